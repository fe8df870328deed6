"""Fixed values. They have to match what the two recording systems write and what existing
rules look for, so they are listed here as plain text and used nowhere else as literals."""

# Dataset names of the two planes.
CONTENT = "content"
GATEWAY = "gateway"

SCHEMA_VERSION = "9.4.0"
EVENT_KIND = "event"
EVENT_MODULE = "planewatch"

# Marker of the proxy's own health checks: a tag, and the name of the account it bills.
HEALTH_MARKER = "litellm-internal-health-check"

GENERATION = "GENERATION"
ERROR_LEVEL = "ERROR"
COMPLETION_PREFIX = "chatcmpl-"
PSEUDO_TAG_PREFIX = "User-Agent:"

SUCCESS = "success"
FAILURE = "failure"

UNKNOWN_PROVIDER = "unknown"
DEFAULT_OPERATION = "chat"

SCENARIO_PREFIX = "scenario-"
SCENARIOS = ["benign", "injection", "truncated"]

AUTH_ERROR_CLASSES = [
    "KeyNotFoundError",
    "AuthenticationError",
    "ProxyAuthError",
    "InvalidAPIKeyError",
    "ExpiredKeyError",
]
AUTH_STATUS_CODES = [401, 403]
BUDGET_ERROR_CLASS = "BudgetExceededError"
RATE_ERROR_CLASSES = ["ProxyRateLimitError", "RateLimitError"]

ACTION_OK = "chat_completion"
ACTION_BUDGET = "budget_exceeded"
ACTION_RATE = "rate_limited"
ACTION_AUTH = "auth_failure"
ACTION_FAILED = "request_failed"

# Route prefix -> provider vocabulary.
PROVIDER_SYSTEMS = {
    "anthropic": "anthropic",
    "azure": "azure.ai.openai",
    "azure_ai": "azure.ai.inference",
    "bedrock": "aws.bedrock",
    "cohere": "cohere",
    "deepseek": "deepseek",
    "gemini": "gcp.gemini",
    "groq": "groq",
    "hosted_vllm": "vllm",
    "llamafile": "llamafile",
    "lm_studio": "lm_studio",
    "mistral": "mistral_ai",
    "ollama": "ollama",
    "ollama_chat": "ollama",
    "openai": "openai",
    "openrouter": "openrouter",
    "perplexity": "perplexity",
    "together_ai": "together_ai",
    "vertex_ai": "gcp.vertex_ai",
    "vllm": "vllm",
    "watsonx": "ibm.watsonx.ai",
    "xai": "xai",
}

# Call type -> operation vocabulary.
CALL_OPERATIONS = {
    "acompletion": "chat",
    "aembedding": "embeddings",
    "atext_completion": "text_completion",
    "completion": "chat",
    "embedding": "embeddings",
    "text_completion": "text_completion",
}

# Text patterns.
PROJECT_PATH = r"/project/([^/]+)/"
ZONED_TIME = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})\z"
NAIVE_TIME = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?\z"
HTTP_STATUS = r"\A[1-5][0-9]{2}\z"
HEX_DIGEST = r"[0-9a-f]{64}"
SECRET_TOKEN = r"sk-[A-Za-z0-9._\-]*"
REDACTED_TOKEN = r"\Ask-\.\.\.[A-Za-z0-9]{1,8}\z"

EXCERPT_BYTES = 200

# Windows and thresholds (seconds unless the name says otherwise).
OVERLAP = 300
GATEWAY_LOOK_BACK = 86400
CORRELATION_WINDOW = 300
COST_TOLERANCE = 1e-6
CANARY = "XK9-Canaries-77"
INJECTION_WORDS = ["ignore", "previous", "instructions"]
SHORT_OUTPUT_BYTES = 20
TOKEN_RATIO = 2.0
SPIKE_FACTOR = 5
SPIKE_HISTORY = 7 * 86400
SEQUENCE_SPAN = 900
PROMPT_MIN_CHARS = 100
PROMPT_MIN_KEYS = 3
VISIBILITY_BUDGET = 30
MIN_LAG = 120
HEALTH_WINDOW = 900
HEALTH_PERIOD = 300
