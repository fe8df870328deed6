"""Detection rules over the documents of both datasets.

Rules share these conventions: every rule names its dataset; time windows use `event.start`,
which means the same instant in both datasets; requests are counted by distinct trace id and
never by row, because a retried request has one row per attempt.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from planewatch import constants as K
from planewatch.operators.sequences import in_order


def trace_id() -> Column:
    return F.col("trace.id")


def user_id() -> Column:
    return F.col("user.id")


def event_start() -> Column:
    return F.col("event.start")


def input_tokens() -> Column:
    return F.col("gen_ai.usage.input_tokens")


def output_tokens() -> Column:
    return F.col("gen_ai.usage.output_tokens")


def cost_usd() -> Column:
    return F.col("llm.total_cost_usd")



def content_only(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("dataset") == K.CONTENT)


def gateway_only(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("dataset") == K.GATEWAY)


def in_window(docs: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Half-open window on `event.start`; the day partition is cut as well."""
    if start is not None:
        docs = docs.filter((event_start() >= F.lit(start)) & (F.col("event_date") >= F.lit(start.date())))
    if end is not None:
        docs = docs.filter((event_start() < F.lit(end)) & (F.col("event_date") <= F.lit(end.date())))
    return docs


def hour_of(ts: Column) -> Column:
    return F.window(ts, "1 hour")["start"]


def without_provider(model: Column) -> Column:
    """Model name after the first slash, or all of it."""
    return F.when(F.contains(model, F.lit("/")), F.substr(model, F.locate("/", model) + 1)).otherwise(model)


# ----------------------------------------------------------- content rules

def canary_output(docs: DataFrame, canary: str = K.CANARY) -> DataFrame:
    """The model said the planted secret. Exact case, answers only."""
    return content_only(docs).filter(F.contains(F.col("llm.output"), F.lit(canary))).select(
        trace_id().alias("trace_id"), user_id().alias("user_id"), event_start().alias("event_start")
    )


def mentions_all(text: Column, words: Iterable[str]) -> Column:
    """All words, any order, any case."""
    hit = F.lit(True)
    for word in words:
        hit = hit & text.ilike(f"%{word}%")
    return hit


def mentions_in_order(text: Column, words: Iterable[str]) -> Column:
    return text.ilike("%" + "%".join(words) + "%")


def injection_phrase(docs: DataFrame, words: Iterable[str] = K.INJECTION_WORDS) -> DataFrame:
    return content_only(docs).filter(mentions_all(F.col("llm.user_prompt"), words)).select(
        trace_id().alias("trace_id"), user_id().alias("user_id"), event_start().alias("event_start")
    )


def short_output(docs: DataFrame, limit: int = K.SHORT_OUTPUT_BYTES) -> DataFrame:
    """Refused requests have an empty output and match too; `short_output_rate` leaves them out."""
    length = F.col("llm.output_length")
    return content_only(docs).filter(length < limit).select(
        trace_id().alias("trace_id"), user_id().alias("user_id"), F.col("event.outcome").alias("outcome"),
        length.alias("output_length"),
    )


def short_output_rate(docs: DataFrame, limit: int = K.SHORT_OUTPUT_BYTES) -> DataFrame:
    """Short answers of successful requests per user and hour."""
    hits = content_only(docs).filter(
        (F.col("llm.output_length") < limit) & (F.col("event.outcome") == K.SUCCESS)
    )
    return hits.groupBy(user_id().alias("user_id"), hour_of(event_start()).alias("hour")).agg(
        F.count_distinct(trace_id()).alias("short_outputs")
    )


def _total(tokens: Column) -> Column:
    """A sum that cannot overflow: beyond what a field holds it stays at the largest number, so that absurd
    counts raise an alert and do not hide their user from it."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    return F.least(F.sum(tokens.cast("decimal(21,0)")).cast("decimal(38,0)"), most).cast("bigint")


def token_sum_user(docs: DataFrame) -> DataFrame:
    return content_only(docs).filter(user_id().isNotNull()).groupBy(user_id().alias("user_id")).agg(
        _total(input_tokens()).alias("input_tokens"), _total(output_tokens()).alias("output_tokens")
    )


def token_spike(docs: DataFrame, factor: float = K.SPIKE_FACTOR, history: int = K.SPIKE_HISTORY) -> DataFrame:
    """Hours in which a user's tokens exceed ``factor`` times the mean of their own hours in the
    history before. A user's first hours have no history and raise nothing.

    Requests are summed to hours before the window runs, so what the window sorts per user is
    bounded by the hours in the data however many requests one user sends.
    """
    hourly = (
        content_only(docs)
        .filter(user_id().isNotNull() & input_tokens().isNotNull() & output_tokens().isNotNull() & event_start().isNotNull())
        .groupBy(user_id().alias("user_id"), hour_of(event_start()).alias("hour"))
        .agg(_total(input_tokens().cast("decimal(20,0)") + output_tokens()).alias("tokens"))
    )
    before = (
        Window.partitionBy("user_id").orderBy(F.unix_seconds("hour")).rangeBetween(-history, -1)
    )
    usual = F.avg("tokens").over(before)
    return hourly.withColumn("usual_tokens", usual).filter(F.col("tokens") > factor * F.col("usual_tokens"))


def token_ratio(docs: DataFrame, ratio: float = K.TOKEN_RATIO) -> DataFrame:
    """Long answers to short prompts; needs both counts and a positive input."""
    value = F.when(input_tokens() > 0, F.try_divide(output_tokens().cast("double"), input_tokens().cast("double")))
    return content_only(docs).select(
        trace_id().alias("trace_id"), user_id().alias("user_id"), value.alias("token_ratio")
    ).filter(F.col("token_ratio") > ratio)


def cost_per_session(docs: DataFrame) -> DataFrame:
    session = F.col("session.id")
    return content_only(docs).filter(session.isNotNull()).groupBy(session.alias("session_id")).agg(
        F.sum(cost_usd()).alias("total_cost_usd")
    )


# ----------------------------------------------------------- gateway rules

def model_routing(docs: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """Successful requests for a watched model that were served by none of its expected models.
    ``expected`` (requested -> served names) is configuration written by hand."""
    asked, served = F.col("gen_ai.request.model"), F.col("gen_ai.response.model")
    odd = F.lit(False)
    for requested, names in expected.items():
        odd = odd | ((asked == requested) & ~F.coalesce(served.isin(list(names)), F.lit(False)))
    return gateway_only(docs).filter((F.col("event.outcome") == K.SUCCESS) & odd).select(
        F.col("document_id").alias("request_id"), trace_id().alias("trace_id"),
        asked.alias("requested_model"), served.alias("served_model"),
    )


def budget_blocks(docs: DataFrame) -> DataFrame:
    """Requests refused over budget per hour and key alias."""
    return (
        gateway_only(docs).filter((F.col("event.action") == K.ACTION_BUDGET) & event_start().isNotNull())
        .groupBy(hour_of(event_start()).alias("hour"), F.col("llm.key.alias").alias("key_alias"))
        .agg(F.count_distinct(trace_id()).alias("blocked_requests"))
    )


def auth_clusters(docs: DataFrame) -> DataFrame:
    """Per hour: how many different keys failed, in how many requests."""
    return (
        gateway_only(docs).filter((F.col("event.action") == K.ACTION_AUTH) & event_start().isNotNull())
        .groupBy(hour_of(event_start()).alias("hour"))
        .agg(
            F.count_distinct(F.col("llm.key.hash")).alias("distinct_keys_tried"),
            F.count_distinct(trace_id()).alias("attempts"),
        )
    )


def enforcement_type(docs: DataFrame) -> DataFrame:
    """A 429 split by its reason."""
    action = F.col("event.action")
    return gateway_only(docs).filter(action.isin(K.ACTION_BUDGET, K.ACTION_RATE)).groupBy(
        action.alias("event_action")
    ).agg(F.count_distinct(trace_id()).alias("requests"))


# ------------------------------------------------------- cross-plane rules

def attempt_then_block(docs: DataFrame, span: int = K.SEQUENCE_SPAN,
                       words: Iterable[str] = K.INJECTION_WORDS) -> DataFrame:
    """A gateway failure after an injection-shaped prompt of the same user, at most ``span``
    seconds earlier; each failure is paired with the latest such prompt.

    A sequence of two steps (see ``sequences.in_order``): no self-join, and a busy user is spread over tasks.
    """
    base = docs.filter(user_id().isNotNull() & event_start().isNotNull())
    at = F.unix_micros(event_start()).alias("at")
    attempts = content_only(base).filter(mentions_in_order(F.col("llm.user_prompt"), words)).select(
        user_id().alias("user_id"), at, F.struct(F.lit(None).cast("string").alias("request_id"), trace_id().alias("trace_id")).alias("id")
    )
    failures = gateway_only(base).filter(F.col("event.outcome") == K.FAILURE).select(
        user_id().alias("user_id"), at, F.struct(F.col("document_id").alias("request_id"), trace_id().alias("trace_id")).alias("id")
    )
    attempt, failure = F.col("chain")[0], F.col("chain")[1]
    return in_order([attempts, failures], span).select(
        "user_id", failure["id"]["request_id"].alias("request_id"), failure["id"]["trace_id"].alias("trace_id"),
        F.timestamp_micros("at").alias("failed_at"),
        attempt["id"]["trace_id"].alias("attempt_trace_id"),
        F.timestamp_micros(attempt["at"]).alias("attempted_at"),
    )


def content_without_gateway(docs: DataFrame, baseline: DataFrame, start: datetime | None = None,
                            end: datetime | None = None) -> DataFrame:
    """Requests the gateway has no record of, known exceptions left out.

    One grouping over ids instead of two anti-joins: every source is cut to distinct ids before
    the shuffle, and neither the gateway side nor the list of exceptions is broadcast or sorted
    against the other.
    """
    window = in_window(docs, start, end)
    seen = window.filter(trace_id().isNotNull()).select(
        trace_id().alias("trace_id"), (F.col("dataset") == K.CONTENT).alias("content")
    )
    known = baseline.select("trace_id", F.lit(False).alias("content"))
    return (
        seen.unionByName(known)
        .groupBy("trace_id")
        .agg(F.bool_or("content").alias("content"), F.bool_or(~F.col("content")).alias("explained"))
        .filter(F.col("content") & ~F.col("explained"))
        .select("trace_id")
    )


def cost_disagreement(docs: DataFrame, tolerance: float = K.COST_TOLERANCE) -> DataFrame:
    """Requests whose cost differs between the planes, relative to the larger one."""
    def side(dataset: str) -> Column:
        return F.sum(F.when(F.col("dataset") == dataset, cost_usd()))

    gateway, content = F.col("gateway_cost"), F.col("content_cost")
    return (
        docs.filter(trace_id().isNotNull() & cost_usd().isNotNull())
        .groupBy(trace_id().alias("trace_id"))
        .agg(side(K.GATEWAY).alias("gateway_cost"), side(K.CONTENT).alias("content_cost"))
        .filter((gateway > 0) & (content > 0))
        .withColumn("difference", F.abs(gateway - content) / F.greatest(gateway, content))
        .filter(F.col("difference") > tolerance)
    )


def model_disagreement(docs: DataFrame) -> DataFrame:
    """Requests for which the planes name different served models, provider prefix aside. Of
    several served attempts the last one counts, as it does in the content record."""
    served = F.col("gen_ai.response.model")

    def side(dataset: str) -> Column:
        order = F.struct(event_start().alias("at"), F.col("document_id").alias("id"))
        return F.max(F.when(F.col("dataset") == dataset, F.struct(order.alias("o"), served.alias("model"))))["model"]

    return (
        docs.filter(trace_id().isNotNull() & served.isNotNull())
        .groupBy(trace_id().alias("trace_id"))
        .agg(side(K.GATEWAY).alias("gateway_model"), side(K.CONTENT).alias("content_model"))
        .filter(without_provider(F.col("gateway_model")) != without_provider(F.col("content_model")))
    )


def _prompt_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(prompt digest, key hash) pairs of matched requests.

    Prompts are reduced to a digest before the join, and the gateway side to distinct (trace,
    key) pairs, so long texts are not shuffled and a trace id that holds a large share of the
    attempts shrinks to its few keys.
    """
    prompt = F.col("llm.user_prompt")
    prompts = content_only(docs).filter(trace_id().isNotNull() & (F.char_length(prompt) > min_chars)).select(
        trace_id().alias("trace_id"), F.sha2(prompt, 256).alias("prompt_sha256"),
        F.char_length(prompt).cast("bigint").alias("prompt_chars"), user_id().alias("user_id"),
    )
    keys = gateway_only(docs).filter(trace_id().isNotNull() & F.col("llm.key.hash").isNotNull()).select(
        trace_id().alias("trace_id"), F.col("llm.key.hash").alias("key_hash")
    ).distinct()
    return prompts.join(keys, "trace_id")


def prompt_many_keys(docs: DataFrame, min_chars: int = K.PROMPT_MIN_CHARS, min_keys: int = K.PROMPT_MIN_KEYS,
                     allowed_sha256: DataFrame | None = None, start: datetime | None = None,
                     end: datetime | None = None) -> DataFrame:
    """One prompt under many keys within a window. ``allowed_sha256`` holds digests of known
    template prompts."""
    pairs = _prompt_keys(in_window(docs, start, end), min_chars)
    if allowed_sha256 is not None:
        pairs = pairs.join(allowed_sha256.select("prompt_sha256").distinct(), "prompt_sha256", "left_anti")
    return pairs.groupBy("prompt_sha256").agg(
        F.max("prompt_chars").alias("prompt_chars"), F.count_distinct("key_hash").alias("distinct_keys")
    ).filter(F.col("distinct_keys") >= min_keys)


def prompt_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The full text behind the digests of `prompt_many_keys`."""
    prompt = F.col("llm.user_prompt")
    texts = content_only(docs).select(F.sha2(prompt, 256).alias("prompt_sha256"), prompt.alias("user_prompt"))
    return texts.join(found.select("prompt_sha256"), "prompt_sha256", "left_semi").distinct()


def key_many_users(docs: DataFrame) -> DataFrame:
    """The mirror image: prompts and users behind one key."""
    return _prompt_keys(docs, min_chars=0).groupBy("key_hash").agg(
        F.count_distinct("prompt_sha256").alias("distinct_prompts"),
        F.count_distinct("user_id").alias("distinct_users"),
    )
