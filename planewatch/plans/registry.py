"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over all rows of the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.functions import content as B
from planewatch.functions import documents as D
from planewatch.operators import correlate as G
from planewatch.operators import detections as R
from planewatch.operators import health as H
from planewatch.operators import quality as Q
from planewatch.operators.scorecard import detection_scorecard
from planewatch.operators.upsert import upsert_latest, upsert_stored
from planewatch.plans import derive
from planewatch.session import apply_conf, scratch_dir
from planewatch.sources import archive as A
from planewatch.sources import planes
from planewatch.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Configuration the rules are run with. Expected pairs: what normally serves each model.
EXPECTED_MODELS = {
    "model-a": [f"{p}/model-a" for p in planes.PROVIDERS],
    "model-b": [f"{p}/model-b" for p in planes.PROVIDERS],
}
NOW = datetime(2024, 1, 16)
BASE_URL = "https://traces.example/"
# Digest of a key name that is known to be harmless.
ALLOWED_HASHES = [hashlib.sha256(b"key-0").hexdigest()]
# Rules 11 and 14 look at a window; three days give them something to find in these tables.
RULE_WINDOW = timedelta(days=3)
HEALTH_LAG = int(H.join_health_lag(timedelta(seconds=30), timedelta(seconds=10)).total_seconds())
PROVIDER_EXCEPTIONS = ["ai21", "cloudflare", "replicate"]
# What the gateway's release would list, as far as these records need it.
KNOWN_PROVIDERS = ["groq", "openai", "bedrock", "ollama_chat", "anthropic", "azure", "vertex_ai", "mistral", "cloudflare", "voyage", "nlp_cloud"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_conf(spark), sf_dir)

        _QUERIES[name] = run
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --------------------------------------------------------------- shared inputs

# Only plans and paths are kept here, never data: building a plan takes some thousand calls to
# the JVM, and most queries start from the same few.
@lru_cache(maxsize=32)
def lines(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    return planes.content_lines(spark, sf_dir) if dataset == K.CONTENT else planes.gateway_lines(spark, sf_dir)


@lru_cache(maxsize=32)
def events(spark: SparkSession, sf_dir: str, dataset: str, skip_health: bool = True) -> DataFrame:
    return derive.latest_events(lines(spark, sf_dir, dataset), dataset, skip_health)


@lru_cache(maxsize=32)
def stored(spark: SparkSession, sf_dir: str, dataset: str) -> str:
    """Path of the documents of one dataset, derived from the tables and written on first use.

    Rules run on stored documents, as they do in operation: records are parsed once when they
    come in, and not again by every rule. The table is in the shared folder, partitioned by day,
    so a rule reads the columns and days it needs, and a lost executor loses nothing.
    """
    staged, path = scratch_dir(spark, f"events-{dataset}"), scratch_dir(spark, f"documents-{dataset}")
    kept = derive.kept_events(lines(spark, sf_dir, dataset), dataset)
    kept.write.option("compression", "zstd").parquet(staged)
    latest = upsert_stored(spark.read.schema(kept.schema).parquet(staged), keys=("document_id",))
    A.write_documents(derive.documents_of(latest, dataset), path, rebalance=False)
    return path


@lru_cache(maxsize=32)
def documents(spark: SparkSession, sf_dir: str, dataset: str | None = None) -> DataFrame:
    """The stored documents of one dataset, or the view over both."""
    if dataset is None:
        return A.dataset_view(documents(spark, sf_dir, K.CONTENT), documents(spark, sf_dir, K.GATEWAY))
    schema = S.CONTENT_DOCUMENT if dataset == K.CONTENT else S.GATEWAY_DOCUMENT
    return spark.read.schema(schema).parquet(stored(spark, sf_dir, dataset))


def _usd(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 9)


def _both(per_dataset: Callable[[str], DataFrame]) -> DataFrame:
    return per_dataset(K.CONTENT).unionByName(per_dataset(K.GATEWAY))



# -------------------------------------------------------- A: scan, ingest, store

def _archived(spark: SparkSession, sf_dir: str, dataset: str) -> str:
    path = scratch_dir(spark, f"archive-{dataset}")
    planes.write_archive(lines(spark, sf_dir, dataset), path, "gzip")
    return path


def _scan(spark: SparkSession, sf_dir: str, dataset: str, field: str) -> DataFrame:
    found = A.scan_archive(spark, _archived(spark, sf_dir, dataset))
    record = F.regexp_extract("raw", f'"{field}":"([^"]*)"', 1)
    return found.groupBy(record.alias("record_id")).agg(F.count(F.lit(1)).alias("lines"))


@query("scan_content")
def scan_content(spark, sf_dir):
    return _scan(spark, sf_dir, K.CONTENT, "id")


@query("scan_gateway")
def scan_gateway(spark, sf_dir):
    return _scan(spark, sf_dir, K.GATEWAY, "request_id")


def _decoded(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    return derive.decode(lines(spark, sf_dir, dataset).filter(~A.is_blank(F.col("raw"))), dataset)


@lru_cache(maxsize=32)
def passed(spark: SparkSession, sf_dir: str) -> derive.BackfillRun:
    """One pass over the lines of both datasets, written by what each line is, on first use."""
    return derive.BackfillRun(spark, {d: lines(spark, sf_dir, d) for d in (K.CONTENT, K.GATEWAY)}, scratch_dir(spark, "passed"))


@query("quarantine")
def quarantine(spark, sf_dir):
    return _both(passed(spark, sf_dir).quarantine).select(
        "dataset", F.col("ingest_seq.row").alias("ingest_row"), "reason",
        F.octet_length("excerpt").cast("bigint").alias("excerpt_bytes"),
    )


@query("require_document_id")
def require_document_id(spark, sf_dir):
    def kept(d: str) -> DataFrame:
        # All decoded lines, unusable ones included: they are what has no id.
        to_events = B.content_events if d == K.CONTENT else derive.gateway_events
        found = A.require_document_id(to_events(_decoded(spark, sf_dir, d)))
        return found.groupBy(F.lit(d).alias("dataset"), "document_id").agg(F.count(F.lit(1)).alias("versions"))

    return _both(kept)


@query("upsert_latest")
def upsert(spark, sf_dir):
    def latest(d: str) -> DataFrame:
        docs = upsert_latest(derive.documents_from_lines(lines(spark, sf_dir, d), d))
        return docs.select(
            "dataset", "document_id", F.col("ingest_seq.row").alias("ingest_row"),
            F.col("event.duration").alias("duration_ns"),
        )

    return _both(latest)


@query("initial_bound")
def initial_bound(spark, sf_dir):
    def bounded(d: str) -> DataFrame:
        latest = derive.latest_events(lines(spark, sf_dir, d), d, bound=lambda e: A.initial_bound(e, d, now=NOW))
        return latest.select(F.lit(d).alias("dataset"), "document_id", "request_ts")

    return _both(bounded)


@query("backfill")
def backfill(spark, sf_dir):
    archives = {d: _archived(spark, sf_dir, d) for d in (K.CONTENT, K.GATEWAY)}
    return derive.BackfillRun(spark, archives, scratch_dir(spark, "backfill")).all_documents().select(
        "dataset", "document_id", F.col("event.start").alias("event_start"),
        F.col("event.outcome").alias("outcome"), F.col("event.duration").alias("duration_ns"),
    )


@query("drop_health_checks")
def drop_health_checks(spark, sf_dir):
    return _both(lambda d: events(spark, sf_dir, d).select(F.lit(d).alias("dataset"), "document_id"))


@query("dataset_view")
def dataset_view(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "dataset", "document_id", R.trace_id().alias("trace_id"), R.event_start().alias("event_start"),
        F.col("event.outcome").alias("outcome"), F.col("llm.output_length").alias("output_length"),
        F.col("http.response.status_code").alias("status_code"), F.col("llm.key.alias").alias("key_alias"),
    )


@query("load_baseline")
def load_baseline(spark, sf_dir):
    path = scratch_dir(spark, "baseline")
    ids = planes.baseline(spark, sf_dir)
    # One JSON document per id: written and read in parallel.
    ids.select(F.lit("predates the join key").alias("reason"), F.array("trace_id").alias("trace_ids")).write.json(path)
    return A.load_baseline(spark, path, one_document=False)


@query("ingest_counters")
def ingest_counters(spark, sf_dir):
    return _both(passed(spark, sf_dir).counters)


# ------------------------------------------------------------ B: content records

def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, K.CONTENT)


def _content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every good line, replays included."""
    parts = B.content_parts(A.good_lines(_decoded(spark, sf_dir, K.CONTENT)))
    return parts.withColumn("trace_id", B.text_of(F.col("w.id"))).withColumn("ingest_row", F.col("ingest_seq.row"))


@query("parse_content")
def parse_content(spark, sf_dir):
    return _content(spark, sf_dir).select(
        "trace_id", "environment", "session_id", "user_id", "trace_name", F.array_join("tags", ",").alias("tags"),
        "request_ts", "ingest_ts", _usd("cost").alias("cost"),
    )


@query("project_id_fallback")
def project_id_fallback(spark, sf_dir):
    return _content(spark, sf_dir).select("trace_id", "project_id", "source_ref")


@query("parse_messages")
def parse_messages(spark, sf_dir):
    m = F.col("messages")
    return _content(spark, sf_dir).select(
        "trace_id",
        F.coalesce(F.array_join(F.transform(m, lambda x: x["role"]), ","), F.lit("")).alias("roles"),
        F.md5(F.coalesce(F.array_join(F.transform(m, lambda x: x["content"]), "|"), F.lit(""))).alias("contents_md5"),
    )


@query("parse_output")
def parse_output(spark, sf_dir):
    return _content(spark, sf_dir).select("trace_id", "output_role", F.md5("output").alias("output_md5"))


@query("decode_observations")
def decode_observations(spark, sf_dir):
    return _content_parts(spark, sf_dir).select(
        "trace_id", "ingest_row", F.col("obs").isNotNull().alias("has_detail"),
        F.when(F.col("obs").isNotNull(), F.size("obs")).cast("bigint").alias("observations"),
    )


@query("order_generations")
def order_generations(spark, sf_dir):
    ids = F.transform(B.ordered_generations(F.col("obs")), lambda t: t["o"]["id"])
    return _content_parts(spark, sf_dir).select("trace_id", "ingest_row", F.array_join(ids, ",").alias("generations"))


@query("reduce_generations")
def reduce_generations(spark, sf_dir):
    return _content(spark, sf_dir).select(
        "trace_id", "status", "status_message", "request_model", "response_model", "response_id", "max_tokens",
        "input_tokens", "output_tokens", "generation_count", "errored_generation_count", _usd("cost").alias("cost"),
    )


@query("request_bounds")
def request_bounds(spark, sf_dir):
    return _content(spark, sf_dir).select(
        "trace_id", F.col("start_ts").alias("event_start"), F.col("end_ts").alias("event_end")
    )


@query("completion_id")
def completion_id(spark, sf_dir):
    exploded = _content_parts(spark, sf_dir).select("trace_id", "ingest_row", F.explode("obs").alias("o"))
    return exploded.select(
        "trace_id", "ingest_row", F.col("o.id").alias("observation_id"),
        B.completion_id(F.col("o.id")).alias("completion_id"),
    )


@query("scenario_label")
def scenario_label(spark, sf_dir):
    return _content(spark, sf_dir).select("trace_id", "trace_name", "scenario")


@query("content_health_check")
def content_health_check(spark, sf_dir):
    return events(spark, sf_dir, K.CONTENT, skip_health=False).select("document_id", "is_health_check")


@query("duration_ns")
def duration_ns(spark, sf_dir):
    return _content(spark, sf_dir).select("trace_id", "duration_ns")


# ------------------------------------------------------------ C: gateway records

def _gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, K.GATEWAY)


def _gateway_query(name: str, *columns: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        return _gateway(spark, sf_dir).selectExpr("document_id AS request_id", *columns)


_gateway_query("parse_gateway", "call_id", "key_alias", "key_hash", "team_id", "provider", "call_type", "requester_ip")
_gateway_query("join_key", "trace_id")
_gateway_query("trusted_session", "status", "session_id")
_gateway_query("gateway_user", "user_id")
_gateway_query("gateway_times", "start_ts AS event_start", "end_ts AS event_end", "duration_ns")
_gateway_query("gateway_status", "status", "status_message", "error_class", "error_code", "http_status")
_gateway_query("gateway_models", "request_model", "response_model", "response_id")
_gateway_query("absent_not_zero", "input_tokens", "output_tokens", "round(cost, 9) AS cost")
_gateway_query("clean_tags", "array_join(tags, ',') AS tags")
_gateway_query("attempted_retries", "attempted_retries")


@query("gateway_health_check")
def gateway_health_check(spark, sf_dir):
    return events(spark, sf_dir, K.GATEWAY, skip_health=False).select("document_id", "is_health_check")


# ------------------------------------------------------ D: document derivation

def _document_query(name: str, *columns: str, dataset: str | None = None) -> None:
    @query(name)
    def run(spark, sf_dir):
        return documents(spark, sf_dir, dataset).selectExpr("dataset", "document_id", *columns)


_document_query(
    "common_fields", "ts", "schema_version", "event.kind AS kind", "event.module AS module", "event.outcome AS outcome",
    "event.start AS event_start", "event.end AS event_end", "event.ingested AS ingested", "event.duration AS duration_ns",
    "trace.id AS trace_id", "session.id AS session_id", "user.id AS user_id", "error.message AS error_message", "event_date",
)
_document_query(
    "last_message_by_role", "md5(llm.system_prompt) AS system_md5", "md5(llm.user_prompt) AS user_md5", dataset=K.CONTENT
)
_document_query("encode_messages", "md5(llm.messages) AS messages_md5", dataset=K.CONTENT)
_document_query(
    "content_sizes", "llm.message_count AS message_count", "llm.output_length AS output_length", dataset=K.CONTENT
)
_document_query("genai_system", "gen_ai.system AS system")
_document_query("genai_operation", "gen_ai.operation.name AS operation")
_document_query("event_types", "array_join(event.type, ',') AS event_types", dataset=K.GATEWAY)
_document_query("event_categories", "array_join(event.category, ',') AS event_categories")
_document_query("event_action", "event.action AS action", dataset=K.GATEWAY)
_document_query("related_users", "array_join(related.user, ',') AS related_users")
_document_query("null_groups", *[
    f"{g} IS NOT NULL AS has_{g.split('.')[-1]}"
    for g in ("trace", "session", "gen_ai.request", "gen_ai.response", "gen_ai.usage", "error", "http", "related")
])
_document_query("gateway_has_no_content", *[
    f"llm.{f} IS NULL AS no_{f}"
    for f in ("user_prompt", "output", "messages", "message_count", "output_length", "generation_count")
])


@query("event_reference")
def event_reference(spark, sf_dir):
    docs = D.content_documents(_content(spark, sf_dir), BASE_URL)
    return docs.select("document_id", F.col("event.reference").alias("reference"))


# ------------------------------------------------------------- E: data quality

def _made_schemas(spark: SparkSession, sf_dir: str) -> dict[str, list]:
    """Per dataset the schema of the documents as they are derived, and as the stored files say themselves."""
    derived = {K.CONTENT: D.content_documents, K.GATEWAY: D.gateway_documents}
    return {d: [make(events(spark, sf_dir, d)).schema, spark.read.parquet(stored(spark, sf_dir, d)).schema] for d, make in derived.items()}


@query("schema_parity")
def schema_parity(spark, sf_dir):
    content = documents(spark, sf_dir, K.CONTENT)
    gateway = documents(spark, sf_dir, K.GATEWAY)
    made = _made_schemas(spark, sf_dir)
    problems = [p for a, b in zip(made[K.CONTENT], made[K.GATEWAY], strict=True) for p in Q.schema_parity(a, b)]
    if problems:
        raise ValueError("; ".join(problems))
    return Q.field_census(content, gateway)


@query("declared_fields")
def declared_fields(spark, sf_dir):
    docs = {K.CONTENT: documents(spark, sf_dir, K.CONTENT), K.GATEWAY: documents(spark, sf_dir, K.GATEWAY)}
    declared = {K.CONTENT: S.CONTENT_DOCUMENT, K.GATEWAY: S.GATEWAY_DOCUMENT}
    problems = [p for d, made in _made_schemas(spark, sf_dir).items() for m in made for p in Q.declared_fields(m, declared[d])]
    if problems:
        raise ValueError("; ".join(problems))
    return _both(lambda d: docs[d].groupBy("dataset", "schema_version").agg(F.count(F.lit(1)).alias("documents")))


@query("merged_traces")
def merged_traces(spark, sf_dir):
    return Q.merged_traces(_content(spark, sf_dir))


@query("credential_scan")
def credential_scan(spark, sf_dir):
    spends = planes.gateway_lines(spark, sf_dir).select(
        F.concat(F.lit("line-"), F.col("ingest_seq.row").cast("string")).alias("source"), "raw"
    )
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("raw")
    )
    return Q.credential_scan(spends.unionByName(texts), "source", "raw", allowed_hashes=ALLOWED_HASHES)


@query("provider_coverage")
def provider_coverage(spark, sf_dir):
    path = scratch_dir(spark, "providers")
    spark.createDataFrame([(p,) for p in ["# providers of this release", "", *KNOWN_PROVIDERS]], "value string").coalesce(1).write.text(path)
    known = A.load_names(spark, path, "provider")
    return Q.provider_coverage(_gateway(spark, sf_dir).select("provider"), PROVIDER_EXCEPTIONS, known)


@query("unknown_provider_audit")
def unknown_provider_audit(spark, sf_dir):
    return Q.unknown_provider_audit(documents(spark, sf_dir))


@query("join_key_fanout")
def join_key_fanout(spark, sf_dir):
    return Q.join_key_fanout(documents(spark, sf_dir, K.GATEWAY), more_than=1)


# --------------------------------------------------------------- F: detections

def _rule(name: str, build: Callable[[DataFrame], DataFrame], dataset: str | None = None) -> None:
    """A rule over the view, or over the table of the only dataset it looks at."""
    @query(name)
    def run(spark, sf_dir):
        return build(documents(spark, sf_dir, dataset))


_rule("d01_canary_output", R.canary_output, K.CONTENT)
_rule("d02_injection_phrase", R.injection_phrase, K.CONTENT)
_rule("d03_short_output", R.short_output, K.CONTENT)
_rule("d03_short_output_rate", R.short_output_rate, K.CONTENT)
_rule("d04_token_sum_user", R.token_sum_user, K.CONTENT)
_rule("d04_token_spike", lambda d: R.token_spike(d).withColumn("usual_tokens", F.round("usual_tokens", 6)), K.CONTENT)
_rule("d05_token_ratio", lambda d: R.token_ratio(d).withColumn("token_ratio", F.round("token_ratio", 9)), K.CONTENT)
_rule("d06_cost_per_session", lambda d: R.cost_per_session(d).withColumn("total_cost_usd", _usd("total_cost_usd")), K.CONTENT)
_rule("d07_model_routing", lambda d: R.model_routing(d, EXPECTED_MODELS), K.GATEWAY)
_rule("d08_budget_blocks", R.budget_blocks, K.GATEWAY)
_rule("d09_attempt_then_block", R.attempt_then_block)
_rule("d10_auth_clusters", R.auth_clusters, K.GATEWAY)
_rule("d12_cost_disagreement", lambda d: R.cost_disagreement(d).select(
    "trace_id", _usd("gateway_cost").alias("gateway_cost"), _usd("content_cost").alias("content_cost")))
_rule("d13_model_disagreement", R.model_disagreement)
_rule("d14_key_many_users", R.key_many_users)
_rule("d15_enforcement_type", R.enforcement_type, K.GATEWAY)


@query("d11_content_without_gateway")
def d11_content_without_gateway(spark, sf_dir):
    """A window that ends one lag before now, so that a record still on its way is not reported."""
    end = NOW - timedelta(seconds=HEALTH_LAG)
    return R.content_without_gateway(documents(spark, sf_dir), planes.baseline(spark, sf_dir), end - RULE_WINDOW, end)


@query("d14_prompt_many_keys")
def d14_prompt_many_keys(spark, sf_dir):
    """Within a window, known templates left out: here the prompts of conversations with a system text."""
    known = planes.conversation_texts(spark, sf_dir).filter("system_text IS NOT NULL AND user_text IS NOT NULL")
    allowed = known.select(F.sha2("user_text", 256).alias("prompt_sha256"))
    return R.prompt_many_keys(documents(spark, sf_dir), allowed_sha256=allowed, start=NOW - RULE_WINDOW, end=NOW)


# ------------------------------------------------ G: correlation, join health

_rule("correlate", lambda d: G.correlate(d).select(
    "trace_id", "request_id", "side", "content_outcome", "gateway_outcome", "content_start", "gateway_start"))
_rule("resolve_request", lambda d: G.resolve_request(d).select(
    "trace_id", "attempts", "has_content", "event_start", "outcome", "gateway_outcome", "content_outcome",
    _usd("cost_usd").alias("cost_usd"), _usd("gateway_cost").alias("gateway_cost"),
    _usd("content_cost").alias("content_cost"), "input_tokens", "output_tokens", "requested_model",
    "served_model", "gateway_model", "content_model", "system", "user_id", "session_id",
    F.md5("user_prompt").alias("prompt_md5"), F.md5("output").alias("output_md5")))
_rule("completion_id_crosscheck", G.completion_id_crosscheck)
_rule("attempts_per_request", lambda d: G.attempts_per_request(d).withColumn(
    "attempts_per_request", F.round("attempts_per_request", 9)), K.GATEWAY)
_rule("correlation_window", lambda d: G.correlation_window(d).select("trace_id", "request_id", "skew_us"))
_rule("forged_health_tag", G.forged_health_tag, K.GATEWAY)


@query("join_health_lag")
def join_health_lag(spark, sf_dir):
    """The lag each row's intervals would need: fetch and index intervals taken from the data."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    lag = H.lag_seconds(fetch=k, index=k * 2)
    return e.groupBy(k.alias("fetch_seconds")).agg(F.max(lag).alias("lag_seconds"), F.count(F.lit(1)).alias("rows"))


# The default measurement is a quarter of an hour; three days give it something to count here.
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.join_health(
        documents(spark, sf_dir), planes.baseline(spark, sf_dir), NOW, window_seconds=3 * 86400, lag_seconds=HEALTH_LAG
    )


@query("join_health")
def join_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query("join_health_rates")
def join_health_rates(spark, sf_dir):
    return H.with_rates(_health(spark, sf_dir)).select(
        F.round("content_unexplained_rate", 9).alias("content_unexplained_rate"),
        F.round("gateway_unexplained_rate", 9).alias("gateway_unexplained_rate"), "healthy",
    )


@query("join_health_series")
def join_health_series(spark, sf_dir):
    return H.join_health_series(documents(spark, sf_dir), planes.baseline(spark, sf_dir), lag_seconds=HEALTH_LAG)


# ---------------------------------------------------------------- H: evaluation

@query("detection_scorecard")
def scorecard(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return detection_scorecard(docs, {
        "canary_output": R.canary_output(docs),
        "injection_phrase": R.injection_phrase(docs),
        "short_output": R.short_output(docs),
        "token_ratio": R.token_ratio(docs),
        "model_routing": R.model_routing(docs, EXPECTED_MODELS),
        "attempt_then_block": R.attempt_then_block(docs),
        "content_without_gateway": R.content_without_gateway(docs, planes.baseline(spark, sf_dir)),
        "cost_disagreement": R.cost_disagreement(docs),
        "model_disagreement": R.model_disagreement(docs),
    })


# ----------------------------------------------------------------- I: streaming

@lru_cache(maxsize=32)
def rolled(spark: SparkSession, sf_dir: str, dataset: str) -> str:
    """Path of the archive as rolled files, which all streams read; written on first use."""
    path = scratch_dir(spark, f"rolled-{dataset}")
    planes.write_rolled(lines(spark, sf_dir, dataset), path, scratch_dir(spark, f"lines-{dataset}"), compression="gzip")
    runs.append_closing_record(spark, path, dataset)
    return path


@query("incremental_ingest")
def incremental_ingest(spark, sf_dir):
    """The archive grows while it is read: half of it is there at the first run, all of it at the second,
    which goes on from the checkpoint of the first."""
    path, folder = scratch_dir(spark, "growing"), scratch_dir(spark, "ledger")
    planes.write_rolled(
        lines(spark, sf_dir, K.GATEWAY), path, scratch_dir(spark, "lines"),
        after=lambda k: runs.take_new_records(spark, path, folder) if k in (2, 5) else None,
    )
    return runs.taken_records(spark, folder)


def _stream_query(name: str, run_stream: Callable[..., DataFrame], *datasets: str, files: int = 1) -> None:
    """Streams read rolled files in the order of time, so many per micro-batch; each with all of its parts."""
    @query(name)
    def run(spark, sf_dir):
        paths = {d: rolled(spark, sf_dir, d) for d in datasets}
        return run_stream(spark, paths, files_per_batch={d: files * planes.rolled_parts(spark, p) for d, p in paths.items()})


_stream_query("stream_upsert_sink", runs.upsert_sink, K.CONTENT, K.GATEWAY, files=3)
_stream_query("stream_hourly_blocks", runs.hourly_blocks, K.GATEWAY)
_stream_query("stream_hourly_auth", runs.hourly_auth, K.GATEWAY)
_stream_query("stream_enforcement_type", runs.hourly_enforcement, K.GATEWAY)
_stream_query("stream_unmatched", runs.unmatched, K.CONTENT, K.GATEWAY)
_stream_query("stream_sequence", runs.sequence, K.CONTENT, K.GATEWAY)
