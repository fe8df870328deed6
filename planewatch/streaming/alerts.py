"""Rules on streams of documents (see `ingest.stream_documents`: `event_ts` has the watermark)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from planewatch import constants as K
from planewatch.operators.detections import trace_id, user_id, mentions_in_order

HOUR = "1 hour"


def _seen(condition: Column) -> Column:
    """A condition that stays above the watermark. Otherwise Spark filters first, the watermark
    moves only with the rows a rule looks for, and a rare event is reported when the next comes."""
    return F.when(F.col("event_ts").isNotNull(), condition)


def _per_hour(found: DataFrame, *keys: str) -> DataFrame:
    """Distinct values per hour. A stream has no count-distinct, so it is two groupings: one row
    per hour and value, then rows per hour. ``found`` has `kind` and `value` next to the keys."""
    once = found.groupBy(F.window("event_ts", HOUR).alias("slot"), *keys, "kind", "value").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return once.groupBy(F.window(F.window_time("slot"), HOUR).alias("w"), *keys)


def hourly_blocks(gateway: DataFrame) -> DataFrame:
    found = gateway.filter(_seen(F.col("event.action") == K.ACTION_BUDGET)).select(
        "event_ts", F.col("llm.key.alias").alias("key_alias"), F.lit("trace").alias("kind"), trace_id().alias("value")
    )
    return _per_hour(found, "key_alias").agg(F.count("value").alias("blocked_requests")).select(
        F.col("w.start").alias("hour"), "key_alias", "blocked_requests"
    )


def hourly_auth(gateway: DataFrame) -> DataFrame:
    """Two distinct counts at once: both kinds of value go through the same two groupings."""
    both = F.array(
        F.struct(F.lit("key").alias("kind"), F.col("llm.key.hash").alias("value")),
        F.struct(F.lit("trace").alias("kind"), trace_id().alias("value")),
    )
    found = gateway.filter(_seen(F.col("event.action") == K.ACTION_AUTH)).select("event_ts", F.inline(both))

    def of(kind: str):
        return F.count(F.when(F.col("kind") == kind, F.col("value")))

    return _per_hour(found).agg(of("key").alias("distinct_keys_tried"), of("trace").alias("attempts")).select(
        F.col("w.start").alias("hour"), "distinct_keys_tried", "attempts"
    )


def hourly_enforcement(gateway: DataFrame) -> DataFrame:
    action = F.col("event.action")
    found = gateway.filter(_seen(action.isin(K.ACTION_BUDGET, K.ACTION_RATE))).select(
        "event_ts", action.alias("event_action"), F.lit("trace").alias("kind"), trace_id().alias("value")
    )
    return _per_hour(found, "event_action").agg(F.count("value").alias("requests")).select(
        F.col("w.start").alias("hour"), "event_action", "requests"
    )


def unmatched(content: DataFrame, gateway: DataFrame, seconds: int = K.CORRELATION_WINDOW) -> DataFrame:
    """Requests that stay without a partner, in both directions, once the watermark has passed.

    Attempts are grouped to one row per trace id and slot before the join. The grouping is
    combined before the shuffle and keeps first and last start, which is enough to test the
    time bound exactly: a slot is narrower than the bound, so it cannot hold both of its ends.
    """
    attempts = gateway.filter(_seen(trace_id().isNotNull())).groupBy(
        F.window("event_ts", f"{seconds} seconds").alias("slot"), trace_id().alias("gateway_trace")
    ).agg(F.min("event_ts").alias("first_at"), F.max("event_ts").alias("last_at")).select(
        "gateway_trace", "first_at", "last_at", F.window_time("slot").alias("slot_ts")
    )
    records = content.filter(_seen(trace_id().isNotNull())).select(trace_id().alias("content_trace"), F.col("event_ts").alias("content_ts"))
    bound = F.expr(f"INTERVAL {seconds} SECONDS")
    slot = F.expr(f"INTERVAL {2 * seconds} SECONDS")
    c = F.col
    same_request = (
        (c("content_trace") == c("gateway_trace"))
        & (c("last_at") >= c("content_ts") - bound) & (c("first_at") <= c("content_ts") + bound)
        # The same on the columns with a watermark, so that state can be dropped.
        & (c("slot_ts") >= c("content_ts") - bound) & (c("slot_ts") <= c("content_ts") + slot)
    )
    joined = records.join(attempts, same_request, "full_outer")
    return joined.filter(c("content_trace").isNull() | c("gateway_trace").isNull()).select(
        F.when(c("gateway_trace").isNull(), F.lit(K.CONTENT)).otherwise(F.lit(K.GATEWAY)).alias("plane"),
        F.coalesce("content_trace", "gateway_trace").alias("trace_id"),
    )


def sequence(content: DataFrame, gateway: DataFrame, span: int = K.SEQUENCE_SPAN,
             words: Iterable[str] = K.INJECTION_WORDS) -> DataFrame:
    """Gateway failures with an injection-shaped prompt of the same user in the ``span`` seconds
    before.

    Prompts are grouped to user and minute (first and last time) before the join, so a failure
    meets at most one row per minute of the span instead of every prompt; as a minute cannot hold
    both ends of the span the test is still exact. User and slice of time are the join key, which
    spreads a busy user over many tasks. A failure can come out once per minute row that
    matches; readers take distinct rows.
    """
    step = 60
    if span % step:
        raise ValueError("span must be whole minutes")
    attempts = content.filter(
        _seen(user_id().isNotNull() & mentions_in_order(F.col("llm.user_prompt"), words))
    ).groupBy(
        F.window("event_ts", f"{step} seconds").alias("minute"), user_id().alias("attempt_user")
    ).agg(F.min("event_ts").alias("first_at"), F.max("event_ts").alias("last_at"))
    first_slice = F.expr(f"unix_seconds(minute.start) div {span}")
    attempts = attempts.select(
        "attempt_user", "first_at", "last_at", F.window_time("minute").alias("minute_ts"),
        F.explode(F.array(first_slice, first_slice + 1)).alias("attempt_slice"),
    )
    failures = gateway.filter(_seen(user_id().isNotNull() & (F.col("event.outcome") == K.FAILURE))).select(
        user_id().alias("user_id"), F.col("document_id").alias("request_id"), trace_id().alias("trace_id"),
        F.col("event_ts").alias("failed_at"), F.expr(f"unix_seconds(event_ts) div {span}").alias("slice"),
    )
    c, whole, minute = F.col, F.expr(f"INTERVAL {span} SECONDS"), F.expr(f"INTERVAL {step} SECONDS")
    before = (
        (c("attempt_user") == c("user_id")) & (c("attempt_slice") == c("slice"))
        & (c("first_at") < c("failed_at")) & (c("last_at") >= c("failed_at") - whole)
        & (c("minute_ts") >= c("failed_at") - whole) & (c("minute_ts") <= c("failed_at") + minute)
    )
    return failures.join(attempts, before, "inner").select("user_id", "request_id", "trace_id", "failed_at")
