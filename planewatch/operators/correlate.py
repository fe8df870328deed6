"""The join of the two planes on the trace id: one content record, one to many attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planewatch import constants as K
from planewatch.operators.detections import (
    cost_usd, input_tokens, output_tokens, event_start, trace_id, user_id, content_only, gateway_only, hour_of,
)


def _sides(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    content = content_only(docs).filter(trace_id().isNotNull()).select(
        trace_id().alias("trace_id"), event_start().alias("content_start"), F.col("event.outcome").alias("content_outcome"),
        user_id().alias("content_user"), F.col("gen_ai.response.id").alias("content_response_id"),
    )
    gateway = gateway_only(docs).select(
        trace_id().alias("trace_id"), F.col("document_id").alias("request_id"), event_start().alias("gateway_start"),
        F.col("event.outcome").alias("gateway_outcome"), F.col("event.action").alias("gateway_action"),
        F.col("gen_ai.response.id").alias("gateway_response_id"),
    )
    return content, gateway


def spread_nulls(key: Column, unique: Column) -> Column:
    """A join key for rows that may have none. Rows without one get a value of their own that no
    real id can equal: they match nothing, as before, but no longer meet in a single task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), unique))


def correlate(docs: DataFrame) -> DataFrame:
    """Full outer match, one row per attempt plus one per unmatched request.

    A full outer join cannot be split when one trace id holds a large share of the attempts. Put
    together from a left join (which adaptive execution splits on the attempts' side) and the
    requests without any attempt (an anti-join on distinct ids) it can.
    """
    content, gateway = _sides(docs)
    key = spread_nulls(F.col("trace_id"), F.col("request_id"))
    matched = gateway.withColumn("_key", key).join(
        content.withColumnRenamed("trace_id", "_key").withColumn("side", F.lit("both")), "_key", "left"
    ).drop("_key")
    ids = gateway.select("trace_id").filter("trace_id IS NOT NULL").distinct()
    lonely = content.join(ids, "trace_id", "left_anti").withColumn("side", F.lit("content_only"))
    return matched.unionByName(lonely, allowMissingColumns=True).withColumn(
        "side", F.coalesce("side", F.lit("gateway_only"))
    )


def correlation_window(docs: DataFrame, seconds: int = K.CORRELATION_WINDOW) -> DataFrame:
    """Matches whose starts lie within the window.

    A band join: rows meet by id and bin of time, as wide as the window. A request stands in its own bin and in the
    two beside it, an attempt in its own only, so each pair meets once and is then held to the exact window. An
    id that very many records share (a constant one, say) pairs what happened at about the same time, and no
    longer all its requests with all its attempts.
    """
    content, gateway = _sides(docs)
    start, width = {"c": F.unix_micros("content_start"), "g": F.unix_micros("gateway_start")}, seconds * 1_000_000
    skew = F.abs(start["g"] - start["c"])
    if width == 0:
        return gateway.filter("trace_id IS NOT NULL").join(content, "trace_id").withColumn("skew_us", skew).filter("skew_us = 0")
    own = F.floor(start["c"] / width)
    requests = content.withColumn("_bin", F.explode(F.sequence(own - 1, own + 1)))
    attempts = gateway.filter("trace_id IS NOT NULL").withColumn("_bin", F.floor(start["g"] / width))
    return attempts.join(requests, ["trace_id", "_bin"]).drop("_bin").withColumn("skew_us", skew).filter(F.col("skew_us") <= width)


def resolve_request(docs: DataFrame) -> DataFrame:
    """One row per request with the value of the plane that is authoritative for each field, and
    both originals where the planes can disagree.

    Attempts are grouped to one row per trace id first (combined before the shuffle), so the full
    outer join meets at most one row per side: a trace id with very many attempts cannot pile up.
    """
    order = F.struct(event_start().alias("at"), F.col("document_id").alias("id"))
    outcome, served, asked = F.col("event.outcome"), F.col("gen_ai.response.model"), F.col("gen_ai.request.model")
    known_system = F.when(F.col("gen_ai.system") != K.UNKNOWN_PROVIDER, F.col("gen_ai.system"))

    def last(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]

    gateway = gateway_only(docs).filter(trace_id().isNotNull()).groupBy(trace_id().alias("trace_id")).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.when(F.bool_or(outcome == K.SUCCESS), F.lit(K.SUCCESS))
        .when(F.bool_or(outcome == K.FAILURE), F.lit(K.FAILURE)).alias("gateway_outcome"),
        F.sum(cost_usd()).alias("gateway_cost"),
        F.try_sum(input_tokens()).alias("gateway_input_tokens"),
        F.try_sum(output_tokens()).alias("gateway_output_tokens"),
        last(served).alias("gateway_model"),
        last(asked).alias("gateway_requested"),
        last(known_system).alias("gateway_system"),
        last(user_id()).alias("gateway_user"),
        F.min(event_start()).alias("gateway_start"),
    )
    content = content_only(docs).filter(trace_id().isNotNull()).select(
        trace_id().alias("trace_id"), F.lit(True).alias("has_content"), outcome.alias("content_outcome"),
        cost_usd().alias("content_cost"), input_tokens().alias("content_input_tokens"),
        output_tokens().alias("content_output_tokens"), served.alias("content_model"),
        asked.alias("content_requested"), known_system.alias("content_system"),
        user_id().alias("content_user"), F.col("session.id").alias("session_id"),
        event_start().alias("content_start"), F.col("llm.user_prompt").alias("user_prompt"),
        F.col("llm.output").alias("output"),
    )
    return gateway.join(content, "trace_id", "full_outer").select(
        "trace_id",
        F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"),
        F.coalesce("has_content", F.lit(False)).alias("has_content"),
        F.coalesce("gateway_start", "content_start").alias("event_start"),
        F.coalesce("gateway_outcome", "content_outcome").alias("outcome"), "gateway_outcome", "content_outcome",
        F.coalesce("gateway_cost", "content_cost").alias("cost_usd"), "gateway_cost", "content_cost",
        F.coalesce("gateway_input_tokens", "content_input_tokens").alias("input_tokens"),
        F.coalesce("gateway_output_tokens", "content_output_tokens").alias("output_tokens"),
        "gateway_input_tokens", "content_input_tokens", "gateway_output_tokens", "content_output_tokens",
        F.coalesce("gateway_requested", "content_requested").alias("requested_model"),
        F.coalesce("gateway_model", "content_model").alias("served_model"), "gateway_model", "content_model",
        F.coalesce("gateway_system", "content_system", F.lit(K.UNKNOWN_PROVIDER)).alias("system"),
        F.coalesce("content_user", "gateway_user").alias("user_id"),
        "session_id", "user_prompt", "output",
    )


def completion_id_crosscheck(docs: DataFrame) -> DataFrame:
    """Every attempt by how it matches: on the trace id, on the completion id, on both, on
    neither. A match on one key only is a signal of its own."""
    content, gateway = _sides(docs)
    by_trace = content.select(F.col("trace_id").alias("_trace"), F.lit(True).alias("trace_hit"))
    by_completion = content.filter("content_response_id IS NOT NULL").select(
        F.col("content_response_id").alias("_completion")
    ).distinct().withColumn("completion_hit", F.lit(True))
    request = F.col("request_id")
    with_both = (
        gateway.withColumn("_trace", spread_nulls(F.col("trace_id"), request))
        .withColumn("_completion", spread_nulls(F.col("gateway_response_id"), request))
        .join(by_trace, "_trace", "left")
        .join(by_completion, "_completion", "left")
    )
    trace_hit, completion_hit = F.col("trace_hit").isNotNull(), F.col("completion_hit").isNotNull()
    return with_both.select(
        "request_id", "trace_id", "gateway_response_id", "gateway_outcome",
        F.when(trace_hit & completion_hit, F.lit("both"))
        .when(trace_hit, F.lit("trace_only"))
        .when(completion_hit, F.lit("completion_only"))
        .otherwise(F.lit("none")).alias("matched_by"),
    )


def crosscheck_coverage(docs: DataFrame) -> DataFrame:
    return completion_id_crosscheck(docs).groupBy("gateway_outcome", "matched_by").agg(
        F.count(F.lit(1)).alias("attempts")
    )


def attempts_per_request(docs: DataFrame) -> DataFrame:
    """Attempts per request and hour; a jump is a retry storm."""
    return (
        gateway_only(docs).filter(trace_id().isNotNull() & event_start().isNotNull())
        .groupBy(hour_of(event_start()).alias("hour"))
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct(trace_id()).alias("requests"))
        .withColumn("attempts_per_request", F.col("attempts") / F.col("requests"))
    )


def forged_health_tag(docs: DataFrame) -> DataFrame:
    """Attempts that carry the health-check tag although a real account was billed. The proxy's
    own checks are gone by the time documents exist, so what still has the tag forged it."""
    return gateway_only(docs).filter(F.array_contains("tags", K.HEALTH_MARKER)).select(
        F.col("document_id").alias("request_id"), trace_id().alias("trace_id"), user_id().alias("user_id"),
        F.col("llm.key.alias").alias("key_alias"),
    )
