"""Gateway spend records (one per HTTP attempt) to flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.functions.content import decode_lines
from planewatch.functions.text import blank_to_null, first_given, non_empty, text_of, utc_time


def join_key(caller_trace_id: Column) -> Column:
    """The caller's trace id, only if it is a JSON string and not empty. The map it sits in is
    caller-controlled, so a number is not an id."""
    return blank_to_null(text_of(caller_trace_id))


def gateway_status(status: Column) -> Column:
    """Known statuses only; anything else is unknown, which is not a failure."""
    return F.when(status.isin(K.SUCCESS, K.FAILURE), status)


def http_status(code: Column) -> Column:
    return F.when(code.rlike(K.HTTP_STATUS), code).try_cast("int")


def reported(value: Column, evidence: Column) -> Column:
    """The number columns hold 0 when nothing was measured. The source says it has data by a
    non-null object elsewhere in the record, and only then is the number taken."""
    return F.when(evidence.isNotNull(), F.coalesce(value, F.lit(0)))


def is_gateway_health_check(*billed: Column) -> Column:
    """True if any billed-account field is the health account. Tags are ignored on purpose:
    callers set them, and could otherwise take themselves out of the audit."""
    hit = F.lit(False)
    for col in billed:
        hit = hit | F.coalesce(col == K.HEALTH_MARKER, F.lit(False))
    return hit


def clean_tags(tags: Column) -> Column:
    kept = F.filter(tags, lambda t: ~F.coalesce(t, F.lit("")).startswith(K.PSEUDO_TAG_PREFIX))
    return non_empty(F.transform(kept, lambda t: F.coalesce(t, F.lit(""))))


def decode_gateway(lines: DataFrame) -> DataFrame:
    return decode_lines(lines, S.GATEWAY_WIRE, "request_id")


def gateway_events(decoded: DataFrame) -> DataFrame:
    """Decoded good lines to one flat event per attempt. A plain projection: no shuffle."""
    w = F.col("w")
    meta, err = w["metadata"], w["metadata"]["error_information"]
    request_id = blank_to_null(text_of(w["request_id"]))
    status = gateway_status(w["status"])
    failed = F.coalesce(w["status"] == K.FAILURE, F.lit(False))
    start = utc_time(w["startTime"], naive_is_utc=True)
    model = blank_to_null(w["model"])
    ms = w["request_duration_ms"]
    return decoded.select(
        "ingest_seq",
        request_id.alias("document_id"),
        join_key(meta["spend_logs_metadata"]["trace_id"]).alias("trace_id"),
        F.when(w["status"] == K.SUCCESS, blank_to_null(w["session_id"])).alias("session_id"),
        first_given(w["end_user"], w["user"], meta["user_api_key_user_id"]).alias("user_id"),
        clean_tags(w["request_tags"]).alias("tags"),
        is_gateway_health_check(
            w["api_key"], w["team_id"], meta["user_api_key"],
            meta["user_api_key_alias"], meta["user_api_key_team_id"],
        ).alias("is_health_check"),
        start.alias("request_ts"),
        start.alias("start_ts"),
        utc_time(w["endTime"], naive_is_utc=True).alias("end_ts"),
        F.when(ms > 0, F.try_multiply(ms, F.lit(1000000).cast("bigint"))).alias("duration_ns"),
        status.alias("status"),
        blank_to_null(err["error_message"]).alias("status_message"),
        blank_to_null(err["error_class"]).alias("error_class"),
        blank_to_null(err["error_code"]).alias("error_code"),
        http_status(err["error_code"]).alias("http_status"),
        # On a refusal nothing served the request: `model` then names what was asked for.
        F.coalesce(blank_to_null(w["model_group"]), model).alias("request_model"),
        F.when(~failed, model).alias("response_model"),
        F.when(~failed & request_id.startswith(K.COMPLETION_PREFIX), request_id).alias("response_id"),
        F.lit(None).cast("bigint").alias("max_tokens"),
        reported(w["prompt_tokens"], meta["usage_object"]).cast("bigint").alias("input_tokens"),
        reported(w["completion_tokens"], meta["usage_object"]).cast("bigint").alias("output_tokens"),
        reported(w["spend"], meta["cost_breakdown"]).cast("double").alias("cost"),
        blank_to_null(meta["litellm_call_id"]).alias("call_id"),
        blank_to_null(meta["user_api_key_alias"]).alias("key_alias"),
        first_given(w["api_key"], meta["user_api_key"]).alias("key_hash"),
        first_given(w["team_id"], meta["user_api_key_team_id"]).alias("team_id"),
        blank_to_null(w["custom_llm_provider"]).alias("provider"),
        blank_to_null(w["call_type"]).alias("call_type"),
        first_given(w["requester_ip_address"], meta["requester_ip_address"]).alias("requester_ip"),
        meta["attempted_retries"].alias("attempted_retries"),
    )
