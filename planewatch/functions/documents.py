"""Flat events to nested documents with a fixed schema per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from planewatch import constants as K
from planewatch.functions.text import lookup, non_empty, struct_or_null


def last_message_by_role(messages: Column, role: str) -> Column:
    """Content of the last message of a role, '' if there is none."""
    mine = F.filter(messages, lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(mine, F.lit(-1))["content"], F.lit(""))


def encode_messages(messages: Column) -> Column:
    """The conversation as compact JSON text, '' if there is none. Angle brackets, ampersands
    and the two Unicode line separators are written as escapes, as the stored documents have them."""
    text = F.to_json(messages)
    for char, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"),
                         ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.coalesce(text, F.lit(""))


def event_reference(base_url: str, ref: Column) -> Column:
    if not base_url:
        return ref
    joined = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(ref, r"\A/+", ""))
    absolute = ref.startswith("http://") | ref.startswith("https://")
    return F.when(absolute, ref).otherwise(joined)


def _route_prefix(model: Column) -> Column:
    return F.when(F.contains(model, F.lit("/")), F.lower(F.split_part(model, F.lit("/"), F.lit(1))))


def genai_system(provider: Column | None, served: Column, requested: Column) -> Column:
    """Provider in the fixed vocabulary, from the best evidence there is, never NULL."""
    found = [lookup(K.PROVIDER_SYSTEMS, _route_prefix(m)) for m in (served, requested)]
    if provider is not None:
        found.insert(0, lookup(K.PROVIDER_SYSTEMS, F.lower(F.trim(provider))))
    return F.coalesce(*found, F.lit(K.UNKNOWN_PROVIDER))


def genai_operation(call_type: Column | None) -> Column:
    if call_type is None:
        return F.lit(K.DEFAULT_OPERATION)
    return F.coalesce(
        lookup(K.CALL_OPERATIONS, F.lower(F.trim(call_type))), F.lit(K.DEFAULT_OPERATION)
    )


def is_auth_failure(error_class: Column, status_code: Column) -> Column:
    return F.coalesce(error_class.isin(K.AUTH_ERROR_CLASSES), F.lit(False)) | F.coalesce(
        status_code.isin(K.AUTH_STATUS_CODES), F.lit(False)
    )


def event_types(status: Column, auth: Column) -> Column:
    return (
        F.when(status == K.SUCCESS, F.array(F.lit("allowed")))
        .when((status == K.FAILURE) & auth, F.array(F.lit("denied"), F.lit("start")))
        .when(status == K.FAILURE, F.array(F.lit("denied")))
    )


def event_categories(auth: Column) -> Column:
    return F.when(auth, F.array(F.lit("api"), F.lit("authentication"))).otherwise(F.array(F.lit("api")))


def event_action(status: Column, error_class: Column, auth: Column) -> Column:
    """Closed vocabulary. Budget and rate refusals share a status code, so the class decides."""
    refused = (
        F.when(error_class == K.BUDGET_ERROR_CLASS, F.lit(K.ACTION_BUDGET))
        .when(error_class.isin(K.RATE_ERROR_CLASSES), F.lit(K.ACTION_RATE))
        .when(auth, F.lit(K.ACTION_AUTH))
        .otherwise(F.lit(K.ACTION_FAILED))
    )
    return F.when(status.eqNullSafe(K.FAILURE), refused).otherwise(F.lit(K.ACTION_OK))


def related_users(*ids: Column) -> Column:
    return non_empty(F.array_distinct(F.array_compact(F.array(*ids))))


def _typed_null(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def common_fields(dataset: str, category: Column, type_: Column, action: Column,
                  ingested: Column, reference: Column, scenario: Column, name: Column,
                  error_type: Column, error_code: Column, related: Column,
                  system: Column, operation: Column) -> list[Column]:
    """The columns both datasets share, built in one place so that they cannot drift apart."""
    c = F.col
    return [
        c("request_ts").alias("ts"),
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.lit(K.EVENT_KIND).alias("kind"),
            category.alias("category"),
            type_.alias("type"),
            action.alias("action"),
            F.lit(dataset).alias("dataset"),
            F.lit(K.EVENT_MODULE).alias("module"),
            c("status").alias("outcome"),
            c("start_ts").alias("start"),
            c("end_ts").alias("end"),
            c("duration_ns").alias("duration"),
            ingested.alias("ingested"),
            reference.alias("reference"),
        ).alias("event"),
        struct_or_null(c("trace_id").alias("id")).alias("trace"),
        struct_or_null(c("session_id").alias("id")).alias("session"),
        struct_or_null(c("user_id").alias("id")).alias("user"),
        F.struct(
            system.alias("system"),
            F.struct(operation.alias("name")).alias("operation"),
            struct_or_null(c("request_model").alias("model"), c("max_tokens")).alias("request"),
            struct_or_null(c("response_model").alias("model"), c("response_id").alias("id")).alias("response"),
            struct_or_null(c("input_tokens"), c("output_tokens")).alias("usage"),
        ).alias("gen_ai"),
        struct_or_null(
            c("status_message").alias("message"), error_type.alias("type"), error_code.alias("code")
        ).alias("error"),
        struct_or_null(related.alias("user")).alias("related"),
        F.struct(scenario.alias("scenario_outcome"), name.alias("scenario_name")).alias("labels"),
        c("tags"),
    ]


def _keys(dataset: str) -> list[Column]:
    return [
        F.col("document_id"),
        F.col("ingest_seq"),
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.col("start_ts"), F.col("request_ts")).cast("date").alias("event_date"),
    ]


def content_documents(events: DataFrame, base_url: str = "") -> DataFrame:
    c = F.col
    none, no_list = _typed_null(T.StringType()), _typed_null(T.ArrayType(T.StringType()))
    shared = common_fields(
        K.CONTENT,
        category=F.array(F.lit("api")), type_=no_list, action=none,
        ingested=c("ingest_ts"), reference=event_reference(base_url, c("source_ref")),
        scenario=c("scenario"), name=c("trace_name"),
        error_type=none, error_code=none,
        related=related_users(c("user_id")),
        system=genai_system(None, c("response_model"), c("request_model")),
        operation=genai_operation(None),
    )
    llm = F.struct(
        c("cost").alias("total_cost_usd"),
        last_message_by_role(c("messages"), "system").alias("system_prompt"),
        last_message_by_role(c("messages"), "user").alias("user_prompt"),
        c("output"),
        c("output_role"),
        encode_messages(c("messages")).alias("messages"),
        F.when(c("messages").isNull(), F.lit(0)).otherwise(F.size(c("messages"))).cast("bigint").alias("message_count"),
        F.octet_length(c("output")).cast("bigint").alias("output_length"),
        c("generation_count"),
        c("errored_generation_count"),
    ).alias("llm")
    return events.select(*shared, llm, *_keys(K.CONTENT))


def gateway_documents(events: DataFrame) -> DataFrame:
    """No content columns at all: the gateway never sees prompt or answer, and an empty text
    there would be read as "there was one and it was empty"."""
    c = F.col
    none, no_time = _typed_null(T.StringType()), _typed_null(T.TimestampType())
    auth = is_auth_failure(c("error_class"), c("http_status"))
    shared = common_fields(
        K.GATEWAY,
        category=event_categories(auth),
        type_=event_types(c("status"), auth),
        action=event_action(c("status"), c("error_class"), auth),
        ingested=no_time, reference=none, scenario=none, name=none,
        error_type=c("error_class"), error_code=c("error_code"),
        related=related_users(c("user_id"), c("key_alias")),
        system=genai_system(c("provider"), c("response_model"), c("request_model")),
        operation=genai_operation(c("call_type")),
    )
    llm = F.struct(
        c("cost").alias("total_cost_usd"),
        struct_or_null(c("key_alias").alias("alias"), c("key_hash").alias("hash")).alias("key"),
    ).alias("llm")
    http = F.when(
        c("http_status").isNotNull(), F.struct(F.struct(c("http_status").alias("status_code")).alias("response"))
    ).alias("http")
    return events.select(*shared, llm, http, *_keys(K.GATEWAY))
