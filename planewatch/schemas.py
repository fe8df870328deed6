"""Every schema is written out: nothing is inferred or merged at run time."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- wire records
# Only the fields that are read. Identifiers and message parts are VARIANT so that a number
# is not mistaken for text; polymorphic parts stay raw JSON (STRING) for a second look. Every
# value is decoded inside a wrapper object `{"v": ...}`, see `functions.text.decode_part`.

CORRUPT = "_bad"

CONTENT_WIRE = f"""
    v STRUCT<
        id: VARIANT, projectId: STRING, timestamp: STRING, name: STRING, input: STRING, output: STRING,
        sessionId: STRING, userId: STRING, tags: ARRAY<STRING>, environment: STRING, htmlPath: STRING,
        latency: DOUBLE, totalCost: DOUBLE, createdAt: STRING, observations: STRING>,
    {CORRUPT} STRING
"""

MESSAGE_LIST = "ARRAY<STRUCT<role: VARIANT, content: VARIANT>>"
WRAPPED_MESSAGES = f"v STRUCT<messages: {MESSAGE_LIST}>, {CORRUPT} STRING"
BARE_MESSAGES = f"v {MESSAGE_LIST}, {CORRUPT} STRING"
OUTPUT_WIRE = f"v STRUCT<content: VARIANT, role: VARIANT>, {CORRUPT} STRING"

OBSERVATION_WIRE = f"""
    v ARRAY<STRUCT<
        id: STRING, type: STRING, model: STRING, level: STRING, statusMessage: STRING,
        startTime: STRING, endTime: STRING,
        usage: STRUCT<input: BIGINT, output: BIGINT>,
        metadata: STRUCT<model_group: STRING>,
        modelParameters: STRUCT<max_tokens: BIGINT>>>,
    {CORRUPT} STRING
"""

GATEWAY_WIRE = f"""
    v STRUCT<
        request_id: VARIANT, call_type: STRING, api_key: STRING, spend: DOUBLE, prompt_tokens: BIGINT,
        completion_tokens: BIGINT, startTime: STRING, endTime: STRING, request_duration_ms: BIGINT,
        model: STRING, model_group: STRING, custom_llm_provider: STRING, user: STRING, end_user: STRING,
        team_id: STRING, session_id: STRING, requester_ip_address: STRING,
        request_tags: ARRAY<STRING>, status: STRING,
        metadata: STRUCT<
            spend_logs_metadata: STRUCT<trace_id: VARIANT>,
            user_api_key_alias: STRING, user_api_key: STRING, user_api_key_user_id: STRING,
            user_api_key_team_id: STRING, litellm_call_id: STRING, requester_ip_address: STRING,
            error_information: STRUCT<error_code: STRING, error_class: STRING, error_message: STRING>,
            usage_object: STRING, cost_breakdown: STRING, attempted_retries: BIGINT>>,
    {CORRUPT} STRING
"""

# ------------------------------------------------------------------- documents

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
_STRINGS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_SHARED = {
    "ts": _TS,
    "schema_version": _S,
    "event": _struct(
        kind=_S, category=_STRINGS, type=_STRINGS, action=_S, dataset=_S, module=_S, outcome=_S,
        start=_TS, end=_TS, duration=_L, ingested=_TS, reference=_S,
    ),
    "trace": _struct(id=_S),
    "session": _struct(id=_S),
    "user": _struct(id=_S),
    "gen_ai": _struct(
        system=_S,
        operation=_struct(name=_S),
        request=_struct(model=_S, max_tokens=_L),
        response=_struct(model=_S, id=_S),
        usage=_struct(input_tokens=_L, output_tokens=_L),
    ),
    "error": _struct(message=_S, type=_S, code=_S),
    "related": _struct(user=_STRINGS),
    "labels": _struct(scenario_outcome=_S, scenario_name=_S),
    "tags": _STRINGS,
}

# Where a line stood in the archive. Compared member by member, so the later line is the greater.
INGEST_SEQ = _struct(at=_TS, file=_S, block=_L, row=_L)

_KEYS = {"document_id": _S, "ingest_seq": INGEST_SEQ, "dataset": _S, "event_date": T.DateType()}

CONTENT_DOCUMENT = _struct(
    **_SHARED,
    llm=_struct(
        total_cost_usd=_D, system_prompt=_S, user_prompt=_S, output=_S, output_role=_S, messages=_S,
        message_count=_L, output_length=_L, generation_count=_L, errored_generation_count=_L,
    ),
    **_KEYS,
)

GATEWAY_DOCUMENT = _struct(
    **_SHARED,
    llm=_struct(total_cost_usd=_D, key=_struct(alias=_S, hash=_S)),
    http=_struct(response=_struct(status_code=T.IntegerType())),
    **_KEYS,
)

SHARED_FIELDS = list(_SHARED)

QUARANTINE = _struct(dataset=_S, ingest_seq=INGEST_SEQ, reason=_S, excerpt=_S)
BASELINE = _struct(reason=_S, recorded_at=_S, cutoff=_S, trace_ids=_STRINGS)


def leaves(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Dotted leaf path -> type name."""
    out: dict[str, str] = {}
    for field in schema.fields:
        path = prefix + field.name
        if isinstance(field.dataType, T.StructType) and field.name != "ingest_seq":
            out.update(leaves(field.dataType, path + "."))
        else:
            out[path] = field.dataType.simpleString()
    return out
