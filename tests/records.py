"""Small wire records for tests, built from a complete one by overriding fields."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def lines(spark: SparkSession, *records: dict | str) -> DataFrame:
    rows = [(r if isinstance(r, str) else json.dumps(r), n) for n, r in enumerate(records)]
    df = spark.createDataFrame(rows, "raw string, n bigint")
    return df.select("raw", F.struct(
        F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("block"), F.col("n").alias("row"),
    ).alias("ingest_seq"))


def observation(**fields) -> dict:
    base = {
        "id": "time-1_chatcmpl-a", "type": "GENERATION", "model": "groq/small", "level": "DEFAULT",
        "startTime": "2024-05-01T10:00:00.000Z", "endTime": "2024-05-01T10:00:01.000Z",
        "usage": {"input": 10, "output": 20, "total": 30, "unit": "TOKENS"},
        "metadata": {"model_group": "small"}, "modelParameters": {"max_tokens": 100},
    }
    return {**base, **fields}


def refused(**fields) -> dict:
    base = {
        "id": "time-1_", "model": "small", "level": "ERROR", "statusMessage": "over budget",
        "usage": {"input": 0, "output": 0}, "metadata": {}, "modelParameters": {},
    }
    return observation(**{**base, **fields})


def trace(**fields) -> dict:
    base = {
        "id": "t1", "projectId": "p1", "timestamp": "2024-05-01T10:00:01.5Z", "name": "scenario-benign",
        "sessionId": "s1", "userId": "u1", "tags": ["app"], "environment": "lab",
        "htmlPath": "/project/p1/traces/t1", "latency": 1.5, "totalCost": 0.25,
        "createdAt": "2024-05-01T10:00:03+02:00",
        "input": {"messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hello"}]},
        "output": {"content": "hi there", "role": "assistant"},
        "observations": [observation()],
    }
    return {**base, **fields}


def spend(meta: dict | None = None, **fields) -> dict:
    metadata = {
        "spend_logs_metadata": {"trace_id": "t1"}, "user_api_key_alias": "key-a", "user_api_key": "hash-m",
        "user_api_key_user_id": "owner", "user_api_key_team_id": "team-m", "litellm_call_id": "c1",
        "error_information": None, "usage_object": {"total_tokens": 30}, "cost_breakdown": {"total": 0.25},
        "attempted_retries": 0,
    }
    base = {
        "request_id": "chatcmpl-a", "call_type": "acompletion", "api_key": "hash-a", "spend": 0.25,
        "prompt_tokens": 10, "completion_tokens": 20, "startTime": "2024-05-01T10:00:00.000+00:00",
        "endTime": "2024-05-01T10:00:01.000+00:00", "request_duration_ms": 1000, "model": "groq/small",
        "model_group": "small", "custom_llm_provider": "groq", "user": "u1", "end_user": "", "team_id": "",
        "session_id": "s1", "requester_ip_address": None, "request_tags": ["User-Agent: x", "app"],
        "status": "success",
    }
    return {**base, **fields, "metadata": {**metadata, **(meta or {})}}


def refusal(error_class: str = "BudgetExceededError", code: str = "429", meta: dict | None = None, **fields) -> dict:
    blocked = {
        "usage_object": None, "cost_breakdown": None, "attempted_retries": None,
        "error_information": {"error_code": code, "error_class": error_class, "error_message": "no"},
    }
    base = {
        "request_id": "req-1", "call_type": "", "spend": 0, "prompt_tokens": 0, "completion_tokens": 0,
        "model": "small", "model_group": "", "custom_llm_provider": "", "status": "failure",
        "session_id": "random",
    }
    return spend({**blocked, **(meta or {})}, **{**base, **fields})
