"""Gateway records: null rules, join key, status, health checks."""

import datetime as dt

import pytest

from planewatch import constants as K
from planewatch.plans import derive
from tests.records import lines, refusal, spend


def event(spark, record):
    rows = derive.events_from_lines(lines(spark, record), K.GATEWAY).collect()
    assert len(rows) == 1
    return rows[0]


def test_success(spark):
    e = event(spark, spend())
    assert (e.document_id, e.trace_id, e.session_id, e.user_id) == ("chatcmpl-a", "t1", "s1", "u1")
    assert (e.key_alias, e.key_hash, e.team_id, e.tags) == ("key-a", "hash-a", "team-m", ["app"])
    assert (e.request_model, e.response_model, e.response_id) == ("small", "groq/small", "chatcmpl-a")
    assert (e.input_tokens, e.output_tokens, e.cost, e.attempted_retries) == (10, 20, 0.25, 0)
    assert (e.status, e.duration_ns, e.error_class, e.http_status) == ("success", 1_000_000_000, None, None)


def test_refusal_reports_nothing_as_zero(spark):
    e = event(spark, refusal())
    assert (e.status, e.input_tokens, e.output_tokens, e.cost, e.attempted_retries) == ("failure", None, None, None, None)
    assert (e.request_model, e.response_model, e.response_id, e.session_id) == ("small", None, None, None)
    assert (e.error_class, e.error_code, e.http_status, e.status_message) == ("BudgetExceededError", "429", 429, "no")


@pytest.mark.parametrize("caller, expected", [
    ({"trace_id": "x"}, "x"), ({"trace_id": ""}, None), ({"trace_id": None}, None), ({"trace_id": 5}, None),
    ({"trace_id": {"a": "b"}}, None), ({}, None), (None, None),
])
def test_join_key(spark, caller, expected):
    assert event(spark, spend({"spend_logs_metadata": caller})).trace_id == expected


def test_presence_of_an_empty_object_counts(spark):
    e = event(spark, spend({"usage_object": {}, "cost_breakdown": {}}, prompt_tokens=0, completion_tokens=0, spend=0))
    assert (e.input_tokens, e.output_tokens, e.cost) == (0, 0, 0.0)
    e = event(spark, spend({"usage_object": None, "cost_breakdown": None}))
    assert (e.input_tokens, e.output_tokens, e.cost) == (None, None, None)


@pytest.mark.parametrize("text, expected", [
    ("2024-05-01T10:00:00.138+00:00", dt.datetime(2024, 5, 1, 10, 0, 0, 138000)),
    ("2024-05-01T10:00:00.138000Z", dt.datetime(2024, 5, 1, 10, 0, 0, 138000)),
    ("2024-05-01T10:00:00.123456789Z", dt.datetime(2024, 5, 1, 10, 0, 0, 123456)),
    ("2024-05-01T12:00:00+02:00", dt.datetime(2024, 5, 1, 10)),
    ("2024-05-01T10:00:00", dt.datetime(2024, 5, 1, 10)),
    ("2024-05-01", None), ("2024-05-01 10:00:00", None), ("2024-13-01T10:00:00Z", None), ("", None), (None, None),
])
def test_times(spark, text, expected):
    e = event(spark, spend(startTime=text))
    assert e.start_ts == expected and e.request_ts == expected


@pytest.mark.parametrize("code, status", [
    ("429", 429), ("100", 100), ("599", 599), ("600", None), ("099", None), ("42", None), ("4290", None),
    ("4x9", None), ("", None), ("429\n", None),
])
def test_http_status(spark, code, status):
    assert event(spark, refusal(code=code)).http_status == status


def test_unknown_status_is_not_a_failure(spark):
    e = event(spark, spend(status="weird"))
    assert (e.status, e.session_id, e.response_model, e.response_id) == (None, None, "groq/small", "chatcmpl-a")


def test_response_id_needs_the_completion_prefix(spark):
    assert event(spark, spend(request_id="abc")).response_id is None


def test_fallbacks(spark):
    e = event(spark, spend(api_key="", user="", model_group="", requester_ip_address="", meta={"requester_ip_address": "1.2.3.4"}))
    assert (e.key_hash, e.user_id, e.request_model, e.requester_ip) == ("hash-m", "owner", "groq/small", "1.2.3.4")
    assert event(spark, spend(end_user="end")).user_id == "end"
    assert event(spark, spend(request_duration_ms=0)).duration_ns is None
    assert event(spark, spend(request_tags=["User-Agent: x"])).tags is None


@pytest.mark.parametrize("record, health", [
    (spend(api_key=K.HEALTH_MARKER), True),
    (spend(team_id=K.HEALTH_MARKER), True),
    (spend({"user_api_key": K.HEALTH_MARKER}), True),
    (spend({"user_api_key_alias": K.HEALTH_MARKER}), True),
    (spend({"user_api_key_team_id": K.HEALTH_MARKER}), True),
    (spend(request_tags=[K.HEALTH_MARKER]), False),
    (spend(user=K.HEALTH_MARKER), False),
])
def test_health_check_is_who_was_billed(spark, record, health):
    assert event(spark, record).is_health_check is health


def test_wrong_types_are_quarantined(spark):
    from planewatch.sources import archive as A

    decoded = derive.decode(
        lines(spark, spend(), spend(prompt_tokens="many"), spend(prompt_tokens=1.5), spend(request_tags="x"), spend(request_id=7)),
        K.GATEWAY,
    )
    assert sorted(r.ingest_seq.row for r in A.bad_lines(decoded, K.GATEWAY).collect()) == [1, 2, 3, 4]
