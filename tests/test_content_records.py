"""Content records: decoding, ordering and reducing observations."""

import datetime as dt

import pytest

from planewatch import constants as K
from planewatch.plans import derive
from tests.records import lines, observation, refused, trace


def event(spark, **fields):
    rows = derive.events_from_lines(lines(spark, trace(**fields)), K.CONTENT).collect()
    assert len(rows) == 1
    return rows[0]


def test_complete_record(spark):
    e = event(spark)
    assert (e.trace_id, e.project_id, e.session_id, e.user_id, e.scenario) == ("t1", "p1", "s1", "u1", "benign")
    assert e.request_ts == dt.datetime(2024, 5, 1, 10, 0, 1, 500000)
    assert e.ingest_ts == dt.datetime(2024, 5, 1, 8, 0, 3)
    assert e.duration_ns == 1_500_000_000
    assert [tuple(m) for m in e.messages] == [("system", "be kind"), ("user", "hello")]
    assert (e.output, e.output_role, e.status) == ("hi there", "assistant", "success")
    assert (e.input_tokens, e.output_tokens, e.cost, e.max_tokens) == (10, 20, 0.25, 100)
    assert (e.request_model, e.response_model, e.response_id) == ("small", "groq/small", "chatcmpl-a")


def test_null_and_empty_scalars_are_absent(spark):
    e = event(spark, sessionId=None, userId="", projectId="", htmlPath="/project/p9/traces/t1", latency=None,
              totalCost=None, createdAt="yesterday", tags=[], name=None)
    assert (e.session_id, e.user_id, e.project_id) == (None, None, "p9")
    assert (e.duration_ns, e.cost, e.ingest_ts, e.tags, e.scenario) == (None, None, None, None, None)


@pytest.mark.parametrize("value, expected", [
    ({"messages": []}, None),
    ([], None),
    (None, None),
    ("hello", None),
    ([{"role": "user", "content": "a"}], [("user", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"content": None}]}, [("user", "a"), ("", "")]),
    # Parts that are not text make the list unusable, not half usable.
    ([{"role": "user", "content": [{"type": "text"}]}], None),
    ({"messages": [{"role": "user", "content": 5}]}, None),
])
def test_messages(spark, value, expected):
    got = event(spark, input=value).messages
    assert (got and [tuple(m) for m in got]) == expected


@pytest.mark.parametrize("value, expected", [
    (None, ("", "")), ({"role": "assistant"}, ("", "assistant")), ("text", ("", "")), ({"content": 3, "role": "a"}, ("", "")),
])
def test_output(spark, value, expected):
    e = event(spark, output=value)
    assert (e.output, e.output_role) == expected


@pytest.mark.parametrize("listed, detail", [
    (["id-1", "id-2"], False), ([observation(), "id-2"], False), (None, False), ([], True), ([observation()], True),
    # One number of the wrong type makes all of the detail unusable.
    ([observation(usage={"input": "1", "output": 2})], False),
])
def test_observation_forms(spark, listed, detail):
    e = event(spark, observations=listed)
    assert e.has_detail is detail
    if not detail:
        assert (e.status, e.generation_count, e.input_tokens, e.cost) == (None, 0, None, 0.25)


def test_tokens_sum_and_last_in_time_wins(spark):
    e = event(spark, observations=[
        observation(id="x_chatcmpl-late", model="openai/big", startTime="2024-05-01T10:00:09Z", metadata={"model_group": "big"}),
        observation(id="x_chatcmpl-early", startTime="2024-05-01T10:00:02Z"),
    ])
    assert (e.input_tokens, e.output_tokens, e.generation_count) == (20, 40, 2)
    assert (e.response_model, e.request_model, e.response_id) == ("openai/big", "big", "chatcmpl-late")


def test_unreadable_times_keep_listed_order_and_never_win(spark):
    e = event(spark, observations=[
        observation(id="x_timed", startTime="2020-01-01T00:00:00Z"),
        observation(id="x_first", startTime=None), observation(id="x_second", startTime="soon"),
    ])
    assert e.response_id == "timed"
    e = event(spark, observations=[observation(id="x_one", startTime=None), observation(id="x_two", startTime="")])
    assert e.response_id == "two"


def test_partial_usage_is_no_usage(spark):
    e = event(spark, observations=[observation(), observation(usage=None)])
    assert (e.input_tokens, e.output_tokens, e.generation_count) == (None, None, 2)


def test_missing_leaf_of_a_reported_usage_is_zero(spark):
    e = event(spark, observations=[observation(usage={"output": 7})])
    assert (e.input_tokens, e.output_tokens) == (0, 7)


def test_other_observation_types_only_widen_the_bounds(spark):
    e = event(spark, observations=[
        {"id": "s", "type": "SPAN", "startTime": "2024-05-01T09:59:00Z", "endTime": "2024-05-01T10:05:00Z"}, observation(),
    ])
    assert e.generation_count == 1
    assert (e.start_ts, e.end_ts) == (dt.datetime(2024, 5, 1, 9, 59), dt.datetime(2024, 5, 1, 10, 5))


def test_refused_only(spark):
    e = event(spark, totalCost=0, observations=[
        refused(statusMessage="second", startTime="2024-05-01T10:00:05Z"),
        refused(statusMessage="first", startTime="2024-05-01T10:00:04Z"),
    ])
    assert (e.status, e.status_message) == ("failure", "first")
    assert (e.input_tokens, e.output_tokens, e.cost) == (None, None, None)
    assert (e.generation_count, e.errored_generation_count) == (0, 2)
    assert (e.request_model, e.response_model, e.response_id) == ("small", None, None)


def test_mixed_keeps_cost_and_counts_refusals_apart(spark):
    e = event(spark, observations=[
        observation(startTime="2024-05-01T10:00:09Z"), refused(startTime="2024-05-01T10:00:01Z"),
    ])
    assert (e.status, e.cost, e.generation_count, e.errored_generation_count) == ("success", 0.25, 1, 1)
    assert (e.input_tokens, e.status_message) == (10, "over budget")


def test_requested_model_rules_of_a_refusal(spark):
    # After an answer, a refusal's plain model is ignored, its model group is not.
    late = "2024-05-01T11:00:00Z"
    e = event(spark, observations=[observation(), refused(model="other", startTime=late)])
    assert e.request_model == "small"
    e = event(spark, observations=[observation(), refused(model="other", metadata={"model_group": "grp"}, startTime=late)])
    assert e.request_model == "grp"
    # Before an answer that names no group, the refusal's model stands.
    e = event(spark, observations=[refused(model="other", startTime="2024-05-01T09:00:00Z"), observation(metadata={})])
    assert e.request_model == "other"


def test_no_generations_is_unknown(spark):
    e = event(spark, observations=[{"id": "s", "type": "SPAN"}])
    assert (e.status, e.cost, e.start_ts, e.input_tokens) == (None, 0.25, None, None)


def test_completion_id(spark):
    from pyspark.sql import functions as F
    from planewatch.functions.content import completion_id

    df = spark.createDataFrame([("time-1_chatcmpl-a_b",), ("time-1_",), ("plain",), (None,)], "id string")
    got = [r.c for r in df.select(completion_id(F.col("id")).alias("c")).collect()]
    assert got == ["chatcmpl-a_b", None, None, None]


@pytest.mark.parametrize("name, label", [
    ("scenario-injection", "injection"), ("scenario-truncated", "truncated"), ("scenario-other", None),
    ("injection", None), ("my scenario-benign", None),
])
def test_scenario_label(spark, name, label):
    assert event(spark, name=name).scenario == label


def test_bad_lines_and_blank_lines(spark):
    from planewatch.sources import archive as A

    good = trace()
    import json
    records = lines(
        spark, good, '{"id":"t2"', "[1]", "null", '{"name":"x"}', '{"id":""}', '{"id":5}', '{"id":"t3","tags":"x"}',
        '{"id":"t4"} tail', '{"id":"t5"}{"id":"t6"}', json.dumps(trace(id="t7", output={"content": "if (x) {y} z", "role": "a"})),
        "   ", "x" * 300,
    )
    decoded = derive.decode(records.filter(~A.is_blank(records.raw)), K.CONTENT)
    assert [r.trace_id for r in derive.events_from_decoded(decoded, K.CONTENT).collect()] == ["t1", "t7"]
    bad = {r.ingest_seq.row: r for r in A.bad_lines(decoded, K.CONTENT).collect()}
    assert {n: r.reason for n, r in bad.items()} == {
        1: "undecodable record", 2: "undecodable record", 3: "record has no id", 4: "record has no id",
        5: "record has no id", 6: "undecodable record", 7: "undecodable record", 8: "undecodable record",
        9: "undecodable record", 12: "undecodable record",
    }
    assert bad[12].excerpt == "x" * 200 + "..."
    assert bad[1].excerpt == '{"id":"t2"'
