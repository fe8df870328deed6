"""Content records (one per logical request) to flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.functions.text import (
    blank_to_null,
    decode_part,
    is_text_or_absent,
    text_of,
    utc_time,
)


def _all_text(items: Column) -> Column:
    return F.forall(items, lambda m: is_text_or_absent(m["role"]) & is_text_or_absent(m["content"]))


def _as_text(items: Column) -> Column:
    texts = F.transform(items, lambda m: F.struct(*[
        F.coalesce(text_of(m[part]), F.lit("")).alias(part) for part in ("role", "content")
    ]))
    return F.when(F.size(items) > 0, texts)


def messages(wrapped: Column, bare: Column) -> Column:
    """``{"messages": [...]}`` first, a bare list second, otherwise none; order is kept. A list
    with a part that is not text counts as none, and so does an empty one.

    An explicit list inside the wrapper wins even when it is empty.
    """
    inner, outer = wrapped["v"]["messages"], bare["v"]
    return F.when(
        inner.isNotNull() & wrapped[S.CORRUPT].isNull() & _all_text(inner), _as_text(inner)
    ).when(outer.isNotNull() & bare[S.CORRUPT].isNull() & _all_text(outer), _as_text(outer))


def output_part(decoded: Column, name: str) -> Column:
    """One member of the output object; nothing at all when either member is not text."""
    usable = (
        decoded[S.CORRUPT].isNull()
        & is_text_or_absent(decoded["v"]["content"])
        & is_text_or_absent(decoded["v"]["role"])
    )
    return F.coalesce(F.when(usable, text_of(decoded["v"][name])), F.lit(""))


def observations(decoded: Column) -> Column:
    """The detailed observations, or NULL when the record lists bare ids only (or anything odd)."""
    return F.when(decoded[S.CORRUPT].isNull(), decoded["v"])


def completion_id(observation_id: Column) -> Column:
    """What follows the first underscore of an observation id."""
    at = F.locate("_", observation_id)
    return F.when(at > 0, blank_to_null(F.substr(observation_id, at + 1)))


def ordered_generations(obs: Column) -> Column:
    """Generations by start time. Records list them in any order; those whose time cannot be
    read come first, in listed order, so that they never win a last-one-wins field."""
    timed = F.transform(
        obs, lambda o, i: F.struct(utc_time(o["startTime"]).alias("at"), i.alias("i"), o.alias("o"))
    )
    generations = F.filter(timed, lambda t: t["o"]["type"] == K.GENERATION)
    # Sorting structs compares member by member, NULL first: (time, position) is all that is needed.
    return F.array_sort(generations)


def request_bounds(obs: Column) -> tuple[Column, Column]:
    """Earliest start and latest end over all observations, refused ones included."""
    return (
        F.array_min(F.transform(obs, lambda o: utc_time(o["startTime"]))),
        F.array_max(F.transform(obs, lambda o: utc_time(o["endTime"]))),
    )


_EMPTY = {
    "answered": "bigint", "refused": "bigint", "with_usage": "bigint",
    "input_tokens": "bigint", "output_tokens": "bigint", "max_tokens": "bigint",
    "request_model": "string", "response_model": "string", "response_id": "string",
    "message": "string",
}


def reduce_generations(generations: Column) -> Column:
    """One ordered fold over the sorted generations.

    Tokens add up over the answered ones; models, limit and completion id are taken from the last
    one that gives them; the first non-empty message of a refused one is kept. A refused
    generation names the requested model only, and its plain ``model`` counts for that only while
    nothing has answered yet, which is why this must be a fold and not a set of independent picks.
    """
    # The token sums become NULL when they overflow; a plain 0 would declare that they never do.
    start = {"answered": F.lit(0), "refused": F.lit(0), "with_usage": F.lit(0)}
    start |= {name: F.lit("0").try_cast("bigint") for name in ("input_tokens", "output_tokens")}
    zero = F.struct(*[start.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in _EMPTY.items()])

    def step(acc: Column, timed: Column) -> Column:
        g = timed["o"]
        refused = F.coalesce(g["level"] == K.ERROR_LEVEL, F.lit(False))
        one = F.when(refused, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
        measured = ~refused & g["usage"].isNotNull()
        model, group = blank_to_null(g["model"]), blank_to_null(g["metadata"]["model_group"])

        def add(total: str, leaf: str) -> Column:
            more = F.when(measured, F.coalesce(g["usage"][leaf], F.lit(0).cast("bigint")))
            return F.try_add(acc[total], F.coalesce(more, F.lit(0).cast("bigint")))

        return F.struct(
            (acc["answered"] + one).alias("answered"),
            (acc["refused"] + 1 - one).alias("refused"),
            (acc["with_usage"] + measured.cast("bigint")).alias("with_usage"),
            add("input_tokens", "input").alias("input_tokens"),
            add("output_tokens", "output").alias("output_tokens"),
            F.coalesce(g["modelParameters"]["max_tokens"], acc["max_tokens"]).alias("max_tokens"),
            F.coalesce(
                group, F.when(refused & acc["response_model"].isNull(), model), acc["request_model"]
            ).alias("request_model"),
            F.coalesce(F.when(~refused, model), acc["response_model"]).alias("response_model"),
            F.coalesce(F.when(~refused, completion_id(g["id"])), acc["response_id"]).alias("response_id"),
            F.coalesce(
                acc["message"], F.when(refused, blank_to_null(g["statusMessage"]))
            ).alias("message"),
        )

    return F.aggregate(generations, zero, step)


def scenario_label(name: Column, prefix: str = K.SCENARIO_PREFIX) -> Column:
    """Ground-truth label out of the trace name; only the closed set counts."""
    label = F.substr(name, F.lit(len(prefix) + 1))
    return F.when(name.startswith(prefix) & label.isin(K.SCENARIOS), label)


def project_id(given: Column, path: Column) -> Column:
    return F.coalesce(blank_to_null(given), blank_to_null(F.regexp_extract(path, K.PROJECT_PATH, 1)))


def duration_ns(seconds: Column) -> Column:
    """NULL where the number cannot be held: no wire value may stop the job."""
    return (seconds * 1e9).try_cast("bigint")


def is_content_health_check(tags: Column) -> Column:
    return F.coalesce(F.array_contains(tags, K.HEALTH_MARKER), F.lit(False))


def decode_lines(lines: DataFrame, schema: str, id_field: str) -> DataFrame:
    """``(raw, ingest_seq)`` to the wire record in ``w``, and in ``reason`` why a line is unusable."""
    decoded = lines.withColumn("d", decode_part(F.col("raw"), schema))
    w, bad = F.col("d")["v"], F.col("d")[S.CORRUPT]
    reason = F.when(
        bad.isNotNull() | ~is_text_or_absent(w[id_field]), F.lit("undecodable record")
    ).when(blank_to_null(text_of(w[id_field])).isNull(), F.lit("record has no id"))
    return decoded.select("raw", "ingest_seq", w.alias("w"), reason.alias("reason"))


def decode_content(lines: DataFrame) -> DataFrame:
    return decode_lines(lines, S.CONTENT_WIRE, "id")


def content_parts(decoded: DataFrame) -> DataFrame:
    """The polymorphic parts of good lines, each decoded once: messages in both forms, the output,
    the detailed observations. Each decoded part gets a column before anything looks into it, or
    every look would decode it again."""
    w = F.col("w")
    parts = decoded.select(
        "ingest_seq", "w",
        F.when(w["input"].startswith("{"), decode_part(w["input"], S.WRAPPED_MESSAGES)).alias("wrapped"),
        F.when(w["input"].startswith("["), decode_part(w["input"], S.BARE_MESSAGES)).alias("bare"),
        F.when(w["output"].isNotNull(), decode_part(w["output"], S.OUTPUT_WIRE)).alias("out"),
        decode_part(w["observations"], S.OBSERVATION_WIRE).alias("listed"),
    )
    return parts.withColumn("obs", observations(F.col("listed")))


def content_events(decoded: DataFrame) -> DataFrame:
    """Decoded good lines to one flat event per trace record. A plain projection: no shuffle."""
    w = F.col("w")
    stage = content_parts(decoded).withColumn("r", reduce_generations(ordered_generations(F.col("obs"))))

    obs, r, tags = F.col("obs"), F.col("r"), w["tags"]
    start, end = request_bounds(obs)
    status = (
        F.when(r["answered"] > 0, F.lit(K.SUCCESS)).when(r["refused"] > 0, F.lit(K.FAILURE))
    )
    failed = F.coalesce(status == K.FAILURE, F.lit(False))
    measured = (r["answered"] > 0) & (r["with_usage"] == r["answered"])
    zero = F.lit(0).cast("bigint")
    trace_id = blank_to_null(text_of(w["id"]))
    return stage.select(
        "ingest_seq",
        trace_id.alias("document_id"),
        trace_id.alias("trace_id"),
        project_id(w["projectId"], w["htmlPath"]).alias("project_id"),
        blank_to_null(w["environment"]).alias("environment"),
        blank_to_null(w["sessionId"]).alias("session_id"),
        blank_to_null(w["userId"]).alias("user_id"),
        blank_to_null(w["name"]).alias("trace_name"),
        scenario_label(w["name"]).alias("scenario"),
        F.when(F.size(tags) > 0, F.transform(tags, lambda t: F.coalesce(t, F.lit("")))).alias("tags"),
        is_content_health_check(tags).alias("is_health_check"),
        utc_time(w["timestamp"]).alias("request_ts"),
        utc_time(w["createdAt"]).alias("ingest_ts"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        duration_ns(w["latency"]).alias("duration_ns"),
        status.alias("status"),
        r["message"].alias("status_message"),
        blank_to_null(w["htmlPath"]).alias("source_ref"),
        messages(F.col("wrapped"), F.col("bare")).alias("messages"),
        output_part(F.col("out"), "content").alias("output"),
        output_part(F.col("out"), "role").alias("output_role"),
        r["request_model"].alias("request_model"),
        r["response_model"].alias("response_model"),
        r["response_id"].alias("response_id"),
        r["max_tokens"].alias("max_tokens"),
        F.when(measured, r["input_tokens"]).alias("input_tokens"),
        F.when(measured, r["output_tokens"]).alias("output_tokens"),
        F.when(~failed, w["totalCost"]).alias("cost"),
        F.coalesce(r["answered"], zero).alias("generation_count"),
        F.coalesce(r["refused"], zero).alias("errored_generation_count"),
        obs.isNotNull().alias("has_detail"),
    )
