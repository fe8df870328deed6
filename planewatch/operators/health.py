"""Is the join of the two planes complete? A broken join looks just like a quiet day."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from planewatch import constants as K
from planewatch.operators.detections import event_start, trace_id, in_window


# Times before this are taken for a broken clock.
EARLIEST = datetime(2000, 1, 1, tzinfo=timezone.utc)
TICK_RUN = 4096


def join_health_lag(fetch_interval: timedelta, index_interval: timedelta) -> timedelta:
    """How far behind now a measurement must end, so that records on their way are not missed."""
    budget = timedelta(seconds=K.VISIBILITY_BUDGET) + fetch_interval + index_interval
    return max(timedelta(seconds=K.MIN_LAG), budget)


def lag_seconds(fetch: Column, index: Column) -> Column:
    """The same rule over columns of intervals in seconds."""
    return F.greatest(F.lit(K.MIN_LAG), F.lit(K.VISIBILITY_BUDGET) + fetch + index).cast("bigint")


def _plane_rows(docs: DataFrame, *extra: Column) -> DataFrame:
    is_gateway = F.col("dataset") == K.GATEWAY
    return docs.select(
        *extra, trace_id().alias("trace_id"),
        F.when(is_gateway, 0).otherwise(1).cast("bigint").alias("content"),
        F.when(is_gateway, 1).otherwise(0).cast("bigint").alias("gateway"),
        F.lit(False).alias("expected"),
    )


def _per_id(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per plane for every trace id. Both planes and the baseline go through one grouping,
    combined before the shuffle; there is no join, and nothing is broadcast or collected."""
    return rows.groupBy(*keys, "trace_id").agg(
        F.sum("content").alias("content"), F.sum("gateway").alias("gateway"), F.bool_or("expected").alias("expected")
    )


def _counts() -> list[Column]:
    """A matched id is matched whatever the baseline says; only then is it asked."""
    c = F.col
    has_id = c("trace_id").isNotNull()
    in_content, in_gateway = has_id & (c("content") > 0), has_id & (c("gateway") > 0)

    def ids(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return [
        ids(in_content, "content_total"),
        ids(in_content & in_gateway, "content_matched"),
        ids(in_content & ~in_gateway & c("expected"), "content_expected_unmatched"),
        ids(in_content & ~in_gateway & ~c("expected"), "content_unexplained"),
        ids(in_gateway, "gateway_total"),
        ids(in_content & in_gateway, "gateway_matched"),
        ids(in_gateway & ~in_content & c("expected"), "gateway_expected_unmatched"),
        ids(in_gateway & ~in_content & ~c("expected"), "gateway_unexplained"),
        F.coalesce(F.sum("gateway"), F.lit(0)).cast("bigint").alias("gateway_rows"),
        F.coalesce(F.sum(F.when(~has_id, c("gateway"))), F.lit(0)).cast("bigint").alias("gateway_rows_without_key"),
    ]


def _baseline_rows(baseline: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return baseline.select("trace_id", none.alias("content"), none.alias("gateway"), F.lit(True).alias("expected"))


def join_health(docs: DataFrame, baseline: DataFrame, now: datetime, window_seconds: int = K.HEALTH_WINDOW,
                lag_seconds: int = K.MIN_LAG) -> DataFrame:
    """One measurement over ``[now - lag - window, now - lag)``: a single row."""
    end = now - timedelta(seconds=lag_seconds)
    start = end - timedelta(seconds=window_seconds)
    rows = _plane_rows(in_window(docs, start, end)).unionByName(_baseline_rows(baseline))
    return _per_id(rows).agg(*_counts()).select(
        F.lit(start).alias("window_start"), F.lit(end).alias("window_end"), "*"
    )


def with_rates(health: DataFrame) -> DataFrame:
    """Rates with the expected ones out of both sides of the fraction, 0 when nothing is left."""
    def rate(plane: str) -> Column:
        rest = F.col(f"{plane}_total") - F.col(f"{plane}_expected_unmatched")
        return F.when(rest > 0, F.col(f"{plane}_unexplained") / rest).otherwise(F.lit(0.0))

    return health.select(
        "*",
        rate("content").alias("content_unexplained_rate"),
        rate("gateway").alias("gateway_unexplained_rate"),
        ((F.col("content_unexplained") == 0) & (F.col("gateway_unexplained") == 0)).alias("healthy"),
    )


def join_health_series(docs: DataFrame, baseline: DataFrame, period_seconds: int = K.HEALTH_PERIOD,
                       window_seconds: int = K.HEALTH_WINDOW, lag_seconds: int = K.MIN_LAG,
                       since: datetime = EARLIEST, until: datetime | None = None) -> DataFrame:
    """The same measurement at every tick of the period, from the first tick whose window holds a
    record to the last one, quiet ticks included. ``window_seconds`` must be a multiple of
    ``period_seconds``.

    Rows are cut to one per (period slot, trace id, plane) before they are copied to the ticks
    whose window covers the slot, so the copies grow with ids and not with rows.

    Records dated before ``since`` or after ``until`` (a day from now if not given) have a broken
    clock and are left out: a single one would stretch the series by millions of quiet ticks. The
    ticks are made in runs of ``TICK_RUN``, so no row holds more of them.
    """
    if window_seconds % period_seconds:
        raise ValueError("window_seconds must be a multiple of period_seconds")
    reach = window_seconds // period_seconds
    # Slot s holds the starts t with floor((t + lag) / period) = s. The window of tick k (at
    # k * period) is made of the slots k - reach .. k - 1.
    micros = 1000000
    slot = F.floor((F.unix_micros(event_start()) + lag_seconds * micros) / F.lit(period_seconds * micros)).cast("bigint")
    last_start = F.lit(until) if until else F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    docs = docs.filter((event_start() >= F.lit(since)) & (event_start() <= last_start))
    slots = _per_id(_plane_rows(docs, slot.alias("slot")), "slot")
    copies = slots.select(
        F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + reach)).alias("tick"),
        "trace_id", "content", "gateway", "expected",
    )
    bounds = docs.agg(F.min(slot).alias("first"), F.max(slot).alias("last"))
    runs = bounds.filter("first IS NOT NULL").select(
        F.explode(F.sequence(F.col("first") + 1, F.col("last") + reach, F.lit(TICK_RUN).cast("bigint"))).alias("run"),
        (F.col("last") + reach).alias("end"),
    )
    every_tick = runs.select(
        F.explode(F.sequence(F.col("run"), F.least(F.col("run") + (TICK_RUN - 1), F.col("end")))).alias("tick"),
        F.lit(None).cast("string").alias("trace_id"), F.lit(0).cast("bigint").alias("content"),
        F.lit(0).cast("bigint").alias("gateway"), F.lit(False).alias("expected"),
    )
    per_tick = _per_id(copies.unionByName(every_tick), "tick")
    known = baseline.select("trace_id", F.lit(True).alias("listed")).distinct()
    # Only unmatched ids need the baseline: the matched ones stay out of this join.
    unmatched = (F.col("trace_id").isNotNull()) & ((F.col("content") == 0) | (F.col("gateway") == 0))
    checked = per_tick.filter(unmatched).drop("expected").join(known, "trace_id", "left").select(
        "tick", "trace_id", "content", "gateway", F.coalesce("listed", F.lit(False)).alias("expected")
    )
    rest = per_tick.filter(~unmatched).select("tick", "trace_id", "content", "gateway", "expected")
    tick_time = F.timestamp_seconds(F.col("tick") * period_seconds)
    return checked.unionByName(rest).groupBy("tick").agg(*_counts()).select(
        tick_time.alias("measured_at"),
        F.timestamp_seconds(F.col("tick") * period_seconds - lag_seconds - window_seconds).alias("window_start"),
        F.timestamp_seconds(F.col("tick") * period_seconds - lag_seconds).alias("window_end"),
        "content_total", "content_matched", "content_expected_unmatched", "content_unexplained",
        "gateway_total", "gateway_matched", "gateway_expected_unmatched", "gateway_unexplained",
        "gateway_rows", "gateway_rows_without_key",
    )
