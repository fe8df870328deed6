"""How well the rules do against the ground-truth labels. Labels are read here and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planewatch.operators.detections import trace_id, content_only


def detection_scorecard(docs: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """Per rule and label: requests hit and missed. ``hits`` maps a rule name to a DataFrame
    with ``trace_id``.

    Labels and the finds of all rules go through one grouping by trace id: a rule that finds the
    same id in many rows counts it once, and there is one shuffle however many rules there are.
    """
    names = list(hits)
    label = F.coalesce(F.col("labels.scenario_outcome"), F.lit("unlabelled"))
    rows = content_only(docs).filter(trace_id().isNotNull()).select(
        trace_id().alias("trace_id"), label.alias("label"), *[F.lit(False).alias(n) for n in names]
    )
    for name in names:
        rows = rows.unionByName(hits[name].filter("trace_id IS NOT NULL").select(
            "trace_id", F.lit(None).cast("string").alias("label"), *[F.lit(n == name).alias(n) for n in names]
        ))
    per_trace = rows.groupBy("trace_id").agg(
        F.max("label").alias("label"), *[F.bool_or(n).alias(n) for n in names]
    ).filter("label IS NOT NULL")
    per_label = per_trace.groupBy("label").agg(
        *[F.struct(F.count_if(F.col(n)).alias("hits"), F.count_if(~F.col(n)).alias("misses")).alias(n) for n in names]
    )
    listed = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n)["hits"].alias("hits"), F.col(n)["misses"].alias("misses"))
        for n in names
    ])
    return per_label.select("label", F.inline(listed))
