"""Events that follow each other, in any number of steps, by one user and within a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SLICES = 3


def in_order(steps: list[DataFrame], span: int) -> DataFrame:
    """(user_id, at, chain): every event of the last step that ends a chain of one event per step.

    ``steps`` are tables (user_id, at, id), ``at`` in microseconds, ``id`` of one type for all. A chain's events
    are strictly one after the other, and at most ``span`` seconds lie between its first and its last. Of all
    chains that end in an event the one that starts latest is given (ties: the greatest ids), as an array of (at, id).

    The automaton is a running maximum: an event of step k carries on the best chain of step k - 1 so far, and
    where even that began too long ago there is none. Per user and slice of time the events of two steps go
    through one ordered window; a slice needs to know one row of each slice before it that the span reaches, the
    best chain in it. So a busy user is spread over many tasks, and no events are paired that do not belong
    together. Rows without a user or a time take no part.
    """
    known = [s.where("user_id IS NOT NULL AND at IS NOT NULL").select("user_id", "at", "id") for s in steps]
    found = known[0].select("user_id", "at", F.array(F.struct("at", "id")).alias("chain"))
    for step in known[1:]:
        found = _followed(found, step, span)
    return found


def _followed(earlier: DataFrame, later: DataFrame, span: int) -> DataFrame:
    width = max(1, -(-span // SLICES)) * 1_000_000
    piece = F.floor(F.col("at") / width).alias("piece")
    chain, identity = earlier.schema["chain"].dataType, later.schema["id"].dataType
    earlier = earlier.select("user_id", "at", piece, F.lit(1).alias("kind"), "chain", F.lit(None).cast(identity).alias("id"))
    later = later.select("user_id", "at", piece, F.lit(0).alias("kind"), F.lit(None).cast(chain).alias("chain"), "id")
    best = earlier.groupBy("user_id", "piece").agg(F.max("chain").alias("chain"))
    carried = best.select(
        "user_id", F.element_at("chain", -1)["at"].alias("at"), F.explode(F.sequence(F.col("piece") + 1, F.col("piece") + SLICES)).alias("piece"),
        F.lit(1).alias("kind"), "chain", F.lit(None).cast(identity).alias("id"),
    )
    # At the same instant the later step sorts first: the event before it must be strictly earlier.
    so_far = Window.partitionBy("user_id", "piece").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timeline = earlier.unionByName(later).unionByName(carried).withColumn("best", F.max("chain").over(so_far))
    ended = timeline.where((F.col("kind") == 0) & (F.col("best")[0]["at"] >= F.col("at") - span * 1_000_000))
    return ended.select("user_id", "at", F.array_append("best", F.struct("at", "id")).alias("chain"))
