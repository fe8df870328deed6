"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. Source number i, by code point with null last, weighs 3, 1, 2, 3, 1, 2, ... All sources share
``share`` per cent of all words; a target stops at ``passes`` times the words of its source, and the
excess goes to the others by weight until none is above. With the sources in order of cap / weight
that is one running sum.

Draws. The documents of a source are dealt by a hash of their id into blocks of about ``block_docs``.
A target is so many whole passes over the source, then the first blocks whose words fit into the
rest, then every document of the next block that still fits, one after the other in the order of their
keys and past those that do not fit. So every source ends below its target by less than the smallest
document of that block that was left out (blocks after it are not asked), no document is used more
than ``passes`` times, and a rerun draws the same.

Shards. The drawn blocks of all sources are the urn. The root of a binary tree holds its exact count
of draws per source; a node splits them over its two halves by one multivariate-hypergeometric draw
seeded by the node, down to the shards. Every shard works out its own path, so the tree is never in
one place. A source's draws, in a permuted order, are given to the shards in consecutive runs of
these quotas: disjoint blocks, each shard with its own exact quota per source. Rows are shuffled
inside their shard.

Per-source figures (one row per source) are the only thing that is worked on in one task and sent to
the tasks; there may be ``most_sources`` of them, which is checked.

Defined cases: a null text has size 0; a null source is a source of its own; a source without words
has target 0 and nothing is taken; rows that repeat a doc_id (or have none) are documents of their
own, whose takes the query adds up by doc_id as one row per row; a very long text only has a large size;
ties in order are broken by the hash of the row, and equal rows are told apart by a number; an empty table gives an empty mix;
columns with clashing names are carried through under their own names by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewatch.llm.words import WORD, stored, table

SHARE, PASSES, BLOCK_DOCS, SHARD_BLOCKS, MOST_SOURCES = 150, 2, 256, 8, 10_000
COARSE = 1024


def with_targets(sizes: DataFrame, share: int = SHARE, passes: int = PASSES) -> DataFrame:
    """source, n_docs, source_size, target from (source, n_docs, source_size); few rows, see above."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, (3, 1, 2))), (F.pmod(F.row_number().over(one) - 1, F.lit(3)) + 1)))
    capped = weighed.withColumn("cap", F.col("source_size") * passes)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = capped.select(
        "*",
        (F.sum("source_size").over(every) * share / F.lit(100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
    )
    # In this order sources are capped up to the first whose cap is above what its weight would give it.
    levelled = summed.withColumn("level", F.when(F.col("cap") * F.col("weights") >= F.col("rest") * F.col("weight"), F.col("rest") / F.col("weights")))
    level = F.first("level", ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return levelled.select("source", "n_docs", "source_size", F.coalesce(level * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _shards(counts: list[int], shards: int, seed: int):
    """Per shard and source: the first of its draws and how many, along its own path down the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                low, high, first, own = 0, shards, np.zeros(len(counts), np.int64), np.array(counts, np.int64)
                while high - low > 1 and own.sum():
                    middle = (low + high) // 2
                    draw = np.random.default_rng((seed, low, high))
                    left = draw.multivariate_hypergeometric(own, int(own.sum()) * (middle - low) // (high - low), method="marginals")
                    if shard < middle:
                        high, own = middle, left
                    else:
                        low, first, own = middle, first + left, own - left
                some = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), shard)), pa.array(some), pa.array(first[some]), pa.array(own[some])],
                    ["shard", "number", "first", "n"],
                )

    return run


def mix(docs: DataFrame, share: int = SHARE, passes: int = PASSES, block_docs: int = BLOCK_DOCS, seed: int = 11, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """(draws, sized). draws: key, hash, doc_id, size, shard, place: one row per use of a document, to
    be read by shard and place. sized: every document with key, source, size, source_size and target;
    key tells rows apart, also those that repeat a doc_id."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The row's own content is its key, so that a task that runs again after a loss deals the row the same.
    rows = stored(docs.select("doc_id", "source", size.alias("size"), _row_hash().alias("hash")), "sizes")
    doubled = rows.groupBy("hash", "doc_id").agg(F.count("*").alias("copies"), F.first("source").alias("source"), F.first("size").alias("size"))
    keyed = doubled.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "hash")
    keyed = stored(keyed.select(F.xxhash64("hash", "copy", F.lit(seed)).alias("key"), "hash", "doc_id", "source", "size"), "keyed")
    totals = keyed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    sources = [r for r in with_targets(totals, share, passes).orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()]
    if len(sources) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    plan = spark.createDataFrame(
        [(i, r.source, r.source_size, float(r.target), max(1, math.ceil(r.n_docs / block_docs)), *_passes(r.target, r.source_size)) for i, r in enumerate(sources)],
        "number long, source string, source_size long, target double, blocks long, whole long, rest double",
    )
    planned = keyed.join(F.broadcast(plan), keyed["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    sized = planned.withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    # Running sums by whole ranges of blocks, then by block inside one range, then by document inside one block.
    block = stored(sized.groupBy("number", "block", "blocks", "whole", "rest").agg(F.sum("size").alias("words")), "blocks")
    block = block.withColumn("part", F.floor(F.col("block") * COARSE / F.col("blocks")))
    parts = block.groupBy("number", "part").agg(F.sum("words").alias("words"))
    so_far = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("number", "part", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("part_before"))
    in_part = Window.partitionBy("number", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = block.join(parts, ["number", "part"]).withColumn("before", F.col("part_before") + F.coalesce(F.sum("words").over(in_part), F.lit(0)))
    placed = placed.withColumn("fits", F.col("before") + F.col("words") <= F.col("rest")).withColumn("cut", ~F.col("fits") & (F.col("before") < F.col("rest")))
    taken = F.col("whole") + F.when(F.col("fits") | F.col("cut"), 1).otherwise(0)
    drawn = stored(placed.select("number", "block", "before", "rest", "cut", taken.alias("times"), "whole"), "drawn").where("times > 0")
    # The urn: draw number = pass * blocks + block, permuted by a multiplier without common factor.
    last = {r.number: r.n for r in drawn.groupBy("number").agg(F.sum("times").alias("n")).collect()}  # one row per source
    counts = [int(last.get(i, 0)) for i in range(len(sources))]
    shards = max(1, math.ceil(sum(counts) / SHARD_BLOCKS))
    path = spark.range(shards).mapInArrow(_shards(counts, shards, seed), "shard long, number long, first long, n long")
    runs = path.select("shard", "number", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))
    stride = spark.createDataFrame([(i, c, _coprime(c)) for i, c in enumerate(counts)], "number long, n long, stride long")
    draws = drawn.select("number", "block", "before", "rest", "whole", "cut", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("pass"))
    draws = draws.join(F.broadcast(plan.select("number", "blocks")), "number").join(F.broadcast(stride), "number")
    draws = draws.withColumn("draw", F.pmod((F.col("pass") * F.col("blocks") + F.col("block")) * F.col("stride"), F.col("n")))
    draws = draws.join(runs, ["number", "draw"]).select("number", "block", "pass", "shard", "before", "rest", (F.col("cut") & (F.col("pass") == F.col("whole"))).alias("cut"))
    uses = sized.select("key", "hash", "doc_id", "number", "block", "size").join(stored(draws, "draws"), ["number", "block"])
    # In a block that is cut: every document that still fits when its turn comes. One block a source, of bounded rows.
    partly = uses.where("cut").groupBy("number", "block", "before", "rest").agg(F.array_sort(F.collect_list(F.struct("key", "size"))).alias("docs"))
    start = F.struct((F.col("rest") - F.col("before")).alias("gap"), F.array().cast("array<bigint>").alias("keys"))
    filled = F.aggregate("docs", start, lambda s, d: F.when(
        d["size"] <= s["gap"], F.struct((s["gap"] - d["size"]).alias("gap"), F.array_append(s["keys"], d["key"]).alias("keys"))
    ).otherwise(s))
    partly = partly.select("number", "block", F.explode(filled["keys"]).alias("key"))
    partly = uses.where("cut").join(partly, ["number", "block", "key"], "left_semi")
    out = uses.where("not cut").unionByName(partly.select(uses.columns))
    out = out.select("key", "hash", "doc_id", "size", "pass", "shard", F.xxhash64("key", "pass", "shard").alias("place"))
    return out, sized.select("key", "doc_id", "source", "size", "source_size", "target")


def _row_hash():
    return F.xxhash64("doc_id", "source", "text")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, shard after shard, in the order of each shard."""
    draws, _ = mix(docs)
    one = docs.withColumn("row_hash", _row_hash()).dropDuplicates(["row_hash"])
    drawn = one.join(draws.select(F.col("hash").alias("row_hash"), "shard", "place"), "row_hash")
    return drawn.repartition("shard").sortWithinPartitions("shard", "place").select(*docs.columns)


def _passes(target: float, size: int) -> tuple[int, float]:
    whole = int(target // size) if size else 0
    return whole, max(0.0, target - whole * size)


def _coprime(n: int) -> int:
    k = max(1, int(n * 0.6180339887))
    while math.gcd(k, max(1, n)) > 1:
        k += 1
    return k


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, sized = mix(table(spark, sf_dir, "documents"))
    taken = draws.groupBy("key", F.col("doc_id").alias("id")).agg(F.sum("size").alias("taken"))
    mixed = sized.join(taken, (sized["key"] == taken["key"]) & sized["doc_id"].eqNullSafe(taken["id"]), "left")
    return mixed.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
