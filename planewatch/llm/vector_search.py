"""Approximate nearest neighbours by largest inner product, from balanced posting lists.

1. The largest inner product is the smallest distance once every vector gets one more component that
   gives all of them the length of the longest. Centroids are trained on at most ``TRAIN_ROWS``
   vectors, chosen by a hash of the id; clusters that are much too small are moved into large ones.
   Their number is ``LISTS`` times the root of the number of rows, at most ``MOST_LISTS``.
2. Every vector goes to the list of its nearest centroid, and near a boundary also to others, up to
   ``COPIES``, whose distance is within ``CLOSE`` of the smallest.
3. Centroids are searched through an in-memory neighbour graph, for many vectors at once.
4. A query visits the lists whose centroid is within ``RATIO`` of its smallest distance, at least
   ``LEAST_LISTS`` and at most ``VISITS`` times the root of the number of lists.
5. Lists are dealt into blocks of about ``LIST_ROWS`` vectors, and the queries of a list into blocks of
   about ``QUERY_ROWS``, so that a list that very many rows share is searched by many tasks. Inside a
   block the scores are exact, in double precision; each query keeps its nearest there, and the best
   of all blocks after that.

Defined cases: vectors that are null, zero, hold null or non-finite components, have another length
than most, or have no id take no part; rows that repeat an id count as one (the one whose vector has
the smallest hash); ties go to the smaller id; with fewer candidates than asked for, all are found
(queries that found too few visit every list); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewatch.llm.words import stored, table

K, EVERY = 20, 20
TRAIN_ROWS, LISTS, VISITS, MOST_LISTS = 20_000, 0.4, 3.6, 4096
COPIES, CLOSE, RATIO, LEAST_LISTS, DEGREE = 4, 1.03, 1.35, 16, 16
LIST_ROWS, QUERY_ROWS = 2048, 512


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): one row per id that takes part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    one = good.groupBy("vec_id").agg(F.min_by("vector", F.struct(F.xxhash64("vector"), F.to_json("vector"))).alias("vector"))
    one = stored(one.where("size(vector) > 0"), "vectors")
    usual = one.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return one.where(F.size("vector") == (usual.length if usual else 0))


def train_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.default_rng(1)
    centres = x[draw.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        small = np.flatnonzero(counts * 4 < len(x) / lists)
        large = np.argsort(-counts, kind="stable")[: len(small)]
        for s, g in zip(small, large, strict=False):
            if counts[g] > 2 * max(1, counts[s]):
                centres[s] = x[draw.choice(np.flatnonzero(near == g))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])


class CentroidGraph:
    """Each centroid linked to its nearest others; searched by widening beams, many vectors at a time."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        square = (centres * centres).sum(1)
        self.links = np.concatenate(
            [np.argsort(square - 2 * centres[a : a + 512] @ centres.T, axis=1, kind="stable")[:, : DEGREE + 1] for a in range(0, len(centres), 512)]
        )
        jumps = np.random.default_rng(2).integers(0, len(centres), (len(centres), 2))  # a few far links keep it connected
        self.links = np.concatenate([self.links, jumps], axis=1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found and their distances, nearest first; -1 where fewer were found."""
        n, lists = len(x), len(self.centres)
        rows = np.arange(n)
        seen, opened = np.zeros((n, lists), bool), np.zeros((n, lists), bool)
        distance = np.full((n, lists), np.inf)
        new = np.tile(np.unique(np.linspace(0, lists - 1, min(lists, 8)).astype(int)), (n, 1))
        wide = min(beam, lists)
        while True:
            fresh = ~np.take_along_axis(seen, new, 1)
            r, c = np.nonzero(fresh)
            r, c = r, new[r, c]
            distance[r, c] = np.sqrt(((x[r] - self.centres[c]) ** 2).sum(1))
            seen[r, c] = True
            waiting = np.where(opened, np.inf, distance)
            best = waiting.argmin(1)
            worst = np.partition(distance, wide - 1, axis=1)[:, wide - 1]
            go = (waiting[rows, best] <= worst) & np.isfinite(waiting[rows, best])
            if not go.any():
                break
            opened[rows[go], best[go]] = True
            new = np.where(go[:, None], self.links[best], best[:, None])
        order = np.argsort(distance, axis=1, kind="stable")[:, :wide]
        found = np.take_along_axis(distance, order, 1)
        return np.where(np.isfinite(found), order, -1), found


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("vector").flatten()).reshape(batch.num_rows, -1)


def _assign(shared, longest: float, beam: int, close: float, least: int, most: int, extend: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            graph = graph or CentroidGraph(shared.value)
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = _vectors(some)
                more = np.sqrt(np.maximum(longest - (x * x).sum(1), 0)) if extend else np.zeros(len(x))
                lists, distance = graph.search(np.c_[x, more], beam)
                take = (lists >= 0) & ((distance <= close * distance[:, :1]) | (np.arange(lists.shape[1]) < least))
                take[:, most:] = False
                offsets = np.zeros(len(x) + 1, np.int32)
                np.cumsum(take.sum(1), out=offsets[1:])
                own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists[take].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("vector"), own], ["vec_id", "vector", "lists"])

    return run


def _search(k: int):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            x, q = (np.array(t.column("vector").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (vectors, queries))
            ids, own = vectors.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            slack = 1e-9 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
            rough = q @ x.T
            rough[own[:, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                # Exact scores, each summed in the same order, decide among those near the k-th and above.
                c = np.flatnonzero((rough[i] >= least[i] - slack[i]) & np.isfinite(rough[i]))
                score = (q[i] * x[c]).sum(axis=1)
                best = np.lexsort((ids[c], -score))[:k]
                found.append((np.full(len(best), own[i]), ids[c[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def _visit(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query and block."""
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("v_blocks"))
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("q_blocks"))
    blocks = stored(sizes.join(asked, "list"), "list-blocks")

    def part(n: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = postings.join(blocks, "list").select("list", part("v_blocks").alias("v"), each("q_blocks").alias("q"), "vec_id", "vector")
    right = queries.join(blocks, "list").select("list", each("v_blocks").alias("v"), part("q_blocks").alias("q"), "vec_id", "vector")
    keys = ["list", "v", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, is_query, k: int = K, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of every row for which ``is_query`` holds."""
    spark = rows.sparkSession
    vectors = usable(rows)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = vectors.agg(F.count("*"), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).toArrow()
    x = _vectors(sample.combine_chunks().to_batches()[0])
    x = np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))]
    lists = int(np.clip(LISTS * math.sqrt(n), 1, min(MOST_LISTS, len(x))))
    shared = spark.sparkContext.broadcast(train_centroids(x, lists))
    assigned = "vec_id long, vector array<double>, lists array<int>"

    def exploded(frame: DataFrame) -> DataFrame:
        return frame.select(F.explode("lists").alias("list"), "vec_id", "vector")

    postings = exploded(stored(vectors.mapInArrow(_assign(shared, longest, 2 * COPIES, CLOSE, 1, COPIES, True), assigned), "postings"))
    asking = vectors.where(is_query)
    most = max(LEAST_LISTS, math.ceil(VISITS * math.sqrt(lists)))
    visits = exploded(asking.mapInArrow(_assign(shared, longest, most, ratio, LEAST_LISTS, most, False), assigned))
    best = stored(_best(_visit(postings, visits, k), k), "nearest")
    enough = best.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k, n - 1))
    short = stored(asking.join(enough, "vec_id", "left_anti"), "short")
    if n > 1 and not short.isEmpty():
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), "vec_id", "vector")
        again = _best(_visit(postings, every, k), k)
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
