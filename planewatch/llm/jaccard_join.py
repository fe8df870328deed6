"""Exact Jaccard join of documents on word shingles by a forest of signature trees.

Sets. A document's set is its distinct shingles of ``words`` words (all words of a shorter text are one).
Documents with equal sets become one class, which its smallest doc_id stands for.

Forest. Sets that link share one of the first ``n - ceil(0.8 n) + 1`` of their shingles in any order that
is the same for all. The order is by rising count in a table of ``CELLS`` cells, which covers all documents
and has a fixed size: passages that many documents share come last, at any corpus size, and no link depends on
it. A tree stands for a shingle; a class is in the trees of its first shingles, and trees of a single
class fall away.

Trees. The leaves of a tree are its classes, by size. Every node holds the bitmap of its shingles
(``BITS`` bits), which is the OR of those below it, the range of their sizes, and the most shingles that
share a bit with another. A pair of nodes can overlap in no more shingles than their bitmaps have in
common plus the fewer of those doubled ones. Dual traversal starts at (root, root), goes on to
pairs of children, and drops pairs whose possible overlap is below what their smallest sizes ask for, or
whose classes are known to be connected. All trees of a task are traversed at once.

What is left of a tree goes through the same traversal with bitmaps of one or two bits a shingle. Then of classes that could link are compared exactly on full texts, by a search from
each class through those not yet found, so that large groups of copies do not turn into all pairs.

Two rounds. First each class visits only the first of its trees, which connects most groups of copies. Then
come all trees that still hold more than one component. A tree of more than ``block`` classes is dealt
into blocks: in the first round each with three of the tree's classes as pivots, in the second each pair of
blocks on its own. No task holds more than two blocks, and no pair is left out.

Defined cases: null and wordless texts have the empty set and are linked with nothing; a null doc_id is linked
with nothing (component_id null); rows that repeat a doc_id are one document, linked with whatever links
with any of its texts; a very long text is one large set; ties do not arise; an empty table gives an empty
result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.components import components
from planewatch.llm.near_dedup import _groups, _spread, shingle_sets
from planewatch.llm.words import WordHashes, id_and_text, mix, slices, stored, table
from planewatch.operators.upsert import marked

WORDS, THRESHOLD = 5, 80  # per cent
CELLS_LOG, PIECE = 18, 1 << 12
CELLS = 1 << CELLS_LOG
MARKS_LOG = 24  # bits of a table of marked ids, 2 MB
BITS, FAN, BLOCK, PAIRS, ROWS = 1024, 8, 512, 1 << 19, 1 << 15
SALTS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def _cells(sets: np.ndarray) -> np.ndarray:
    return (mix(sets) >> np.uint64(64 - CELLS_LOG)).astype(np.int64)


def _digests(sets: np.ndarray, starts: np.ndarray) -> pa.Array:
    """128 bits that stand for a set; null for the empty one."""
    some = np.diff(starts) > 0
    sums = np.zeros((len(some), 2), np.uint64)
    for k, salt in enumerate(SALTS):
        if some.any():
            sums[some, k] = np.add.reduceat(mix(sets ^ salt), starts[:-1][some])
    return pa.array([x.tobytes() if n else None for x, n in zip(sums, some, strict=True)], pa.binary())


def _sign(words: int):
    """doc_id, n_shingles, digest of every row; then this task's counts of shingles by cell, as piece and counts."""
    names = ["doc_id", "n_shingles", "digest", "piece", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(CELLS, np.int64)
        for rows, texts in slices(batches):
            sets, starts = shingle_sets(hashes, texts, words)
            counts += np.bincount(_cells(sets), minlength=CELLS)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(starts)), _digests(sets, starts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        for at in range(0, CELLS, PIECE):
            if (some := counts[at : at + PIECE]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at // PIECE], pa.int32()), pa.array([some.tobytes()], pa.binary())], names
                )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # of at most CELLS / PIECE pieces
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[piece] = total.get(piece, 0) + np.frombuffer(counts, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])


def shingle_counts(signed: DataFrame) -> np.ndarray:
    """The table of counts; added up in two steps, so that no task adds the pieces of all tasks."""
    pieces = signed.where("piece is not null").select("piece", "counts")
    schema = "piece int, counts binary"
    few = pieces.repartition("piece", F.pmod(F.spark_partition_id(), F.lit(64))).mapInArrow(_add, schema)
    out = np.zeros((CELLS // PIECE, PIECE), np.int64)
    for r in few.repartition("piece").mapInArrow(_add, schema).collect():
        out[r.piece] += np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The narrower bitmap of the same set: places are low bits of a hash."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _prefixes(counts, words: int):
    """Per row the digest, the size, the bitmap, the wide bitmap and the first shingles in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows, texts in slices(batches, most=2 << 20):
            sets, starts = shingle_sets(hashes, texts, words)
            size = np.diff(starts)
            doc = np.repeat(np.arange(len(texts)), size)
            wide = np.array([max(BITS, 1 << int(n).bit_length()) for n in size], np.int64)  # one or two bits a shingle
            at = np.r_[0, np.cumsum(wide // 64)]
            bits = np.zeros(at[-1], np.uint64)
            bit = mix(sets ^ np.uint64(0x5851F42D4C957F2D)) & (wide[doc] - 1).astype(np.uint64)
            np.bitwise_or.at(bits, at[:-1][doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            own = [bits[a:b] for a, b in zip(at, at[1:], strict=False)]
            order = np.lexsort((sets, counts.value[_cells(sets)], doc))
            first = size - (THRESHOLD * size + 99) // 100 + (size > 0)
            keep = np.arange(len(sets)) - starts[:-1][doc] < first[doc]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first)].astype(np.int32)), pa.array(sets[order][keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), _digests(sets, starts), pa.array(size), pa.array([_folded(x, BITS // 64).tobytes() for x in own], pa.binary()),
                    pa.array([x.tobytes() for x in own], pa.binary()), lists,
                ],
                ["doc_id", "digest", "size", "bitmap", "wide", "first"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by tree, whose tree has another row."""
    held = None  # the last row so far, and whether its tree is already known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").to_numpy()
        same = tree[1:] == tree[:-1]
        goes = np.r_[False, same] | np.r_[same, False]
        if held is not None:
            before = held[0].column("tree")[0].as_py() == tree[0]
            if before or held[1]:
                yield held[0]
            goes[0] |= before
        out = np.flatnonzero(goes[:-1])
        if len(out):
            yield batch.take(pa.array(out))
        held = batch.slice(batch.num_rows - 1), bool(goes[-1])
    if held is not None and held[1]:
        yield held[0]


class Forest:
    """Signature trees of many groups of rows: ``group`` is sorted; inside a group rows are to be sorted by size."""

    def __init__(self, group: np.ndarray, size: np.ndarray, bitmap: np.ndarray, part: np.ndarray, side: np.ndarray) -> None:
        doubled = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        # Per level: bitmap, least and most size, doubled shingles, least and most component, sides (as bits).
        self.levels = [(bitmap, size, size, doubled, part, part, 1 << side)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(edge) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(edge, np.diff(np.r_[edge, len(group)]))
            start = np.flatnonzero(place % FAN == 0)
            self.children.append((start, np.diff(np.r_[start, len(group)])))
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.bitwise_or)
            self.levels.append(tuple(f.reduceat(x, start, axis=0) for f, x in zip(how, self.levels[-1], strict=True)))
            group = group[start]

    def able(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a pair of nodes may hold a pair of rows to link."""
        bitmap, least, most, doubled, low, high, sides = self.levels[level]
        common = np.bitwise_count(bitmap[a] & bitmap[b]).sum(axis=1, dtype=np.int64) + np.minimum(doubled[a], doubled[b])
        overlap = np.minimum(common, np.minimum(most[a], most[b]))
        out = (100 + THRESHOLD) * overlap >= THRESHOLD * (least[a] + least[b])
        out &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        return out & ~((sides[a] == sides[b]) & ((sides[a] == 2) | (sides[a] == 4)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may link, in portions."""
        top = len(self.levels) - 1
        root = np.arange(len(self.levels[top][1]))
        open_ = [(top, root, root)]
        while open_:
            level, a, b = open_.pop()
            keep = self.able(level, a, b)
            if level == 0:
                keep &= a != b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            start, many = self.children[level - 1]
            total = np.cumsum(many[a] * many[b])
            cuts = np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1
            for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True):
                if len(x):
                    n = many[x] * many[y]
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    right = np.repeat(many[y], n)
                    c, d = np.repeat(start[x], n) + k // right, np.repeat(start[y], n) + k % right
                    open_.append((level - 1, c[c <= d], d[c <= d]))


def _whole_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ROWS rows without cutting a tree; rows arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= ROWS:
            cut = int(np.argmax(np.r_[batch.column("tree").to_numpy() != held[-1].column("tree")[-1].as_py(), True]))
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _wide_enough(wide: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose wide bitmaps leave room for the overlap they need."""
    words = np.array([len(x) // 8 for x in wide])
    keep = np.zeros(len(a), bool)
    for both in np.unique(np.minimum(words[a], words[b])).tolist():
        here = np.flatnonzero(np.minimum(words[a], words[b]) == both)
        rows, place = np.unique(np.r_[a[here], b[here]], return_inverse=True)
        bits = np.stack([_folded(np.frombuffer(wide[r], np.uint64), both) for r in rows.tolist()])
        doubled = size[rows] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        x, y = place.reshape(2, -1)
        for at in range(0, len(here), step := max(1, (1 << 22) // both)):
            p, q = x[at : at + step], y[at : at + step]
            overlap = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64) + np.minimum(doubled[p], doubled[q])
            keep[here[at : at + step]] = (100 + THRESHOLD) * overlap >= THRESHOLD * (size[rows[p]] + size[rows[q]])
    return a[keep], b[keep]


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree the groups of rows connected by pairs that may link, named by what is in them."""
    for rows in _whole_trees(batches):
        group, node, size, part, side = (rows.column(c).to_numpy() for c in ("tree", "node", "size", "part", "side"))
        bitmap = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        found = list(Forest(group, size, bitmap, part, side.astype(np.int64)).pairs())
        if found and "wide" in rows.column_names:
            found = [_wide_enough(rows.column("wide").to_pylist(), size, *np.concatenate(found, axis=1))]
        if not found or not len(found[0][0]):
            continue
        a, b = np.concatenate(found, axis=1)
        root = np.arange(len(group))
        while True:  # the smallest row of each group spreads along its pairs
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = np.unique(np.r_[a, b])
        some = some[np.argsort(root[some], kind="stable")]
        edge = np.flatnonzero(np.r_[True, root[some][1:] != root[some][:-1]])
        name = mix(np.add.reduceat(mix(node[some].view(np.uint64) ^ SALTS[0]), edge))
        name = np.repeat(name, np.diff(np.r_[edge, len(some)]))
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(node[some]), pa.array(part[some])], ["cluster", "node", "part"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as small as they get, for the way to other tasks."""
    pack = zstandard.ZstdCompressor(level=3)
    for rows, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([pack.compress(t) for t in texts], pa.binary())], ["node", "text"])


def _links(words: int):
    """Edges of a forest over the true links inside each group, without comparing what is connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in _groups(batches, "cluster"):
            if group.num_rows < 2:
                continue
            node, part = group.column("node").to_numpy(), group.column("part").to_numpy()
            sets, starts = shingle_sets(hashes, [zstandard.decompress(t) for t in group.column("text").to_pylist()], words)
            size = np.diff(starts)
            token = np.unique(sets, return_inverse=True)[1].reshape(-1)
            held = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)

            def alike(i: int, rest: np.ndarray) -> np.ndarray:
                out = (part[rest] != part[i]) & (size[rest] * 100 >= THRESHOLD * size[i]) & (size[i] * 100 >= THRESHOLD * size[rest])  # noqa: B023
                some = rest[out]
                if len(some):
                    held[token[starts[i] : starts[i + 1]]] = True  # noqa: B023
                    ends = np.cumsum(size[some])  # noqa: B023
                    at = np.repeat(starts[some] - (ends - size[some]), size[some]) + np.arange(ends[-1])  # noqa: B023
                    both = np.add.reduceat(held[token[at]].astype(np.int64), ends - size[some])  # noqa: B023
                    held[token[starts[i] : starts[i + 1]]] = False  # noqa: B023
                    out[out] = 100 * both >= THRESHOLD * (size[some] + size[i] - both)  # noqa: B023
                return out

            root = _spread(len(node), alike)
            other = root != np.arange(len(node))
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], ["a", "b"])

    return run


def _dealt(posts: DataFrame, block: int, every: bool) -> DataFrame:
    """tree, node, side: trees as they are, or larger ones in blocks with pivots (or, if ``every``, in pairs of blocks)."""
    large = stored(posts.groupBy("tree").agg(F.count("*").alias("n"), F.min("node").alias("p0"), F.max("node").alias("p1"), F.min_by("node", F.xxhash64("node")).alias("p2")).where(F.col("n") > block), "large-trees")
    if large.isEmpty():
        return posts.select("tree", "node", F.lit(0).alias("side"))
    marked = posts.join(large, "tree", "left").withColumn("blocks", F.ceil(F.col("n") / block))
    whole = marked.where("n is null").select("tree", "node", F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("node", "tree"), F.col("blocks"))
    parts = marked.where("n is not null").select("tree", "node", "blocks", own.alias("own"))
    if every:
        met = parts.select("tree", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        parts = met.select(F.xxhash64("tree", F.least("own", "other"), F.greatest("own", "other")).alias("tree"), "node", side.alias("side"))
    else:
        pivots = large.select("tree", F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1).alias("all"), F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("node"))
        pivots = pivots.select("tree", "node", F.explode("all").alias("own"))
        parts = parts.select("tree", "node", "own").unionByName(pivots).distinct().select(F.xxhash64("tree", "own", "own").alias("tree"), "node", F.lit(0).alias("side"))
    return whole.unionByName(parts)


def _gathered(groups: DataFrame, block: int) -> DataFrame:
    """Groups that hold the same row, the one whose hash is the least in each of them, as one group if that has at most
    ``block`` rows: alike texts are together in many trees, and each of them is then copied once and not for every tree."""
    least = groups.groupBy("cluster").agg(F.min_by("node", F.xxhash64("node")).alias("anchor"))
    rows = groups.join(least, "cluster")
    few = rows.select("anchor", "node").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") <= block)
    name = F.when(F.col("n").isNotNull(), F.xxhash64("anchor")).otherwise(F.col("cluster"))
    return rows.join(few, "anchor", "left").select(name.alias("cluster"), "node", "part").distinct()


def _round(posts: DataFrame, members: DataFrame, texts: DataFrame, words: int, block: int, every: bool, label: str) -> DataFrame:
    """Links (a, b) found in the trees of ``posts`` (tree, node); members: node, size, bitmap, wide, part; texts: doc_id, text."""
    rows = _dealt(posts, block, every).join(members, "node")
    rows = rows.select("tree", "node", "size", "part", "side", "bitmap").repartition("tree").sortWithinPartitions("tree", "size", "node")
    schema = "cluster long, node long, part long"
    groups = stored(rows.mapInArrow(_traverse, schema).distinct(), f"{label}-loose-groups")
    # Once more with bitmaps as wide as the sets are large, which are too heavy to be in every tree.
    again = groups.select(F.col("cluster").alias("tree"), "node", "part", F.lit(0).alias("side")).join(members.select("node", "size", "bitmap", "wide"), "node")
    again = again.repartition("tree").sortWithinPartitions("tree", "size", "node").mapInArrow(_traverse, schema)
    groups = stored(_gathered(stored(again.distinct(), f"{label}-tight-groups"), block), f"{label}-groups")
    # Of the texts only those of some group are packed and leave their task, and by the same kind of join at any size.
    wanted = marked(texts, groups.select(F.col("node").alias("doc_id")), ("doc_id",), MARKS_LOG).where("_again")
    wanted = wanted.select("doc_id", "text").mapInArrow(_packed, "node long, text binary")
    met = groups.join(wanted.hint("merge"), "node").select("cluster", "node", "part", "text")
    return met.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(_links(words), "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    texts = id_and_text(docs)
    schema = "doc_id long, n_shingles long, digest binary, piece int, counts binary"
    passed = stored(texts.mapInArrow(_sign(words), schema), "signed")
    signed = passed.where("piece is null").select("doc_id", "n_shingles", "digest")
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(passed))
    able = signed.where("doc_id is not null and digest is not null")
    classes = stored(able.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    # An id with one row that stands for its class is a member as it is; only the rows of others are looked up.
    twice = signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    unsure = twice.unionByName(signed.where("digest is null").select("doc_id")).unionByName(able.join(classes, "digest").where("doc_id <> node").select("doc_id"))
    found = marked(texts.where("doc_id is not null"), unsure, ("doc_id",), MARKS_LOG)
    sure, looked_up = (
        found.where(which).select("doc_id", "text").mapInArrow(_prefixes(counts, words), "doc_id long, digest binary, size long, bitmap binary, wide binary, first array<long>")
        for which in ("not _again", "_again")
    )
    looked_up = looked_up.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    members = stored(sure.unionByName(looked_up).withColumnRenamed("doc_id", "node"), "members")
    posts = members.select("node", F.posexplode("first").alias("place", "tree"))
    posts = posts.repartition("tree").sortWithinPartitions("tree").mapInArrow(_shared, "node long, place int, tree long")
    posts = stored(posts, "trees")
    # Rows of one id with different texts are one document.
    several = able.join(classes, "digest").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("nodes"))
    several = several.where("a < b").select("a", F.explode("nodes").alias("b")).where("a < b")
    read = texts.where("doc_id is not null")
    bare = members.select("node", "size", "bitmap", "wide")
    first = posts.groupBy("node").agg(F.min_by("tree", "place").alias("tree"))
    links = stored(_round(first, bare.withColumn("part", F.col("node")), read, words, block, False, "first").unionByName(several), "first-links")
    found = stored(components(links, "first"), "first-components")
    named = stored(posts.join(found, "node", "left").select("tree", "node", F.coalesce("component", "node").alias("part")), "named")
    mixed = named.groupBy("tree").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("tree")
    left = stored(named.join(mixed, "tree", "left_semi"), "mixed")
    parted = bare.join(left.select("node", "part").distinct(), "node")
    more = _round(left.select("tree", "node"), parted, read, words, block, True, "every")
    final = components(stored(links.unionByName(more), "links"), "all")
    rows = signed.join(classes, "digest", "left").join(final.withColumnRenamed("component", "least"), "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "node", "doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def component_sql(words: int, kept: str = "") -> str:
    """The components of whole shingle sets as SQL, for tables whose doc_id does not repeat."""
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + {words - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {words - 2}, 2) END)) AS i FROM t)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (h) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id)::BIGINT AS component_id{kept}
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


SQL = component_sql(WORDS)
