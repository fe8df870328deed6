"""Phrase collocations from a weighted de Bruijn graph of word grams.

The graph. A node is a run of up to three words of one language, an edge the longest gram, four words:
it leads from its first three words to its last three. Every word position of every piece starts one
gram, of four words or of what the piece has left. Tasks count equal grams of about ``BUFFER`` bytes of
text before anything is shuffled.

Rows. A task's grams with the same first two words travel as one line of text, ``lang <tab> two words``
and then, each on a line of its own, the words behind them with a count if it is not 1.

Flow. Lines arrive sorted. What leaves a node, its edges and the ends of pieces in
it, is the count of its phrase, so one pass gives the counts of all phrases of one to four words.
Where the first two words together are too rare, nothing behind them is read. A node whose whole
flow leaves by one edge is compacted into it: one row then stands for all the lengths from ``low`` to
``k``. Rows below ``least`` are dropped where their count is complete, which is all but the counts of
single words, of hot pairs, and of pairs with more than ``OPEN`` different continuations in one task:
what is known of those is handed on before it fills the memory, and added up afterwards.

Hot pairs. Grams are dealt by their first two words. A pair with more than 1 in ``HOT`` of all
positions is found beforehand (each task names the pairs above that share of a buffer, at most ``2 *
HOT`` rows; a pair above it everywhere is above it somewhere) and dealt by all four words as well, in as
many parts as its share asks for. Its counts of two and three words come as one row per part and
are added up afterwards. So no task's share of the rows grows with the commonest pair, and at most
``2 * HOT`` pairs are sent to the tasks.

Scores. The two parts of every cut of a candidate are looked up among the counted phrases: both are
inside the candidate, so both are counted. Products are decimals of 38 digits.

Defined cases: a null text is empty; a null lang is ``und``; rows that repeat a doc_id or have none
count one by one; a very long text is cut at a piece end or, in a piece without end, between words, with
the three next words in view, so that counts do not change; ties of cuts go to the smallest cut,
ties of phrases to higher count and then smaller UTF-8 bytes; an empty table gives an empty result;
columns other than text and lang play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewatch.llm.words import stored, table

LEAST, INSIDE, TOP = 30, 80, 2000
BUFFER, HOT, OPEN, DEALT = 3 << 20, 512, 32 << 20, 256
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
IS_BREAK, IS_BLANK = np.zeros(256, bool), np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
IS_BLANK[list(BLANKS)] = True
GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
AHEAD = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,3}")


def _stretches(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of a text and how many of their bytes are their own; what follows those is only looked at."""
    at = 0
    while len(text) - at > most and (gap := GAP.search(text, at + most)):
        yield text[at : AHEAD.match(text, gap.start()).end()], gap.start() - at
        at = gap.start()
    yield text[at:], len(text) - at


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, bytes, int]]]:
    """(lang, stretch, own bytes) of about ``most`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for stretch, own in _stretches(text or b"", most):
                if held and size + len(stretch) > most:
                    yield held
                    held, size = [], 0
                if own:
                    held.append((lang, stretch.lower(), own))  # bytes.lower() changes A-Z only
                    size += len(stretch) + 1
    if held:
        yield held


def _named(lang: str) -> bytes:
    """A language without the marks that lines are made of."""
    name = lang.encode()
    return b"\x01" + name.hex().encode() if set(name) & set(b"\t\n\r") or name[:1] == b"\x01" else name


def _unnamed(name: bytes) -> str:
    return (bytes.fromhex(name[1:].decode()) if name[:1] == b"\x01" else name).decode()


def _noted(numbers: np.ndarray, form: bytes, usual: int) -> pa.Array:
    """Numbers as text, empty for the usual one."""
    some, back = np.unique(numbers, return_inverse=True)
    return pa.array([b"" if x == usual else form % x for x in some.tolist()], pa.binary()).take(pa.array(back.reshape(-1)))


class _Grams:
    """The distinct grams of one buffer, sorted, as places in the sorted list of its words (0 is none), and their counts."""

    def __init__(self, buffer: list[tuple[str, bytes, int]]) -> None:
        raw = np.frombuffer(b"\n".join(b for _, b, _ in buffer), np.uint8)
        ends = IS_BREAK[raw]
        inside = ~(ends | IS_BLANK[raw])
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        piece = np.cumsum(ends)[start]
        first = np.r_[0, np.cumsum([len(b) + 1 for _, b, _ in buffer])][:-1]
        row = np.searchsorted(first, start, "right") - 1
        names = sorted({lang for lang, _, _ in buffer})
        lang = np.array([names.index(x) for x, _, _ in buffer], np.int64)[row]
        offsets = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        self.words, self.names = words.dictionary.take(pa.array(order)), names
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        ids = place[words.indices.to_numpy()]
        after, open_ = [ids], np.ones(len(ids), bool)
        for k in (1, 2, 3):
            open_ = open_ & np.r_[piece[k:] == piece[:-k], np.zeros(min(k, len(ids)), bool)]
            after.append(np.where(open_, np.r_[ids[k:], np.zeros(min(k, len(ids)), np.int64)], 0))
        own = start - first[row] < np.array([n for _, _, n in buffer])[row]
        high, low = ((lang << 42) + (after[0] << 21) + after[1])[own], ((after[2] << 21) + after[3])[own]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(high)])
        self.n = np.diff(np.r_[new, len(high)])
        self.high, self.low = high[new], low[new]

    def rows(self, hot: list[tuple[str, str, str, int]]) -> pa.Array:
        """One line per language and pair of first words (and part), with the words behind them."""
        part, mask = self.parts(hot), (1 << 21) - 1
        order = np.lexsort((self.low, part, self.high)) if part.any() else np.arange(len(part))
        high, low, part, n = self.high[order], self.low[order], part[order], self.n[order]
        new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (part[1:] != part[:-1])][: len(high)])
        none = pa.array([b""], pa.binary())
        plain, spaced = pa.concat_arrays([none, self.words]), pa.concat_arrays([none, pc.binary_join_element_wise(b" ", self.words, b"")])
        behind = pc.binary_join_element_wise(plain.take(pa.array(low >> 21)), spaced.take(pa.array(low & mask)), _noted(n, b"\t%d", 1), b"")
        behind = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[new, len(high)].astype(np.int32)), behind), b"\n")
        lang = pa.array([_named(x) + b"\t" for x in self.names], pa.binary()).take(pa.array(high[new] >> 42))
        first, second = plain.take(pa.array(high[new] >> 21 & mask)), spaced.take(pa.array(high[new] & mask))
        return pc.binary_join_element_wise(lang, first, second, _noted(part[new], b"\r%d", 0), b"\n", behind, b"")

    def pair(self, lang: str, first: str, second: str) -> int | None:
        """The number that stands for a pair in ``high``."""
        if lang not in self.names:
            return None
        ids = [pc.index(self.words, pa.scalar(w.encode(), pa.binary())).as_py() + 1 for w in (first, second)]
        return (self.names.index(lang) << 42) + (ids[0] << 21) + ids[1] if all(ids) else None

    def parts(self, hot: list[tuple[str, str, str, int]]) -> np.ndarray:
        """0, and for grams of hot pairs a number from 1 on that follows from their last two words."""
        out = np.zeros(len(self.n), np.int32)
        for lang, first, second, n in hot:
            if (key := self.pair(lang, first, second)) is not None:
                a, b = np.searchsorted(self.high, [key, key + 1])
                rest, back = np.unique(np.r_[self.low[a:b] >> 21, self.low[a:b] & (1 << 21) - 1], return_inverse=True)
                known = np.array([xxhash.xxh3_64_intdigest(self.words[i - 1].as_py()) if i else 0 for i in rest.tolist()], np.uint64)
                h = known[back].reshape(2, -1)
                out[a:b] = 1 + ((h[0] * np.uint64(0x9E3779B97F4A7C15) + h[1]) >> np.uint64(16)) % np.uint64(n)
        return out


def _hot(most: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for buffer in _buffers(batches, most):
            grams = _Grams(buffer)
            total += int(grams.n.sum())
            new = np.flatnonzero(np.r_[True, grams.high[1:] != grams.high[:-1]][: len(grams.high)])
            if len(new):
                n = np.add.reduceat(grams.n, new)
                often = (n * hot > n.sum()) & (grams.high[new] & (1 << 21) - 1 > 0)
                pairs = [(grams.names[h >> 42], *(grams.words[i - 1].as_py().decode() for i in (h >> 21 & (1 << 21) - 1, h & (1 << 21) - 1))) for h in grams.high[new[often]].tolist()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (zip(*pairs, strict=True) if pairs else ([], [], []))), pa.array(n[often])], ["lang", "w1", "w2", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string())] * 3 + [pa.array([total])], ["lang", "w1", "w2", "n"])

    return run


def hot_pairs(texts: DataFrame, most: int, hot: int) -> list[tuple[str, str, str, int]]:
    """(lang, first word, second word, parts) of at most 2 * hot pairs: named counts are true ones, and each is over total / (2 * hot)."""
    named = stored(texts.mapInArrow(_hot(most, hot), "lang string, w1 string, w2 string, n long").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")), "pairs")
    total = sum(r.n for r in named.where("lang is null").collect())
    found = named.where("lang is not null").where(F.col("n") * (2 * hot) > total).collect()
    return [(r.lang, r.w1, r.w2, math.ceil(r.n * 2 * hot / total)) for r in found]


def _edges(most: int, hot: list[tuple[str, str, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(batches, most):
            rows = _Grams(buffer).rows(hot)
            for at in range(0, len(rows), 1 << 15):
                yield pa.RecordBatch.from_arrays([rows.slice(at, 1 << 15)], ["line"])

    return run


class _Lines:
    """Where the keys and the first words of lines end, and how many grams each line holds."""

    def __init__(self, lines: pa.Array) -> None:
        offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        self.raw = np.frombuffer(lines.buffers()[2], np.uint8)[: offsets[-1]]
        self.start, self.stop = offsets[:-1], offsets[1:]
        turn = np.flatnonzero(self.raw == 10)
        first = np.searchsorted(turn, self.start)
        self.key = turn[first]
        gap = np.flatnonzero((self.raw == 32) | (self.raw == 13) | (self.raw == 10))
        tab = np.flatnonzero(self.raw == 9)
        self.lang = tab[np.searchsorted(tab, self.start)]
        self.word = gap[np.searchsorted(gap, self.lang)]
        self.n = np.searchsorted(turn, self.stop) - first
        # Counts that are told: what they say, less the one that the entry itself counts for.
        at = tab[tab > self.key[np.searchsorted(self.start, tab, "right") - 1]]
        row, said, going = np.searchsorted(self.start, at, "right") - 1, np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(1, 20):
            place = np.minimum(at + k, len(self.raw) - 1)
            going &= (at + k < self.stop[row]) & (self.raw[place] > 47) & (self.raw[place] < 58)
            if not going.any():
                break
            said[going] = said[going] * 10 + self.raw[place[going]] - 48
        np.add.at(self.n, row, said - 1)

    def heads(self, stop: np.ndarray) -> pa.Array:
        """The beginnings of the lines, up to the given places."""
        length = stop - self.start
        ends = np.r_[0, np.cumsum(length)]
        letters = self.raw[np.arange(ends[-1]) + np.repeat(self.start - ends[:-1], length)]
        return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])


def _differ(column: pa.Array) -> np.ndarray:
    """Where a column without nulls differs from the row before."""
    return np.r_[True, np.array(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))]


class _Node:
    """What is known of one pair of first words: its flow, and the counts of what stands behind it."""

    def __init__(self, key: bytes) -> None:
        self.key, self.n, self.bytes = key, 0, 0
        self.held: list[bytes] = []
        self.counts: Counter = Counter()
        self.partial = b"\r" in key  # other tasks have more of it

    def add(self, n: int, behind: bytes) -> None:
        self.n += n
        self.held.append(behind)
        self.bytes += len(behind)

    def read(self) -> None:
        for entry, times in Counter(b"\n".join(self.held).split(b"\n")).items() if self.held else ():
            words, tab, n = entry.partition(b"\t")
            self.counts[words] += times * int(n) if tab else times
        self.held, self.bytes = [], 0

    def rows(self, least: int) -> Iterator[tuple[str, bytes, int, int, int]]:
        """(lang, words, k, low, f)."""
        lang, _, key = self.key.partition(b"\r")[0].partition(b"\t")
        if b" " not in key or self.n < least and not self.partial:
            return  # the end of a piece, or a pair too rare for anything behind it
        self.read()
        lang, flows = _unnamed(lang), Counter()
        for words, n in self.counts.items():
            if words:
                flows[words.partition(b" ")[0]] += n
        fewest = 1 if self.partial else least
        lows, whole = {}, False
        for third, n in flows.items():
            if n >= fewest:
                unary = n == self.n and not self.partial
                lows[third] = 2 if unary else 3
                whole |= unary
        if not whole:
            yield lang, key, 2, 2, self.n
        compacted = set()
        for words, n in self.counts.items():
            third, more, _ = words.partition(b" ")
            if more and n >= fewest:
                unary = n == flows[third] and not self.partial
                if unary:
                    compacted.add(third)
                yield lang, key + b" " + words, 4, lows[third] if unary else 4, n
        for third, low in lows.items():
            if third not in compacted:
                yield lang, key + b" " + third, 3, low, flows[third]


def _flow(least: int, most: int):
    """Counts of all phrases from sorted lines. One pair is open at a time."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("k", pa.int32()), ("low", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("line")
            lines = _Lines(column)
            first = lines.heads(lines.word)
            runs = np.flatnonzero(_differ(first))
            out = []
            for head, n in zip(first.take(pa.array(runs)).to_pylist(), np.add.reduceat(lines.n, runs).tolist(), strict=True):
                lang, _, word = head.partition(b"\t")
                out.append((_unnamed(lang), word, 1, 1, n))
            starts = np.flatnonzero(_differ(lines.heads(lines.key)))
            stops = np.r_[starts[1:], batch.num_rows]
            # Pairs that are too rare, and neither first nor last of the batch, are passed over.
            look = (np.add.reduceat(lines.n, starts) >= least) | (lines.raw[lines.word[starts]] == 32) & _dealt_apart(lines, starts)
            look[[0, -1]] = True
            for a, b in zip(starts[look].tolist(), stops[look].tolist(), strict=True):
                for i in range(a, b):
                    line = column[i].as_py()
                    split = int(lines.key[i] - lines.start[i])
                    if node is None or node.key != line[:split]:
                        if node is not None:
                            out.extend(node.rows(least))
                        node = _Node(line[:split])
                    node.add(int(lines.n[i]), line[split + 1 :])
                    if node.bytes > most:
                        node.read()
                        if len(node.counts) * 64 > most:
                            node.partial = True
                            out.extend(node.rows(least))
                            node.n, node.counts = 0, Counter()
                if len(out) > 1 << 17:
                    yield from _batches(out, schema)
                    out = []
            yield from _batches(out, schema)
        if node is not None:
            yield from _batches(node.rows(least), schema)

    return run


def _dealt_apart(lines: _Lines, rows: np.ndarray) -> np.ndarray:
    """Whether the key of a row names a part of a hot pair."""
    mark = np.flatnonzero(lines.raw == 13)
    return np.searchsorted(mark, lines.key[rows]) > np.searchsorted(mark, lines.start[rows])


def _batches(rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for at in range(0, len(rows), 1 << 15):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + (1 << 15)], strict=True), schema.types, strict=True)], schema=schema)


def phrase_counts(docs: DataFrame, least: int = LEAST, buffer: int = BUFFER, hot: int = HOT, open_bytes: int = OPEN) -> tuple[DataFrame, DataFrame]:
    """(phrases, words). phrases: lang, phrase, m (its words, 1 to 4), f, of all phrases counted at least
    ``least`` times; words: lang, n, the count of all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    edges = texts.mapInArrow(_edges(buffer, hot_pairs(texts, buffer, hot)), "line binary")
    dealt = edges.repartition(F.substring_index(F.col("line").cast("string"), "\n", 1)).sortWithinPartitions("line")
    graph = dealt.mapInArrow(_flow(least, open_bytes), "lang string, words binary, k int, low int, f long")
    graph = stored(graph.select("lang", F.col("words").cast("string").alias("words"), "k", "low", "f"), "graph")
    single = stored(graph.where("k = 1").groupBy("lang", F.col("words").alias("w1")).agg(F.sum("f").alias("f")), "words")
    spread = graph.where("k > 1").select("lang", F.split("words", " ", -1).alias("w"), "f", F.explode(F.sequence("low", "k")).alias("m"))
    phrase = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("m"))).alias("phrase")
    longer = spread.select("lang", phrase, "m", "f").groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"))
    counted = longer.unionByName(single.select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("m"), "f")).where(F.col("f") >= least)
    return stored(counted, "phrases"), single.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buffer: int = BUFFER, hot: int = HOT, open_bytes: int = OPEN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to four words of each language."""
    phrases, words = phrase_counts(docs, least, buffer, hot, open_bytes)
    candidates = phrases.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    w = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "m", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"))
    first, rest = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("cut"))), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("m") - F.col("cut")))
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), first.alias("part")), F.struct(F.lit(False).alias("left"), rest.alias("part")))).alias("side"))
    sides = sides.select("lang", F.col("side.part").alias("part"), "phrase", "a", "cut", F.col("side.left").alias("left"))
    parts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    found = sides.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr("(2000000 * CAST(a AS decimal(30, 0))) div (CAST(l AS decimal(20, 0)) + r)").alias("score")
    least_cut = found.select("lang", "phrase", "a", F.struct(score, "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    # The longest count around each phrase that is a part of a longer candidate.
    lengths = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda j: F.transform(
        F.sequence(F.lit(1), F.col("m") - j + 1), lambda i: F.concat_ws(" ", F.slice("w", i, j))
    )))
    around = candidates.where("m > 2").select("lang", "m", w.alias("w"), "a").select("lang", F.explode(lengths).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least_cut.join(around, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR 100 * CAST(longer AS decimal(30, 0)) < {inside} * CAST(a AS decimal(30, 0))")
    ).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))  # a language's phrases are cut down in many tasks first
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1)::BIGINT)) AS i FROM t, (VALUES (1), (2), (3), (4)) AS x(k))
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS MATERIALIZED (
  SELECT c.*, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
), lefts AS MATERIALIZED (
  SELECT cuts.*, f.f AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = cuts.first
), cut AS (
  SELECT x.lang, x.phrase, x.a, x.j, x.l, f.f AS r, (2000000 * x.a::HUGEINT) // (x.l + f.f) AS score
  FROM lefts x JOIN f ON f.lang = x.lang AND f.phrase = x.rest
), lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[s:s + j - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM c))
  ) GROUP BY lang, phrase
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {INSIDE} * a::HUGEINT
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= {TOP}
"""
