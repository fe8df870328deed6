"""Removal of passages that an earlier document already has, with a count-min prefilter.

A window is ``WINDOW`` consecutive words. Neighbouring windows share an anchor: the smallest hash
among the runs of ``GRAM`` words inside the window. Equal windows have equal anchors, so the count of
an anchor is never below the count of any of its windows, and about one anchor stands for twenty of
them. A block is a run of consecutive windows with one anchor.

1. Each task names the cells of its anchors in a count-min sketch of ``ROWS`` rows, which stop at two;
   they are merged piece by piece. The estimate is never too low. A row has eight cells for every block
   that texts of this size have, up to ``2 ** MOST_WIDTH`` (64 MB for both rows as bits). Larger sketches
   would not fit a broadcast, and asking a sketch that is spread over the cluster moves each block
   as far as step 2 does; so beyond some 50 GB of text step 2 gets a growing share of all blocks.
2. Blocks whose anchor is estimated to be repeated (no others can hold a repeated window) are grouped
   exactly, by a 128-bit hash of all their words. A block found in a smaller doc_id is removed as a whole.
3. Where an anchor has blocks of different words, the windows of those blocks are grouped exactly too,
   each block speaking once, through its smallest document. Which of its windows also start in a
   smaller doc_id is all that step 2 has left open. The tasks find those blocks by a bitmap with 128 bits
   for each of them, fewer where that would be more than ``2 ** MOST_WIDTH``, and by a join where it would be
   fewer than eight.
4. Spans of removed words meet the texts by doc_id and ``row``, which tells the texts of an id with several
   apart: 0, or a hash of the text.

Defined cases: a null text has no words; a null doc_id neither removes nor loses words; of rows that repeat a
doc_id each loses its own repeated words (none because of the other, whose doc_id is not smaller); a
very long text is one document like any other, worked on by itself; an empty table gives an empty result;
columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import Powers, WordHashes, id_and_text, mix, slices, stored, table

WINDOW, GRAM, ROWS = 50, 10, 2
MOST_WIDTH, BLOCK_BYTES, CELLS_PER_BLOCK, BITS_PER_OPEN, LEAST_PER_OPEN = 28, 256, 8, 128, 8
PIECE = 1 << 15  # cells of one stored piece of the sketch
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


class _Windows:
    """Hashes of windows and blocks of a few texts."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.powers = Powers(0xB5026F5AA96619E9), Powers(0xD1342543DE82EF95)

    def read(self, texts: list[bytes]) -> None:
        h, starts = self.hashes.of(texts)
        self.prefix = self.powers[0].prefix(h), self.powers[1].prefix(mix(h))
        n, counts = len(h), np.diff(starts)
        windows = np.maximum(counts - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), windows)
        first = np.r_[0, np.cumsum(windows)]
        self.at = np.arange(first[-1]) - np.repeat(first[:-1] - starts[:-1], windows)
        if not len(self.at):
            self.block_start = self.block_end = self.anchor = np.zeros(0, np.uint64)
            self.block_doc = self.block_at = self.block_stop = np.zeros(0, np.int64)
            return
        low = mix(self.powers[0].runs(self.prefix[0], np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
        span, left = 1, WINDOW - GRAM + 1  # minimum over the runs of a window, by doubling
        while span * 2 <= left:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (left - span)], low[left - span :])[self.at]
        new = np.r_[True, (low[1:] != low[:-1]) | (self.doc[1:] != self.doc[:-1])]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(low)] - 1
        self.anchor, self.block_doc = low[begin], self.doc[begin]
        self.block_at, self.block_stop = self.at[begin], self.at[end] + WINDOW
        self.offset = starts

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = (end - start).astype(np.uint64)
        return tuple(mix(p.runs(q, start, end) + length * np.uint64(0x9E3779B97F4A7C15)) for p, q in zip(self.powers, self.prefix, strict=True))


def _cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(anchor ^ np.uint64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - width)).astype(np.int64)


def _count(width: int):
    """The cells of this task's anchors, sorted, piece by piece; each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows()
        for _, texts in slices(batches, most=2 << 20):
            windows.read(texts)
            for row in range(ROWS):
                cells = np.sort(_cells(windows.anchor, row, width))
                if not len(cells):
                    continue
                cells = cells[np.r_[np.ones(min(2, len(cells)), bool), cells[2:] != cells[:-2]]]
                piece = cells // PIECE
                edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                offsets = np.r_[edge, len(cells)] * 2
                inside = pa.py_buffer((cells % PIECE).astype(np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row << width) // PIECE + piece[edge]), pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int32)), inside])],
                    ["piece", "cells"],
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up pieces that arrive sorted; keeps, per piece, the cells counted twice or more as bits."""
    at, counts = None, np.zeros(PIECE, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        if (counts > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["piece", "twice"])

    for batch in batches:
        for piece, cells in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if piece != at:
                yield from told()
                at = piece
                counts[:] = 0
            np.add.at(counts, np.frombuffer(cells, np.uint16), 1)
    yield from told()


def sketch_width(blocks: int, cells: int = CELLS_PER_BLOCK, most: int = MOST_WIDTH) -> int:
    """How many cells, as a power of two, that many blocks ask for."""
    return min(most, max(PIECE.bit_length() - 1, (blocks * cells - 1).bit_length()))


def repeated_anchors(texts: DataFrame, width: int) -> np.ndarray:
    """The merged sketch as ROWS bitmaps of 2 ** width bits: cells counted at least twice."""
    pieces = texts.mapInArrow(_count(width), "piece long, cells binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece long, twice binary")
    out = np.zeros((ROWS * (1 << width) // PIECE, PIECE // 8), np.uint8)
    for r in merged.toLocalIterator():  # at most ROWS * 2 ** MOST_WIDTH bits, whatever the input
        out[r.piece] = np.frombuffer(r.twice, np.uint8)
    return out.reshape(ROWS, -1)


def _test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _blocks(sketch, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, windows = sketch.value, _Windows()
        for rows, texts in slices(batches, most=2 << 20):
            windows.read(texts)
            if not len(windows.anchor):
                continue
            seen = np.all([_test(bits[row], _cells(windows.anchor, row, width)) for row in range(ROWS)], axis=0)
            at, stop, doc = windows.block_at[seen], windows.block_stop[seen], windows.block_doc[seen]
            h1, h2 = windows.digests(at, stop)
            ids, first = rows.column("doc_id").to_numpy(), windows.offset[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), rows.column("row").take(pa.array(doc)), pa.array(windows.anchor[seen].view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(at - first), pa.array(stop - first)],
                ["doc_id", "row", "anchor", "h1", "h2", "start", "stop"],
            )

    return run


def _windows_of(windows: _Windows, rows: pa.RecordBatch, doc: np.ndarray, at: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """``many`` windows from each place on."""
    first = np.r_[0, np.cumsum(many)]
    start = np.arange(first[-1]) + np.repeat(at - first[:-1], many)
    doc = np.repeat(doc, many)
    w1, w2 = windows.digests(start, start + WINDOW)
    begin = start - windows.offset[doc]
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").take(pa.array(doc)), rows.column("row").take(pa.array(doc)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(begin)],
        ["doc_id", "row", "h1", "h2", "start"],
    )


def _parts(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that stay small on the way out."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _open_windows(sketch, width: int):
    """Windows of the blocks whose bit is set. A bit set by chance adds true windows of true documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, windows = sketch.value, _Windows()
        for rows, texts in slices(batches, most=2 << 20):
            windows.read(texts)
            if not len(windows.anchor):
                continue
            ids = rows.column("doc_id").to_numpy()
            h1, _ = windows.digests(windows.block_at, windows.block_stop)
            seen = _test(bits, (h1.view(np.int64) ^ ids[windows.block_doc]) & ((1 << width) - 1))
            at, many = windows.block_at[seen], windows.block_stop[seen] - WINDOW + 1 - windows.block_at[seen]
            if len(at):
                yield from _parts(_windows_of(windows, rows, windows.block_doc[seen], at, many))

    return run


def _listed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the blocks listed with each text."""
    windows = _Windows()
    for rows, texts in slices(batches, most=2 << 20):
        windows.read(texts)
        if not len(windows.anchor):
            continue
        starts, stops = rows.column("starts"), rows.column("stops")
        doc = np.repeat(np.arange(len(texts)), np.array(pc.list_value_length(starts)))
        start, stop = starts.flatten().to_numpy(), stops.flatten().to_numpy()
        yield from _parts(_windows_of(windows, rows, doc, start + windows.offset[doc], stop - WINDOW + 1 - start))


def _marked(opened: DataFrame, width: int) -> np.ndarray:
    """A bitmap of 2 ** width bits with the blocks (h1, first)."""
    cell = F.col("h1").bitwiseXOR(F.col("first")).bitwiseAND(F.lit((1 << width) - 1)) + 1
    cells = opened.select(cell.alias("cell"))
    pieces = cells.groupBy(F.bitmap_bucket_number("cell").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros(((1 << width) // PIECE, PIECE // 8), np.uint8)
    for r in pieces.toLocalIterator():  # at most 2 ** MOST_WIDTH bits
        bits[r.piece - 1] = np.frombuffer(r.bits, np.uint8)
    return np.packbits(np.unpackbits(bits.reshape(-1), bitorder="little"))


def repeated_spans(texts: DataFrame, most_width: int = MOST_WIDTH) -> DataFrame:
    """doc_id, row, start, stop from texts ``with_row``: runs of words (numbered from 0, stop excluded) to
    remove; they may overlap."""
    spark = texts.sparkSession
    texts = texts.where("doc_id is not null").select("doc_id", "text", "row")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch_width(size // BLOCK_BYTES + 1, most=most_width)
    sketch = spark.sparkContext.broadcast(repeated_anchors(texts, width))
    found = stored(
        texts.mapInArrow(_blocks(sketch, width), "doc_id long, row long, anchor long, h1 long, h2 long, start long, stop long"), "blocks"
    )
    block = stored(found.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("first")), "block-first")
    whole = found.join(block, ["anchor", "h1", "h2"]).where("first < doc_id").select("doc_id", "row", "start", "stop")
    several = block.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    opened = stored(block.join(several.select("anchor"), "anchor", "left_semi"), "open-blocks")
    count = opened.count()
    schema = "doc_id long, row long, h1 long, h2 long, start long"
    if count * LEAST_PER_OPEN <= 1 << most_width:
        open_width = sketch_width(count + 1, BITS_PER_OPEN, most_width)
        single = texts.mapInArrow(_open_windows(spark.sparkContext.broadcast(_marked(opened, open_width)), open_width), schema)
    else:
        speaking = found.join(opened, ["anchor", "h1", "h2"]).where("first = doc_id")
        lists = speaking.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("b"))
        lists = lists.select("doc_id", "row", F.col("b.start").alias("starts"), F.col("b.stop").alias("stops"))
        single = texts.dropDuplicates(["doc_id", "row"]).join(lists, ["doc_id", "row"]).mapInArrow(_listed_windows, schema)
    single = stored(single, "windows")
    earliest = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    parts = single.join(earliest, ["h1", "h2"]).where("first < doc_id")
    return whole.unionByName(parts.select("doc_id", "row", "start", (F.col("start") + WINDOW).alias("stop")))


def with_row(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as bytes, row."""
    rows, h = id_and_text(docs, *more), F.xxhash64("text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a < b")
    several = stored(several.select("doc_id", F.lit(True).alias("substring_several")), "several-texts")
    if several.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    return rows.join(several, "doc_id", "left").withColumn("row", F.when(F.col("substring_several"), h).otherwise(F.lit(0).cast("long"))).drop("substring_several")


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each of them."""
    found = [m.start() for m in WORD_BYTES.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : found[a]])
        at = found[b]
    return b"".join([*out, text[at:]])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts, the digest and the text that is left; other columns are passed on."""
    for rows, texts in slices(batches, most=2 << 20):
        n_words, n_removed, digest, left = [], [], [], []
        for text, starts, stops in zip(texts, rows.column("starts").to_pylist(), rows.column("stops").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            spans = _merged(starts or [], stops or [])
            for a, b in reversed(spans):
                del words[a:b]
            n_removed.append(n_words[-1] - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            left.append(_cut(text, spans) if spans else text)
        nulls = rows.column("text").is_null()
        text = pa.array([None if x.as_py() else t for x, t in zip(nulls, left, strict=True)], pa.binary())
        out = rows.select([c for c in rows.schema.names if c not in ("text", "starts", "stops")])
        for name, column in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("kept_sha256", pa.array(digest, pa.string())), ("left_text", text)):
            out = out.append_column(name, column)
        yield out


def without_repeats(docs: DataFrame, carry: tuple[str, ...] = (), most_width: int = MOST_WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and left_text (the text without the removed words), one row
    per row of ``docs``; columns named in ``carry`` are passed on."""
    texts = with_row(docs, *carry)
    spans = repeated_spans(texts, most_width).groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = texts.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "starts", "stops", *carry)
    more = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    out = joined.mapInArrow(_remove, f"doc_id long, {more}n_words long, n_removed long, kept_sha256 string, left_text binary")
    return out.withColumn("left_text", F.col("left_text").cast("string"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (SELECT doc_id, w, len(w) AS k FROM t), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(k - 48, 1))) AS i FROM n)
), first AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM first
), removed AS (SELECT doc_id, list(p) AS ps, count(*) AS r FROM gone GROUP BY doc_id), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM (
    SELECT n.doc_id, unnest(n.w) AS word, generate_subscripts(n.w, 1) AS p FROM n
  ) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT n.doc_id, n.k::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM n LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
