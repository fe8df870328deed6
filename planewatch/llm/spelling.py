"""Spelling variants: words one edit apart, grouped under their commonest form, by variable-length grams.

Words. Runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased; where 97 divides the crc32 of
``<doc_id>:<run>`` a code point is deleted. Tasks count their words before the shuffle. Every letter
is one byte of Latin-1, in which order and length are those of code points.

Gram dictionary. Words stand between two marks. All grams of two to ``LONGEST`` letters are counted: those
of two and three exactly, those of four in ``CELLS`` cells, a table of fixed size. A gram with more than
``often`` occurrences is pruned from the dictionary in favour of the longer ones that begin with it.

Decomposition. At every letter stands one gram: the shortest that is not pruned (or of ``LONGEST`` letters,
or ended by the mark). It follows from its own letters alone, so an edit affects only grams that
contain its place: per word at most ``bound``, the largest number of grams over one letter. Two words one
edit apart share all other grams, at the same distance from the start (before the edit) or from
the end (after it). So each has one of the shared grams among its ``bound + 1`` rarest: those are listed.

Lists. The rarest grams are listed by gram, distance and length, under one key for replaced letters and two
for the shorter and the longer word of an insertion. Lists are merged: words of one list with an
equal first or second half (one of them is untouched by any single edit) are compared exactly. Lists
of grams with more than ``most`` occurrences are divided by these halves before they are shuffled.

Forms. Each word's near word of largest n (then smallest) is its form if n is at least double. Forms at
least double at each step, so chains are short; roots come from joining the table of forms with
itself until nothing changes.

Defined cases: a null text has no words; a null doc_id reads as an empty one; rows that repeat a doc_id count
one by one; very long texts and words are worked on whole; ties go to the smaller word; an
empty table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import Powers, mix, stored, table

SHORTEST, RARE, EVERY = 5, 3, 97
LONGEST, CELLS = 4, 1 << 18
OFTEN, MOST, PAIRS = 500, 200_000, 1 << 20
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LETTERS = 92  # a-z, U+00C0 to U+00FF, the mark before a word and the one after it
BEFORE, AFTER = 90, 91
CODE = np.zeros(256, np.int64)
CODE[97:123] = np.arange(26)
CODE[192:256] = np.arange(26, 90)
EDGES = [0, LETTERS**2, LETTERS**2 + LETTERS**3, LETTERS**2 + LETTERS**3 + CELLS]
KEEP = 200_000


def _runs(text: bytes) -> Counter:
    if len(text) < 4 << 20:
        return Counter(RUN.findall(text))
    return Counter(m[0] for m in RUN.finditer(text))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of at least SHORTEST letters, in Latin-1, and how often this task met them."""
    counts: dict[bytes, int] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode().encode("latin-1") for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seed = zlib.crc32((doc_id or b"") + b":")
            for word, n in _runs((text or b"").lower()).items():  # bytes.lower() changes A-Z only
                h = zlib.crc32(word, seed)
                if h % EVERY == 0:
                    letters = word.decode()
                    at = h % len(letters)
                    word = (letters[:at] + letters[at + 1 :]).encode()
                if len(word) >= SHORTEST and len(word) - word.count(0xC3) >= SHORTEST:
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > KEEP:
                yield told()
                counts.clear()
    if counts:
        yield told()


def word_counts(docs: DataFrame, least: int = RARE) -> DataFrame:
    """w (Latin-1), n: the words counted at least ``least`` times."""
    texts = docs.select(F.col("doc_id").cast("string").cast("binary").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")


class _Marked:
    """Words one after the other, each between two marks, and the numbers of their grams of two to four letters."""

    def __init__(self, words: pa.Array) -> None:
        lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]).astype(np.int64)
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
        raw = np.frombuffer(words.buffers()[2], np.uint8)[first : first + lengths.sum()] if lengths.sum() else np.zeros(0, np.uint8)
        self.lengths = lengths
        self.start = np.r_[0, np.cumsum(lengths + 2)]
        self.codes = np.zeros(self.start[-1], np.int64)
        self.codes[self.start[:-1]] = BEFORE
        self.codes[self.start[1:] - 1] = AFTER
        self.word = np.repeat(np.arange(len(lengths)), lengths + 2)
        self.left = self.start[1:][self.word] - np.arange(len(self.codes))  # letters from here to the end
        place = np.arange(lengths.sum()) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1
        self.codes[place] = CODE[raw]
        c = np.r_[self.codes, 0, 0, 0]
        n = len(self.codes)
        self.grams = {}
        code = c[:n]
        for k in range(1, LONGEST):
            code = code * LETTERS + c[k : n + k]
            self.grams[k + 1] = code

    def cell(self, k: int) -> np.ndarray:
        """Where the count of each gram of k letters stands in the table."""
        code = self.grams[k]
        return EDGES[k - 2] + (code if k < 4 else (mix(code.astype(np.uint64)) >> np.uint64(64 - 18)).astype(np.int64))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(EDGES[-1], np.int64)
    for batch in batches:
        marked = _Marked(batch.column("w"))
        for k in range(2, LONGEST + 1):
            total += np.bincount(marked.cell(k)[marked.left >= k], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def gram_table(words: DataFrame) -> np.ndarray:
    """Counts of grams by cell; at most EDGES[-1] numbers, whatever the corpus."""
    cells = words.select("w").mapInArrow(_gram_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(EDGES[-1], np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out


def _mixed(*numbers) -> np.ndarray:
    out = np.uint64(0)
    for x in numbers:
        out = mix(np.asarray(x).astype(np.uint64) + out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return out


def _halves(powers: Powers, codes: np.ndarray, start: np.ndarray, length: np.ndarray, short: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first half and of the second, as the shorter of two words one edit apart divides: the
    longer one leaves out the letter between."""
    prefix = powers.prefix(mix(codes.astype(np.uint64) + np.uint64(1)))
    half = short // 2
    return [powers.runs(prefix, start, start + half), powers.runs(prefix, start + half + (length - short), start + length)]


def _lists(counts, often: int, most: int):
    """The lists each word is on: list (a hash of gram, distance and length), role (0 same length, 1 shorter, 2 longer), w, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, powers = counts.value, Powers(0xB5026F5AA96619E9)
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                marked = _Marked(batch.column("w"))
                p = np.flatnonzero(marked.left >= 2)
                word, left = marked.word[p], marked.left[p]
                size = np.full(len(p), 2)
                seen = held[marked.cell(2)[p]]
                code = marked.grams[2][p]
                for k in range(3, LONGEST + 1):  # pruned grams grow by a letter
                    grow = (size == k - 1) & (seen > often) & (left >= k)
                    size[grow] = k
                    seen[grow] = held[marked.cell(k)[p[grow]]]
                    code[grow] = marked.grams[k][p[grow]]
                over = np.zeros(len(marked.codes) + 1, np.int64)
                np.add.at(over, p, 1)
                np.add.at(over, p + size, -1)
                over = np.cumsum(over[:-1])
                over[marked.start[:-1]] = over[marked.start[1:] - 1] = 0
                bound = np.maximum.reduceat(over, marked.start[:-1])
                gram = size * LETTERS**LONGEST + code
                rank = np.minimum(seen, 1 << 32) * (1 << 30) + gram
                order = np.lexsort((rank, word))
                begin = np.searchsorted(word[order], np.arange(batch.num_rows))
                last = rank[order][np.minimum(begin + bound, np.searchsorted(word[order], np.arange(batch.num_rows), "right") - 1)]
                rare = rank <= last[word]  # all places of a listed gram
                word, gram, left, seen = word[rare], gram[rare], left[rare], seen[rare]
                length = marked.lengths[word]
                before = p[rare] - marked.start[word]
                first = marked.start[word] + 1
                for kind, distance, role, short in (
                    (0, before, 0, length), (1, before, 1, length), (2, left, 1, length), (1, before, 2, length - 1), (2, left, 2, length - 1),
                ):
                    name = _mixed(np.full(len(gram), kind), gram, distance, short)
                    hot = seen > most
                    first_half, second_half = _halves(powers, marked.codes, first, length, short)
                    names = [np.where(hot, _mixed(name, first_half), name), _mixed(name, second_half, np.ones(len(name)))[hot]]
                    rows = np.r_[word, word[hot]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(names).view(np.int64)), pa.array(np.full(len(rows), role, np.int8)), *(batch.column(c).take(pa.array(rows)) for c in ("w", "n"))],
                        ["list", "role", "w", "n"],
                    )

    return run


def _whole_lists(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows without cutting a list; rows arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            names = batch.column("list").to_numpy()
            cut = int(np.searchsorted(names != held[-1].column("list")[-1].as_py(), True))
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(run: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row number and how many rows after it belong to it: all such pairs, about PAIRS at a time."""
    done = np.r_[0, np.cumsum(many)]
    at = 0
    while at < len(run):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        n = many[at:stop]
        yield np.repeat(run[at:stop], n), np.arange(done[at], done[stop]) - np.repeat(done[at:stop], n)
        at = stop


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words of one list that are exactly one edit apart."""
    powers = Powers(0xB5026F5AA96619E9)
    for rows in _whole_lists(batches, 50_000):
        rows = rows.combine_chunks()
        words = rows.column("w").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        marked = _Marked(words)
        name, role, n = (rows.column(c).to_numpy() for c in ("list", "role", "n"))
        start, length = marked.start[:-1] + 1, marked.lengths
        found = []
        for same in (True, False):
            some = np.flatnonzero((role == 0) == same)
            if not len(some):
                continue
            short = length[some] - (role[some] == 2)
            for half in _halves(powers, marked.codes, start[some], length[some], short):
                key = _mixed(name[some].view(np.uint64), half, short)
                order = np.lexsort((role[some], key))
                key, row, kind = key[order], some[order], role[some][order]
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                stop = np.repeat(np.r_[edge[1:], len(key)], np.diff(np.r_[edge, len(key)]))
                place = np.arange(len(key))
                if same:
                    after = place + 1
                else:  # the longer words follow the shorter ones
                    turn = np.repeat(np.r_[edge[1:], len(key)] - np.add.reduceat((kind == 2).astype(np.int64), edge), np.diff(np.r_[edge, len(key)]))
                    after = np.where(kind == 1, turn, stop)
                for i, k in _pairs_of(place, stop - after):
                    j = after[i] + k
                    a, b = row[i], row[j]
                    able = length[b] - length[a] == (0 if same else 1)
                    a, b = a[able], b[able]
                    if not len(a):
                        continue
                    m = length[a]
                    inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    x = marked.codes[np.repeat(start[a], m) + inside]
                    y = marked.codes[np.repeat(start[b], m) + inside]
                    cuts = np.cumsum(m) - m
                    if same:
                        near = np.add.reduceat((x != y).astype(np.int64), cuts) == 1
                    else:
                        z = marked.codes[np.repeat(start[b], m) + inside + 1]
                        first = np.minimum.reduceat(np.where(x != y, inside, np.repeat(m, m)), cuts)
                        near = np.maximum.reduceat(np.where(x != z, inside, -1), cuts) < first
                    found.append(np.stack([a[near], b[near]]))
        if found:
            a, b = np.concatenate(found, axis=1)
            if len(a):
                out = pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n[a]), pa.array(n[b])], ["a", "b", "na", "nb"])
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]


def near_words(words: DataFrame, often: int = OFTEN, most: int = MOST) -> DataFrame:
    """a, b, na, nb: every pair of words one edit apart, once in each direction."""
    counts = words.sparkSession.sparkContext.broadcast(gram_table(words))
    lists = words.mapInArrow(_lists(counts, often, most), "list long, role byte, w binary, n long")
    pairs = lists.repartition("list").sortWithinPartitions("list").mapInArrow(_near, "a binary, b binary, na long, nb long")
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    one = stored(one.distinct(), "near")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))


def _roots(forms: DataFrame) -> DataFrame:
    """w, root of the words that have a form."""
    now = stored(forms.select("w", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("w").alias("root"), F.col("root").alias("further"))
        longer = stored(now.join(then, "root", "left").select("w", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            return longer.select("w", "root")
        now = longer.select("w", "root")


def spelling_variants(docs: DataFrame, often: int = OFTEN, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word counted often enough."""
    words = word_counts(docs)
    best = F.min(F.struct((-F.col("nb")).alias("nb"), F.col("b").alias("b")))
    near = near_words(words, often, most).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, F.col("w") == F.col("a"), "left")
    has = -F.col("best.nb") >= 2 * F.col("n")
    told = stored(
        joined.select("w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.b")).alias("form"), F.when(has, -F.col("best.nb")).alias("form_n")), "told"
    )
    rooted = told.join(_roots(told.where("form is not null")), "w", "left")
    text = {c: F.decode(c, "ISO-8859-1") for c in ("w", "form", "root")}
    return rooted.select(text["w"].alias("word"), text["form"].alias("form"), F.coalesce(text["root"], text["w"]).alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
