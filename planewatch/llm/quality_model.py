"""Document quality from random-indexing word vectors and a two-layer network.

1. Words are maximal runs of one class of characters (small letters, capitals, digits, single kinds of
   symbols, line ends), hashed into ``BUCKETS`` words. Every bucket has a fixed sparse random index
   vector; its word vector is the sum of the index vectors of the words up to two places away, over
   all documents. Tasks add up their own part, the parts are merged by ranges of buckets, and the
   result has a fixed size (``BUCKETS * DIMENSIONS`` numbers) whatever the corpus.
2. A document is the mean and the spread of the unit word vectors of its words, and the logarithm of
   their number.
3. A two-layer network is trained in numpy on at most ``MOST_LABELS`` labelled documents, chosen by a
   hash of the id and never from the held-out fold. A fifth of them is kept apart from the weights,
   chooses the training step to keep, and fits the temperature that calibrates the probabilities.

Defined cases: a null or empty text has the zero vector and the score of that; a null doc_id is scored,
held_out null becomes false and it is never trained on; labels that are null are left out, of several
labels for one id the smallest counts; without usable labels of both kinds every score is the share
of label 1 (0.5 without labels); a very long text is pooled as a whole, in memory that grows with its words;
equal texts have equal scores; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import Powers, id_and_text, mix, slices, stored, table

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 32, 4, 2
MOST_LABELS, HIDDEN, FOLDS, CUT = 20_000, 24, 5, 0.3
RANGE = 256  # buckets of one merged row
KINDS = np.full(256, 4, np.int64)  # other bytes, also those of letters beyond ASCII, count as small letters
KINDS[[32, 9, 11, 12, 13]] = 0
KINDS[10] = 1
KINDS[ord("0") : ord("9") + 1] = 2
KINDS[ord("A") : ord("Z") + 1] = 3
for _place, _byte in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    KINDS[_byte] = 5 + _place


def index_vectors() -> np.ndarray:
    draw = np.random.default_rng(5)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = np.argsort(draw.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, draw.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


class _Buckets:
    """Word buckets of texts, one text after the other, and where each text starts."""

    def __init__(self) -> None:
        self.powers, self.letters = Powers(0xB5026F5AA96619E9), mix(np.arange(1, 257, dtype=np.uint64))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        kind = KINDS[raw]
        new = np.r_[True, kind[1:] != kind[:-1]]
        new[ends[:-1][ends[:-1] < len(raw)]] = True
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], len(raw)]
        some = kind[start] > 0
        start, stop = start[some], stop[some]
        h = mix(self.powers.runs(self.powers.prefix(self.letters[raw]), start, stop))
        return (h >> np.uint64(64 - 14)).astype(np.int64), np.r_[0, np.searchsorted(start, ends)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of index vectors of neighbours, as ranges of buckets."""
    buckets, index = _Buckets(), index_vectors()
    places = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(index, places, axis=1).astype(np.float64)
    total = np.zeros(BUCKETS * DIMENSIONS)
    seen = np.zeros(BUCKETS, bool)
    for _, texts in slices(batches):
        b, starts = buckets.of(texts)
        seen[b] = True
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        pairs: dict[int, np.ndarray] = {}
        for reach in range(1, REACH + 1):
            same = doc[reach:] == doc[:-reach]
            pairs[reach] = b[:-reach][same] * BUCKETS + b[reach:][same]
        both, n = np.unique(np.concatenate(list(pairs.values())), return_counts=True)
        for word, other in ((both // BUCKETS, both % BUCKETS), (both % BUCKETS, both // BUCKETS)):
            for k in range(NONZERO):
                total += np.bincount(word * DIMENSIONS + places[other, k], signs[other, k] * n, minlength=len(total))
    for first in range(0, BUCKETS, RANGE):
        if seen[first : first + RANGE].any():
            rows = total[first * DIMENSIONS : (first + RANGE) * DIMENSIONS]
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([rows.astype(np.int32 if np.abs(rows).max() < 2**31 else np.int64).tobytes()], pa.binary())], ["first", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each range; they arrive sorted by it."""
    at, total = None, None
    for batch in batches:
        for first, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = np.frombuffer(sums, np.int32 if len(sums) == 4 * RANGE * DIMENSIONS else np.int64).astype(np.int64)
            if first == at:
                total = total + rows
            else:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["first", "sums"])
                at, total = first, rows
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["first", "sums"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets, learnt from all texts; BUCKETS x DIMENSIONS, whatever the corpus."""
    parts = texts.mapInArrow(_count, "first long, sums binary")
    merged = parts.repartition("first").sortWithinPartitions("first").mapInArrow(_add, "first long, sums binary")
    out = np.zeros((BUCKETS, DIMENSIONS))
    for r in merged.collect():
        out[r.first : r.first + RANGE] = np.frombuffer(r.sums, np.int64).reshape(RANGE, DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean, spread and log length per document."""
    n, m = len(starts) - 1, np.diff(starts)
    out = np.zeros((n, 2 * DIMENSIONS + 1), np.float32)
    some = m > 0
    if some.any():
        at, size = starts[:-1][some], m[some][:, None]
        for d in range(DIMENSIONS):
            x = vectors[b, d].astype(np.float64)
            mean = np.add.reduceat(x, at)[:, None] / size
            square = np.add.reduceat(x * x, at)[:, None] / size
            out[some, d] = mean[:, 0]
            out[some, DIMENSIONS + d] = np.sqrt(np.maximum(square - mean * mean, 0))[:, 0]
    out[:, -1] = np.log1p(m) / 8
    return out


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for rows, texts in slices(batches):
            x = pooled(shared.value, *buckets.of(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "pooled"])

    return run


class Network:
    """Two layers: standardised input, tanh, one logit; the temperature divides it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, seed: int = 3, steps: int = 1500) -> None:
        draw = np.random.default_rng(seed)
        self.middle, self.scale = x[~apart].mean(0), x[~apart].std(0) + 1e-3
        z = self._standard(x)
        zt, yt, zv, yv = z[~apart], y[~apart], z[apart], y[apart]
        p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        best, self.weights = np.inf, [q.copy() for q in p]
        for step in range(1, steps + 1):
            some = draw.integers(0, len(zt), min(512, len(zt)))
            a = np.tanh(zt[some] @ p[0] + p[1])
            error = (_sigmoid(a @ p[2] + p[3]) - yt[some]) / len(some)
            back = np.outer(error, p[2]) * (1 - a * a)
            grads = [zt[some].T @ back + 1e-4 * p[0], back.sum(0), a.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            for q, g, mq, vq in zip(p, grads, m, v, strict=True):
                mq += 0.1 * (g - mq)
                vq += 0.001 * (g * g - vq)
                q -= 0.005 * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.999**step)) + 1e-8)
            if step % 25 == 0 or step == steps:
                loss = _loss(np.tanh(zv @ p[0] + p[1]) @ p[2] + p[3], yv)
                if loss < best:
                    best, self.weights = loss, [q.copy() for q in p]
        logit = self._logit(zv)
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        self.temperature = float(heats[int(np.argmin([_loss(logit / h, yv) for h in heats]))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.middle) / self.scale

    def _logit(self, z: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.einsum("ij,j->i", np.tanh(np.einsum("ij,jk->ik", z, w[0]) + w[1]), w[2]) + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(self._standard(x)) / self.temperature)


class Constant:
    """The score when there is nothing to learn from."""

    def __init__(self, share: float) -> None:
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("pooled").flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x).astype(np.float64))], ["doc_id", "score"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``; labels: doc_id, quality."""
    context = docs.sparkSession.sparkContext
    texts = id_and_text(docs)
    vectors = context.broadcast(word_vectors(texts))
    features = stored(texts.mapInArrow(_pool(vectors), "doc_id long, pooled array<float>"), "pooled")
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = features.join(usable, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    known = known.select("doc_id", "pooled", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("apart")).toPandas()
    y, apart = known.quality.to_numpy(float), known.apart.to_numpy(bool)
    if min(len(set(y[apart])), len(set(y[~apart]))) == 2:
        model = Network(np.stack(known.pooled.to_list()), y, apart)
    else:
        model = Constant(float(y.mean()) if len(y) else 0.5)
    scored = features.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
