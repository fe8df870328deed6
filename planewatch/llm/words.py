"""Words of whole texts as numbers, for the operators that work on Arrow batches.

A word is a run of bytes other than the six ASCII white-space characters, which is what
``bytes.split()`` yields and what ``WORD`` matches. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder that all executors share and read back: later steps neither repeat the
    work nor depend on executors that may be lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``most`` bytes of text, so that numbers made from them stay small."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).to_pylist()]
        start = total = 0
        for i, text in enumerate(texts):
            if total and total + len(text) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += len(text)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; keeps those of short words, at most ``most`` of them."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, one text after the other, and where each text starts (and the last ends)."""
        parts, starts = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words)))
            starts[i + 1] = starts[i] + len(words)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), starts


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of runs by prefix sums."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(n - 1, self.base, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(n - 1, self.inverse, np.uint64)])

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.to(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.multiply(h, self.up[: len(h)], out=out[1:])
        np.cumsum(out[1:], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]
