"""Idempotent last-write-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WIDTH = 26  # the table of repeated keys has 2 ** WIDTH bits, 8 MB
BUCKET = 1 << 15  # bits of one row of it

def upsert_latest(documents: DataFrame, keys: tuple[str, ...] = ("dataset", "document_id"),
                  order: str = "ingest_seq") -> DataFrame:
    """The latest version of every document.

    A row number limited to 1 is cut down to one row per key inside each map task before the
    shuffle (a partial group limit), so a key that holds a large share of all rows stays small.
    """
    latest_first = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (
        documents.withColumn("_rank", F.row_number().over(latest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def marked(rows: DataFrame, held: DataFrame, keys: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """``rows`` with `_again`: true wherever the keys are among those of ``held``, and for few others.

    Every key of ``held`` sets one bit in a table of fixed size, so rows are told apart where they are, without a
    shuffle. A row whose bit another key has set is marked for nothing; callers must not mind.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << width))
    bucket = F.floor(place / BUCKET)
    set_ = held.select(bucket.alias("_bucket"), (place % BUCKET).alias("_place"))
    bits = set_.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_place div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(_place % 8 as int))")
    # At most 2 ** width bits, however many rows there are.
    found = rows.withColumns({"_bucket": bucket, "_place": place % BUCKET}).join(F.broadcast(bits), "_bucket", "left")
    return found.select(*rows.columns, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias("_again"))


def upsert_stored(rows: DataFrame, keys: tuple[str, ...] = ("dataset", "document_id"),
                  order: str = "ingest_seq", width: int = WIDTH) -> DataFrame:
    """The same over rows that are read from files, where most keys have one version: only rows whose key may be
    repeated go through the window, and the others, with all their text, are neither shuffled nor sorted.

    A first pass over the keys alone marks every key that has several rows. A row marked for nothing goes through
    the window too; it never changes the result.
    """
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = marked(rows, repeated, keys, width)
    once = found.filter(~F.col("_again")).drop("_again")
    return once.unionByName(upsert_latest(found.filter("_again").drop("_again"), keys, order))
