"""Incremental ingest that accounts for every record: kept once, and nothing given up for being late.

A watermark alone cannot do this: ``dropDuplicatesWithinWatermark`` forgets an id when the watermark passes
it, and throws away whatever comes later without saying so. Here the rows stored so far are themselves
the set of ids already seen, by day of the record's start:

- the first copy of a record is stored, further ones are counted as duplicates, in the same batch or any later
  one. Copies of a record name the same start, so only the days of a batch's own records are looked at;
- a record whose start is more than the overlap before the latest start of earlier batches is late. It is
  stored all the same, marked, and also listed in a table of its own, for whoever has already counted its hour;
- records without a readable start share one day, ``none``, and are looked up there for good;
- health checks and records without an id are not stored. They are counted, and health checks move the mark of
  lateness forward as other records do: a quiet period must not stop it.

Every batch writes under its own number, last of all the row with its counts. A batch that has no such
row yet does not exist for readers and for the batches after it, so one that failed half way and runs again changes
nothing. ``lines = blank + parse_errors + skipped + stored + duplicates`` holds for every batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from planewatch import constants as K
from planewatch.plans import derive
from planewatch.sources import archive as A

NO_DAY = "none"
COUNTS = "batch_id long, lines long, blank long, parse_errors long, skipped long, stored long, late long, duplicates long, latest timestamp"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def counts(spark: SparkSession, table: str) -> DataFrame:
    """One row per finished batch."""
    return _read(spark, f"{table}/counts", COUNTS)


def _finished(spark: SparkSession, table: str, batch_id: int) -> tuple[list[int], object]:
    rows = counts(spark, table).where(F.col("batch_id") < batch_id).agg(F.collect_set("batch_id").alias("ids"), F.max("latest").alias("latest")).first()
    return rows.ids, rows.latest


def records(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """Every record once, with ``late`` and the batch that brought it."""
    stored = _read(spark, f"{table}/records", f"{schema}, late boolean, batch_id long, event_date string")
    return stored.join(counts(spark, table).select("batch_id"), "batch_id", "left_semi")


def late_records(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The late ones among them, in a small table of their own."""
    stored = _read(spark, f"{table}/late", f"{schema}, batch_id long, event_date string")
    return stored.join(counts(spark, table).select("batch_id"), "batch_id", "left_semi")


def take_batch(batch: DataFrame, batch_id: int, dataset: str, table: str, columns: list[str], overlap: int = K.OVERLAP) -> dict[str, int]:
    """Store one batch of lines; returns its counts. ``columns`` are SQL expressions over the flat events."""
    spark = batch.sparkSession
    done, latest = _finished(spark, table, batch_id)
    staged = f"{table}/staged/batch_id={batch_id}"
    narrow = derive.classified(A.number_lines(batch), dataset).select(
        "ingest_seq", "kind", "document_id", F.coalesce("start_ts", "request_ts").alias("event_ts"), *(F.expr(c) for c in columns)
    )
    narrow.write.mode("overwrite").parquet(staged)  # decoded once, looked at several times
    rows = spark.read.schema(narrow.schema).parquet(staged)

    first = Window.partitionBy("document_id").orderBy("ingest_seq")
    fresh = rows.where(F.col("kind") == derive.EVENT).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    fresh = fresh.drop("_n", "kind", "ingest_seq").withColumn("event_date", F.coalesce(F.to_date("event_ts").cast("string"), F.lit(NO_DAY)))
    days = [r.event_date for r in fresh.select("event_date").distinct().collect()]  # one row per day
    seen = _read(spark, f"{table}/records", "document_id string, batch_id long, event_date string")
    seen = seen.where(F.col("event_date").isin(days) & F.col("batch_id").isin(done)).select("document_id")
    mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {overlap} SECONDS")
    new = fresh.join(seen, "document_id", "left_anti").withColumn("late", F.coalesce(F.col("event_ts") < mark, F.lit(False)))
    path = f"{table}/records/batch_id={batch_id}"
    new.write.mode("overwrite").partitionBy("event_date").parquet(path)
    stored = spark.read.schema(new.schema).parquet(path)
    stored.where("late").drop("late").write.mode("overwrite").partitionBy("event_date").parquet(f"{table}/late/batch_id={batch_id}")

    def of(*kinds: str):
        return F.count_if(F.col("kind").isin(*kinds))

    told = rows.agg(
        F.count("*").alias("lines"), of(derive.BLANK).alias("blank"), of(derive.BAD).alias("bad"), of(derive.HEALTH, derive.NO_ID).alias("skipped"),
        of(derive.EVENT).alias("events"), F.max("event_ts").alias("latest"),
    ).first()
    kept = stored.agg(F.count("*").alias("stored"), F.count_if("late").alias("late")).first()
    result = {
        "lines": told.lines, "blank": told.blank, "parse_errors": told.bad, "skipped": told.skipped, "stored": kept.stored, "late": kept.late,
        "duplicates": told.events - kept.stored,
    }
    row = spark.createDataFrame([(*result.values(), told.latest)], COUNTS.split(", ", 1)[1])
    row.coalesce(1).write.mode("overwrite").parquet(f"{table}/counts/batch_id={batch_id}")
    return result


def ingest(spark: SparkSession, path: str, dataset: str, table: str, checkpoint: str, columns: list[str],
           files_per_batch: int | None = None, growing: bool = False) -> None:
    """Take everything that is there, then stop. ``growing``: files may still be appended to."""
    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, dataset, table, columns)

    (
        A.stream_lines(spark, path, files_per_batch, growing).writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


__all__ = ["counts", "ingest", "late_records", "records", "take_batch"]
