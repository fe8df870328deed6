"""Continuous ingest of the archives: the batch transforms on a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.functions.documents import content_documents, gateway_documents
from planewatch.operators.upsert import upsert_latest
from planewatch.plans import derive
from planewatch.sources import archive as A

WATERMARK = f"{K.OVERLAP} seconds"


def stream_events(spark: SparkSession, path: str, dataset: str, files_per_batch: int | None = None, growing: bool = False) -> DataFrame:
    """Flat events as they arrive. A stream cannot number its rows; the place is file and block."""
    lines = A.stream_lines(spark, path, files_per_batch, growing).select(
        "raw", F.struct("at", "file", "block", F.lit(None).cast("bigint").alias("row")).alias("ingest_seq")
    )
    return A.require_document_id(A.drop_health_checks(derive.events_from_lines(lines, dataset)))


def stream_documents(spark: SparkSession, path: str, dataset: str, files_per_batch: int | None = None) -> DataFrame:
    """Documents with their start as top-level `event_ts` under the 5-minute watermark. Records
    without a start cannot be placed in a window; they are in the stored documents all the same."""
    found = stream_events(spark, path, dataset, files_per_batch)
    docs = content_documents(found) if dataset == K.CONTENT else gateway_documents(found)
    return (
        docs.withColumn("event_ts", F.col("event.start")).filter(F.col("event_ts").isNotNull())
        .withWatermark("event_ts", WATERMARK)
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """The first copy of every record within the overlap window. State is dropped with the
    watermark, as a record can only be fetched again inside that window."""
    placed = events.withColumn("event_ts", F.coalesce("start_ts", "request_ts"))
    return placed.withWatermark("event_ts", WATERMARK).dropDuplicatesWithinWatermark(["document_id"])


def run_to_end(stream: DataFrame, out: str, checkpoint: str, on_dropped: Callable[[int], None] | None = None) -> DataFrame:
    """Process what is there, then stop; returns what has been written. ``on_dropped`` is told how many rows
    came after the watermark had passed them, which no window or join of the stream has seen."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if on_dropped:
        on_dropped(dropped_rows(query))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators refused as too late, over the batches that Spark still
    reports (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in json.loads(p.json if isinstance(p.json, str) else p.json())["stateOperators"])


# ----------------------------------------------------------- idempotent sink

def _stored_schema(dataset: str) -> T.StructType:
    declared = S.CONTENT_DOCUMENT if dataset == K.CONTENT else S.GATEWAY_DOCUMENT
    return T.StructType(
        [f for f in declared.fields if f.name != "dataset"]
        + [T.StructField("dataset", T.StringType()), T.StructField("batch_id", T.LongType())]
    )


def write_batches(spark: SparkSession, path: str, dataset: str, table: str, checkpoint: str,
                  files_per_batch: int | None = None,
                  on_batch: Callable[[int, dict[str, int]], None] | None = None, growing: bool = False) -> None:
    """Every micro-batch goes to a folder of its own, named by its number and overwritten if the
    batch is run again after a failure. At-least-once delivery plus a repeatable write is what
    makes the table exact; nothing already stored is rewritten.

    The run's counters are observed while the documents are written and handed to ``on_batch``.
    Only a batch that has bad lines is read once more, for the quarantine table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counters = Observation()
        lines = A.number_lines(batch)
        decoded = derive.decode(lines, dataset)
        blank, bad = A.is_blank(F.col("raw")), F.col("reason").isNotNull()
        watched = decoded.observe(
            counters, F.count(F.lit(1)).alias("lines"), F.count_if(~blank & ~bad).alias("parsed"),
            F.count_if(~blank & bad).alias("parse_errors"),
        )
        docs = derive.documents_from_events(derive.events_from_decoded(watched, dataset), dataset)
        upsert_latest(docs).drop("dataset").write.mode("overwrite").parquet(
            f"{table}/dataset={dataset}/batch_id={batch_id}"
        )
        if counters.get["parse_errors"]:
            rejected = A.bad_lines(decoded.filter(~blank), dataset)
            rejected.drop("dataset").write.mode("overwrite").parquet(
                f"{table}-quarantine/dataset={dataset}/batch_id={batch_id}"
            )
        if on_batch:
            on_batch(batch_id, counters.get)

    (
        A.stream_lines(spark, path, files_per_batch, growing).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def quarantined(spark: SparkSession, table: str) -> DataFrame:
    """The rejected lines of all batches next to ``table``."""
    schema = T.StructType([f for f in S.QUARANTINE.fields if f.name != "dataset"] + [
        T.StructField("dataset", T.StringType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{table}-quarantine")


def latest_documents(spark: SparkSession, table: str, dataset: str) -> DataFrame:
    """What the batches add up to: the latest version of every document."""
    stored = spark.read.schema(_stored_schema(dataset)).option("basePath", table).parquet(f"{table}/dataset={dataset}")
    ordered = stored.withColumn("_order", F.struct("batch_id", "ingest_seq"))
    return upsert_latest(ordered, order="_order").drop("_order", "batch_id")


def compact(spark: SparkSession, table: str, dataset: str, out: str) -> None:
    """Rewrite the batches as a table by day, so that readers need no deduplication."""
    A.write_documents(latest_documents(spark, table, dataset), out)
