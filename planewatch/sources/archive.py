"""Archives in, documents out: scanning, rejecting, storing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.sources.tail import tail_lines


def is_blank(raw: Column) -> Column:
    # The white space of a regular expression, without making a Java string of every line.
    return F.ltrim(raw, F.lit(" \t\n\x0b\f\r")) == ""


# ------------------------------------------------------------------ scanning

def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of an archive, byte for byte, with the place it was read from."""
    return _with_place(spark.read.option("lineSep", "\n").text(path))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, growing: bool = False) -> DataFrame:
    """The same as a stream. Spark's checkpoint remembers which files were read or, in an archive
    whose files are still appended to, up to where."""
    if growing:
        return tail_lines(spark, path)
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _with_place(reader.format("text").load(path))


def _with_place(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """``(raw, ingest_seq)``. Rows keep their order inside a file block, so the task-local row
    number completes a total order without any shuffle. Batch data only; a stream calls this
    inside ``foreachBatch``."""
    return lines.select(
        "raw", F.struct("at", "file", "block", F.monotonically_increasing_id().alias("row")).alias("ingest_seq")
    )


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of one archive as ``(raw, ingest_seq)``."""
    return number_lines(scan_lines(spark, path)).filter(~is_blank(F.col("raw")))


def scan_lines_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A missing archive is skipped, not an error."""
    try:
        return scan_lines(spark, path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_archive_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    lines = scan_lines_or_none(spark, path)
    return None if lines is None else number_lines(lines).filter(~is_blank(F.col("raw")))


# ----------------------------------------------------------------- rejecting

def excerpt(raw: Column, limit: int = K.EXCERPT_BYTES) -> Column:
    """At most ``limit`` bytes of a bad line, enough to recognise it."""
    head = F.make_valid_utf8(F.substring(raw.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(raw) > limit, F.concat(head, F.lit("..."))).otherwise(raw)


def good_lines(decoded: DataFrame) -> DataFrame:
    """Lines that can be used.

    Kept by exploding a list of one or none, not by a filter: Spark pushes a filter below the
    projection that parses the line and would parse every line again, once per use in the
    condition. A generator stays where it is.
    """
    kept = F.when(F.col("reason").isNull(), F.array("w"))
    return decoded.select("ingest_seq", F.explode(kept).alias("w"))


def bad_lines(decoded: DataFrame, dataset: str) -> DataFrame:
    """Lines that could not be used, for the quarantine table."""
    rejected = F.when(F.col("reason").isNotNull(), F.array(
        F.struct("reason", excerpt(F.col("raw")).alias("excerpt"))
    ))
    return decoded.select(F.lit(dataset).alias("dataset"), "ingest_seq", F.inline(rejected))


def require_document_id(events: DataFrame) -> DataFrame:
    """An invented id would make every replay a new document."""
    return events.filter(F.col("document_id").isNotNull())


def drop_health_checks(events: DataFrame, enabled: bool = True) -> DataFrame:
    return events.filter(~F.col("is_health_check")) if enabled else events


def initial_bound(
    events: DataFrame,
    dataset: str,
    now: datetime,
    start: datetime | None = None,
    stored: datetime | None = None,
    time_column: str = "request_ts",
) -> DataFrame:
    """Where a run begins: a stored cutoff wins, then ``start``, then a day back for the gateway
    and no bound at all for content. ``now`` is handed in so that a run can be repeated."""
    bound = stored or start
    if bound is None and dataset == K.GATEWAY:
        bound = now - timedelta(seconds=K.GATEWAY_LOOK_BACK)
    return events if bound is None else events.filter(F.col(time_column) >= F.lit(bound))


def ingest_counters(all_lines: DataFrame, events: DataFrame, dataset: str) -> DataFrame:
    """lines / parsed / parse_errors / skipped / queued of one run, one row.

    ``all_lines`` are decoded lines, blank ones included; ``events`` the events of the good ones.
    Both sides are reduced to one row before they meet.
    """
    zero = F.lit(0).cast("bigint")
    blank = is_blank(F.col("raw"))
    lines = all_lines.select(
        F.lit(1).cast("bigint").alias("lines"),
        F.when(~blank & F.col("reason").isNull(), 1).otherwise(0).cast("bigint").alias("parsed"),
        F.when(~blank & F.col("reason").isNotNull(), 1).otherwise(0).cast("bigint").alias("parse_errors"),
        zero.alias("skipped"),
        zero.alias("queued"),
    )
    skip = F.col("is_health_check") | F.col("document_id").isNull()
    outcome = events.select(
        zero.alias("lines"), zero.alias("parsed"), zero.alias("parse_errors"),
        skip.cast("bigint").alias("skipped"), (~skip).cast("bigint").alias("queued"),
    )
    names = ["lines", "parsed", "parse_errors", "skipped", "queued"]
    return lines.unionByName(outcome).agg(
        *[F.coalesce(F.sum(n), zero).alias(n) for n in names]
    ).select(F.lit(dataset).alias("dataset"), *names)


# ------------------------------------------------------------------- storing

def dataset_view(content: DataFrame, gateway: DataFrame) -> DataFrame:
    """One query surface over both datasets; fields only one of them has are NULL in the other."""
    return content.unionByName(gateway, allowMissingColumns=True)


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite", rebalance: bool = True) -> None:
    """Parquet by dataset and day. The rebalance lets a heavy day be split over many tasks and
    light days share one, so neither giant tasks nor floods of small files come out. Without it
    every task writes its part of each day: more files, but the texts are not shuffled."""
    if rebalance:
        documents = documents.hint("rebalance", F.col("dataset"), F.col("event_date"))
    documents.write.mode(mode).option("compression", "zstd").partitionBy("dataset", "event_date").parquet(path)


def write_few_parts(rows: DataFrame, path: str, column: str, most: int = 8) -> None:
    """Parquet by a column of at most ``most`` values. A task holds a file open for each of them; otherwise Spark sorts
    all of its rows, texts included, by that column first."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(most))
    try:
        rows.write.option("compression", "zstd").partitionBy(column).parquet(path)
    finally:
        conf.set(name, before)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents under the full schema of both datasets."""
    schema = dataset_view(
        spark.createDataFrame([], S.CONTENT_DOCUMENT), spark.createDataFrame([], S.GATEWAY_DOCUMENT)
    ).schema
    return spark.read.schema(schema).parquet(path)


def load_baseline(spark: SparkSession, path: str | None, one_document: bool = True) -> DataFrame:
    """Trace ids that are known never to match, from one JSON document or from one per line. No
    file means none are expected."""
    empty = spark.createDataFrame([], "trace_id string")
    if not path:
        return empty
    try:
        found = spark.read.schema(S.BASELINE).option("multiLine", one_document).json(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return found.select(F.explode("trace_ids").alias("trace_id")).distinct()


def load_names(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A list of names, one per line; blank lines and lines that begin with # are left out."""
    names = spark.read.text(path).select(F.trim("value").alias(column))
    return names.filter((F.col(column) != "") & ~F.col(column).startswith("#")).distinct()
