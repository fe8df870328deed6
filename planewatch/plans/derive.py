"""Archive lines to documents. Batch replay and streaming both go through these functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from planewatch import constants as K
from planewatch.functions.content import content_events, decode_content
from planewatch.functions.documents import content_documents, gateway_documents
from planewatch.functions.gateway import decode_gateway, gateway_events
from planewatch.operators.upsert import upsert_latest, upsert_stored
from planewatch.sources import archive as A


def decode(lines: DataFrame, dataset: str) -> DataFrame:
    return decode_content(lines) if dataset == K.CONTENT else decode_gateway(lines)


def events_from_decoded(decoded: DataFrame, dataset: str) -> DataFrame:
    good = A.good_lines(decoded)
    return content_events(good) if dataset == K.CONTENT else gateway_events(good)


def events_from_lines(lines: DataFrame, dataset: str) -> DataFrame:
    return events_from_decoded(decode(lines.filter(~A.is_blank(F.col("raw"))), dataset), dataset)


#: What a line can turn out to be; each line is exactly one of them.
EVENT, HEALTH, NO_ID, BAD, BLANK = "event", "health", "no_id", "bad", "blank"


def classified(lines: DataFrame, dataset: str) -> DataFrame:
    """Every line, decoded once: `kind`, for bad ones `reason` and `excerpt`, and the fields of its event.

    What is known of a line that has no record travels inside its place, past the functions that read records.
    """
    blank = A.is_blank(F.col("raw"))
    bad = ~blank & F.col("reason").isNotNull()
    place = F.struct(
        F.col("ingest_seq").alias("place"), F.when(blank, BLANK).when(bad, BAD).alias("kind"),
        F.when(bad, F.col("reason")).alias("reason"), F.when(bad, A.excerpt(F.col("raw"))).alias("excerpt"),
    )
    record = F.explode_outer(F.when(~blank & F.col("reason").isNull(), F.array("w")))
    rows = decode(lines, dataset).select(place.alias("ingest_seq"), record.alias("w"))
    events = content_events(rows) if dataset == K.CONTENT else gateway_events(rows)
    kind = F.coalesce(
        F.col("ingest_seq.kind"), F.when(F.col("is_health_check"), HEALTH), F.when(F.col("document_id").isNull(), NO_ID), F.lit(EVENT)
    )
    return events.select(
        F.col("ingest_seq.place").alias("ingest_seq"), kind.alias("kind"), F.col("ingest_seq.reason").alias("reason"),
        F.col("ingest_seq.excerpt").alias("excerpt"), *(c for c in events.columns if c != "ingest_seq"),
    )


class BackfillRun:
    """One pass over the archives, several outputs.

    Each archive is decoded once and its lines are written by what they are. Documents, quarantine, health
    checks and counters are then read from their own part: a reader of the quarantine opens the folder of bad
    lines only, and the counters read no text at all. A missing archive is skipped.
    """

    def __init__(self, spark: SparkSession, archives: dict[str, str | DataFrame], out: str, base_url: str = "") -> None:
        """``archives``: where each archive is, or its numbered lines."""
        self.spark, self.out, self.base_url = spark, out, base_url
        self.schemas: dict[str, T.StructType] = {}
        for dataset, given in archives.items():
            lines = given
            if isinstance(given, str):
                found = A.scan_lines_or_none(spark, given)
                lines = None if found is None else A.number_lines(found)
            if lines is not None:
                rows = classified(lines, dataset)
                A.write_few_parts(rows, f"{out}/dataset={dataset}", "kind")
                fields = [f for f in rows.schema.fields if f.name != "kind"]
                self.schemas[dataset] = T.StructType([*fields, T.StructField("kind", T.StringType())])
        if not self.schemas:
            raise ValueError(f"no archive found: {archives}")

    def rows(self, dataset: str, *kinds: str) -> DataFrame:
        found = self.spark.read.schema(self.schemas[dataset]).parquet(f"{self.out}/dataset={dataset}")
        return found.filter(F.col("kind").isin(*kinds)) if kinds else found

    def documents(self, dataset: str, skip_health: bool = True) -> DataFrame:
        kinds = (EVENT,) if skip_health else (EVENT, HEALTH)
        found = A.require_document_id(self.rows(dataset, *kinds)).drop("kind", "reason", "excerpt")
        return documents_of(upsert_stored(found, keys=("document_id",)), dataset, self.base_url)

    def all_documents(self, skip_health: bool = True) -> DataFrame:
        parts = {d: self.documents(d, skip_health) for d in self.schemas}
        return A.dataset_view(parts[K.CONTENT], parts[K.GATEWAY]) if len(parts) == 2 else next(iter(parts.values()))

    def quarantine(self, dataset: str) -> DataFrame:
        return self.rows(dataset, BAD).select(F.lit(dataset).alias("dataset"), "ingest_seq", "reason", "excerpt")

    def counters(self, dataset: str) -> DataFrame:
        """lines / parsed / parse_errors / skipped / queued, one row."""
        of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
        return self.rows(dataset).agg(
            F.count(F.lit(1)).alias("lines"), of(EVENT, HEALTH, NO_ID).alias("parsed"), of(BAD).alias("parse_errors"),
            of(HEALTH, NO_ID).alias("skipped"), of(EVENT).alias("queued"),
        ).select(F.lit(dataset).alias("dataset"), "*")


def documents_from_events(events: DataFrame, dataset: str, base_url: str = "",
                          skip_health: bool = True) -> DataFrame:
    kept = A.require_document_id(A.drop_health_checks(events, skip_health))
    return content_documents(kept, base_url) if dataset == K.CONTENT else gateway_documents(kept)


def documents_from_lines(lines: DataFrame, dataset: str, base_url: str = "",
                         skip_health: bool = True) -> DataFrame:
    return documents_from_events(events_from_lines(lines, dataset), dataset, base_url, skip_health)


def kept_events(lines: DataFrame, dataset: str, skip_health: bool = True) -> DataFrame:
    """Events that are fit to be stored, every version of them."""
    return A.require_document_id(A.drop_health_checks(events_from_lines(lines, dataset), skip_health))


def latest_events(lines: DataFrame, dataset: str, skip_health: bool = True,
                  bound: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events after the upsert. Deduplicating here, before documents are built, shuffles flat
    rows instead of nested ones. ``bound`` cuts the events before they are shuffled: a run that
    begins at some time fetches nothing older."""
    kept = kept_events(lines, dataset, skip_health)
    return upsert_latest(bound(kept) if bound else kept, keys=("document_id",))


def documents_of(latest: DataFrame, dataset: str, base_url: str = "") -> DataFrame:
    """Documents of events that are fit to be stored."""
    return content_documents(latest, base_url) if dataset == K.CONTENT else gateway_documents(latest)


def backfill(spark: SparkSession, archives: dict[str, str], base_url: str = "",
             skip_health: bool = True) -> DataFrame:
    """Every document again from the archives, each dataset on its own; a missing one is skipped."""
    derived: dict[str, DataFrame] = {}
    for dataset, path in archives.items():
        lines = A.scan_archive_or_none(spark, path)
        if lines is not None:
            derived[dataset] = documents_of(latest_events(lines, dataset, skip_health), dataset, base_url)
    if not derived:
        raise ValueError(f"no archive found: {archives}")
    if len(derived) == 2:
        return A.dataset_view(derived[K.CONTENT], derived[K.GATEWAY])
    return next(iter(derived.values()))
