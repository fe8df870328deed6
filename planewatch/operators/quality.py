"""Data-quality checks on schemas, records and vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.operators.detections import trace_id, user_id, gateway_only


def schema_parity(content: T.StructType, gateway: T.StructType) -> list[str]:
    """What is wrong between the two schemas: one field with two types, or a shared field that
    only one of them has. A query over both would not fail on either, it would be wrong."""
    a, b = S.leaves(content), S.leaves(gateway)
    problems = [f"{f}: {a[f]} and {b[f]}" for f in sorted(a.keys() & b.keys()) if a[f] != b[f]]
    for field in S.SHARED_FIELDS:
        missing = {f for f in a.keys() ^ b.keys() if f.split(".")[0] == field}
        problems += [f"{f}: in one dataset only" for f in sorted(missing)]
    return problems


def declared_fields(made: T.StructType, declared: T.StructType) -> list[str]:
    """Leaves that are produced but not declared, or declared otherwise, and those never produced."""
    produced, known = S.leaves(made), S.leaves(declared)
    wrong = [f"{f}: {t}" for f, t in produced.items() if known.get(f) != t]
    return sorted(wrong + [f"{f}: never produced" for f in known.keys() - produced.keys()])


def field_census(content: DataFrame, gateway: DataFrame) -> DataFrame:
    """The parity check over stored data: per shared top-level field, the rows that have it in
    each dataset. One pass over each, reduced to a single row before the fields are listed."""
    def counts(docs: DataFrame, dataset: str) -> DataFrame:
        one = docs.agg(*[F.count(F.col(f)).alias(f) for f in S.SHARED_FIELDS])
        return one.unpivot([], S.SHARED_FIELDS, "field", "filled").withColumn("dataset", F.lit(dataset))

    return counts(content, K.CONTENT).unionByName(counts(gateway, K.GATEWAY)).select("field", "dataset", "filled")


def merged_traces(events: DataFrame) -> DataFrame:
    """Trace records that are several requests in one: the id is the session's, or more than one
    of the mutually exclusive scenario tags is present."""
    tags = F.size(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")),
                                    F.array(*[F.lit(s) for s in K.SCENARIOS]))).cast("bigint")
    as_session = F.coalesce(F.col("trace_id") == F.col("session_id"), F.lit(False))
    return events.select(
        "trace_id", as_session.alias("id_is_session"), tags.alias("scenario_tags")
    ).filter(F.col("id_is_session") | (F.col("scenario_tags") > 1))


def credential_scan(texts: DataFrame, key: str, text: str, allowed_hashes: list[str] | None = None) -> DataFrame:
    """Key hashes and unredacted secret tokens, token by token over the whole text: a redacted
    token next to a real one must not hide it. One row per find, no shuffle."""
    def tokens(kind: str, pattern: str, keep: Callable[[Column], Column]) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(F.filter(found, keep), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    allowed = list(allowed_hashes or [])
    found = F.concat(
        tokens("sha256_hash", K.HEX_DIGEST, lambda t: ~t.isin(allowed) if allowed else F.lit(True)),
        tokens("secret_token", K.SECRET_TOKEN, lambda t: ~t.rlike(K.REDACTED_TOKEN)),
    )
    return texts.select(F.col(key), F.explode(found).alias("f")).select(key, "f.kind", "f.token")


def provider_coverage(observed: DataFrame, exceptions: list[str], known: DataFrame | None = None) -> DataFrame:
    """Both differences between the providers there are and the decisions made about them.

    Providers are those seen in the records, ``observed``, and those that the gateway's release lists, ``known``
    (see ``archive.load_names``): one that no record has yet needs a decision before it has. Decisions are the
    mapped names and the exceptions, configuration in the code. ``undecided`` is a seen provider without a decision,
    ``undecided known`` one that is only listed; ``unseen ...`` is a decision about a provider that no record
    has, and ``unlisted ...`` one that is missing from the list as well, so probably misspelt or gone.

    Both columns ``provider`` may have any number of rows; they are cut to distinct names before anything else.
    """
    spark = observed.sparkSession
    decided = spark.createDataFrame(
        [(p, "mapped") for p in K.PROVIDER_SYSTEMS] + [(p, "exception") for p in exceptions],
        "provider string, decision string",
    )

    def names(df: DataFrame) -> DataFrame:
        return df.select(F.lower(F.trim("provider")).alias("provider")).filter(
            F.col("provider").isNotNull() & (F.col("provider") != "")
        ).distinct()

    def about(rows: DataFrame, problem: str) -> DataFrame:
        return rows.select("provider", F.concat(F.lit(problem), F.col("decision")).alias("problem"))

    seen = names(observed)
    gaps = seen.join(decided, "provider", "left_anti").select("provider", F.lit("undecided").alias("problem"))
    unseen = decided.join(seen, "provider", "left_anti")
    if known is None:
        return gaps.unionByName(about(unseen, "unseen "))
    listed = names(known)
    coming = listed.join(seen, "provider", "left_anti").join(decided, "provider", "left_anti")
    return (
        gaps.unionByName(coming.select("provider", F.lit("undecided known").alias("problem")))
        .unionByName(about(unseen.join(listed, "provider", "left_semi"), "unseen "))
        .unionByName(about(unseen.join(listed, "provider", "left_anti"), "unlisted "))
    )


def unknown_provider_audit(docs: DataFrame) -> DataFrame:
    """Documents without a provider by dataset and outcome. Refusals have none by nature; only
    successes are gaps in the table."""
    return docs.filter(F.col("gen_ai.system") == K.UNKNOWN_PROVIDER).groupBy(
        "dataset", F.col("event.outcome").alias("outcome")
    ).agg(
        F.count(F.lit(1)).alias("documents"),
        F.bool_or(F.col("event.outcome").eqNullSafe(K.SUCCESS)).alias("is_gap"),
    )


def join_key_fanout(docs: DataFrame, more_than: int) -> DataFrame:
    """Trace ids with unusually many attempts. A constant id joins everything and looks healthy.
    Attempts are combined before the shuffle, so that very id costs nothing extra here."""
    return (
        gateway_only(docs).filter(trace_id().isNotNull()).groupBy(trace_id().alias("trace_id"))
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct(user_id()).alias("distinct_users"))
        .filter(F.col("attempts") > more_than)
    )
