"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that change results, or that the plans in this package rely on. Partition counts
# and memory belong to the cluster and are left alone.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing comes after shuffles of small rows and makes them many times larger. Merging such
    # shuffles up to the default of 1 MB would leave most cores idle; large ones are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # State of streams on disk and not on the heap, which the number of open ids would fill.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One store for a join's two sides and their indexes instead of four, each of which takes 4 MB of disk in every
    # partition from the start. A stream that goes on from a checkpoint keeps the format it has there.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def build_session(app_name: str = "planewatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the result-relevant settings on a session somebody else built."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files when they end, and not when the driver collects garbage. For a
    loop of jobs that each shuffle a part of the texts; a query made inside must not be run twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a folder on this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="planewatch-")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(base, f"planewatch-{label}-{uuid.uuid4().hex}")
