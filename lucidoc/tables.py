"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
#: Joins may keep rows in the partitions of a part of their key, shuffle files go as soon as the table is written, and nothing is sent
#: to the driver and broadcast because its files look small: packed ids and rows yet to be exploded are many times as large there.
WITHIN = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    # What listeners are told of a plan, in full each time a stage of it ends, is half a megabyte for the largest.
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.maxPlanStringLength": "20000",
}


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; it goes when the application ends.

    Where the setting is missing, a session on one machine uses its temporary folder; a cluster has none that all see.
    """
    base = spark.conf.get(CHECKPOINTS, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINTS} to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/lucidoc-checkpoints"
    path = f"{base.rstrip('/')}/lucidoc-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold inside; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_within(df: DataFrame, folder: str, name: str) -> DataFrame:
    """As stored(), for plans whose steps stay in a document: rows dealt out by it, with repartition(), aren't dealt anew for its pages, blocks and lines.
    Only what has a hint is broadcast, and the driver's heap shrinks to what is in use afterwards."""
    with _set(df.sparkSession, WITHIN):
        out = stored(df, folder, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a Parquet table, which cuts lineage, keeps later plans small and outlives executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes tables that nothing reads any more; a missing one is no error."""
    for name in names:
        where, files = _place(spark, f"{folder}/{name}")
        files.delete(where, True)
