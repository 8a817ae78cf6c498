"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, name: str = "runloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Test tables are a few megabytes; keep their shuffles spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Times are epoch milliseconds, so the session must read timestamps as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned and run inside; afterwards they are as before."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def measured(spark: SparkSession) -> AbstractContextManager[None]:
    """What is planned inside broadcasts a table by the rows it turns out to have, not by the size of its files.

    Cut tables are small as files: one below the threshold may be fifty times as large in the driver's memory.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return settings(spark, {"spark.sql.adaptive.autoBroadcastJoinThreshold": spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or limit, "spark.sql.autoBroadcastJoinThreshold": "-1"})


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-process session without one (a test) gets its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="runloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: A table of long texts is written in groups of few megabytes, looked at every few rows. A reader decodes up to
#: 4096 rows of a group at once, which of whole exports would be more than a task has.
WIDE = {"parquet.block.size": str(2 << 20), "parquet.page.size.row.check.min": "8", "parquet.page.size.row.check.max": "64"}


def cut_lineage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared one as columns, and read it back from there.

    Readers then decode the columns they use alone. ``wide``: a row may hold a whole file. What columns can't hold (untyped
    nulls, intervals, names that differ in case alone) is checkpointed row by row.
    """
    spark = df.sparkSession
    names, kinds = {name.lower() for name in df.columns}, df.schema.simpleString()
    if len(names) == len(df.columns) and "void" not in kinds and "interval" not in kinds:
        path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.options(**(WIDE if wide else {})).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
