"""Live views over steps and calls as they are appended: counters, failure rates, idle gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runloom.functions import calls as fc


def tail(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of a growing parquet folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def with_event_time(rows: DataFrame, column: str, late: str = "10 minutes") -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis(F.col(column))).withWatermark("ts", late)


def run_counters(calls: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls and failures per run and hour."""
    return calls.withColumn("bad", fc.failed()).groupBy(F.window("ts", width).alias("w"), "traj_id").agg(
        F.count("*").alias("calls"), F.count_if("bad").alias("failures")
    ).select("traj_id", F.col("w.start").alias("start"), "calls", "failures")


def failure_rate(calls: DataFrame, width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Failures per tool over sliding windows."""
    return calls.withColumn("bad", fc.failed()).groupBy(F.window("ts", width, slide).alias("w"), "tool_name").agg(
        F.count("*").alias("calls"), F.count_if("bad").alias("failures")
    ).select("tool_name", F.col("w.start").alias("start"), "calls", "failures")


def idle_sessions(rows: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Bursts of activity per run, ended by a quiet gap."""
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "traj_id").agg(F.count("*").alias("rows")).select(
        "traj_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows"
    )
