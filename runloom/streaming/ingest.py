"""Log segments that keep arriving, and the tables of the runs they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import cut_lineage
from runloom.sources.bridges import Runs

#: Bits of a line number that count bytes inside a segment.
INSIDE = 40


def segments(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Lines of the segment files that arrive below ``folder``, with their file and split."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).format("text").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))


def numbered(batch: DataFrame, run: Callable[[Column], Column], segment: Callable[[Column], Column]) -> DataFrame:
    """(traj_id, line_no, line): lines in the order of their segment's number and place in it.

    A line's number is its segment's, then the split's first byte and how many lines of the split come before;
    a line has a byte at least, so numbers grow with the place.
    """
    rows = cut_lineage(batch.withColumn("at", F.monotonically_increasing_id()))
    first = rows.groupBy("path", "block").agg(F.min("at").alias("first"))
    rows = rows.join(first, ["path", "block"]).filter(F.trim("line") != "")
    number = F.shiftleft(segment(F.col("path")).cast("bigint"), INSIDE) + F.col("block") + F.col("at") - F.col("first")
    return rows.select(run(F.col("path")).cast("bigint").alias("traj_id"), number.alias("line_no"), "line")


def absorb(lines: DataFrame, batch_id: int, bronze: str, silver: str, convert: Callable[[DataFrame], Runs]) -> None:
    """Add a batch of lines to ``bronze`` and write the tables of the runs in it anew.

    Both are partitioned by run. A batch's lines have a partition of their own in each run, and a run's tables replace
    what was there, so a batch that is repeated leaves what it left before. Other runs are not read.
    """
    spark = lines.sparkSession
    rows = lines.withColumn("batch", F.lit(batch_id).cast("bigint"))
    overwrite = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    overwrite(rows.repartition("traj_id"), bronze, "traj_id", "batch")
    touched = cut_lineage(rows.select("traj_id").distinct())
    stored = spark.read.schema("line_no bigint, line string, traj_id bigint, batch bigint").parquet(bronze)
    whole = stored.join(touched, "traj_id", "left_semi").select("traj_id", "line_no", "line")
    runs = convert(whole)
    for name in ("steps", "calls", "parts"):
        table = getattr(runs, name)
        overwrite(table.repartition("traj_id", "slice"), f"{silver}/{name}", "traj_id")


def follow(stream: DataFrame, bronze: str, silver: str, convert: Callable[[DataFrame], Runs], run: Callable[[Column], Column], segment: Callable[[Column], Column], checkpoint: str):
    """A writer that absorbs every batch of ``segments``; start it with a trigger."""

    def each(batch: DataFrame, batch_id: int) -> None:
        absorb(numbered(batch, run, segment), batch_id, bronze, silver, convert)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
