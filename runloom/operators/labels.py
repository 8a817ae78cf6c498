"""Step labels: validity against the taxonomy, and counts and durations per phase and action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels with ``valid``: the (phase, action) pair is in the taxonomy; of what size that is, Spark finds out."""
    known = taxonomy.select("phase", "action").distinct().withColumn("_ok", F.lit(True))
    return labels.join(known, ["phase", "action"], "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")


def _assistant(labels: DataFrame) -> DataFrame:
    return labels.filter("coalesce(role, 'assistant') = 'assistant'")


def label_summary(labels: DataFrame) -> DataFrame:
    unknown = F.count_if((F.col("phase") == "unknown") | (F.col("action") == "unknown"))
    rows = _assistant(labels).groupBy("traj_id").agg(F.count("*").alias("total"), unknown.alias("unknown"))
    return rows.select("traj_id", "total", (F.col("total") - F.col("unknown")).alias("classified"), "unknown", ((F.col("total") - F.col("unknown")) / F.col("total")).alias("rate"))


def label_distribution(labels: DataFrame) -> DataFrame:
    """Long form over both levels: count and seconds per phase, and per action with its first-seen phase."""
    rows = _assistant(labels).filter("phase <> 'unknown' and action <> 'unknown'").select(
        "traj_id", "step_idx", "duration_s", "phase",
        F.explode(F.array(F.struct(F.lit("phase").alias("level"), F.col("phase").alias("name")), F.struct(F.lit("action").alias("level"), F.col("action").alias("name")))).alias("_x"),
    )
    seconds = F.coalesce(F.sum(F.col("duration_s").cast("decimal(18,3)")).cast("double"), F.lit(0.0))
    return rows.groupBy("traj_id", "_x.level", "_x.name").agg(
        F.count("*").alias("steps"), seconds.alias("seconds"), F.min_by("phase", "step_idx").alias("phase")
    )


def label_timeline(labels: DataFrame) -> DataFrame:
    """Classified assistant steps and user turns."""
    user = F.col("role") == "user"
    known = (F.col("phase") != "unknown") & (F.col("action") != "unknown") & (F.coalesce("role", F.lit("assistant")) == "assistant")
    return labels.filter(user | known).select("traj_id", "step_idx", "role", "phase", "action", "duration_s")
