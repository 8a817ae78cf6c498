"""Files beside the run logs: label sidecars, manifests, patches, shards; and the report sink."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import cut_lineage

LABELS = (
    "taxonomy_version STRING, model STRING, trajectory_file STRING, steps ARRAY<STRUCT<index BIGINT, raw_index BIGINT, role STRING, "
    "phase STRING, action STRING, label_source STRING, duration_s DOUBLE>>"
)
MANIFEST = "task_id STRING, reference STRING, compared STRING, anchor STRING"


def parse_labels(docs: DataFrame) -> DataFrame:
    """(path, text) label files -> one row per step; files without steps or taxonomy version are left out."""
    rows = docs.select("path", F.from_json("text", LABELS).alias("d")).filter("d.steps is not null and d.taxonomy_version is not null")
    return rows.select("path", F.explode("d.steps").alias("s")).select("path", F.col("s.index").alias("step_idx"), "s.role", "s.phase", "s.action", "s.duration_s")


def parse_manifest(docs: DataFrame) -> DataFrame:
    """(path, text) manifests -> tasks; an entry without one of the three required fields gets an error."""
    rows = docs.select("path", F.posexplode(F.from_json("text", f"ARRAY<STRUCT<{MANIFEST}>>")).alias("pos", "m")).select("path", F.col("pos").cast("bigint").alias("pos"), "m.*")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in ("task_id", "reference", "compared")]))
    return rows.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))


def anchor_files(text: Column) -> Column:
    """Files a patch touches."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^[+-]{3}\s+[ab]/(.+)$"), F.lit(1)))


def diff_churn(docs: DataFrame) -> DataFrame:
    """Added, removed and context lines per file of a multi-file diff."""
    rows = docs.select("path", F.posexplode(F.filter(F.split("text", r"(?m)^(?=diff --git )"), lambda s: s.startswith("diff --git "))).alias("pos", "part"))
    name = F.regexp_extract("part", r"^diff --git a/(\S+) b/", 1)
    lines = rows.select("path", F.col("pos").cast("bigint").alias("file_no"), name.alias("file"), F.explode(F.split("part", "\n")).alias("l"))
    added = F.col("l").startswith("+") & ~F.col("l").startswith("+++")
    removed = F.col("l").startswith("-") & ~F.col("l").startswith("---")
    return lines.groupBy("path", "file_no", "file").agg(
        F.count_if(added).alias("additions"), F.count_if(removed).alias("deletions"), F.count_if(F.col("l").startswith("@@")).alias("hunks"), F.count_if(F.col("l").startswith(" ")).alias("context")
    )


def shard_gaps(names: DataFrame) -> DataFrame:
    """Shard files of a run (traj_id, file) with their number; how many are missing below the highest."""
    rows = names.withColumn("shard", F.regexp_extract("file", r"(\d+)(?:\.[^.]*)?$", 1).cast("bigint"))
    return rows.groupBy("traj_id").agg(
        F.count("*").alias("shards"), F.max("shard").alias("last"), (F.max("shard") + 1 - F.countDistinct("shard")).alias("missing")
    )


def session_tree(sessions: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Descendants of every root with their smallest depth, all of them unless ``max_depth`` is given.

    ``sessions``: session_id, parent_id. One join per level, written to shared storage; a session seen
    from its root before isn't followed again, so a cycle ends.
    """
    edges = sessions.filter("parent_id is not null").select("session_id", "parent_id").distinct()
    found = level = cut_lineage(sessions.filter("parent_id is null").select(F.col("session_id").alias("root"), "session_id", F.lit(0).cast("bigint").alias("depth")).distinct())
    depth = 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        step = level.select("root", F.col("session_id").alias("parent_id")).join(edges, "parent_id").select("root", "session_id").distinct()
        level = cut_lineage(step.join(found.select("root", "session_id"), ["root", "session_id"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        found = found.unionByName(level)
    return found


def commit_report(report: DataFrame, folder: str, name: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> bool:
    """Write ``report`` once under ``name`` below ``folder``; False where it was committed before.

    Rows go to a place of this attempt; the manifest entry that names it is written last and never replaced. An attempt that
    breaks off, or comes second, leaves rows that no entry names, so nobody reads them.
    """
    spark = report.sparkSession
    if _entries(spark, folder, name) is not None:
        return False
    attempt = uuid.uuid4().hex
    report.write.partitionBy(*by).format(kind).save(f"{folder}/rows/report={name}/attempt={attempt}")
    entry = spark.createDataFrame([(attempt, kind, report.schema.json())], "attempt string, kind string, schema string")
    try:
        entry.coalesce(1).write.mode("error").json(f"{folder}/manifest/report={name}")
    except AnalysisException:  # someone else was first
        return False
    return True


def _entries(spark: SparkSession, folder: str, name: str) -> Row | None:
    try:
        return spark.read.schema("attempt string, kind string, schema string").json(f"{folder}/manifest/report={name}").orderBy("attempt").first()
    except AnalysisException:
        return None


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The committed rows of the report ``name``."""
    entry = _entries(spark, folder, name)
    if entry is None:
        raise ValueError(f"no report {name} below {folder}")
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).format(entry["kind"]).load(f"{folder}/rows/report={name}/attempt={entry['attempt']}")
