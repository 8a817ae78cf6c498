"""Groups of runs of one task: scorecards, similarity matrix, coverage matrices.

``members``: group_id, traj_id, run_pos (0 is the baseline). Matrices come in long form, one row per
key and run; a pivot for display is one ``groupBy().pivot()`` away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import paths
from runloom.operators import filters, metrics as m
from runloom.operators.files import capability_usage

# Scorecard columns and whether lower is better.
RANKED = {
    "steps": True, "wall_clock": True, "total_tokens": True, "peak_occupancy": True, "compaction_count": True, "tool_success_rate": False,
}


def scorecard(members: DataFrame, steps: DataFrame, calls: DataFrame, pressure: DataFrame) -> DataFrame:
    """One row per run; a run without steps stays as an error row with nulls."""
    rows = members.join(m.scorecard(steps, calls), "traj_id", "left").join(filters.success(steps), "traj_id", "left")
    rows = rows.join(pressure.select("traj_id", "peak_occupancy", "peak_share", "compaction_count"), "traj_id", "left")
    return rows.withColumns(
        {"error": F.when(F.col("steps").isNull(), "run without steps"), "finished": F.coalesce("success", F.lit(False))}
    ).drop("success")


def best_worst(card: DataFrame) -> DataFrame:
    """Long form: runs holding the best or worst value of a column; none when all agree or only one has it."""
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(low).alias("low")) for c, low in RANKED.items() if c in card.columns])
    rows = card.filter("error is null").select("group_id", "traj_id", F.explode(values).alias("_v")).select("group_id", "traj_id", "_v.*").filter("value is not null")
    ends = rows.groupBy("group_id", "metric").agg(F.min("value").alias("_min"), F.max("value").alias("_max"), F.count("*").alias("_n"))
    rows = rows.join(ends.filter("_n >= 2 and _min < _max"), ["group_id", "metric"])
    least, most = F.col("value") == F.col("_min"), F.col("value") == F.col("_max")
    flag = F.when(F.when(F.col("low"), least).otherwise(most), "best").when(F.when(F.col("low"), most).otherwise(least), "worst")
    return rows.select("group_id", "traj_id", "metric", flag.alias("flag")).filter("flag is not null")


def run_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a group in run order; the pairs are the matrix asked for."""
    a = members.select("group_id", F.col("traj_id").alias("reference"), F.col("run_pos").alias("_a"))
    b = members.select("group_id", F.col("traj_id").alias("compared"), F.col("run_pos").alias("_b"))
    rows = a.join(b, "group_id").filter("_a < _b")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("group_id", "reference", "compared")])
    return rows.select(key.alias("group_key"), "group_id", "reference", "compared")


def baseline_pairs(members: DataFrame) -> DataFrame:
    """Every other run of a group against its baseline."""
    base = members.filter("run_pos = 0").select("group_id", F.col("traj_id").alias("reference"))
    rows = base.join(members.filter("run_pos > 0").select("group_id", F.col("traj_id").alias("compared")), "group_id")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("group_id", "reference", "compared")])
    return rows.select(key.alias("group_key"), "group_id", "reference", "compared")


def f1_matrix(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """Pairwise F1; two runs without actions are alike, one against none is not."""
    rows = pairs.join(similarity.select("group_key", "f1"), "group_key", "left")
    return rows.select("group_id", "reference", "compared", F.coalesce("f1", F.lit(1.0)).alias("f1"))


def _kind(runs: Column, size: Column) -> Column:
    least = F.greatest(F.lit(2), F.ceil(size / 2))
    return F.when(runs >= least, "consensus").when(runs == 1, "unique").otherwise("partial")


def coverage(cells: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """How many runs of the group have each key, and what that makes it. ``cells``: group_id, traj_id, keys."""
    size = members.groupBy("group_id").agg(F.count("*").alias("_size"))
    seen = cells.select("group_id", "traj_id", *keys).distinct().groupBy("group_id", *keys).agg(F.count("*").alias("n_runs"))
    return seen.join(size, "group_id").select("group_id", *keys, "n_runs", _kind(F.col("n_runs"), F.col("_size")).alias("kind"))


def action_cells(members: DataFrame, acts: DataFrame) -> DataFrame:
    """Non-file actions per run; every spawn counts as the same action."""
    spawn = F.col("action_type") == "AGENT_SPAWN"
    rows = acts.filter("action_type not in ('REASON', 'FILE_READ', 'FILE_WRITE')").withColumn("target", F.when(spawn, "*").otherwise(F.trim("target")))
    rows = rows.filter("target <> ''").groupBy("traj_id", "action_type", "target").agg(F.count("*").alias("count"))
    return rows.join(members.select("group_id", "traj_id"), "traj_id")


def file_cells(members: DataFrame, acts: DataFrame) -> DataFrame:
    """Reads and writes per run and file. A relative path joins the one absolute path of the group it ends."""
    rows = acts.filter("action_type in ('FILE_READ', 'FILE_WRITE') and target not in ('', '.')").groupBy("traj_id", "target").agg(
        F.count_if(F.col("action_type") == "FILE_READ").alias("reads"), F.count_if(F.col("action_type") == "FILE_WRITE").alias("writes")
    ).join(members.select("group_id", "traj_id"), "traj_id")
    known = rows.select("group_id", "target").distinct().withColumn("file", paths.basename(F.col("target")))
    rooted = known.filter("startswith(target, '/')").select("group_id", "file", F.col("target").alias("_abs"))
    loose = known.filter("not startswith(target, '/')")
    alias = loose.join(rooted, ["group_id", "file"]).filter(F.col("_abs").endswith(F.concat(F.lit("/"), F.col("target"))))
    alias = alias.groupBy("group_id", "target").agg(F.count("*").alias("_n"), F.min("_abs").alias("_to")).filter("_n = 1")
    rows = rows.join(alias.drop("_n"), ["group_id", "target"], "left").withColumn("path", F.coalesce("_to", "target"))
    return rows.groupBy("group_id", "traj_id", "path").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))


def capability_cells(members: DataFrame, calls: DataFrame) -> DataFrame:
    return capability_usage(calls).join(members.select("group_id", "traj_id"), "traj_id")


def distinct_ids(runs: DataFrame) -> DataFrame:
    """Run ids inside a group: the stem, then with format, then with model, then numbered.

    ``runs``: group_id, traj_id, run_pos, stem, format_label, model. A group is the handful of runs compared.
    """
    stem = Window.partitionBy("group_id", "stem")
    rows = runs.withColumn("_id", F.when(F.count("*").over(stem) > 1, F.concat_ws(" · ", "stem", "format_label")).otherwise(F.col("stem")))
    same = Window.partitionBy("group_id", "_id")
    model = F.when(F.col("model") != "", F.concat_ws(" · ", "_id", "model"))
    rows = rows.withColumn("_id2", F.when(F.count("*").over(same) > 1, F.coalesce(model, "_id")).otherwise(F.col("_id")))
    rank = F.row_number().over(Window.partitionBy("group_id", "_id2").orderBy("run_pos"))
    name = F.when(rank == 1, F.col("_id2")).otherwise(F.concat(F.col("_id2"), F.lit("-"), rank.cast("string")))
    return rows.withColumn("run_id", name).drop("_id", "_id2")


def folder_rollup(cells: DataFrame) -> DataFrame:
    """Reads, writes and files per folder; a file counts once for every folder above it."""
    # Home directory and drive prefixes left out of the tree.
    home = r"^(?:mnt/[^/]+/(?:Users|home)/[^/]+|(?:home|Users|mnt)/[^/]+)/(?=.)"
    named = F.filter(F.split("path", "/"), lambda part: ~part.isin("", "."))
    rows = cells.withColumn("_p", F.split(F.regexp_replace(F.array_join(named, "/"), home, ""), "/"))
    folders = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", F.lit(1), i), "/"))
    rows = rows.filter(F.size("_p") > 1).select("group_id", "path", "traj_id", "reads", "writes", F.explode(folders).alias("folder"))
    by_file = rows.groupBy("group_id", "folder", "path").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))
    return by_file.groupBy("group_id", "folder").agg(F.count("*").alias("files"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))


def _anchored(parts: Column) -> Column:
    """How many leading parts name a user's home or a drive. Their names."""
    size, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    return (
        F.when((size >= 3) & at(0).isin("home", "Users"), 2)
        .when((size >= 5) & (at(0) == "mnt") & at(2).isin("Users", "home"), 4)
        .when((size >= 3) & (at(0) == "mnt"), 2).otherwise(0)
    )


def folder_paths(cells: DataFrame) -> DataFrame:
    """``shown`` of every (group_id, path): its parts without the home prefix.

    A relative path goes below the one parent under which the group's anchored paths have its first folder; where there
    are several parents, or none, it stays as it is.
    """
    files = cells.select("group_id", "path").distinct()
    files = files.withColumn("_all", F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".")))
    files = files.withColumn("_home", _anchored(F.col("_all"))).withColumn("_rel", F.slice("_all", F.col("_home") + 1, F.greatest(F.lit(0), F.size("_all"))))
    above = F.transform(F.sequence(F.lit(1), F.size("_rel") - 1), lambda i: F.struct(F.get("_rel", i - 1).alias("folder"), F.slice("_rel", F.lit(1), i - 1).alias("parent")))
    known = files.filter("_home > 0 and size(_rel) > 1").select("group_id", F.explode(above).alias("x")).select("group_id", "x.*").distinct()
    single = known.groupBy("group_id", "folder").agg(F.count("*").alias("_n"), F.first("parent").alias("_parent")).filter("_n = 1").drop("_n")
    loose = F.when((F.col("_home") == 0) & (F.size("_rel") > 1), F.get("_rel", F.lit(0)))
    rows = files.withColumn("folder", loose).join(single, ["group_id", "folder"], "left")
    shown = F.when(F.size("_rel") == 0, F.slice("_all", -1, 1)).otherwise(F.concat(F.coalesce("_parent", F.array().cast("array<string>")), "_rel"))
    return rows.select("group_id", "path", F.when(F.size("_all") > 0, shown).otherwise(F.array("path")).alias("shown"))


def folder_tree(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Files, reads, writes and the mix of readers of every folder, at any level, of a group.

    Of a folder's files ``all_runs`` are read by all runs of the group (two at least), ``one_run`` by exactly one, ``other`` by
    some or none. A file counts once in every folder above it.
    """
    size = members.groupBy("group_id").agg(F.count("*").alias("_runs"))
    files = cells.groupBy("group_id", "path").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"), F.count_if(F.col("reads") > 0).alias("_readers"))
    rows = files.join(folder_paths(cells), ["group_id", "path"]).join(size, "group_id").filter(F.size("shown") > 1)
    folders = F.transform(F.sequence(F.lit(1), F.size("shown") - 1), lambda i: F.array_join(F.slice("shown", F.lit(1), i), "/"))
    shared = (F.col("_runs") >= 2) & (F.col("_readers") == F.col("_runs"))
    rows = rows.withColumns({"_shared": shared, "_one": ~shared & (F.col("_readers") == 1), "folder": F.explode(folders)})
    return rows.groupBy("group_id", "folder").agg(
        F.count("*").alias("files"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"),
        F.count_if("_shared").alias("all_runs"), F.count_if("_one").alias("one_run"), F.count_if(~F.col("_shared") & ~F.col("_one")).alias("other"),
    )


def folder_readers(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Of the files below a folder that one run alone reads, how many each run reads: group_id, folder, traj_id, files."""
    read = cells.filter("reads > 0").select("group_id", "path", "traj_id").distinct()
    alone = read.groupBy("group_id", "path").agg(F.count("*").alias("_n"), F.first("traj_id").alias("traj_id"))
    size = members.groupBy("group_id").agg(F.count("*").alias("_runs"))
    rows = alone.filter("_n = 1").join(size.filter("_runs >= 1"), "group_id").join(folder_paths(cells), ["group_id", "path"]).filter(F.size("shown") > 1)
    folders = F.transform(F.sequence(F.lit(1), F.size("shown") - 1), lambda i: F.array_join(F.slice("shown", F.lit(1), i), "/"))
    return rows.select("group_id", "traj_id", F.explode(folders).alias("folder")).groupBy("group_id", "folder", "traj_id").agg(F.count("*").alias("files"))
