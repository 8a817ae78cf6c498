"""Issues of a run: what the detectors found, in one table, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators import hotspots as h, sequence as s

# Order of severities.
RANK = {"error": 0, "antipattern": 1, "bottleneck": 2}


def _issue(rows: DataFrame, kind: str, severity: str | Column, step: str, title: Column) -> DataFrame:
    return rows.select("traj_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(step).alias("step_idx"), title.alias("title"))


def issues(steps: DataFrame, calls: DataFrame, premature: DataFrame | None = None) -> DataFrame:
    """One row per issue. Failures of harness tools are antipatterns, from five on called frequent."""
    clusters = s.error_clusters(calls)
    system = F.col("error_class") == "system"
    often = F.when(system & (F.col("count") >= 5), "Frequent system errors: ").when(system, "System error: ").otherwise("")
    failures = _issue(clusters, "failure_pattern", F.when(system, "antipattern").otherwise("error"), "first_step", F.concat(often, F.format_string("%s: %s (%dx)", "tool", "pattern", "count")))
    found = [
        failures,
        _issue(s.failure_chains(steps, calls).filter("length >= 2"), "cascade", "error", "start", F.format_string("%d failing steps in a row", "length")),
        _issue(s.fruitless_streaks(steps, calls), "fruitless", "antipattern", "start_step", F.format_string("%d fruitless search steps in a row", "length")),
        _issue(s.shell_reads(calls), "shell_read", "antipattern", "step_idx", F.concat(F.lit("shell used to read: "), "command")),
        _issue(s.edit_thrash(calls), "edit_thrash", "antipattern", "start_step", F.format_string("%d edits of %s, %d failed", "count", "path", "fail_count")),
        _issue(s.repeated_searches(calls), "repeated_search", "antipattern", "first_step", F.format_string("search repeated %dx: %s", "count", "display")),
        _issue(s.plan_items(s.plan_history(calls)).filter("stalled"), "stalled_item", "antipattern", "seen_step", F.concat(F.lit("stalled plan item: "), "content")),
        _issue(h.bottlenecks(steps, calls), "bottleneck", "bottleneck", "step_idx", F.col("title")),
    ]
    if premature is not None:
        found.append(_issue(premature, "premature_compaction", "antipattern", "step_idx", F.col("reason")))
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return reduce(DataFrame.unionByName, found).withColumn("severity_rank", rank[F.col("severity")])


def issue_kpi(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Issues per run and severity with the overall status; a run of ``runs`` without issues is good."""
    n = F.count("severity")
    return runs.select("traj_id").distinct().join(found, "traj_id", "left").groupBy("traj_id").agg(
        n.alias("issues"), *[F.count_if(F.col("severity") == k).alias(f"{k}s") for k in RANK],
        F.when(n == 0, "good").when(n < 3, "warn").otherwise("bad").alias("status"),
    )
