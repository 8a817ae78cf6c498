"""Many pair reports at once: statistics, pattern frequency, before/after comparison."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.hotspots import moments
from runloom.operators.slices import nearest_rank

# Metrics of a pair report and whether a higher value is better.
DIRECTIONS = {
    "recall": True, "precision": True, "f1": True, "overhead": False, "harmful_ratio": False,
    "anchor_write_precision_ref": True, "anchor_write_precision_cmp": True, "anchor_write_recall_ref": True,
    "anchor_write_recall_cmp": True, "off_patch_write_ratio_ref": False, "off_patch_write_ratio_cmp": False,
}
DEAD_BAND = 0.01


def long_metrics(reports: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """One row per report and metric it has; reports with an ``error`` are left out."""
    rows = reports.filter("error is null") if "error" in reports.columns else reports
    have = [m for m in DIRECTIONS if m in reports.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in have])
    return rows.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.value").filter("value is not null")


def batch_stats(metrics: DataFrame) -> DataFrame:
    """Count, mean, median, p5, p95, min, max, deviation and variation per metric."""
    ranks = nearest_rank(metrics, ["metric"], F.col("value"), {"p5": 0.05, "p95": 0.95, "min": 0.0, "max": 1.0}, "median")
    basic = moments(metrics, ["metric"], F.col("value"), decimals=9).withColumnsRenamed({"n": "count", "sd": "stdev"})
    cv = F.when(F.col("mean") != 0, F.col("stdev") / F.abs("mean"))
    return basic.join(ranks, "metric").withColumn("variation", cv)


def pattern_frequency(tasks: DataFrame, patterns: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """Tasks showing each pattern type, and whether that makes it a supported finding."""
    whole = tasks.agg(F.count("*").alias("_n"))
    seen = patterns.select("task_id", "type").distinct().groupBy("type").agg(F.count("*").alias("tasks"))
    rows = seen.join(F.broadcast(whole)).withColumn("prevalence", F.col("tasks") / F.col("_n")).drop("_n")
    level = F.when((F.col("tasks") >= least) & (F.col("prevalence") >= share), "supported_finding").otherwise("single_pair_hypothesis")
    return rows.withColumn("evidence_level", level)


def pair_tasks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tasks of either batch with the side they occur on."""
    a = before.select("task_id").distinct().withColumn("_b", F.lit(1))
    b = after.select("task_id").distinct().withColumn("_a", F.lit(1))
    side = F.when(F.col("_b").isNull(), "after_only").when(F.col("_a").isNull(), "before_only").otherwise("paired")
    return a.join(b, "task_id", "full").select("task_id", side.alias("side"))


def _direction(delta: Column, higher: Column) -> Column:
    good = F.when(higher, delta).otherwise(-delta)
    return F.when(good > DEAD_BAND, "improved").when(good < -DEAD_BAND, "regressed").otherwise("unchanged")


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Means of both batches over the tasks that have the metric on both sides, with a sign test."""
    b = before.select("task_id", "metric", F.col("value").alias("b"))
    both = b.join(after.select("task_id", "metric", F.col("value").alias("a")), ["task_id", "metric"])
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,12)")).cast("double")
    sums = both.groupBy("metric").agg(
        F.count("*").alias("n"), (exact("b") / F.count("*")).alias("before_mean"), (exact("a") / F.count("*")).alias("after_mean"),
        F.count_if(F.col("a") > F.col("b")).alias("n_up"), F.count_if(F.col("a") < F.col("b")).alias("n_down"),
    )
    higher = F.col("metric").isin(*[m for m, up in DIRECTIONS.items() if up])
    out = sums.withColumn("delta", F.col("after_mean") - F.col("before_mean"))
    return out.withColumns({"direction": _direction(F.col("delta"), higher), "p_value": sign_test(F.col("n"), F.col("n_up"), F.col("n_down"))})


def log_factorial(n: Column) -> Column:
    """Logarithm of n!, by Stirling's series eight places further up."""
    x = n.cast("double") + 9
    powers = {1: 1 / 12, 3: -1 / 360, 5: 1 / 1260, 7: -1 / 1680, 9: 1 / 1188}
    series = reduce(lambda a, b: a + b, [c / F.pow(x, F.lit(k)) for k, c in powers.items()], (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi))
    return series - reduce(lambda a, b: a + b, [F.log(n + i) for i in range(1, 9)])


def sign_test(n: Column, up: Column, down: Column) -> Column:
    """Two-sided binomial sign test; null below two observations.

    The tail is summed from its largest term downwards. Terms further than five roots of the count
    away are below 1e-21 of that one, so the work is the root of the count, not the count.
    """
    moved, k = up + down, F.least(up, down)
    largest = F.exp(log_factorial(moved) - log_factorial(k) - log_factorial(moved - k) - moved * math.log(2))
    far = F.least(k, F.ceil(5 * F.sqrt(moved.cast("double"))) + 1).cast("bigint")
    begin = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("p"))

    def add(state: Column, i: Column) -> Column:
        return F.struct((state["t"] * (k - i) / (moved - k + 1 + i)).alias("t"), (state["p"] + state["t"]).alias("p"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), far), begin, add)["p"] * largest
    return F.when(n < 2, F.lit(None)).when(moved == 0, 1.0).otherwise(F.least(F.lit(1.0), tail * 2))


def pattern_deltas(tasks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of paired tasks showing each pattern (or umbrella pattern) before and after; fewer is better."""
    paired = tasks.filter("side = 'paired'").select("task_id")
    whole = paired.agg(F.count("*").alias("_n"))

    def shown(df: DataFrame, name: str) -> DataFrame:
        kinds = df.select("task_id", F.explode(F.array_compact(F.array("type", "parent_type"))).alias("type")).distinct()
        return kinds.join(paired, "task_id", "left_semi").groupBy("type").agg(F.count("*").alias(name))

    both = shown(before, "_b").join(shown(after, "_a"), "type", "full").fillna(0).join(F.broadcast(whole))
    rows = both.select("type", (F.col("_b") / F.col("_n")).alias("before_share"), (F.col("_a") / F.col("_n")).alias("after_share"))
    rows = rows.withColumn("delta", F.col("after_share") - F.col("before_share"))
    return rows.withColumn("direction", _direction(F.col("delta"), F.lit(False)))


def guardrails(deltas: DataFrame, relative: float = 0.10, level: float = 0.05) -> DataFrame:
    """Regressions that are large or significant, when something else improved."""
    won = deltas.filter("direction = 'improved'").agg(F.count("*").alias("_won"))
    rows = deltas.filter("direction = 'regressed'").join(F.broadcast(won)).filter("_won > 0").drop("_won")
    change = F.when(F.col("before_mean") != 0, F.abs("delta") / F.abs("before_mean")).otherwise(1.0)
    rows = rows.withColumns({"relative_regression": change, "significant": F.coalesce(F.col("p_value") < level, F.lit(False))})
    return rows.filter((F.col("relative_regression") >= relative) | F.col("significant"))


def recommendation(deltas: DataFrame, warnings: DataFrame) -> DataFrame:
    """One line on the effect of an intervention; there are eleven metrics at most."""
    names = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("metric"))))
    rows = deltas.agg(names("improved").alias("i"), names("regressed").alias("r"))
    rows = rows.join(F.broadcast(warnings.agg(F.array_sort(F.collect_list("metric")).alias("w"))))
    some = lambda c, k: F.array_join(F.slice(c, 1, k), ", ")
    up, down, warned = F.size("i") > 0, F.size("r") > 0, F.size("w") > 0
    text = (
        F.when(~up & ~down, "No significant changes detected.")
        .when(up & warned, F.concat(F.lit("Intervention improved "), some("i", 2), F.lit(" but regressed "), some("w", 2), F.lit(". Review tradeoffs.")))
        .when(up & down, F.concat(F.lit("Intervention improved "), some("i", 2), F.lit(" with minor regressions in "), some("r", 2), F.lit(" (below guardrail thresholds).")))
        .when(up, F.concat(F.lit("Intervention improved "), some("i", 3), F.lit(" without regressions.")))
        .otherwise(F.concat(F.lit("Intervention regressed "), some("r", 3), F.lit(" without improvements.")))
    )
    return rows.select(text.alias("recommendation"))
