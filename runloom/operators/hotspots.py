"""Where the time went: step decomposition, outliers, bottlenecks, top steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import calls as fc, tokens as ft
from runloom.operators.slices import nearest_rank, neighbours

STEP = ["traj_id", "slice", "step_idx"]
def assistant() -> Column:
    return F.col("role") == "assistant"


def _first_input() -> Column:
    keys = ("file_path", "command", "pattern", "path")
    return F.coalesce(*[F.when(F.col(f"input.{k}") != "", F.col(f"input.{k}")) for k in keys], F.lit(""))


def decompose(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool, inference and idle seconds of every step, their shares of the span, and the longest call."""
    ms = F.coalesce(fc.duration_ms(), F.lit(0.0))
    rows = calls.select(
        *STEP, ms.alias("ms"), fc.duration_ms().isNull().alias("untimed"),
        F.struct(ms.alias("ms"), (-F.col("call_pos")).alias("p"), "tool_name", F.substring(_first_input(), 1, 50).alias("target")).alias("_c"),
    )
    per = rows.groupBy(*STEP).agg(
        F.sum("ms").alias("tool_ms"), F.bool_or("untimed").alias("untimed"), F.max(F.when(F.col("ms") > 0, F.col("_c"))).alias("_top")
    )
    out = neighbours(steps, lambda w: {"_done": F.lag("time_completed_ms").over(w)}, before=1).join(per, STEP, "left")
    duration = F.coalesce("duration", F.lit(0.0))
    live = duration > 0
    idle = F.greatest(F.lit(0.0), F.round((F.col("time_created_ms") - F.col("_done")) / 1000, 2))
    out = out.withColumns(
        {
            "idle_s": F.when(live, F.coalesce(idle, F.lit(0.0))).otherwise(0.0),
            "tool_s": F.when(live, F.least(F.coalesce(F.col("tool_ms") / 1000, F.lit(0.0)), duration)).otherwise(0.0),
        }
    ).withColumn("inference_s", F.when(live, F.greatest(F.lit(0.0), duration - F.col("tool_s"))).otherwise(0.0))
    span = duration + F.col("idle_s")
    share = lambda c: F.when(live, F.round(F.col(c) / span * 100, 1)).otherwise(0.0)
    return out.withColumns(
        {
            "tool_pct": share("tool_s"), "inference_pct": share("inference_s"), "idle_pct": share("idle_s"),
            "timing_incomplete": ~live | F.coalesce("untimed", F.lit(False)),
            "dominant_tool": F.when(live, F.col("_top.tool_name")),
            "dominant_target": F.when(live, F.col("_top.target")),
            "dominant_s": F.when(live, F.round(F.col("_top.ms") / 1000, 2)),
        }
    ).withColumns({c: F.round(F.round(c, 6), 2) for c in ("tool_s", "inference_s", "idle_s")}).drop("_done", "_top", "tool_ms", "untimed")


def explanation() -> Column:
    """One line on where a decomposed step's time went, largest component first."""
    secs = lambda c: F.concat(F.col(c).cast("string"), F.lit("s"))
    target = F.when(F.col("dominant_target") != "", F.concat(F.lit(": "), F.col("dominant_target"))).otherwise("")
    running = F.concat(secs("tool_s"), F.lit(" executing tools"))
    named = F.concat(running, F.lit(" ("), F.col("dominant_tool"), target, F.lit(" "), secs("dominant_s"), F.lit(")"))
    thinking = F.concat(secs("inference_s"), F.lit(" LLM inference ("), F.format_number("tokens.total", 0), F.lit(" tokens)"))
    tool = F.concat(secs("tool_s"), F.lit(" tool execution"))
    queue = F.concat(secs("idle_s"), F.lit(" idle gap before step (queuing or rate limiting)"))
    has_tool, has_thought = F.col("tool_s") > 0, F.col("inference_s") > 0
    by_tool = F.array(F.when(F.col("dominant_tool").isNotNull(), named).otherwise(running), F.when(has_thought, thinking))
    by_idle = F.array(queue, F.when(has_tool, tool), F.when(has_thought, thinking))
    by_thought = F.array(thinking, F.when(has_tool, tool))
    body = (
        F.when((F.col("tool_pct") >= F.col("inference_pct")) & (F.col("tool_pct") >= F.col("idle_pct")), by_tool)
        .when(F.col("idle_pct") >= F.col("inference_pct"), by_idle)
        .otherwise(by_thought)
    )
    small = (F.col("idle_s") > 0) & (F.col("idle_pct") < F.col("tool_pct")) & (F.col("idle_pct") < F.col("inference_pct"))
    tail = F.array(F.when(small, F.concat(secs("idle_s"), F.lit(" idle"))))
    return F.concat(
        F.format_string("Step %d: %.1fs — ", F.col("step_idx"), F.coalesce("duration", F.lit(0.0))),
        F.array_join(F.array_compact(F.concat(body, tail)), ", "),
        F.when(F.col("timing_incomplete"), " [timing incomplete]").otherwise(""),
    )


def moments(df: DataFrame, keys: list[str], value: Column, decimals: int = 3) -> DataFrame:
    """Count, mean and sample deviation from exact decimal sums, so the split of rows cannot matter."""
    v = value.cast(f"decimal(18,{decimals})")
    sums = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).cast("double").alias("_s"), F.sum(v * v).cast("double").alias("_q")
    )
    n, s, q = F.col("n"), F.col("_s"), F.col("_q")
    variance = F.greatest(F.lit(0.0), (n * q - s * s) / (n * (n - 1)))
    return sums.select(*keys, "n", (s / n).alias("mean"), F.when(n > 1, F.sqrt(variance)).otherwise(0.0).alias("sd"))


def outlier_thresholds(steps: DataFrame) -> DataFrame:
    """Seconds a step must exceed to count as an outlier of its run."""
    timed = steps.filter(assistant() & (F.col("duration") > 0)).select("traj_id", "duration")
    ranks = nearest_rank(timed, ["traj_id"], F.col("duration"), {"p90": 0.9}, "median")
    rows = moments(timed, ["traj_id"], F.col("duration")).join(ranks, "traj_id")
    least = F.lit(vocab.BOTTLENECK_MIN_S)
    floor = F.greatest(least, F.col("median") * 2, F.col("p90"))
    sigma = F.col("mean") + 1.5 * F.col("sd")
    tight = F.greatest(least, F.least(floor, F.greatest(F.col("median") * 2, sigma)))
    return rows.select("traj_id", F.when((F.col("n") >= 8) & (F.col("sd") > 0), tight).otherwise(floor).alias("threshold"))


def bottlenecks(steps: DataFrame, calls: DataFrame, top: int = vocab.BOTTLENECK_TOP) -> DataFrame:
    """The ``top`` outlier steps of a run that have one dominant, actionable cause."""
    rows = decompose(steps, calls).filter(assistant() & (F.col("duration") > 0)).join(outlier_thresholds(steps), "traj_id")
    impact = F.col("duration") + F.col("idle_s")
    rows = rows.withColumn("impact", impact).filter(F.col("impact") >= F.col("threshold"))
    share = ft.cache_share(F.col("tokens.cache_read"), F.col("tokens.total"))
    weak = (F.col("tokens.total") > 0) & F.coalesce(F.round(share, 4) < vocab.BOTTLENECK_CACHE, F.lit(False))
    thinks = (F.col("inference_pct") >= 50) & (F.col("inference_s") >= vocab.BOTTLENECK_INFERENCE_S)
    cause = (
        F.when((F.col("idle_pct") >= 40) & (F.col("idle_s") >= vocab.BOTTLENECK_IDLE_S), "idle")
        .when((F.col("tool_pct") >= 50) & (F.col("tool_s") >= vocab.BOTTLENECK_TOOL_S), "tool")
        .when(thinks & ((F.col("tokens.total") >= vocab.BOTTLENECK_TOKENS) | weak), "context")
        .when(thinks & (F.col("inference_s") >= vocab.BOTTLENECK_LONG_INFERENCE_S), "inference")
    )
    rows = rows.withColumn("cause", cause).filter("cause is not null")
    label = F.concat(F.coalesce("dominant_tool", F.lit("tool")), F.when(F.col("dominant_target") != "", F.concat(F.lit(": "), F.col("dominant_target"))).otherwise(""))
    short = F.when(F.length(label) <= 40, label).otherwise(F.concat(F.substring(label, 1, 37), F.lit("…")))
    title = (
        F.when(F.col("cause") == "idle", F.format_string("Idle/queue bottleneck before #%d (%.0fs gap)", "step_idx", "idle_s"))
        .when(F.col("cause") == "tool", F.format_string("Tool bottleneck: %s (%.1fs)", short, F.col("tool_s")))
        .when(F.col("cause") == "context", F.format_string("Context/cache bottleneck at #%d (%.1fs)", "step_idx", "duration"))
        .otherwise(F.format_string("Inference bottleneck at #%d (%.1fs)", "step_idx", "duration"))
    )
    order = Window.partitionBy("traj_id").orderBy(F.col("impact").desc(), "step_idx")
    rows = rows.withColumns({"title": title, "detail": F.substring(explanation(), 1, 200), "rank": F.row_number().over(order)})
    return rows.filter(F.col("rank") <= top).select(
        "traj_id", "step_idx", F.col("rank").cast("bigint").alias("rank"), "duration", "cause", "title", "detail", "idle_s", "tool_s", "inference_s"
    )


def sigma_outliers(df: DataFrame, value: Column, threshold: float = 2.0, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Rows whose value lies more than ``threshold`` deviations above the mean of their run's positive values."""
    keys = list(keys)
    rows = df.withColumn("_v", value)
    stats = moments(rows.filter("_v > 0"), keys, F.col("_v"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    stats = stats.join(whole, keys).filter("_all >= 10 AND n >= 5 AND sd > 0")
    hit = (F.col("_v") > 0) & (F.col("_v") - F.col("mean") > threshold * F.col("sd"))
    return rows.join(stats, keys).filter(hit).drop("_v", "_all", "n", "mean", "sd")


def top_steps(rows: DataFrame, value: str, k: int = 5, largest: bool = True) -> DataFrame:
    """The ``k`` extreme steps of every run; Spark prunes to k per run before the shuffle."""
    direction = F.col(value).desc() if largest else F.col(value).asc()
    order = Window.partitionBy("traj_id").orderBy(direction, "step_idx")
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
