"""Tables behind the charts: token bars, durations, lanes, timelines, waterfalls, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import agents, calls as fc, tokens as ft
from runloom.operators import filters, metrics as m
from runloom.operators.slices import islands, running

STEP = ["traj_id", "slice", "step_idx"]
PARTS_OF_TOTAL = ("fresh", "cache_read", "cache_write", "output", "reasoning")


def token_bars(steps: DataFrame) -> DataFrame:
    """Disjoint token segments of every step."""
    return steps.select("traj_id", "step_idx", agents.effective_agent().alias("agent"), ft.step_segments().alias("_s")).select(
        "traj_id", "step_idx", "agent", *[f"_s.{p}" for p in PARTS_OF_TOTAL]
    )


def token_bars_by_agent(steps: DataFrame) -> DataFrame:
    return token_bars(steps).groupBy("traj_id", "agent").agg(*[F.sum(p).alias(p) for p in PARTS_OF_TOTAL])


def step_durations(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Duration without spawn waits, the kind of failure, and the run's mean."""
    split = m.step_time_split(steps, calls).select("traj_id", "step_idx", F.col("duration_excl_spawn_s").alias("seconds"))
    kinds = filters.step_error_kind(steps, calls).select("traj_id", "step_idx", "error_kind")
    mean = split.groupBy("traj_id").agg((m.exact_sum(F.col("seconds")) / F.count("seconds")).alias("mean_seconds"))
    return split.join(kinds, ["traj_id", "step_idx"]).join(mean, "traj_id")


def tool_frequency(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls per tool label and agent."""
    who = steps.select(*STEP, agents.effective_agent().alias("agent"))
    return calls.select(*STEP, fc.chart_name().alias("label")).join(who, STEP).groupBy("traj_id", "label", "agent").agg(F.count("*").alias("calls"))


def tool_duration_segments(calls: DataFrame) -> DataFrame:
    """Timed calls of a label stacked end to end: where each one starts in its bar."""
    rows = calls.select(*STEP, "call_pos", fc.chart_name().alias("label"), fc.stats_duration_ms().alias("ms")).filter("ms > 0")
    rows = running(rows, {"_sum": F.col("ms")}, keys=["traj_id", "label"], order=["step_idx", "call_pos"])
    return rows.select("traj_id", "label", "step_idx", "call_pos", "ms", (F.col("_sum") - F.col("ms")).alias("base_ms"))


def swimlanes(steps: DataFrame) -> DataFrame:
    """Stretches of consecutive steps in one lane; user turns have a lane of their own."""
    lane = F.when(F.col("role") == "user", "user").otherwise(F.concat(F.lit("agent:"), agents.effective_agent()))
    rows = steps.select(*STEP, lane.alias("lane"), "tokens.total", "tool_call_count")
    return islands(rows, ["lane"]).groupBy("traj_id", F.col("island").alias("start_step")).agg(
        F.min("lane").alias("lane"), F.max("step_idx").alias("end_step"), F.sum("total").alias("tokens"), F.sum("tool_call_count").alias("calls")
    )


def tool_outcomes(calls: DataFrame) -> DataFrame:
    return calls.select("traj_id", "step_idx", "call_pos", "tool_name", (~fc.failed()).alias("ok"), fc.hint().alias("hint"))


def waterfall(patterns: DataFrame) -> DataFrame:
    """Extra tokens per divergence type, largest first, and where each bar starts; seven types per pair."""
    from pyspark.sql import Window

    rows = patterns.groupBy("group_key", "type").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("group_key").orderBy(F.col("tokens").desc(), "type")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"rank": F.row_number().over(order), "base": F.coalesce(F.sum("tokens").over(before), F.lit(0))})


def agent_labels(steps: DataFrame, size: int = 20) -> DataFrame:
    """Display label per agent: 'main', a title or name of a tagged sub-agent, else a short id; equal labels get an id suffix."""
    agent = agents.effective_agent()
    seen = steps.groupBy("traj_id", agent.alias("agent")).agg(
        F.bool_or(F.coalesce("is_sub_agent", F.lit(False))).alias("_sub"),
        F.min_by("session_title", F.when(F.col("session_title") != "", F.col("step_idx"))).alias("_title"),
    )
    named = F.when(F.col("_sub") & F.col("_title").isNotNull(), agents.clip(F.col("_title"), size)).when(
        F.col("_sub"), F.concat(F.lit("sub "), F.substring("agent", 1, 12))
    )
    rows = seen.withColumn("label", F.when(F.col("agent") == "", "main").otherwise(F.coalesce(named, agents.short_label(F.col("agent")))))
    twice = rows.groupBy("traj_id", "label").agg((F.count("*") > 1).alias("_twice"))
    rows = rows.join(twice, ["traj_id", "label"])
    tail = F.when(F.length("agent") > 6, F.substring(F.col("agent"), -6, 6)).otherwise(F.col("agent"))
    name = F.when(F.col("_twice") & (F.col("agent") != ""), F.concat("label", F.lit(" ("), tail, F.lit(")"))).otherwise(F.col("label"))
    return rows.select("traj_id", "agent", name.alias("label"))


def brief(scorecard: DataFrame) -> DataFrame:
    """Text lines that sum up a run, from its scorecard row."""
    lines = F.array(
        F.format_string("%d steps, %d tokens, %d tool calls", "steps", "total_tokens", "tool_calls"),
        F.format_string("%d failed calls", "tool_fail"),
        F.format_string("%.1f s on the clock", "wall_clock"),
    )
    return scorecard.select("traj_id", F.posexplode(lines).alias("line_no", "text"))


