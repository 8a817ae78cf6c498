"""Step filters and run predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import agents, calls as fc

STEP = ["traj_id", "slice", "step_idx"]


def step_error_kind(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Steps with ``error_kind``: 'tool' wins over 'system'; null without a failure."""
    bad = calls.filter(fc.failed()).groupBy(*STEP).agg(F.bool_or(fc.error_kind() == "tool").alias("_by_tool"))
    kind = (
        F.when(F.col("_by_tool"), "tool").when(F.col("_by_tool").isNotNull(), "system")
        .when(F.lower(F.trim("finish")) == "error", "system").when(F.col("error_count") > 0, "tool")
    )
    return steps.join(bad, STEP, "left").withColumn("error_kind", kind).drop("_by_tool")


def with_workflow_role(steps: DataFrame, parts: DataFrame) -> DataFrame:
    text = parts.groupBy(*STEP).agg(
        F.bool_and(F.when(F.col("type") == "text", F.coalesce("synthetic", F.lit(False)))).alias("_syn"),
        F.bool_or(F.col("type") == "compaction").alias("_cmp"),
    )
    out = steps.join(text, STEP, "left")
    return out.withColumn("workflow_role", agents.workflow_role(F.col("_syn"), F.col("_cmp"))).drop("_syn", "_cmp")


def filter_steps(
    steps: DataFrame,
    calls: DataFrame,
    parts: DataFrame,
    roles: Sequence[str],
    features: Sequence[str] = (),
    agent_ids: Sequence[str] = (),
    keyword: str = "",
) -> DataFrame:
    """Roles, features and agents are each alternatives; the groups and the keyword must all hold.

    Roles are 'User' and 'Assistant' (everything that is no human turn); no role keeps nothing.
    Features are 'Tool Calls', 'Errors', 'Reasoning'. The keyword looks at preview, tool names and inputs.
    """
    rows = with_workflow_role(step_error_kind(steps, calls), parts)
    human = F.col("workflow_role") == "user"
    keep = F.lit(False)
    if "User" in roles:
        keep = keep | human
    if "Assistant" in roles:
        keep = keep | ~human
    tests = {
        "Tool Calls": F.col("tool_call_count") > 0,
        "Errors": F.col("error_kind").isNotNull(),
        "Reasoning": F.coalesce("has_reasoning", F.lit(False)),
    }
    if features and "All" not in features:
        wanted = F.lit(False)
        for name in features:
            wanted = wanted | tests[name]
        keep = keep & wanted
    if agent_ids:
        keep = keep & agents.effective_agent().isin(*agent_ids)
    word = keyword.strip().lower()
    if word:
        said = F.lower(F.concat_ws(" ", "tool_name", F.to_json("input"))).contains(word)
        hits = calls.filter(said).select(*STEP).distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hits, STEP, "left")
        keep = keep & (F.lower(F.coalesce("text_preview", F.lit(""))).contains(word) | F.coalesce("_hit", F.lit(False)))
    return rows.filter(keep).select("traj_id", "step_idx")


def success(steps: DataFrame) -> DataFrame:
    """A run succeeded when its last assistant step stopped by itself."""
    last = F.max_by("finish", F.when(F.col("role") == "assistant", F.col("step_idx")))
    return steps.groupBy("traj_id").agg(F.coalesce(last.isin("stop", "end_turn"), F.lit(False)).alias("success"))


def empty_runs(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Listed runs without a single step, as error rows."""
    return sessions.select("traj_id").join(steps.select("traj_id").distinct(), "traj_id", "left_anti").withColumn(
        "error", F.lit("no steps")
    )


def head_and_tail(steps: DataFrame, size: int = 40) -> DataFrame:
    """The first and last ``size`` steps of every run, found from the run length alone."""
    length = steps.groupBy("traj_id").agg((F.max("step_idx") + 1).alias("_n"))
    rows = steps.join(length, "traj_id")
    return rows.filter((F.col("step_idx") < size) | (F.col("step_idx") >= F.col("_n") - size)).drop("_n")


def friendly_finish(value: Column) -> Column:
    # Finish reasons and how they read; others are title-cased.
    names = {"tool-calls": "Tool Call", "stop": "Completed", "end_turn": "End Turn"}
    rules = F
    for key, text in names.items():
        rules = rules.when(value == key, text)
    return rules.otherwise(F.initcap(F.translate(F.coalesce(value, F.lit("")), "-_", "  ")))
