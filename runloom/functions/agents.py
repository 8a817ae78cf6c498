"""Who acted: agent keys of a step, as column expressions over the steps table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_agent() -> Column:
    """'' for the main agent; a sub-agent goes by its session, else its name.

    A null ``is_sub_agent`` means the log never says; then any agent name is a sub-agent.
    """
    agent = F.coalesce("agent", F.lit(""))
    session = F.when(F.col("session_id") != "", F.col("session_id"))
    sub = F.coalesce("is_sub_agent", F.lit(False)) | agent.endswith("(subagent)")
    return (
        F.when(F.col("role") == "user", "")
        .when(sub, F.coalesce(session, agent))
        .when(F.col("is_sub_agent").isNull(), agent)
        .otherwise("")
    )


def window_agent() -> Column:
    """Key of the context window a step belongs to: its session when there is one.

    Without a session, user and compaction turns of a sub-agent belong to that agent's window.
    """
    agent = F.coalesce("agent", F.lit(""))
    session = F.when(F.col("session_id") != "", F.col("session_id"))
    sub = F.coalesce("is_sub_agent", F.lit(False)) | agent.endswith("(subagent)") | F.col("is_sub_agent").isNull()
    turn = F.when(sub, agent).otherwise("")
    return F.coalesce(session, F.when(F.col("role").isin("user", "compaction"), turn).otherwise(effective_agent()))


def workflow_role(all_synthetic: Column, has_compaction_part: Column | None = None) -> Column:
    """Display role; ``all_synthetic`` says the step has text parts and every one is injected."""
    compaction = F.coalesce("is_compaction_checkpoint", F.lit(False)) | F.coalesce(F.lit(None).cast("boolean") if has_compaction_part is None else has_compaction_part, F.lit(False))
    return (
        F.when(F.col("role") != "user", F.col("role"))
        .when(compaction, "compaction")
        .when(F.coalesce(all_synthetic, F.lit(False)), "system")
        .when(F.coalesce("is_sub_agent", F.lit(False)), "task")
        .otherwise("user")
    )


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def short_label(agent: Column) -> Column:
    return (
        F.when(agent == "", "main")
        .when(F.length(agent) > 8, F.concat(F.substring(agent, 1, 8), F.lit("…")))
        .otherwise(agent)
    )
