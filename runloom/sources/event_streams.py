"""Event streams: turns of a conversation, inherited prefixes, child logs, tool spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import carry, running
from runloom.session import cut_lineage

# Tool spellings of one editor and the common names.
TOOL_NAMES = {"StrReplace": "Edit", "Shell": "Bash"}


def common_tool_name(name: Column) -> Column:
    rules = F
    for spelled, common in TOOL_NAMES.items():
        rules = rules.when(name == spelled, F.lit(common))
    return rules.when(F.coalesce(name, F.lit("")) == "", "?").otherwise(name)


def turns(events: DataFrame) -> DataFrame:
    """Turn number of every event (traj_id, slice, line_no, kind, role); kind is message, reasoning, call or complete.

    A turn ends when the role changes, after a completion, and where reasoning follows a call of the same
    turn. Reasoning has no role of its own: it stays with what is open, else it is the assistant's.
    """
    order = ["line_no"]
    rows = running(events, {"_seg": F.when(F.col("kind") == "complete", 1).otherwise(0)}, order=order, strict=True).fillna(0, ["_seg"])
    own = F.when(F.col("kind") == "message", F.col("role")).when(F.col("kind") == "call", "assistant")
    rows = carry(rows, {"_open": F.when(own.isNotNull(), F.struct(own.alias("role"), F.col("_seg").alias("seg")))}, order=order)
    held = F.when(F.col("_open.seg") == F.col("_seg"), F.col("_open.role"))
    rows = rows.withColumn("turn_role", F.coalesce(own, held, F.lit("assistant"))).drop("_open")
    rows = cut_lineage(rows.filter("kind <> 'complete'"))
    rows = carry(rows, {"_prev": F.struct("turn_role", "_seg")}, order=order)
    changed = F.col("_prev").isNull() | (F.col("_prev.turn_role") != F.col("turn_role")) | (F.col("_prev._seg") != F.col("_seg"))
    rows = running(rows.withColumn("_new", F.when(changed, 1).otherwise(0)), {"_part": F.col("_new")}, order=order)
    rows = cut_lineage(rows.drop("_prev"))
    # The last call or reasoning before decides: a call means tool parts are open, reasoning that they are not.
    acted = F.when(F.col("kind").isin("call", "reasoning"), F.struct("kind", "_part"))
    rows = carry(rows, {"_act": acted}, order=order)
    after_call = (F.col("kind") == "reasoning") & (F.col("turn_role") == "assistant") & (F.col("_act.kind") == "call") & (F.col("_act._part") == F.col("_part"))
    starts = F.when((F.col("_new") == 1) | F.coalesce(after_call, F.lit(False)), 1).otherwise(0)
    rows = running(rows.withColumn("_start", starts), {"turn": F.col("_start")}, order=order)
    return rows.drop("_seg", "_new", "_part", "_act", "_start")


def own_events(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Drop what a forked child inherited: events below the seed length of its header."""
    seeds = headers.select("session_id", F.col("seed_length").cast("bigint").alias("_seed"))
    rows = events.join(seeds, "session_id", "left")
    return rows.filter(F.col("seq") >= F.greatest(F.lit(0), F.coalesce("_seed", F.lit(0)))).drop("_seed")


def human_messages(messages: DataFrame) -> DataFrame:
    """User messages typed by a person: no source kind, or kind 'user'."""
    return messages.filter(F.coalesce(F.col("source_kind"), F.lit("")).isin("", "user"))


def merge_children(messages: DataFrame) -> DataFrame:
    """Order the messages of a parent and its children by time, parents first at equal times."""
    from runloom.operators.slices import dense_index

    position = F.col("time_created_ms") * 2 + F.when(F.col("is_sub_agent"), 1).otherwise(0)
    return dense_index(messages, "traj_id", position, ["session_id", "pos"])
