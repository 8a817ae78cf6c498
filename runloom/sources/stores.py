"""Session stores: tables of sessions, messages and parts, and folders of message shards, put together as exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import carry, dense_index, running
from runloom.session import cut_lineage

# Tools whose parts name the session they started.
SPAWNING = ("task", "agent", "delegate", "subagent")


def edges(sessions: DataFrame, messages: DataFrame, parts: DataFrame, completed: bool = False) -> DataFrame:
    """(parent, child, relation) of the store: the child's own parent_id, and the sessions named by tool parts.

    ``completed``: only parts of finished calls count, whatever the tool.
    """
    own = sessions.filter("parent_id <> ''").select(F.col("parent_id").alias("parent"), F.col("session_id").alias("child"), F.lit(1).alias("_own"), F.lit(0).alias("_told"))
    meta = lambda n: F.get_json_object("data", f"$.state.metadata.{n}")
    named = F.coalesce(*[F.when(meta(n) != "", meta(n)) for n in ("sessionId", "sessionID", "session_id")])
    tool = F.get_json_object("data", "$.type") == "tool"
    counts = F.get_json_object("data", "$.state.status") == "completed" if completed else F.lower(F.get_json_object("data", "$.tool")).isin(*SPAWNING)
    told = parts.filter(tool & counts).select("message_id", named.alias("child")).filter("child is not null").join(messages.select("message_id", F.col("session_id").alias("parent")), "message_id")
    told = told.filter("parent <> child").select("parent", "child", F.lit(0).alias("_own"), F.lit(1).alias("_told"))
    rows = own.unionByName(told).groupBy("parent", "child").agg(F.max("_own").alias("_own"), F.max("_told").alias("_told"))
    relation = F.when(F.col("_own") + F.col("_told") == 2, "parent_id+tool_metadata").when(F.col("_own") == 1, "parent_id").otherwise("tool_metadata")
    return rows.select("parent", "child", relation.alias("relation"))


def roots(sessions: DataFrame) -> DataFrame:
    """Sessions that exports start from: those without a parent, or whose parent isn't in the store, and one of each cycle of parents.

    Walks of doubling length lead every session to where its parents end or turn in a circle; a circle is named by its
    smallest session.
    """
    known = sessions.select("session_id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("parent"))
    here = known.select(F.col("session_id").alias("parent"), F.lit(True).alias("_there"))
    up = known.join(here, "parent", "left")
    tops = up.filter("_there is null").select("session_id")
    walk = cut_lineage(up.select("session_id", F.when(F.col("_there"), F.col("parent")).alias("at"), F.col("session_id").alias("least")))
    length, count = 1, walk.count()
    while length < count and not walk.filter("at is not null").isEmpty():
        # from here to `at` everything was seen; go on from there as far again
        step = walk.select(F.col("session_id").alias("at"), F.col("at").alias("_to"), F.col("least").alias("_low"))
        walk = walk.filter("at is not null").join(step, "at").select("session_id", F.col("_to").alias("at"), F.least("least", "_low").alias("least"))
        walk, length = cut_lineage(walk), 2 * length
    # what is still under way goes round; every session of a circle is reached, and sees its whole circle
    ends = walk.filter("at is not null").select(F.col("at").alias("session_id")).distinct()
    circles = walk.join(ends, "session_id", "left_semi").select(F.col("least").alias("session_id")).distinct()
    return tops.unionByName(circles).distinct()


def descendants(start: DataFrame, links: DataFrame, sessions: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, missing): every session reached from each root, breadth first, and the references that lead nowhere.

    found: root, session_id, depth, discovered_by, traversal_parent_id. A session found twice at one depth belongs to the
    path that comes first in the order of ids. missing: root, parent, child, depth, reason.
    """
    known = sessions.select(F.col("session_id").alias("child")).distinct()
    level = start.select(F.col("session_id").alias("root"), "session_id", F.array("session_id").alias("path"), F.lit("root").alias("discovered_by"), F.lit(None).cast("string").alias("traversal_parent_id"), F.lit(0).cast("bigint").alias("depth"))
    found = level = cut_lineage(level)
    depth = 0
    while not level.isEmpty():
        depth += 1
        step = level.select("root", F.col("session_id").alias("parent"), "path").join(links, "parent")
        step = cut_lineage(step.join(found.select("root", F.col("session_id").alias("child")), ["root", "child"], "left_anti"))
        there = step.join(known, "child", "left_semi")
        if max_depth is not None and depth > max_depth:
            there = there.filter("false")
        best = there.groupBy("root", "child").agg(F.min(F.struct(F.concat("path", F.array("child")).alias("path"), "relation", "parent")).alias("m"))
        level = cut_lineage(best.select("root", F.col("child").alias("session_id"), "m.path", F.col("m.relation").alias("discovered_by"), F.col("m.parent").alias("traversal_parent_id"), F.lit(depth).cast("bigint").alias("depth")))
        found = found.unionByName(level)
    found = cut_lineage(found.drop("path"))
    # each session was expanded once, so one pass over all depths gives what their references missed
    told = found.select("root", F.col("session_id").alias("parent"), (F.col("depth") + 1).alias("depth")).join(links, "parent")
    missing = told.join(known, "child", "left_anti").withColumn("reason", F.lit("absent"))
    if max_depth is not None:
        deep = told.filter(F.col("depth") > max_depth).join(found.select("root", F.col("session_id").alias("child")), ["root", "child"], "left_anti")
        missing = missing.unionByName(deep.join(known, "child", "left_semi").withColumn("reason", F.lit("too deep")), allowMissingColumns=True)
    return found, cut_lineage(missing.select("root", "parent", "child", "depth", "reason").distinct())


def assemble(found: DataFrame, sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Every root's messages, its own and those of all sessions below it, in order of (time, place in the session, id).

    ``messages``: message_id, session_id, time_created, data; ``parts``: part_id, message_id, time_created, data (JSON). A
    message's own creation time stays; the row's time only fills a missing one. Messages below the root are marked as a
    sub-agent's, with parent, depth and title. ``parts`` of a message are its JSON texts in order of (time, id).
    """
    own_time = F.get_json_object("data", "$.time.created").cast("bigint")
    rows = messages.withColumns({"created": F.coalesce(own_time, F.col("time_created").cast("bigint")), "_sort": F.coalesce(F.col("time_created").cast("bigint"), own_time, F.lit(0))})
    rows = dense_index(rows, "session_id", F.coalesce(F.col("time_created"), F.lit(0)), ["message_id"], name="ordinal")
    held = parts.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "part_id", "data"))), lambda p: p["data"]).alias("parts"))
    facts = sessions.select("session_id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("_parent"), F.coalesce("title", F.lit("")).alias("title"))
    below = F.col("depth") > 0
    rows = rows.join(found, "session_id").join(facts, "session_id").join(held, "message_id", "left")
    rows = rows.select(
        "root", "session_id", "message_id", "ordinal", "_sort", "created", "data", F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), below.alias("is_sub_agent"), "depth",
        F.when(below, F.coalesce("_parent", "traversal_parent_id")).alias("parent_session_id"), F.when(below, F.col("title")).alias("session_title"),
    )
    return dense_index(rows, "root", F.col("_sort"), ["ordinal", "message_id"]).drop("_sort")


def manifest(found: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per session of a root: depth, how and through which session it was found, and its messages."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return found.join(counts, "session_id", "left").fillna(0, ["message_count"])


def merge_shards(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, gaps) of shard files (traj_id, file, text): a JSON list each, merged in the order of their numbers.

    messages: traj_id, shard, pos in it, position in the run, message. gaps: traj_id and the first and last missing number of
    each gap below the highest. Two files of one number are an error of the run: neither is merged.
    """
    numbered = shards.withColumn("shard", F.regexp_extract("file", r"(\d+)(?:\.[^.]*)?$", 1).cast("bigint"))
    once = numbered.groupBy("traj_id", "shard").agg(F.count("*").alias("_n"), F.first("text").alias("text"))
    broken = once.filter("_n > 1").select("traj_id").distinct()
    once = cut_lineage(once.join(broken, "traj_id", "left_anti").select("traj_id", "shard", F.from_json("text", "array<string>").alias("messages")))
    sized = once.select("traj_id", "shard", F.size("messages").alias("n")).withColumn("slice", F.floor(F.col("shard") / 4096).cast("bigint"))
    before = running(sized, {"_upto": F.col("n")}, order=["shard"], strict=True).fillna(0, ["_upto"]).select("traj_id", "shard", "_upto")
    rows = once.join(before, ["traj_id", "shard"]).select("traj_id", "shard", "_upto", F.posexplode("messages").alias("pos", "message"))
    last = carry(sized, {"_last": F.col("shard")}, order=["shard"]).select("traj_id", (F.coalesce("_last", F.lit(-1)) + 1).alias("first"), (F.col("shard") - 1).alias("last"))
    return rows.select("traj_id", "shard", "pos", (F.col("_upto") + F.col("pos")).alias("position"), "message"), last.filter("first <= last")
