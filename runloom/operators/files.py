"""Files a run touched: interactions, targets, first touches, token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import calls as fc, paths

STEP = ["traj_id", "slice", "step_idx"]


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _touch(path: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(path.isNotNull(), F.struct(path.alias("path"), kind.alias("type")))


def _structured() -> Column:
    rules = F
    for tool, (keys, kind) in vocab.FILE_TOOL_KEYS.items():
        path = F.coalesce(*[_filled(F.col(f"input.{k}")) for k in keys])
        rules = rules.when(F.col("tool_name") == tool, _touch(path, kind))
    return rules.otherwise(F.lit(None))


def file_interactions(calls: DataFrame) -> DataFrame:
    """One row per path a call reads, writes or searches, or skill it loads."""
    search = fc.is_tool(("Glob", "glob", "Grep", "grep"))
    glob = fc.is_tool(("Glob", "glob"))
    command = F.col("input.command")
    shell_kind = F.when(fc.shell_writes(command), "write").otherwise("read")
    shell = F.when(
        fc.is_tool(vocab.BASH_TOOLS) & (command != ""),
        F.transform(fc.shell_paths(command), lambda p: F.struct(p.alias("path"), shell_kind.alias("type"))),
    )
    fixed = F.array_compact(
        F.array(
            _structured(),
            F.when(search, _touch(_filled(F.col("input.path")), "search")),
            F.when(glob, _touch(_filled(F.col("input.pattern")), "search")),
            _touch(F.concat(F.lit("skill:"), fc.skill_name()), "skill"),
        )
    )
    empty = F.array().cast("array<struct<path:string,type:string>>")
    rows = calls.select(
        *STEP, "call_pos", F.col("tool_name").alias("tool"), F.posexplode(F.concat(F.coalesce(shell, empty), fixed)).alias("touch_pos", "_t")
    )
    path = paths.slashes(F.col("_t.path"))
    skill = (F.col("_t.type") == "read") & F.lower(paths.basename(F.regexp_replace(path, "/+$", ""))).eqNullSafe("skill.md")
    return rows.select(
        *STEP, "call_pos", F.col("touch_pos").cast("bigint").alias("touch_pos"), "tool", path.alias("path"), F.when(skill, "skill").otherwise(F.col("_t.type")).alias("type")
    )


def target_files(calls: DataFrame, parts: DataFrame) -> DataFrame:
    """Patched files and successful write targets."""
    patched = parts.filter("type = 'patch'").select("traj_id", F.explode("files").alias("path"))
    patched = patched.filter("path <> ''").select("traj_id", paths.slashes(F.col("path")).alias("path"))
    written = calls.filter(fc.is_tool(vocab.WRITE_TOOLS) & ~fc.failed()).select("traj_id", fc.write_path().alias("path"))
    return patched.unionByName(written.filter("path is not null")).distinct()


def first_touches(interactions: DataFrame, targets: DataFrame) -> DataFrame:
    """First step touching each target, matched by whole-segment suffix.

    Touches collapse to distinct paths first; equal file names make the join key, so the suffix test
    only sees paths that could match.
    """
    seen = interactions.groupBy("traj_id", paths.normal(F.col("path")).alias("touched")).agg(F.min("step_idx").alias("step"))
    seen = seen.withColumn("file", paths.basename(F.col("touched")))
    goal = targets.select("traj_id", F.col("path").alias("target"), paths.normal(F.col("path")).alias("_goal"))
    goal = goal.withColumn("file", paths.basename(F.col("_goal")))
    hits = seen.join(goal, ["traj_id", "file"]).filter(paths.same_file(F.col("touched"), F.col("_goal")))
    return hits.groupBy("traj_id", "target").agg(F.min("step").alias("first_step"))


def file_targeting(steps: DataFrame, interactions: DataFrame, targets: DataFrame) -> DataFrame:
    """Average first touch and exploration ratio per run that has both touches and targets."""
    touches = first_touches(interactions, targets).groupBy("traj_id").agg(
        (F.sum("first_step") / F.count("*")).alias("avg_first_touch"), F.count("*").alias("touched_targets")
    )
    looked = interactions.filter("type in ('read', 'search')").select("traj_id", paths.normal(F.col("path")).alias("p")).distinct()
    looked = looked.groupBy("traj_id").agg(F.count("*").alias("_looked"))
    goals = targets.groupBy("traj_id").agg(F.count("*").alias("targets"))
    active = interactions.select("traj_id").distinct()
    out = goals.join(active, "traj_id", "left_semi").join(touches, "traj_id", "left").join(looked, "traj_id", "left")
    return out.select(
        "traj_id", "targets", F.coalesce("touched_targets", F.lit(0)).alias("touched_targets"), "avg_first_touch",
        (F.coalesce("_looked", F.lit(0)) / F.col("targets")).alias("exploration_ratio"),
    )


def file_token_cost(steps: DataFrame, interactions: DataFrame) -> DataFrame:
    """Step tokens shared equally over the step's touches, summed per file."""
    per_step = interactions.groupBy(*STEP).agg(F.count("*").alias("_n"))
    tokens = steps.select(*STEP, "tokens.total").filter("total > 0").join(per_step, STEP)
    rows = interactions.select(*STEP, paths.normal(F.col("path")).alias("path")).join(tokens, STEP)
    share = (F.col("total") / F.col("_n")).cast("decimal(28,9)")
    return rows.groupBy("traj_id", "path").agg(F.round(F.sum(share)).cast("bigint").alias("tokens"))


def file_summary(interactions: DataFrame) -> DataFrame:
    """Unique paths and touches per kind."""
    by_path = interactions.groupBy("traj_id", "path").agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in ("read", "write", "search", "skill")]
    )
    return by_path.groupBy("traj_id").agg(
        F.count("*").alias("unique_paths"),
        *[F.sum(k).alias(f"{k}s") for k in ("read", "write", "search")],
        F.sum("skill").alias("skill_loads"),
    )


def skill_calls(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls per (run, agent, skill)."""
    from runloom.functions.agents import effective_agent

    who = steps.select(*STEP, effective_agent().alias("agent"))
    rows = calls.withColumn("skill", fc.skill_name()).filter("skill is not null").select(*STEP, "skill")
    return rows.join(who, STEP).groupBy("traj_id", "agent", "skill").agg(F.count("*").alias("calls"))


def capability_usage(calls: DataFrame) -> DataFrame:
    """Long form: calls per tool and per skill; unnamed tools are left out."""
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("tool_name").isin("", "?"), F.struct(F.lit("tool").alias("kind"), F.col("tool_name").alias("name"))),
            F.when(fc.skill_name().isNotNull(), F.struct(F.lit("skill").alias("kind"), fc.skill_name().alias("name"))),
        )
    )
    return calls.select("traj_id", F.explode(kinds).alias("_x")).groupBy("traj_id", "_x.kind", "_x.name").agg(F.count("*").alias("calls"))
