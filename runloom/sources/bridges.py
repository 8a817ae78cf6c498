"""Silver tables derived from the star-schema fixtures by plain projections.

``event_runs``   events        -> one run per user, one step per event, at most one call per step
``order_runs``   orders, lines -> several overlapping calls per step
``chat_runs``    conversations -> real text
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.slices import dense_index, with_slice
from runloom.schema import CALLS, INPUT, INPUT_TEXT, PARTS, STEPS
from runloom.session import cut_lineage, prepare


@dataclass(frozen=True)
class Runs:
    steps: DataFrame
    calls: DataFrame
    parts: DataFrame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def conform(df: DataFrame, schema) -> DataFrame:
    """Project to ``schema``; columns the source lacks are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def call_input(**given: Column) -> Column:
    texts = [given.get(n, F.lit(None)).cast("string").alias(n) for n in INPUT_TEXT]
    todos = given.get("todos", F.lit(None)).cast(INPUT["todos"].dataType).alias("todos")
    return F.struct(*texts, todos)


def token_struct(**given: Column) -> Column:
    zero = ("total", "input", "output", "cache_read", "cache_write")
    rest = ("reasoning", "context_window", "prompt_peak", "prompt_peak_cache_read")
    return F.struct(
        *[F.coalesce(given.get(n, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n in zero],
        *[given.get(n, F.lit(None)).cast("bigint").alias(n) for n in rest],
    )


def _millis(stamp: str) -> Column:
    return F.unix_millis(F.col(stamp).cast("timestamp"))


def event_rows(spark: SparkSession, folder: str, indexed: bool = True) -> DataFrame:
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint")
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("traj_id"),
        "event_id",
        "event_type",
        k.alias("k"),
        F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
        F.floor("value").cast("bigint").alias("whole"),
        _millis("ts").alias("time_created_ms"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )
    if indexed:
        rows = dense_index(rows, "traj_id", F.col("micros"), ["event_id"])
    else:
        rows = rows.withColumn("step_idx", F.lit(None).cast("bigint"))
    rows = with_slice(rows)
    k = F.col("k")
    kind = F.col("event_type")
    user = (kind == "signup") & (k % 2 == 0)
    tool = (
        F.when(user, F.lit(None))
        .when(kind == "view", F.when(k % 3 == 0, "Grep").when(k % 3 == 1, "Read").otherwise("Glob"))
        .when(kind == "click", "Bash")
        .when(kind == "purchase", "Edit")
        .when(kind == "error", F.when(k % 2 == 0, "Bash").otherwise("Edit"))
        .otherwise(F.when(k % 4 == 1, "TodoWrite").otherwise("Task"))
    )
    return rows.withColumns(
        {"role": F.when(user, "user").otherwise("assistant"), "tool_name": tool, "failed": kind == "error"}
    )


def event_runs(spark: SparkSession, folder: str, indexed: bool = True, once: bool = False) -> Runs:
    """``once`` writes the numbered rows first, for queries that read steps, calls and parts many times."""
    rows = event_rows(spark, folder, indexed)
    if once:
        rows = cut_lineage(rows)
    k, cents, run = F.col("k"), F.col("cents"), F.col("traj_id")
    user = F.col("role") == "user"
    cache = F.floor(cents * 6 / 10).cast("bigint")
    fresh = F.floor(cents * 3 / 10).cast("bigint")
    model = (
        F.when(user, "").when(run % 4 == 0, "claude-large").when(run % 4 == 1, "gpt-4o-mini")
        .when(run % 4 == 2, "other-model").otherwise("")
    )
    sub = F.concat(F.lit("sub"), (k % 3).cast("string"))
    steps = rows.select(
        "traj_id", "step_idx", "slice", "role",
        F.when(k % 10 == 9, sub).otherwise("").alias("agent"),
        model.alias("model_id"),
        F.when(model == "", "").otherwise("vendor").alias("provider_id"),
        F.when(k % 10 == 0, "stop").otherwise("tool-calls").alias("finish"),
        (cents / 1000).alias("duration"),
        "time_created_ms",
        (F.col("time_created_ms") + cents).alias("time_completed_ms"),
        token_struct(total=cents, cache_read=cache, input=fresh, output=cents - cache - fresh).alias("tokens"),
        F.concat(F.col("event_type"), F.lit(" "), k.cast("string")).alias("text_preview"),
        (user & (k % 20 == 0)).alias("is_compaction_checkpoint"),
        F.lit(False).alias("summary_true"),
        (~user & (k % 4 == 0)).alias("has_reasoning"),
        F.when(F.col("failed"), 1).otherwise(0).alias("error_count"),
        F.when(F.col("tool_name").isNotNull(), 1).otherwise(0).alias("tool_call_count"),
    )
    tool = F.col("tool_name")
    m = (k % 5).cast("string")
    file = F.concat(F.lit("src/m"), m, F.lit(".py"))
    command = (
        F.when(k % 4 == 0, "pytest tests")
        .when(k % 4 == 1, F.concat(F.lit("cat ./src/m"), m, F.lit(".py")))
        .when(k % 4 == 2, "grep -rn x ./src")
        .otherwise("git status")
    )
    todos = F.array(
        F.struct(
            F.concat(F.lit("item"), (k % 7).cast("string")).alias("content"),
            F.when(k % 3 == 0, "completed").otherwise("in_progress").alias("status"),
        ),
        F.struct(
            F.concat(F.lit("item"), ((k + 1) % 7).cast("string")).alias("content"),
            F.lit("pending").alias("status"),
        ),
    )
    start = F.col("time_created_ms")
    calls = rows.filter(tool.isNotNull()).select(
        "traj_id", "step_idx", "slice",
        F.lit(0).alias("call_pos"),
        "tool_name",
        F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("tool_id"),
        F.when(F.col("failed"), "error").otherwise("completed").alias("status"),
        call_input(
            command=F.when(tool == "Bash", command),
            file_path=F.when(tool.isin("Read", "Edit"), file),
            path=F.when(tool.isin("Grep", "Glob"), F.lit("src")),
            pattern=F.when(tool.isin("Grep", "Glob"), F.concat(F.lit("p"), m)),
            todos=F.when(tool == "TodoWrite", todos),
        ).alias("input"),
        F.when(tool.isin("Grep", "Glob") & (F.col("whole") % 4 != 0), "").otherwise("ok").alias("output"),
        (tool == "Bash").alias("exit_present"),
        F.when(tool == "Bash", F.when(F.col("failed"), k % 3).when(k % 8 == 3, F.lit(None)).otherwise(0)).alias("exit_code"),
        start.alias("time_start"),
        (start + F.floor(cents / 2).cast("bigint")).alias("time_end"),
        F.when((tool == "Read") & (k % 6 == 1), start + 600_000).alias("time_compacted"),
    )
    part_type = F.array_compact(
        F.array(
            F.struct(F.lit("text").alias("type"), F.concat(F.lit("say "), F.col("event_type")).alias("text"), (user & (k % 6 == 0)).alias("synthetic")),
            F.when(~user & (k % 4 == 0), F.struct(F.lit("reasoning").alias("type"), F.lit("think").alias("text"), F.lit(False).alias("synthetic"))),
            F.when(tool.isNotNull(), F.struct(F.lit("tool_call").alias("type"), F.lit("").alias("text"), F.lit(False).alias("synthetic"))),
            F.when((F.col("event_type") == "purchase") & (k % 3 == 0), F.struct(F.lit("patch").alias("type"), F.lit("").alias("text"), F.lit(False).alias("synthetic"))),
            F.when((tool == "TodoWrite") & (k % 5 == 0), F.struct(F.lit("snapshot").alias("type"), F.lit("").alias("text"), F.lit(False).alias("synthetic"))),
        )
    )
    parts = rows.select(
        "traj_id", "step_idx", "slice", F.posexplode(part_type).alias("part_pos", "_p"),
        file.alias("_file"), todos.alias("_todos"),
    ).select(
        "traj_id", "step_idx", "slice", "part_pos", "_p.type", "_p.text", "_p.synthetic",
        F.when(F.col("_p.type") == "patch", F.array("_file")).alias("files"),
        F.when(F.col("_p.type") == "snapshot", F.col("_todos")).alias("items"),
    )
    return Runs(conform(steps, STEPS), conform(calls, CALLS), conform(parts, PARTS))


def order_runs(spark: SparkSession, folder: str, positions: bool = True) -> Runs:
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("traj_id"), "o_orderkey", "o_totalprice",
        _millis("o_orderdate").alias("time_created_ms"),
    )
    orders = with_slice(dense_index(orders, "traj_id", F.col("time_created_ms"), ["o_orderkey"]))
    duration = F.lit(60) + F.col("o_orderkey") % 60
    lines = table(spark, folder, "lineitem")
    if positions:
        lines = dense_index(
            lines, "l_orderkey", F.col("l_linenumber"),
            ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], name="call_pos",
        )
    else:
        lines = lines.withColumn("call_pos", F.lit(0))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    total = F.floor("o_totalprice").cast("bigint")
    steps = orders.select(
        "traj_id", "step_idx", "slice",
        F.lit("assistant").alias("role"), F.lit("").alias("agent"), F.lit("").alias("finish"),
        duration.cast("double").alias("duration"),
        "time_created_ms",
        (F.col("time_created_ms") + duration * 1000).alias("time_completed_ms"),
        token_struct(total=total, output=total).alias("tokens"),
        "o_orderkey",
    )
    kind = F.element_at(
        F.array(*[F.lit(n) for n in ("Read", "Grep", "Glob", "Bash", "Edit", "Write", "mcp__srv__run", "Task")]),
        (F.col("l_partkey") % 8 + 1).cast("int"),
    )
    start = F.col("time_created_ms") + F.col("l_linenumber").cast("bigint") * 1000
    calls = lines.select(
        "traj_id", "step_idx", "slice",
        "call_pos",
        kind.alias("tool_name"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"),
        call_input(
            file_path=F.concat(F.lit("/w/p"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".py"))
        ).alias("input"),
        start.alias("time_start"),
        (start + F.floor(F.col("l_quantity") * 1000).cast("bigint")).alias("time_end"),
    )
    counts = calls.groupBy("traj_id", "step_idx").agg(
        F.count("*").alias("tool_call_count"), F.count_if(F.col("status") == "failed").alias("error_count")
    )
    steps = steps.join(counts, ["traj_id", "step_idx"], "left").fillna(0, ["tool_call_count", "error_count"])
    parts = spark.createDataFrame([], PARTS)
    return Runs(conform(steps, STEPS), conform(calls, CALLS), parts)


def chat_runs(spark: SparkSession, folder: str) -> Runs:
    rows = with_slice(
        table(spark, folder, "conversations").select(
            F.col("conv_id").alias("traj_id"), F.col("turn").alias("step_idx"), "role", "text"
        )
    )
    steps = rows.select(
        "traj_id", "step_idx", "slice", "role", F.lit("").alias("agent"), F.col("text").alias("text_preview"),
        token_struct().alias("tokens"), F.lit(0).alias("error_count"), F.lit(0).alias("tool_call_count"),
    )
    parts = rows.select(
        "traj_id", "step_idx", "slice", F.lit(0).alias("part_pos"), F.lit("text").alias("type"), "text",
        F.lit(False).alias("synthetic"),
    )
    return Runs(conform(steps, STEPS), conform(spark.createDataFrame([], CALLS), CALLS), conform(parts, PARTS))
