"""Per-run metrics. Every function takes silver tables and returns one row per run unless it says otherwise.

Rates and ratios stay unrounded; seconds are summed as integers or decimals, so a result does not depend
on how Spark happened to split the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import agents, calls as fc, tokens as ft
from runloom.operators.slices import carry, nearest_rank, neighbours

STEP = ["traj_id", "slice", "step_idx"]
def assistant() -> Column:
    return F.col("role") == "assistant"


def exact_sum(seconds: Column) -> Column:
    return F.sum(seconds.cast("decimal(18,3)")).cast("double")


def _bigint_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def token_sums() -> list[Column]:
    """Sum of usable values and number of rejected ones, for every token field."""
    out = []
    for name in vocab.TOKEN_FIELDS:
        value = F.col(f"tokens.{name}")
        out.append(_bigint_sum(ft.usable(value)).alias(f"{name}_tokens"))
        out.append(F.count_if(value.isNotNull() & ft.usable(value).isNull()).alias(f"{name}_unusable"))
    return out


def usable_token_sums(steps: DataFrame, keys=("traj_id",)) -> DataFrame:
    return steps.groupBy(*keys).agg(*token_sums())


def duration_stats(steps: DataFrame) -> DataFrame:
    basic = steps.groupBy("traj_id").agg(
        F.count("*").alias("total_steps"),
        exact_sum(F.col("duration")).alias("total_duration"),
        (exact_sum(F.col("duration")) / F.count("duration")).alias("avg_duration"),
        F.max("duration").alias("max_duration"),
    )
    ranks = nearest_rank(steps, ["traj_id"], F.col("duration"), {"p95_duration": 0.95}, "median_duration")
    return basic.join(ranks, "traj_id", "left")


def wall_clock_columns() -> Column:
    """Span of the step stamps, else the summed durations."""
    span = (
        F.greatest(F.max("time_created_ms"), F.max("time_completed_ms"))
        - F.least(F.min("time_created_ms"), F.min("time_completed_ms"))
    ) / 1000
    stamps = F.count("time_created_ms") + F.count("time_completed_ms")
    return F.coalesce(F.when((stamps >= 2) & (span > 0), span), exact_sum(F.col("duration")), F.lit(0.0))


def wall_clock(steps: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Seconds on the clock; a positive ``total_duration`` reported for the run wins."""
    derived = steps.groupBy("traj_id").agg(wall_clock_columns().alias("wall_clock"))
    if sessions is None:
        return derived
    stated = sessions.filter("total_duration > 0").select("traj_id", F.col("total_duration").alias("_stated"))
    out = derived.join(stated, "traj_id", "left")
    return out.select("traj_id", F.coalesce("_stated", "wall_clock").alias("wall_clock"))


def call_rollup(calls: DataFrame) -> DataFrame:
    """One row per step with calls: counts, union of non-spawn windows, longest spawn wait.

    The calls of one step are the parallel calls of one model message, so a window over them is small.
    The union of windows is the part of each window, in start order, past everything before it.
    """
    timed = calls.select(
        *STEP, "call_pos", "tool_name", fc.failed().alias("failed"), fc.is_tool(vocab.SPAWN_TOOLS).alias("spawn"),
        fc.duration_ms().alias("ms"), fc.window_ms().alias("win"),
    )
    open_ = ~F.col("spawn") & F.col("ms").isNotNull()
    timed = timed.withColumn("win", F.when(open_, F.col("win")))
    order = Window.partitionBy(*STEP).orderBy("win.start", "win.end").rowsBetween(Window.unboundedPreceding, -1)
    timed = timed.withColumn("_to", F.max("win.end").over(order))
    fresh = F.greatest(F.lit(0), F.col("win.end") - F.greatest(F.col("win.start"), F.coalesce("_to", "win.start")))
    return timed.groupBy(*STEP).agg(
        F.count("*").alias("calls"),
        F.count_if("failed").alias("failed_calls"),
        (_bigint_sum(fresh) + F.coalesce(F.sum(F.when(open_ & F.col("win").isNull(), F.col("ms"))), F.lit(0.0))).alias("tool_ms"),
        F.coalesce(F.max(F.when(F.col("spawn"), F.col("ms"))), F.lit(0.0)).alias("spawn_ms"),
        F.count_if(F.col("spawn") & F.col("ms").isNotNull()).alias("delegated_calls"),
        F.coalesce(F.sum(F.when(~F.col("spawn"), F.col("ms"))), F.lit(0.0)).alias("tool_sum_ms"),
        F.count_if(open_).alias("timed_calls"),
    )


def with_calls(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Steps with their call rollup and the time split tool / spawn / generation in milliseconds."""
    zero = ["calls", "failed_calls", "tool_ms", "spawn_ms", "delegated_calls", "tool_sum_ms", "timed_calls"]
    out = steps.join(call_rollup(calls), STEP, "left").fillna(0, zero)
    own = F.round(F.col("duration") * 1000)
    rest = F.greatest(F.lit(0.0), own - F.col("spawn_ms"))
    waited = F.least(F.col("tool_ms"), rest)
    return out.withColumns({"rest_ms": F.when(F.col("duration").isNotNull(), rest), "wait_ms": waited}).withColumn(
        "generation_ms", F.col("rest_ms") - F.col("wait_ms")
    )


def step_time_split(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Per step: spawn wait, tool seconds, duration without spawn, generation seconds."""
    return with_calls(steps, calls).select(
        "traj_id", "step_idx",
        (F.col("spawn_ms") / 1000).alias("spawn_wait_s"),
        (F.col("rest_ms") / 1000).alias("duration_excl_spawn_s"),
        (F.col("tool_ms") / 1000).alias("tool_s"),
        (F.col("generation_ms") / 1000).alias("generation_s"),
        (F.when(F.col("rest_ms").isNotNull(), F.col("wait_ms")) / 1000).alias("tool_wait_s"),
    )


def cache_columns(steps: DataFrame) -> DataFrame:
    share = ft.cache_share(F.col("tokens.cache_read"), F.col("tokens.total"))
    return steps.withColumns({"share": share, "fresh": ft.step_segments()["fresh"]})


def token_stats(steps: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Totals, fresh input, rates and cache shares.

    The mean cache share is withheld when any assistant step with tokens reports an impossible one.
    ``sessions`` may add ``patch_lines`` and ``churn`` for tokens per changed line.
    """
    rows = cache_columns(steps)
    rated = assistant() & (F.col("tokens.total") > 0)
    unusable = F.count_if(rated & F.col("share").isNull())
    # A share is summed as a decimal of 15 digits: exact, and the same however the rows are split.
    mean = (F.sum(F.when(rated, F.col("share")).cast("decimal(20,15)")) / F.count(F.when(rated, F.col("share")))).cast("double")
    total, inp, out = F.col("total_tokens"), F.col("input_tokens"), F.col("output_tokens")
    sums = rows.groupBy("traj_id").agg(
        *token_sums(),
        _bigint_sum(F.col("fresh")).alias("fresh_tokens"),
        F.count("*").alias("steps"),
        F.count_if(assistant()).alias("assistant_steps"),
        F.count_if(F.col("role") == "user").alias("user_steps"),
        exact_sum(F.col("duration")).alias("seconds"),
        unusable.alias("cache_unusable_steps"),
        F.when(unusable == 0, mean).alias("avg_cache_ratio"),
        F.count_if(rated & (F.col("share") >= 0.9)).alias("cache_dominant_steps"),
    )
    ranks = nearest_rank(
        rows.filter(assistant()), ["traj_id"], F.col("tokens.total"), {"p95_step_tokens": 0.95}, "median_step_tokens"
    )
    speeds = nearest_rank(
        rows.filter(assistant() & (F.col("duration") > 0)), ["traj_id"],
        F.col("tokens.total") / F.col("duration"), {}, "median_tokens_per_second",
    )
    wide = sums.join(ranks, "traj_id", "left").join(speeds, "traj_id", "left")
    if sessions is not None:
        lines = sessions.select("traj_id", "patch_lines", "churn")
        wide = wide.join(lines, "traj_id", "left").withColumns(
            {
                "tokens_per_patch_line": F.when(F.col("patch_lines") > 0, (inp + out) / F.col("patch_lines")),
                "tokens_per_churn_line": F.when(F.col("churn") > 0, (inp + out) / F.col("churn")),
            }
        ).drop("patch_lines", "churn")
    return wide.withColumns(
        {
            "fresh_ratio": F.when(total > 0, F.col("fresh_tokens") / total).otherwise(0.0),
            "avg_tokens_per_step": total / F.col("steps"),
            "avg_tokens_per_assistant_step": F.when(F.col("assistant_steps") > 0, total / F.col("assistant_steps")),
            "tokens_per_second": F.when(F.col("seconds") > 0, total / F.col("seconds")),
            "output_input_ratio": F.when(inp > 0, out / inp),
        }
    )


def tool_breakdown(calls: DataFrame) -> DataFrame:
    """Long form: calls per (run, tool name) and (run, status)."""
    kinds = calls.select(
        "traj_id",
        F.explode(
            F.array(
                F.struct(F.lit("tool").alias("kind"), F.col("tool_name").alias("name")),
                F.struct(F.lit("status").alias("kind"), F.coalesce("status", F.lit("?")).alias("name")),
            )
        ).alias("_x"),
    )
    return kinds.groupBy("traj_id", "_x.kind", "_x.name").agg(F.count("*").alias("calls"))


def tool_stats(steps: DataFrame, calls: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Counts, success, timing and delegation. Untimed exports get null, never zero."""
    rows = with_calls(steps, calls)
    if parts is not None:
        patched = parts.filter("type = 'patch'").select(*STEP).distinct().withColumn("patched", F.lit(True))
        rows = rows.join(patched, STEP, "left")
    else:
        rows = rows.withColumn("patched", F.lit(None).cast("boolean"))
    sums = rows.groupBy("traj_id").agg(
        _bigint_sum(F.col("tool_call_count")).alias("tool_calls"),
        _bigint_sum(F.col("failed_calls")).alias("tool_fail"),
        _bigint_sum(F.col("calls")).alias("_calls"),
        (F.sum("tool_ms") / 1000).alias("_tool_s"),
        (F.sum("tool_sum_ms") / 1000).alias("_sum_s"),
        F.sum("timed_calls").alias("_timed"),
        (F.sum("spawn_ms") / 1000).alias("_spawn_s"),
        _bigint_sum(F.col("delegated_calls")).alias("delegated_calls"),
        F.count_if(assistant() & (F.col("tool_call_count") >= 2)).alias("multi_tool_steps"),
        F.count_if(assistant() & (F.col("tool_call_count") == 0)).alias("no_tool_steps"),
        F.count_if(assistant() & F.col("patched")).alias("patch_steps"),
        _bigint_sum(ft.usable(F.col("tokens.total"))).alias("_tokens"),
        wall_clock_columns().alias("_wall"),
    )
    each = calls.filter(~fc.is_tool(vocab.SPAWN_TOOLS)).select("traj_id", fc.duration_ms().alias("ms"))
    ranks = nearest_rank(each, ["traj_id"], F.col("ms"), {"p95_tool_ms": 0.95, "max_tool_ms": 1.0})
    timed = (F.col("_timed") > 0) | (F.col("_tool_s") > 0)
    clock = F.col("_wall") > 0
    return sums.join(ranks, "traj_id", "left").select(
        "traj_id", "tool_calls",
        (F.col("_calls") - F.col("tool_fail")).alias("tool_success"),
        "tool_fail",
        F.when(F.col("tool_calls") > 0, (F.col("_calls") - F.col("tool_fail")) / F.col("tool_calls")).alias("tool_success_rate"),
        F.when(F.col("tool_calls") > 0, F.col("_tokens") / F.col("tool_calls")).alias("tokens_per_tool"),
        F.when(timed, F.col("_tool_s")).alias("tool_time_total"),
        F.when(timed & clock, F.col("_tool_s") / F.col("_wall")).alias("tool_wait_share"),
        F.when(timed, F.coalesce(F.col("_sum_s") / F.when(F.col("_timed") > 0, F.col("_timed")), F.lit(0.0))).alias("avg_tool_duration"),
        (F.col("p95_tool_ms") / 1000).alias("p95_tool_duration"),
        (F.col("max_tool_ms") / 1000).alias("max_tool_duration"),
        F.when(F.col("delegated_calls") > 0, F.col("_spawn_s")).alias("delegation_time_total"),
        "delegated_calls", "multi_tool_steps", "no_tool_steps", "patch_steps",
        F.when(clock, F.col("tool_calls") / (F.col("_wall") / 60)).alias("tool_calls_per_min"),
    )


def breakdowns(steps: DataFrame, parts: DataFrame) -> DataFrame:
    """Long form: steps per role, agent, model, finish reason; parts per type."""
    pairs = F.array_compact(
        F.array(
            F.struct(F.lit("role").alias("kind"), F.col("role").alias("name")),
            *[
                F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("name")))
                for kind, value in (
                    ("agent", agents.effective_agent()), ("model", F.col("model_id")), ("finish", F.col("finish")),
                )
            ],
        )
    )
    by_step = steps.select("traj_id", F.explode(pairs).alias("_x")).select("traj_id", "_x.kind", "_x.name")
    by_part = parts.select("traj_id", F.lit("part").alias("kind"), F.col("type").alias("name"))
    return by_step.unionByName(by_part).groupBy("traj_id", "kind", "name").agg(F.count("*").alias("n"))


def efficiency_stats(steps: DataFrame) -> DataFrame:
    users, assistants = F.count_if(F.col("role") == "user"), F.count_if(assistant())
    turns = steps.groupBy("traj_id").agg(
        users.alias("user_turns"), assistants.alias("assistant_turns"),
        F.when(users + assistants > 0, assistants / (users + assistants)).alias("autonomy_ratio"),
    )
    ranks = nearest_rank(
        steps.filter(assistant()), ["traj_id"], F.col("duration"),
        {"p50_duration": 0.5, "p90_duration": 0.9, "p99_duration": 0.99},
    )
    return turns.join(ranks, "traj_id", "left")


def command_metrics(calls: DataFrame) -> DataFrame:
    """Runs with at least one call that reports an exit code; a null code counts but is no failure."""
    rows = calls.filter("exit_present").groupBy("traj_id").agg(
        F.count("*").alias("commands"), F.count_if(F.coalesce(F.col("exit_code") != 0, F.lit(False))).alias("command_failures")
    )
    return rows.withColumn("command_success_rate", (F.col("commands") - F.col("command_failures")) / F.col("commands"))


def response_latency(steps: DataFrame) -> DataFrame:
    """First user stamp to the first and the last completed assistant answer, in seconds."""
    asked = F.when((F.col("role") == "user") & F.col("time_created_ms").isNotNull(), F.col("step_idx"))
    done = F.when(assistant() & F.col("time_completed_ms").isNotNull(), F.col("step_idx"))
    start = F.min_by("time_created_ms", asked)
    return steps.groupBy("traj_id").agg(
        ((F.min_by("time_completed_ms", done) - start) / 1000).alias("first_response_s"),
        ((F.max_by("time_completed_ms", done) - start) / 1000).alias("full_response_s"),
    )


def throughput_columns() -> list[Column]:
    timed = assistant() & (F.col("duration") > 0) & (F.col("tokens.output") >= 0) & (F.col("generation_ms") > 0)
    tokens, seconds = F.sum(F.when(timed, F.col("tokens.output"))), F.sum(F.when(timed, F.col("generation_ms"))) / 1000
    n, whole = F.count_if(timed), F.count_if(assistant())
    return [
        F.when((seconds > 0) & (tokens > 0), tokens / seconds).alias("output_tokens_per_sec"),
        n.alias("timed_steps"), whole.alias("assistant_steps"),
        F.when(whole > 0, n / whole).alias("timed_coverage"),
        (n < whole).alias("timing_incomplete"),
        F.coalesce(tokens, F.lit(0)).alias("timed_tokens"),
        F.coalesce(seconds, F.lit(0.0)).alias("timed_seconds"),
        F.coalesce(F.sum(F.when(timed, F.col("wait_ms"))) / 1000, F.lit(0.0)).alias("tool_wait_seconds"),
    ]


def throughput(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Output tokens per second of generation, both taken from the same timed assistant steps."""
    return with_calls(steps, calls).groupBy("traj_id").agg(*throughput_columns())


def plan_snapshot_metrics(parts: DataFrame) -> DataFrame:
    """Items in the first plan snapshot, completion of the last one, number of snapshots."""
    snaps = parts.filter((F.col("type") == "snapshot") & F.col("items").isNotNull())
    at = F.struct("step_idx", "part_pos")
    done = F.size(F.filter("items", lambda item: item["status"].isin("completed", "done")))
    facts = snaps.select(
        "traj_id", at.alias("at"), F.size("items").alias("n"), F.when(F.size("items") > 0, done / F.size("items")).alias("ratio")
    )
    return facts.groupBy("traj_id").agg(
        F.min_by("n", "at").cast("bigint").alias("plan_items"),
        F.max_by("ratio", "at").alias("plan_completion_ratio"),
        F.count("*").alias("plan_updates"),
    )


def part_counts(parts: DataFrame) -> DataFrame:
    kinds = ("reasoning", "text", "patch")
    mix = F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("type") != "", F.col("type")))))
    return parts.groupBy(*STEP).agg(
        *[F.count_if(F.col("type") == k).alias(f"{k}_parts") for k in kinds], mix.alias("part_mix")
    )


def _per_second(amount: Column) -> Column:
    return F.when(F.col("duration") > 0, amount / F.col("duration"))


def message_metrics(steps: DataFrame, calls: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per step: tokens, rates, tool time, part counts."""
    rows = cache_columns(with_calls(steps, calls)).join(part_counts(parts), STEP, "left")
    tool_s, total = F.col("tool_ms") / 1000, F.col("tokens.total")
    return rows.select(
        "traj_id", "step_idx", "role", agents.effective_agent().alias("agent"), "model_id", "finish", "duration",
        total.alias("tokens_total"), F.col("tokens.input").alias("tokens_input"),
        F.col("tokens.output").alias("tokens_output"), F.col("tokens.cache_read").alias("cache_read"),
        F.col("fresh").alias("fresh_tokens"), F.col("share").alias("cache_ratio"),
        _per_second(total).alias("tokens_per_sec"), _per_second(F.col("fresh")).alias("fresh_per_sec"),
        F.when(F.col("tokens.input") > 0, F.col("tokens.output") / F.col("tokens.input")).alias("output_input_ratio"),
        F.col("tool_call_count").alias("tool_calls"), F.col("error_count").alias("errors"),
        tool_s.alias("tool_time_s"), F.coalesce(_per_second(tool_s), F.lit(0.0)).alias("tool_time_share"),
        *[F.coalesce(f"{k}_parts", F.lit(0)).alias(f"{k}_parts") for k in ("reasoning", "text", "patch")],
    )


def step_analytics(steps: DataFrame, calls: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per step: rates, part mix, and the idle gap since the step before it."""
    rows = neighbours(steps, lambda w: {"_done": F.lag("time_completed_ms").over(w)}, before=1)
    rows = cache_columns(with_calls(rows, calls)).join(part_counts(parts).select(*STEP, "part_mix"), STEP, "left")
    return rows.select(
        "traj_id", "step_idx", "role", "agent", "model_id", F.col("duration").alias("duration_s"),
        F.col("tool_sum_ms").alias("tool_time_ms"),
        _per_second(F.col("tool_sum_ms") / 1000).alias("tool_time_share"),
        F.col("tokens.total").alias("tok_total"), _per_second(F.col("tokens.total")).alias("tok_per_s"),
        F.col("share").alias("cache_ratio"), F.col("fresh").alias("fresh_tok"),
        F.when(F.col("tokens.input") > 0, F.col("tokens.output") / F.col("tokens.input")).alias("out_in_ratio"),
        F.col("tool_call_count").alias("tool_calls"), "finish", F.coalesce("part_mix", F.lit("")).alias("part_mix"),
        ((F.col("time_created_ms") - F.col("_done")) / 1000).alias("idle_before_s"),
    )


def edit_precision(calls: DataFrame) -> DataFrame:
    rows = calls.withColumns({"_w": fc.is_tool(vocab.WRITE_TOOLS), "_f": fc.failed()}).groupBy("traj_id").agg(
        F.count_if("_f").alias("failed_calls"),
        F.count_if("_w").alias("edits"),
        F.count_if(F.col("_w") & ~F.col("_f")).alias("edit_success"),
    )
    return rows.withColumn("edit_precision", F.when(F.col("edits") > 0, F.col("edit_success") / F.col("edits")))


def verdict_columns() -> dict[str, Column]:
    """Verdict status per metric over avg_cache_ratio, tool_success_rate, output_tokens_per_sec, tool_fail."""

    def grade(value: Column, good: float, warn: float) -> Column:
        return F.when(value >= good, "good").when(value >= warn, "warn").otherwise("bad")

    cache, rate, speed = F.col("avg_cache_ratio"), F.col("tool_success_rate"), F.col("output_tokens_per_sec")
    # Rates are graded as they are shown: percent with one decimal.
    percent = lambda c: F.round(c * 100, 1)
    return {
        "Cache Efficiency": F.when(F.col("total_tokens") == 0, "good").when(cache.isNull(), "warn").otherwise(grade(percent(cache), 60, 30)),
        "Tool Success": F.when(F.col("tool_calls") == 0, "good").otherwise(grade(percent(rate), 95, 80)),
        "Throughput": F.when(speed.isNull(), "good").otherwise(grade(F.round(speed, 1), 50, 20)),
        "Errors": F.when(F.col("tool_fail") == 0, "good").when(F.col("tool_fail") <= 2, "warn").otherwise("bad"),
    }


def health_verdicts(scorecard: DataFrame) -> DataFrame:
    """Long form: one row per run and metric."""
    verdicts = F.array(
        *[F.struct(F.lit(name).alias("metric"), status.alias("status")) for name, status in verdict_columns().items()]
    )
    return scorecard.select("traj_id", F.explode(verdicts).alias("_v")).select("traj_id", "_v.metric", "_v.status")


def agent_info(steps: DataFrame) -> DataFrame:
    """Model and provider of the last assistant step naming a model; first named agent."""
    named = F.when(assistant() & (F.col("model_id") != ""), F.col("step_idx"))
    vendor = F.when(assistant() & (F.col("model_id") != "") & (F.col("provider_id") != ""), F.col("step_idx"))
    with_model = F.when(assistant() & (F.col("model_id") != "") & (F.col("agent") != ""), F.col("step_idx"))
    any_agent = F.when(F.col("agent") != "", F.col("step_idx"))
    return steps.groupBy("traj_id").agg(
        F.coalesce(F.max_by("model_id", named), F.lit("")).alias("model_id"),
        F.coalesce(F.max_by("provider_id", vendor), F.lit("")).alias("provider_id"),
        F.coalesce(F.min_by("agent", with_model), F.min_by("agent", any_agent), F.lit("")).alias("agent_id"),
    )


def agent_summary(steps: DataFrame, spawns: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """One row per (run, agent) over assistant steps, with the order of first appearance.

    ``spawns`` (traj_id, agent_id, spawned_by) and ``calls`` add the step that started the agent.
    """
    rows = steps.filter(assistant()).withColumn("agent_id", agents.effective_agent())
    out = rows.groupBy("traj_id", "agent_id").agg(
        *token_sums(),
        F.count("*").alias("steps"),
        F.coalesce(exact_sum(F.col("duration")), F.lit(0.0)).alias("seconds"),
        _bigint_sum(F.col("tool_call_count")).alias("tool_calls"),
        _bigint_sum(F.col("error_count")).alias("errors"),
        F.min("step_idx").alias("first_step"),
    )
    out = out.withColumns(
        {
            "cache_share": ft.cache_share(F.col("cache_read_tokens"), F.col("total_tokens")),
            "tokens_per_second": F.when(F.col("seconds") > 0, F.col("total_tokens") / F.col("seconds")).otherwise(0.0),
        }
    )
    if spawns is not None and calls is not None:
        at = calls.filter("tool_id <> ''").groupBy("traj_id", F.col("tool_id").alias("spawned_by")).agg(
            F.max("step_idx").alias("spawned_by_step")
        )
        out = out.join(spawns, ["traj_id", "agent_id"], "left").join(at, ["traj_id", "spawned_by"], "left")
    return out


def agent_insights(summary: DataFrame) -> DataFrame:
    """Agents that dominate tokens or tool calls, never hit the cache, or fail often."""
    totals = summary.groupBy("traj_id").agg(
        F.count("*").alias("_agents"), F.sum("total_tokens").alias("_tokens"), F.sum("tool_calls").alias("_calls")
    )
    rows = summary.join(totals, "traj_id").filter("_agents > 1 AND _tokens > 0")
    share, errors = F.col("total_tokens") / F.col("_tokens"), F.col("errors") / F.col("steps")
    calls = F.col("tool_calls") / F.greatest(F.lit(1), F.col("_calls"))
    found = F.array_compact(
        F.array(
            F.when(share > 0.6, F.struct(F.lit("token_share").alias("insight"), share.alias("value"))),
            F.when(
                (F.col("cache_share") == 0) & (F.col("total_tokens") > 0) & (F.col("cache_read_tokens") == 0),
                F.struct(F.lit("no_cache").alias("insight"), F.lit(0.0).alias("value")),
            ),
            F.when(errors > 0.1, F.struct(F.lit("error_rate").alias("insight"), errors.alias("value"))),
            F.when(calls > 0.7, F.struct(F.lit("call_share").alias("insight"), calls.alias("value"))),
        )
    )
    return rows.select("traj_id", "agent_id", F.explode(found).alias("_f")).select("traj_id", "agent_id", "_f.insight", "_f.value")


def scorecard(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """The headline row per run, from one pass over steps joined with their calls."""
    rows = cache_columns(with_calls(steps, calls))
    rated = assistant() & (F.col("tokens.total") > 0)
    mean = (F.sum(F.when(rated, F.col("share")).cast("decimal(20,15)")) / F.count(F.when(rated, F.col("share")))).cast("double")
    return rows.groupBy("traj_id").agg(
        F.count("*").alias("steps"),
        _bigint_sum(ft.usable(F.col("tokens.total"))).alias("total_tokens"),
        F.when(F.count_if(rated & F.col("share").isNull()) == 0, mean).alias("avg_cache_ratio"),
        _bigint_sum(F.col("tool_call_count")).alias("tool_calls"),
        _bigint_sum(F.col("failed_calls")).alias("tool_fail"),
        F.when(F.sum("calls") > 0, (F.sum("calls") - F.sum("failed_calls")) / F.sum("calls")).alias("tool_success_rate"),
        wall_clock_columns().alias("wall_clock"),
        throughput_columns()[0],
    )
