"""Order-aware patterns of a run: phases, chains, streaks, repeated work, plans, n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import calls as fc
from runloom.operators.slices import SLICE, carry, islands, neighbours, running, with_slice

STEP = ["traj_id", "slice", "step_idx"]
def assistant() -> Column:
    return F.col("role") == "assistant"


def first_steps(steps: DataFrame, limit: int | None) -> DataFrame:
    """Keep the first ``limit`` steps of every run (None keeps all)."""
    return steps if limit is None else steps.filter(F.col("step_idx") < limit)


def truncation(steps: DataFrame, limit: int = 2000) -> DataFrame:
    n = F.count("*")
    return steps.groupBy("traj_id").agg(
        F.least(n, F.lit(limit)).alias("kept"), n.alias("total"), (n > limit).alias("truncated")
    )


# ---- phases ---------------------------------------------------------------------------------------


def step_flags(calls: DataFrame) -> DataFrame:
    """What the calls of each step did."""
    flags = {
        "plans": fc.is_plan(),
        "writes": fc.is_tool(vocab.WRITE_TOOLS),
        "reads": fc.is_tool(vocab.READ_TOOLS + vocab.SEARCH_TOOLS),
        "fails": fc.failed(),
        "validates": fc.is_validation(F.col("input.command")),
        "succeeds": ~fc.failed(),
    }
    rows = calls.select(*STEP, *[c.alias(n) for n, c in flags.items()])
    return rows.groupBy(*STEP).agg(*[F.bool_or(n).alias(n) for n in flags])


def step_phases(steps: DataFrame, calls: DataFrame, parts: DataFrame) -> DataFrame:
    """Workflow phase of every step; 'unknown' where nothing tells."""
    snapshots = parts.filter((F.col("type") == "snapshot") & F.col("items").isNotNull())
    snapshots = snapshots.select(*STEP).distinct().withColumn("snapshot", F.lit(True))
    rows = steps.select(*STEP, "role", "finish", "tool_call_count").join(step_flags(calls), STEP, "left")
    rows = rows.join(snapshots, STEP, "left")
    phase = (
        F.when(~assistant(), "unknown")
        .when(F.col("snapshot"), "plan")
        .when(F.col("plans"), "plan")
        .when(F.col("writes"), "implement")
        .when(F.col("validates"), "validate")
        .when(F.col("fails"), "debug")
        .when(F.col("reads"), "understand")
        .when(F.col("finish").isin("stop", "end_turn") | (F.col("tool_call_count") == 0), "report")
        .otherwise("unknown")
    )
    return rows.select(*STEP, phase.alias("phase"), F.coalesce("plans", F.lit(False)).alias("plans"))


def phase_segments(phases: DataFrame) -> DataFrame:
    """Maximal stretches of one phase; unknown steps are passed over."""
    rows = islands(phases.filter("phase <> 'unknown'"), ["phase"])
    return rows.groupBy("traj_id", F.col("island").alias("start_idx")).agg(
        F.min("phase").alias("phase"), F.max("step_idx").alias("end_idx"), F.count("*").alias("steps")
    )


def phase_anomalies(steps: DataFrame, phases: DataFrame, segments: DataFrame) -> DataFrame:
    """Backward transitions between neighbouring segments.

    Intentional when one of the three steps before it used a plan tool.
    """
    rank = F.create_map(*[F.lit(x) for pair in vocab.PHASE_RANK.items() for x in pair])
    seg = with_slice(segments, idx="start_idx").withColumn("rank", rank[F.col("phase")])
    seg = carry(seg, {"_prev": F.struct("phase", "rank")}, order=["start_idx"])
    seg = seg.filter(F.col("rank") < F.col("_prev.rank"))
    planned = neighbours(
        phases.select(*STEP, "plans"),
        lambda w: {"planned": F.max("plans").over(w.rangeBetween(-3, -1))},
        before=3,
    ).filter("planned").select("traj_id", F.col("step_idx").alias("start_idx"), "planned")
    totals = steps.groupBy("traj_id").agg(F.count("*").alias("_n"))
    rows = seg.join(planned, ["traj_id", "start_idx"], "left").join(totals, "traj_id")
    return rows.select(
        "traj_id",
        F.col("_prev.phase").alias("from_phase"),
        F.col("phase").alias("to_phase"),
        F.col("start_idx").alias("step_idx"),
        (F.col("end_idx") - F.col("start_idx") + 1).alias("span"),
        ((F.col("end_idx") - F.col("start_idx") + 1) / F.col("_n")).alias("span_fraction"),
        F.when(F.col("planned"), "intentional_iteration").otherwise("unintentional_drift").alias("category"),
    )


# ---- failures -------------------------------------------------------------------------------------


def failure_chains(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Maximal runs of consecutive assistant steps with a failure; user steps do not break a run."""
    failing = calls.filter(fc.failed()).select(*STEP).distinct().withColumn("_f", F.lit(True))
    rows = steps.filter(assistant()).select(*STEP, "error_count").join(failing, STEP, "left")
    rows = rows.select(*STEP, ((F.col("error_count") > 0) | F.coalesce("_f", F.lit(False))).alias("bad"))
    chains = islands(rows, ["bad"]).filter("bad")
    return chains.groupBy("traj_id", F.col("island").alias("start")).agg(
        F.max("step_idx").alias("end"), F.count("*").alias("length")
    )


def failure_chain_metrics(steps: DataFrame, chains: DataFrame) -> DataFrame:
    whole = steps.groupBy("traj_id").agg(F.count_if(assistant()).alias("_n"))
    sums = chains.groupBy("traj_id").agg(
        F.count("*").alias("chains"), F.sum("length").alias("chain_steps"), F.max("length").alias("longest")
    )
    rows = whole.join(sums, "traj_id", "left").fillna(0, ["chains", "chain_steps", "longest"])
    share = F.when(F.col("_n") > 0, F.col("chain_steps") / F.col("_n")).otherwise(0.0)
    return rows.select("traj_id", "chains", "chain_steps", "longest", share.alias("chain_step_share"))


def error_rows(calls: DataFrame) -> DataFrame:
    """Failed calls with the label and the pattern they cluster by."""
    return calls.filter(fc.failed()).select(
        *STEP, "call_pos", fc.chart_name().alias("tool"), fc.error_pattern().alias("pattern"), fc.error_kind().alias("error_class")
    )


def error_clusters(calls: DataFrame) -> DataFrame:
    """One row per (run, tool label, error pattern)."""
    by_step = error_rows(calls).groupBy("traj_id", "tool", "pattern", "step_idx").agg(
        F.count("*").alias("n"), F.min_by("error_class", "call_pos").alias("error_class")
    )
    return by_step.groupBy("traj_id", "tool", "pattern").agg(
        F.sum("n").alias("count"), F.count("*").alias("steps"), F.min("step_idx").alias("first_step"),
        F.max("step_idx").alias("last_step"), F.min_by("error_class", "step_idx").alias("error_class"),
    )


def error_cluster_steps(calls: DataFrame) -> DataFrame:
    """The member steps of every cluster, one row each."""
    return error_rows(calls).select("traj_id", "tool", "pattern", "step_idx").distinct()


def root_cause_summary(clusters: DataFrame) -> DataFrame:
    """A sentence per cluster; clusters may carry parent_agent / parent_step."""
    where = F.when(
        F.col("first_step") != F.col("last_step"), F.format_string("steps %d..%d", "first_step", "last_step")
    ).otherwise(F.format_string("step %d", "first_step"))
    text = F.concat(
        F.format_string("%dx %s failures: '%s' (", "count", "tool", "pattern"), where, F.lit(")")
    )
    if "parent_step" in clusters.columns:
        trace = F.format_string(" — traced to %s step %d", "parent_agent", "parent_step")
        text = F.concat(text, F.when(F.col("parent_step").isNotNull(), trace).otherwise(""))
    return clusters.select("traj_id", "tool", "pattern", text.alias("summary"))


def with_spawn(rows: DataFrame, steps: DataFrame, summary: DataFrame, first: str) -> DataFrame:
    """Where the first step of a chain or cluster ran in a spawned agent, the step that spawned it."""
    from runloom.functions.agents import effective_agent

    who = steps.select("traj_id", F.col("step_idx").alias(first), effective_agent().alias("agent_id"))
    born = summary.filter("spawned_by_step is not null").select("traj_id", "agent_id", F.col("spawned_by_step").alias("parent_step"))
    out = rows.join(who, ["traj_id", first], "left").join(born, ["traj_id", "agent_id"], "left")
    known = F.col("parent_step").isNotNull() & (F.col("agent_id") != "")
    return out.withColumns(
        {"parent_agent": F.when(known, "main"), "parent_step": F.when(known, F.col("parent_step"))}
    ).drop("agent_id")


def recovery_paths(steps: DataFrame, calls: DataFrame, reach: int = 20) -> DataFrame:
    """Per failing step: tool names up to and with the next step that has a successful call, if within reach."""
    names = calls.groupBy(*STEP).agg(
        F.array_sort(F.collect_list(F.struct("call_pos", "tool_name"))).alias("named"),
        F.bool_or(~fc.failed()).alias("ok"),
        F.bool_or(fc.failed()).alias("bad"),
    )
    rows = steps.select(*STEP).join(names, STEP, "left")
    rows = rows.select(
        *STEP, "bad",
        F.struct(
            F.coalesce(F.transform("named", lambda c: c["tool_name"]), F.array().cast("array<string>")).alias("names"),
            F.coalesce("ok", F.lit(False)).alias("ok"),
        ).alias("_s"),
    )
    ahead = neighbours(rows, lambda w: {"_next": F.collect_list("_s").over(w.rowsBetween(1, reach))}, after=reach)
    hit = F.array_position(F.transform("_next", lambda s: s["ok"]), True)
    path = F.flatten(F.transform(F.slice("_next", F.lit(1), hit.cast("int")), lambda s: s["names"]))
    return ahead.filter("bad").select("traj_id", "step_idx", F.when((hit > 0) & (F.size(path) > 0), path).alias("path"))


def failure_patterns(steps: DataFrame, calls: DataFrame, reach: int = 20) -> DataFrame:
    """Clusters with their commonest recovery path; ties go to the path seen first."""
    members = error_cluster_steps(calls).join(recovery_paths(steps, calls, reach), ["traj_id", "step_idx"], "left")
    paths = members.filter("path is not null").groupBy("traj_id", "tool", "pattern", "path").agg(
        F.count("*").alias("n"), F.min("step_idx").alias("seen")
    )
    best = paths.groupBy("traj_id", "tool", "pattern").agg(
        F.max_by("path", F.struct("n", (-F.col("seen")).alias("seen"))).alias("recovery_path")
    )
    return error_clusters(calls).join(best, ["traj_id", "tool", "pattern"], "left")


# ---- fruitless and repeated work ------------------------------------------------------------------


def fruitless_steps(calls: DataFrame) -> DataFrame:
    """Steps whose search calls all came back empty."""
    rows = calls.withColumns({"_s": fc.is_search(), "_e": fc.found_nothing()}).groupBy(*STEP).agg(
        F.count_if("_s").alias("searches"), F.count_if(F.col("_s") & ~F.col("_e")).alias("found"), F.count("*").alias("calls")
    )
    return rows.select(*STEP, "calls", ((F.col("searches") > 0) & (F.col("found") == 0)).alias("fruitless"))


def fruitless_streaks(steps: DataFrame, calls: DataFrame, least: int = 3) -> DataFrame:
    rows = steps.select(*STEP).join(fruitless_steps(calls), STEP, "left").fillna(False, ["fruitless"])
    streaks = islands(rows, ["fruitless"]).filter("fruitless")
    return streaks.groupBy("traj_id", F.col("island").alias("start_step")).agg(
        F.max("step_idx").alias("end_step"), F.count("*").alias("length"), F.sum("calls").alias("calls")
    ).filter(F.col("length") >= least)


def repeated_searches(calls: DataFrame, least: int = 3) -> DataFrame:
    """A search asked on several fruitless steps that are not all in a row."""
    empty = fruitless_steps(calls).filter("fruitless").select(*STEP)
    asked = calls.withColumn("signature", fc.search_signature()).filter("signature is not null")
    rows = asked.join(empty, STEP, "left_semi").select("traj_id", "signature", "step_idx").distinct()
    out = rows.groupBy("traj_id", "signature").agg(
        F.count("*").alias("count"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step")
    )
    display = F.substring(F.regexp_replace("signature", "^(grep|glob|bash):", ""), 1, 80)
    return out.filter(
        (F.col("count") >= least) & (F.col("last_step") - F.col("first_step") + 1 != F.col("count"))
    ).withColumn("display", display)


def edit_thrash(calls: DataFrame, reach: int = 15, least: int = 3) -> DataFrame:
    """Per path: the largest stretch of writes within ``reach`` steps that has a failure; the earliest of equals."""
    rows = calls.filter(fc.is_tool(vocab.WRITE_TOOLS)).select(
        *STEP, "call_pos", fc.write_path().alias("path"), fc.failed().cast("int").alias("bad")
    ).filter("path is not null")
    # Calls of the same step that come earlier are not part of a stretch starting at this call.
    same = Window.partitionBy("traj_id", "path", "step_idx").orderBy("call_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_n0": F.count("*").over(same), "_b0": F.coalesce(F.sum("bad").over(same), F.lit(0))})

    def ahead(w):
        frame = w.rangeBetween(0, reach)
        return {"_n": F.count("*").over(frame), "_b": F.sum("bad").over(frame), "_to": F.max("step_idx").over(frame)}

    rows = neighbours(rows, ahead, after=reach, keys=("traj_id", "path"))
    rows = rows.withColumns({"_n": F.col("_n") - F.col("_n0"), "_b": F.col("_b") - F.col("_b0")})
    rows = rows.filter((F.col("_n") >= least) & (F.col("_b") >= 1))
    best = F.max(
        F.struct("_n", (-F.col("step_idx")).alias("_s"), (-F.col("call_pos")).alias("_p"), "_b", "_to")
    ).alias("_m")
    return rows.groupBy("traj_id", "path").agg(best).select(
        "traj_id", "path", F.col("_m._n").alias("count"), F.col("_m._b").alias("fail_count"),
        (-F.col("_m._s")).alias("start_step"), F.col("_m._to").alias("end_step"),
    )


def shell_reads(calls: DataFrame) -> DataFrame:
    """Shell calls that read a file although a read tool exists."""
    command = F.col("input.command")
    return calls.filter(fc.is_tool(vocab.BASH_TOOLS)).select(
        "traj_id", "step_idx", "call_pos", F.substring(command, 1, 80).alias("command"), fc.shell_read_pattern(command).alias("pattern")
    ).filter("pattern is not null")


# ---- plans ----------------------------------------------------------------------------------------


def plan_history(calls: DataFrame) -> DataFrame:
    """One row per plan snapshot with its items, numbered within the run."""
    rows = calls.filter(fc.is_plan() & (F.size("input.todos") > 0)).select(
        *STEP, "call_pos",
        F.transform(
            "input.todos",
            lambda t: F.struct(
                F.coalesce(t["content"], F.lit("")).alias("content"),
                F.when(t["status"] != "", t["status"]).otherwise("?").alias("status"),
            ),
        ).alias("items"),
    )
    return running(rows, {"snapshot": F.lit(1)}, order=["step_idx", "call_pos"])


def plan_items_long(history: DataFrame) -> DataFrame:
    return history.select("traj_id", "step_idx", "call_pos", F.posexplode("items").alias("item_pos", "_i")).select(
        "traj_id", "step_idx", "call_pos", F.col("item_pos").cast("bigint").alias("item_pos"), "_i.content", "_i.status"
    )


def plan_phases(history: DataFrame) -> DataFrame:
    """Stretches of snapshots; a new one starts where no item of the last snapshot is left."""
    order = ["step_idx", "call_pos"]
    rows = history.select(*STEP, "call_pos", "snapshot", F.array_distinct(F.transform("items", lambda i: i["content"])).alias("held"))
    rows = carry(rows, {"_prev": F.col("held")}, order=order)
    fresh = (F.size("_prev") > 0) & ~F.arrays_overlap("_prev", "held")
    rows = running(rows.withColumn("_new", F.when(fresh, 1).otherwise(0)), {"phase_index": F.col("_new")}, order=order)
    at = F.struct("step_idx", "call_pos")
    return rows.groupBy("traj_id", "phase_index").agg(
        F.min("step_idx").alias("start_step"), F.max("step_idx").alias("end_step"),
        F.count("*").alias("snapshots"), F.max_by(F.size("held").cast("bigint"), at).alias("item_count"),
    )


def plan_items(history: DataFrame, slow: int = 20) -> DataFrame:
    """First start, first completion and duration of every plan item; stalled when never done or slow."""
    rows = plan_items_long(history)
    out = rows.groupBy("traj_id", "content").agg(
        F.min(F.when(F.col("status") == "in_progress", F.col("step_idx"))).alias("start_step"),
        F.min(F.when(F.col("status") == "completed", F.col("step_idx"))).alias("end_step"),
        F.min(F.struct("step_idx", "call_pos", "item_pos")).alias("_seen"),
    )
    duration = F.col("end_step") - F.col("start_step")
    stalled = (F.col("start_step").isNotNull() & F.col("end_step").isNull()) | F.coalesce(duration > slow, F.lit(False))
    return out.select(
        "traj_id", "content", "start_step", "end_step", duration.alias("duration_steps"), stalled.alias("stalled"),
        F.col("_seen.step_idx").alias("seen_step"), F.col("_seen.item_pos").alias("seen_pos"),
    )


def plan_summary(history: DataFrame) -> DataFrame:
    resets = plan_phases(history).groupBy("traj_id").agg((F.count("*") - 1).alias("plan_resets"))
    items = plan_items(history).groupBy("traj_id").agg(
        F.count("*").alias("total_items"), F.count_if("stalled").alias("stalled_items")
    )
    return items.join(resets, "traj_id")


# ---- n-grams --------------------------------------------------------------------------------------


def call_stream(calls: DataFrame) -> DataFrame:
    """Named calls of a run in order, with a dense position."""
    named = calls.filter(F.coalesce(F.col("tool_name"), F.lit("")) != "").select(*STEP, "call_pos", "tool_name")
    rows = running(named, {"_seq": F.lit(1)}, order=["step_idx", "call_pos"])
    return rows.withColumn("seq", (F.col("_seq") - 1).cast("bigint")).drop("_seq", "slice")


def tool_sequences(calls: DataFrame, least: int = 3, longest: int = 5, piece: int = 16 * SLICE) -> DataFrame:
    """Tool n-grams by number of non-overlapping occurrences, taken greedily from the left.

    The greedy scan is a small state machine: all it carries past a position is how many positions are
    still covered by the last pick, fewer than n. Each piece of a run is scanned once per possible
    carry-in, and the pieces are then chained, so no task holds all positions of a frequent n-gram.
    """
    stream = with_slice(call_stream(calls), idx="seq")

    def grams(w):
        return {"_g": F.collect_list("tool_name").over(w.rowsBetween(0, longest - 1))}

    rows = neighbours(stream, grams, after=longest - 1, idx="seq")
    sizes = F.filter(F.sequence(F.lit(2), F.lit(longest)), lambda n: n <= F.size("_g"))
    rows = rows.select("traj_id", "step_idx", "seq", "_g", F.explode(sizes).alias("n")).select(
        "traj_id", "step_idx", "seq", F.col("n").cast("bigint").alias("n"), F.slice("_g", F.lit(1), F.col("n").cast("int")).alias("gram")
    )
    # Rare n-grams can never qualify; drop them before any positions are gathered.
    key = ["traj_id", "n", "gram"]
    often = rows.groupBy(*key).agg(F.count("*").alias("_c")).filter(F.col("_c") >= least).drop("_c")
    rows = rows.join(often, key, "left_semi").withColumn("piece", F.floor(F.col("seq") / piece))
    spots = rows.groupBy(*key, "piece").agg(F.array_sort(F.collect_list("seq")).alias("at"))
    base = F.col("piece") * piece

    def scan(covered: Column) -> Column:
        begin = F.struct((base + covered).alias("free"), F.lit(0).cast("bigint").alias("n"))

        def take(state: Column, pos: Column) -> Column:
            return F.when(
                pos >= state["free"], F.struct((pos + F.col("n")).alias("free"), (state["n"] + 1).alias("n"))
            ).otherwise(state)

        end = F.aggregate("at", begin, take)
        return F.struct(end["n"].alias("n"), F.greatest(F.lit(0), end["free"] - base - piece).alias("over"))

    moves = spots.select(*key, "piece", F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), scan).alias("move"))
    chained = moves.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("piece", "move"))).alias("_m"))
    begin = F.struct(F.lit(-2).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("over"), F.lit(0).cast("bigint").alias("n"))

    def follow(state: Column, item: Column) -> Column:
        carried = F.when(item["piece"] == state["piece"] + 1, state["over"]).otherwise(F.lit(0))
        move = F.get(item["move"], carried.cast("int"))
        return F.struct(item["piece"].alias("piece"), move["over"].alias("over"), (state["n"] + move["n"]).alias("n"))

    out = chained.select("traj_id", "n", F.array_join("gram", " > ").alias("gram"), F.aggregate("_m", begin, follow)["n"].alias("frequency"))
    return out.filter(F.col("frequency") >= least)


# ---- sub-agents -----------------------------------------------------------------------------------


def spawn_edges(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Child session -> spawning step and parent; the first spawn wins, self and root spawns are ignored."""
    roots = steps.filter("session_id <> ''").groupBy("traj_id").agg(F.min_by("session_id", "step_idx").alias("root"))
    at = steps.select("traj_id", "step_idx", F.col("session_id").alias("parent"))
    rows = calls.filter("child_session_id <> ''").select("traj_id", "step_idx", "call_pos", F.col("child_session_id").alias("child"))
    rows = rows.join(at, ["traj_id", "step_idx"]).join(roots, "traj_id", "left")
    rows = rows.filter((F.col("child") != F.coalesce("parent", F.lit(""))) & (F.col("child") != F.coalesce("root", F.lit(""))))
    where = F.struct("step_idx", "call_pos")
    return rows.groupBy("traj_id", "child").agg(
        F.min_by("parent", where).alias("parent"), F.min("step_idx").alias("spawn_step")
    )


def annotate_spawned(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Mark the steps of spawned sessions as sub-agent steps and name their parent."""
    edges = spawn_edges(steps, calls).select("traj_id", F.col("child").alias("session_id"), F.col("parent").alias("_parent"))
    out = steps.join(edges, ["traj_id", "session_id"], "left")
    known = F.col("_parent").isNotNull()
    own = F.when(F.col("parent_session_id") != "", F.col("parent_session_id"))
    return out.withColumns(
        {
            "is_sub_agent": F.when(known, True).otherwise(F.col("is_sub_agent")),
            "parent_session_id": F.when(known, F.coalesce(own, "_parent")).otherwise(F.col("parent_session_id")),
        }
    ).select(*steps.columns)


def subagent_sessions(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Stretches of consecutive steps of one sub-agent session, with tokens, calls, time and the spawn step."""
    session = F.when(F.coalesce("is_sub_agent", F.lit(False)) & (F.col("session_id") != ""), F.col("session_id"))
    rows = steps.select(*STEP, session.alias("_sid"), "tokens.total", "tool_call_count", "duration")
    rows = islands(rows, ["_sid"]).filter("_sid is not null")
    out = rows.groupBy("traj_id", F.col("island").alias("start_step")).agg(
        F.min("_sid").alias("session_id"), F.max("step_idx").alias("end_step"), F.count("*").alias("steps"),
        F.sum("total").alias("total_tokens"), F.sum("tool_call_count").alias("total_tools"),
        F.sum(F.col("duration").cast("decimal(18,3)")).cast("double").alias("total_duration"),
    )
    born = spawn_edges(steps, calls).select("traj_id", F.col("child").alias("session_id"), "spawn_step")
    return out.join(born, ["traj_id", "session_id"], "left")


def backfill_last_duration(steps: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Close an open last step with the run's end stamp, else the latest completion before it."""
    last = steps.groupBy("traj_id").agg(F.max("step_idx").alias("_last"))
    done = steps.join(last, "traj_id").filter(F.col("step_idx") < F.col("_last")).groupBy("traj_id").agg(
        F.max("time_completed_ms").alias("_seen")
    )
    ends = last.join(done, "traj_id", "left")
    if sessions is not None:
        ends = ends.join(sessions.select("traj_id", F.col("finished_at_ms").alias("_told")), "traj_id", "left")
    else:
        ends = ends.withColumn("_told", F.lit(None).cast("bigint"))
    ends = ends.select("traj_id", F.col("_last").alias("step_idx"), F.coalesce("_told", "_seen").alias("_end"))
    out = steps.join(ends, ["traj_id", "step_idx"], "left")
    start = F.col("time_created_ms")
    fill = F.col("duration").isNull() & (start > 0) & (F.col("_end") > start)
    return out.withColumns(
        {
            "duration": F.when(fill, F.round((F.col("_end") - start) / 1000, 2)).otherwise(F.col("duration")),
            "time_completed_ms": F.when(fill, F.coalesce("time_completed_ms", "_end")).otherwise(F.col("time_completed_ms")),
        }
    ).select(*steps.columns)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
