"""Context-window pressure: occupancy over time, compactions, and what fills the window.

A window belongs to (run, window agent). Everything row-level runs per slice of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import agents, calls as fc, tokens as ft
from runloom.operators.slices import SLICE, carry, running, with_slice
from runloom.session import cut_lineage

STEP = ["traj_id", "slice", "step_idx"]
WINDOW = ["traj_id", "window"]


def occupancy_columns() -> Column:
    """Tokens the prompt of a step held: an explicit window, else its largest request, else its own input."""
    t = lambda n: F.col(f"tokens.{n}")
    seg = ft.step_segments()
    cached = F.coalesce(t("prompt_peak_cache_read"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    fresh = seg["fresh"] + seg["cache_write"]

    def triple(new: Column, read: Column, whole: Column) -> Column:
        return F.struct(new.alias("fresh"), read.alias("cache_read"), whole.alias("occupancy"))

    return F.coalesce(
        F.when(t("context_window") >= 0, triple(zero, t("context_window"), t("context_window"))),
        F.when(t("prompt_peak") >= 0, triple(t("prompt_peak") - cached, cached, t("prompt_peak"))),
        triple(fresh, seg["cache_read"], fresh + seg["cache_read"]),
    )


def is_checkpoint() -> Column:
    return F.coalesce("is_compaction_checkpoint", F.lit(False)) | (F.col("role") == "compaction")


def is_summary_turn() -> Column:
    return (
        F.coalesce("summary_true", F.lit(False)) | is_checkpoint() | F.coalesce(F.lower("agent") == "compaction", F.lit(False))
    )


def occupancy(steps: DataFrame) -> DataFrame:
    """Every step with its window, its occupancy, and the nearest occupied turns of the window around it."""
    rows = steps.select(
        *STEP, "role", "time_created_ms", agents.window_agent().alias("window"),
        is_checkpoint().alias("checkpoint"), is_summary_turn().alias("summary_turn"),
        F.coalesce("summary_true", F.lit(False)).alias("summary_true"),
        ((F.col("role") == "assistant") & ~is_checkpoint()).alias("turn"),
        F.coalesce(F.col("tokens.context_window") >= 0, F.lit(False)).alias("told"),
        occupancy_columns().alias("_o"),
    ).select("*", "_o.*").drop("_o")
    shot = rows.groupBy(*WINDOW).agg(F.bool_or(F.col("turn") & F.col("told")).alias("snapshot")).filter("snapshot")
    rows = rows.join(shot, WINDOW, "left").fillna(False, ["snapshot"])
    live = F.col("turn") & (~F.col("snapshot") | F.col("told")) & (F.col("occupancy") > 0)
    held = F.when(F.col("turn") & (F.col("occupancy") > 0), F.col("occupancy"))
    rows = rows.withColumn("live", live)
    return carry(rows, {"before": held}, keys=WINDOW, back={"next": held})


def _event(kind: Column | str) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    after = F.coalesce(F.when(F.col("occupancy") > 0, F.col("occupancy")), F.col("next"))
    return [
        *[F.col(c) for c in STEP], F.col("window"), kind.alias("kind"), F.col("before").alias("occupancy_before"),
        after.alias("occupancy_after"), F.greatest(F.lit(0), F.col("before") - after).alias("dropped"),
    ]


def _no_null_drop(events: DataFrame) -> DataFrame:
    both = F.col("occupancy_before").isNotNull() & F.col("occupancy_after").isNotNull()
    return events.withColumn("dropped", F.when(both, F.col("dropped")))


def explicit_events(occ: DataFrame, parts: DataFrame) -> DataFrame:
    """Compactions the log states: checkpoints, compaction parts, compress steps, summaries."""
    name = F.lower(F.coalesce("text", F.lit("")))
    marks = parts.select(
        *STEP,
        F.when(F.col("type") == "compaction", "compaction_part").when(
            F.col("type").isin("step_start", "step_finish") & (name.contains("compress") | name.contains("compact")), "compress_step"
        ).alias("kind"),
    ).filter("kind is not null")
    by_part = occ.filter("not checkpoint").join(marks, STEP).select(*_event(F.col("kind")))
    own = F.when(F.col("checkpoint"), "compaction_message").when(F.col("turn") & F.col("summary_true"), "summary")
    by_step = occ.withColumn("kind", own).filter("kind is not null").select(*_event(F.col("kind")))
    return _no_null_drop(by_step.unionByName(by_part))


def prune_waves(steps: DataFrame, calls: DataFrame, gap_ms: int = vocab.PRUNE_GAP_MS) -> DataFrame:
    """Earliest stamp of every burst of pruned tool outputs; a burst ends at a gap above ``gap_ms``."""
    stamp = F.col("time_compacted")
    seconds = (stamp >= 1_000_000_000) & (stamp < 10_000_000_000)
    rows = calls.filter(stamp > 0).select(*STEP, F.when(seconds, stamp * 1000).otherwise(stamp).alias("ts"))
    rows = rows.join(steps.select(*STEP, agents.window_agent().alias("window")), STEP)
    rows = rows.groupBy(*WINDOW, "ts").agg(F.min("step_idx").alias("first_step"))
    rows = rows.withColumn("hour", F.floor(F.col("ts") / 3_600_000))
    rows = carry(rows, {"_prev": F.col("ts")}, keys=WINDOW, order=["ts"], piece="hour")
    return rows.filter(F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") > gap_ms)).select(*WINDOW, "ts", "first_step")


def turn_at_or_after(occ: DataFrame, stamps: DataFrame) -> DataFrame:
    """For each (window, ts): the first turn created at or after ts, else the last turn of the window.

    Turns and stamps are merged on one time axis and the smallest step index seen so far is carried from
    late to early, so no stamp is paired with all turns.
    """
    turns = occ.filter("turn and time_created_ms is not null")
    axis = turns.select(*WINDOW, (-F.col("time_created_ms")).alias("_t"), F.lit(0).alias("_k"), (-F.col("step_idx")).alias("_s"), F.lit(None).cast("bigint").alias("first_step"))
    axis = axis.unionByName(
        stamps.select(*WINDOW, (-F.col("ts")).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("_s"), "first_step")
    ).withColumn("_piece", F.floor(F.col("_t") / 3_600_000))
    axis = running(axis, {"_best": F.col("_s")}, keys=WINDOW, order=["_t", "_k"], how="max", piece="_piece").filter("_k = 1")
    last = turns.groupBy(*WINDOW).agg(F.max("step_idx").alias("_last"))
    out = axis.join(last, WINDOW, "left")
    return out.select(*WINDOW, (-F.col("_t")).alias("ts"), F.coalesce(-F.col("_best"), "_last", "first_step").alias("step_idx"))


def prune_events(occ: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Prune waves booked on the turn that first shows the smaller window; no visible drop is no event."""
    host = turn_at_or_after(occ, prune_waves(steps, calls)).select("traj_id", "step_idx", "ts")
    rows = with_slice(host).join(occ, STEP).select(*_event("tool_prune"))
    return _no_null_drop(rows).filter("dropped is null or dropped > 0")


def drop_events(occ: DataFrame, known: DataFrame) -> DataFrame:
    """Lasting falls of the occupancy with no known compaction nearby."""
    points = occ.filter(F.col("turn") & F.when(F.col("snapshot"), F.col("told")).otherwise(F.col("occupancy") > 0))
    cached = points.groupBy(*WINDOW).agg(F.bool_or(F.col("cache_read") > 0).alias("_cached"))
    # The latest known event up to the turn after each point, found on one merged axis.
    marks = known.select("traj_id", "window", F.col("step_idx").alias("_pos"), F.lit(0).alias("_kind"), F.col("step_idx").alias("_mark"))
    axis = points.withColumns({"_pos": F.col("step_idx") + 1, "_kind": F.lit(1), "_mark": F.lit(None).cast("bigint")})
    axis = axis.unionByName(marks, allowMissingColumns=True).withColumn("_piece", F.floor(F.col("_pos") / SLICE))
    axis = running(axis, {"_event": F.col("_mark")}, keys=WINDOW, order=["_pos", "_kind"], how="max", piece="_piece")
    rows = axis.filter("_kind = 1").drop("_pos", "_kind", "_mark", "_piece")
    at = F.struct(F.col("step_idx").alias("step"), F.col("occupancy").alias("occ"), F.col("summary_turn").alias("sum"))
    rows = carry(rows, {"_p": at}, keys=WINDOW, back={"_n": F.col("occupancy")})
    rows = rows.join(cached, WINDOW)
    explicit = known.select("traj_id", "step_idx").distinct().withColumn("_taken", F.lit(True))
    rows = rows.join(explicit, ["traj_id", "step_idx"], "left")
    occ_, prev = F.col("occupancy"), F.col("_p.occ")
    falls = F.when(
        F.col("snapshot"),
        (occ_ < prev * vocab.SNAPSHOT_DROP_RATIO) & (prev - occ_ >= vocab.SNAPSHOT_DROP_TOKENS),
    ).otherwise(
        F.col("_cached") & (occ_ < prev * vocab.DROP_RATIO)
        & F.coalesce(F.col("_n") < prev * vocab.RECOVERED_RATIO, occ_ < prev * vocab.LAST_DROP_RATIO)
    )
    near = F.coalesce((F.col("_event") > F.col("_p.step")) | (F.col("_event") >= F.col("step_idx") - 1), F.lit(False))
    rows = rows.filter(falls & ~near & ~F.col("_p.sum") & F.col("_taken").isNull())
    host = _only_user_between(occ, rows)
    out = host.select(
        "traj_id", F.col("_host").alias("step_idx"), "window", F.lit("occupancy_drop").alias("kind"),
        prev.alias("occupancy_before"), occ_.alias("occupancy_after"), F.greatest(F.lit(0), prev - occ_).alias("dropped"),
    )
    return with_slice(out)


def _only_user_between(occ: DataFrame, drops: DataFrame) -> DataFrame:
    """Host of a drop: the single user turn since the point before it (explicit windows only), else the turn."""
    users = occ.filter("role = 'user'").select(*STEP, F.lit(1).alias("_u"))
    ends = drops.filter("snapshot").select("traj_id", F.explode(F.array("step_idx", "_p.step")).alias("step_idx")).distinct()
    axis = with_slice(ends).withColumn("_u", F.lit(0)).unionByName(users)
    axis = running(axis, {"_count": F.col("_u"), }, order=["step_idx", "_u"])
    axis = running(axis, {"_user": F.when(F.col("_u") == 1, F.col("step_idx"))}, order=["step_idx", "_u"], how="max")
    seen = axis.filter("_u = 0").select("traj_id", "step_idx", "_count", "_user")
    to = seen.select("traj_id", "step_idx", F.col("_count").alias("_c1"), "_user")
    fro = seen.select("traj_id", F.col("step_idx").alias("_from"), F.col("_count").alias("_c0"))
    out = drops.withColumn("_from", F.col("_p.step")).join(to, ["traj_id", "step_idx"], "left").join(fro, ["traj_id", "_from"], "left")
    single = F.coalesce(F.col("_c1") - F.col("_c0") == 1, F.lit(False))
    return out.withColumn("_host", F.when(single, F.col("_user")).otherwise(F.col("step_idx")))


def compaction_events(occ: DataFrame, steps: DataFrame, calls: DataFrame, parts: DataFrame) -> DataFrame:
    """All compaction signals: stated, pruned, and inferred from lasting drops."""
    known = explicit_events(occ, parts).unionByName(prune_events(occ, steps, calls))
    known = cut_lineage(known)
    return cut_lineage(known.unionByName(drop_events(occ, known)))


def coalesce_events(events: DataFrame, occ: DataFrame) -> DataFrame:
    """Signals with no live turn between them become one compaction."""
    live = occ.filter("live").select(*STEP, "window", F.lit("").alias("kind"), F.lit(1).alias("_live"))
    axis = events.withColumn("_live", F.lit(0)).unionByName(live, allowMissingColumns=True)
    # A live turn on a signal's own step counts as after it (it is not strictly before).
    axis = running(axis, {"_seen": F.col("_live")}, keys=WINDOW, order=["step_idx", "_live", "kind"])
    rows = axis.filter("_live = 0").drop("_live")
    here = occ.filter("live").select(*STEP, "window", F.lit(1).alias("_here"))
    rows = rows.join(here, [*STEP, "window"], "left").withColumn("_upto", F.col("_seen") + F.coalesce("_here", F.lit(0)))
    order = ["step_idx", "kind"]
    rows = carry(rows, {"_last": F.col("_upto")}, keys=WINDOW, order=order)
    apart = F.col("_last").isNull() | (F.col("_seen") > F.col("_last"))
    rows = running(rows.withColumn("_new", F.when(apart, 1).otherwise(0)), {"_group": F.col("_new")}, keys=WINDOW, order=order)
    at = F.struct(*order)
    # Downstream operators use the few merged events several times over.
    out = cut_lineage(rows).groupBy(*WINDOW, "_group").agg(
        F.min("step_idx").alias("step_idx"),
        F.min_by("kind", at).alias("_kind"),
        F.bool_or(F.col("kind") == "summary").alias("_sum"),
        F.min_by("occupancy_before", at).alias("occupancy_before"),
        F.coalesce(
            F.max_by("occupancy_after", F.when(F.col("occupancy_after") > 0, at)), F.min_by("occupancy_after", at)
        ).alias("occupancy_after"),
        F.max("dropped").alias("_dropped"),
        F.count("*").alias("signals"),
    )
    both = F.col("occupancy_before").isNotNull() & F.col("occupancy_after").isNotNull()
    return out.select(
        *WINDOW, "step_idx", F.when(F.col("_sum"), "summary").otherwise(F.col("_kind")).alias("kind"), "occupancy_before", "occupancy_after",
        F.when(both, F.greatest(F.lit(0), F.col("occupancy_before") - F.col("occupancy_after"))).otherwise(F.col("_dropped")).alias("dropped"),
        "signals",
    )


def pressure_points(occ: DataFrame) -> DataFrame:
    """Occupancy points of every window; turn numbers also count turns that reported nothing."""
    turns = occ.filter(F.col("turn") & (~F.col("snapshot") | F.col("told")))
    turns = running(turns, {"local_turn": F.lit(1)}, keys=WINDOW)
    return turns.filter("live").select(*WINDOW, "step_idx", "slice", "local_turn", "fresh", "cache_read", "occupancy")


def spliced_points(points: DataFrame, merged: DataFrame) -> DataFrame:
    """Points plus a vertical cliff (before, after) at every compaction that shrank the window."""
    cliffs = merged.filter("occupancy_after > 0 and occupancy_after < occupancy_before")
    cliffs = with_slice(cliffs).select(*STEP, "window", "occupancy_before", "occupancy_after")
    facts = F.struct("local_turn", "fresh", "cache_read")
    axis = points.select(*STEP, "window", facts.alias("_f")).withColumn("_k", F.lit(1))
    axis = axis.unionByName(cliffs.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    axis = carry(axis, {"_b": F.col("_f")}, keys=WINDOW, order=["step_idx", "_k"])
    at = points.select(*STEP, "window", facts.alias("_at"))
    axis = axis.withColumn("_g", F.col("_f"))
    nxt = carry(axis.withColumn("_k2", -F.col("_k")), {}, keys=WINDOW, order=["step_idx", "_k2"], back={"_a": F.col("_g")})
    rows = nxt.filter("_k = 0").join(at, [*STEP, "window"], "left")
    before = F.coalesce("_b", "_at")
    after = F.coalesce("_a", "_at", "_b")
    rows = rows.filter(before.isNotNull()).select(
        *STEP, "window",
        F.explode(
            F.array(
                F.struct(before.alias("f"), F.col("occupancy_before").alias("occupancy")),
                F.struct(after.alias("f"), F.col("occupancy_after").alias("occupancy")),
            )
        ).alias("_x"),
    ).select(*WINDOW, "step_idx", "slice", "_x.f.local_turn", "_x.f.fresh", "_x.f.cache_read", "_x.occupancy")
    both = points.withColumn("_real", F.lit(0)).unionByName(rows.withColumn("_real", F.lit(1)))
    first = Window.partitionBy(*WINDOW, "step_idx", "occupancy").orderBy("_real", "local_turn")
    return both.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_real")


def window_limits(steps: DataFrame, occ: DataFrame, sessions: DataFrame | None = None, override: int | None = None) -> DataFrame:
    """Window size per run and where it comes from: override, declared, model, default, or unknown.

    A model or default window smaller than a prompt the run really sent is disproved: unknown, null.
    """
    rules, known = F, F.lit(False)
    for prefix, size in vocab.MODEL_WINDOWS:
        hit = F.lower("model_id").startswith(prefix)
        rules, known = rules.when(hit, F.lit(size)), known | hit
    rows = steps.groupBy("traj_id").agg(F.min_by(rules.otherwise(F.lit(None)), F.when(known, F.col("step_idx"))).alias("_model"))
    peak = occ.filter("turn").groupBy("traj_id").agg(F.max("occupancy").alias("_peak"))
    rows = rows.join(peak, "traj_id", "left")
    if sessions is not None:
        rows = rows.join(sessions.select("traj_id", F.col("window_limit").alias("_told")), "traj_id", "left")
    else:
        rows = rows.withColumn("_told", F.lit(None).cast("bigint"))
    mine = F.lit(override).cast("bigint")
    guess = F.coalesce("_model", F.lit(vocab.DEFAULT_WINDOW)).cast("bigint")
    disproved = F.coalesce(F.col("_peak") > guess, F.lit(False))
    return rows.select(
        "traj_id",
        F.coalesce(mine, "_told", F.when(~disproved, guess)).alias("window_limit"),
        F.when(mine.isNotNull(), "override").when(F.col("_told").isNotNull(), "declared").when(disproved, "unknown")
        .when(F.col("_model").isNotNull(), "model").otherwise("default").alias("window_source"),
        F.coalesce(mine, "_told", guess).alias("working_limit"),
    )


def pressure_stats(points: DataFrame, merged: DataFrame, limits: DataFrame) -> DataFrame:
    """Peak, peak share, compactions and largest drop per run; windows without a point do not count."""
    top = points.groupBy("traj_id").agg(F.max("occupancy").alias("peak_occupancy"))
    shown = merged.join(points.select(*WINDOW).distinct(), WINDOW, "left_semi").groupBy("traj_id").agg(
        F.count("*").alias("compaction_count"), F.max("dropped").alias("largest_drop")
    )
    rows = limits.join(top, "traj_id", "left").join(shown, "traj_id", "left")
    rows = rows.fillna(0, ["peak_occupancy", "compaction_count", "largest_drop"])
    share = F.when((F.col("window_limit") > 0) & (F.col("peak_occupancy") > 0), F.col("peak_occupancy") / F.col("window_limit"))
    return rows.select(
        "traj_id", "peak_occupancy", share.alias("peak_share"), "compaction_count", "largest_drop", "window_limit", "window_source"
    )


def premature_compactions(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Stated compactions that grew the window, or ran while it was less than half full."""
    rows = events.filter(F.col("kind").isin(*vocab.EXPLICIT_KINDS)).join(limits, "traj_id")
    grew = F.coalesce(F.col("occupancy_after") >= F.col("occupancy_before"), F.lit(False))
    early = F.coalesce(F.col("occupancy_before") < F.col("window_limit") * vocab.PREMATURE_RATIO, F.lit(False))
    return rows.filter(grew | early).select(
        *WINDOW, "step_idx", "kind", "occupancy_before", "occupancy_after",
        (F.col("occupancy_before") / F.col("window_limit")).alias("before_share"), "window_limit",
        F.when(grew, "window_grew").otherwise("low_occupancy").alias("reason"),
    )


def busiest_window(occ: DataFrame) -> DataFrame:
    """The window with the highest occupancy of each run: its peak and its latest turn."""
    turns = occ.filter("turn")
    top = turns.groupBy("traj_id").agg(
        F.max(F.struct("occupancy", (-F.col("step_idx")).alias("_s"), "window")).alias("_m")
    ).filter("_m.occupancy > 0")
    top = top.select("traj_id", "_m.window", (-F.col("_m._s")).alias("peak_step"), F.col("_m.occupancy").alias("peak_occupancy"))
    last = turns.groupBy(*WINDOW).agg(
        F.max("step_idx").alias("anchor_step"), F.max_by("occupancy", "step_idx").alias("occupancy")
    )
    return top.join(last, WINDOW)


def snapshot_choices(occ: DataFrame, merged: DataFrame) -> DataFrame:
    """The last turn of a window before each of its compactions."""
    axis = occ.filter("turn").select(*STEP, "window", F.struct(F.col("step_idx").alias("step"), "occupancy").alias("_t"), F.lit(1).alias("_k"))
    axis = axis.unionByName(with_slice(merged).select(*STEP, "window", F.lit(0).alias("_k")), allowMissingColumns=True)
    rows = carry(axis, {"_b": F.col("_t")}, keys=WINDOW, order=["step_idx", "_k"]).filter("_k = 0 and _b is not null")
    return rows.select(*WINDOW, F.col("_b.step").alias("step_idx"), F.col("_b.occupancy").alias("occupancy")).distinct()


def _bucket_rows(occ: DataFrame, calls: DataFrame, parts: DataFrame) -> DataFrame:
    """Estimated tokens of every part and call with its bucket; ``summary_only`` marks what survives a compaction."""
    who = occ.select(*STEP, "window", "role", "summary_turn")
    size = ft.estimate(F.col("text"))
    system = F.col("role").isin("system", "developer")
    kind, summary = F.col("type"), F.col("summary_turn")
    bucket = (
        F.when(system, "system").when(kind == "compaction", "summarized")
        .when((kind == "text") & F.coalesce("synthetic", F.lit(False)), "system")
        .when(kind.isin("text", "reasoning") & summary, "summarized")
        .when(kind.isin("text", "reasoning"), "conversation")
    )
    kept = ~system & ((kind == "compaction") | (summary & (bucket == "summarized")))
    texts = parts.join(who, STEP).select(*STEP, "window", bucket.alias("bucket"), size.alias("tokens"), kept.alias("kept"))
    sent, back = ft.estimate(F.to_json("input")), ft.estimate(F.col("output"))
    spawn = fc.is_tool(vocab.SPAWN_TOOLS) | F.coalesce(F.col("child_session_id") != "", F.lit(False))
    pairs = (
        F.when(fc.skill_name().isNotNull(), F.array(F.struct(F.lit("skills").alias("b"), (sent + back).alias("t"))))
        .when(spawn, F.array(F.struct(F.lit("subagents").alias("b"), sent.alias("t")), F.struct(F.lit("tool_outputs").alias("b"), back.alias("t"))))
        .when(fc.is_mcp(F.col("tool_name")), F.array(F.struct(F.lit("mcp").alias("b"), (sent + back).alias("t"))))
        .otherwise(F.array(F.struct(F.lit("conversation").alias("b"), sent.alias("t")), F.struct(F.lit("tool_outputs").alias("b"), back.alias("t"))))
    )
    spoken = calls.select(*STEP, F.explode(pairs).alias("_x")).select(*STEP, F.col("_x.b").alias("bucket"), F.col("_x.t").alias("tokens"))
    spoken = spoken.join(who.filter(~system).select(*STEP, "window"), STEP).withColumn("kept", F.lit(False))
    return texts.filter("bucket is not null").unionByName(spoken)


def window_composition(
    occ: DataFrame, events: DataFrame, calls: DataFrame, parts: DataFrame, anchors: DataFrame | None = None, blobs: DataFrame | None = None
) -> DataFrame:
    """Long form: what the window holds at its latest turn (or at ``anchors``), per bucket.

    Counts start at the last stated compaction before the turn. Estimates above the occupancy are scaled
    down to it, the rounding rest going to the largest bucket; occupancy above them is 'unattributed'.
    """
    anchor = anchors if anchors is not None else busiest_window(occ)
    anchor = anchor.select(*WINDOW, "anchor_step", "occupancy")
    stored = events.filter(F.col("kind").isin(*vocab.EXPLICIT_KINDS)).select(*WINDOW, F.col("step_idx").alias("_e"))
    last = anchor.join(stored, WINDOW).filter(F.col("_e") < F.col("anchor_step")).groupBy(*WINDOW, "anchor_step").agg(F.max("_e").alias("_e"))
    anchor = anchor.join(last, [*WINDOW, "anchor_step"], "left")
    rows = _bucket_rows(occ, calls, parts).join(anchor, WINDOW)
    step, cut = F.col("step_idx"), F.col("_e")
    inside = (step > F.coalesce(cut, F.lit(-1))) & (step <= F.col("anchor_step"))
    saved = F.col("kept") & (step >= F.greatest(F.lit(0), cut - 1)) & (step <= cut)
    rows = rows.filter(inside | F.coalesce(saved, F.lit(False)))
    sums = rows.groupBy("traj_id", "bucket").agg(F.sum("tokens").alias("tokens"))
    if blobs is not None:
        sums = sums.unionByName(blobs.select("traj_id", "bucket", "tokens")).groupBy("traj_id", "bucket").agg(F.sum("tokens").alias("tokens"))
    rank = F.array_position(F.array(*[F.lit(b) for b in vocab.BUCKETS]), F.col("bucket"))
    held = sums.filter("tokens > 0").withColumn("_rank", rank)
    # At most nine buckets per run.
    run = Window.partitionBy("traj_id")
    held = held.join(anchor.select("traj_id", "occupancy"), "traj_id").withColumn("_all", F.sum("tokens").over(run))
    over = (F.col("_all") > F.col("occupancy")) & (F.col("occupancy") > 0)
    held = held.withColumn("_scaled", F.when(over, F.floor(F.col("tokens") * (F.col("occupancy") / F.col("_all"))).cast("bigint")).otherwise(F.col("tokens")))
    largest = Window.partitionBy("traj_id").orderBy(F.col("_scaled").desc(), F.col("tokens").desc(), "_rank")
    rest = F.col("occupancy") - F.sum("_scaled").over(run)
    held = held.withColumns({"_rest": rest, "_first": F.row_number().over(largest) == 1})
    fixed = F.when(over & F.col("_first"), F.greatest(F.lit(0), F.col("_scaled") + F.col("_rest"))).otherwise(F.col("_scaled"))
    out = held.select("traj_id", "bucket", fixed.alias("tokens"), over.alias("scaled"))
    known = sums.groupBy("traj_id").agg(F.sum("tokens").alias("_all"))
    gap = anchor.join(known, "traj_id", "left").select("traj_id", (F.col("occupancy") - F.coalesce("_all", F.lit(0))).alias("tokens"))
    gap = gap.filter("tokens > 0").select("traj_id", F.lit("unattributed").alias("bucket"), "tokens", F.lit(False).alias("scaled"))
    return out.unionByName(gap).filter("tokens > 0")


def usage_segments(composition: DataFrame, anchor: DataFrame, limits: DataFrame) -> DataFrame:
    """Bucket shares of the window and of the loaded tokens, with a label for what the log does not contain."""
    run = Window.partitionBy("traj_id")
    part = lambda *names: F.coalesce(F.sum(F.when(F.col("bucket").isin(*names), F.col("tokens"))).over(run), F.lit(0))
    rows = composition.join(anchor.select("traj_id", "occupancy"), "traj_id").join(limits.select("traj_id", "working_limit"), "traj_id")
    hidden = F.when(part("unattributed") > part("system", "tools"), "Harness system definitions (not included in log)").otherwise(
        "Other (not included in log)"
    )
    return rows.select(
        "traj_id", "bucket", F.when(F.col("bucket") == "unattributed", hidden).otherwise(F.col("bucket")).alias("label"), "tokens",
        (F.col("tokens") / F.col("working_limit")).alias("window_share"),
        F.when(F.col("occupancy") > 0, F.col("tokens") / F.col("occupancy")).otherwise(0.0).alias("loaded_share"),
    )
