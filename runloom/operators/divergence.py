"""Comparison of aligned runs: similarity, harmful extras, divergence patterns, evaluation layers.

Everything is keyed by ``group_key`` (a pair of runs, or a pair and segment).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import paths
from runloom.operators.actions import MILESTONES, milli_cost, next_write_step
from runloom.operators.slices import SLICE, islands, running, with_slice
from runloom.session import cut_lineage

PAIR = ["group_key"]


def similarity(ref: DataFrame, cmp: DataFrame, matched: DataFrame, rate: float = vocab.TOKEN_RATE) -> DataFrame:
    """Recall, precision, F1 and overhead by cost; by counts for both sides when one has no cost at all."""

    def side(df: DataFrame, seq: str, name: str) -> DataFrame:
        hit = matched.select("group_key", F.col(seq).alias("seq")).withColumn("_hit", F.lit(True))
        rows = df.join(hit, ["group_key", "seq"], "left").withColumn("_c", milli_cost(rate))
        return rows.groupBy("group_key").agg(
            F.count("*").alias(f"{name}_n"), F.count_if("_hit").alias(f"{name}_hit"),
            F.sum("_c").cast("double").alias(f"{name}_w"),
            F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_c"))), F.lit(0)).cast("double").alias(f"{name}_hw"),
        )

    both = side(ref, "ref_seq", "ref").join(side(cmp, "cmp_seq", "cmp"), "group_key", "full")
    both = both.fillna(0)
    counts = ((F.col("ref_w") == 0) & (F.col("ref_n") > 0)) | ((F.col("cmp_w") == 0) & (F.col("cmp_n") > 0))
    pick = lambda s, w, n: F.when(counts, F.col(f"{s}_{n}").cast("double")).otherwise(F.col(f"{s}_{w}"))
    rw, cw = pick("ref", "w", "n"), pick("cmp", "w", "n")
    recall = F.when(rw > 0, pick("ref", "hw", "hit") / rw).otherwise(0.0)
    precision = F.when(cw > 0, pick("cmp", "hw", "hit") / cw).otherwise(0.0)
    out = both.select(
        "group_key", recall.alias("recall"), precision.alias("precision"), F.when(rw > 0, cw / rw).otherwise(0.0).alias("overhead"),
        F.col("ref_n").alias("ref_actions"), F.col("cmp_n").alias("cmp_actions"), F.col("ref_hit").alias("matched"),
    )
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def extras(cmp: DataFrame, matched: DataFrame) -> DataFrame:
    """Compared actions without a partner, numbered in order."""
    rows = cmp.join(matched.select("group_key", F.col("cmp_seq").alias("seq")), ["group_key", "seq"], "left_anti")
    rows = rows.withColumn("slice", F.floor(F.col("seq") / SLICE))
    rows = running(rows, {"_e": F.lit(1)}, keys=PAIR, order=["seq"])
    return rows.withColumn("extra", (F.col("_e") - 1).cast("bigint")).drop("_e")


def _pattern(rows: DataFrame, kind: Column | str, confidence: Column | float, evidence: Column, parent: str | None = None, **more: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return rows.select(
        "group_key", kind.alias("type"), F.lit(parent).cast("string").alias("parent_type"),
        more.get("first_step", F.col("step_idx")).alias("first_step"),
        more.get("last_step", F.col("step_idx")).alias("last_step"),
        more.get("steps", F.lit(1)).cast("bigint").alias("steps"),
        more.get("tokens", F.col("token_share")).cast("bigint").alias("tokens"),
        F.round(confidence, 2).alias("confidence"), evidence.alias("evidence"),
    )


def _named(kind: str, suffix: str) -> Column:
    return F.concat(F.lit(f"{kind}("), F.col("target"), F.lit(f"){suffix}"))


def _write_retries(rows: DataFrame, cmp: DataFrame) -> DataFrame:
    """Overwritten writes: rewritten within three steps, or refined later."""
    nxt = next_write_step(cmp.withColumn("slice", F.floor(F.col("step_idx") / SLICE))).drop("slice")
    rows = rows.filter("action_type = 'FILE_WRITE' and effect = 'reverted'").join(nxt.select("traj_id", "step_idx", "target", "next_step").distinct(), ["traj_id", "step_idx", "target"], "left")
    gap = F.coalesce(F.col("next_step") - F.col("step_idx"), F.lit(999))
    close = gap <= 3
    confidence = F.when(close, F.least(F.lit(0.9), 0.7 + (3 - gap) * 0.1)).otherwise(F.greatest(F.lit(0.3), 0.5 - (gap - 3) * 0.02))
    text = F.concat(_named("FILE_WRITE", " [reverted] → rewrite at +"), gap.cast("string"), F.lit(" steps"))
    kind = F.when(close, "reverted_and_rewritten").otherwise("iterative_refinement")
    return _pattern(rows, kind, confidence, text, "write_retry")


def _recoveries(rows: DataFrame) -> DataFrame:
    """Mark failed extras followed by the same action, and that follower.

    A follower cannot start a pair of its own, so in a row of failures every second one starts.
    """
    same = ["group_key", "action_type", "target"]
    rows = running(rows, {"_k": F.lit(1)}, keys=same, order=["extra"]).drop("slice")
    rows = with_slice(rows.withColumn("bad", F.col("effect") == "failed"), idx="_k")
    rows = islands(rows, ["bad"], keys=same, idx="_k")
    size = rows.groupBy(*same).agg(F.max("_k").alias("_size"))
    rows = rows.join(size, same)
    starts = F.col("bad") & ((F.col("_k") - F.col("island")) % 2 == 0) & (F.col("_k") < F.col("_size"))
    rows = rows.withColumn("starts", starts)
    after = rows.filter("starts").select(*same, (F.col("_k") + 1).alias("_k"), F.lit(True).alias("follows"), F.col("step_idx").alias("_step0"), F.col("token_share").alias("_tok0"))
    rows = rows.join(after, [*same, "_k"], "left").fillna(False, ["follows"])
    return rows.drop("_k", "_size", "island", "bad", "slice")


def divergence_patterns(ref: DataFrame, cmp: DataFrame, matched: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """All divergence patterns of every pair. Stages run in order; an extra explained once is not explained again.

    The evidence of a dead end names its first and last action; :func:`dead_end_actions` lists all of them.
    """
    return _explained(ref, cmp, matched, anchors)[0]


def dead_end_actions(ref: DataFrame, cmp: DataFrame, matched: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Every action of every dead end: group_key, first_step of the dead end, position in it from 0, step_idx, action_type and target."""
    idle = _explained(ref, cmp, matched, anchors)[1]
    ends = idle.groupBy("group_key", "island").agg(F.count("*").alias("n"), F.min("step_idx").alias("first_step")).filter("n >= 2")
    return idle.join(ends, ["group_key", "island"]).select("group_key", "first_step", (F.col("extra") - F.col("island")).alias("position"), "step_idx", "action_type", "target")


def _explained(ref: DataFrame, cmp: DataFrame, matched: DataFrame, anchors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(patterns, the idle extras that nothing else explains, by stretch)."""
    rows = cut_lineage(_recoveries(extras(cmp, matched)))
    retry = _write_retries(rows, cmp)
    recover = _pattern(
        rows.filter("follows"), "error_recovery_overhead", 0.8,
        F.concat("action_type", F.lit("("), "target", F.lit(") [failed], then again")),
        first_step=F.col("_step0"), steps=F.lit(2), tokens=F.col("token_share") + F.col("_tok0"),
    )
    taken = F.col("starts") | F.col("follows") | ((F.col("action_type") == "FILE_WRITE") & (F.col("effect") == "reverted"))
    rows = rows.withColumn("taken", taken)
    first_write = cmp.filter("action_type = 'FILE_WRITE'").groupBy("group_key").agg(F.min("step_idx").alias("_fw"))
    word = reduce(lambda a, b: a | b, [paths.basename(F.col("target")).contains(w) for w in vocab.VALIDATION_WORDS])
    rows = rows.join(first_write, "group_key", "left")
    early = ~F.col("taken") & (F.col("action_type") == "COMMAND") & F.coalesce(F.col("step_idx") < F.col("_fw"), F.lit(False)) & word
    rows = rows.withColumn("early", early)
    premature = _pattern(rows.filter("early"), "premature_validation", 0.5, _named("COMMAND", " before first write"))
    rows = rows.withColumn("taken", F.col("taken") | F.col("early"))
    partner = cmp.join(matched.select("group_key", F.col("cmp_seq").alias("seq")), ["group_key", "seq"], "left_semi")
    found = partner.filter("action_type = 'SEARCH'").select("group_key", "target").distinct().withColumn("_m", F.lit(True))
    search = (F.col("action_type") == "SEARCH") & ~F.col("taken")
    first = rows.filter(search).groupBy("group_key", "target").agg(F.min("extra").alias("_first"))
    rows = rows.join(found, ["group_key", "target"], "left").join(first, ["group_key", "target"], "left")
    rows = rows.withColumn("again", search & (F.coalesce("_m", F.lit(False)) | (F.col("extra") > F.col("_first"))))
    redundant = _pattern(rows.filter("again"), "redundant_search", 0.7, _named("SEARCH", " repeated"))
    rows = rows.withColumn("taken", F.col("taken") | F.coalesce("again", F.lit(False)))
    later = partner.groupBy("group_key", "target").agg(F.max("step_idx").alias("_later"))
    rows = rows.join(later, ["group_key", "target"], "left")
    unused = ~F.coalesce(F.col("_later") > F.col("step_idx"), F.lit(False))
    broad = ~F.col("taken") & (F.col("action_type") == "FILE_READ") & (F.col("effect") == "unknown") & unused
    subtree = lambda c: F.substring_index(F.regexp_replace(c, "^/+|/+$", ""), "/", 2)
    if anchors is not None:
        home = anchors.select("group_key", subtree(paths.slashes(F.col("path"))).alias("_sub")).distinct()
        some = home.select("group_key").distinct().withColumn("_anchored", F.lit(True))
        rows = rows.withColumn("_sub", subtree(F.col("target"))).join(home.withColumn("_home", F.lit(True)), ["group_key", "_sub"], "left").join(some, "group_key", "left")
        broad = broad & F.col("_home").isNull()
        base = F.when(F.col("_anchored"), 0.7).otherwise(0.5)
    else:
        base = F.lit(0.5)
    debug = F.coalesce(F.col("phase_label") == "debug", F.lit(False)) | F.coalesce(
        F.col("action_label").isin("debug_root_cause", "debug_hypothesis_test", "code_reading"), F.lit(False)
    )
    rows = rows.withColumn("broad", F.coalesce(broad, F.lit(False)))
    phase = F.when(F.col("phase_label").isNotNull(), F.concat(F.lit(" [phase="), "phase_label", F.lit("]"))).otherwise("")
    explore = _pattern(
        rows.filter("broad"), "broad_exploration", F.when(debug, F.greatest(F.lit(0.3), base - 0.2)).otherwise(base),
        F.concat(_named("FILE_READ", ""), phase),
    )
    rows = rows.withColumn("taken", F.col("taken") | F.col("broad"))
    idle = ~F.col("taken") & F.col("action_type").isin("FILE_READ", "SEARCH") & (F.col("effect") == "unknown")
    rows = with_slice(rows.withColumn("idle", idle), idx="extra")
    stretches = islands(rows, ["idle"], keys=PAIR, idx="extra").filter("idle")
    action = F.concat("action_type", F.lit("("), "target", F.lit(")"))
    runs = stretches.groupBy("group_key", "island").agg(
        F.count("*").alias("n"), F.sum("token_share").alias("tok"), F.min("step_idx").alias("a"), F.max("step_idx").alias("b"),
        F.min_by(action, "extra").alias("first"), F.max_by(action, "extra").alias("last"),
    ).filter("n >= 2")
    dead = _pattern(
        runs, "dead_end_branch", F.least(F.lit(0.8), 0.5 + F.col("n") * 0.1), F.format_string("%d actions from %s to %s", "n", "first", "last"),
        first_step=F.col("a"), last_step=F.col("b"), steps=F.col("n"), tokens=F.col("tok"),
    )
    order = ordering(ref, cmp).filter("inversions >= threshold")
    reorder = _pattern(
        order, "ordering_inefficiency", F.least(F.lit(0.9), 0.5 + F.col("inversions") / F.col("possible") * 0.4),
        F.format_string("%d inversions across %d unique common actions (threshold %d)", "inversions", "common", "threshold"),
        first_step=F.col("first_step"), last_step=F.col("last_step"), steps=F.col("common"), tokens=F.lit(0),
    )
    return reduce(DataFrame.unionByName, [retry, recover, premature, redundant, explore, reorder, dead]), stretches


def ordering(ref: DataFrame, cmp: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Inversions between the first-use orders of the actions both runs share.

    Counted bit by bit: two ranks are inverted at the highest bit in which they differ, so per bit and
    common prefix it is a running count of ones before each zero. No pairs are formed.
    """

    def first_use(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter("target <> '' and action_type <> 'REASON'")
        return rows.groupBy("group_key", "action_type", "target").agg(
            F.min("seq").alias(name), F.min_by("step_idx", "seq").alias(f"{name}_step")
        )

    both = first_use(ref, "r").join(first_use(cmp, "c"), ["group_key", "action_type", "target"]).select("group_key", "r", "c", "c_step")
    both = running(both.withColumn("slice", F.floor(F.col("r") / SLICE)), {"rank": F.lit(1)}, keys=PAIR, order=["r"]).drop("slice")
    both = both.withColumn("rank", (F.col("rank") - 1).cast("bigint"))
    sizes = both.groupBy("group_key").agg(
        F.count("*").alias("common"), F.min("c_step").alias("first_step"), F.max("c_step").alias("last_step")
    ).filter(F.col("common") >= least)
    both = both.join(sizes.select("group_key", "common"), "group_key")
    level = F.explode(F.sequence(F.lit(0), F.ceil(F.log2("common")).cast("int")))
    bits = both.select("group_key", "rank", "c", level.alias("level"))
    bits = bits.withColumns(
        {
            "one": F.expr("CAST(shiftright(rank, level) & 1 AS BIGINT)"), "prefix": F.expr("shiftright(rank, level + 1)"),
            "slice": F.floor(F.col("c") / SLICE),
        }
    )
    bits = running(bits, {"ones": F.col("one")}, keys=["group_key", "level", "prefix"], order=["c"])
    count = bits.groupBy("group_key").agg(F.sum(F.when(F.col("one") == 0, F.col("ones")).otherwise(0)).alias("inversions"))
    n = F.col("common")
    return sizes.join(count, "group_key").withColumn("possible", F.floor(n * (n - 1) / 2).cast("bigint")).withColumn(
        "threshold", F.greatest(F.lit(1), F.ceil(F.col("possible") * share)).cast("bigint")
    )


def harmful(cmp: DataFrame, matched: DataFrame, patterns: DataFrame, rate: float = vocab.TOKEN_RATE) -> DataFrame:
    """Cost share of failed, reverted and dead-end extras; by counts when the run has no cost."""
    rows = extras(cmp, matched)
    dead = patterns.filter("type = 'dead_end_branch'").select("group_key", "first_step", "last_step")
    # Dead ends of one pair do not overlap, so each extra meets at most one.
    ends = dead.select("group_key", F.col("first_step").alias("step_idx"), F.lit(0).alias("_k"), F.col("last_step").alias("_to"))
    axis = rows.withColumn("_k", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    axis = axis.withColumn("slice", F.floor(F.col("step_idx") / SLICE))
    axis = running(axis, {"_until": F.col("_to")}, keys=PAIR, order=["step_idx", "_k"], how="max").filter("_k = 1")
    inside = F.coalesce(F.col("step_idx") <= F.col("_until"), F.lit(False))
    bad = F.col("effect").isin("failed", "reverted") | inside
    sums = axis.filter(bad).groupBy("group_key").agg(
        F.count("*").alias("harmful"), F.sum("token_share").alias("harmful_tokens"), F.sum("latency_ms").alias("harmful_latency_ms"),
        F.sum(milli_cost(rate)).cast("double").alias("_h"),
    )
    whole = cmp.groupBy("group_key").agg(F.count("*").alias("_n"), F.sum(milli_cost(rate)).cast("double").alias("_w"))
    out = whole.join(sums, "group_key", "left").fillna(0)
    ratio = F.when(F.col("_w") > 0, F.col("_h") / F.col("_w")).otherwise(F.col("harmful") / F.col("_n"))
    return out.select("group_key", "harmful", "harmful_tokens", "harmful_latency_ms", F.least(ratio, F.lit(1.0)).alias("harmful_ratio"))


def milestone_deltas(ref: DataFrame, cmp: DataFrame) -> DataFrame:
    """Compared minus reference step of every milestone both runs reach."""
    a = ref.select("group_key", *[F.col(n).alias(f"_r_{n}") for n in MILESTONES])
    b = cmp.select("group_key", *[F.col(n).alias(f"_c_{n}") for n in MILESTONES])
    return a.join(b, "group_key", "full").select(
        "group_key", *[(F.col(f"_c_{n}") - F.col(f"_r_{n}")).alias(f"{n}_delta") for n in MILESTONES]
    )


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """Patterns per pair and type; an umbrella type counts its members."""
    kinds = F.explode(F.array_compact(F.array("type", "parent_type"))).alias("type")
    return patterns.select("group_key", kinds).groupBy("group_key", "type").agg(F.count("*").alias("n"))


def eval_layers(pairs: DataFrame, patterns: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Verdict per pair and layer: strong, moderate, weak, or n/a without any value."""
    counted = {
        "broad_exploration_count": "broad_exploration", "reverted_and_rewritten_count": "reverted_and_rewritten",
        "iterative_refinement_count": "iterative_refinement", "error_recovery_count": "error_recovery_overhead",
        "dead_end_branch_count": "dead_end_branch",
    }
    wide = patterns.groupBy("group_key").agg(*[F.count_if(F.col("type") == t).cast("double").alias(m) for m, t in counted.items()])
    rows = pairs.select("group_key").join(wide, "group_key", "left").fillna(0.0)
    cover = {"anchor_write_precision": "write_precision", "off_patch_write_ratio": "off_patch_write_ratio", "anchor_write_recall": "write_recall"}
    if anchor is not None:
        rows = rows.join(anchor.select("group_key", *[F.col(c).alias(m) for m, c in cover.items()]), "group_key", "left")
    else:
        rows = rows.withColumns({m: F.lit(None).cast("double") for m in cover})
    graded = []
    for layer, metric, lower, good, warn in vocab.LAYER_THRESHOLDS:
        value = F.col(metric)
        grade = F.when(value > warn, 2).when(value > good, 1) if lower else F.when(value < warn, 2).when(value < good, 1)
        graded.append(
            F.struct(F.lit(layer).alias("layer"), F.lit(metric).alias("metric"), value.alias("value"), F.when(value.isNotNull(), grade.otherwise(0)).alias("grade"))
        )
    long = rows.select("group_key", F.explode(F.array(*graded)).alias("_g")).select("group_key", "_g.*")
    worst = F.max("grade")
    return long.groupBy("group_key", "layer").agg(
        F.when(worst.isNull(), "n/a").when(worst == 2, "weak").when(worst == 1, "moderate").otherwise("strong").alias("verdict")
    )
