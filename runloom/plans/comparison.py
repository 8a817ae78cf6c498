"""Comparison of run pairs, from silver tables to one report row per pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import actions as ac, align as al, divergence as dv, files, filters
from runloom.session import cut_lineage, measured


@dataclass(frozen=True)
class Pairs:
    """Labelled actions of both sides of every pair, and their alignment."""

    manifest: DataFrame
    ref: DataFrame
    cmp: DataFrame
    matched: DataFrame


def labelled(steps: DataFrame, calls: DataFrame, parts: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Numbered non-REASON actions with effects, written once; every comparison reads them several times."""
    acts = cut_lineage(ac.actions(steps, calls, parts))
    return cut_lineage(al.numbered(ac.with_effects(acts, calls, parts, anchors)))


def compare(acts: DataFrame, manifest: DataFrame, fuzzy: bool = False) -> Pairs:
    """``manifest``: group_key, reference, compared (run ids)."""
    ref = acts.join(manifest.select("group_key", F.col("reference").alias("traj_id")), "traj_id")
    cmp = acts.join(manifest.select("group_key", F.col("compared").alias("traj_id")), "traj_id")
    ref, cmp = cut_lineage(ref), cut_lineage(cmp)
    return Pairs(manifest, ref, cmp, cut_lineage(al.align(ref, cmp, fuzzy)))


def milestone_targets(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Files either run of a pair changed."""
    ends = manifest.select("group_key", F.explode(F.array("reference", "compared")).alias("traj_id"))
    return ends.join(targets, "traj_id").select("group_key", "path").distinct()


def pair_milestones(pairs: Pairs, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    goal = milestone_targets(pairs.manifest, targets)
    return tuple(ac.milestones(side, goal, keys=("group_key",)) for side in (pairs.ref, pairs.cmp))


def compare_segments(pairs: Pairs, targets: DataFrame) -> DataFrame:
    """Per pair and segment. Equal milestone order: recall, precision, overhead within the segment.

    Otherwise each side lists its own segments with steps and tokens.
    """
    marks = pair_milestones(pairs, targets)
    sides = []
    for name, side, mark in zip(("reference", "compared"), (pairs.ref, pairs.cmp), marks):
        seg = ac.segments(side, mark, keys=("group_key",)).withColumn("side", F.lit(name))
        sides.append(cut_lineage(seg))
    order = [s.select("group_key", F.col("milestone_order").alias(f"_o{i}")).distinct() for i, s in enumerate(sides)]
    same = order[0].join(order[1], "group_key").filter("_o0 = _o1").select("group_key")
    placed = []
    for side, seg in zip((pairs.ref, pairs.cmp), sides):
        # At most six segments per pair: a range join on the pair key.
        spans = seg.select("group_key", "seg", "label", "start_step", "end_step")
        hit = side.join(spans, "group_key").filter("step_idx >= start_step and step_idx < end_step")
        placed.append(hit.drop("start_step", "end_step"))
    keyed = [
        cut_lineage(p.join(same, "group_key", "left_semi").withColumn("group_key", F.concat_ws("#", "group_key", F.col("seg").cast("string"))))
        for p in placed
    ]
    keyed = [al.numbered(k.drop("seq").withColumn("_t", F.col("traj_id")).withColumn("traj_id", F.col("group_key"))).withColumn("traj_id", F.col("_t")).drop("_t") for k in keyed]
    keyed = [cut_lineage(k) for k in keyed]
    sim = dv.similarity(keyed[0], keyed[1], al.align(keyed[0], keyed[1]))
    grid = sides[0].join(same, "group_key", "left_semi").select("group_key", "seg", "label")
    grid = grid.withColumn("_k", F.concat_ws("#", "group_key", F.col("seg").cast("string")))
    paired = grid.join(sim.withColumnRenamed("group_key", "_k"), "_k", "left").fillna(0, ["ref_actions", "cmp_actions"])
    paired = paired.select(
        "group_key", F.lit("paired").alias("side"), "seg", "label",
        F.when(F.col("ref_actions") == 0, 1.0).otherwise(F.coalesce("recall", F.lit(0.0))).alias("recall"),
        F.when(F.col("cmp_actions") == 0, 1.0).otherwise(F.coalesce("precision", F.lit(0.0))).alias("precision"),
        F.when(F.col("ref_actions") == 0, 0.0).otherwise(F.coalesce("overhead", F.lit(0.0))).alias("overhead"),
    )
    out = paired
    for seg, side in zip(sides, placed):
        per_step = side.groupBy("group_key", "seg", "step_idx").agg(F.sum("token_share").alias("t"))
        sums = per_step.groupBy("group_key", "seg").agg(F.count("*").alias("steps"), F.sum("t").alias("tokens"))
        own = seg.join(same, "group_key", "left_anti").join(sums, ["group_key", "seg"], "left").fillna(0, ["steps", "tokens"])
        out = out.unionByName(own.select("group_key", "side", "seg", "label", "steps", "tokens"), allowMissingColumns=True)
    return out


def report(pairs: Pairs, steps: DataFrame, calls: DataFrame, targets: DataFrame, anchored: bool = False) -> DataFrame:
    """One row per pair: outcome, similarity, harm, milestone deltas, notes, confidence.

    Its parts are made one after the other, so the driver never holds what all their joins broadcast.
    """
    with measured(steps.sparkSession):
        return _report(pairs, steps, targets, anchored)


def _report(pairs: Pairs, steps: DataFrame, targets: DataFrame, anchored: bool) -> DataFrame:
    ends = filters.success(steps).join(
        steps.groupBy("traj_id").agg(
            F.count("*").alias("steps"), F.sum("tokens.total").alias("tokens"), F.sum("tool_call_count").alias("tool_calls")
        ),
        "traj_id",
    )
    ends = cut_lineage(ends)
    out = pairs.manifest
    for name in ("reference", "compared"):
        named = ends.select(F.col("traj_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("success", "steps", "tokens", "tool_calls")])
        out = out.join(named, name, "left")
    patterns = cut_lineage(dv.divergence_patterns(pairs.ref, pairs.cmp, pairs.matched))
    out = out.join(cut_lineage(dv.similarity(pairs.ref, pairs.cmp, pairs.matched)), "group_key", "left")
    out = out.join(cut_lineage(dv.harmful(pairs.cmp, pairs.matched, patterns)), "group_key", "left")
    out = out.join(cut_lineage(dv.milestone_deltas(*pair_milestones(pairs, targets))), "group_key", "left")
    wrote = []
    for side, df in (("_a", pairs.ref), ("_b", pairs.cmp)):
        kept = df.filter("action_type = 'FILE_WRITE' and effect = 'survived'").select("group_key", "target").distinct()
        wrote.append(kept.withColumn(side, F.lit(1)))
    differs = wrote[0].join(wrote[1], ["group_key", "target"], "full").filter("_a is null or _b is null").select("group_key").distinct()
    out = out.join(cut_lineage(differs).withColumn("_differs", F.lit(True)), "group_key", "left")
    empty = F.col("reference_steps").isNull() | F.col("compared_steps").isNull()
    other = F.col("reference_success") != F.col("compared_success")
    note = (
        F.when(F.lit(anchored), F.lit(None).cast("string"))
        .when(other, "different outcomes")
        .when(F.col("_differs"), "different files modified")
    )
    out = out.withColumns(
        {
            "note": note,
            "error": F.when(empty, "run without steps"),
            "alignment_confidence": F.when(F.lit(not anchored) & other, "informational").otherwise("heuristic"),
            "milestone_confidence": F.lit("anchored" if anchored else "heuristic"),
        }
    ).drop("_differs")
    return cut_lineage(out)


def run_targets(calls: DataFrame, parts: DataFrame) -> DataFrame:
    return files.target_files(calls, parts)
