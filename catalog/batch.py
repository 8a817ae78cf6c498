"""Batches of pairs, before/after, groups of runs, labels."""

from pyspark.sql import functions as F

from catalog.comparison import EXTRA, PAIR, SIM, manifest, pairs, staged
from catalog.metrics import _nr
from catalog.registry import query
from catalog.sql import events_sql
from runloom.operators import divergence as dv, labels as lb, metrics as m
from runloom.plans import batch as b, comparison as cp, groups as g
from runloom.session import cut_lineage
from runloom.sources.bridges import event_runs, table


def reports(spark, d):
    """Pair p belongs to task p div 2; even pairs are the batch before, odd ones after."""
    p = pairs(spark, d)[1]
    sim = dv.similarity(p.ref, p.cmp, p.matched)
    n = F.col("group_key").cast("bigint")
    out = sim.withColumns({"task_id": F.floor(n / 2).cast("bigint"), "after": n % 2 == 1})
    return p, cut_lineage(out)


def sides(spark, d):
    rows = b.long_metrics(reports(spark, d)[1], ("task_id", "after"))
    return rows.filter("not after"), rows.filter("after")


LONG = """, lg AS (SELECT g // 2 AS task_id, g % 2 = 1 AS after, unnest(['recall', 'precision', 'f1', 'overhead']) AS metric,
   unnest([recall, precision, CASE WHEN recall + precision > 0 THEN 2 * precision * recall / (recall + precision) ELSE 0 END, overhead]) AS value FROM si)"""


@query("a30_batch_stats", events_sql(PAIR + SIM + LONG + "," + _nr("lg", "value", 0.05, "p5", "metric") + "," + _nr("lg", "value", 0.95, "p95", "metric") + """
  SELECT metric, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, any_value(p5) AS p5, any_value(p95) AS p95, min(value) AS min, max(value) AS max,
   any_value(p5_median) AS median, round(stddev_samp(value) / abs(avg(value)), 6) AS variation FROM lg JOIN p5 USING (metric) JOIN p95 USING (metric) GROUP BY metric"""))
def a30(spark, d):
    out = b.batch_stats(b.long_metrics(reports(spark, d)[1]))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stdev", "variation")})


@query("a33_consistency", events_sql(PAIR + SIM + LONG + " SELECT metric, round(stddev_samp(value) / abs(avg(value)), 6) AS variation FROM lg GROUP BY metric"))
def a33(spark, d):
    return b.batch_stats(b.long_metrics(reports(spark, d)[1])).select("metric", F.round("variation", 6).alias("variation"))


@query("a31_pattern_frequency", events_sql(PAIR + EXTRA + """ SELECT type, count(DISTINCT g) AS tasks, count(DISTINCT g) / (SELECT count(*) FROM pr)::DOUBLE AS prevalence,
   CASE WHEN count(DISTINCT g) >= 3 AND count(DISTINCT g) / (SELECT count(*) FROM pr)::DOUBLE >= 0.5 THEN 'supported_finding' ELSE 'single_pair_hypothesis' END AS evidence_level FROM pt GROUP BY type"""))
def a31(spark, d):
    """Also the promotion rule: enough tasks and enough prevalence."""
    p = pairs(spark, d)[1]
    found = dv.divergence_patterns(p.ref, p.cmp, p.matched).withColumnRenamed("group_key", "task_id")
    return b.pattern_frequency(p.manifest, found)


DELTA = LONG + """, dl AS (SELECT metric, count(*) AS n, avg(x.value) AS before_mean, avg(y.value) AS after_mean, count(*) FILTER (y.value > x.value) AS n_up, count(*) FILTER (y.value < x.value) AS n_down
    FROM lg x JOIN lg y USING (task_id, metric) WHERE NOT x.after AND y.after GROUP BY metric),
  dd AS (SELECT *, after_mean - before_mean AS delta, CASE WHEN metric = 'overhead' THEN before_mean - after_mean ELSE after_mean - before_mean END AS good FROM dl),
  sg AS (SELECT *, CASE WHEN good > 0.01 THEN 'improved' WHEN good < -0.01 THEN 'regressed' ELSE 'unchanged' END AS direction,
    least(1.0, 2 * list_sum(list_transform(range(0, least(n_up, n_down) + 1), lambda i: exp(lgamma(n_up + n_down + 1) - lgamma(i + 1) - lgamma(n_up + n_down - i + 1) + (n_up + n_down) * ln(0.5))))) AS p_value FROM dd)"""


@query("a34_metric_deltas", events_sql(PAIR + SIM + DELTA + " SELECT metric, n, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean, n_up, n_down, round(delta, 6) AS delta, direction FROM sg"))
def a34(spark, d):
    out = b.metric_deltas(*sides(spark, d)).drop("p_value")
    return out.withColumns({c: F.round(c, 6) for c in ("before_mean", "after_mean", "delta")})


@query("a36_significance", events_sql(PAIR + SIM + DELTA + " SELECT metric, round(p_value, 6) AS p_value FROM sg"))
def a36(spark, d):
    return b.metric_deltas(*sides(spark, d)).select("metric", F.round("p_value", 6).alias("p_value"))


def costly_sides(spark, d):
    """The pair of a task with the greater overhead comes after: more is found, at a price."""
    rows = reports(spark, d)[1]
    last = rows.groupBy("task_id").agg(F.max_by("group_key", F.struct("overhead", F.col("group_key").cast("bigint").alias("n"))).alias("_last"))
    rows = rows.join(last, "task_id").withColumn("after", F.col("group_key") == F.col("_last"))
    rows = b.long_metrics(rows, ("task_id", "after"))
    return rows.filter("not after"), rows.filter("after")


COSTLY = DELTA.replace("g % 2 = 1 AS after", "after").replace("FROM si)", "FROM (SELECT *, row_number() OVER (PARTITION BY g // 2 ORDER BY overhead DESC, g DESC) = 1 AS after FROM si))")


@query("a37_guardrails", events_sql(PAIR + SIM + COSTLY + """ SELECT metric, round(abs(delta) / abs(before_mean), 6) AS relative_regression FROM sg WHERE direction = 'regressed' AND (SELECT count(*) FROM sg WHERE direction = 'improved') > 0
   AND (abs(delta) / abs(before_mean) >= 0.1 OR p_value < 0.05)"""))
def a37(spark, d):
    out = b.guardrails(b.metric_deltas(*costly_sides(spark, d)))
    return out.select("metric", F.round("relative_regression", 6).alias("relative_regression"))


@query("a38_recommendation", events_sql(PAIR + SIM + COSTLY + """, wn AS (SELECT metric FROM sg WHERE direction = 'regressed' AND (abs(delta) / abs(before_mean) >= 0.1 OR p_value < 0.05)),
  ls AS (SELECT coalesce(list_sort(list(metric) FILTER (direction = 'improved')), []) AS i, coalesce(list_sort(list(metric) FILTER (direction = 'regressed')), []) AS r, coalesce((SELECT list_sort(list(metric)) FROM wn), []) AS w FROM sg)
  SELECT CASE WHEN len(i) + len(r) = 0 THEN 'No significant changes detected.'
   WHEN len(i) > 0 AND len(w) > 0 THEN 'Intervention improved ' || array_to_string(i[:2], ', ') || ' but regressed ' || array_to_string(w[:2], ', ') || '. Review tradeoffs.'
   WHEN len(i) > 0 AND len(r) > 0 THEN 'Intervention improved ' || array_to_string(i[:2], ', ') || ' with minor regressions in ' || array_to_string(r[:2], ', ') || ' (below guardrail thresholds).'
   WHEN len(i) > 0 THEN 'Intervention improved ' || array_to_string(i[:3], ', ') || ' without regressions.'
   ELSE 'Intervention regressed ' || array_to_string(r[:3], ', ') || ' without improvements.' END AS recommendation FROM ls"""))
def a38(spark, d):
    deltas = cut_lineage(b.metric_deltas(*costly_sides(spark, d)))
    return b.recommendation(deltas, b.guardrails(deltas))


@query("j13_task_pairing", """SELECT o_custkey AS task_id, CASE WHEN max(o_orderpriority) < '3' THEN 'before_only' WHEN min(o_orderpriority) >= '3' THEN 'after_only' ELSE 'paired' END AS side
   FROM orders GROUP BY 1""")
def j13(spark, d):
    """Tasks with urgent orders against tasks with all others."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderpriority")
    return b.pair_tasks(rows.filter("o_orderpriority < '3'"), rows.filter("o_orderpriority >= '3'"))


@query("a35_pattern_deltas", events_sql(PAIR + EXTRA + """, pk AS (SELECT DISTINCT g // 2 AS t, g % 2 AS a, type FROM pt UNION SELECT DISTINCT g // 2, g % 2, parent_type FROM pt WHERE parent_type IS NOT NULL),
   tk AS (SELECT g // 2 AS t FROM pr GROUP BY 1 HAVING count(*) = 2),
   pd AS (SELECT type, count(*) FILTER (a = 0) / (SELECT count(*) FROM tk)::DOUBLE AS before_share, count(*) FILTER (a = 1) / (SELECT count(*) FROM tk)::DOUBLE AS after_share FROM pk WHERE t IN (SELECT t FROM tk) GROUP BY type)
  SELECT *, after_share - before_share AS delta, CASE WHEN after_share - before_share < -0.01 THEN 'improved' WHEN after_share - before_share > 0.01 THEN 'regressed' ELSE 'unchanged' END AS direction FROM pd"""))
def a35(spark, d):
    p = pairs(spark, d)[1]
    found = cut_lineage(dv.divergence_patterns(p.ref, p.cmp, p.matched))
    n = F.col("group_key").cast("bigint")
    keyed = found.withColumns({"task_id": F.floor(n / 2), "after": n % 2 == 1})
    tasks = p.manifest.withColumns({"task_id": F.floor(n / 2), "after": n % 2 == 1})
    side = b.pair_tasks(tasks.filter("not after"), tasks.filter("after"))
    return b.pattern_deltas(side, keyed.filter("not after"), keyed.filter("after"))


@query("j14_manifest_runs", events_sql(PAIR + " SELECT CAST(g AS VARCHAR) AS group_key, reference, compared, (SELECT count(*) FROM st WHERE traj_id = reference) AS ref_steps, (SELECT count(*) FROM st WHERE traj_id = compared) AS cmp_steps FROM pr"))
def j14(spark, d):
    n = event_runs(spark, d, indexed=False).steps.groupBy("traj_id").agg(F.count("*").alias("n"))
    rows = manifest(spark, d).join(n.select(F.col("traj_id").alias("reference"), F.col("n").alias("ref_steps")), "reference", "left")
    return rows.join(n.select(F.col("traj_id").alias("compared"), F.col("n").alias("cmp_steps")), "compared", "left")


def members(spark, d):
    """Group g holds runs 5g .. 5g+4; the lowest id is the baseline."""
    runs = table(spark, d, "events").select(F.col("user_id").alias("traj_id")).distinct()
    return runs.select(F.floor(F.col("traj_id") / 5).cast("bigint").alias("group_id"), "traj_id", (F.col("traj_id") % 5).alias("run_pos"))


GROUP = ", mb AS (SELECT DISTINCT traj_id // 5 AS group_id, traj_id FROM st), gs AS (SELECT group_id, count(*) AS size FROM mb GROUP BY 1)"
KIND = "CASE WHEN count(DISTINCT traj_id) >= greatest(2, CAST(ceil(any_value(size) / 2.0) AS BIGINT)) THEN 'consensus' WHEN count(DISTINCT traj_id) = 1 THEN 'unique' ELSE 'partial' END"


@query("j15_run_pairs", events_sql(GROUP + " SELECT a.group_id, a.traj_id AS reference, b.traj_id AS compared FROM mb a JOIN mb b ON a.group_id = b.group_id AND a.traj_id < b.traj_id"))
def j15(spark, d):
    return g.run_pairs(members(spark, d)).drop("group_key")


@query("n02_best_worst", events_sql(GROUP + """, cd AS (SELECT group_id, traj_id, unnest(['steps', 'total_tokens']) AS metric, unnest([n, tok])::DOUBLE AS value FROM (SELECT traj_id // 5 AS group_id, traj_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS tok FROM st GROUP BY ALL)),
  mm AS (SELECT *, min(value) OVER w AS mn, max(value) OVER w AS mx, count(*) OVER w AS c FROM cd WINDOW w AS (PARTITION BY group_id, metric))
  SELECT group_id, traj_id, metric, CASE WHEN value = mn THEN 'best' ELSE 'worst' END AS flag FROM mm WHERE c >= 2 AND mn < mx AND value IN (mn, mx)"""))
def n02(spark, d):
    runs = event_runs(spark, d)
    card = members(spark, d).join(m.scorecard(runs.steps, runs.calls).select("traj_id", "steps", "total_tokens"), "traj_id", "left")
    return g.best_worst(card.withColumn("error", F.lit(None).cast("string")))


@query("n01_group_scorecard", None)
def n01(spark, d):
    from catalog.pressure import stage
    from runloom.operators import pressure as p

    runs, occ = stage(spark, d)
    merged = p.coalesce_events(p.compaction_events(occ, runs.steps, runs.calls, runs.parts), occ)
    stats = p.pressure_stats(p.pressure_points(occ), merged, p.window_limits(runs.steps, occ))
    return g.scorecard(members(spark, d), runs.steps, runs.calls, stats)


def group_pairs(spark, d):
    """Runs, their actions, and the groups they belong to."""
    runs, acts = staged(spark, d)
    return runs, acts, members(spark, d)


GROUP_PAIR = PAIR.replace(
    "SELECT a.traj_id // 2 AS g,", "SELECT a.traj_id * 100000 + b.traj_id AS g,"
).replace("ON b.traj_id = a.traj_id + 1 WHERE a.traj_id % 2 = 0", "ON b.traj_id // 5 = a.traj_id // 5 AND a.traj_id < b.traj_id")
BASE_PAIR = GROUP_PAIR.replace("a.traj_id < b.traj_id", "a.traj_id < b.traj_id AND a.traj_id % 5 = 0")


@query("n08_group_waste", events_sql(BASE_PAIR + EXTRA + """ SELECT (reference // 5) || '|' || reference || '|' || compared AS group_key, type, count(*) AS n FROM pr
  JOIN (SELECT g, type FROM pt UNION ALL SELECT g, parent_type FROM pt WHERE parent_type IS NOT NULL) x ON x.g = pr.g GROUP BY ALL"""))
def n08(spark, d):
    """Divergence patterns of every run against the first run of its group."""
    runs, acts, group = group_pairs(spark, d)
    p = cp.compare(acts, cut_lineage(g.baseline_pairs(group)))
    return dv.pattern_counts(dv.divergence_patterns(p.ref, p.cmp, p.matched))


@query("n04_n05_action_coverage", events_sql(PAIR + GROUP + f" SELECT group_id, kind AS action_type, target, count(DISTINCT traj_id) AS n_runs, {KIND.replace('kind', 'kind')} AS kind FROM ef JOIN mb USING (traj_id) JOIN gs USING (group_id) WHERE ef.kind NOT IN ('FILE_READ', 'FILE_WRITE') GROUP BY group_id, ef.kind, target"))
def n05(spark, d):
    runs, acts, group = group_pairs(spark, d)
    return g.coverage(g.action_cells(group, acts), group, ["action_type", "target"])


@query("n06_file_matrix", events_sql(PAIR + GROUP + " SELECT group_id, traj_id, target AS path, count(*) FILTER (kind = 'FILE_READ') AS reads, count(*) FILTER (kind = 'FILE_WRITE') AS writes FROM ef JOIN mb USING (traj_id) WHERE kind IN ('FILE_READ', 'FILE_WRITE') GROUP BY ALL"))
def n06(spark, d):
    runs, acts, group = group_pairs(spark, d)
    return g.file_cells(group, acts)


@query("n10_folder_rollup", events_sql(PAIR + GROUP + " SELECT group_id, 'src' AS folder, count(DISTINCT target) AS files, count(*) FILTER (kind = 'FILE_READ') AS reads, count(*) FILTER (kind = 'FILE_WRITE') AS writes FROM ef JOIN mb USING (traj_id) WHERE kind IN ('FILE_READ', 'FILE_WRITE') GROUP BY group_id"))
def n10(spark, d):
    runs, acts, group = group_pairs(spark, d)
    return g.folder_rollup(g.file_cells(group, acts))


@query("n07_tool_matrix", events_sql(GROUP + f" SELECT group_id, 'tool' AS capability, tool_name AS name, count(DISTINCT traj_id) AS n_runs, {KIND} AS kind FROM calls JOIN mb USING (traj_id) JOIN gs USING (group_id) GROUP BY ALL"))
def n07(spark, d):
    group = members(spark, d)
    cells = g.capability_cells(group, event_runs(spark, d, indexed=False).calls).withColumnRenamed("kind", "capability")
    return g.coverage(cells, group, ["capability", "name"])


@query("n09_distinct_run_ids", """WITH r AS (SELECT c_custkey // 5 AS group_id, c_custkey AS traj_id, c_custkey % 5 AS run_pos, 'run' || (c_custkey % 3) AS stem, CASE c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS f, 'm' || (c_custkey % 4) AS mo FROM customer),
  a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY group_id, stem) > 1 THEN stem || ' · ' || f ELSE stem END AS i FROM r),
  b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY group_id, i) > 1 THEN i || ' · ' || mo ELSE i END AS j FROM a)
  SELECT group_id, traj_id, CASE WHEN row_number() OVER (PARTITION BY group_id, j ORDER BY run_pos) = 1 THEN j ELSE j || '-' || row_number() OVER (PARTITION BY group_id, j ORDER BY run_pos) END AS run_id FROM b""")
def n09(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.floor(c / 5).cast("bigint").alias("group_id"), c.alias("traj_id"), (c % 5).alias("run_pos"), F.concat(F.lit("run"), (c % 3).cast("string")).alias("stem"),
        F.when(c % 2 == 0, "A").otherwise("B").alias("format_label"), F.concat(F.lit("m"), (c % 4).cast("string")).alias("model"),
    )
    return g.distinct_ids(rows).select("group_id", "traj_id", "run_id")


def _labels(spark, d):
    k = F.col("step_idx") % 7
    steps = event_runs(spark, d).steps
    phase = F.when(k == 0, "unknown").when(k < 3, "debug").when(k < 5, "implement").otherwise("validate")
    return steps.select("traj_id", "step_idx", "role", phase.alias("phase"), F.concat(F.lit("a"), (F.col("step_idx") % 5).cast("string")).alias("action"), F.col("duration").alias("duration_s"))


LABEL = """, lb AS (SELECT traj_id, step_idx, role, CASE WHEN step_idx % 7 = 0 THEN 'unknown' WHEN step_idx % 7 < 3 THEN 'debug' WHEN step_idx % 7 < 5 THEN 'implement' ELSE 'validate' END AS phase, 'a' || (step_idx % 5) AS action, cents FROM st)"""


@query("a27_label_summary", events_sql(LABEL + " SELECT traj_id, count(*) AS total, count(*) FILTER (phase <> 'unknown') AS classified, count(*) FILTER (phase = 'unknown') AS unknown, count(*) FILTER (phase <> 'unknown') / count(*)::DOUBLE AS rate FROM lb WHERE role = 'assistant' GROUP BY 1"))
def a27(spark, d):
    return lb.label_summary(_labels(spark, d))


@query("v08_label_distribution", events_sql(LABEL + """ SELECT traj_id, level, name, count(*) AS steps, sum(cents) / 1000.0::DOUBLE AS seconds, arg_min(phase, step_idx) AS phase FROM (
   SELECT *, 'phase' AS level, phase AS name FROM lb UNION ALL SELECT *, 'action', action FROM lb) WHERE role = 'assistant' AND phase <> 'unknown' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY traj_id, level, name")))
def v08(spark, d):
    return lb.label_distribution(_labels(spark, d))


@query("s37_taxonomy_check", events_sql(LABEL + " SELECT traj_id, step_idx, phase = 'debug' AND action IN ('a0', 'a1') AS valid FROM lb"))
def s37(spark, d):
    rows = _labels(spark, d)
    known = rows.filter("phase = 'debug' and action in ('a0', 'a1')").select("phase", "action").distinct()
    return lb.valid_labels(rows, known).select("traj_id", "step_idx", "valid")



@query("n03_f1_matrix", events_sql(GROUP_PAIR + SIM + """ SELECT reference // 5 AS group_id, reference, compared, CASE WHEN recall + precision > 0 THEN 2 * precision * recall / (recall + precision) ELSE 0 END AS f1 FROM pr JOIN si ON si.g = pr.g"""))
def n03(spark, d):
    runs, acts, group = group_pairs(spark, d)
    both = cut_lineage(g.run_pairs(group))
    p = cp.compare(acts, both.select("group_key", "reference", "compared"))
    return g.f1_matrix(both, dv.similarity(p.ref, p.cmp, p.matched))


@query("i21_pair_notes", events_sql(PAIR + """, ok AS (SELECT traj_id, coalesce(arg_max(finish, step_idx) FILTER (NOT is_user) = 'stop', false) AS s, count(*) AS n, CAST(sum(cents) AS BIGINT) AS t FROM st GROUP BY 1),
  sw AS (SELECT traj_id, string_agg(DISTINCT target, ',' ORDER BY target) AS w FROM ef WHERE kind = 'FILE_WRITE' AND effect = 'survived' GROUP BY 1)
  SELECT CAST(g AS VARCHAR) AS group_key, a.s AS reference_success, b.s AS compared_success, a.n AS reference_steps, b.n AS compared_steps, a.t AS reference_tokens, b.t AS compared_tokens,
   CASE WHEN a.s <> b.s THEN 'different outcomes' WHEN x.w IS DISTINCT FROM y.w THEN 'different files modified' END AS note
  FROM pr JOIN ok a ON a.traj_id = reference JOIN ok b ON b.traj_id = compared LEFT JOIN sw x ON x.traj_id = reference LEFT JOIN sw y ON y.traj_id = compared"""))
def i21n(spark, d):
    from runloom.plans.comparison import report, run_targets

    runs, p = pairs(spark, d)
    out = report(p, runs.steps, runs.calls, run_targets(runs.calls, runs.parts))
    return out.select("group_key", "reference_success", "compared_success", "reference_steps", "compared_steps", "reference_tokens", "compared_tokens", "note")


@query("i23_batch_errors", events_sql(PAIR + " SELECT CAST(g AS VARCHAR) AS group_key, CASE WHEN g % 10 = 0 THEN 'run without steps' END AS error FROM pr"))
def i23(spark, d):
    """A task whose run is missing fails alone; the others are reported."""
    from runloom.plans.comparison import compare, report, run_targets

    runs, acts = staged(spark, d)
    gone = F.when(F.col("group_key").cast("bigint") % 10 == 0, F.col("compared") + 10_000_000).otherwise(F.col("compared"))
    p = compare(acts, manifest(spark, d).withColumn("compared", gone))
    return report(p, runs.steps, runs.calls, run_targets(runs.calls, runs.parts)).select("group_key", "error")
