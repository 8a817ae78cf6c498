"""Pairs of runs: canonical actions, alignment, divergence, milestones, anchors."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.functions import calls as fc, paths
from runloom.operators import actions as ac, divergence as dv, files
from runloom.plans import comparison as cp
from runloom.session import cut_lineage
from runloom.sources.bridges import event_runs, table


def manifest(spark, d):
    """Pair p compares runs 2p and 2p+1."""
    runs = table(spark, d, "events").select(F.col("user_id").alias("traj_id")).distinct()
    ref = runs.filter("traj_id % 2 = 0").select(F.col("traj_id").alias("reference"), (F.col("traj_id") + 1).alias("compared"))
    both = ref.join(runs.select(F.col("traj_id").alias("compared")), "compared")
    return both.select((F.col("reference") / 2).cast("bigint").cast("string").alias("group_key"), "reference", "compared")


def anchors(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("traj_id")).distinct()
    return runs.select("traj_id", F.explode(F.array(F.lit("src/m0.py"), F.lit("src/m1.py"))).alias("path"))


def staged(spark, d):
    runs = event_runs(spark, d, once=True)
    return runs, cp.labelled(runs.steps, runs.calls, runs.parts)


def pairs(spark, d):
    runs, acts = staged(spark, d)
    return runs, cp.compare(acts, manifest(spark, d))


ACTS = """, ac AS (SELECT *, CASE WHEN tool_name = 'Read' THEN 'FILE_READ' WHEN tool_name = 'Edit' THEN 'FILE_WRITE' WHEN tool_name IN ('Grep', 'Glob') THEN 'SEARCH'
     WHEN command LIKE 'cat%' THEN 'FILE_READ' WHEN command LIKE 'grep%' THEN 'SEARCH' WHEN tool_name = 'TodoWrite' THEN 'REASON' ELSE 'COMMAND' END AS kind,
    CASE WHEN tool_name IN ('Read', 'Edit') THEN file_path WHEN tool_name IN ('Grep', 'Glob') THEN pattern || '@' || path WHEN command LIKE 'cat%' THEN substr(command, 7)
     WHEN command LIKE 'grep%' THEN 'x@src' WHEN tool_name = 'TodoWrite' THEN '' WHEN tool_name = 'Bash' THEN split_part(command, ' ', 1) ELSE tool_name END AS target,
    failed OR coalesce(exit_code, 0) <> 0 AS bad, t_end - t_start AS latency FROM calls),
 gf AS (SELECT DISTINCT traj_id, file_path AS target FROM calls WHERE tool_name = 'Edit' AND NOT failed
   UNION SELECT DISTINCT traj_id, 'src/m' || (k % 5) || '.py' FROM st WHERE event_type = 'purchase' AND k % 3 = 0),
 lw AS (SELECT traj_id, target, max(step_idx) AS lw FROM ac WHERE kind = 'FILE_WRITE' GROUP BY ALL),
 ef AS (SELECT ac.traj_id, ac.step_idx, kind, ac.target, latency, cents AS share, CASE WHEN bad THEN 'failed' WHEN kind = 'FILE_WRITE' THEN CASE WHEN lw <> step_idx THEN 'reverted' ELSE 'survived' END
     WHEN kind = 'COMMAND' THEN CASE WHEN command LIKE 'pytest%' THEN 'justified' ELSE 'survived' END WHEN kind = 'FILE_READ' AND gf.target IS NOT NULL THEN 'justified' ELSE 'unknown' END AS effect,
     row_number() OVER (PARTITION BY ac.traj_id ORDER BY step_idx) - 1 AS seq, cents * 1000 + latency * 50 AS mc
   FROM ac LEFT JOIN lw ON lw.traj_id = ac.traj_id AND lw.target = ac.target LEFT JOIN gf ON gf.traj_id = ac.traj_id AND gf.target = ac.target WHERE kind <> 'REASON')"""


@query("i01_canonical_actions", events_sql(ACTS + """ SELECT traj_id, step_idx, 0::BIGINT AS act_pos, kind AS action_type, target, latency AS latency_ms FROM ac
  UNION ALL SELECT traj_id, step_idx, -1, 'REASON', '', cents FROM st"""))
def i01(spark, d):
    runs = event_runs(spark, d)
    return ac.actions(runs.steps, runs.calls, runs.parts).select("traj_id", "step_idx", "act_pos", "action_type", "target", "latency_ms")


@query("i02_token_share", events_sql(ACTS + """ SELECT traj_id, step_idx, CAST(0 AS BIGINT) AS act_pos, CASE WHEN kind = 'REASON' THEN 0 ELSE cents END AS token_share FROM ac
  UNION ALL SELECT traj_id, step_idx, -1, CASE WHEN tool_name IS NULL OR tool_name = 'TodoWrite' THEN cents ELSE 0 END FROM st"""))
def i02(spark, d):
    runs = event_runs(spark, d)
    return ac.actions(runs.steps, runs.calls, runs.parts).select("traj_id", "step_idx", "act_pos", "token_share")


@query("i03_effect_labels", events_sql(ACTS + " SELECT traj_id, step_idx, seq, kind AS action_type, target, effect FROM ef"))
def i03(spark, d):
    return staged(spark, d)[1].select("traj_id", "step_idx", "seq", "action_type", "target", "effect")


@query("i06_action_cost", events_sql(ACTS + " SELECT traj_id, seq, share + latency / 1000.0::DOUBLE * 50 AS cost FROM ef"))
def i06(spark, d):
    return staged(spark, d)[1].select("traj_id", "seq", ac.cost().alias("cost"))


@query("i05_reduced_command", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'FILE_READ' WHEN 2 THEN 'FILE_WRITE' END AS action_type,
   CASE event_id % 4 WHEN 0 THEN 'v' || event_id || '@/src' WHEN 1 THEN '/w/f' || event_id WHEN 2 THEN '/w/g' || event_id END AS target FROM events""")
def i05(spark, d):
    e, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = (
        F.when(e == 0, F.concat(F.lit("cat a.txt | grep -n v"), n, F.lit(" /src")))
        .when(e == 1, F.concat(F.lit("ls | head -5 /w/f"), n))
        .when(e == 2, F.concat(F.lit("echo x | tee /w/g"), n))
        .otherwise(F.concat(F.lit("make | wc "), n))
    )
    return table(spark, d, "events").select("event_id", ac.reduced(line).alias("r")).select("event_id", "r.action_type", "r.target")


PAIR = ACTS + """, pr AS (SELECT a.traj_id // 2 AS g, a.traj_id AS reference, b.traj_id AS compared FROM (SELECT DISTINCT traj_id FROM st) a JOIN (SELECT DISTINCT traj_id FROM st) b ON b.traj_id = a.traj_id + 1 WHERE a.traj_id % 2 = 0),
 mx AS (SELECT g, r.seq AS i, c.seq AS j, r.kind = c.kind AND r.target = c.target AND (r.effect = c.effect OR r.effect = 'unknown' OR c.effect = 'unknown' OR
     (r.effect IN ('survived', 'justified') AND c.effect IN ('survived', 'justified'))) AS hit FROM pr JOIN ef r ON r.traj_id = reference JOIN ef c ON c.traj_id = compared),
 mr AS (SELECT g, i, list(hit ORDER BY j) AS h FROM mx GROUP BY ALL),
 dp AS (SELECT g, -1::BIGINT AS i, [0] || list_transform(h, lambda x: 0) AS row FROM mr WHERE i = 0
   UNION ALL SELECT dp.g, mr.i, list_reduce(list_transform(range(1, len(mr.h) + 1), lambda j: [CASE WHEN mr.h[j] THEN dp.row[j] + 1 ELSE 0 END, dp.row[j + 1]]),
      lambda acc, x: acc || [greatest(x[1], x[2], acc[len(acc)])], [0]) FROM dp JOIN mr ON mr.g = dp.g AND mr.i = dp.i + 1),
 sz AS (SELECT g, max(i) AS n, max(len(h)) AS m FROM mr GROUP BY g),
 bt AS (SELECT g, n AS i, m AS j, false AS m, -1::BIGINT AS mi, -1::BIGINT AS mj FROM sz
   UNION ALL SELECT b.g, CASE WHEN k.take OR k.up THEN b.i - 1 ELSE b.i END, CASE WHEN k.take THEN b.j - 1 WHEN k.up THEN b.j ELSE b.j - 1 END, k.take, b.i, b.j - 1
   FROM bt b JOIN (SELECT c.g, c.i, c.row AS cur, p.row AS prv, mr.h FROM dp c JOIN dp p ON p.g = c.g AND p.i = c.i - 1 JOIN mr ON mr.g = c.g AND mr.i = c.i) t ON t.g = b.g AND t.i = b.i,
   LATERAL (SELECT t.h[b.j] AND t.cur[b.j + 1] = t.prv[b.j] + 1 AS take, t.prv[b.j + 1] >= t.cur[b.j] AS up) k WHERE b.i >= 0 AND b.j > 0),
 al AS (SELECT g, mi AS ref_seq, mj AS cmp_seq FROM bt WHERE m),
 rf AS (SELECT g, ef.* FROM pr JOIN ef ON traj_id = reference), cm AS (SELECT g, ef.* FROM pr JOIN ef ON traj_id = compared)"""


@query("i04_equivalence_counts", events_sql(PAIR + " SELECT CAST(g AS VARCHAR) AS group_key, CAST(count(*) FILTER (hit) AS BIGINT) AS matches FROM mx GROUP BY g"))
def i04(spark, d):
    """Equivalent action pairs per run pair, counted from distinct (type, target, effect) of both sides."""
    runs, p = pairs(spark, d)
    return equivalences(p)


def equivalences(p):
    keys = ["group_key", "action_type", "target", "effect"]
    a = p.ref.groupBy(*keys).agg(F.count("*").alias("n"))
    b = p.cmp.groupBy(*keys).agg(F.count("*").alias("m"))
    shape = lambda df: df.withColumn(
        "key",
        F.when(F.col("action_type") == "SEARCH", F.regexp_replace("target", "@[^@]*$", ""))
        .when(F.col("action_type").isin("FILE_READ", "FILE_WRITE"), paths.basename(F.col("target")))
        .when(F.col("action_type") == "AGENT_SPAWN", "")
        .otherwise(fc.base_command(F.col("target"))),
    )
    a = shape(a).select("group_key", "action_type", "key", F.col("target").alias("t1"), F.col("effect").alias("e1"), "n")
    b = shape(b).select("group_key", "action_type", "key", F.col("target").alias("t2"), F.col("effect").alias("e2"), "m")
    x, y = F.col("t1"), F.col("t2")
    two = F.coalesce(paths.last_two(x) == paths.last_two(y), F.lit(False))
    files_ok = paths.same_file(x, y) | two
    done = F.array(F.lit("survived"), F.lit("justified"))
    fits = (F.col("e1") == F.col("e2")) | (F.col("e1") == "unknown") | (F.col("e2") == "unknown") | (F.array_contains(done, F.col("e1")) & F.array_contains(done, F.col("e2")))
    scope = lambda t: F.regexp_extract(t, "@([^@]*)$", 1)
    sx, sy = scope(x), scope(y)
    search_ok = (sx == "") | (sy == "") | paths.same_file(sx, sy) | F.coalesce(paths.last_two(sx) == paths.last_two(sy), F.lit(False))
    kind = F.col("action_type")
    ok = F.when(kind.isin("FILE_READ", "FILE_WRITE"), files_ok).when(kind == "SEARCH", search_ok).otherwise(F.lit(True))
    hits = a.join(b, ["group_key", "action_type", "key"]).filter(fits & ok).groupBy("group_key").agg(F.sum(F.col("n") * F.col("m")).alias("matches"))
    return p.manifest.select("group_key").join(hits, "group_key", "left").fillna(0)


@query("i07_alignment", events_sql(PAIR + " SELECT CAST(g AS VARCHAR) AS group_key, ref_seq, cmp_seq FROM al"))
def i07(spark, d):
    return pairs(spark, d)[1].matched


SIM = """, sr AS (SELECT rf.g AS g, count(*) AS n, sum(mc)::DOUBLE AS w, count(ref_seq) AS h, coalesce(sum(mc) FILTER (ref_seq IS NOT NULL), 0)::DOUBLE AS hw FROM rf LEFT JOIN al ON al.g = rf.g AND ref_seq = seq GROUP BY rf.g),
 sc AS (SELECT cm.g AS g, count(*) AS n, sum(mc)::DOUBLE AS w, count(cmp_seq) AS h, coalesce(sum(mc) FILTER (cmp_seq IS NOT NULL), 0)::DOUBLE AS hw FROM cm LEFT JOIN al ON al.g = cm.g AND cmp_seq = seq GROUP BY cm.g),
 si AS (SELECT sr.g, sr.hw / sr.w AS recall, sc.hw / sc.w AS precision, sc.w / sr.w AS overhead, sr.n AS ref_actions, sc.n AS cmp_actions, sr.h AS matched FROM sr JOIN sc ON sc.g = sr.g)"""


@query("i08_alignment_metrics", events_sql(PAIR + SIM + """ SELECT CAST(g AS VARCHAR) AS group_key, recall, precision, overhead, ref_actions, cmp_actions, matched,
   CASE WHEN recall + precision > 0 THEN 2 * precision * recall / (recall + precision) ELSE 0 END AS f1 FROM si"""))
def i08(spark, d):
    p = pairs(spark, d)[1]
    return dv.similarity(p.ref, p.cmp, p.matched)


EXTRA = """, ex AS (SELECT cm.*, row_number() OVER (PARTITION BY cm.g ORDER BY seq) - 1 AS e FROM cm WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.g = cm.g AND cmp_seq = seq)),
 kx AS (SELECT *, row_number() OVER (PARTITION BY g, kind, target ORDER BY e) AS kk, count(*) OVER (PARTITION BY g, kind, target) AS ks, effect = 'failed' AS fl FROM ex),
 kg AS (SELECT *, kk - row_number() OVER (PARTITION BY g, kind, target, fl ORDER BY e) AS isl FROM kx),
 kp AS (SELECT *, fl AND (row_number() OVER (PARTITION BY g, kind, target, fl, isl ORDER BY e) - 1) % 2 = 0 AND kk < ks AS starts FROM kg),
 kf AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY g, kind, target ORDER BY e), false) AS follows FROM kp),
 wr AS (SELECT kf.*, (SELECT min(w.step_idx) FROM cm w WHERE w.g = kf.g AND w.kind = 'FILE_WRITE' AND w.target = kf.target AND w.step_idx > kf.step_idx) AS nx FROM kf),
 t1 AS (SELECT *, starts OR follows OR (kind = 'FILE_WRITE' AND effect = 'reverted') AS k1 FROM wr),
 t2 AS (SELECT t1.*, NOT k1 AND kind = 'COMMAND' AND coalesce(step_idx < (SELECT min(w.step_idx) FROM cm w WHERE w.g = t1.g AND w.kind = 'FILE_WRITE'), false) AND target LIKE '%test%' AS early FROM t1),
 t3 AS (SELECT *, NOT (k1 OR early) AND kind = 'SEARCH' AS sq FROM t2),
 t4 AS (SELECT t3.*, sq AND (e > min(CASE WHEN sq THEN e END) OVER (PARTITION BY g, target) OR EXISTS (SELECT 1 FROM cm w JOIN al ON al.g = w.g AND cmp_seq = w.seq WHERE w.g = t3.g AND w.kind = 'SEARCH' AND w.target = t3.target)) AS again FROM t3),
 t5 AS (SELECT t4.*, NOT (k1 OR early OR again) AND kind = 'FILE_READ' AND effect = 'unknown' AND NOT EXISTS (SELECT 1 FROM cm w JOIN al ON al.g = w.g AND cmp_seq = w.seq WHERE w.g = t4.g AND w.target = t4.target AND w.step_idx > t4.step_idx) AS broad FROM t4),
 t6 AS (SELECT *, NOT (k1 OR early OR again OR broad) AND kind IN ('FILE_READ', 'SEARCH') AND effect = 'unknown' AS idle FROM t5),
 de AS (SELECT g, min(step_idx) AS a, max(step_idx) AS b, count(*) AS n, sum(share) AS tok, arg_min(kind || '(' || target || ')', e) AS f, arg_max(kind || '(' || target || ')', e) AS l FROM (SELECT *, e - row_number() OVER (PARTITION BY g, idle ORDER BY e) AS dead FROM t6) WHERE idle GROUP BY g, dead HAVING count(*) >= 2),
 fu AS (SELECT r.g, r.f AS r, c.f AS c, c.s FROM (SELECT g, kind, target, min(seq) AS f FROM rf GROUP BY ALL) r JOIN (SELECT g, kind, target, min(seq) AS f, arg_min(step_idx, seq) AS s FROM cm GROUP BY ALL) c ON c.g = r.g AND c.kind = r.kind AND c.target = r.target),
 iv AS (SELECT a.g, count(*) AS inv FROM fu a JOIN fu b ON a.g = b.g AND a.c < b.c AND a.r > b.r GROUP BY a.g),
 od AS (SELECT fu.g, count(*) AS common, any_value(coalesce(inv, 0)) AS inversions, min(s) AS first_step, max(s) AS last_step FROM fu LEFT JOIN iv ON iv.g = fu.g GROUP BY fu.g HAVING count(*) >= 3),
 oe AS (SELECT *, common * (common - 1) // 2 AS possible, greatest(1, CAST(ceil((common * (common - 1) // 2) * 0.3::DOUBLE) AS BIGINT)) AS threshold FROM od),
 pt AS (SELECT g, CASE WHEN coalesce(nx - step_idx, 999) <= 3 THEN 'reverted_and_rewritten' ELSE 'iterative_refinement' END AS type, 'write_retry' AS parent_type, step_idx AS first_step, step_idx AS last_step, 1 AS steps, share AS tokens,
     CASE WHEN coalesce(nx - step_idx, 999) <= 3 THEN least(0.9, 0.7 + (3 - (nx - step_idx)) * 0.1) ELSE greatest(0.3, 0.5 - (coalesce(nx - step_idx, 999) - 3) * 0.02) END AS confidence, 'FILE_WRITE(' || target || ') [reverted] → rewrite at +' || coalesce(nx - step_idx, 999) || ' steps' AS evidence FROM t6 WHERE kind = 'FILE_WRITE' AND effect = 'reverted'
   UNION ALL SELECT g, 'error_recovery_overhead', NULL, s0, step_idx, 2, share + h0, 0.8, kind || '(' || target || ') [failed], then again' FROM (SELECT *, lag(step_idx) OVER (PARTITION BY g, kind, target ORDER BY e) AS s0, lag(share) OVER (PARTITION BY g, kind, target ORDER BY e) AS h0 FROM t6) WHERE follows
   UNION ALL SELECT g, 'premature_validation', NULL, step_idx, step_idx, 1, share, PREMATURE, 'COMMAND(' || target || ') before first write' FROM t6 WHERE early
   UNION ALL SELECT g, 'redundant_search', NULL, step_idx, step_idx, 1, share, REDUNDANT, 'SEARCH(' || target || ') repeated' FROM t6 WHERE again
   UNION ALL SELECT g, 'broad_exploration', NULL, step_idx, step_idx, 1, share, 0.5, 'FILE_READ(' || target || ')' FROM t6 WHERE broad
   UNION ALL SELECT g, 'dead_end_branch', NULL, a, b, n, CAST(tok AS BIGINT), least(0.8, 0.5 + n * 0.1), n || ' actions from ' || f || ' to ' || l FROM de
   UNION ALL SELECT g, 'ordering_inefficiency', NULL, first_step, last_step, common, 0, least(0.9, 0.5 + inversions / possible::DOUBLE * 0.4), inversions || ' inversions across ' || common || ' unique common actions (threshold ' || threshold || ')' FROM oe WHERE inversions >= threshold)"""
EXTRA = EXTRA.replace("PREMATURE", "0.5").replace("REDUNDANT", "0.7")

PATTERN_SQL = """ SELECT CAST(g AS VARCHAR) AS group_key, type, parent_type, first_step, last_step, steps::BIGINT AS steps, tokens::BIGINT AS tokens, round(confidence, 2)::DOUBLE AS confidence, evidence FROM pt"""


def _patterns(spark, d):
    p = pairs(spark, d)[1]
    return p, dv.divergence_patterns(p.ref, p.cmp, p.matched)


@query("i14_i20_divergence_patterns", events_sql(PAIR + EXTRA + PATTERN_SQL))
def i14(spark, d):
    return _patterns(spark, d)[1]


@query("i18_dead_end_actions", events_sql(PAIR + EXTRA + """, dx AS (SELECT *, e - row_number() OVER (PARTITION BY g, idle ORDER BY e) AS dead FROM t6), dn AS (SELECT *, count(*) OVER (PARTITION BY g, dead) AS n, min(step_idx) OVER (PARTITION BY g, dead) AS first_step, e - min(e) OVER (PARTITION BY g, dead) AS position FROM dx WHERE idle)
  SELECT CAST(g AS VARCHAR) AS group_key, first_step, position, step_idx, kind AS action_type, target FROM dn WHERE n >= 2"""))
def i18(spark, d):
    p = pairs(spark, d)[1]
    return dv.dead_end_actions(p.ref, p.cmp, p.matched)


@query("i19_ordering", events_sql(PAIR + EXTRA + " SELECT CAST(g AS VARCHAR) AS group_key, common, first_step, last_step, inversions, possible, threshold FROM oe"))
def i19(spark, d):
    p = pairs(spark, d)[1]
    return dv.ordering(p.ref, p.cmp)


@query("i09_harmful_divergence", events_sql(PAIR + EXTRA + """, hm AS (SELECT t6.*, effect IN ('failed', 'reverted') OR EXISTS (SELECT 1 FROM de WHERE de.g = t6.g AND t6.step_idx BETWEEN a AND b) AS hz FROM t6)
  SELECT CAST(cm.g AS VARCHAR) AS group_key, coalesce(any_value(h.c), 0) AS harmful, coalesce(any_value(h.t), 0)::BIGINT AS harmful_tokens, coalesce(any_value(h.l), 0)::BIGINT AS harmful_latency_ms,
   least(coalesce(any_value(h.m), 0)::DOUBLE / sum(mc)::DOUBLE, 1.0) AS harmful_ratio FROM cm LEFT JOIN (SELECT g, count(*) AS c, sum(share) AS t, sum(latency) AS l, sum(mc) AS m FROM hm WHERE hz GROUP BY g) h ON h.g = cm.g GROUP BY cm.g"""))
def i09(spark, d):
    p, patterns = _patterns(spark, d)
    return dv.harmful(p.cmp, p.matched, patterns)


@query("k07_action_sets", events_sql(PAIR + """ SELECT CAST(g AS VARCHAR) AS group_key, kind AS action_type, target, CASE WHEN a AND b THEN 'common' WHEN a THEN 'reference' ELSE 'compared' END AS side
   FROM (SELECT g, kind, target, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT g, kind, target, 0 AS s FROM rf UNION ALL SELECT g, kind, target, 1 FROM cm) GROUP BY ALL)"""))
def k07(spark, d):
    p = pairs(spark, d)[1]
    keys = ["group_key", "action_type", "target"]
    a = p.ref.select(*keys).distinct().withColumn("a", F.lit(1))
    b = p.cmp.select(*keys).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "common").when(F.col("a").isNotNull(), "reference").otherwise("compared")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


MILE = """, ml AS (SELECT traj_id, min(step_idx) FILTER (kind IN ('FILE_READ', 'SEARCH') AND tgt) AS first_relevant_file, min(step_idx) FILTER (kind = 'FILE_WRITE' AND tgt) AS first_edit,
   min(step_idx) FILTER (kind = 'FILE_WRITE' AND tgt AND effect = 'survived') AS first_surviving_edit, min(step_idx) FILTER (kind = 'COMMAND' AND effect IN ('justified') AND target = 'pytest') AS first_passing_validation,
   max(step_idx) FILTER (kind = 'FILE_WRITE' AND effect = 'survived') AS final_patch FROM (SELECT ef.*, EXISTS (SELECT 1 FROM gf WHERE gf.traj_id = ef.traj_id AND gf.target = ef.target) AS tgt FROM ef) GROUP BY traj_id)"""


@query("i10_milestones", events_sql(ACTS + MILE + " SELECT * FROM ml"))
def i10(spark, d):
    runs, acts = staged(spark, d)
    return ac.milestones(acts, files.target_files(runs.calls, runs.parts))


@query("i11_milestone_deltas", events_sql(PAIR + MILE.replace(", ml AS", ", pg AS (SELECT g, reference AS traj_id, target FROM pr JOIN gf ON gf.traj_id IN (reference, compared) UNION SELECT g, compared, target FROM pr JOIN gf ON gf.traj_id IN (reference, compared)), ml AS").replace("FROM gf WHERE gf.traj_id = ef.traj_id AND gf.target = ef.target", "FROM pg WHERE pg.traj_id = ef.traj_id AND pg.target = ef.target") + """
  SELECT CAST(g AS VARCHAR) AS group_key, c.first_relevant_file - r.first_relevant_file AS first_relevant_file_delta, c.first_edit - r.first_edit AS first_edit_delta,
   c.first_surviving_edit - r.first_surviving_edit AS first_surviving_edit_delta, c.first_passing_validation - r.first_passing_validation AS first_passing_validation_delta, c.final_patch - r.final_patch AS final_patch_delta
  FROM pr JOIN ml r ON r.traj_id = reference JOIN ml c ON c.traj_id = compared"""))
def i11(spark, d):
    runs, p = pairs(spark, d)
    return dv.milestone_deltas(*cp.pair_milestones(p, cp.run_targets(runs.calls, runs.parts)))


@query("i12_segments", events_sql(ACTS + MILE + """, bd AS (SELECT traj_id, name, pos, rank FROM (SELECT traj_id, 'first_relevant_file' AS name, first_relevant_file AS pos, 0 AS rank FROM ml UNION ALL SELECT traj_id, 'first_edit', first_edit, 1 FROM ml
    UNION ALL SELECT traj_id, 'first_surviving_edit', first_surviving_edit, 2 FROM ml UNION ALL SELECT traj_id, 'first_passing_validation', first_passing_validation, 3 FROM ml UNION ALL SELECT traj_id, 'final_patch', final_patch, 4 FROM ml) WHERE pos IS NOT NULL),
  be AS (SELECT * FROM bd UNION ALL SELECT traj_id, 'start', 0, -1 FROM ml UNION ALL SELECT traj_id, 'end', max(step_idx) + 1, 9 FROM ef GROUP BY traj_id),
  bs AS (SELECT *, CASE rank WHEN -1 THEN -1 WHEN 9 THEN 9999999 ELSE pos END AS o FROM be),
  sg AS (SELECT traj_id, row_number() OVER w AS seg, name || ' → ' || lead(name) OVER w AS label, pos AS start_step, lead(pos) OVER w AS end_step, rank FROM bs WINDOW w AS (PARTITION BY traj_id ORDER BY o, rank))
  SELECT traj_id, seg, label, start_step, end_step FROM sg WHERE rank <> 9"""))
def i12(spark, d):
    runs, acts = staged(spark, d)
    return ac.segments(acts, ac.milestones(acts, files.target_files(runs.calls, runs.parts))).drop("milestone_order")


@query("i13_segment_comparison", None)
def i13(spark, d):
    runs, p = pairs(spark, d)
    return cp.compare_segments(p, cp.run_targets(runs.calls, runs.parts))


@query("i21_pair_report", None)
def i21(spark, d):
    runs, p = pairs(spark, d)
    return cp.report(p, runs.steps, runs.calls, cp.run_targets(runs.calls, runs.parts))


ANCH = """, ah AS (SELECT traj_id, kind, target, step_idx FROM ef WHERE kind IN ('FILE_READ', 'FILE_WRITE')),
 am AS (SELECT traj_id, 2::BIGINT AS anchor_files, count(DISTINCT target) FILTER (kind = 'FILE_WRITE') AS files_written, count(DISTINCT target) FILTER (kind = 'FILE_WRITE' AND target IN ('src/m0.py', 'src/m1.py')) AS anchor_files_written,
   min(step_idx) FILTER (kind = 'FILE_READ' AND target IN ('src/m0.py', 'src/m1.py')) AS first_anchor_read, min(step_idx) FILTER (kind = 'FILE_WRITE' AND target IN ('src/m0.py', 'src/m1.py')) AS first_anchor_write
   FROM (SELECT DISTINCT traj_id FROM st) LEFT JOIN ah USING (traj_id) GROUP BY traj_id),
 an AS (SELECT *, CASE WHEN files_written > 0 THEN anchor_files_written / files_written::DOUBLE END AS write_precision, anchor_files_written / 2.0::DOUBLE AS write_recall,
   CASE WHEN files_written > 0 THEN (files_written - anchor_files_written) / files_written::DOUBLE END AS off_patch_write_ratio FROM am)"""


@query("a39_anchor_metrics", events_sql(ACTS + ANCH + " SELECT * FROM an"))
def a39(spark, d):
    return ac.anchor_metrics(staged(spark, d)[1], anchors(spark, d))


@query("i22_anchor_analysis", events_sql(PAIR + ANCH + """ SELECT CAST(g AS VARCHAR) AS group_key, 'reference' AS side, write_precision, write_recall FROM pr JOIN an ON traj_id = reference
  UNION ALL SELECT CAST(g AS VARCHAR), 'compared', write_precision, write_recall FROM pr JOIN an ON traj_id = compared"""))
def i22(spark, d):
    runs, acts = staged(spark, d)
    ends = manifest(spark, d).select("group_key", F.explode(F.create_map(F.lit("reference"), "reference", F.lit("compared"), "compared")).alias("side", "traj_id"))
    return ends.join(ac.anchor_metrics(acts, anchors(spark, d)), "traj_id").select("group_key", "side", "write_precision", "write_recall")


@query("j07_anchor_hits", events_sql(ACTS + ANCH + " SELECT DISTINCT traj_id, target, target AS anchor FROM ah WHERE target IN ('src/m0.py', 'src/m1.py')"))
def j07(spark, d):
    return ac.anchor_hits(staged(spark, d)[1], anchors(spark, d))


@query("a39_anchor_class_recall", events_sql(ACTS + """ SELECT s.traj_id, 'source' AS class, 2::BIGINT AS files, coalesce(w, 0) AS written, coalesce(w, 0) / 2.0::DOUBLE AS recall FROM (SELECT DISTINCT traj_id FROM st) s
   LEFT JOIN (SELECT traj_id, count(DISTINCT target) AS w FROM ef WHERE kind = 'FILE_WRITE' AND target IN ('src/m0.py', 'src/m1.py') GROUP BY 1) x USING (traj_id)"""))
def a39c(spark, d):
    return ac.anchor_class_recall(staged(spark, d)[1], anchors(spark, d))


@query("a40_eval_layers", events_sql(PAIR + EXTRA + ANCH + """, vc AS (SELECT pr.g, count(*) FILTER (type = 'broad_exploration') AS be, count(*) FILTER (type = 'reverted_and_rewritten') AS rr, count(*) FILTER (type = 'iterative_refinement') AS ir,
    count(*) FILTER (type = 'error_recovery_overhead') AS er, count(*) FILTER (type = 'dead_end_branch') AS db FROM pr LEFT JOIN pt ON pt.g = pr.g GROUP BY pr.g),
  vv AS (SELECT vc.*, an.* FROM vc JOIN pr ON pr.g = vc.g JOIN an ON an.traj_id = compared)
  SELECT CAST(g AS VARCHAR) AS group_key, layer, CASE WHEN w = 2 THEN 'weak' WHEN w = 1 THEN 'moderate' ELSE 'strong' END AS verdict FROM (
   SELECT g, 'file_selection' AS layer, greatest(CASE WHEN write_precision < 0.5 THEN 2 WHEN write_precision < 0.75 THEN 1 ELSE 0 END, CASE WHEN off_patch_write_ratio > 0.5 THEN 2 WHEN off_patch_write_ratio > 0.25 THEN 1 ELSE 0 END, CASE WHEN be > 8 THEN 2 WHEN be > 3 THEN 1 ELSE 0 END) AS w FROM vv
   UNION ALL SELECT g, 'edit_stability', greatest(CASE WHEN rr > 5 THEN 2 WHEN rr > 2 THEN 1 ELSE 0 END, CASE WHEN ir > 8 THEN 2 WHEN ir > 3 THEN 1 ELSE 0 END, CASE WHEN er > 3 THEN 2 WHEN er > 1 THEN 1 ELSE 0 END) FROM vv
   UNION ALL SELECT g, 'completion_quality', greatest(CASE WHEN write_recall < 0.25 THEN 2 WHEN write_recall < 0.5 THEN 1 ELSE 0 END, CASE WHEN db > 3 THEN 2 WHEN db > 1 THEN 1 ELSE 0 END) FROM vv)"""))
def a40(spark, d):
    runs, acts = staged(spark, d)
    p = cp.compare(acts, manifest(spark, d))
    cover = ac.anchor_metrics(acts, anchors(spark, d)).withColumnRenamed("traj_id", "compared")
    cover = p.manifest.join(cover, "compared")
    return dv.eval_layers(p.manifest, dv.divergence_patterns(p.ref, p.cmp, p.matched), cover)


@query("a41_file_class", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'fixture' WHEN 2 THEN 'generated' WHEN 3 THEN 'spec' ELSE 'source' END AS class FROM events""")
def a41(spark, d):
    n = F.col("event_id").cast("string")
    shapes = (
        F.concat(F.lit("a/b/test_"), n, F.lit(".py")), F.concat(F.lit("x/testdata/y"), n), F.concat(F.lit("q/"), n, F.lit(".pb.go")),
        F.concat(F.lit("api/v"), n, F.lit(".proto")), F.concat(F.lit("test_"), n, F.lit(".py")), F.concat(F.lit("src/m"), n, F.lit(".py")),
    )
    path = F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", ac.file_class(path).alias("class"))


@query("j12_step_labels", events_sql(ACTS + """ SELECT traj_id, step_idx, CASE WHEN step_idx % 3 = 0 THEN 'debug' WHEN step_idx % 3 = 1 THEN 'implement' END AS phase_label FROM ac"""))
def j12(spark, d):
    runs = event_runs(spark, d)
    labels = runs.steps.filter("step_idx % 3 < 2").select("traj_id", "step_idx", F.when(F.col("step_idx") % 3 == 0, "debug").otherwise("implement").alias("phase"), F.lit("x").alias("action"))
    return ac.actions(runs.steps, runs.calls, runs.parts, labels).filter("act_pos >= 0").select("traj_id", "step_idx", "phase_label")


@query("j18_justified_reads", events_sql(ACTS + " SELECT DISTINCT traj_id, target, 'target_file' AS why FROM ef WHERE kind = 'FILE_READ' AND EXISTS (SELECT 1 FROM gf WHERE gf.traj_id = ef.traj_id AND gf.target = ef.target)"))
def j18(spark, d):
    runs, acts = staged(spark, d)
    return ac.justified_reads(acts, runs.calls, files.target_files(runs.calls, runs.parts))


@query("i07_alignment_fuzzy", None)
def i07f(spark, d):
    runs, acts = staged(spark, d)
    return cut_lineage(cp.compare(acts, manifest(spark, d), fuzzy=True).matched)


