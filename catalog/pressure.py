"""Context-window pressure."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.operators import pressure as p
from runloom.session import cut_lineage
from runloom.sources.bridges import event_runs


def stage(spark, d):
    """Bridge runs, their occupancy table and compaction signals; the tables are reused several times."""
    runs = event_runs(spark, d, once=True)
    occ = cut_lineage(p.occupancy(runs.steps))
    return runs, occ


# Window agent of the bridge is the agent name; occupancy is fresh input plus cache read.
OCC = """, oc AS (SELECT *, agent AS win, is_user AND k % 20 = 0 AS checkpoint, NOT is_user AS turn, tok_input + cache_read AS occ FROM st),
 ob AS (SELECT *, last_value(CASE WHEN turn AND occ > 0 THEN occ END IGNORE NULLS) OVER (PARTITION BY traj_id, win ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
   first_value(CASE WHEN turn AND occ > 0 THEN occ END IGNORE NULLS) OVER (PARTITION BY traj_id, win ORDER BY step_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
   turn AND occ > 0 AS live FROM oc),
 ev1 AS (SELECT traj_id, win, step_idx, 'compaction_message' AS kind, bef, coalesce(CASE WHEN occ > 0 THEN occ END, nxt) AS aft FROM ob WHERE checkpoint),
 ts AS (SELECT DISTINCT traj_id, agent AS win, compacted AS ts FROM calls WHERE compacted IS NOT NULL),
 wv AS (SELECT traj_id, win, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY traj_id, win ORDER BY ts) AS pr FROM ts) WHERE pr IS NULL OR ts - pr > 30000),
 ho AS (SELECT w.traj_id, w.win, w.ts, coalesce((SELECT min(step_idx) FROM ob o WHERE o.traj_id = w.traj_id AND o.win = w.win AND o.turn AND o.created >= w.ts),
    (SELECT max(step_idx) FROM ob o WHERE o.traj_id = w.traj_id AND o.win = w.win AND o.turn)) AS step_idx FROM wv w),
 ev2 AS (SELECT o.traj_id, o.win, o.step_idx, 'tool_prune' AS kind, bef, coalesce(CASE WHEN occ > 0 THEN occ END, nxt) AS aft FROM ho JOIN ob o USING (traj_id, step_idx)),
 kn AS (SELECT * FROM ev1 UNION ALL SELECT * FROM ev2 WHERE bef IS NULL OR aft IS NULL OR bef > aft),
 pt AS (SELECT *, lag(step_idx) OVER w AS ps, lag(occ) OVER w AS po, lead(occ) OVER w AS ne, max(cache_read) OVER (PARTITION BY traj_id, win) > 0 AS cached FROM ob WHERE live
   WINDOW w AS (PARTITION BY traj_id, win ORDER BY step_idx)),
 ev3 AS (SELECT traj_id, win, step_idx, 'occupancy_drop' AS kind, po AS bef, occ AS aft FROM pt WHERE cached AND occ < po * 0.7::DOUBLE
   AND CASE WHEN ne IS NOT NULL THEN ne < po * 0.8::DOUBLE ELSE occ < po * 0.4::DOUBLE END
   AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.traj_id = pt.traj_id AND kn.step_idx = pt.step_idx)
   AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.traj_id = pt.traj_id AND kn.win = pt.win AND (kn.step_idx BETWEEN ps + 1 AND pt.step_idx - 1 OR abs(kn.step_idx - pt.step_idx) <= 1))),
 evs AS (SELECT *, CASE WHEN bef IS NOT NULL AND aft IS NOT NULL THEN greatest(0, bef - aft) END AS dropped FROM (SELECT * FROM kn UNION ALL SELECT * FROM ev3)),
 eo AS (SELECT e.*, (SELECT count(*) FROM ob o WHERE o.traj_id = e.traj_id AND o.win = e.win AND o.live AND o.step_idx < e.step_idx) AS seen,
    (SELECT count(*) FROM ob o WHERE o.traj_id = e.traj_id AND o.win = e.win AND o.live AND o.step_idx <= e.step_idx) AS upto FROM evs e),
 eg AS (SELECT *, sum(fresh) OVER (PARTITION BY traj_id, win ORDER BY step_idx, kind ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN seen > coalesce(lag(upto) OVER (PARTITION BY traj_id, win ORDER BY step_idx, kind), -1) THEN 1 ELSE 0 END AS fresh FROM eo)),
 mg AS (SELECT traj_id, win, min(step_idx) AS step_idx, arg_min(kind, (step_idx, kind)) AS kind, first(bef ORDER BY step_idx, kind) AS bef,
    coalesce(arg_max(aft, (step_idx, kind)) FILTER (aft > 0), first(aft ORDER BY step_idx, kind)) AS aft, max(dropped) AS mxd, count(*) AS signals FROM eg GROUP BY traj_id, win, g),
 mm AS (SELECT traj_id, win, step_idx, kind, bef, aft, CASE WHEN bef IS NOT NULL AND aft IS NOT NULL THEN greatest(0, bef - aft) ELSE mxd END AS dropped, signals FROM mg),
 lm AS (SELECT traj_id, CASE WHEN traj_id % 4 = 0 AND nm > 0 THEN 200000 ELSE 128000 END AS guess, pk,
    CASE WHEN traj_id % 4 IN (0, 1) AND nm > 0 THEN 'model' ELSE 'default' END AS src
   FROM (SELECT traj_id, count(*) FILTER (NOT is_user) AS nm, max(occ) FILTER (turn) AS pk FROM oc GROUP BY 1))"""

EVENT_COLUMNS = "traj_id, win AS \"window\", step_idx, kind, bef AS occupancy_before, aft AS occupancy_after, dropped"


@query("c01_occupancy", events_sql(OCC + ' SELECT traj_id, step_idx, tok_input AS fresh, cache_read, occ AS occupancy, live FROM ob'))
def c01(spark, d):
    return p.occupancy(event_runs(spark, d).steps).select("traj_id", "step_idx", "fresh", "cache_read", "occupancy", "live")


@query("f03_occupancy_steps", events_sql(OCC + " SELECT traj_id, step_idx, turn, live FROM ob"))
def f03(spark, d):
    return p.occupancy(event_runs(spark, d).steps).select("traj_id", "step_idx", "turn", "live")


@query("f04_summary_turns", events_sql(OCC + " SELECT traj_id, step_idx FROM ob WHERE checkpoint"))
def f04(spark, d):
    return event_runs(spark, d).steps.filter(p.is_summary_turn()).select("traj_id", "step_idx")


@query("j10_nearest_occupancy", events_sql(OCC + ' SELECT traj_id, step_idx, win AS "window", bef AS before, nxt AS next FROM ob'))
def j10(spark, d):
    return p.occupancy(event_runs(spark, d).steps).select("traj_id", "step_idx", "window", "before", "next")


@query("c02_window_limit", events_sql(OCC + """ SELECT traj_id, CASE WHEN pk > guess THEN NULL ELSE guess END AS window_limit, CASE WHEN pk > guess THEN 'unknown' ELSE src END AS window_source,
  guess AS working_limit FROM lm""").replace("guess END AS window_limit", "guess::BIGINT END AS window_limit").replace("guess AS working_limit", "guess::BIGINT AS working_limit"))
def c02(spark, d):
    runs, occ = stage(spark, d)
    return p.window_limits(runs.steps, occ)


@query("c03_explicit_compactions", events_sql(OCC + f" SELECT {EVENT_COLUMNS} FROM evs WHERE kind = 'compaction_message'"))
def c03(spark, d):
    runs, occ = stage(spark, d)
    return p.explicit_events(occ, runs.parts).drop("slice")


@query("c04_prune_waves", events_sql(OCC + ' SELECT traj_id, win AS "window", ts FROM wv'))
def c04(spark, d):
    runs = event_runs(spark, d)
    return p.prune_waves(runs.steps, runs.calls).select("traj_id", "window", "ts")


@query("j11_turn_at_or_after", events_sql(OCC + ' SELECT traj_id, win AS "window", ts, step_idx FROM ho'))
def j11(spark, d):
    runs, occ = stage(spark, d)
    return p.turn_at_or_after(occ, p.prune_waves(runs.steps, runs.calls))


@query("c05_compaction_events", events_sql(OCC + f" SELECT {EVENT_COLUMNS} FROM evs"))
def c05(spark, d):
    runs, occ = stage(spark, d)
    return p.compaction_events(occ, runs.steps, runs.calls, runs.parts).drop("slice")


@query("c06_coalesced_compactions", events_sql(OCC + f" SELECT {EVENT_COLUMNS}, signals FROM mm"))
def c06(spark, d):
    runs, occ = stage(spark, d)
    return p.coalesce_events(p.compaction_events(occ, runs.steps, runs.calls, runs.parts), occ)


POINTS = """, pp AS (SELECT traj_id, win, step_idx, lt AS local_turn, tok_input AS fresh, cache_read, occ FROM (
   SELECT *, row_number() OVER (PARTITION BY traj_id, win ORDER BY step_idx) AS lt FROM ob WHERE turn) WHERE live)"""


@query("c08_pressure_points", events_sql(OCC + POINTS + ' SELECT traj_id, win AS "window", step_idx, local_turn, fresh, cache_read, occ AS occupancy FROM pp'))
def c08(spark, d):
    return p.pressure_points(p.occupancy(event_runs(spark, d).steps)).drop("slice")


@query("c07_spliced_points", events_sql(OCC + POINTS + """, cf AS (SELECT traj_id, win, step_idx, unnest([bef, aft]) AS occ FROM mm WHERE aft > 0 AND aft < bef)
  SELECT DISTINCT traj_id, win AS "window", step_idx, occ AS occupancy FROM (SELECT traj_id, win, step_idx, occ FROM pp UNION ALL
   SELECT traj_id, win, step_idx, occ FROM cf WHERE EXISTS (SELECT 1 FROM pp WHERE pp.traj_id = cf.traj_id AND pp.win = cf.win AND (pp.step_idx <= cf.step_idx)))"""))
def c07(spark, d):
    runs, occ = stage(spark, d)
    merged = p.coalesce_events(p.compaction_events(occ, runs.steps, runs.calls, runs.parts), occ)
    return p.spliced_points(p.pressure_points(occ), merged).select("traj_id", "window", "step_idx", "occupancy")


@query("c09_pressure_stats", events_sql(OCC + POINTS + """ SELECT lm.traj_id, coalesce(pk, 0) AS peak_occupancy,
   CASE WHEN pk <= guess AND pk > 0 THEN pk / guess::DOUBLE END AS peak_share, coalesce(c, 0) AS compaction_count, coalesce(mx, 0) AS largest_drop,
   CASE WHEN pk > guess THEN NULL ELSE guess END::BIGINT AS window_limit, CASE WHEN pk > guess THEN 'unknown' ELSE src END AS window_source
  FROM lm LEFT JOIN (SELECT traj_id, count(*) AS c, max(dropped) AS mx FROM mm WHERE (traj_id, win) IN (SELECT (traj_id, win) FROM pp) GROUP BY 1) x USING (traj_id)"""))
def c09(spark, d):
    runs, occ = stage(spark, d)
    merged = p.coalesce_events(p.compaction_events(occ, runs.steps, runs.calls, runs.parts), occ)
    return p.pressure_stats(p.pressure_points(occ), merged, p.window_limits(runs.steps, occ))


@query("c10_premature_compactions", events_sql(OCC + """ SELECT traj_id, win AS "window", step_idx, kind, bef AS occupancy_before, aft AS occupancy_after,
   bef / (CASE WHEN pk > guess THEN NULL ELSE guess END)::DOUBLE AS before_share, (CASE WHEN pk > guess THEN NULL ELSE guess END)::BIGINT AS window_limit,
   CASE WHEN coalesce(aft >= bef, false) THEN 'window_grew' ELSE 'low_occupancy' END AS reason
  FROM evs JOIN lm USING (traj_id) WHERE kind = 'compaction_message' AND (coalesce(aft >= bef, false) OR coalesce(bef < (CASE WHEN pk > guess THEN NULL ELSE guess END) * 0.5, false))"""))
def c10(spark, d):
    runs, occ = stage(spark, d)
    events = p.compaction_events(occ, runs.steps, runs.calls, runs.parts)
    return p.premature_compactions(events, p.window_limits(runs.steps, occ))


BUSY = """, tp AS (SELECT traj_id, win, step_idx AS peak_step, occ AS peak_occupancy FROM ob WHERE turn AND occ > 0 QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY occ DESC, step_idx) = 1),
 bz AS (SELECT tp.*, (SELECT max(step_idx) FROM ob o WHERE o.traj_id = tp.traj_id AND o.win = tp.win AND turn) AS anchor_step FROM tp),
 bw AS (SELECT bz.*, o.occ AS occupancy FROM bz JOIN ob o ON o.traj_id = bz.traj_id AND o.step_idx = bz.anchor_step)"""


@query("c13_busiest_window", events_sql(OCC + BUSY + ' SELECT traj_id, win AS "window", peak_step, peak_occupancy, anchor_step, occupancy FROM bw'))
def c13(spark, d):
    return p.busiest_window(p.occupancy(event_runs(spark, d).steps))


@query("c13_snapshot_choices", events_sql(OCC + """ SELECT DISTINCT m.traj_id, m.win AS "window", o.step_idx, o.occ AS occupancy FROM mm m JOIN ob o ON o.traj_id = m.traj_id AND o.win = m.win
   AND o.step_idx = (SELECT max(step_idx) FROM ob x WHERE x.traj_id = m.traj_id AND x.win = m.win AND x.turn AND x.step_idx < m.step_idx)"""))
def c13s(spark, d):
    runs, occ = stage(spark, d)
    merged = p.coalesce_events(p.compaction_events(occ, runs.steps, runs.calls, runs.parts), occ)
    return p.snapshot_choices(occ, merged)


# Token estimates of the bridge: texts "say <type>", "think"; call inputs as JSON of the filled fields.
COMP = BUSY + """, lc AS (SELECT bw.*, (SELECT max(step_idx) FROM evs e WHERE e.traj_id = bw.traj_id AND e.win = bw.win AND e.kind = 'compaction_message' AND e.step_idx < bw.anchor_step) AS cut FROM bw),
 js AS (SELECT *, CASE tool_name WHEN 'Bash' THEN length('{"command":""}') + length(command) WHEN 'Read' THEN length('{"file_path":""}') + length(file_path)
    WHEN 'Edit' THEN length('{"file_path":""}') + length(file_path) WHEN 'Task' THEN 2
    WHEN 'TodoWrite' THEN length('{"todos":[{"content":"item0","status":"pending"},{"content":"item0","status":""}]}') + CASE WHEN k % 3 = 0 THEN 9 ELSE 11 END
    ELSE length('{"path":"src","pattern":""}') + length(pattern) END AS sent FROM calls),
 br AS (SELECT traj_id, agent AS win, step_idx, CASE WHEN is_user AND k % 6 = 0 THEN 'system' WHEN is_user AND k % 20 = 0 THEN 'summarized' ELSE 'conversation' END AS bucket,
    (length('say ' || event_type) + 3) // 4 AS t, is_user AND k % 20 = 0 AND k % 6 <> 0 AS kept FROM st
   UNION ALL SELECT traj_id, agent, step_idx, 'conversation', 2, false FROM st WHERE NOT is_user AND k % 4 = 0
   UNION ALL SELECT traj_id, agent, step_idx, CASE WHEN tool_name = 'Task' THEN 'subagents' ELSE 'conversation' END, greatest(1, (sent + 3) // 4), false FROM js
   UNION ALL SELECT traj_id, agent, step_idx, 'tool_outputs', CASE WHEN output = '' THEN 0 ELSE 1 END, false FROM js),
 bs AS (SELECT br.traj_id, bucket, CAST(sum(t) AS BIGINT) AS t FROM br JOIN lc USING (traj_id, win)
   WHERE (step_idx > coalesce(cut, -1) AND step_idx <= anchor_step) OR (kept AND cut IS NOT NULL AND step_idx BETWEEN cut - 1 AND cut) GROUP BY ALL),
 ba AS (SELECT bs.*, occupancy, sum(t) OVER (PARTITION BY traj_id) AS total, list_position(['system','tools','rules','skills','mcp','subagents','summarized','conversation','tool_outputs'], bucket) AS rk
   FROM bs JOIN bw USING (traj_id) WHERE t > 0),
 bx AS (SELECT *, total > occupancy AND occupancy > 0 AS over, CASE WHEN total > occupancy AND occupancy > 0 THEN CAST(floor(t * (occupancy / total::DOUBLE)) AS BIGINT) ELSE t END AS sc FROM ba),
 by_ AS (SELECT *, occupancy - sum(sc) OVER (PARTITION BY traj_id) AS rest, row_number() OVER (PARTITION BY traj_id ORDER BY sc DESC, t DESC, rk) AS rn FROM bx),
 wc AS (SELECT traj_id, bucket, CAST(CASE WHEN over AND rn = 1 THEN greatest(0, sc + rest) ELSE sc END AS BIGINT) AS tokens, over AS scaled FROM by_
   UNION ALL SELECT bw.traj_id, 'unattributed', CAST(occupancy - coalesce((SELECT sum(t) FROM bs WHERE bs.traj_id = bw.traj_id), 0) AS BIGINT), false FROM bw)"""


@query("c11_window_composition", events_sql(OCC + COMP + " SELECT * FROM wc WHERE tokens > 0"))
def c11(spark, d):
    runs, occ = stage(spark, d)
    events = p.compaction_events(occ, runs.steps, runs.calls, runs.parts)
    return p.window_composition(occ, events, runs.calls, runs.parts)


@query("c12_spawn_calls", events_sql("SELECT traj_id, step_idx FROM calls WHERE tool_name = 'Task'"))
def c12(spark, d):
    from runloom import vocab
    from runloom.functions import calls as fc

    return event_runs(spark, d).calls.filter(fc.is_tool(vocab.SPAWN_TOOLS)).select("traj_id", "step_idx")


@query("c14_usage_segments", events_sql(OCC + COMP + """ SELECT wc.traj_id, bucket, CASE WHEN bucket <> 'unattributed' THEN bucket
    WHEN tokens > coalesce((SELECT sum(tokens) FROM wc x WHERE x.traj_id = wc.traj_id AND x.bucket IN ('system', 'tools')), 0) THEN 'Harness system definitions (not included in log)'
    ELSE 'Other (not included in log)' END AS label, tokens, tokens / guess::DOUBLE AS window_share, CASE WHEN occupancy > 0 THEN tokens / occupancy::DOUBLE ELSE 0 END AS loaded_share
  FROM wc JOIN bw USING (traj_id) JOIN lm USING (traj_id) WHERE tokens > 0"""))
def c14(spark, d):
    runs, occ = stage(spark, d)
    events = p.compaction_events(occ, runs.steps, runs.calls, runs.parts)
    composition = p.window_composition(occ, events, runs.calls, runs.parts)
    return p.usage_segments(composition, p.busiest_window(occ), p.window_limits(runs.steps, occ))


@query("f04_snapshot_sessions", None)
def f04s(spark, d):
    """Windows with an explicit size on every fourth turn, as some exports have."""
    runs = event_runs(spark, d)
    steps = runs.steps.withColumn(
        "tokens", F.col("tokens").withField("context_window", F.when(F.col("step_idx") % 4 == 0, F.col("tokens.total") * 10))
    )
    occ = cut_lineage(p.occupancy(steps))
    return p.drop_events(occ, p.explicit_events(occ, runs.parts)).drop("slice")
