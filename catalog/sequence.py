"""Phases, failures, streaks, repeated work, plans, n-grams and sub-agent stretches."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.functions import agents, calls as fc
from runloom.operators import sequence as s
from runloom.sources.bridges import event_runs

PHASE = """, ph AS (SELECT traj_id, step_idx, tool_name = 'TodoWrite' AS plans, CASE WHEN is_user THEN 'unknown' WHEN tool_name = 'TodoWrite' THEN 'plan'
   WHEN tool_name = 'Edit' THEN 'implement' WHEN command LIKE '%pytest%' THEN 'validate'
   WHEN tool_name IS NOT NULL AND (failed OR coalesce(exit_code, 0) <> 0) THEN 'debug'
   WHEN tool_name IN ('Bash', 'Grep', 'Glob', 'Read') THEN 'understand' WHEN finish = 'stop' OR tool_name IS NULL THEN 'report' ELSE 'unknown' END AS phase FROM st),
 seg AS (SELECT traj_id, min(step_idx) AS start_idx, any_value(phase) AS phase, max(step_idx) AS end_idx, count(*) AS steps FROM (
   SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) - row_number() OVER (PARTITION BY traj_id, phase ORDER BY step_idx) AS g
   FROM ph WHERE phase <> 'unknown') GROUP BY traj_id, phase, g)"""


@query("g01_step_phase", events_sql(PHASE + " SELECT traj_id, step_idx, phase FROM ph"))
def g01(spark, d):
    runs = event_runs(spark, d)
    return s.step_phases(runs.steps, runs.calls, runs.parts).select("traj_id", "step_idx", "phase")


@query("g02_phase_segments", events_sql(PHASE + " SELECT * FROM seg"))
def g02(spark, d):
    runs = event_runs(spark, d)
    return s.phase_segments(s.step_phases(runs.steps, runs.calls, runs.parts))


@query("g03_phase_anomalies", events_sql(PHASE + """, rk AS (SELECT *, CASE phase WHEN 'understand' THEN 0 WHEN 'plan' THEN 1 WHEN 'implement' THEN 2
    WHEN 'debug' THEN 3 WHEN 'validate' THEN 4 WHEN 'report' THEN 5 END AS r FROM seg),
  pv AS (SELECT *, lag(r) OVER (PARTITION BY traj_id ORDER BY start_idx) AS pr, lag(phase) OVER (PARTITION BY traj_id ORDER BY start_idx) AS pp FROM rk)
  SELECT traj_id, pp AS from_phase, phase AS to_phase, start_idx AS step_idx, end_idx - start_idx + 1 AS span,
   (end_idx - start_idx + 1) / (SELECT count(*) FROM st s WHERE s.traj_id = pv.traj_id)::DOUBLE AS span_fraction,
   CASE WHEN EXISTS (SELECT 1 FROM ph WHERE ph.traj_id = pv.traj_id AND ph.step_idx BETWEEN start_idx - 3 AND start_idx - 1 AND plans) THEN 'intentional_iteration'
     ELSE 'unintentional_drift' END AS category FROM pv WHERE r < pr"""))
def g03(spark, d):
    runs = event_runs(spark, d)
    phases = s.step_phases(runs.steps, runs.calls, runs.parts)
    return s.phase_anomalies(runs.steps, phases, s.phase_segments(phases))


@query("j17_plan_just_before", events_sql("""SELECT traj_id, step_idx, coalesce(max(CASE WHEN tool_name = 'TodoWrite' THEN 1 ELSE 0 END)
   OVER (PARTITION BY traj_id ORDER BY step_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)::BIGINT = 1 AS planned FROM st"""))
def j17(spark, d):
    from runloom.operators.slices import neighbours

    runs = event_runs(spark, d)
    rows = runs.steps.join(s.step_flags(runs.calls).select(*s.STEP, "plans"), s.STEP, "left")
    rows = neighbours(rows, lambda w: {"p": F.max("plans").over(w.rangeBetween(-3, -1))}, before=3)
    return rows.select("traj_id", "step_idx", F.coalesce("p", F.lit(False)).alias("planned"))


NGRAM = """, stream AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) - 1 AS pos, tool_name AS t FROM calls),
 ld AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3, lead(t, 4) OVER w AS t4 FROM stream WINDOW w AS (PARTITION BY traj_id ORDER BY pos)),
 occ AS (SELECT traj_id, pos, 2::BIGINT AS n, t || ' > ' || t1 AS gram FROM ld WHERE t1 IS NOT NULL
  UNION ALL SELECT traj_id, pos, 3, t || ' > ' || t1 || ' > ' || t2 FROM ld WHERE t2 IS NOT NULL
  UNION ALL SELECT traj_id, pos, 4, t || ' > ' || t1 || ' > ' || t2 || ' > ' || t3 FROM ld WHERE t3 IS NOT NULL
  UNION ALL SELECT traj_id, pos, 5, t || ' > ' || t1 || ' > ' || t2 || ' > ' || t3 || ' > ' || t4 FROM ld WHERE t4 IS NOT NULL),
 nxt AS (SELECT o.traj_id, o.n, o.gram, o.pos, min(p.pos) AS np FROM occ o LEFT JOIN occ p ON o.traj_id = p.traj_id AND o.gram = p.gram AND p.pos >= o.pos + o.n GROUP BY ALL),
 pick AS (SELECT traj_id, n, gram, min(pos) AS pos FROM occ GROUP BY ALL
  UNION ALL SELECT k.traj_id, k.n, k.gram, x.np FROM pick k JOIN nxt x ON k.traj_id = x.traj_id AND k.gram = x.gram AND k.pos = x.pos WHERE x.np IS NOT NULL)"""


@query("g04_tool_sequences", events_sql(NGRAM + " SELECT traj_id, n, gram, count(*) AS frequency FROM pick GROUP BY ALL HAVING count(*) >= 3"))
def g04(spark, d):
    return s.tool_sequences(event_runs(spark, d).calls)


FAILS = """, fc AS (SELECT *, tool_name IS NOT NULL AND (failed OR coalesce(exit_code, 0) <> 0) AS bad FROM st),
 ch AS (SELECT traj_id, min(step_idx) AS start, max(step_idx) AS "end", count(*) AS length FROM (
  SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) - row_number() OVER (PARTITION BY traj_id, bad ORDER BY step_idx) AS g
  FROM fc WHERE NOT is_user) WHERE bad GROUP BY traj_id, g)"""


@query("g05_failure_chains", events_sql(FAILS + " SELECT * FROM ch"))
def g05(spark, d):
    runs = event_runs(spark, d)
    return s.failure_chains(runs.steps, runs.calls)


@query("a23_chain_metrics", events_sql(FAILS + """ SELECT traj_id, coalesce(c, 0) AS chains, coalesce(n, 0) AS chain_steps, coalesce(mx, 0) AS longest,
   CASE WHEN a > 0 THEN coalesce(n, 0) / a::DOUBLE ELSE 0 END AS chain_step_share
   FROM (SELECT traj_id, count(*) FILTER (NOT is_user) AS a FROM st GROUP BY 1)
   LEFT JOIN (SELECT traj_id, count(*) AS c, CAST(sum(length) AS BIGINT) AS n, max(length) AS mx FROM ch GROUP BY 1) USING (traj_id)"""))
def a23(spark, d):
    runs = event_runs(spark, d)
    return s.failure_chain_metrics(runs.steps, s.failure_chains(runs.steps, runs.calls))


CLUSTER = """, er AS (SELECT traj_id, step_idx, k, CASE WHEN tool_name = 'Bash' THEN CASE k % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'cat' WHEN 2 THEN 'grep' ELSE 'git' END ELSE tool_name END AS tool,
   CASE WHEN coalesce(exit_code, 0) <> 0 THEN 'exit code ' || exit_code ELSE output END AS pattern,
   CASE WHEN tool_name = 'Edit' THEN 'system' ELSE 'tool' END AS error_class FROM calls WHERE failed OR coalesce(exit_code, 0) <> 0),
 cl AS (SELECT traj_id, tool, pattern, count(*) AS count, count(DISTINCT step_idx) AS steps, min(step_idx) AS first_step, max(step_idx) AS last_step,
   arg_min(error_class, step_idx) AS error_class FROM er GROUP BY ALL)"""


@query("a24_error_clusters", events_sql(CLUSTER + " SELECT * FROM cl"))
def a24(spark, d):
    return s.error_clusters(event_runs(spark, d).calls)


@query("a24_error_cluster_steps", events_sql(CLUSTER + " SELECT DISTINCT traj_id, tool, pattern, step_idx FROM er"))
def a24s(spark, d):
    return s.error_cluster_steps(event_runs(spark, d).calls)


@query("a25_root_cause_summary", events_sql(CLUSTER + """ SELECT traj_id, tool, pattern, count || 'x ' || tool || ' failures: ''' || pattern || ''' (' ||
   CASE WHEN first_step <> last_step THEN 'steps ' || first_step || '..' || last_step ELSE 'step ' || first_step END || ')' AS summary FROM cl"""))
def a25(spark, d):
    return s.root_cause_summary(s.error_clusters(event_runs(spark, d).calls))


@query("a26_tool_errors", events_sql("""SELECT traj_id, count(*) AS failed_calls, count(DISTINCT step_idx) AS failed_steps FROM calls
   WHERE failed OR coalesce(exit_code, 0) <> 0 GROUP BY traj_id"""))
def a26(spark, d):
    rows = s.error_rows(event_runs(spark, d).calls).groupBy("traj_id", "step_idx").agg(F.count("*").alias("n"))
    return rows.groupBy("traj_id").agg(F.sum("n").alias("failed_calls"), F.count("*").alias("failed_steps"))


@query("j04_clusters_with_spawn", events_sql(CLUSTER + """, sp AS (SELECT traj_id, 'sub' || (k % 3) AS agent, min(step_idx) AS parent_step FROM calls WHERE tool_name = 'Task' GROUP BY ALL)
  SELECT cl.traj_id, cl.tool, cl.pattern, first_step, CASE WHEN sp.parent_step IS NOT NULL THEN 'main' END AS parent_agent, sp.parent_step
  FROM cl JOIN st ON st.traj_id = cl.traj_id AND st.step_idx = cl.first_step LEFT JOIN sp ON sp.traj_id = cl.traj_id AND sp.agent = st.eff_agent"""))
def j04(spark, d):
    from catalog.metrics import j03

    rows = s.error_clusters(event_runs(spark, d).calls)
    return s.with_spawn(rows, event_runs(spark, d).steps, j03(spark, d), "first_step").select(
        "traj_id", "tool", "pattern", "first_step", "parent_agent", "parent_step"
    )


@query("j04_chains_with_spawn", events_sql(FAILS + """, sp AS (SELECT traj_id, 'sub' || (k % 3) AS agent, min(step_idx) AS parent_step FROM calls WHERE tool_name = 'Task' GROUP BY ALL)
  SELECT ch.traj_id, start, length, sp.parent_step FROM ch JOIN st ON st.traj_id = ch.traj_id AND st.step_idx = ch.start
  LEFT JOIN sp ON sp.traj_id = ch.traj_id AND sp.agent = st.eff_agent"""))
def j04c(spark, d):
    from catalog.metrics import j03

    runs = event_runs(spark, d)
    rows = s.failure_chains(runs.steps, runs.calls)
    return s.with_spawn(rows, runs.steps, j03(spark, d), "start").select("traj_id", "start", "length", "parent_step")


RECOVER = CLUSTER + """, okk AS (SELECT s.traj_id, s.step_idx, s.tool_name, s.tool_name IS NOT NULL AND NOT (failed OR coalesce(exit_code, 0) <> 0) AS ok FROM st s),
 nx AS (SELECT e.traj_id, e.step_idx, min(o.step_idx) AS s2 FROM (SELECT DISTINCT traj_id, step_idx FROM er) e JOIN okk o ON o.traj_id = e.traj_id
   AND o.step_idx > e.step_idx AND o.step_idx <= e.step_idx + 20 AND o.ok GROUP BY ALL),
 pa AS (SELECT n.traj_id, n.step_idx, string_agg(o.tool_name, ' > ' ORDER BY o.step_idx) AS path FROM nx n JOIN okk o ON o.traj_id = n.traj_id
   AND o.step_idx > n.step_idx AND o.step_idx <= n.s2 AND o.tool_name IS NOT NULL GROUP BY ALL)"""


@query("j09_next_success", events_sql(RECOVER + """ SELECT DISTINCT er.traj_id, er.step_idx, coalesce(path, '') AS path FROM er LEFT JOIN pa USING (traj_id, step_idx)"""))
def j09(spark, d):
    runs = event_runs(spark, d)
    return s.recovery_paths(runs.steps, runs.calls).select("traj_id", "step_idx", F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"))


@query("g06_failure_patterns", events_sql(RECOVER + """, md AS (SELECT traj_id, tool, pattern, path, count(*) AS n, min(step_idx) AS seen
    FROM (SELECT DISTINCT traj_id, tool, pattern, step_idx FROM er) JOIN pa USING (traj_id, step_idx) GROUP BY ALL),
  best AS (SELECT traj_id, tool, pattern, path FROM md QUALIFY row_number() OVER (PARTITION BY traj_id, tool, pattern ORDER BY n DESC, seen) = 1)
  SELECT traj_id, tool, pattern, count, first_step, error_class, coalesce(path, '') AS recovery_path FROM cl LEFT JOIN best USING (traj_id, tool, pattern)"""))
def g06(spark, d):
    runs = event_runs(spark, d)
    return s.failure_patterns(runs.steps, runs.calls).select(
        "traj_id", "tool", "pattern", "count", "first_step", "error_class", F.coalesce(F.array_join("recovery_path", " > "), F.lit("")).alias("recovery_path")
    )


FRUIT = """, fr AS (SELECT *, coalesce((tool_name IN ('Grep', 'Glob') OR command LIKE 'grep %') AND output = '', false) AS fruitless FROM st)"""


@query("f05_fruitless_steps", events_sql(FRUIT + " SELECT traj_id, step_idx, fruitless FROM fr WHERE tool_name IS NOT NULL"))
def f05(spark, d):
    return s.fruitless_steps(event_runs(spark, d).calls).select("traj_id", "step_idx", "fruitless")


@query("g07_fruitless_streaks", events_sql(FRUIT + """ SELECT traj_id, min(step_idx) AS start_step, max(step_idx) AS end_step, count(*) AS length, count(*) AS calls FROM (
   SELECT *, step_idx - row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) AS g FROM fr WHERE fruitless) GROUP BY traj_id, g HAVING count(*) >= 3"""))
def g07(spark, d):
    runs = event_runs(spark, d)
    return s.fruitless_streaks(runs.steps, runs.calls)


THRASH = """, ed AS (SELECT traj_id, step_idx, file_path AS path, failed FROM calls WHERE tool_name = 'Edit'),
 wn AS (SELECT a.traj_id, a.path, a.step_idx AS start_step, count(*) AS count, count(*) FILTER (b.failed) AS fail_count, max(b.step_idx) AS end_step
   FROM ed a JOIN ed b ON a.traj_id = b.traj_id AND a.path = b.path AND b.step_idx BETWEEN a.step_idx AND a.step_idx + 15 GROUP BY ALL),
 th AS (SELECT traj_id, path, count, fail_count, start_step, end_step FROM wn WHERE count >= 3 AND fail_count >= 1
   QUALIFY row_number() OVER (PARTITION BY traj_id, path ORDER BY count DESC, start_step) = 1)"""


@query("g08_edit_thrash", events_sql(THRASH + " SELECT * FROM th"))
def g08(spark, d):
    return s.edit_thrash(event_runs(spark, d).calls)


@query("g09_repeated_searches", events_sql(FRUIT + """, sg AS (SELECT traj_id, step_idx, lower(tool_name) || ':' || pattern || '|' || path AS signature FROM fr WHERE fruitless)
  SELECT traj_id, signature, count(*) AS count, min(step_idx) AS first_step, max(step_idx) AS last_step, substr(signature, 6, 80) AS display FROM sg
  GROUP BY traj_id, signature HAVING count(*) >= 3 AND max(step_idx) - min(step_idx) + 1 <> count(*)"""))
def g09(spark, d):
    return s.repeated_searches(event_runs(spark, d).calls)


@query("f06_shell_reads", events_sql(r"""SELECT traj_id, step_idx, 0::BIGINT AS call_pos, replace(command, './', '') AS command, '^cat\s+[\"'']?[/\\a-zA-Z]' AS pattern
   FROM calls WHERE command LIKE 'cat %'"""))
def f06(spark, d):
    calls = event_runs(spark, d).calls
    bare = F.replace(F.col("input.command"), F.lit("./"), F.lit(""))
    return s.shell_reads(calls.withColumn("input", F.col("input").withField("command", bare)))


PLAN = """, pl AS (SELECT traj_id, step_idx, k, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) AS snapshot FROM calls WHERE tool_name = 'TodoWrite'),
 it AS (SELECT traj_id, step_idx, 0::BIGINT AS item_pos, 'item' || (k % 7) AS content, CASE WHEN k % 3 = 0 THEN 'completed' ELSE 'in_progress' END AS status FROM pl
   UNION ALL SELECT traj_id, step_idx, 1, 'item' || ((k + 1) % 7), 'pending' FROM pl),
 pp AS (SELECT *, lag(k) OVER (PARTITION BY traj_id ORDER BY step_idx) % 7 AS b FROM pl),
 pg AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND k % 7 <> b AND (k + 1) % 7 <> b AND k % 7 <> (b + 1) % 7 THEN 1 ELSE 0 END)
   OVER (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS g FROM pp),
 px AS (SELECT traj_id, CAST(g AS BIGINT) AS phase_index, min(step_idx) AS start_step, max(step_idx) AS end_step, count(*) AS snapshots, 2::BIGINT AS item_count FROM pg GROUP BY traj_id, g),
 pi AS (SELECT traj_id, content, min(step_idx) FILTER (status = 'in_progress') AS start_step, min(step_idx) FILTER (status = 'completed') AS end_step,
   min(step_idx) AS seen_step FROM it GROUP BY ALL),
 ps AS (SELECT *, end_step - start_step AS duration_steps, (start_step IS NOT NULL AND end_step IS NULL) OR coalesce(end_step - start_step > 20, false) AS stalled FROM pi)"""


@query("g10_plan_history", events_sql(PLAN + " SELECT traj_id, step_idx, 0::BIGINT AS call_pos, item_pos, content, status FROM it"))
def g10(spark, d):
    return s.plan_items_long(s.plan_history(event_runs(spark, d).calls))


@query("g11_plan_phases", events_sql(PLAN + " SELECT * FROM px"))
def g11(spark, d):
    return s.plan_phases(s.plan_history(event_runs(spark, d).calls))


@query("g12_plan_items", events_sql(PLAN + " SELECT traj_id, content, start_step, end_step, duration_steps, stalled, seen_step FROM ps"))
def g12(spark, d):
    return s.plan_items(s.plan_history(event_runs(spark, d).calls)).drop("seen_pos")


@query("g12_plan_summary", events_sql(PLAN + """ SELECT traj_id, count(*) AS total_items, count(*) FILTER (stalled) AS stalled_items,
   (SELECT count(*) - 1 FROM px WHERE px.traj_id = ps.traj_id) AS plan_resets FROM ps GROUP BY traj_id"""))
def g12s(spark, d):
    return s.plan_summary(s.plan_history(event_runs(spark, d).calls))


def tagged(runs):
    """Bridge runs with one session per agent and Task calls that name the child session."""
    main = F.concat(F.lit("S"), F.col("traj_id").cast("string"))
    steps = runs.steps.withColumns(
        {
            "is_sub_agent": F.col("agent") != "",
            "session_id": F.when(F.col("agent") != "", F.concat(main, F.lit("-"), F.col("agent"))).otherwise(main),
        }
    )
    child = F.concat(main, F.lit("-sub"), (F.col("step_idx") % 3).cast("string"))
    calls = runs.calls.withColumn("child_session_id", F.when(F.col("tool_name") == "Task", child))
    return steps, calls


TAGGED = """, tg AS (SELECT *, agent <> '' AS sub, 'S' || traj_id || CASE WHEN agent <> '' THEN '-' || agent ELSE '' END AS session_id FROM st),
 sproot AS (SELECT traj_id, arg_min(session_id, step_idx) AS root FROM tg GROUP BY 1),
 spall AS (SELECT traj_id, step_idx, session_id AS parent, 'S' || traj_id || '-sub' || (step_idx % 3) AS child FROM tg WHERE tool_name = 'Task'),
 sp AS (SELECT traj_id, child, arg_min(parent, step_idx) AS parent, min(step_idx) AS spawn_step FROM spall JOIN sproot USING (traj_id) WHERE child <> parent AND child <> root GROUP BY ALL)"""


@query("j02_spawn_edges", events_sql(TAGGED + " SELECT traj_id, child, parent, spawn_step FROM sp"))
def j02(spark, d):
    steps, calls = tagged(event_runs(spark, d))
    return s.spawn_edges(steps, calls)


@query("j02_annotate_spawned", events_sql(TAGGED + """ SELECT tg.traj_id, step_idx, tg.sub OR sp.child IS NOT NULL AS is_sub_agent, sp.parent AS parent_session_id
   FROM tg LEFT JOIN sp ON sp.traj_id = tg.traj_id AND sp.child = tg.session_id"""))
def j02a(spark, d):
    steps, calls = tagged(event_runs(spark, d))
    return s.annotate_spawned(steps, calls).select("traj_id", "step_idx", "is_sub_agent", "parent_session_id")


@query("g13_subagent_sessions", events_sql(TAGGED + """, gi AS (SELECT *, step_idx - row_number() OVER (PARTITION BY traj_id, session_id ORDER BY step_idx) AS g FROM tg WHERE sub)
  SELECT gi.traj_id, min(step_idx) AS start_step, gi.session_id, max(step_idx) AS end_step, count(*) AS steps, CAST(sum(cents) AS BIGINT) AS total_tokens,
   count(tool_name) AS total_tools, sum(cents) / 1000.0::DOUBLE AS total_duration, any_value(sp.spawn_step) AS spawn_step
  FROM gi LEFT JOIN sp ON sp.traj_id = gi.traj_id AND sp.child = gi.session_id GROUP BY gi.traj_id, gi.session_id, g"""))
def g13(spark, d):
    steps, calls = tagged(event_runs(spark, d))
    return s.subagent_sessions(steps, calls)


@query("g15_last_duration", events_sql("""SELECT traj_id, step_idx, CASE WHEN step_idx < mx THEN duration WHEN seen > created THEN round((seen - created) / 1000.0::DOUBLE, 2) END AS duration
  FROM (SELECT *, max(step_idx) OVER (PARTITION BY traj_id) AS mx, max(completed) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
   FROM (SELECT traj_id, step_idx, duration, created, CASE WHEN step_idx % 5 = 2 THEN completed + 10000000 ELSE completed END AS completed FROM st))"""))
def g15(spark, d):
    steps = event_runs(spark, d).steps
    last = steps.groupBy("traj_id").agg(F.max("step_idx").alias("_mx"))
    steps = steps.join(last, "traj_id").withColumns(
        {
            "duration": F.when(F.col("step_idx") < F.col("_mx"), F.col("duration")),
            "time_completed_ms": F.col("time_completed_ms") + F.when(F.col("step_idx") % 5 == 2, 10_000_000).otherwise(0),
        }
    ).drop("_mx")
    return s.backfill_last_duration(steps).select("traj_id", "step_idx", "duration")


@query("f01_step_cap", events_sql("""SELECT traj_id, least(count(*), 60) AS kept, count(*) AS total, count(*) > 60 AS truncated FROM st GROUP BY traj_id"""))
def f01(spark, d):
    return s.truncation(event_runs(spark, d, indexed=False).steps, 60)


@query("p11_effective_agent", events_sql(TAGGED + """ SELECT traj_id, step_idx, eff_agent AS unsaid, CASE WHEN is_user THEN '' WHEN sub THEN session_id ELSE '' END AS said FROM tg"""))
def p11(spark, d):
    runs = event_runs(spark, d)
    unsaid = runs.steps.select("traj_id", "step_idx", agents.effective_agent().alias("unsaid"))
    said = tagged(runs)[0].select("traj_id", "step_idx", agents.effective_agent().alias("said"))
    return unsaid.join(said, ["traj_id", "step_idx"])


@query("p12_window_agent", events_sql(TAGGED + " SELECT traj_id, step_idx, session_id AS window_agent FROM tg"))
def p12(spark, d):
    return tagged(event_runs(spark, d))[0].select("traj_id", "step_idx", agents.window_agent().alias("window_agent"))


@query("p13_workflow_role", events_sql("""SELECT traj_id, step_idx, CASE WHEN NOT is_user THEN 'assistant' WHEN k % 20 = 0 THEN 'compaction'
   WHEN k % 6 = 0 THEN 'system' WHEN agent <> '' THEN 'task' ELSE 'user' END AS workflow_role FROM st"""))
def p13(spark, d):
    runs = event_runs(spark, d)
    steps = tagged(runs)[0]
    text = runs.parts.groupBy(*s.STEP).agg(F.bool_and(F.when(F.col("type") == "text", F.col("synthetic"))).alias("syn"), F.bool_or(F.col("type") == "compaction").alias("cmp"))
    return steps.join(text, s.STEP, "left").select("traj_id", "step_idx", agents.workflow_role(F.col("syn"), F.col("cmp")).alias("workflow_role"))


@query("p15_step_error_kind", events_sql("""SELECT traj_id, step_idx, CASE WHEN tool_name = 'Bash' AND (failed OR coalesce(exit_code, 0) <> 0) THEN 'tool'
   WHEN tool_name IS NOT NULL AND failed THEN 'system' WHEN failed THEN 'tool' END AS error_kind FROM st"""))
def p15(spark, d):
    runs = event_runs(spark, d)
    return m_error_kind(runs).select("traj_id", "step_idx", "error_kind")


def m_error_kind(runs):
    bad = runs.calls.filter(fc.failed()).groupBy(*s.STEP).agg(F.bool_or(fc.error_kind() == "tool").alias("by_tool"))
    kind = (
        F.when(F.col("by_tool"), "tool").when(F.col("by_tool").isNotNull(), "system")
        .when(F.lower(F.trim("finish")) == "error", "system").when(F.col("error_count") > 0, "tool")
    )
    return runs.steps.join(bad, s.STEP, "left").withColumn("error_kind", kind)


@query("p21_error_pattern", events_sql(CLUSTER + " SELECT traj_id, step_idx, tool, pattern, error_class FROM er"))
def p21(spark, d):
    return s.error_rows(event_runs(spark, d).calls).select("traj_id", "step_idx", "tool", "pattern", "error_class")


@query("p30_search_signature", events_sql("""SELECT traj_id, step_idx, CASE WHEN tool_name = 'Bash' THEN 'bash:' || command ELSE lower(tool_name) || ':' || pattern || '|' || path END AS signature
   FROM calls WHERE tool_name IN ('Grep', 'Glob') OR command LIKE 'grep%'"""))
def p30(spark, d):
    return event_runs(spark, d).calls.select("traj_id", "step_idx", fc.search_signature().alias("signature")).filter("signature is not null")
