"""Chart series, issues and live views."""

from pyspark.sql import functions as F

from catalog.comparison import EXTRA, PAIR, _patterns
from catalog.files import TOUCH
from catalog.metrics import CALLX
from catalog.registry import query
from catalog.sequence import CLUSTER, FAILS, FRUIT, PLAN, THRASH, tagged
from catalog.sql import events_sql
from runloom.operators import files as fi, filters as fl, issues as iss, metrics as m, sequence as s, series as v
from runloom.sources.bridges import event_runs
from runloom.streaming import live


@query("v01_token_bars", events_sql("SELECT traj_id, step_idx, eff_agent AS agent, tok_input AS fresh, cache_read, 0::BIGINT AS cache_write, tok_output AS output, 0::BIGINT AS reasoning FROM st"))
def v01(spark, d):
    return v.token_bars(event_runs(spark, d).steps)


@query("v01_token_bars_by_agent", events_sql("SELECT traj_id, eff_agent AS agent, CAST(sum(tok_input) AS BIGINT) AS fresh, CAST(sum(cache_read) AS BIGINT) AS cache_read, 0::BIGINT AS cache_write, CAST(sum(tok_output) AS BIGINT) AS output, 0::BIGINT AS reasoning FROM st GROUP BY ALL"))
def v01a(spark, d):
    return v.token_bars_by_agent(event_runs(spark, d, indexed=False).steps)


@query("v02_step_durations", events_sql(CALLX + """ SELECT traj_id, step_idx, rest_ms / 1000.0::DOUBLE AS seconds, CASE WHEN tool_name = 'Bash' AND (failed OR coalesce(exit_code, 0) <> 0) THEN 'tool'
   WHEN tool_name IS NOT NULL AND failed THEN 'system' WHEN failed THEN 'tool' END AS error_kind, (sum(rest_ms) OVER (PARTITION BY traj_id) / 1000.0::DOUBLE) / count(*) OVER (PARTITION BY traj_id) AS mean_seconds FROM f"""))
def v02(spark, d):
    runs = event_runs(spark, d)
    return v.step_durations(runs.steps, runs.calls)


LABELLED = """, lc AS (SELECT *, CASE WHEN tool_name = 'Bash' THEN CASE k % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'cat' WHEN 2 THEN 'grep' ELSE 'git' END ELSE tool_name END AS label FROM calls)"""


@query("v03_tool_frequency", events_sql(LABELLED + " SELECT traj_id, label, eff_agent AS agent, count(*) AS calls FROM lc GROUP BY ALL"))
def v03(spark, d):
    runs = event_runs(spark, d)
    return v.tool_frequency(runs.steps, runs.calls)


@query("v03_tool_duration_segments", events_sql(LABELLED + """ SELECT traj_id, label, step_idx, 0::BIGINT AS call_pos, (t_end - t_start)::DOUBLE AS ms,
   (sum(t_end - t_start) OVER (PARTITION BY traj_id, label ORDER BY step_idx ROWS UNBOUNDED PRECEDING) - (t_end - t_start))::DOUBLE AS base_ms FROM lc WHERE tool_name <> 'Task' AND t_end > t_start"""))
def v03d(spark, d):
    return v.tool_duration_segments(event_runs(spark, d).calls)


@query("v04_swimlanes", events_sql(""", ln AS (SELECT *, CASE WHEN is_user THEN 'user' ELSE 'agent:' || eff_agent END AS lane FROM st)
  SELECT traj_id, min(step_idx) AS start_step, lane, max(step_idx) AS end_step, CAST(sum(cents) AS BIGINT) AS tokens, count(tool_name) AS calls FROM (
   SELECT *, step_idx - row_number() OVER (PARTITION BY traj_id, lane ORDER BY step_idx) AS g FROM ln) GROUP BY traj_id, lane, g"""))
def v04(spark, d):
    return v.swimlanes(event_runs(spark, d).steps)


@query("v05_group_lanes", None)
def v05(spark, d):
    from catalog.batch import members

    return v.swimlanes(event_runs(spark, d).steps).join(members(spark, d), "traj_id")


@query("v06_tool_outcomes", events_sql("SELECT traj_id, step_idx, 0::BIGINT AS call_pos, tool_name, NOT (failed OR coalesce(exit_code, 0) <> 0) AS ok, coalesce(command, file_path, path, '') AS hint FROM calls"))
def v06(spark, d):
    return v.tool_outcomes(event_runs(spark, d).calls)


@query("v07_file_timeline", events_sql(TOUCH + " SELECT traj_id, path, type, min(step_idx) AS first_step, max(step_idx) AS last_step, count(*) AS touches FROM tu GROUP BY ALL"))
def v07(spark, d):
    return fi.file_interactions(event_runs(spark, d).calls).groupBy("traj_id", "path", "type").agg(
        F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"), F.count("*").alias("touches")
    )


@query("v07_plan_gantt", events_sql(PLAN + " SELECT traj_id, content, start_step, end_step, start_step IS NULL AS unstarted FROM ps"))
def v07p(spark, d):
    return s.plan_items(s.plan_history(event_runs(spark, d).calls)).select("traj_id", "content", "start_step", "end_step", F.col("start_step").isNull().alias("unstarted"))


@query("v09_divergence_waterfall", events_sql(PAIR + EXTRA + """, wf AS (SELECT CAST(g AS VARCHAR) AS group_key, type, CAST(sum(tokens) AS BIGINT) AS tokens FROM pt GROUP BY ALL)
  SELECT *, row_number() OVER w AS rank, CAST(coalesce(sum(tokens) OVER (PARTITION BY group_key ORDER BY tokens DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM wf WINDOW w AS (PARTITION BY group_key ORDER BY tokens DESC, type)"""))
def v09(spark, d):
    return v.waterfall(_patterns(spark, d)[1]).withColumn("rank", F.col("rank").cast("bigint"))


@query("v10_brief", events_sql(""" SELECT traj_id, 0::BIGINT AS line_no, count(*) || ' steps, ' || CAST(sum(cents) AS BIGINT) || ' tokens, ' || count(tool_name) || ' tool calls' AS text FROM st GROUP BY traj_id
   UNION ALL SELECT traj_id, 1, count(*) FILTER (failed OR coalesce(exit_code, 0) <> 0) || ' failed calls' FROM st GROUP BY traj_id
   UNION ALL SELECT traj_id, 2, (w + 50) // 100 // 10 || '.' || (w + 50) // 100 % 10 || ' s on the clock' FROM (SELECT traj_id, CAST(CASE WHEN max(completed) > min(created) THEN max(completed) - min(created) ELSE sum(cents) END AS BIGINT) AS w FROM st GROUP BY traj_id)"""))
def v10(spark, d):
    runs = event_runs(spark, d)
    return v.brief(m.scorecard(runs.steps, runs.calls)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("p32_agent_labels", events_sql("SELECT DISTINCT traj_id, eff_agent AS agent, CASE WHEN eff_agent = '' THEN 'main' ELSE eff_agent END AS label FROM st"))
def p32(spark, d):
    return v.agent_labels(event_runs(spark, d).steps)


@query("p32_tagged_labels", events_sql("SELECT DISTINCT traj_id, CASE WHEN agent <> '' AND NOT is_user THEN 'S' || traj_id || '-' || agent ELSE '' END AS agent, CASE WHEN agent <> '' AND NOT is_user THEN 'sub ' || substr('S' || traj_id || '-' || agent, 1, 12) ELSE 'main' END AS label FROM st"))
def p32t(spark, d):
    return v.agent_labels(tagged(event_runs(spark, d))[0])


@query("p34_friendly_finish", events_sql("SELECT traj_id, step_idx, CASE WHEN finish = 'stop' THEN 'Completed' ELSE 'Tool Call' END AS finish FROM st"))
def p34(spark, d):
    return event_runs(spark, d).steps.select("traj_id", "step_idx", fl.friendly_finish(F.col("finish")).alias("finish"))


ISSUES = CLUSTER + FAILS.replace(", fc AS", ", fcx AS").replace("FROM fc WHERE", "FROM fcx WHERE") + FRUIT + THRASH + PLAN + """, sgx AS (SELECT traj_id, step_idx, lower(tool_name) || ':' || pattern || '|' || path AS signature FROM fr WHERE fruitless),
 iz AS (SELECT traj_id, 'failure_pattern' AS kind, CASE WHEN error_class = 'system' THEN 'antipattern' ELSE 'error' END AS severity FROM cl
  UNION ALL SELECT traj_id, 'cascade', 'error' FROM ch WHERE length >= 2
  UNION ALL SELECT traj_id, 'fruitless', 'antipattern' FROM (SELECT traj_id, step_idx - row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) AS g FROM fr WHERE fruitless) GROUP BY traj_id, g HAVING count(*) >= 3
  UNION ALL SELECT traj_id, 'edit_thrash', 'antipattern' FROM th
  UNION ALL SELECT traj_id, 'repeated_search', 'antipattern' FROM sgx GROUP BY traj_id, signature HAVING count(*) >= 3 AND max(step_idx) - min(step_idx) + 1 <> count(*)
  UNION ALL SELECT traj_id, 'stalled_item', 'antipattern' FROM ps WHERE stalled)"""


@query("k03_issue_counts", events_sql(ISSUES + " SELECT traj_id, kind, severity, count(*) AS n FROM iz GROUP BY ALL"))
def k03(spark, d):
    """Issues per run and kind; bottlenecks have their own query."""
    runs = event_runs(spark, d)
    return iss.issues(runs.steps, runs.calls).filter("kind <> 'bottleneck'").groupBy("traj_id", "kind", "severity").agg(F.count("*").alias("n"))


@query("k02_ranked_issues", None)
def k02(spark, d):
    runs = event_runs(spark, d)
    return iss.issues(runs.steps, runs.calls).orderBy("traj_id", "severity_rank", "step_idx", "title")


@query("k04_issue_kpi", None)
def k04(spark, d):
    runs = event_runs(spark, d)
    return iss.issue_kpi(iss.issues(runs.steps, runs.calls), runs.steps)


@query("t02_live_counters", events_sql("SELECT traj_id, epoch_us(time_bucket(INTERVAL 1 HOUR, make_timestamp(t_start * 1000))) AS start_us, count(*) AS calls, count(*) FILTER (failed OR coalesce(exit_code, 0) <> 0) AS failures FROM calls GROUP BY ALL"))
def t02(spark, d):
    """The streaming aggregation over the finished table."""
    rows = live.run_counters(live.with_event_time(event_runs(spark, d, indexed=False).calls, "time_start"))
    return rows.select("traj_id", F.unix_micros("start").alias("start_us"), "calls", "failures")


@query("t03_failure_rate", events_sql("""SELECT tool_name, epoch_us(time_bucket(INTERVAL 5 MINUTE, make_timestamp(t_start * 1000))) - o AS start_us, count(*) AS calls, count(*) FILTER (failed OR coalesce(exit_code, 0) <> 0) AS failures
   FROM calls, (SELECT unnest([0, 300000000]) AS o) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY tool_name, epoch_us(time_bucket(INTERVAL 5 MINUTE, make_timestamp(t_start * 1000))) - o")))
def t03(spark, d):
    rows = live.failure_rate(live.with_event_time(event_runs(spark, d, indexed=False).calls, "time_start"))
    return rows.select("tool_name", F.unix_micros("start").alias("start_us"), "calls", "failures")


@query("t04_idle_sessions", events_sql(""", gp AS (SELECT traj_id, t_start, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY traj_id ORDER BY t_start) <= 1800000 THEN 0 ELSE 1 END AS f FROM calls),
  gg AS (SELECT *, sum(f) OVER (PARTITION BY traj_id ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS g FROM gp) SELECT traj_id, min(t_start) * 1000 AS start_us, count(*) AS rows FROM gg GROUP BY traj_id, g"""))
def t04(spark, d):
    rows = live.idle_sessions(live.with_event_time(event_runs(spark, d, indexed=False).calls, "time_start"), "30 minutes")
    return rows.select("traj_id", F.unix_micros("start").alias("start_us"), "rows")
