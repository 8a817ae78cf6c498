"""Files, hotspots, filters, top steps."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql, orders_sql
from catalog.metrics import _nr
from catalog.sequence import tagged
from runloom import vocab
from runloom.functions import calls as fc, paths
from runloom.operators import files as fi, filters as fl, hotspots as h, metrics as m
from runloom.sources.bridges import chat_runs, event_runs, order_runs, table

TOUCH = """, tu AS (SELECT traj_id, step_idx, tool_name AS tool, file_path AS path, CASE WHEN tool_name = 'Read' THEN 'read' ELSE 'write' END AS type, cents FROM calls WHERE tool_name IN ('Read', 'Edit')
   UNION ALL SELECT traj_id, step_idx, tool_name, path, 'search', cents FROM calls WHERE tool_name IN ('Grep', 'Glob')
   UNION ALL SELECT traj_id, step_idx, tool_name, pattern, 'search', cents FROM calls WHERE tool_name = 'Glob'
   UNION ALL SELECT traj_id, step_idx, tool_name, './src/m' || (k % 5) || '.py', 'read', cents FROM calls WHERE tool_name = 'Bash' AND k % 4 = 1
   UNION ALL SELECT traj_id, step_idx, tool_name, './src', 'read', cents FROM calls WHERE tool_name = 'Bash' AND k % 4 = 2),
 tg AS (SELECT DISTINCT traj_id, 'src/m' || (k % 5) || '.py' AS path FROM st WHERE event_type = 'purchase'),
 nm AS (SELECT *, CASE WHEN path LIKE './%' THEN substr(path, 3) ELSE path END AS np FROM tu)"""


@query("g16_file_interactions", events_sql(TOUCH + " SELECT traj_id, step_idx, tool, path, type FROM tu"))
def g16(spark, d):
    return fi.file_interactions(event_runs(spark, d).calls).select("traj_id", "step_idx", "tool", "path", "type")


@query("g17_target_files", events_sql(TOUCH + " SELECT * FROM tg"))
def g17(spark, d):
    runs = event_runs(spark, d, indexed=False)
    return fi.target_files(runs.calls, runs.parts)


@query("j06_first_touches", events_sql(TOUCH + """ SELECT tg.traj_id, tg.path AS target, min(step_idx) AS first_step FROM tg JOIN nm ON nm.traj_id = tg.traj_id AND nm.np = tg.path GROUP BY ALL"""))
def j06(spark, d):
    runs = event_runs(spark, d)
    return fi.first_touches(fi.file_interactions(runs.calls), fi.target_files(runs.calls, runs.parts))


@query("a22_file_targeting", events_sql(TOUCH + """, ft AS (SELECT tg.traj_id, tg.path, min(step_idx) AS f FROM tg JOIN nm ON nm.traj_id = tg.traj_id AND nm.np = tg.path GROUP BY ALL)
  SELECT traj_id, targets, coalesce(tt, 0) AS touched_targets, af AS avg_first_touch, coalesce(lk, 0) / targets::DOUBLE AS exploration_ratio
  FROM (SELECT traj_id, count(*) AS targets FROM tg GROUP BY 1)
  LEFT JOIN (SELECT traj_id, count(*) AS tt, sum(f)::DOUBLE / count(*) AS af FROM ft GROUP BY 1) USING (traj_id)
  LEFT JOIN (SELECT traj_id, count(DISTINCT np) AS lk FROM nm WHERE type IN ('read', 'search') GROUP BY 1) USING (traj_id)
  WHERE traj_id IN (SELECT traj_id FROM tu)"""))
def a22(spark, d):
    runs = event_runs(spark, d)
    return fi.file_targeting(runs.steps, fi.file_interactions(runs.calls), fi.target_files(runs.calls, runs.parts))


@query("a22_file_token_cost", events_sql(TOUCH + """, pn AS (SELECT traj_id, step_idx, count(*) AS n FROM tu GROUP BY ALL)
  SELECT traj_id, np AS path, CAST(round(sum(CAST(cents AS DECIMAL(28,9)) / n)) AS BIGINT) AS tokens FROM nm JOIN pn USING (traj_id, step_idx) WHERE cents > 0 GROUP BY ALL"""))
def a22c(spark, d):
    runs = event_runs(spark, d)
    return fi.file_token_cost(runs.steps, fi.file_interactions(runs.calls))


@query("k08_file_summary", events_sql(TOUCH + """ SELECT traj_id, count(DISTINCT path) AS unique_paths, count(*) FILTER (type = 'read') AS reads, count(*) FILTER (type = 'write') AS writes,
   count(*) FILTER (type = 'search') AS searches, 0::BIGINT AS skill_loads FROM tu GROUP BY traj_id"""))
def k08(spark, d):
    return fi.file_summary(fi.file_interactions(event_runs(spark, d).calls)).withColumnRenamed("searchs", "searches")


@query("a28_capability_usage", events_sql("SELECT traj_id, 'tool' AS kind, tool_name AS name, count(*) AS calls FROM calls GROUP BY ALL"))
def a28(spark, d):
    return fi.capability_usage(event_runs(spark, d, indexed=False).calls)


def _skills(calls):
    """Task calls of the bridge turned into skill calls."""
    skill = F.concat(F.lit("s"), (F.col("step_idx") % 4).cast("string"))
    named = F.when(F.col("step_idx") % 3 > 0, skill)
    return calls.withColumns(
        {
            "tool_name": F.when(F.col("tool_name") == "Task", "Skill").otherwise(F.col("tool_name")),
            "input": F.col("input").withField("skill_name", F.when(F.col("tool_name") == "Task", named)),
        }
    )


@query("a29_skill_calls", events_sql("""SELECT traj_id, eff_agent AS agent, CASE WHEN step_idx % 3 > 0 THEN 's' || (step_idx % 4) ELSE '(unnamed skill)' END AS skill, count(*) AS calls
   FROM calls WHERE tool_name = 'Task' GROUP BY ALL"""))
def a29(spark, d):
    runs = event_runs(spark, d)
    calls = _skills(runs.calls).withColumn("tool_name", F.when(F.col("tool_name") == "Skill", "skill").otherwise(F.col("tool_name")))
    return fi.skill_calls(runs.steps, calls)


@query("p16_tool_vocabulary", orders_sql("""SELECT traj_id, step_idx, call_pos, tool_name IN ('Edit', 'Write') AS writes, tool_name = 'Task' AS spawns, tool_name = 'Bash' AS shells,
   tool_name IN ('Read', 'Grep', 'Glob', 'Edit', 'Write') AS system, tool_name LIKE 'mcp%' AS mcp, file_path AS write_path FROM ocalls"""))
def p16(spark, d):
    return order_runs(spark, d).calls.select(
        "traj_id", "step_idx", "call_pos", fc.is_tool(vocab.WRITE_TOOLS).alias("writes"), fc.is_tool(vocab.SPAWN_TOOLS).alias("spawns"),
        fc.is_tool(vocab.BASH_TOOLS).alias("shells"), fc.is_tool(vocab.SYSTEM_TOOLS).alias("system"), fc.is_mcp(F.col("tool_name")).alias("mcp"),
        fc.write_path().alias("write_path"),
    )


def _commands(spark, d):
    """Shell lines made from event rows, with wrappers, navigation and pipes."""
    e, k = F.col("event_id"), (F.col("event_id") % 8)
    n = e.cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("cd /w/"), n, F.lit(" && pytest -q tests")))
        .when(k == 1, F.concat(F.lit("FOO="), n, F.lit(" env BAR=2 sudo -u root grep -rn x .")))
        .when(k == 2, F.concat(F.lit("timeout 30 python3 -m tool"), n, F.lit(" --fast")))
        .when(k == 3, F.concat(F.lit("python /opt/run"), n, F.lit(".py | head -5")))
        .when(k == 4, F.concat(F.lit("git grep v"), n))
        .when(k == 5, F.concat(F.lit("/usr/bin/find . -name f"), n))
        .when(k == 6, F.concat(F.lit("cd /w"), n))
        .otherwise(F.concat(F.lit("bash -c 'npm test "), n, F.lit("' ; ls")))
    )
    return table(spark, d, "events").select("event_id", line.alias("command"))


@query("p22_primary_command", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'pytest' WHEN 1 THEN 'grep' WHEN 2 THEN 'tool' || event_id WHEN 3 THEN 'run' || event_id || '.py'
   WHEN 4 THEN 'git' WHEN 5 THEN 'find' WHEN 6 THEN 'cd' ELSE 'npm' END AS label FROM events""")
def p22(spark, d):
    return _commands(spark, d).select("event_id", fc.primary_command(F.col("command")).alias("label"))


@query("p24_runs_search", "SELECT event_id, event_id % 8 IN (1, 4, 5) AS searches FROM events")
def p24(spark, d):
    return _commands(spark, d).select("event_id", fc.runs_search(F.col("command")).alias("searches"))


@query("p25_shell_paths", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '/w/' || event_id WHEN 3 THEN '/opt/run' || event_id || '.py' WHEN 5 THEN '/usr/bin/find' WHEN 6 THEN '/w' || event_id ELSE '' END AS paths FROM events""")
def p25(spark, d):
    return _commands(spark, d).select("event_id", F.array_join(fc.shell_paths(F.col("command")), ",").alias("paths"))


@query("p27_validation_command", "SELECT event_id, event_id % 8 IN (0, 7) AS validates FROM events")
def p27(spark, d):
    return _commands(spark, d).select("event_id", fc.is_validation(F.col("command")).alias("validates"))


@query("p31_base_command", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'cd' WHEN 1 THEN 'env' WHEN 2 THEN 'timeout' WHEN 3 THEN 'python' WHEN 4 THEN 'git'
   WHEN 5 THEN '/usr/bin/find' WHEN 6 THEN 'cd' ELSE 'bash' END AS base FROM events""")
def p31(spark, d):
    return _commands(spark, d).select("event_id", fc.base_command(F.col("command")).alias("base"))


@query("p17_error_class", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'platform_error' WHEN 1 THEN 'permission_error' WHEN 2 THEN 'missing_file' WHEN 3 THEN 'bad_input' END AS class FROM events""")
def p17(spark, d):
    e = F.col("event_id")
    words = ("sh: foo: command not found", "open: Permission denied", "ENOENT: no such file", "line 9 out of range", "fine")
    text = F.element_at(F.array(*[F.lit(w) for w in words]), (e % 5 + 1).cast("int"))
    text = F.concat(F.col("event_type"), F.lit(": "), text)
    return table(spark, d, "events").select("event_id", fc.error_class(text).alias("class"))


@query("p20_call_window", events_sql("SELECT traj_id, step_idx, t_start AS win_start, t_end AS win_end FROM calls"))
def p20(spark, d):
    return event_runs(spark, d).calls.select("traj_id", "step_idx", fc.window_ms()["start"].alias("win_start"), fc.window_ms()["end"].alias("win_end"))


@query("p23_call_hint", events_sql("SELECT traj_id, step_idx, coalesce(command, file_path, path, '') AS hint FROM calls"))
def p23(spark, d):
    return event_runs(spark, d).calls.select("traj_id", "step_idx", fc.hint().alias("hint"))


@query("p26_path_normal", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/home/u/a' || event_id || '.py' WHEN 1 THEN 'b' || event_id WHEN 2 THEN '/x/c' || event_id WHEN 3 THEN '../d' || event_id
   ELSE 'e/f' || event_id END AS path FROM events""")
def p26(spark, d):
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    raw = (
        F.when(e % 5 == 0, F.concat(F.lit("\\\\wsl.localhost\\Ubuntu\\home\\u\\a"), n, F.lit(".py")))
        .when(e % 5 == 1, F.concat(F.lit("./a/../b"), n))
        .when(e % 5 == 2, F.concat(F.lit("C:\\x\\.\\c"), n))
        .when(e % 5 == 3, F.concat(F.lit("q/../../d"), n, F.lit("/")))
        .otherwise(F.concat(F.lit("e//f"), n))
    )
    return table(spark, d, "events").select("event_id", paths.target(raw).alias("path"))


@query("f07_skill_file", """SELECT event_id, event_id % 3 = 0 AS skill_file FROM events""")
def f07(spark, d):
    n = F.col("event_id").cast("string")
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a"), n, F.lit("/SKILL.md"))).otherwise(F.concat(F.lit("skill.md/b"), n))
    call = F.struct(path.alias("p"))
    return table(spark, d, "events").select("event_id", F.lower(paths.basename(call["p"])).eqNullSafe("skill.md").alias("skill_file"))


@query("f02_workflow_filter", events_sql("""SELECT traj_id, step_idx FROM st WHERE NOT (is_user AND k % 20 <> 0 AND k % 6 <> 0) AND tool_name IS NOT NULL
   AND (contains(preview, 'm3') OR contains(coalesce(command, ''), 'm3') OR contains(coalesce(file_path, ''), 'm3') OR (tool_name = 'TodoWrite' AND (k % 7 = 3 OR (k + 1) % 7 = 3)))"""))
def f02(spark, d):
    runs = event_runs(spark, d)
    return fl.filter_steps(runs.steps, runs.calls, runs.parts, ["Assistant"], ["Tool Calls"], keyword=" M3 ")


@query("f02_keyword_chat", """SELECT conv_id AS traj_id, turn AS step_idx FROM conversations WHERE contains(lower(text), 'que') AND role = 'user'""")
def f02c(spark, d):
    runs = chat_runs(spark, d)
    return fl.filter_steps(runs.steps, runs.calls, runs.parts, ["User"], keyword="que")


@query("f08_success", events_sql("SELECT traj_id, coalesce(arg_max(finish, step_idx) FILTER (NOT is_user) = 'stop', false) AS success FROM st GROUP BY traj_id"))
def f08(spark, d):
    return fl.success(event_runs(spark, d).steps)


@query("f09_empty_runs", """SELECT c_custkey AS traj_id, 'no steps' AS error FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def f09(spark, d):
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("traj_id"))
    return fl.empty_runs(sessions, event_runs(spark, d, indexed=False).steps)


@query("k05_head_tail", events_sql("""SELECT traj_id, step_idx FROM (SELECT traj_id, step_idx, max(step_idx) OVER (PARTITION BY traj_id) AS mx FROM st) WHERE step_idx < 10 OR step_idx > mx - 10"""))
def k05(spark, d):
    return fl.head_and_tail(event_runs(spark, d).steps, 10).select("traj_id", "step_idx")


@query("k06_preview_limit", events_sql("SELECT traj_id, step_idx, preview FROM st WHERE step_idx < 80"))
def k06(spark, d):
    return event_runs(spark, d).steps.filter("step_idx < 80").select("traj_id", "step_idx", F.col("text_preview").alias("preview"))


def _k01(name, value, order, where):
    return events_sql(f"""SELECT traj_id, step_idx, row_number() OVER (PARTITION BY traj_id ORDER BY {value} {order}, step_idx) AS rank, {value} AS {name} FROM st
      WHERE {where} QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY {value} {order}, step_idx) <= 5""")


@query("k01_top_latency", _k01("duration", "duration", "DESC", "true"))
def k01a(spark, d):
    return h.top_steps(event_runs(spark, d).steps, "duration").select("traj_id", "step_idx", "rank", "duration")


@query("k01_top_tokens", _k01("total", "cents", "DESC", "true"))
def k01b(spark, d):
    rows = event_runs(spark, d).steps.withColumn("total", F.col("tokens.total"))
    return h.top_steps(rows, "total").select("traj_id", "step_idx", "rank", "total")


@query("k01_low_cache", _k01("share", "(cache_read / cents::DOUBLE)", "ASC", "NOT is_user AND cents > 0 AND traj_id IN (SELECT traj_id FROM st WHERE NOT is_user AND cache_read > 0)"))
def k01c(spark, d):
    rows = m.cache_columns(event_runs(spark, d).steps).filter("role = 'assistant' and tokens.total > 0")
    used = rows.filter("share > 0").select("traj_id").distinct()
    return h.top_steps(rows.join(used, "traj_id", "left_semi"), "share", largest=False).select("traj_id", "step_idx", "rank", "share")


DECOMP = """, dd AS (SELECT *, lag(completed) OVER (PARTITION BY traj_id ORDER BY step_idx) AS done FROM st),
 de AS (SELECT *, CASE WHEN cents > 0 THEN greatest(0, coalesce(created - done + 5, 0) // 10) / 100.0::DOUBLE ELSE 0.0 END AS idle0,
   CASE WHEN tool_name IS NULL OR cents = 0 THEN 0.0 ELSE least((t_end - t_start) / 1000.0::DOUBLE, duration) END AS tool0 FROM dd),
 df AS (SELECT *, CASE WHEN cents > 0 THEN greatest(0.0::DOUBLE, duration - tool0) ELSE 0.0 END AS inf0, duration + idle0 AS span FROM de),
 dc AS (SELECT traj_id, step_idx, is_user, cents, cache_read, duration, CASE WHEN tool_name IS NULL OR cents = 0 THEN 0.0 ELSE (cents // 2 + 5) // 10 / 100.0::DOUBLE END AS tool_s, (cents - CASE WHEN tool_name IS NULL THEN 0 ELSE cents // 2 END + 5) // 10 / 100.0::DOUBLE AS inference_s, idle0 AS idle_s,
   CASE WHEN cents > 0 THEN round(tool0 / span * 100, 1) ELSE 0.0 END AS tool_pct, CASE WHEN cents > 0 THEN round(inf0 / span * 100, 1) ELSE 0.0 END AS inference_pct,
   CASE WHEN cents > 0 THEN round(idle0 / span * 100, 1) ELSE 0.0 END AS idle_pct, cents = 0 AS timing_incomplete,
   CASE WHEN cents > 1 THEN tool_name END AS dominant_tool, CASE WHEN cents > 1 AND tool_name IS NOT NULL THEN coalesce(file_path, command, pattern, '') END AS dominant_target FROM df)"""


@query("g18_hotspot_split", events_sql(DECOMP + " SELECT * EXCLUDE (is_user, cents, cache_read, duration) FROM dc"))
def g18(spark, d):
    runs = event_runs(spark, d)
    return h.decompose(runs.steps, runs.calls).select(
        "traj_id", "step_idx", "tool_s", "inference_s", "idle_s", "tool_pct", "inference_pct", "idle_pct", "timing_incomplete", "dominant_tool", "dominant_target"
    )


@query("g19_hotspot_text", None)
def g19(spark, d):
    runs = event_runs(spark, d)
    return h.decompose(runs.steps, runs.calls).select("traj_id", "step_idx", h.explanation().alias("explanation"))


THR = "," + _nr("st", "duration", 0.9, "p90", where="NOT is_user AND cents > 0") + """, mo AS (SELECT traj_id, count(*) AS n, avg(duration) AS mean, stddev_samp(duration) AS sd FROM st WHERE NOT is_user AND cents > 0 GROUP BY 1),
 th AS (SELECT traj_id, CASE WHEN n >= 8 AND sd > 0 THEN greatest(8.0, least(greatest(8.0, p90_median * 2, p90), greatest(p90_median * 2, mean + 1.5 * sd)))
   ELSE greatest(8.0, p90_median * 2, p90) END AS threshold FROM mo JOIN p90 USING (traj_id))"""


@query("g20_outlier_threshold", events_sql(THR + " SELECT traj_id, round(threshold, 6) AS threshold FROM th"))
def g20(spark, d):
    return h.outlier_thresholds(event_runs(spark, d, indexed=False).steps).withColumn("threshold", F.round("threshold", 6))


@query("g21_bottlenecks", events_sql(THR + DECOMP + """, cc AS (SELECT dc.*, duration + idle_s AS impact, CASE WHEN idle_pct >= 40 AND idle_s >= 10 THEN 'idle' WHEN tool_pct >= 50 AND tool_s >= 5 THEN 'tool'
    WHEN inference_pct >= 50 AND inference_s >= 15 AND (cents >= 40000 OR round(cache_read / cents::DOUBLE, 4) < 0.35) THEN 'context' WHEN inference_pct >= 50 AND inference_s >= 30 THEN 'inference' END AS cause
    FROM dc JOIN th USING (traj_id) WHERE NOT is_user AND cents > 0 AND duration + idle_s >= threshold)
  SELECT traj_id, step_idx, row_number() OVER w AS rank, duration, cause, idle_s, tool_s, inference_s FROM cc WHERE cause IS NOT NULL
  WINDOW w AS (PARTITION BY traj_id ORDER BY impact DESC, step_idx) QUALIFY row_number() OVER w <= 3"""))
def g21(spark, d):
    runs = event_runs(spark, d)
    return h.bottlenecks(runs.steps, runs.calls).drop("title", "detail")


@query("g22_sigma_outliers", events_sql(""", sg AS (SELECT traj_id, avg(duration) AS mean, stddev_samp(duration) AS sd, count(*) AS n FROM st WHERE cents > 0 GROUP BY 1)
  SELECT st.traj_id, step_idx, duration FROM st JOIN sg USING (traj_id) WHERE n >= 5 AND sd > 0 AND duration - mean > 2.0 * sd"""))
def g22(spark, d):
    return h.sigma_outliers(event_runs(spark, d).steps, F.col("duration")).select("traj_id", "step_idx", "duration")


@query("j05_step_with_analytics", events_sql("""SELECT traj_id, step_idx, role, (created - lag(completed) OVER (PARTITION BY traj_id ORDER BY step_idx)) / 1000.0::DOUBLE AS idle_before_s FROM st"""))
def j05(spark, d):
    runs = event_runs(spark, d)
    rows = m.step_analytics(runs.steps, runs.calls, runs.parts).select("traj_id", "step_idx", "idle_before_s")
    return runs.steps.select("traj_id", "step_idx", "role").join(rows, ["traj_id", "step_idx"])


@query("p01_tagged_steps", events_sql("""SELECT traj_id, step_idx, role, finish, cents AS total FROM st"""))
def p01(spark, d):
    return tagged(event_runs(spark, d))[0].select("traj_id", "step_idx", "role", "finish", F.col("tokens.total").alias("total"))
