"""Object exports and exec-style logs rendered from the events table."""

from pyspark.sql import functions as F

from catalog.ingest import EV, rows
from catalog.registry import query
from catalog.sequence import TAGGED, tagged
from catalog.sql import events_sql
from runloom.operators.slices import with_slice
from runloom.sources import exec_calls as ex, opencode as oc
from runloom.sources.bridges import event_runs, table


def exports(spark, d):
    """One small export per event: a user turn and an assistant turn with a tool part."""
    n = F.col("event_id").cast("string")
    kind = F.col("event_type")
    user = F.struct(
        F.struct(F.lit("user").alias("role"), F.lit("s1").alias("sessionID"), F.lit(None).cast("string").alias("modelID"), F.struct(F.col("ms").alias("created"), F.lit(None).cast("bigint").alias("completed")).alias("time"),
                 F.lit(None).cast("struct<input:bigint,output:bigint,cache:struct<read:bigint>>").alias("tokens")).alias("info"),
        F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("do "), n).alias("text"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("callID"),
                         F.lit(None).cast("struct<status:string,title:string,output:string,input:struct<command:string>,metadata:struct<exit:bigint>>").alias("state"))).alias("parts"),
    )
    state = F.struct(
        F.when(kind == "error", "error").otherwise("completed").alias("status"), F.lit("run it").alias("title"), F.lit("out").alias("output"),
        F.struct(F.concat(F.lit("ls "), n).alias("command")).alias("input"), F.struct((F.col("k") % 3).alias("exit")).alias("metadata"),
    )
    answer = F.struct(
        F.struct(F.lit("assistant").alias("role"), F.lit("s1").alias("sessionID"), F.lit("m1").alias("modelID"), F.struct(F.col("ms").alias("created"), (F.col("ms") + F.col("cents")).alias("completed")).alias("time"),
                 F.struct(F.col("cents").alias("input"), F.lit(3).cast("bigint").alias("output"), F.struct(F.lit(2).cast("bigint").alias("read")).alias("cache")).alias("tokens")).alias("info"),
        F.array(F.struct(F.lit("tool").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("bash").alias("tool"), F.concat(F.lit("c"), n).alias("callID"), state.alias("state"))).alias("parts"),
    )
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("r"), n).alias("id")).alias("info"), F.array(user, answer).alias("messages")))
    return rows(spark, d).select(F.col("event_id").alias("traj_id"), doc.alias("text"))


@query("s15_export_steps", EV + """SELECT event_id AS traj_id, 0::BIGINT AS step_idx, 'user' AS role, 0::BIGINT AS total, 'do ' || event_id AS text_preview, 0::BIGINT AS tool_call_count, 0::BIGINT AS error_count, '' AS model_id, ms AS time_created_ms, NULL::BIGINT AS time_completed_ms FROM ev
  UNION ALL SELECT event_id, 1, 'assistant', cents + 5, '[Tool: bash] run it', 1, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, 'm1', ms, ms + cents FROM ev""")
def s15(spark, d):
    return oc.convert(exports(spark, d)).steps.select("traj_id", "step_idx", "role", "tokens.total", "text_preview", "tool_call_count", "error_count", "model_id", "time_created_ms", "time_completed_ms")


@query("p02_export_calls", EV + "SELECT event_id AS traj_id, 1::BIGINT AS step_idx, 'bash' AS tool_name, 'c' || event_id AS tool_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status, 'ls ' || event_id AS command, true AS exit_present, k % 3 AS exit_code FROM ev")
def p02(spark, d):
    return oc.convert(exports(spark, d)).calls.select("traj_id", "step_idx", "tool_name", "tool_id", "status", "input.command", "exit_present", "exit_code")


@query("s16_session_summary", events_sql(TAGGED + """ SELECT traj_id, min(created) AS started, max(completed) AS finished, arg_min(model_id, step_idx) FILTER (model_id <> '') AS model, count(DISTINCT session_id) FILTER (sub) AS subagent_sessions,
   (max(completed) - min(created)) / 1000.0::DOUBLE AS total_duration FROM tg GROUP BY traj_id"""))
def s16(spark, d):
    return oc.session_summary(tagged(event_runs(spark, d))[0])


@query("p33_timeline_agents", events_sql(TAGGED + """, ns AS (SELECT traj_id, count(DISTINCT session_id) AS c FROM tg GROUP BY 1)
  SELECT traj_id, step_idx, CASE WHEN c > 1 THEN session_id || CASE WHEN NOT (is_user AND k % 20 = 0) AND agent <> '' THEN '::' || agent WHEN is_user AND k % 20 = 0 AND agent <> '' AND EXISTS (SELECT 1 FROM tg x WHERE x.traj_id = tg.traj_id AND x.session_id = tg.session_id AND NOT (x.is_user AND x.k % 20 = 0)) THEN '::' || agent ELSE '' END
    WHEN is_user THEN '' WHEN sub THEN session_id ELSE '' END AS lane FROM tg JOIN ns USING (traj_id)"""))
def p33(spark, d):
    return oc.timeline_agents(tagged(event_runs(spark, d))[0])


def execs(spark, d):
    e, n = F.col("event_id") % 7, F.col("event_id").cast("string")
    line = (
        F.when(e == 0, F.concat(F.lit("cat src/a"), n, F.lit(".py | head")))
        .when(e == 1, F.concat(F.lit("rg -n 'v"), n, F.lit("' src")))
        .when(e == 2, F.concat(F.lit("ls dir"), n))
        .when(e == 3, F.concat(F.lit("echo x | tee out/f"), n, F.lit(".txt")))
        .when(e == 4, F.concat(F.lit("make t"), n))
        .when(e == 5, F.concat(F.lit("*** Begin Patch\n*** Update File: p"), n, F.lit(".py\n+x")))
        .otherwise("")
    )
    name = F.when(e == 5, "apply_patch").when(e == 6, "view_image").otherwise("exec_command")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", name.alias("function"), line.alias("command"))


@query("s23_exec_intent", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'Glob' WHEN 3 THEN 'Write' WHEN 4 THEN 'Bash' WHEN 5 THEN 'Write' ELSE 'view_image' END AS tool,
   CASE event_id % 7 WHEN 0 THEN 'src/a' || event_id || '.py' WHEN 3 THEN 'out/f' || event_id || '.txt' WHEN 5 THEN 'p' || event_id || '.py' END AS file_path,
   CASE event_id % 7 WHEN 1 THEN 'v' || event_id END AS pattern, CASE event_id % 7 WHEN 1 THEN 'src' WHEN 2 THEN 'dir' || event_id END AS path FROM events""")
def s23(spark, d):
    r = execs(spark, d).withColumn("tool", ex.exec_tool(F.col("function"), F.col("command")))
    return r.select("event_id", "tool", ex.exec_input(F.col("tool"), F.col("command")).alias("i")).select("event_id", "tool", "i.*")


@query("s21_paired_outputs", """SELECT user_id AS traj_id, 'c' || event_id AS call_id, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'error' ELSE 'success' END AS status,
   CASE WHEN event_id % 5 = 0 THEN '' WHEN event_type = 'view' THEN 'Error: no' ELSE 'fine' END AS output FROM events""")
def s21(spark, d):
    e = F.col("event_id")
    calls = table(spark, d, "events").select(F.col("user_id").alias("traj_id"), F.concat(F.lit("c"), e.cast("string")).alias("call_id"), e.alias("line_no"), "event_type")
    outputs = calls.filter("line_no % 5 <> 0").select(
        "traj_id", "call_id", (F.col("line_no") + 1).alias("line_no"), F.when(F.col("event_type") == "view", "Error: no").otherwise("fine").alias("output"),
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 0).alias("exit_code"),
    )
    return ex.pair_outputs(calls, outputs).select("traj_id", "call_id", "status", "output")


@query("s18_pair_in_turn", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 3 = 0)
  SELECT c.user_id AS traj_id, c.event_id AS line_no, CAST(r.event_id AS VARCHAR) AS output, CASE WHEN r.event_id IS NULL THEN 'missing_result' END AS error_type FROM c LEFT JOIN r ON r.user_id = c.user_id AND r.event_type = c.event_type AND r.n = c.n""")
def s18(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("traj_id"), F.col("event_type").alias("call_id"), F.col("event_id").alias("line_no"))
    results = calls.filter("line_no % 3 = 0").withColumn("output", F.col("line_no").cast("string"))
    return ex.pair_in_turn(calls, results).select("traj_id", "line_no", "output", "error_type")


@query("s25_model_in_force", events_sql(""" SELECT traj_id, step_idx AS line_no, last_value(CASE WHEN k % 4 = 0 THEN 'm' || (k % 5) END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS current_model FROM st"""))
def s25(spark, d):
    from runloom.sources.bridges import event_rows

    k = F.col("k")
    r = with_slice(event_rows(spark, d)).select("traj_id", "slice", F.col("step_idx").alias("line_no"), F.when(k % 4 == 0, F.concat(F.lit("m"), (k % 5).cast("string"))).otherwise("").alias("model"))
    return ex.carry_model(r).select("traj_id", "line_no", "current_model")
