"""Sources: logs rendered from the given tables as vendor JSON, then read back by the source operators."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.operators.slices import with_slice
from runloom.session import shared_folder
from runloom.sources import claude_code as cc, logs, sidecars as sc, usage as us
from runloom.sources.bridges import chat_runs, event_runs, table

EV = """WITH ev AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ms FROM events) """


def rows(spark, d):
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint")
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", k.alias("k"), F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("ts").cast("timestamp").alias("ts"),
    )


def documents(spark, d):
    """One JSON lines text per customer; some broken in the middle, some cut off at the end."""
    c = F.col("c_custkey")
    good = F.concat(F.lit('{"type": "session", "id": "s'), c.cast("string"), F.lit('"}'))
    more = F.lit('{"type": "user/message", "n": 2}')
    text = (
        F.when(c % 5 == 0, F.concat(good, F.lit("\n{broken\n"), more, F.lit("\n")))
        .when(c % 5 == 1, F.concat(good, F.lit("\r\n"), more, F.lit('\r\n{"type": "cut')))
        .when(c % 5 == 2, F.concat(good, F.lit('\n\n{"type": "x"}\n')))
        .when(c % 5 == 3, F.concat(F.lit('{"type": "session_meta"}\n'), more))
        .otherwise(F.concat(F.lit('{"type": "session", "id": "p", "createdAt": 17}\n'), more, F.lit("\n{bad}")))
    )
    return table(spark, d, "customer").select(c.cast("string").alias("path"), text.alias("text"))


@query("s02_line_scan", """SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 5 WHEN 2 THEN unnest([0, 2]) ELSE unnest([0, 1]) END::BIGINT AS line_no FROM customer WHERE c_custkey % 5 <> 0""")
def s02(spark, d):
    return logs.parse_lines(documents(spark, d))[0].select("path", "line_no")


@query("s01_rejected_logs", "SELECT CAST(c_custkey AS VARCHAR) AS path, 2::BIGINT AS line_no FROM customer WHERE c_custkey % 5 = 0")
def s01(spark, d):
    return logs.parse_lines(documents(spark, d))[1]


@query("s04_event_format", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 5 WHEN 1 THEN 'dsh' WHEN 2 THEN 'pi' WHEN 3 THEN 'codex' ELSE 'dsh' END AS format FROM customer WHERE c_custkey % 5 <> 0")
def s04(spark, d):
    events = logs.parse_lines(documents(spark, d))[0].withColumn("file", F.col("path")).withColumn("path", F.col("path").cast("bigint"))
    return logs.event_format(logs.number_events(events)).withColumn("path", F.col("path").cast("string"))


def objects(spark, d):
    c, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = (
        F.when(c % 7 == 0, F.concat(F.lit('{"format": "ccsession-trajectory", "n": '), n, F.lit("}")))
        .when(c % 7 == 1, F.lit('{"export_metadata": {"source_format": "cursor_composer"}, "info": {"id": 1}, "messages": []}'))
        .when(c % 7 == 2, F.lit('{"export_metadata": {"schema_version": 2, "source_format": "codearts_opencode_sqlite"}, "info": {"id": 1}, "messages": []}'))
        .when(c % 7 == 3, F.lit('{"meta": {"session_id": "z"}, "state": {"messages": [{"type": "message", "contents": []}]}}'))
        .when(c % 7 == 4, F.lit('{"info": {"id": 1}, "messages": [1]}'))
        .when(c % 7 == 5, F.lit('[{"_codex_format": true}]'))
        .otherwise(F.lit('{"info": [], "messages": [1]}'))
    )
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


@query("s05_object_format", """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'ccsession' WHEN 1 THEN 'cursor' WHEN 2 THEN 'codearts' WHEN 3 THEN 'icode' WHEN 4 THEN 'opencode' WHEN 5 THEN 'codex' ELSE 'unknown' END AS format FROM customer""")
def s05(spark, d):
    """With the one-element list unwrapping of the payload step."""
    return objects(spark, d).select("c_custkey", logs.object_format(logs.one_event_list(F.col("text"))).alias("format"))


@query("s06_format_hint", """SELECT c_custkey, CASE WHEN h IN ('', f) THEN f WHEN f = 'unknown' THEN h END AS format, CASE WHEN NOT (h IN ('', f) OR f = 'unknown') THEN 'format mismatch: expected ' || h || ', found ' || f END AS error
   FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'pi' ELSE 'codex' END AS h, CASE c_custkey % 2 WHEN 0 THEN 'pi' ELSE 'unknown' END AS f FROM customer)""")
def s06(spark, d):
    c = F.col("c_custkey")
    hint = F.when(c % 3 == 0, "").when(c % 3 == 1, "pi").otherwise("codex")
    r = logs.resolve_format(F.when(c % 2 == 0, "pi").otherwise("unknown"), hint)
    return table(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.*")


@query("p04_iso_millis", EV + "SELECT event_id, ms FROM ev")
def p04(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows(spark, d).select("event_id", logs.iso_millis(text).alias("ms"))


def entry_lines(spark, d):
    """Per event: a thinking block and a tool use of one message, and the tool result of the next user entry."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    n = F.col("event_id").cast("string")
    agent = F.when(F.col("k") % 10 == 9, "sub").otherwise(F.lit(None))
    usage = lambda out: F.struct(F.lit(3).alias("input_tokens"), out.alias("output_tokens"), F.lit(5).alias("cache_read_input_tokens"))
    base = lambda i, role: [(F.col("event_id") * 3 + i).alias("index"), F.lit(role).alias("role"), agent.alias("agent_id")]
    think = F.to_json(F.struct(*base(0, "assistant"), F.concat(F.lit("m"), n).alias("message_id"), when.alias("timestamp"), usage(F.lit(1)).alias("usage"),
                               F.array(F.struct(F.lit("thinking").alias("type"), F.concat(F.lit("hm "), n).alias("text"))).alias("content")))
    tool = F.to_json(F.struct(*base(1, "assistant"), F.concat(F.lit("m"), n).alias("message_id"), F.lit("tool_use").alias("stop_reason"), usage(F.col("cents")).alias("usage"),
                              F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), n).alias("id"), F.col("event_type").alias("name"),
                                               F.struct(F.concat(F.lit("run "), n).alias("command")).alias("input"))).alias("content")))
    back = F.to_json(F.struct(*base(2, "user"), F.concat(F.lit("u"), n).alias("message_id"),
                              F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), n).alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), F.lit("out").alias("content"))).alias("content")))
    return rows(spark, d).select(F.col("user_id").alias("traj_id"), F.explode(F.array(think, tool, back)).alias("line"))


CCX = EV + """, st AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS step_idx, CASE WHEN k % 10 = 9 THEN 'sub' ELSE '' END AS agent FROM ev),
 nx AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, agent ORDER BY step_idx) AS nms FROM st) """


@query("s07_claude_steps", CCX + """SELECT user_id AS traj_id, step_idx, agent, 'assistant' AS role, 8 + cents AS total, cents AS output, 5::BIGINT AS cache_read, 1::BIGINT AS tool_call_count,
   CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS error_count, true AS has_reasoning, 'hm ' || event_id AS text_preview, 'tool_use' AS finish, ms AS time_created_ms, nms AS time_completed_ms FROM nx""")
def s07(spark, d):
    steps = cc.convert(cc.read_entries(entry_lines(spark, d))).steps
    return steps.select("traj_id", "step_idx", "agent", "role", "tokens.total", "tokens.output", "tokens.cache_read", "tool_call_count", "error_count", "has_reasoning", "text_preview", "finish", "time_created_ms", "time_completed_ms")


@query("s08_merge_messages", EV + "SELECT user_id AS traj_id, 'm' || event_id AS message_id, event_id * 3 AS index, 2::BIGINT AS blocks, cents AS output_tokens, 'tool_use' AS stop_reason FROM ev")
def s08(spark, d):
    whole = cc.merge_messages(cc.read_entries(entry_lines(spark, d))).filter("role = 'assistant'")
    return whole.select("traj_id", "message_id", "index", F.size("content").cast("bigint").alias("blocks"), F.col("usage.output_tokens").cast("bigint").alias("output_tokens"), "stop_reason")


@query("s09_tool_results", EV + "SELECT user_id AS traj_id, 't' || event_id AS tool_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, 'out' AS output, CASE WHEN event_type = 'error' THEN 'out' END AS error FROM ev")
def s09(spark, d):
    return cc.tool_results(cc.read_entries(entry_lines(spark, d))).select("traj_id", "tool_id", "result.status", "result.output", "result.error")


@query("s10_claude_calls", CCX + "SELECT user_id AS traj_id, step_idx, 1::BIGINT AS call_pos, event_type AS tool_name, 't' || event_id AS tool_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, 'run ' || event_id AS command FROM st")
def s10(spark, d):
    calls = cc.convert(cc.read_entries(entry_lines(spark, d))).calls
    return calls.select("traj_id", "step_idx", "call_pos", "tool_name", "tool_id", "status", "input.command")


@query("s10_claude_parts", CCX + "SELECT user_id AS traj_id, step_idx, unnest([0, 1])::BIGINT AS part_pos, unnest(['reasoning', 'tool_call']) AS type FROM st")
def s10p(spark, d):
    return cc.convert(cc.read_entries(entry_lines(spark, d))).parts.select("traj_id", "step_idx", "part_pos", "type")


@query("s12_sub_agents", EV + """SELECT user_id AS traj_id, count(*) FILTER (user_id % 2 = 0 OR k % 10 <> 9 OR kind < 2) AS entries FROM ev, (SELECT unnest([0, 1, 2]) AS kind) GROUP BY user_id""")
def s12(spark, d):
    """Runs with even ids list their sub-agent, so the inline copies of it are left out; else its entries count unless they only bring results."""
    e = cc.read_entries(entry_lines(spark, d))
    sub = e.filter("agent_id is not null")
    both = cc.sub_agent_entries(e.filter("agent_id is null"), sub.filter("traj_id % 2 = 0"), sub)
    return both.groupBy("traj_id").agg(F.count("*").alias("entries"))


def counters(spark, d):
    """Token notifications: cumulative counters that reset now and then, repeats, and own usage on some."""
    fields = lambda n: F.struct(n.alias("total"), n.alias("input"), (n - n).alias("output"), (n - n).alias("reasoning"), F.floor(n / 2).alias("cached"))
    steps = event_runs(spark, d).steps.select("traj_id", "slice", "step_idx")
    n = F.when(F.col("step_idx") % 10 < 9, F.floor(F.col("step_idx") % 10 / 2) * 4).otherwise(1).cast("bigint")
    own = F.when(F.col("step_idx") % 6 == 5, fields(F.lit(7).cast("bigint")))
    return steps.select("traj_id", "slice", F.col("step_idx").alias("line_no"), F.floor(F.col("step_idx") / 4).alias("turn"), fields(n).alias("cum"), own.alias("last"))


USE = """, cu AS (SELECT traj_id, step_idx, CASE WHEN step_idx % 10 < 9 THEN (step_idx % 10) // 2 * 4 ELSE 1 END AS c, CASE WHEN step_idx % 6 = 5 THEN 7 END AS l FROM st),
 c1 AS (SELECT *, lag(c) OVER w AS pc, lag(l) OVER w AS pl, lag(step_idx) OVER w AS ps FROM cu WINDOW w AS (PARTITION BY traj_id ORDER BY step_idx)),
 c2 AS (SELECT * FROM c1 WHERE ps IS NULL OR c <> pc OR l IS DISTINCT FROM pl),
 c3 AS (SELECT *, lag(c) OVER (PARTITION BY traj_id ORDER BY step_idx) AS qc FROM c2),
 c4 AS (SELECT *, CASE WHEN l IS NOT NULL THEN 7 WHEN qc IS NULL OR c < qc THEN c ELSE c - qc END AS used, CASE WHEN l IS NOT NULL THEN 3 WHEN qc IS NULL OR c < qc THEN c // 2 ELSE c // 2 - qc // 2 END AS cached FROM c3),
 c5 AS (SELECT * FROM c4 WHERE used <> 0 OR cached <> 0)"""


@query("s22_usage_deltas", events_sql(USE + " SELECT traj_id, step_idx AS line_no, used AS total, cached FROM c5"))
def s22(spark, d):
    return us.usage_deltas(counters(spark, d)).select("traj_id", "line_no", F.col("used.total").alias("total"), F.col("used.cached").cast("bigint").alias("cached"))


@query("s22_turn_usage", events_sql(USE + " SELECT traj_id, step_idx // 4 AS turn, CAST(sum(used) AS BIGINT) AS input, max(used) AS prompt_peak, CAST(arg_max(cached, used * 1000000 - step_idx) AS BIGINT) AS prompt_peak_cache_read FROM c5 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY traj_id, step_idx // 4")))
def s22t(spark, d):
    return us.turn_usage(us.usage_deltas(counters(spark, d))).select("traj_id", "turn", "input", "prompt_peak", F.col("prompt_peak_cache_read").cast("bigint").alias("prompt_peak_cache_read"))


@query("s28_completion_times", events_sql(" SELECT traj_id, step_idx, lead(created) OVER (PARTITION BY traj_id, agent ORDER BY step_idx) AS time_completed_ms FROM st"))
def s28(spark, d):
    steps = event_runs(spark, d).steps.select("traj_id", "slice", "step_idx", F.col("agent").alias("session_id"), F.col("step_idx").alias("pos"), "time_created_ms")
    return us.completion_times(steps).select("traj_id", "step_idx", "time_completed_ms")


@query("s31_estimated_tokens", """SELECT conv_id AS traj_id, turn AS step_idx, CASE WHEN role = 'user' THEN (length(text) + 3) // 4 ELSE 0 END AS input, CASE WHEN role = 'user' THEN 0 ELSE (length(text) + 3) // 4 END AS output FROM conversations""")
def s31(spark, d):
    runs = chat_runs(spark, d)
    return us.estimated_tokens(runs.steps, runs.parts, runs.calls).select("traj_id", "step_idx", "input", "output")


@query("s32_occupancy_ramp", events_sql("""SELECT traj_id, step_idx, CASE WHEN t = n THEN 100000 WHEN t = 1 THEN 0 WHEN w > 0 THEN CAST(round(100000 * c / w::DOUBLE) AS BIGINT) ELSE 0 END AS context_window FROM (
   SELECT traj_id, step_idx, sum(cents) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) AS t, sum(cents) OVER (PARTITION BY traj_id) AS w, count(*) OVER (PARTITION BY traj_id) AS n FROM st WHERE NOT is_user)"""))
def s32(spark, d):
    steps = event_runs(spark, d).steps
    return us.occupancy_ramp(steps, steps.select("traj_id").distinct().withColumn("snapshot", F.lit(100000).cast("bigint")))


@query("s19_running_window", events_sql("""SELECT traj_id, step_idx AS pos, 500 + CAST(sum(cents) OVER w + coalesce(sum(CASE WHEN step_idx = 20 THEN 50 - s END) OVER w, 0) AS BIGINT) AS context_window
   FROM (SELECT *, (SELECT sum(cents) FROM st x WHERE x.traj_id = st.traj_id AND x.step_idx BETWEEN 5 AND 19) AS s FROM st) WINDOW w AS (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING)"""))
def s19(spark, d):
    steps = event_runs(spark, d).steps
    messages = steps.select("traj_id", "slice", F.col("step_idx").alias("pos"), F.col("tokens.total").alias("tokens"), F.lit(500).alias("overhead"))
    contexts = steps.select("traj_id").distinct().select("traj_id", F.lit(5).cast("bigint").alias("start"), F.lit(20).cast("bigint").alias("end"), F.lit(50).alias("summary_tokens"))
    return us.running_window(messages, contexts).withColumn("context_window", F.col("context_window").cast("bigint"))


@query("s40_export_statistics", events_sql("""SELECT traj_id, count(DISTINCT agent) AS sessions, count(DISTINCT agent) FILTER (agent <> '') AS subagent_sessions, count(*) AS total_messages, count(*) FILTER (is_user) AS user_messages,
   count(*) FILTER (NOT is_user) AS assistant_messages, count(tool_name) AS tool_parts, count(*) FILTER (NOT is_user AND k % 4 = 0) AS reasoning_parts,
   count(*) + count(*) FILTER (NOT is_user AND k % 4 = 0) + count(tool_name) + count(*) FILTER (event_type = 'purchase' AND k % 3 = 0) + count(*) FILTER (tool_name = 'TodoWrite' AND k % 5 = 0) AS total_parts FROM st GROUP BY traj_id"""))
def s40(spark, d):
    from catalog.sequence import tagged

    runs = event_runs(spark, d)
    return us.export_statistics(tagged(runs)[0], runs.parts)


@query("s33_label_sidecars", "SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS step_idx, 'debug' AS phase FROM orders WHERE o_custkey % 4 <> 0")
def s33(spark, d):
    step = F.struct(F.col("o_orderkey").alias("index"), F.lit("assistant").alias("role"), F.lit("debug").alias("phase"), F.lit("x").alias("action"))
    o = table(spark, d, "orders")
    text = F.to_json(F.struct(F.when(F.col("o_custkey") % 4 != 0, "v2").alias("taxonomy_version"), F.array(step).alias("steps")))
    docs = o.select(F.col("o_custkey").cast("string").alias("path"), text.alias("text"))
    return sc.parse_labels(docs).select("path", "step_idx", "phase")


@query("s34_manifest", "SELECT CAST(c_custkey AS VARCHAR) AS path, 't' || c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 'missing compared' END AS error FROM customer")
def s34(spark, d):
    n = F.col("c_custkey").cast("string")
    item = F.struct(F.concat(F.lit("t"), n).alias("task_id"), F.lit("a").alias("reference"), F.when(F.col("c_custkey") % 3 != 0, "b").alias("compared"))
    docs = table(spark, d, "customer").select(n.alias("path"), F.to_json(F.array(item)).alias("text"))
    return sc.parse_manifest(docs).select("path", "task_id", "error")


def diffs(spark, d):
    n = F.col("c_custkey").cast("string")
    one = F.concat(F.lit("diff --git a/x"), n, F.lit(".py b/x"), n, F.lit(".py\n--- a/x"), n, F.lit(".py\n+++ b/x"), n, F.lit(".py\n@@ -1 +1,2 @@\n ctx\n-old\n+new\n+more\n"))
    two = F.lit("diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-gone\n")
    return table(spark, d, "customer").select(n.alias("path"), F.concat(one, two).alias("text"))


@query("s35_anchor_files", "SELECT CAST(c_custkey AS VARCHAR) AS path, unnest(['x' || c_custkey || '.py', 'y.py']) AS file FROM customer")
def s35(spark, d):
    return diffs(spark, d).select("path", F.explode(sc.anchor_files(F.col("text"))).alias("file"))


@query("s36_diff_churn", """SELECT CAST(c_custkey AS VARCHAR) AS path, unnest([0, 1])::BIGINT AS file_no, unnest(['x' || c_custkey || '.py', 'y.py']) AS file, unnest([2, 0])::BIGINT AS additions, 1::BIGINT AS deletions, 1::BIGINT AS hunks, unnest([1, 0])::BIGINT AS context FROM customer""")
def s36(spark, d):
    return sc.diff_churn(diffs(spark, d))


@query("s30_shard_gaps", "SELECT o_custkey AS traj_id, count(*) AS shards, max(o_orderkey) AS last, max(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM orders GROUP BY 1")
def s30(spark, d):
    return sc.shard_gaps(table(spark, d, "orders").select(F.col("o_custkey").alias("traj_id"), F.concat(F.lit("messages_"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file")))


@query("s38_content_digest", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(min(doc_id) OVER (PARTITION BY text) AS VARCHAR) AS first_path, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def s38(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return logs.duplicates(docs).select(F.col("path").cast("string").alias("path"), "sha256", F.col("first_path").cast("string").alias("first_path"), "copies")


@query("s29_session_descendants", """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 8 > 0 THEN c_custkey - 1 END AS p FROM customer),
   t AS (SELECT id AS root, id AS session_id, 0::BIGINT AS depth FROM s WHERE p IS NULL UNION ALL SELECT t.root, s.id, t.depth + 1 FROM t JOIN s ON s.p = t.session_id) SELECT * FROM t""")
def s29(spark, d):
    c = F.col("c_custkey")
    return sc.session_tree(table(spark, d, "customer").select(c.alias("session_id"), F.when(c % 8 > 0, c - 1).alias("parent_id")))


@query("s39_sliced_report", events_sql(" SELECT traj_id, step_idx // 4096 AS slice, count(*) AS steps FROM st GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY traj_id, step_idx // 4096")))
def s39(spark, d):
    """Written to the report folder, committed, and read back."""
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    report = with_slice(event_runs(spark, d).steps).groupBy("traj_id", "slice").agg(F.count("*").alias("steps"))
    sc.commit_report(report, folder, "steps", kind="json")
    return sc.read_report(spark, folder, "steps")
