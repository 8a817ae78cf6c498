"""Token, timing, tool and agent metrics."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql, orders_sql
from runloom.functions import calls as fc, tokens as ft
from runloom.operators import metrics as m
from runloom.operators.slices import nearest_rank
from runloom.sources.bridges import chat_runs, event_runs, order_runs

R = 6  # digits kept of a mean of shares


def _nr(table: str, value: str, q: float, name: str, keys: str = "traj_id", where: str = "true") -> str:
    """Nearest rank by sorting, the plain way."""
    return f"""{name} AS (SELECT {keys}, max(v) FILTER (WHERE rn = greatest(1, CAST(ceil({q}::DOUBLE * n) AS BIGINT))) AS {name},
      (max(v) FILTER (WHERE rn = (n + 1) // 2) + max(v) FILTER (WHERE rn = (n + 2) // 2)) / 2.0::DOUBLE AS {name}_median
      FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn,
            count(*) OVER (PARTITION BY {keys}) AS n FROM {table} WHERE {where} AND {value} IS NOT NULL) GROUP BY {keys})"""


CALLX = """, cr AS (SELECT traj_id, step_idx, CASE WHEN tool_name = 'Task' THEN 0 ELSE t_end - t_start END AS tool_ms,
   CASE WHEN tool_name = 'Task' THEN t_end - t_start ELSE 0 END AS spawn_ms FROM calls),
 f AS (SELECT s.*, coalesce(tool_ms, 0) AS tool_ms, coalesce(spawn_ms, 0) AS spawn_ms,
   greatest(0, cents - coalesce(spawn_ms, 0)) AS rest_ms,
   least(coalesce(tool_ms, 0), greatest(0, cents - coalesce(spawn_ms, 0))) AS wait_ms,
   greatest(0, cents - coalesce(spawn_ms, 0)) - least(coalesce(tool_ms, 0), greatest(0, cents - coalesce(spawn_ms, 0))) AS gen_ms,
   CASE WHEN cents > 0 THEN cache_read / cents::DOUBLE END AS share
   FROM st s LEFT JOIN cr USING (traj_id, step_idx))"""


@query("p05_usable_token", """SELECT event_id, CASE WHEN v >= 0 THEN v END AS usable, coalesce(v, 0) AS finite
  FROM (SELECT event_id, CAST(floor(value) AS BIGINT) - 20 AS v FROM events)""")
def p05(spark, d):
    from runloom.sources.bridges import table

    value = F.floor("value").cast("bigint") - 20
    return table(spark, d, "events").select(
        "event_id", ft.usable(value).alias("usable"), ft.finite_or_zero(value).alias("finite")
    )


@query("p06_cache_share", """SELECT event_id, CASE WHEN total > 0 AND cached <= total THEN cached / total::DOUBLE END AS share
  FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS total, event_id % 40 AS cached FROM events)""")
def p06(spark, d):
    from runloom.sources.bridges import table

    total = F.floor("value").cast("bigint")
    return table(spark, d, "events").select("event_id", ft.cache_share(F.col("event_id") % 40, total).alias("share"))


_SEG = """WITH t AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS total, event_id % 50 AS inp, event_id % 31 AS outp,
   event_id % 7 AS rea, event_id % 90 AS cr, event_id % 11 AS cw FROM events),
 i AS (SELECT *, [inp + outp + rea + cr + cw, inp + outp + cr + cw, inp + outp + rea, inp + outp] AS implied FROM t),
 g AS (SELECT *, [abs(total - implied[1]), abs(total - implied[2]), abs(total - implied[3]), abs(total - implied[4])] AS gap FROM i),
 r AS (SELECT *, CASE WHEN total > 0 AND inp = 0 AND outp = 0 AND rea = 0 AND cr = 0 AND cw = 0 THEN 'total_only'
   WHEN gap[1] = list_min(gap) THEN 'fresh_disjoint' WHEN gap[2] = list_min(gap) THEN 'fresh_nested'
   WHEN gap[3] = list_min(gap) THEN 'cached_disjoint' ELSE 'cached_nested' END AS reading FROM g)
 SELECT event_id, reading, CASE WHEN reading = 'total_only' THEN total WHEN reading LIKE 'fresh%' THEN inp ELSE greatest(0, inp - cr) END AS fresh,
   cr AS cache_read, CASE WHEN reading LIKE 'fresh%' THEN cw ELSE 0 END AS cache_write,
   CASE WHEN reading LIKE '%nested' THEN greatest(0, outp - rea) ELSE outp END AS output, rea AS reasoning FROM r"""


@query("p07_token_segments", _SEG)
def p07(spark, d):
    from runloom.sources.bridges import table

    e = F.col("event_id")
    seg = ft.segments(F.floor(F.col("value") * 10), e % 50, e % 31, e % 7, e % 90, e % 11)
    return table(spark, d, "events").select("event_id", seg.alias("s")).select("event_id", "s.*")


@query("p08_fresh_input", events_sql("SELECT traj_id, step_idx, tok_input AS fresh FROM st"))
def p08(spark, d):
    return event_runs(spark, d).steps.select("traj_id", "step_idx", ft.step_segments()["fresh"].alias("fresh"))


@query("p09_missing_token_fields", """SELECT event_id, concat_ws(', ', CASE WHEN event_id % 2 = 0 THEN 'Total Tokens' END,
  CASE WHEN event_id % 3 = 0 THEN 'Input Tokens' END, CASE WHEN event_id % 5 = 0 THEN 'Output Tokens' END,
  CASE WHEN event_id % 7 = 0 THEN 'Cache Read' END, CASE WHEN event_id % 11 = 0 THEN 'Cache Write' END) AS missing FROM events""")
def p09(spark, d):
    from runloom.sources.bridges import table

    labels = {"Total Tokens": 2, "Input Tokens": 3, "Output Tokens": 5, "Cache Read": 7, "Cache Write": 11}
    reported = {label: F.when(F.col("event_id") % n != 0, F.col("event_id")) for label, n in labels.items()}
    return table(spark, d, "events").select("event_id", F.concat_ws(", ", ft.missing_fields(reported)).alias("missing"))


@query("p28_token_estimate", """SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS estimate
  FROM conversations""")
def p28(spark, d):
    from runloom.sources.bridges import table

    return table(spark, d, "conversations").select("conv_id", "turn", ft.estimate(F.col("text")).alias("estimate"))


@query("p29_window_limit", """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN (event_id + 1) * 1000 WHEN 1 THEN (event_id + 1) * 1000000
   WHEN 2 THEN event_id * 1000 + 200 ELSE NULL END AS BIGINT) AS window_limit FROM events""")
def p29(spark, d):
    from runloom.sources.bridges import table

    e = F.col("event_id")
    text = (
        F.when(e % 4 == 0, F.concat((e + 1).cast("string"), F.lit("k")))
        .when(e % 4 == 1, F.concat((e + 1).cast("string"), F.lit("M")))
        .when(e % 4 == 2, F.concat(e.cast("string"), F.lit(",200")))
        .otherwise("unknown")
    )
    return table(spark, d, "events").select("event_id", ft.window_limit(text).alias("window_limit"))


@query("a01_usable_token_sums", events_sql("""SELECT traj_id, CAST(sum(cents) AS BIGINT) AS total_tokens, CAST(sum(tok_input) AS BIGINT) AS input_tokens,
  CAST(sum(tok_output) AS BIGINT) AS output_tokens, 0::BIGINT AS reasoning_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read_tokens,
  0::BIGINT AS cache_write_tokens, 0::BIGINT AS total_unusable, 0::BIGINT AS input_unusable, 0::BIGINT AS output_unusable,
  0::BIGINT AS reasoning_unusable, 0::BIGINT AS cache_read_unusable, 0::BIGINT AS cache_write_unusable FROM st GROUP BY traj_id"""))
def a01(spark, d):
    return m.usable_token_sums(event_runs(spark, d, indexed=False).steps)


@query("a02_nearest_rank", "WITH " + _nr("events", "value", 0.95, "p95", "user_id") + "," + _nr("events", "value", 0.9, "p90", "user_id")
       + " SELECT user_id, p90, p95, p90_median AS median FROM p90 JOIN p95 USING (user_id)")
def a02(spark, d):
    from runloom.sources.bridges import table

    return nearest_rank(table(spark, d, "events"), ["user_id"], F.col("value"), {"p90": 0.9, "p95": 0.95}, "median")


@query("a03_duration_stats", events_sql("," + _nr("st", "duration", 0.95, "p95_duration") + """
  SELECT traj_id, count(*) AS total_steps, sum(cents) / 1000.0::DOUBLE AS total_duration, (sum(cents) / 1000.0::DOUBLE) / count(*) AS avg_duration,
  max(duration) AS max_duration, any_value(p95_duration) AS p95_duration, any_value(p95_duration_median) AS median_duration
  FROM st JOIN p95_duration USING (traj_id) GROUP BY traj_id"""))
def a03(spark, d):
    return m.duration_stats(event_runs(spark, d, indexed=False).steps)


@query("a04_wall_clock", events_sql("""SELECT traj_id, CASE WHEN max(completed) > min(created) THEN (max(completed) - min(created)) / 1000.0::DOUBLE
  ELSE sum(cents) / 1000.0::DOUBLE END AS wall_clock FROM st GROUP BY traj_id"""))
def a04(spark, d):
    return m.wall_clock(event_runs(spark, d, indexed=False).steps)


@query("a05_token_stats", events_sql("," + _nr("st", "cents", 0.95, "p95_step_tokens", where="NOT is_user") + ","
       + _nr("st", "(cents / duration)", 0.5, "sp", where="NOT is_user AND cents > 0") + f"""
  SELECT traj_id, CAST(sum(cents) AS BIGINT) AS total_tokens, CAST(sum(tok_input) AS BIGINT) AS input_tokens,
   CAST(sum(tok_output) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read_tokens,
   count(*) AS steps, count(*) FILTER (NOT is_user) AS assistant_steps, count(*) FILTER (is_user) AS user_steps,
   CAST(sum(tok_input) AS BIGINT) AS fresh_tokens, 0::BIGINT AS cache_unusable_steps,
   round(avg(cache_read / cents::DOUBLE) FILTER (NOT is_user AND cents > 0), {R}) AS avg_cache_ratio,
   count(*) FILTER (NOT is_user AND cents > 0 AND cache_read / cents::DOUBLE >= 0.9) AS cache_dominant_steps,
   any_value(p95_step_tokens) AS p95_step_tokens, any_value(p95_step_tokens_median) AS median_step_tokens,
   any_value(sp_median) AS median_tokens_per_second,
   CASE WHEN sum(cents) > 0 THEN sum(tok_input) / sum(cents)::DOUBLE ELSE 0 END AS fresh_ratio,
   sum(cents)::DOUBLE / count(*) AS avg_tokens_per_step,
   CASE WHEN count(*) FILTER (NOT is_user) > 0 THEN sum(cents)::DOUBLE / count(*) FILTER (NOT is_user) END AS avg_tokens_per_assistant_step,
   CASE WHEN sum(cents) > 0 THEN sum(cents)::DOUBLE / (sum(cents) / 1000.0::DOUBLE) END AS tokens_per_second,
   CASE WHEN sum(tok_input) > 0 THEN sum(tok_output)::DOUBLE / sum(tok_input) END AS output_input_ratio
  FROM st LEFT JOIN p95_step_tokens USING (traj_id) LEFT JOIN sp USING (traj_id) GROUP BY traj_id"""))
def a05(spark, d):
    out = m.token_stats(event_runs(spark, d, indexed=False).steps)
    drop = [c for c in out.columns if c.endswith("_unusable") or c in ("reasoning_tokens", "cache_write_tokens", "seconds")]
    return out.withColumn("avg_cache_ratio", F.round("avg_cache_ratio", R)).drop(*drop)


@query("a06_tool_stats", events_sql(CALLX + "," + _nr("cr", "tool_ms", 0.95, "p95", where="spawn_ms = 0") + """,
  names AS (SELECT traj_id, count(*) AS n, count(*) FILTER (failed) AS fails, count(*) FILTER (tool_name <> 'Task') AS timed,
    count(*) FILTER (tool_name = 'Task') AS spawns FROM calls GROUP BY traj_id),
  mx AS (SELECT traj_id, max(t_end - t_start) AS mx FROM calls WHERE tool_name <> 'Task' GROUP BY traj_id),
  p AS (SELECT traj_id, max(v) FILTER (WHERE rn = greatest(1, CAST(ceil(0.95::DOUBLE * n) AS BIGINT))) AS p95 FROM (
     SELECT traj_id, t_end - t_start AS v, row_number() OVER (PARTITION BY traj_id ORDER BY t_end - t_start) AS rn, count(*) OVER (PARTITION BY traj_id) AS n
     FROM calls WHERE tool_name <> 'Task') GROUP BY traj_id)
  SELECT traj_id, coalesce(n, 0) AS tool_calls, coalesce(n - fails, 0) AS tool_success, coalesce(fails, 0) AS tool_fail,
   (n - fails) / n::DOUBLE AS tool_success_rate, tok / n::DOUBLE AS tokens_per_tool,
   CASE WHEN timed > 0 THEN tool_s END AS tool_time_total, CASE WHEN timed > 0 AND wall > 0 THEN tool_s / wall END AS tool_wait_share,
   CASE WHEN timed > 0 THEN tool_s / timed END AS avg_tool_duration, p.p95 / 1000.0::DOUBLE AS p95_tool_duration, mx / 1000.0::DOUBLE AS max_tool_duration,
   CASE WHEN spawns > 0 THEN spawn_s END AS delegation_time_total, coalesce(spawns, 0) AS delegated_calls,
   0::BIGINT AS multi_tool_steps, no_tool AS no_tool_steps, patches AS patch_steps,
   CASE WHEN wall > 0 THEN coalesce(n, 0) / (wall / 60) END AS tool_calls_per_min
  FROM (SELECT traj_id, sum(tool_ms) / 1000.0::DOUBLE AS tool_s, sum(spawn_ms) / 1000.0::DOUBLE AS spawn_s, CAST(sum(cents) AS BIGINT) AS tok,
     count(*) FILTER (NOT is_user AND tool_name IS NULL) AS no_tool, count(*) FILTER (event_type = 'purchase' AND k % 3 = 0) AS patches,
     CASE WHEN max(completed) > min(created) THEN (max(completed) - min(created)) / 1000.0::DOUBLE ELSE sum(cents) / 1000.0::DOUBLE END AS wall
     FROM f GROUP BY traj_id) LEFT JOIN names USING (traj_id) LEFT JOIN mx USING (traj_id) LEFT JOIN p USING (traj_id)"""))
def a06(spark, d):
    runs = event_runs(spark, d)
    return m.tool_stats(runs.steps, runs.calls, runs.parts)


@query("a06_tool_breakdown", events_sql("""SELECT traj_id, 'tool' AS kind, tool_name AS name, count(*) AS calls FROM calls GROUP BY ALL
  UNION ALL SELECT traj_id, 'status', CASE WHEN failed THEN 'error' ELSE 'completed' END, count(*) FROM calls GROUP BY ALL"""))
def a06b(spark, d):
    return m.tool_breakdown(event_runs(spark, d, indexed=False).calls)


@query("a07_efficiency", events_sql("," + ",".join(
    _nr("st", "duration", q, n, where="NOT is_user") for q, n in ((0.5, "p50_duration"), (0.9, "p90_duration"), (0.99, "p99_duration"))) + """
  SELECT traj_id, count(*) FILTER (is_user) AS user_turns, count(*) FILTER (NOT is_user) AS assistant_turns,
   count(*) FILTER (NOT is_user) / count(*)::DOUBLE AS autonomy_ratio, any_value(p50_duration) AS p50_duration,
   any_value(p90_duration) AS p90_duration, any_value(p99_duration) AS p99_duration
  FROM st LEFT JOIN p50_duration USING (traj_id) LEFT JOIN p90_duration USING (traj_id) LEFT JOIN p99_duration USING (traj_id) GROUP BY traj_id"""))
def a07(spark, d):
    return m.efficiency_stats(event_runs(spark, d, indexed=False).steps)


@query("a07_breakdowns", events_sql("""SELECT traj_id, kind, name, count(*) AS n FROM (
  SELECT traj_id, 'role' AS kind, role AS name FROM st UNION ALL SELECT traj_id, 'agent', eff_agent FROM st WHERE eff_agent <> ''
  UNION ALL SELECT traj_id, 'model', model_id FROM st WHERE model_id <> '' UNION ALL SELECT traj_id, 'finish', finish FROM st
  UNION ALL SELECT traj_id, 'part', 'text' FROM st UNION ALL SELECT traj_id, 'part', 'reasoning' FROM st WHERE NOT is_user AND k % 4 = 0
  UNION ALL SELECT traj_id, 'part', 'tool_call' FROM calls UNION ALL SELECT traj_id, 'part', 'patch' FROM st WHERE event_type = 'purchase' AND k % 3 = 0
  UNION ALL SELECT traj_id, 'part', 'snapshot' FROM st WHERE tool_name = 'TodoWrite' AND k % 5 = 0) GROUP BY ALL"""))
def a07b(spark, d):
    runs = event_runs(spark, d, indexed=False)
    return m.breakdowns(runs.steps, runs.parts)


@query("a08_command_metrics", events_sql("""SELECT traj_id, count(*) AS commands, count(*) FILTER (coalesce(exit_code, 0) <> 0) AS command_failures,
  (count(*) - count(*) FILTER (coalesce(exit_code, 0) <> 0)) / count(*)::DOUBLE AS command_success_rate FROM calls WHERE exit_present GROUP BY traj_id"""))
def a08(spark, d):
    return m.command_metrics(event_runs(spark, d, indexed=False).calls)


@query("a09_response_latency", events_sql("""SELECT traj_id,
  (arg_min(completed, step_idx) FILTER (NOT is_user) - arg_min(created, step_idx) FILTER (is_user)) / 1000.0::DOUBLE AS first_response_s,
  (arg_max(completed, step_idx) FILTER (NOT is_user) - arg_min(created, step_idx) FILTER (is_user)) / 1000.0::DOUBLE AS full_response_s
  FROM st GROUP BY traj_id"""))
def a09(spark, d):
    return m.response_latency(event_runs(spark, d).steps)


@query("a10_throughput", events_sql(CALLX + """ SELECT traj_id,
  CASE WHEN sum(gen_ms) FILTER (t) > 0 AND sum(tok_output) FILTER (t) > 0 THEN sum(tok_output) FILTER (t)::DOUBLE / (sum(gen_ms) FILTER (t) / 1000.0::DOUBLE) END AS output_tokens_per_sec,
  count(*) FILTER (t) AS timed_steps, count(*) FILTER (NOT is_user) AS assistant_steps,
  CASE WHEN count(*) FILTER (NOT is_user) > 0 THEN count(*) FILTER (t) / (count(*) FILTER (NOT is_user))::DOUBLE END AS timed_coverage,
  count(*) FILTER (t) < count(*) FILTER (NOT is_user) AS timing_incomplete,
  CAST(coalesce(sum(tok_output) FILTER (t), 0) AS BIGINT) AS timed_tokens, coalesce(sum(gen_ms) FILTER (t) / 1000.0::DOUBLE, 0) AS timed_seconds,
  coalesce(sum(wait_ms) FILTER (t) / 1000.0::DOUBLE, 0) AS tool_wait_seconds
  FROM (SELECT *, NOT is_user AND cents > 0 AND gen_ms > 0 AS t FROM f) GROUP BY traj_id"""))
def a10(spark, d):
    runs = event_runs(spark, d)
    return m.throughput(runs.steps, runs.calls)


@query("a11_plan_snapshots", events_sql("""SELECT traj_id, 2::BIGINT AS plan_items,
  CASE WHEN arg_max(k, step_idx) % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS plan_completion_ratio, count(*) AS plan_updates
  FROM st WHERE tool_name = 'TodoWrite' AND k % 5 = 0 GROUP BY traj_id"""))
def a11(spark, d):
    return m.plan_snapshot_metrics(event_runs(spark, d).parts)


@query("a12_message_metrics", events_sql(CALLX + """ SELECT traj_id, step_idx, role, eff_agent AS agent, model_id, finish, duration, cents AS tokens_total,
  tok_input AS tokens_input, tok_output AS tokens_output, cache_read, tok_input AS fresh_tokens, share AS cache_ratio,
  CASE WHEN cents > 0 THEN cents / duration END AS tokens_per_sec, CASE WHEN cents > 0 THEN tok_input / duration END AS fresh_per_sec,
  CASE WHEN tok_input > 0 THEN tok_output / tok_input::DOUBLE END AS output_input_ratio,
  CASE WHEN tool_name IS NULL THEN 0 ELSE 1 END::BIGINT AS tool_calls, CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS errors,
  tool_ms / 1000.0::DOUBLE AS tool_time_s, CASE WHEN cents > 0 THEN (tool_ms / 1000.0::DOUBLE) / duration ELSE 0 END AS tool_time_share,
  CASE WHEN NOT is_user AND k % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS reasoning_parts, 1::BIGINT AS text_parts,
  CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS patch_parts FROM f"""))
def a12(spark, d):
    runs = event_runs(spark, d)
    return m.message_metrics(runs.steps, runs.calls, runs.parts)


@query("a13_step_analytics", events_sql(CALLX + """ SELECT traj_id, step_idx, role, agent, model_id, duration AS duration_s, tool_ms::DOUBLE AS tool_time_ms,
  CASE WHEN cents > 0 THEN (tool_ms / 1000.0::DOUBLE) / duration END AS tool_time_share, cents AS tok_total,
  CASE WHEN cents > 0 THEN cents / duration END AS tok_per_s, share AS cache_ratio, tok_input AS fresh_tok,
  CASE WHEN tok_input > 0 THEN tok_output / tok_input::DOUBLE END AS out_in_ratio,
  CASE WHEN tool_name IS NULL THEN 0 ELSE 1 END::BIGINT AS tool_calls, finish,
  concat_ws(',', CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'patch' END, CASE WHEN NOT is_user AND k % 4 = 0 THEN 'reasoning' END,
    CASE WHEN tool_name = 'TodoWrite' AND k % 5 = 0 THEN 'snapshot' END, 'text', CASE WHEN tool_name IS NOT NULL THEN 'tool_call' END) AS part_mix,
  (created - lag(completed) OVER (PARTITION BY traj_id ORDER BY step_idx)) / 1000.0::DOUBLE AS idle_before_s FROM f"""))
def a13(spark, d):
    runs = event_runs(spark, d)
    return m.step_analytics(runs.steps, runs.calls, runs.parts)


_OSPLIT = """, w AS (SELECT *, max(t_end) OVER (PARTITION BY traj_id, step_idx ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
    FROM ocalls WHERE tool_name <> 'Task'),
  isl AS (SELECT *, sum(CASE WHEN upto IS NULL OR t_start > upto THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id, step_idx ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS g FROM w),
  u AS (SELECT traj_id, step_idx, sum(span) AS tool_ms FROM (SELECT traj_id, step_idx, g, max(t_end) - min(t_start) AS span FROM isl GROUP BY ALL) GROUP BY ALL),
  sp AS (SELECT traj_id, step_idx, max(t_end - t_start) AS spawn_ms FROM ocalls WHERE tool_name = 'Task' GROUP BY ALL),
  os AS (SELECT traj_id, step_idx, dur, coalesce(tool_ms, 0)::DOUBLE AS tool_ms, coalesce(spawn_ms, 0)::DOUBLE AS spawn_ms,
     greatest(0.0::DOUBLE, dur * 1000 - coalesce(spawn_ms, 0)) AS rest FROM ost LEFT JOIN u USING (traj_id, step_idx) LEFT JOIN sp USING (traj_id, step_idx))"""


@query("a14_spawn_wait", orders_sql(_OSPLIT + """ SELECT traj_id, step_idx, spawn_ms / 1000 AS spawn_wait_s, rest / 1000 AS duration_excl_spawn_s FROM os"""))
def a14(spark, d):
    runs = order_runs(spark, d, positions=False)
    return m.step_time_split(runs.steps, runs.calls).select("traj_id", "step_idx", "spawn_wait_s", "duration_excl_spawn_s")


@query("a15_tool_interval_union", orders_sql(_OSPLIT + " SELECT traj_id, step_idx, tool_ms / 1000 AS tool_s FROM os"))
def a15(spark, d):
    runs = order_runs(spark, d, positions=False)
    return m.step_time_split(runs.steps, runs.calls).select("traj_id", "step_idx", "tool_s")


@query("a16_generation_seconds", orders_sql(_OSPLIT + """ SELECT traj_id, step_idx, (rest - least(tool_ms, rest)) / 1000 AS generation_s,
  least(tool_ms, rest) / 1000 AS tool_wait_s FROM os"""))
def a16(spark, d):
    runs = order_runs(spark, d, positions=False)
    return m.step_time_split(runs.steps, runs.calls).select("traj_id", "step_idx", "generation_s", "tool_wait_s")


@query("a17_edit_precision", events_sql("""SELECT traj_id, count(*) FILTER (failed) AS failed_calls, count(*) FILTER (tool_name = 'Edit') AS edits,
  count(*) FILTER (tool_name = 'Edit' AND NOT failed) AS edit_success,
  CASE WHEN count(*) FILTER (tool_name = 'Edit') > 0 THEN count(*) FILTER (tool_name = 'Edit' AND NOT failed) / (count(*) FILTER (tool_name = 'Edit'))::DOUBLE END AS edit_precision
  FROM calls GROUP BY traj_id"""))
def a17(spark, d):
    return m.edit_precision(event_runs(spark, d, indexed=False).calls)


_CARD = f"""SELECT traj_id, count(*) AS steps, CAST(sum(cents) AS BIGINT) AS total_tokens,
   round(avg(share) FILTER (NOT is_user AND cents > 0), {R}) AS avg_cache_ratio, count(tool_name) AS tool_calls, count(*) FILTER (failed) AS tool_fail,
   CASE WHEN count(tool_name) > 0 THEN (count(tool_name) - count(*) FILTER (failed)) / count(tool_name)::DOUBLE END AS tool_success_rate,
   CASE WHEN max(completed) > min(created) THEN (max(completed) - min(created)) / 1000.0::DOUBLE ELSE sum(cents) / 1000.0::DOUBLE END AS wall_clock,
   CASE WHEN sum(gen_ms) FILTER (t) > 0 AND sum(tok_output) FILTER (t) > 0 THEN sum(tok_output) FILTER (t)::DOUBLE / (sum(gen_ms) FILTER (t) / 1000.0::DOUBLE) END AS output_tokens_per_sec
   FROM (SELECT *, NOT is_user AND cents > 0 AND gen_ms > 0 AS t FROM f) GROUP BY traj_id"""


@query("run_scorecard", events_sql(CALLX + " " + _CARD))
def run_scorecard(spark, d):
    runs = event_runs(spark, d)
    return m.scorecard(runs.steps, runs.calls).withColumn("avg_cache_ratio", F.round("avg_cache_ratio", R))


@query("a18_health_verdicts", events_sql(CALLX + ", card AS (" + _CARD + """) SELECT traj_id, metric, status FROM (
  SELECT traj_id, 'Cache Efficiency' AS metric, CASE WHEN total_tokens = 0 THEN 'good' WHEN avg_cache_ratio IS NULL THEN 'warn'
    WHEN round(avg_cache_ratio * 100, 1) >= 60 THEN 'good' WHEN round(avg_cache_ratio * 100, 1) >= 30 THEN 'warn' ELSE 'bad' END AS status FROM card
  UNION ALL SELECT traj_id, 'Tool Success', CASE WHEN tool_calls = 0 THEN 'good' WHEN round(tool_success_rate * 100, 1) >= 95 THEN 'good'
    WHEN round(tool_success_rate * 100, 1) >= 80 THEN 'warn' ELSE 'bad' END FROM card
  UNION ALL SELECT traj_id, 'Throughput', CASE WHEN output_tokens_per_sec IS NULL THEN 'good' WHEN round(output_tokens_per_sec, 1) >= 50 THEN 'good'
    WHEN round(output_tokens_per_sec, 1) >= 20 THEN 'warn' ELSE 'bad' END FROM card
  UNION ALL SELECT traj_id, 'Errors', CASE WHEN tool_fail = 0 THEN 'good' WHEN tool_fail <= 2 THEN 'warn' ELSE 'bad' END FROM card)"""))
def a18(spark, d):
    runs = event_runs(spark, d, indexed=True)
    return m.health_verdicts(m.scorecard(runs.steps, runs.calls))


@query("a19_agent_info", events_sql("""SELECT traj_id, coalesce(arg_max(model_id, step_idx) FILTER (NOT is_user AND model_id <> ''), '') AS model_id,
  CASE WHEN count(*) FILTER (NOT is_user AND model_id <> '') > 0 THEN 'vendor' ELSE '' END AS provider_id,
  coalesce(arg_min(agent, step_idx) FILTER (NOT is_user AND model_id <> '' AND agent <> ''), arg_min(agent, step_idx) FILTER (agent <> ''), '') AS agent_id
  FROM st GROUP BY traj_id"""))
def a19(spark, d):
    return m.agent_info(event_runs(spark, d).steps)


_AGENT = """SELECT traj_id, eff_agent AS agent_id, CAST(sum(cents) AS BIGINT) AS total_tokens, CAST(sum(tok_input) AS BIGINT) AS input_tokens,
  CAST(sum(tok_output) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read_tokens, count(*) AS steps,
  sum(cents) / 1000.0::DOUBLE AS seconds, count(tool_name) AS tool_calls, count(*) FILTER (failed) AS errors, min(step_idx) AS first_step,
  CASE WHEN sum(cents) > 0 THEN sum(cache_read)::DOUBLE / sum(cents) END AS cache_share,
  CASE WHEN sum(cents) > 0 THEN sum(cents)::DOUBLE / (sum(cents) / 1000.0::DOUBLE) ELSE 0 END AS tokens_per_second
  FROM st WHERE NOT is_user GROUP BY ALL"""


@query("a20_agent_summary", events_sql(_AGENT))
def a20(spark, d):
    out = m.agent_summary(event_runs(spark, d).steps)
    return out.drop(*[c for c in out.columns if c.endswith("_unusable")], "reasoning_tokens", "cache_write_tokens")


@query("a21_agent_insights", events_sql(", ag AS (" + _AGENT + """), t AS (SELECT *, count(*) OVER w AS agents, sum(total_tokens) OVER w AS tok, sum(tool_calls) OVER w AS tc
   FROM ag WINDOW w AS (PARTITION BY traj_id))
  SELECT traj_id, agent_id, insight, value FROM (
   SELECT *, 'token_share' AS insight, total_tokens::DOUBLE / tok AS value, total_tokens::DOUBLE / tok > 0.6 AS hit FROM t WHERE tok > 0
   UNION ALL SELECT *, 'no_cache', 0.0, cache_share = 0 AND total_tokens > 0 AND cache_read_tokens = 0 FROM t
   UNION ALL SELECT *, 'error_rate', errors::DOUBLE / steps, errors::DOUBLE / steps > 0.1 FROM t
   UNION ALL SELECT *, 'call_share', tool_calls::DOUBLE / greatest(1, tc), tool_calls::DOUBLE / greatest(1, tc) > 0.7 FROM t)
  WHERE agents > 1 AND tok > 0 AND hit"""))
def a21(spark, d):
    return m.agent_insights(m.agent_summary(event_runs(spark, d).steps))


@query("j03_agent_spawn_step", events_sql("""SELECT a.traj_id, a.agent_id, a.first_step, c.step_idx AS spawned_by_step FROM (
   SELECT traj_id, eff_agent AS agent_id, min(step_idx) AS first_step FROM st WHERE NOT is_user GROUP BY ALL) a
   LEFT JOIN (SELECT traj_id, 'sub' || (k % 3) AS agent_id, min(event_id) AS event_id FROM calls WHERE tool_name = 'Task' GROUP BY ALL) s USING (traj_id, agent_id)
   LEFT JOIN calls c ON c.traj_id = a.traj_id AND c.event_id = s.event_id"""))
def j03(spark, d):
    from runloom.sources.bridges import event_rows

    runs = event_runs(spark, d)
    spawns = (
        event_rows(spark, d, indexed=False).filter("tool_name = 'Task'")
        .groupBy("traj_id", F.concat(F.lit("sub"), (F.col("k") % 3).cast("string")).alias("agent_id"))
        .agg(F.concat(F.lit("call-"), F.min("event_id").cast("string")).alias("spawned_by"))
    )
    return m.agent_summary(runs.steps, spawns, runs.calls).select("traj_id", "agent_id", "first_step", "spawned_by_step")


@query("p14_call_failed", events_sql("SELECT traj_id, step_idx, failed FROM calls"))
def p14(spark, d):
    return event_runs(spark, d).calls.select("traj_id", "step_idx", fc.failed().alias("failed"))


@query("p18_call_durations", orders_sql("""SELECT traj_id, step_idx, call_pos, (t_end - t_start)::DOUBLE AS duration_ms,
  CASE WHEN tool_name <> 'Task' THEN (t_end - t_start)::DOUBLE END AS stats_ms, tool_name = 'Task' AS is_spawn, t_start AS win_start, t_end AS win_end FROM ocalls"""))
def p18(spark, d):
    from runloom import vocab

    return order_runs(spark, d).calls.select(
        "traj_id", "step_idx", "call_pos", fc.duration_ms().alias("duration_ms"), fc.stats_duration_ms().alias("stats_ms"),
        fc.is_tool(vocab.SPAWN_TOOLS).alias("is_spawn"), fc.window_ms()["start"].alias("win_start"), fc.window_ms()["end"].alias("win_end"),
    )


@query("p02_part_mix_chat", """SELECT conv_id AS traj_id, turn AS step_idx, 'text' AS part_mix, 1::BIGINT AS text_parts FROM conversations""")
def p02c(spark, d):
    return m.part_counts(chat_runs(spark, d).parts).select("traj_id", "step_idx", "part_mix", "text_parts")
