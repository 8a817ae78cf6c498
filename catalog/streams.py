"""Event-stream sources over the events table."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.operators.slices import with_slice
from runloom.sources import event_streams as es
from runloom.sources.bridges import event_rows


def stream(spark, d):
    k = F.col("k")
    kind = F.when(k % 20 == 4, "complete").when(k % 5 < 2, "message").when(k % 5 == 2, "reasoning").otherwise("call")
    rows = with_slice(event_rows(spark, d))
    return rows.select("traj_id", "slice", F.col("step_idx").alias("line_no"), kind.alias("kind"), F.when(k % 5 == 0, "user").otherwise("assistant").alias("role"))


@query("s20_turns", events_sql(""", sm AS (SELECT traj_id, step_idx, CASE WHEN k % 20 = 4 THEN 'complete' WHEN k % 5 < 2 THEN 'message' WHEN k % 5 = 2 THEN 'reasoning' ELSE 'call' END AS kind, CASE WHEN k % 5 = 0 THEN 'user' ELSE 'assistant' END AS role FROM st),
  s1 AS (SELECT *, coalesce(sum(CASE WHEN kind = 'complete' THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, CASE WHEN kind = 'message' THEN role WHEN kind = 'call' THEN 'assistant' END AS own FROM sm),
  s2 AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY traj_id, seg ORDER BY step_idx ROWS UNBOUNDED PRECEDING), 'assistant') AS r FROM s1),
  s3 AS (SELECT *, CASE WHEN lag(r) OVER w IS NULL OR lag(r) OVER w <> r OR lag(seg) OVER w <> seg THEN 1 ELSE 0 END AS nw FROM s2 WHERE kind <> 'complete' WINDOW w AS (PARTITION BY traj_id ORDER BY step_idx)),
  s4 AS (SELECT *, sum(nw) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS part FROM s3),
  s5 AS (SELECT *, last_value(CASE WHEN kind IN ('call', 'reasoning') THEN kind END IGNORE NULLS) OVER (PARTITION BY traj_id, part ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS act FROM s4)
  SELECT traj_id, step_idx AS line_no, r AS turn_role, CAST(sum(CASE WHEN nw = 1 OR (kind = 'reasoning' AND r = 'assistant' AND act = 'call') THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM s5"""))
def s20(spark, d):
    return es.turns(stream(spark, d)).select("traj_id", "line_no", "turn_role", F.col("turn").cast("bigint").alias("turn"))


@query("s17_common_tool_names", events_sql("SELECT traj_id, step_idx, CASE tool_name WHEN 'Bash' THEN 'Bash' WHEN 'Edit' THEN 'Edit' ELSE coalesce(tool_name, '?') END AS tool_name FROM st"))
def s17(spark, d):
    spelled = F.when(F.col("tool_name") == "Bash", "Shell").when(F.col("tool_name") == "Edit", "StrReplace").otherwise(F.col("tool_name"))
    return event_rows(spark, d).select("traj_id", "step_idx", es.common_tool_name(spelled).alias("tool_name"))


@query("s26_own_human_events", events_sql("SELECT traj_id AS session_id, step_idx AS seq FROM st WHERE step_idx >= traj_id % 5 AND k % 3 < 2"))
def s26(spark, d):
    rows = event_rows(spark, d)
    headers = rows.select(F.col("traj_id").alias("session_id")).distinct().withColumn("seed_length", F.col("session_id") % 5)
    kind = F.when(F.col("k") % 3 == 0, "user").when(F.col("k") % 3 == 2, "plugin")
    messages = rows.select(F.col("traj_id").alias("session_id"), F.col("step_idx").alias("seq"), kind.alias("source_kind"))
    return es.human_messages(es.own_events(messages, headers)).select("session_id", "seq")


@query("s27_merged_children", """SELECT o_custkey // 10 AS traj_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY epoch_us(o_orderdate) // 1000 * 2 + CASE WHEN o_custkey % 10 > 0 THEN 1 ELSE 0 END, o_custkey, o_orderkey) - 1 AS step_idx FROM orders""")
def s27(spark, d):
    from runloom.sources.bridges import table

    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        F.floor(c / 10).cast("bigint").alias("traj_id"), c.alias("session_id"), F.col("o_orderkey").alias("pos"), (c % 10 > 0).alias("is_sub_agent"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time_created_ms"),
    )
    return es.merge_children(rows).select("traj_id", "pos", "step_idx")


