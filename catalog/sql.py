"""The bridged tables in DuckDB SQL: common table expressions every oracle starts from."""

EVENTS = r"""
ev AS (
  SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_idx,
         event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(floor(value * 100) AS BIGINT) AS cents, CAST(floor(value) AS BIGINT) AS whole,
         epoch_us(ts) // 1000 AS created
  FROM events),
base AS (
  SELECT *, event_type = 'signup' AND k % 2 = 0 AS is_user, event_type = 'error' AS failed,
    CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN NULL
         WHEN event_type = 'view' THEN CASE k % 3 WHEN 0 THEN 'Grep' WHEN 1 THEN 'Read' ELSE 'Glob' END
         WHEN event_type = 'click' THEN 'Bash' WHEN event_type = 'purchase' THEN 'Edit'
         WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'Bash' ELSE 'Edit' END
         WHEN k % 4 = 1 THEN 'TodoWrite' ELSE 'Task' END AS tool_name
  FROM ev),
st AS (
  SELECT traj_id, step_idx, event_id, event_type, k, cents, whole, failed, is_user, tool_name,
    CASE WHEN is_user THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN k % 10 = 9 THEN 'sub' || (k % 3) ELSE '' END AS agent,
    CASE WHEN is_user THEN '' WHEN k % 10 = 9 THEN 'sub' || (k % 3) ELSE '' END AS eff_agent,
    CASE WHEN is_user THEN '' WHEN traj_id % 4 = 0 THEN 'claude-large' WHEN traj_id % 4 = 1 THEN 'gpt-4o-mini'
         WHEN traj_id % 4 = 2 THEN 'other-model' ELSE '' END AS model_id,
    CASE WHEN k % 10 = 0 THEN 'stop' ELSE 'tool-calls' END AS finish,
    cents / 1000.0::DOUBLE AS duration, created, created + cents AS completed,
    cents AS tok_total, cents * 6 // 10 AS cache_read, cents * 3 // 10 AS tok_input,
    cents - cents * 6 // 10 - cents * 3 // 10 AS tok_output,
    event_type || ' ' || k AS preview,
    CASE WHEN tool_name = 'Bash' THEN CASE k % 4 WHEN 0 THEN 'pytest tests' WHEN 1 THEN 'cat ./src/m' || (k % 5) || '.py'
         WHEN 2 THEN 'grep -rn x ./src' ELSE 'git status' END END AS command,
    CASE WHEN tool_name IN ('Read', 'Edit') THEN 'src/m' || (k % 5) || '.py' END AS file_path,
    CASE WHEN tool_name IN ('Grep', 'Glob') THEN 'p' || (k % 5) END AS pattern,
    CASE WHEN tool_name IN ('Grep', 'Glob') THEN 'src' END AS path,
    CASE WHEN tool_name IN ('Grep', 'Glob') AND whole % 4 <> 0 THEN '' ELSE 'ok' END AS output,
    coalesce(tool_name = 'Bash', false) AS exit_present,
    CASE WHEN tool_name = 'Bash' THEN CASE WHEN failed THEN k % 3 WHEN k % 8 = 3 THEN NULL ELSE 0 END END AS exit_code,
    created AS t_start, created + cents // 2 AS t_end,
    CASE WHEN tool_name = 'Read' AND k % 6 = 1 THEN created + 600000 END AS compacted
  FROM base),
calls AS (SELECT * FROM st WHERE tool_name IS NOT NULL)
"""

ORDERS = r"""
ost AS (
  SELECT o_custkey AS traj_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step_idx,
         o_orderkey, epoch_ms(o_orderdate) AS created, CAST(floor(o_totalprice) AS BIGINT) AS tok_total,
         60 + o_orderkey % 60 AS dur
  FROM orders),
ocalls AS (
  SELECT traj_id, step_idx,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS call_pos,
    ['Read','Grep','Glob','Bash','Edit','Write','mcp__srv__run','Task'][CAST(l_partkey % 8 AS INTEGER) + 1] AS tool_name,
    l_returnflag = 'R' AS failed, created + l_linenumber * 1000 AS t_start,
    created + l_linenumber * 1000 + CAST(floor(l_quantity * 1000) AS BIGINT) AS t_end,
    '/w/p' || (l_suppkey % 7) || '.py' AS file_path
  FROM lineitem JOIN ost ON l_orderkey = o_orderkey)
"""


def events_sql(query: str) -> str:
    """``query`` may open with its own CTEs, written as ``, name AS (...) SELECT``."""
    return f"WITH RECURSIVE {EVENTS}\n{query}"


def orders_sql(query: str) -> str:
    return f"WITH RECURSIVE {ORDERS}\n{query}"
