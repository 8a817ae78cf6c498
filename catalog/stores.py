"""Session stores and shards made of the conversations, folder trees, quoted commands and alerts over the events."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import events_sql
from runloom.functions import calls as fc
from runloom.operators import commands
from runloom.plans import groups as g
from runloom.session import cut_lineage
from runloom.sources import stores as st
from runloom.sources.bridges import event_rows, event_runs, table
from runloom.streaming import alerts


def store(spark, d):
    """Sessions, messages and parts of the conversations: chains of eight; every third chain has no root, every third one an absent parent.

    The second message of every fifth conversation has a call that names the conversation seven further on.
    """
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    c = F.col("conv_id")
    name = lambda n: F.format_string("c%06d", n.cast("bigint"))
    first = F.when(F.floor(c / 8) % 3 == 1, "gone").when(F.floor(c / 8) % 3 == 2, name(c + 7))
    sessions = rows.select("conv_id").distinct().select(name(c).alias("session_id"), F.when(c % 8 > 0, name(c - 1)).otherwise(first).alias("parent_id"), F.concat(F.lit("chat "), c.cast("string")).alias("title"))
    message = F.format_string("m%06d.%03d", c.cast("bigint"), F.col("turn").cast("bigint"))
    messages = rows.select(message.alias("message_id"), name(c).alias("session_id"), (F.col("turn") * 1000 + c % 3).cast("bigint").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    said = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    named = F.to_json(F.struct(F.lit("tool").alias("type"), F.lit("Task").alias("tool"), F.struct(F.lit("completed").alias("status"), F.struct(name(c + 7).alias("sessionId")).alias("metadata")).alias("state")))
    both = F.when((c % 5 == 0) & (F.col("turn") == 1), F.array(said, named)).otherwise(F.array(said))
    parts = rows.select(message.alias("message_id"), F.posexplode(both).alias("i", "data")).select(F.concat("message_id", F.lit("p"), F.col("i").cast("string")).alias("part_id"), "message_id", F.col("i").cast("bigint").alias("time_created"), "data")
    return cut_lineage(sessions), cut_lineage(messages), cut_lineage(parts)


STORE = """WITH RECURSIVE cv AS (SELECT DISTINCT conv_id AS c FROM conversations),
 ss AS (SELECT c, CASE WHEN c % 8 > 0 THEN c - 1 WHEN c // 8 % 3 = 1 THEN -1 WHEN c // 8 % 3 = 2 THEN c + 7 END AS p FROM cv),
 ed AS (SELECT p AS a, c AS b, 1 AS own, 0 AS told FROM ss WHERE p IS NOT NULL UNION ALL SELECT conv_id, conv_id + 7, 0, 1 FROM conversations WHERE conv_id % 5 = 0 AND turn = 1),
 eg AS (SELECT a, b, CASE WHEN max(own) + max(told) = 2 THEN 'parent_id+tool_metadata' WHEN max(own) = 1 THEN 'parent_id' ELSE 'tool_metadata' END AS rel FROM ed GROUP BY a, b),
 rt AS (SELECT c FROM ss WHERE p IS NULL OR p NOT IN (SELECT c FROM cv) UNION SELECT c FROM ss WHERE c % 8 = 0 AND p = c + 7 AND (SELECT count(*) FROM cv x WHERE x.c // 8 = ss.c // 8) = 8),
 bf AS (SELECT c AS root, c AS s, 0::BIGINT AS depth, [c] AS path, 'root' AS rel, NULL::BIGINT AS via FROM rt
   UNION ALL SELECT bf.root, eg.b, bf.depth + 1, list_append(bf.path, eg.b), eg.rel, bf.s FROM bf JOIN eg ON eg.a = bf.s JOIN cv ON cv.c = eg.b WHERE NOT list_contains(bf.path, eg.b)),
 fd AS (SELECT root, s, min(depth) AS depth FROM bf GROUP BY root, s),
 pk AS (SELECT root, s, depth, rel, via FROM (SELECT bf.*, row_number() OVER (PARTITION BY root, s ORDER BY depth, path) AS n FROM bf) WHERE n = 1) """


@query("s29_store_sessions", STORE + "SELECT printf('c%06d', root) AS root, printf('c%06d', s) AS session_id, depth, rel AS discovered_by, CASE WHEN via IS NOT NULL THEN printf('c%06d', via) END AS traversal_parent_id, (SELECT count(*) FROM conversations v WHERE v.conv_id = pk.s) AS message_count FROM pk")
def s29_sessions(spark, d):
    sessions, messages, parts = store(spark, d)
    found, _ = st.descendants(st.roots(sessions), st.edges(sessions, messages, parts), sessions)
    return st.manifest(found, messages)


@query("s29_store_messages", STORE + """SELECT printf('c%06d', root) AS root, row_number() OVER (PARTITION BY root ORDER BY turn * 1000 + s % 3, o, printf('m%06d.%03d', s, turn)) - 1 AS step_idx, printf('m%06d.%03d', s, turn) AS message_id,
  depth > 0 AS is_sub_agent, CASE WHEN depth > 0 THEN coalesce(CASE WHEN ss.p = -1 THEN 'gone' WHEN ss.p IS NOT NULL THEN printf('c%06d', ss.p) END, printf('c%06d', via)) END AS parent_session_id, CASE WHEN s % 5 = 0 AND turn = 1 THEN 2 ELSE 1 END::BIGINT AS parts
  FROM pk JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations) v ON v.conv_id = pk.s JOIN ss ON ss.c = pk.s""")
def s29_messages(spark, d):
    sessions, messages, parts = store(spark, d)
    found, _ = st.descendants(st.roots(sessions), st.edges(sessions, messages, parts), sessions)
    rows = st.assemble(found, sessions, messages, parts)
    return rows.select("root", "step_idx", "message_id", "is_sub_agent", "parent_session_id", F.size("parts").cast("bigint").alias("parts"))


@query("s29_missing_sessions", STORE + "SELECT printf('c%06d', pk.root) AS root, printf('c%06d', eg.a) AS parent, printf('c%06d', eg.b) AS child, pk.depth + 1 AS depth FROM pk JOIN eg ON eg.a = pk.s WHERE eg.b NOT IN (SELECT c FROM cv)")
def s29_missing(spark, d):
    sessions, messages, parts = store(spark, d)
    return st.descendants(st.roots(sessions), st.edges(sessions, messages, parts), sessions)[1].drop("reason")


def shards(spark, d):
    """A turn is a shard file with its text, and once more with a mark for odd turns; odd conversations number their shards by twos."""
    c, t = F.col("conv_id"), F.col("turn")
    one = F.to_json(F.struct("text"))
    held = F.when(t % 2 == 1, F.concat(F.lit("["), one, F.lit(", "), F.to_json(F.struct(F.concat("text", F.lit("!")).alias("text"))), F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    return table(spark, d, "conversations").select(c.alias("traj_id"), F.concat(F.lit("messages_"), (t * (1 + c % 2)).cast("string"), F.lit(".json")).alias("file"), held.alias("text"))


@query("s30_merged_shards", "SELECT conv_id AS traj_id, turn * (1 + conv_id % 2) AS shard, CAST(b + i AS BIGINT) AS position, md5(CASE WHEN i = 1 THEN text || '!' ELSE text END) AS digest FROM (SELECT *, sum(1 + turn % 2) OVER (PARTITION BY conv_id ORDER BY turn) - 1 - turn % 2 AS b FROM conversations), (SELECT unnest([0, 1]) AS i) WHERE i <= turn % 2")
def s30_merged(spark, d):
    messages, _ = st.merge_shards(shards(spark, d))
    return messages.select("traj_id", "shard", F.col("position").cast("bigint").alias("position"), F.md5(F.get_json_object("message", "$.text")).alias("digest"))


@query("s30_missing_shards", "SELECT traj_id, prev + 1 AS first, shard - 1 AS last FROM (SELECT conv_id AS traj_id, turn * (1 + conv_id % 2) AS shard, coalesce(lag(turn * (1 + conv_id % 2)) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS prev FROM conversations) WHERE shard > prev + 1")
def s30_missing(spark, d):
    return st.merge_shards(shards(spark, d))[1]


def tree_cells(spark, d):
    """What every user's events read and wrote, below homes, drives and relative folders; groups of five users."""
    k, kind = F.col("k"), F.col("event_type")
    n = lambda m: (k % m).cast("string")
    path = (
        F.when(kind == "view", F.concat(F.lit("/home/ann/proj/src/m"), n(5), F.lit("/f"), n(3), F.lit(".py"))).when(kind == "click", F.concat(F.lit("src/m"), n(5), F.lit("/f"), n(3), F.lit(".py")))
        .when(kind == "purchase", F.concat(F.lit("/mnt/c/Users/bob/work/lib/l"), n(4), F.lit(".py"))).when(kind == "signup", F.concat(F.lit("lib/deep/d"), n(4), F.lit(".py")))
        .when(k % 3 == 0, F.concat(F.lit("/mnt/d/data/t"), n(2), F.lit(".csv"))).when(k % 3 == 1, F.concat(F.lit("docs/./r"), n(2), F.lit(".md"))).when(F.col("traj_id") % 10 < 5, "/home/ann/other/src/b.py").otherwise("top.md")
    )
    rows = event_rows(spark, d, indexed=False).select("traj_id", F.floor(F.col("traj_id") / 5).alias("group_id"), path.alias("path"), (k % 2).alias("w"))
    cells = rows.groupBy("group_id", "traj_id", "path").agg(F.count_if(F.col("w") == 0).alias("reads"), F.count_if(F.col("w") == 1).alias("writes"))
    return cells, rows.select("group_id", "traj_id").distinct()


TREE = """WITH ev AS (SELECT user_id AS t, user_id // 5 AS g, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events),
 ce AS (SELECT g, t, CASE WHEN event_type = 'view' THEN '/home/ann/proj/src/m' || k % 5 || '/f' || k % 3 || '.py' WHEN event_type = 'click' THEN 'src/m' || k % 5 || '/f' || k % 3 || '.py' WHEN event_type = 'purchase' THEN '/mnt/c/Users/bob/work/lib/l' || k % 4 || '.py'
   WHEN event_type = 'signup' THEN 'lib/deep/d' || k % 4 || '.py' WHEN k % 3 = 0 THEN '/mnt/d/data/t' || k % 2 || '.csv' WHEN k % 3 = 1 THEN 'docs/./r' || k % 2 || '.md' WHEN t % 10 < 5 THEN '/home/ann/other/src/b.py' ELSE 'top.md' END AS path,
   count(*) FILTER (k % 2 = 0) AS r, count(*) FILTER (k % 2 = 1) AS w FROM ev GROUP BY ALL),
 fi AS (SELECT g, path, sum(r) AS r, sum(w) AS w, count(*) FILTER (r > 0) AS readers, any_value(t) FILTER (r > 0) AS someone, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS p FROM ce GROUP BY g, path),
 ho AS (SELECT *, CASE WHEN path LIKE '/home/%' THEN 2 WHEN path LIKE '/mnt/c/%' THEN 4 WHEN path LIKE '/mnt/%' THEN 2 ELSE 0 END AS h FROM fi), re AS (SELECT *, p[h + 1:] AS rel FROM ho),
 ix AS (SELECT g, folder, any_value(up) AS up FROM (SELECT DISTINCT g, rel[i] AS folder, rel[1:i - 1] AS up FROM re, generate_series(1, 9) z(i) WHERE h > 0 AND i < len(rel)) GROUP BY g, folder HAVING count(*) = 1),
 sh AS (SELECT re.*, CASE WHEN h = 0 AND len(rel) > 1 AND ix.folder IS NOT NULL THEN list_concat(ix.up, rel) ELSE rel END AS shown FROM re LEFT JOIN ix ON ix.g = re.g AND ix.folder = rel[1]),
 sz AS (SELECT g, count(DISTINCT t) AS n FROM ev GROUP BY g), fo AS (SELECT sh.*, n, array_to_string(shown[1:i], '/') AS folder FROM sh JOIN sz USING (g), generate_series(1, 9) z(i) WHERE i < len(shown)) """


@query("n10_folder_tree", TREE + """SELECT g AS group_id, folder, count(*) AS files, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(w) AS BIGINT) AS writes, count(*) FILTER (n >= 2 AND readers = n) AS all_runs, count(*) FILTER (readers = 1 AND NOT (n >= 2 AND readers = n)) AS one_run,
   count(*) FILTER (NOT (n >= 2 AND readers = n) AND readers <> 1) AS other FROM fo GROUP BY g, folder""")
def n10_tree(spark, d):
    return g.folder_tree(*tree_cells(spark, d))


@query("n10_folder_readers", TREE + "SELECT g AS group_id, folder, someone AS traj_id, count(*) AS files FROM fo WHERE readers = 1 GROUP BY ALL")
def n10_readers(spark, d):
    return g.folder_readers(*tree_cells(spark, d))


@query("p22_quoted_commands", """SELECT event_id AS command_id, CASE event_id % 7 WHEN 0 THEN 'git' WHEN 1 THEN 'echo' WHEN 2 THEN 'rg' WHEN 3 THEN 'tool ' || event_type || '.py' WHEN 4 THEN event_type || '.run' WHEN 5 THEN 'open' ELSE 'make' END AS label, event_id % 7 IN (1, 2) AS searches FROM events""")
def p22_quoted(spark, d):
    e, kind = F.col("event_id"), F.col("event_type")
    line = (
        F.when(e % 7 == 0, F.concat(F.lit("cd 'my dir' && git commit -m \"fix; "), kind, F.lit(' | \\"ok\\""')))
        .when(e % 7 == 1, F.concat(F.lit('echo "'), kind, F.lit("; or\" | grep -n 'a b' src"))).when(e % 7 == 2, F.concat(F.lit("bash -lc \"cd x; rg '"), kind, F.lit(" bar'\"")))
        .when(e % 7 == 3, F.concat(F.lit("sudo -u 'the user' python 'tools/tool "), kind, F.lit(".py' --x"))).when(e % 7 == 4, F.concat(F.lit("sh -c 'python -m "), kind, F.lit(".run'")))
        .when(e % 7 == 5, F.concat(F.lit("open 'quote "), kind)).otherwise("A='b c' make -j")
    )
    return commands.labels(table(spark, d, "events").select(e.alias("command_id"), line.alias("command")))


@query("t05_alerts", events_sql(""", cl AS (SELECT traj_id, step_idx, failed OR coalesce(exit_code, 0) <> 0 AS bad FROM calls WHERE NOT is_user),
  i1 AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) - row_number() OVER (PARTITION BY traj_id, bad ORDER BY step_idx) AS island FROM cl),
  i2 AS (SELECT *, row_number() OVER (PARTITION BY traj_id, bad, island ORDER BY step_idx) AS nth, min(step_idx) OVER (PARTITION BY traj_id, bad, island) AS begun FROM i1),
  oc AS (SELECT traj_id, step_idx, cents, lag(cents) OVER (PARTITION BY traj_id ORDER BY step_idx) AS last FROM st WHERE NOT is_user AND cents > 0)
  SELECT traj_id, 'failure_chain' AS kind, step_idx, 0::BIGINT AS pos, 3::BIGINT AS value, begun AS before FROM i2 WHERE bad AND nth = 3
  UNION ALL SELECT traj_id, 'occupancy_drop', step_idx, -1, cents, last FROM oc WHERE cents < last * 0.7::DOUBLE"""))
def t05(spark, d):
    runs = event_runs(spark, d)
    return alerts.batch_alerts(alerts.watched(runs.steps, runs.calls, fc.failed()))
