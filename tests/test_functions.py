"""Expressions on single values, and sequence operators on tiny runs."""

import math

import pytest
from pyspark.sql import functions as F

from runloom.functions import calls as fc, paths, tokens as ft
from runloom.operators import metrics as m, pressure as pr, sequence as sq
from runloom.operators.slices import with_slice
from runloom.plans import batch
from runloom.schema import CALLS, PARTS, STEPS
from runloom.sources import logs
from runloom.sources.bridges import call_input, conform, token_struct


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize(
    "values",
    [(15304, 4, 300, 0, 0, 15000), (41410, 10, 400, 0, 40000, 1000), (100800, 100000, 800, 300, 96000, 0), (51350, 1000, 200, 150, 50000, 0), (11146, 10866, 216, 176, 64, 0)],
)
def test_segments_sum_to_total(spark, values):
    total, inp, out, rea, read, write = values
    s = one(spark, s=ft.segments(*[F.lit(v) for v in (total, inp, out, rea, read, write)])).s
    assert s.fresh + s.cache_read + s.cache_write + s.output + s.reasoning == total


@pytest.mark.parametrize(
    "line, label, searches",
    [("cd /x && npm test", "npm", False), ("env A=1 sudo -u me rg foo", "rg", True), ("python -m pytest -q", "pytest", False),
     ("python3 tools/run.py", "run.py", False), ("python -c pass", "python", False), ("git grep x", "git", True), ("cd /only", "cd", False)],
)
def test_shell_labels(spark, line, label, searches):
    r = one(spark, a=fc.primary_command(F.lit(line)), b=fc.runs_search(F.lit(line)))
    assert (r.a, r.b) == (label, searches)


@pytest.mark.parametrize("raw, clean", [("a/./b/../c", "a/c"), ("/../x", "/x"), ("", ""), ("C:\\w\\a.py", "/w/a.py"), ("a//b/", "a/b"), ("..", ".."), ("./", "."), ("//x", "//x")])
def test_paths(spark, raw, clean):
    assert one(spark, p=paths.target(F.lit(raw))).p == clean


def test_window_limit(spark):
    got = one(spark, a=ft.window_limit(F.lit("128k")), b=ft.window_limit(F.lit("1.2m")), c=ft.window_limit(F.lit("200,000")), d=ft.window_limit(F.lit("big")))
    assert tuple(got) == (128000, 1200000, 200000, None)


def test_sign_test(spark):
    p = lambda n, u, d: one(spark, p=batch.sign_test(F.lit(n), F.lit(u).cast("bigint"), F.lit(d).cast("bigint"))).p
    assert p(1, 1, 0) is None and p(4, 0, 0) == 1.0
    assert abs(p(8, 7, 1) - 2 * (1 + 8) / 256) < 1e-12 and p(6, 3, 3) == 1.0
    for up, down in ((40, 60), (500, 600), (0, 12), (900, 900)):
        exact = min(1.0, 2 * sum(math.comb(up + down, i) for i in range(min(up, down) + 1)) / 2 ** (up + down))
        assert abs(p(up + down, up, down) / exact - 1) < 1e-9
    # A hundred million pairs, one deviation from even: twice the normal tail.
    assert abs(p(10**8, 5 * 10**7 - 5_000, 5 * 10**7 + 5_000) - 0.3173) < 1e-3


def test_long_messages_that_differ_late_are_different_patterns(spark):
    long = "x" * 200
    df = spark.createDataFrame([(1, i, 0, "Bash", e) for i, e in enumerate([long + "a", long + "b", f"\n\t{long}a\nmore"])], "traj_id long, step_idx long, call_pos long, tool_name string, error string")
    rows = conform(with_slice(df), CALLS).select(fc.error_pattern().alias("p")).collect()
    assert {r.p for r in rows} == {long + "a", long + "b"}


def test_output_status_reads_the_whole_output(spark):
    from runloom.sources.exec_calls import output_status

    late = F.lit("fine " * 100 + "Error: late")
    none = F.lit(None).cast("int")
    got = one(spark, a=output_status(late, none), b=output_status(late, none, reach=200), c=output_status(late, F.lit(0)))
    assert tuple(got) == ("error", "success", "success")


def test_folders_leave_out_homes_and_drives(spark):
    from runloom.plans.groups import folder_rollup

    paths_ = ["/home/me/a/f", "/Users/me/a/g", "/mnt/c/Users/me/a/h", "/mnt/c/b/i", "/root/a/j", "//a/./k", "/home/me", "top"]
    cells = spark.createDataFrame([(1, 1, p, 1, 0) for p in paths_], "group_id long, traj_id long, path string, reads long, writes long")
    assert {(r.folder, r.files) for r in folder_rollup(cells).collect()} == {("a", 4), ("b", 1), ("root", 1), ("root/a", 1), ("home", 1)}


def test_baseline_pairs(spark):
    from runloom.plans.groups import baseline_pairs

    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 20, 0)], "group_id long, traj_id long, run_pos long")
    assert {(r.group_key, r.reference, r.compared) for r in baseline_pairs(members).collect()} == {("1|10|11", 10, 11), ("1|10|12", 10, 12)}


def calls_of(spark, rows):
    """rows: (step, tool, status, path, pattern, output)."""
    df = spark.createDataFrame([(1, s, 0, t, st, p, q, o) for s, t, st, p, q, o in rows], "traj_id long, step_idx long, call_pos long, tool_name string, status string, fp string, q string, output string")
    return conform(with_slice(df).withColumn("input", call_input(file_path=F.col("fp"), pattern=F.col("q"))), CALLS)


def steps_of(spark, n, **cols):
    df = with_slice(spark.range(n).select(F.lit(1).alias("traj_id"), F.col("id").alias("step_idx")))
    base = {"role": F.lit("assistant"), "agent": F.lit(""), "finish": F.lit(""), "tokens": token_struct(), "error_count": F.lit(0), "tool_call_count": F.lit(0)}
    return conform(df.withColumns({**base, **cols}), STEPS)


def test_edit_thrash_needs_a_failure(spark):
    good = calls_of(spark, [(i, "Edit", "completed", "a.py", None, "ok") for i in range(5)])
    assert sq.edit_thrash(good).count() == 0
    bad = calls_of(spark, [(0, "Edit", "error", "a.py", None, ""), (3, "Edit", "completed", "a.py", None, ""), (15, "Edit", "completed", "a.py", None, ""), (16, "Edit", "error", "a.py", None, "")])
    r = sq.edit_thrash(bad).first()
    assert (r["count"], r.fail_count, r.start_step, r.end_step) == (3, 1, 0, 15)


def test_repeated_search_skips_plain_streaks(spark):
    row = lambda i, q: (i, "Grep", "completed", None, q, "")
    assert sq.repeated_searches(calls_of(spark, [row(i, "x") for i in (1, 2, 3)])).count() == 0
    assert sq.repeated_searches(calls_of(spark, [row(i, "x") for i in (1, 2, 7)])).first()["count"] == 3


def test_tool_sequences_do_not_overlap_and_cross_pieces(spark):
    calls = calls_of(spark, [(i, "Read", "completed", None, None, "") for i in range(11)])
    for piece in (3, 4, 1000):
        got = {r.gram: r.frequency for r in sq.tool_sequences(calls, least=2, longest=3, piece=piece).collect()}
        assert got == {"Read > Read": 5, "Read > Read > Read": 3}


def test_parallel_calls_are_united(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 10_000), (1, 0, 1, 5_000, 12_000), (1, 0, 2, 20_000, 21_000)], "traj_id long, step_idx long, call_pos long, time_start long, time_end long")
    calls = conform(with_slice(df).withColumn("tool_name", F.lit("Bash")), CALLS)
    steps = steps_of(spark, 1, duration=F.lit(30.0))
    r = m.step_time_split(steps, calls).first()
    assert (r.tool_s, r.generation_s) == (13.0, 17.0)


def test_prompt_peak_wins_over_sums(spark):
    steps = steps_of(spark, 2, tokens=token_struct(total=F.lit(900), input=F.lit(900), prompt_peak=F.lit(400), prompt_peak_cache_read=F.lit(300)))
    r = pr.occupancy(steps).first()
    assert (r.fresh, r.cache_read, r.occupancy) == (100, 300, 400)


def test_line_scan_rules(spark):
    docs = spark.createDataFrame([("tail", '{"a":1}\n{"b'), ("ended", '{"a":1}\n{"b\n'), ("crlf", '{"a":1}\r\n\r\n{"b":2}\r\n')], "path string, text string")
    events, rejected = logs.parse_lines(docs)
    assert {(r.path, r.line_no) for r in events.collect()} == {("tail", 0), ("crlf", 0), ("crlf", 2)}
    assert [(r.path, r.line_no) for r in rejected.collect()] == [("ended", 2)]


def test_scan_documents_reads_files(spark, tmp_path):
    (tmp_path / "run.jsonl").write_bytes('﻿{"type": "session", "id": "a"}\n{"type": "tool/call"}\n'.encode())
    docs = logs.scan_documents(spark, str(tmp_path))
    events = logs.number_events(logs.parse_lines(docs)[0].withColumn("name", F.col("path")).withColumn("path", F.lit(1)))
    assert logs.event_format(events).first()["format"] == "dsh"


def test_metric_laws(spark):
    """Shares stay in range, successes and failures add up, the 95th percentile is at most the maximum."""
    from runloom.sources.bridges import event_runs

    runs = event_runs(spark, "/root/testdata/sf0.001")
    for r in m.tool_stats(runs.steps, runs.calls, runs.parts).collect():
        assert r.tool_success + r.tool_fail == r.tool_calls
        assert r.tool_success_rate is None or 0 <= r.tool_success_rate <= 1
        assert r.p95_tool_duration is None or r.p95_tool_duration <= r.max_tool_duration
    for r in m.throughput(runs.steps, runs.calls).collect():
        assert r.timed_steps <= r.assistant_steps


def test_parts_schema_is_complete():
    assert {"type", "text", "items", "files"} <= set(PARTS.names)


def test_white_space_of_any_kind_is_stripped(spark):
    from runloom.functions.paths import strip

    rows = spark.createDataFrame([("\n",), ("\t No results\r\n",), (None,)], "text string").select(strip(F.col("text")).alias("text")).collect()
    assert [r["text"] for r in rows] == ["", "No results", None]


def test_session_tree_of_any_depth_and_cycles(spark):
    from runloom.sources.sidecars import session_tree

    rows = [(i, i - 1 if i else None) for i in range(15)] + [(100, 101), (101, 100), (3, 14)]
    found = session_tree(spark.createDataFrame(rows, "session_id long, parent_id long")).collect()
    assert sorted((r["session_id"], r["depth"]) for r in found) == [(i, i) for i in range(15)]


def test_runs_without_issues_are_good(spark):
    from runloom.operators.issues import issue_kpi

    found = spark.createDataFrame([(1, "error")] * 3, "traj_id long, severity string")
    rows = {r["traj_id"]: r for r in issue_kpi(found, spark.createDataFrame([(1,), (2,)], "traj_id long")).collect()}
    assert rows[1]["status"] == "bad" and rows[2]["status"] == "good" and rows[2]["issues"] == 0
