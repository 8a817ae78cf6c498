"""A folder of logs of every dialect goes in, silver tables come out."""

import json
import random

from pyspark.sql import functions as F

from runloom.sources import codex, loading, logs, nested
from tests.test_codex import as_lines, random_events
from tests.test_nested import Maker


def test_one_way_in(spark, tmp_path):
    rnd = random.Random(6)
    events = [json.dumps({"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "s"}}), *as_lines(random_events(rnd, 80))]
    deep = Maker(4).session(3)
    deep["meta"]["session_id"] = "x"
    export = {"info": {"id": "e"}, "messages": [{"info": {"role": "user", "time": {"created": 1}}, "parts": [{"type": "text", "text": "hi"}]}, {"info": {"role": "assistant"}, "parts": [{"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed", "output": "o", "input": {"command": "ls"}}}]}]}
    claude = {"format": "ccsession-trajectory", "trajectory": [{"role": "user", "message_id": "a", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "message_id": "b", "content": [{"type": "text", "text": "r"}]}]}
    files = {
        "stream.jsonl": "\n".join(events) + "\n", "cut.jsonl": "\n".join(events) + '\n{"type": "resp', "array.json": "[" + ",\n".join(events) + "]", "one.json": events[0],
        "deep.json": json.dumps(deep, indent=1), "deep.jsonl": json.dumps(deep) + "\n{\"cut", "wrapped.json": json.dumps([export]), "export.json": json.dumps(export, indent=2), "claude.json": json.dumps(claude),
        "bad.jsonl": events[0] + "\n{oops\n" + events[1] + "\n", "broken.json": '{"a": ', "number.json": "17\n", "pi.jsonl": '{"type": "session", "id": "p"}\n{"type": "message"}\n', "other.json": '{"messages": []}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = loading.load(spark, str(tmp_path))
    listed = {r["path"].rsplit("/", 1)[-1]: r for r in got.files.collect()}
    assert set(listed) == set(files) - {"broken.json"}  # its only line is still being written
    told = {k: (r["format"], r["error"]) for k, r in listed.items()}
    for name, kind in (("stream.jsonl", "codex"), ("cut.jsonl", "codex"), ("array.json", "codex"), ("one.json", "codex"), ("deep.json", "icode"), ("deep.jsonl", "icode"), ("wrapped.json", "opencode"), ("export.json", "opencode"), ("claude.json", "ccsession")):
        assert told[name] == (kind, None), name
    assert told["bad.jsonl"] == ("unknown", "invalid JSON at line 2") and told["pi.jsonl"] == ("pi", "no converter for pi") and told["other.json"] == ("unknown", "unknown dialect") and told["number.json"][1]
    steps = {}
    for r in got.runs.steps.collect():
        steps.setdefault(r["traj_id"], []).append((r["step_idx"], r["role"], r["text_preview"], r["tool_call_count"], r["tokens"]["total"]))
    of = lambda name: sorted(steps.get(listed[name]["traj_id"], []))
    plain = lambda rows: sorted((r["step_idx"], r["role"], r["text_preview"], r["tool_call_count"], r["tokens"]["total"]) for r in rows.collect())
    lines = spark.createDataFrame([(1, i, e) for i, e in enumerate(events)], "traj_id long, line_no long, line string")
    expected = plain(codex.convert(lines).runs.steps)
    assert expected and of("stream.jsonl") == of("cut.jsonl") == of("array.json") == expected and of("one.json") == []
    assert of("deep.json") == of("deep.jsonl") == plain(nested.convert(spark.createDataFrame([(1, json.dumps(deep))], "traj_id long, text string")).steps)
    assert of("wrapped.json") == of("export.json") == [(0, "user", "hi", 0, 0), (1, "assistant", "[Tool: bash]", 1, 0)]
    assert [s[:3] for s in of("claude.json")] == [(0, "user", "q"), (1, "assistant", "r")]
    wrong = loading.load(spark, str(tmp_path), hint="codex").files.filter(F.col("path").endswith("/export.json")).first()
    assert wrong["error"].startswith("format mismatch")


def test_one_reading_tells_the_same_dialect(spark):
    texts = [
        '{"_cc_format": true}', '{"_pi_format": "true"}', '{"format": "ccsession-trajectory"}', '{"export_metadata": {"source_format": "cursor_composer"}, "info": {}, "messages": []}',
        '{"export_metadata": {"schema_version": 2, "source_format": "codearts_opencode_sqlite"}, "info": {"a": 1}, "messages": [1]}', '{"export_metadata": {"schema_version": "2", "source_format": "codearts_legacy_json"}, "messages": []}',
        '{"meta": {"session_id": "z"}, "state": {"messages": [{"type": "message", "contents": []}]}}', '{"meta": {"session_id": "z"}, "state": {"messages": [{"role": "tool", "contents": "x"}]}}',
        '{"_chrys_export": {"format": "chrys-expanded-session-v1"}, "state": {"messages": []}}', '{"info": {"id": 1}, "messages": [1]}', '{"info": [], "messages": [1]}', '{"info": null, "messages": null}', "[1]", "17", '"x"', "null", "{}",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    paths = ["$.type", "$.info", "$.messages", "$.export_metadata.source_format", "$.state.messages[0].contents"]
    head = logs.object_head(F.col("text"))
    got = rows.select("text", logs.object_format(F.col("text")).alias("a"), logs.object_format(F.col("text"), head).alias("b"), *[F.get_json_object("text", p).eqNullSafe(logs.member(head, p)).alias(p) for p in paths]).collect()
    assert all(r["a"] == r["b"] and all(r[p] for p in paths) for r in got), got
    assert {r["a"] for r in got} == {"ccsession", "pi", "cursor", "codearts", "icode", "opencode", "unknown"}


def test_first_events_are_the_first_numbers(spark):
    rows = spark.createDataFrame([(f"p{n % 3}", n * n % 401, str(n)) for n in range(90)], "path string, line_no long, line string").dropDuplicates(["path", "line_no"])
    told = lambda df: sorted(map(tuple, df.select("path", "line_no", "event_no", "line").collect()))
    assert told(logs.first_events(rows)) == told(logs.number_events(rows).filter("event_no < 12"))
