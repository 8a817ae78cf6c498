"""Nested session exports against a recursive reading of the same documents."""

import json
import random
import uuid
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runloom.operators import slices
from runloom.session import shared_folder
from runloom.sources import nested


def stamp(n):
    return f"2026-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}Z"


class Maker:
    def __init__(self, seed):
        self.rnd, self.clock, self.names = random.Random(seed), 0, 0

    def tick(self):
        self.clock += 1
        return self.clock

    def session(self, depth, widest=3):
        rnd = self.rnd
        self.names += 1
        me = {"meta": {"invocation_id": f"inv{self.names}", "session_id": f"s{self.names}", "created_at": stamp(self.tick()), "agent_profile": rnd.choice(["a", "b"])}}
        children = [self.session(depth - 1) for _ in range(rnd.randrange(widest) if depth else 0)]
        if depth and not children and rnd.random() < 0.7:
            children = [self.session(depth - 1)]
        messages, calls = [], []
        for child in children:
            if rnd.random() < 0.6:
                child["meta"]["parent_provider_call_id"] = rnd.choice(["c1", "c2", "c3"])
        asks = [c["meta"]["invocation_id"] for c in children if rnd.random() < 0.7]
        for _ in range(rnd.randrange(2, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "tool", "tool"])
            contents = []
            for _ in range(rnd.randrange(4)):
                call = rnd.choice(["", "", "c1", "c2", "c3"])
                if role == "tool":
                    props = {"failed": rnd.random() < 0.3}
                    if asks and rnd.random() < 0.6:
                        props["_chrys_tool_result_metadata"] = {"sub_agent_invocation_id": asks.pop()}
                    contents.append({"type": "function_result", "call_id": call, "result": f"r{self.tick()}", "additional_properties": props})
                elif role == "assistant" and rnd.random() < 0.6:
                    name, arguments = rnd.choice([("sh", '{"cmd": "ls"}'), ("read", '{"path": "a.py"}'), ("grep", ""), ("", '{"pattern": "x"}'), ("other", "")])
                    contents.append({"type": "function_call", "call_id": call, "name": name, "arguments": arguments})
                    calls.append(call)
                else:
                    contents.append(rnd.choice([{"type": "text", "text": "hi"}, {"type": "text", "text": ""}, "plain", "", {"type": "reasoning", "text": "hm"}]))
            messages.append({"role": role, "contents": contents, "additional_properties": {"_chrys_created_at": stamp(self.tick()), "_group": {"token_count": rnd.choice([0, 0, 5, 7])}}})
        me["meta"]["ended_at"] = stamp(self.tick())
        me["state"] = {"messages": messages}
        me["_chrys_sub_agent_sessions"] = children
        return me


def read(session):
    """(messages in order, calls): a message is [session, role, tokens, parts], a part (kind, text or call)."""
    children = session["_chrys_sub_agent_sessions"]
    inside = {c["meta"]["invocation_id"]: read(c) for c in children}
    by_call = {c["meta"].get("parent_provider_call_id"): c["meta"]["invocation_id"] for c in children}
    out, waiting, behind, seen = [], [], {}, set()
    for m in session["state"]["messages"]:
        tokens, role, parts = m["additional_properties"]["_group"]["token_count"], m["role"], []
        if role == "tool":
            for item in m["contents"]:
                if not isinstance(item, dict) or item.get("type") != "function_result":
                    continue
                props = item["additional_properties"]
                call = next((w for w in waiting if w["id"] == item["call_id"]), None)
                if call is None:
                    call = {"id": item["call_id"], "name": "?", "at": len(out)}
                    out.append([session["meta"]["invocation_id"], "assistant", 0, [("tool_call", call)]])
                else:
                    waiting.remove(call)
                call |= {"status": "error" if props["failed"] else "completed", "output": item["result"], "child": None}
                out[call["at"]][2] += tokens
                tokens = 0
                child = props.get("_chrys_tool_result_metadata", {}).get("sub_agent_invocation_id") or (by_call.get(item["call_id"]) if item["call_id"] else None)
                if child:
                    call["child"] = child
                    if child not in seen:
                        seen.add(child)
                        behind.setdefault(len(out) - 1, []).append(child)
            continue
        stubs = []
        for item in m["contents"]:
            if isinstance(item, str) or item["type"] == "text":
                text = item if isinstance(item, str) else item["text"]
                if text:
                    parts.append(("text", text))
            elif item["type"] == "reasoning" and role == "assistant":
                parts.append(("reasoning", item["text"]))
            elif item["type"] == "function_call":
                name = item["name"]
                if not name and item["arguments"] and stubs:
                    name = stubs.pop(0)
                elif name and not item["arguments"]:
                    stubs.append(name)
                call = {"id": item["call_id"], "name": {"sh": "Bash", "read": "Read", "grep": "Grep"}.get(name, name or "?"), "at": len(out), "status": "error", "output": "", "child": None}
                parts.append(("tool_call", call))
                waiting.append(call)
        if parts or (role == "assistant" and tokens):
            out.append([session["meta"]["invocation_id"], role, tokens, parts])
        else:
            for part in parts:
                waiting.remove(part[1])
    if not behind:
        return out
    merged = []
    for i, m in enumerate(out):
        merged.append(m)
        for child in behind.get(i, []):
            merged += inside[child]
    for child, messages in inside.items():
        if child not in seen:
            merged += messages
    return merged


@pytest.mark.parametrize("size", [3, 4096])
def test_sessions_of_any_depth(spark, monkeypatch, size):
    monkeypatch.setattr(slices.with_slice, "__defaults__", (size, "step_idx"))
    made = {k: Maker(k).session(5 if k % 3 else 2) for k in range(12)}
    got = nested.convert(spark.createDataFrame([(k, json.dumps(s)) for k, s in made.items()], "traj_id long, text string"))
    steps, parts, calls = got.steps.collect(), got.parts.collect(), got.calls.collect()
    deepest = 0
    for k, session in made.items():
        expected = read(session)
        mine = sorted((r for r in steps if r["traj_id"] == k), key=lambda r: r["step_idx"])
        assert [r["step_idx"] for r in mine] == list(range(len(expected)))
        assert [(r["session_id"], r["role"], r["tokens"]["total"]) for r in mine] == [tuple(m[:3]) for m in expected]
        for i, m in enumerate(expected):
            told = sorted((r for r in parts if (r["traj_id"], r["step_idx"]) == (k, i)), key=lambda r: r["part_pos"])
            assert [r["type"] for r in told] == [p[0] for p in m[3]]
            assert [r["text"] for r in told if r["type"] != "tool_call"] == [p[1] for p in m[3] if p[0] != "tool_call"]
            used = sorted((r for r in calls if (r["traj_id"], r["step_idx"]) == (k, i)), key=lambda r: r["call_pos"])
            want = [p[1] for p in m[3] if p[0] == "tool_call"]
            assert [(r["tool_name"], r["tool_id"], r["status"], r["output"], r["child_session_id"]) for r in used] == [(c["name"], c["id"], c["status"], c["output"], c["child"]) for c in want]
        deepest = max(deepest, max((len(r["path"]) for r in nested.sessions(spark.createDataFrame([(k, json.dumps(session))], "traj_id long, text string")).select("path").collect()), default=0)) if k < 3 else deepest
    assert deepest == 5


def test_first_waiting_call_is_answered(spark):
    rnd = random.Random(1)
    rows = [(r, i // 5, i, rnd.random() < 0.5) for r in range(4) for i in range(60)]
    got = {(r["k"], r["pos"]): r["partner"] for r in nested.fifo(spark.createDataFrame(rows, "k long, slice long, pos long, is_call boolean"), ["k"]).collect()}
    for k in range(4):
        waiting = []
        for _, _, pos, is_call in (r for r in rows if r[0] == k):
            if is_call:
                waiting.append(pos)
            else:
                assert got[k, pos] == (waiting.pop(0) if waiting else None)


def test_calls_keep_times_and_reasons(spark):
    call = {"type": "function_call", "call_id": "c", "name": "sh", "arguments": '{"cmd": "ls"}', "additional_properties": {"_chrys_timing": {"started_at": stamp(5), "finished_at": stamp(9)}}}
    late = {"type": "function_call", "call_id": "d", "name": "write", "arguments": '{"path": "x"}'}
    done = {"type": "function_result", "call_id": "c", "exception": "boom", "additional_properties": {"tool_error_kind": "timeout"}}
    doc = {"meta": {"session_id": "s"}, "state": {"messages": [
        {"role": "assistant", "contents": [call, late], "additional_properties": {"_chrys_created_at": stamp(4)}},
        {"role": "tool", "contents": [done], "additional_properties": {"_chrys_created_at": stamp(10)}},
    ]}}
    rows = {r["tool_id"]: r for r in nested.convert(spark.createDataFrame([(1, json.dumps(doc))], "traj_id long, text string")).calls.withColumn("base", F.lit(1767225600000)).collect()}
    c, d = rows["c"], rows["d"]
    assert (c["status"], c["output"], c["error_type"], c["time_start"] - c["base"], c["time_end"] - c["base"], c["input"]["command"]) == ("error", "boom", "timeout", 5000, 9000, "ls")
    assert (d["status"], d["error_type"], d["time_start"] - d["base"], d["time_end"], d["input"]["file_path"]) == ("error", "missing_result", 4000, None, "x")


def test_long_exports_are_read_a_few_at_a_time(spark):
    told = lambda: "".join(uuid.uuid4().hex for _ in range(1500))
    session = lambda n, *below: {"meta": {"session_id": f"s{n}"}, "state": {"messages": [{"role": "user", "contents": [told()]}]}, "_chrys_sub_agent_sessions": [*below]}
    docs = spark.createDataFrame([(n, json.dumps(session(n, session(-n)))) for n in range(400)], "traj_id long, text string").coalesce(1)
    top = Path(shared_folder(spark).removeprefix("file:"))
    before = set(top.iterdir())
    assert nested.sessions(docs).count() == 800
    groups = [pq.ParquetFile(f).metadata for t in set(top.iterdir()) - before for f in t.glob("*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 50_000_000 and max(sizes) < 8_000_000


def test_running_takes_what_comes_before_for_named_columns_alone(spark):
    rows = [(i // 4, i, v) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6, 5, 3])]
    made = slices.running(spark.createDataFrame(rows, "slice long, pos long, v long").withColumn("k", F.lit(1)), {"upto": F.col("v"), "before": F.col("v")}, keys=["k"], order=["pos"], how="max", strict=["before"])
    got = [(r["upto"], r["before"]) for r in sorted(made.collect(), key=lambda r: r["pos"])]
    assert got == [(max(r[2] for r in rows[: i + 1]), max((r[2] for r in rows[:i]), default=None)) for i in range(len(rows))]
