"""The event-stream source against a sequential reading of the same events."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import automaton, slices
from runloom.sources import codex


def stamp(n):
    return f"2026-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}.000Z"


def millis(n):
    return 1767225600000 + 1000 * n


class Reader:
    """One run, event after event."""

    def __init__(self):
        self.messages, self.waiting = [], {}
        self.fresh()

    def fresh(self):
        self.role, self.at, self.parts, self.tokens = None, None, [], []

    def close(self):
        if self.parts and self.role:
            self.messages.append({"role": self.role, "at": self.at, "parts": self.parts, "tokens": self.tokens, "finish": ""})
        self.fresh()

    def started(self, at):
        self.at = self.at or at

    def read(self, events):
        for at, (kind, *rest) in enumerate(events):
            getattr(self, kind)(millis(at), *rest)
        for call, name in self.waiting.items():
            self.role = self.role or "assistant"
            self.parts.append(("tool_call", name, call, "error"))
        self.close()
        return self

    def message(self, at, role, texts):
        if self.parts and role != self.role:
            self.close()
        self.role = role
        self.started(at)
        self.parts += [("text", t) for t in texts]

    def reasoning(self, at, text):
        if self.role == "assistant" and any(p[0].startswith("tool") for p in self.parts):
            self.close()
        self.role = self.role or "assistant"
        self.started(at)
        self.parts.append(("reasoning", text))

    def call(self, at, call, name):
        if self.parts and self.role != "assistant":
            self.close()
        self.role = "assistant"
        self.started(at)
        self.waiting[call] = name

    def output(self, at, call, text):
        self.role = self.role or "assistant"
        self.started(at)
        name = self.waiting.pop(call, None)
        self.parts.append(("tool_call" if name else "tool", name or "Bash", call, "error" if text.startswith("Error:") else "success"))

    def usage(self, at, n):
        self.tokens.append(n)

    def complete(self, at):
        self.close()
        spoken = [m for m in self.messages if m["role"] in ("user", "assistant")]
        if spoken and spoken[-1]["role"] == "assistant":
            spoken[-1]["finish"] = "stop"


def as_lines(events):
    for at, (kind, *rest) in enumerate(events):
        item, told = lambda **p: ("response_item", p), lambda **p: ("event_msg", p)
        etype, payload = {
            "message": lambda role, texts: item(type="message", role=role, content=[{"type": "output_text", "text": t} for t in texts] + [{"type": "input_image"}]),
            "reasoning": lambda text: item(type="reasoning", summary=[{"text": text}]),
            "call": lambda call, name: item(type="function_call", call_id=call, name=name, arguments="{}"),
            "output": lambda call, text: item(type="function_call_output", call_id=call, output=text),
            "usage": lambda n: told(type="token_count", info={"last_token_usage": {"total_tokens": n, "input_tokens": n}, "total_token_usage": {"total_tokens": at}}),
            "complete": lambda: told(type="task_complete"),
        }[kind](*rest)
        yield json.dumps({"type": etype, "timestamp": stamp(at), "payload": payload})


def random_events(rnd, n):
    pick = lambda: rnd.choice([
        ("message", rnd.choice(["user", "assistant", "developer", "user", "system", ""]), rnd.choice([[], ["a"], ["b", "c"]])), ("reasoning", rnd.choice(["", "hm"])),
        ("call", rnd.choice("xyz"), rnd.choice(["wait", "spawn"])), ("call", rnd.choice("xyz"), "wait"), ("output", rnd.choice("xyz"), rnd.choice(["fine", "Error: no"])),
        ("output", "", "fine"), ("usage", rnd.randrange(1, 50)), ("usage", rnd.randrange(1, 50)), ("complete",),
    ])
    return [pick() for _ in range(n)]


@pytest.mark.parametrize("size", [7, 64])
def test_random_runs_in_slices_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(slices.with_slice, "__defaults__", (size, "step_idx"))
    monkeypatch.setattr(automaton, "BLOCK", 3)
    rnd = random.Random(size)
    runs = {k: random_events(rnd, rnd.randrange(1, 120)) for k in range(25)}
    lines = spark.createDataFrame([(k, i, line) for k, events in runs.items() for i, line in enumerate(as_lines(events))], "traj_id long, line_no long, line string")
    got = codex.convert(lines)
    steps, parts = got.runs.steps.collect(), got.runs.parts.collect()
    calls = {(r["traj_id"], r["step_idx"], r["call_pos"]): r for r in got.runs.calls.collect()}
    for k, events in runs.items():
        messages = Reader().read(events).messages
        mine = sorted((r for r in steps if r["traj_id"] == k), key=lambda r: r["step_idx"])
        assert [(r["step_idx"], r["role"], r["time_created_ms"], r["finish"], r["tokens"]["total"], r["tokens"]["prompt_peak"]) for r in mine] == [
            (i, m["role"], m["at"], m["finish"], sum(m["tokens"]), max(m["tokens"], default=None)) for i, m in enumerate(messages)
        ]
        told = {(r["step_idx"], r["part_pos"]): r for r in parts if r["traj_id"] == k}
        assert set(told) == {(i, j) for i, m in enumerate(messages) for j in range(len(m["parts"]))}
        for i, m in enumerate(messages):
            for j, p in enumerate(m["parts"]):
                assert told[i, j]["type"] == p[0]
                if p[0].startswith("tool"):
                    assert (calls[k, i, j]["tool_name"], calls[k, i, j]["tool_id"], calls[k, i, j]["status"]) == p[1:]
                else:
                    assert told[i, j]["text"] == p[1]
        for a, b in zip(mine, mine[1:]):
            later = b["time_created_ms"] is not None and b["time_created_ms"] >= (a["time_created_ms"] or 0)
            assert a["time_completed_ms"] == (b["time_created_ms"] if later else None)


def test_calls_and_sessions(spark):
    call = lambda i, name, given, kind="arguments": {"type": "response_item", "timestamp": stamp(i), "payload": {"type": "function_call", "call_id": f"c{i}", "name": name, kind: given}}
    out = lambda i, text: {"type": "response_item", "timestamp": stamp(i + 50), "payload": {"type": "function_call_output", "call_id": f"c{i}", "output": text}}
    script = 'await run({cmd: "rg -n foo src", x: 1}); run({"cmd": "ls \\"a b\\""})'
    patch = "*** Begin Patch\n*** Update File: a/b.py\n+x\n*** End Patch"
    long_log = "x" * 300 + " error: late"
    events = [
        {"type": "session_meta", "timestamp": stamp(0), "payload": {"id": "s1", "cwd": "C:\\w\\proj", "cli_version": "1", "model": "m"}},
        {"type": "event_msg", "timestamp": stamp(1), "payload": {"type": "task_started", "model_context_window": 258400}},
        call(1, "shell", json.dumps({"command": ["bash", "-lc", "cat it's.py"]})), call(2, "exec", script, "input"), call(3, "apply_patch", patch, "input"), call(4, "exec_command", json.dumps({"cmd": "sed -n '1,5p' src/a.py"})),
        call(5, "spawn_agent", json.dumps({"prompt": "go", "name": "x"})), call(6, "exec_command", "not json"), call(7, "exec_command", {"cmd": "find src"}), call(8, "exec", "no commands here", "input"), call(9, "wait", "[1]"),
        out(1, json.dumps({"output": "", "metadata": {"exit_code": 2}})), out(2, long_log), out(3, "Traceback (most recent call last)"), out(4, "process exited with code 1"), out(5, {"error": "error: object"}), out(6, "Found 0 errors"),
        out(7, json.dumps({"metadata": {"exit_code": 0}, "text": "error: but fine"})), out(8, "exited with code 1 then code 0"), out(9, json.dumps({"metadata": {"exit_code": True}})),
    ]
    lines = spark.createDataFrame([(1, i, json.dumps(e)) for i, e in enumerate(events)], "traj_id long, line_no long, line string")
    got = codex.convert(lines)
    calls = {r["tool_id"]: r for r in got.runs.calls.collect()}
    shown = {k: (r["tool_name"], r["input"]["command"], r["input"]["file_path"], r["input"]["pattern"], r["input"]["path"]) for k, r in calls.items()}
    assert shown["c1"][:2] == ("Bash", "bash -lc 'cat it'\"'\"'s.py'")
    assert shown["c2"][:4] == ("Grep", 'rg -n foo src ; ls "a b"', None, "foo")
    assert shown["c3"][0] == "Write" and shown["c3"][2] == "a/b.py" and shown["c4"] == ("Read", "sed -n '1,5p' src/a.py", "src/a.py", None, None)
    assert shown["c5"][0] == "spawn_agent" and calls["c5"]["input"]["prompt"] == "go" and calls["c5"]["input"]["name"] == "x"
    assert shown["c6"][:2] == ("Bash", "") and shown["c7"][0] == "Glob" and shown["c7"][4] == "src" and shown["c8"][:2] == ("Bash", "no commands here") and shown["c9"][0] == "wait"
    assert {k: r["status"] for k, r in calls.items()} == {"c1": "error", "c2": "success", "c3": "error", "c4": "error", "c5": "success", "c6": "success", "c7": "success", "c8": "success", "c9": "success"}
    session = got.sessions.first()
    assert (session["session_id"], session["directory_name"], session["context_window_limit"], session["total_duration"]) == ("s1", "proj", 258400, 59.0)


def test_automaton_over_many_slices(spark, monkeypatch):
    """The state before a symbol is the number of earlier ones modulo five, whatever the slices are."""
    monkeypatch.setattr(automaton, "BLOCK", 4)
    rnd = random.Random(1)
    rows = [(r, i, rnd.randrange(3)) for r in range(3) for i in range(200 + r)]
    df = spark.createDataFrame(rows, "traj_id long, line_no long, x int")
    table = automaton.table_of(range(5), range(3), lambda s, x: (s + x) % 5)
    for size in (1, 3, 50, 1000):
        got = automaton.run_automaton(slices.with_slice(df, size, "line_no"), table, F.col("x"))
        state = {}
        for r in sorted(got.collect(), key=lambda r: (r["traj_id"], r["line_no"])):
            assert r["state"] == state.get(r["traj_id"], 0)
            state[r["traj_id"]] = (r["state"] + r["x"]) % 5
