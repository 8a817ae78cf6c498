"""Alignment against a plain table walk, in one group and in tiles."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.operators import align as al
from runloom.operators import divergence as dv


def sequence(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.choice(["FILE_READ", "SEARCH", "COMMAND"])
        target = {"FILE_READ": rnd.choice(["/r/src/a.py", "src/a.py", "b.py", "/q/src/a.py"]), "SEARCH": rnd.choice(["p@src", "p", "q@lib"]), "COMMAND": rnd.choice(["git", "pytest"])}[kind]
        out.append((i, kind, target, rnd.choice(list(al.EFFECTS))))
    return out


# Which of the targets above are equivalent: the three end in src/a.py, and a search without scope fits any scope.
GROUP = {"/r/src/a.py": 0, "src/a.py": 0, "/q/src/a.py": 0, "b.py": 1, "p@src": 2, "p": 2, "q@lib": 3, "git": 4, "pytest": 5}


def expected(a, b):
    fits = lambda x, y: x[1] == y[1] and GROUP[x[2]] == GROUP[y[2]] and al.COMPATIBLE[al.EFFECTS[x[3]], al.EFFECTS[y[3]]]
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = t[i - 1, j - 1] + 1 if fits(x, y) else max(t[i - 1, j], t[i, j - 1])
    found, i, j = [], len(a), len(b)
    while i and j:
        if fits(a[i - 1], b[j - 1]) and t[i, j] == t[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif t[i - 1, j] >= t[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return sorted(found)


@pytest.mark.parametrize("cells", [10_000, 0])
def test_alignment(spark, cells):
    pairs = {"x": (sequence(1, 23), sequence(2, 17)), "y": (sequence(3, 9), sequence(4, 30)), "z": (sequence(5, 8), sequence(6, 8))}
    schema = "group_key string, seq long, action_type string, target string, effect string, command string"
    side = lambda s: spark.createDataFrame([(k, *r, "") for k, v in pairs.items() for r in v[s]], schema)
    got = al.align(side(0), side(1), cells=cells, tile=8).collect()
    for key, (a, b) in pairs.items():
        assert sorted((r.ref_seq, r.cmp_seq) for r in got if r.group_key == key) == expected(a, b)


def test_pairs_are_dealt_by_number_and_may_span_batches(spark):
    pairs = {f"p{n}": (sequence(2 * n, n % 7), sequence(2 * n + 1, n % 5 + 1)) for n in range(40)}
    schema = "group_key string, seq long, action_type string, target string, effect string, command string"
    side = lambda s: spark.createDataFrame([(k, *r, "") for k, v in pairs.items() for r in v[s]], schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = al.align(side(0), side(1))
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, (a, b) in pairs.items():
        assert sorted((r.ref_seq, r.cmp_seq) for r in got if r.group_key == key) == expected(a, b)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("kind, a, b, same", [
    ("FILE_READ", "/home/u/repo/src/app.ts", "/other/repo/src/app.ts", True), ("FILE_READ", "/w/a.py", "a.py", True), ("FILE_READ", "/w/a.py", "/v/a.py", False),
    ("FILE_READ", "", "", True), ("FILE_READ", "", "a.py", False), ("SEARCH", "p@/w/src/x", "p", True), ("SEARCH", "p@src", "q@src", False), ("SEARCH", "p@a", "p@b", False),
    ("AGENT_SPAWN", "one", "two", True), ("COMMAND", "git", "git", True), ("COMMAND", "git", "ls", False),
])
def test_match_relation(kind, a, b, same):
    side = lambda t: pd.DataFrame({"code": [0], "kind": [kind], "target": [t]})
    assert len(al._joined(side(a), side(b))) == len(al._joined(side(b), side(a))) == int(same)


def test_lopsided_pairs_and_long_keys_stay_out_of_groups(spark, monkeypatch):
    small = al._align_small

    def guarded(rows):
        assert len(rows) <= 5_000 and rows["target"].nunique() <= 2 and rows["target"].str.len().max() < 20
        return small(rows)

    monkeypatch.setattr(al, "_align_small", guarded)
    row = "action_type string, target string, effect string, command string"
    side = lambda *runs: spark.createDataFrame([(k, i, *r, "") for k, rows in runs for i, r in enumerate(rows)], f"group_key string, seq long, {row}")
    long = [("COMMAND", "git" if i == 69_000 else "ls", "unknown") for i in range(70_000)]
    spawns = lambda c: [("AGENT_SPAWN", f"{c}{i} prompt " * 20, "unknown") for i in range(300)] + [("FILE_READ", f"/{c}{i}/src/a.py", "unknown") for i in range(300)]
    one = [("COMMAND", "git", "unknown")]
    got = al.align(side(("none", long), ("one", long), ("keys", spawns("x"))), side(("one", one), ("keys", spawns("y")), ("zero", long))).collect()
    assert sorted((r.ref_seq, r.cmp_seq) for r in got if r.group_key == "keys") == [(i, i) for i in range(600)]
    assert [(r.group_key, r.ref_seq, r.cmp_seq) for r in got if r.group_key != "keys"] == [("one", 69_000, 0)]


def test_short_targets_have_the_same_equivalents(spark):
    texts = {"FILE_READ": ["", "a", "/a", "x/a", "/w/x/a", "v/x/a", "y/a", "x/", "w/x/"], "SEARCH": ["p", "p@", "p@x", "p@w/x", "p@v/w/x", "p@u/x", "p@q@", "p@q@x", "p@q"], "AGENT_SPAWN": ["one", "two"], "COMMAND": ["w/x/a", "v/x/a"]}
    keys = pd.DataFrame([(k, t) for k, ts in texts.items() for t in ts], columns=["kind", "target"]).rename_axis("code").reset_index()
    short = spark.createDataFrame(keys).withColumn("target", al.short_target(F.col("kind"), F.col("target"))).orderBy("code").toPandas()
    pairs = lambda a: sorted(map(tuple, al._joined(a, a).to_numpy(int).tolist()))
    assert pairs(keys) == pairs(short) and short["target"].nunique() < len(short)


@pytest.mark.parametrize("order, inversions", [("edcba", 10), ("acbde", 1), ("bcdea", 4), ("ddcbaa", 6)])
def test_ordering_counts_inversions(spark, order, inversions):
    ref = "abcd" if order == "ddcbaa" else "abcde"
    schema = "group_key string, seq long, step_idx long, action_type string, target string"
    rows = lambda text: spark.createDataFrame([("g", i, i, "COMMAND", c) for i, c in enumerate(text)], schema)
    out = dv.ordering(rows(ref), rows(order)).first()
    assert out.inversions == inversions and out.common == len(set(ref))
