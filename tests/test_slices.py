"""Slice windows against plain Python, with slices small enough that every run spans several."""

import math
import random

from pyspark.sql import functions as F

from runloom.operators import slices as sl


def frame(spark, size=5, runs=3, steps=23, seed=1):
    rnd = random.Random(seed)
    rows = [(r, i, rnd.choice("aab"), rnd.choice([None, 1, 2, 3])) for r in range(runs) for i in range(steps + r)]
    return rows, sl.with_slice(spark.createDataFrame(rows, "traj_id long, step_idx long, tag string, v long"), size)


def test_running_sum_and_max(spark):
    rows, df = frame(spark)
    out = sl.running(df, {"s": F.col("v")})
    out = sl.running(out, {"m": F.col("v")}, how="max", strict=True)
    got = {(r.traj_id, r.step_idx): (r.s, r.m) for r in out.collect()}
    for run, i, _, _ in rows:
        upto = [v for t, j, _, v in rows if t == run and j <= i and v is not None]
        before = [v for t, j, _, v in rows if t == run and j < i and v is not None]
        assert got[run, i] == (sum(upto), max(before) if before else None)


def test_carry_both_ways(spark):
    rows, df = frame(spark)
    out = sl.carry(df, {"p": F.col("v")}, back={"n": F.col("v")})
    got = {(r.traj_id, r.step_idx): (r.p, r.n) for r in out.collect()}
    for run, i, _, _ in rows:
        before = [v for t, j, _, v in rows if t == run and j < i and v is not None]
        after = [v for t, j, _, v in rows if t == run and j > i and v is not None]
        assert got[run, i] == (before[-1] if before else None, after[0] if after else None)


def test_islands_across_slices(spark):
    rows, df = frame(spark, size=3)
    for adjacent in (False, True):
        picked = [r for r in rows if r[1] % 7 != 3]
        out = sl.islands(df.filter("step_idx % 7 <> 3"), ["tag"], adjacent=adjacent)
        got = {(r.traj_id, r.step_idx): r.island for r in out.collect()}
        start, prev = None, None
        for run, i, tag, _ in picked:
            if prev is None or prev[0] != run or prev[2] != tag or (adjacent and prev[1] != i - 1):
                start = i
            assert got[run, i] == start
            prev = (run, i, tag)


def test_neighbours_see_over_the_border(spark):
    rows, df = frame(spark, size=6)
    out = sl.neighbours(df, lambda w: {"p": F.lag("v").over(w), "s": F.sum("v").over(w.rangeBetween(0, 4))}, before=1, after=4, size=6)
    got = {(r.traj_id, r.step_idx): (r.p, r.s) for r in out.collect()}
    assert len(got) == len(rows)
    for run, i, _, _ in rows:
        own = {j: v for t, j, _, v in rows if t == run}
        near = [own[j] for j in range(i, i + 5) if own.get(j) is not None]
        assert got[run, i] == (own.get(i - 1), sum(near) if near else None)


def test_dense_index_splits_long_runs(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(50), n) for k, size in ((1, 400), (2, 7)) for n in range(size)]
    df = spark.createDataFrame(rows, "traj_id long, t long, n long")
    got = {(r.traj_id, r.n): r.step_idx for r in sl.dense_index(df, "traj_id", F.col("t"), ["n"], hot_rows=20).collect()}
    for key in (1, 2):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[key, n] for _, _, n in ordered] == list(range(len(ordered)))


def test_nearest_rank(spark):
    rnd = random.Random(5)
    rows = [(k, round(rnd.uniform(-3, 900), 2)) for k in (1, 2) for _ in range(57 + k)] + [(3, 0.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    for r in sl.nearest_rank(df, ["k"], F.col("v"), {"p5": 0.05, "p95": 0.95, "top": 1.0}, "med").collect():
        vals = sorted(v for k, v in rows if k == r.k)
        at = lambda q: vals[max(0, math.ceil(q * len(vals)) - 1)]
        middle = (vals[(len(vals) - 1) // 2] + vals[len(vals) // 2]) / 2
        assert (r.p5, r.p95, r.top, r.med) == (at(0.05), at(0.95), vals[-1], middle)
