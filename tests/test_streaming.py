"""Live views give what the same aggregation gives on the finished data."""

from pyspark.sql import functions as F

from runloom.schema import CALLS, PARTS, STEPS
from runloom.session import cut_lineage
from runloom.sources import codex
from runloom.sources.bridges import event_runs
from runloom.streaming import alerts, ingest, live


def test_live_counters_match_batch(spark, tmp_path):
    calls = event_runs(spark, "/root/testdata/sf0.001").calls
    calls.repartition(3).write.parquet(str(tmp_path / "calls"))
    stream = live.with_event_time(live.tail(spark, str(tmp_path / "calls"), calls.schema, 1), "time_start", "60 days")
    query = live.run_counters(stream).writeStream.format("memory").queryName("counters").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("counters").collect()))
    want = sorted(map(tuple, live.run_counters(live.with_event_time(calls, "time_start")).collect()))
    assert got == want and got


def watch_rows(seed, runs=6, steps=60):
    import random

    rnd, rows = random.Random(seed), []
    for run in range(runs):
        at = 1_700_000_000_000 + run
        for step in range(steps + run):
            at += rnd.randrange(1, 90_000)
            rows.append((run, at, step, -1, None, rnd.choice([None, rnd.randrange(1, 100)])))
            rows += [(run, at, step, pos, rnd.random() < 0.6, None) for pos in range(rnd.randrange(3))]
    return rows


def alerts_by_hand(rows):
    found, state = set(), {}
    for run, at, step, pos, failed, held in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        chain, first, last = state.get(run, (0, None, None))
        if failed is not None:
            chain, first = (chain + 1, step if not chain else first) if failed else (0, None)
            if chain == 3:
                found.add((run, "failure_chain", step, pos, 3, first))
        if held is not None:
            if last is not None and held < 0.7 * last:
                found.add((run, "occupancy_drop", step, pos, held, last))
            last = held
        state[run] = (chain, first, last)
    return found


def test_batch_alerts(spark):
    rows = watch_rows(1)
    got = alerts.batch_alerts(spark.createDataFrame(rows, alerts.WATCHED))
    assert set(map(tuple, got.collect())) == alerts_by_hand(rows)


def test_live_alerts_over_batches_and_a_restart(spark, tmp_path):
    """Shuffled within what may come late, in many batches, stopped half way: the alerts of the finished runs, each once."""
    rows = sorted(watch_rows(2), key=lambda r: r[1])
    size = 40
    far = rows[-1][1] + 10 * 24 * 3_600_000
    import random

    def put(part, number):
        random.Random(number).shuffle(part)
        spark.createDataFrame(part, alerts.WATCHED).coalesce(1).write.parquet(str(tmp_path / "in" / f"{number:04d}"))

    def run():
        # one file a batch, in the order of arrival
        stream = spark.readStream.schema(alerts.WATCHED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        found = alerts.live_alerts(stream, late="60 minutes", quiet_ms=3 * 24 * 3_600_000)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return query

    chunks = [rows[i : i + size] for i in range(0, len(rows), size)]
    for number, part in enumerate(chunks[: len(chunks) // 2]):
        put(part, number)
    run()
    for number, part in enumerate(chunks[len(chunks) // 2 :], len(chunks) // 2):
        put(part, number)
    # other runs move the watermark on: first all rows become due, then the quiet runs are forgotten
    for number, at in enumerate((rows[-1][1] + 7_200_000, far, far + 1), len(chunks)):
        put([(99, at, number, -1, None, None)], number)
    query = run()
    got = [tuple(r) for r in spark.read.schema(alerts.ALERTS).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == alerts_by_hand(rows)
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 6, kept  # of run 99 alone


def test_segments_are_absorbed_as_a_full_load(spark, tmp_path):
    """Runs in segments over several batches, one batch twice, an old run appended to."""
    import random

    from tests.test_codex import as_lines, random_events

    rnd = random.Random(3)
    lines = {k: list(as_lines(random_events(rnd, 60))) for k in range(5)}

    def put(run, segment):
        folder = tmp_path / "in" / f"run={run}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{segment}.jsonl").write_text("\n".join(lines[run][20 * segment : 20 * segment + 20]) + "\n")

    path = lambda n: str(tmp_path / n)
    make = lambda rows: codex.convert(rows).runs
    run = lambda p: F.regexp_extract(p, "run=([0-9]+)", 1)
    segment = lambda p: F.regexp_extract(p, r"/([0-9]+)\.jsonl", 1).cast("bigint")

    def step():
        stream = ingest.segments(spark, path("in"))
        query = ingest.follow(stream, path("bronze"), path("silver"), make, run, segment, path("state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for batch in ([(0, 0), (1, 0), (2, 0)], [(0, 1), (3, 0), (3, 1), (3, 2)], [(0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (4, 0), (4, 1), (4, 2)]):
        for where in batch:
            put(*where)
        step()
    tables = lambda: {n: sorted(map(str, spark.read.schema(s).parquet(f"{path('silver')}/{n}").select(*s.names).collect())) for n, s in (("steps", STEPS), ("calls", CALLS), ("parts", PARTS))}
    first = tables()
    # the second batch comes again
    again = spark.read.parquet(path("bronze")).filter("batch = 1").select(F.col("traj_id").cast("bigint").alias("traj_id"), "line_no", "line")
    ingest.absorb(cut_lineage(again), 1, path("bronze"), path("silver"), make)
    assert tables() == first
    whole = spark.createDataFrame([(k, i, line) for k, run_lines in lines.items() for i, line in enumerate(run_lines)], "traj_id long, line_no long, line string")
    full = make(whole)
    assert first == {n: sorted(map(str, getattr(full, n).collect())) for n in ("steps", "calls", "parts")}
