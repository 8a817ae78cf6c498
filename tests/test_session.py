from datetime import datetime

from pyspark.sql import functions as F

from catalog import comparison as catalog
from runloom.plans import comparison
from runloom.session import cut_lineage, measured, settings


def test_a_cut_table_is_read_by_column(spark):
    rows = spark.createDataFrame([(1, "a", [1, None]), (None, None, None), (1, "a", [1, None])], "id long, name string, list array<int>")
    cut = cut_lineage(rows.withColumn("pair", F.struct("id", F.lit(None).cast("string").alias("n"))))
    assert sorted(map(str, cut.collect())) == sorted(map(str, rows.withColumn("pair", F.struct("id", F.lit(None).cast("string").alias("n"))).collect()))
    plan = cut.select("name")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<name:string>" in plan


def test_what_columns_cant_hold_is_cut_all_the_same(spark):
    odd = spark.range(3).select("id", F.lit(None).alias("nothing"), F.lit(1).alias("a"), F.lit(2).alias("A"))
    assert sorted(map(tuple, cut_lineage(odd).collect())) == [(i, None, 1, 2) for i in range(3)]
    assert cut_lineage(odd.select("id").filter("id < 0")).collect() == []


def test_small_files_of_many_rows_are_not_broadcast_unmeasured(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "1m"}):
        many = cut_lineage(spark.range(200_000).selectExpr("id % 7 AS a", "id % 5 AS b"))
        large = cut_lineage(spark.range(400_000).selectExpr("id % 7 AS a", "id AS c"))
        joined = lambda: large.join(many.distinct().unionAll(many), "a").select("c", "b").limit(3)
        plan = lambda: joined()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan()
        with measured(spark):
            assert "BroadcastHashJoin" not in plan()
            assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "1m"
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_a_report_is_planned_by_measured_sizes(spark, tmp_path, monkeypatch):
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(n, datetime(2024, 1, 1, 0, n % 50, n // 50), n % 6, kinds[n * 7 % 5], n % 9 + 0.5, f'{{"k": {n * 3 % 40}}}') for n in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    runs, pairs = catalog.pairs(spark, str(tmp_path))
    limits, cut = [], comparison.cut_lineage
    monkeypatch.setattr(comparison, "cut_lineage", lambda df: (limits.append(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")), cut(df))[1])
    got = comparison.report(pairs, runs.steps, runs.calls, comparison.run_targets(runs.calls, runs.parts)).collect()
    assert len(limits) >= 6 and set(limits) == {"-1"}
    assert sorted((r["group_key"], r["reference_steps"], r["compared_steps"], r["error"]) for r in got) == [(str(n), 15, 15, None) for n in range(3)]
