"""A report is committed once, whatever is repeated or broken off."""

import pytest

from runloom.sources import sidecars as sc


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_committed_once_and_read_back(spark, tmp_path, kind):
    folder = str(tmp_path / "reports")
    first = spark.createDataFrame([(1, "a", 2.5), (2, None, 3.0)], "traj_id long, text string, v double")
    with pytest.raises(ValueError):
        sc.read_report(spark, folder, "r")
    # an attempt that broke off before it was committed
    first.write.format(kind).save(f"{folder}/rows/report=r/attempt=lost")
    assert sc.commit_report(first, folder, "r", kind=kind)
    assert not sc.commit_report(first.limit(1), folder, "r", kind=kind)
    got = sc.read_report(spark, folder, "r")
    assert got.schema == first.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, first.collect()))
    assert sc.commit_report(first, folder, "by_run", kind="parquet", by=("traj_id",))
    assert sc.read_report(spark, folder, "by_run").count() == 2
