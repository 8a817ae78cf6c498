"""Every stage with null, empty, long and repeated texts, rows without an id, clashing columns, and no rows or labels at all."""

import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def labelled(spark, odd_rows, tmp_path_factory):
    rnd = random.Random(5)
    plain = "the of and river stone house walk green morning letter paper window garden light".split()
    rows, labels = [], []
    for i in range(100, 180):
        toxic = i % 4 == 0
        words = [rnd.choice(plain) for _ in range(30)]
        if toxic:
            words = [rnd.choice(["vilescum", "filthwort", "hatemonger", "vilescum"]) if rnd.random() < 0.4 else w for w in words]
        text = " ".join(words) if i % 8 < 6 else "\n".join("$$ ## %% !!" for _ in range(6))
        rows.append((i, text, "s", "h"))
        labels.append((i, 0 if i % 8 >= 6 else 1, int(toxic)))
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    return [*odd_rows, *rows], folder, none


def test_stages_keep_columns_and_odd_rows(spark, odd, labelled):
    rows, folder, none = labelled
    docs = spark.createDataFrame(rows, odd.schema).repartition(3)
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept = [tuple(r) for r in out.collect()]
        assert kept and set(kept) <= set(rows), name
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "toxicity":
            # clean and odd rows stay, however often they are repeated
            assert sum(1 for r in kept if r[0] == 9) == 3 and all(r in kept for r in rows[:13])
            assert not any("vilescum" in (r[1] or "") for r in kept)
        if name == "near_duplicates":
            assert len(kept) == len(set(kept)) and sum(1 for r in kept if r[1] == "same text here") == 1
        else:
            assert stage(spark, docs, none).count() == docs.count()
    packed = cp.pack(spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in rows}) and cp.pack(spark, docs.limit(0), folder).count() == 0
