from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import archive, line_quality, multi_index, shards, toxicity


def test_shards_by_bytes_and_rows(spark, odd, odd_rows, none):
    rng = np.random.default_rng(2)
    many = [(i, "hot " * 20 if i % 3 == 0 else "x" * int(rng.integers(0, 200)), "a") for i in range(3_000)]
    df = spark.createDataFrame(many, "doc_id long, text string, slot string")
    for law in ("bytes", "rows"):
        rows = shards.shard(df, 7, law, range_bytes=4_096).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(3_000))
        of = {s: [r for r in rows if r["shard"] == s] for s in range(7)}
        assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in of.values())
        sizes = [sum(r["size"] if law == "bytes" else 1 for r in part) for part in of.values()]
        assert max(sizes) - min(sizes) <= (450 if law == "bytes" else 1)
    assert shards.shard(odd, 4).count() == len(odd_rows) and shards.shard(none, 4).count() == 0
    assert {"score", "simhash", "shard", "slot", "size"} <= set(shards.shard(odd, 40).columns)
    null = shards.shard(spark.createDataFrame([(None, None), (None, None), (1, "")], "doc_id long, text string"), 2).collect()
    assert [r["size"] for r in null] == [16] * 3


def test_small_groups_of_equal_texts_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i // 4} " * 3) for i in range(8_000)], "doc_id long, text string")
    assert shards.shard(df, 5).groupBy("text").agg({"shard": "approx_count_distinct"}).filter("`approx_count_distinct(shard)` > 1").count() == 0


def vectors(n, width=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32).astype(float)
    return (x / np.linalg.norm(x, axis=1)[:, None]).tolist()


def test_multi_index_recall_and_ties(spark, monkeypatch):
    x = vectors(600)
    x[40:200] = [x[40]] * 160  # a hot vector
    rows = [(i, v, "q") for i, v in enumerate(x)] + [(1_000, None, "q"), (1_010, [0.0] * 8, "q"), (1_020, [float("nan")] + [1.0] * 7, "q"), (1_030, [None] + [1.0] * 7, "q"), (1_040, [1.0], "q"), (None, x[0], "q"), (0, x[0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    found = multi_index.nearest(df, every=20, top=5, centroids=8).collect()
    a, hits = np.array(x), 0
    for q in range(0, 600, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        score = a @ a[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(score, 12))) if i != q][:5]
        hits += len(set(best) & {v for _, v, _ in own})
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for _, v, s in own)
    assert hits >= 0.9 * 150 and {r["query_id"] for r in found} == set(range(0, 600, 20))
    assert multi_index.nearest(df.limit(0), every=20, top=5).count() == 0
    few = multi_index.nearest(spark.createDataFrame([(0, x[0]), (1, x[1]), (2, x[2])], "vec_id long, embedding array<double>"), every=2, top=5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2), (2, 0), (2, 1)]


def test_walk_goes_in_order_of_summed_cost():
    rng = np.random.default_rng(4)
    costs, counts = (rng.random(6), rng.random(5)), np.ones(30, np.int64)
    cells = multi_index.walk(costs, counts, 30)
    total = [costs[0][c // 5] + costs[1][c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and total == sorted(total)


def test_archive_gives_every_record_back(spark, monkeypatch):
    monkeypatch.setattr(archive, "HOT", 50)
    big, hot = "é" * 600, "h" * 1_500
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://d", "small"), (5, "http://e\r\nx", None), (6, "u", ""), (None, "u", big), (2, "http://b", big)] + [(i, "u", hot) for i in range(100, 200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = archive.fields(archive.restore(spark, archive.write(df))).collect()
    assert len(got) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert r["payload"] == payload[r["page_id"]] and head.startswith(b"WARC/1.1\r\n")
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n"
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(1, "revisit", 2), (2, "response", None), (3, "response", None), (5, "response", None), (None, "revisit", 2), (100, "revisit", 199), (199, "response", None)} <= kinds
    assert spark.table(archive.write(df).payloads).count() == 4
    assert archive.restore(spark, archive.write(df.limit(0))).count() == 0


def labelled(spark, n=240):
    rng = np.random.default_rng(7)
    plain = ["river", "stone", "light", "garden", "window", "letter", "market", "summer"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(plain, 40).tolist()
        toxic, poor = i % 3 == 0, i % 4 == 0
        for k in rng.choice(40, 4, replace=False) if toxic else []:
            words[k] = str(rng.choice(["vermin", "filthbag"]))
        lines = [" ".join(words[k : k + 8]).capitalize() + "." for k in range(0, 40, 8)]
        docs.append((i, "\n".join(line.upper() + "!!! ###" for line in lines) if poor else "\n".join(lines), "x"))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(None, None, "x"), (n, "", "x"), (n + 1, "word " * 50_000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "parts", "out"), [(toxicity, "toxic", 5, 0), (line_quality, "quality", 4, 2)])
def test_classifiers_learn_and_score_everything(spark, module, label, parts, out):
    docs, labels = labelled(spark)
    scored = module.score(docs, module.train(docs, labels)).withColumn("held", toxicity.remainder(F.col("doc_id"), parts) == out)
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.filter("quality is not null").collect()}
    held = [r for r in rows if r["held"] and r["doc_id"] in truth and r["doc_id"] is not None]
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held) >= 0.95 * len(held) > 0
    assert module.train(docs, labels.limit(0)) is None and module.score(docs, None).count() == docs.count()
    assert module.score(docs.limit(0), module.train(docs, labels)).count() == 0


def test_forward_backward_against_all_labelings():
    from itertools import product

    rng = np.random.default_rng(8)
    sizes, move = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    good, z, moves = line_quality.forward_backward(unary, move, sizes)
    at = 0
    for k, n in enumerate(sizes):
        every = list(product((0, 1), repeat=int(n)))
        weight = np.exp([sum(unary[at + t] * y[t] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])) for y in every])
        assert np.isclose(z[k], np.log(weight.sum()))
        for t in range(n):
            assert np.isclose(good[at + t], sum(w for w, y in zip(weight, every) if y[t]) / weight.sum())
        assert np.isclose(moves[k].sum(), n - 1)
        at += n


def brute_shared(words: set[str]) -> dict[str, float]:
    """Probability of the last of five letters after the four before, from all words."""
    n, pad = toxicity.ORDER, toxicity.BEFORE * (toxicity.ORDER - 1)
    grams = {f"{pad}{w}{toxicity.AFTER}"[i : i + n] for w in words for i in range(len(w) + 1)}
    counts = {}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in grams)
        grams = set(counts[k])
    probability = {}
    for k in range(1, n):
        c, once, twice = counts[k], *(sum(v == x for v in counts[k].values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        for g, v in c.items():
            same = [x for h, x in c.items() if h[:-1] == g[:-1]]
            probability[g] = (v + 1) / (sum(same) + len(same) + 1) if k == 1 else max(v - d, 0) / sum(same) + d * len(same) / sum(same) * probability[g[1:]]
    return {g: probability[g] for g in counts[n - 1]}


def test_shared_backoff_counts_cover_all_texts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = {"".join(rng.choice(list("abcdé日"), int(rng.integers(1, 9)))) for _ in range(150)} | {"ab" * 300}
    rows = [(" ".join(sorted(words)[i::7]).upper() + " !", "x") for i in range(7)] * 2 + [(None, "x"), ("", "x")]
    docs = spark.createDataFrame(rows, "text string, gram string").repartition(4)
    monkeypatch.setattr(toxicity, "HELD", 50)
    grams = toxicity.corpus_grams(docs).distinct()
    got = {r["gram"]: r["shared"] for r in toxicity.with_shared(grams, toxicity.shared_counts(docs)).collect()}
    expected, of_context = brute_shared(words), Counter()
    assert len(got) == grams.count() and {g[1:] for g in got} == set(expected)
    assert all(abs(p - expected[g[1:]]) < 1e-12 for g, p in got.items())
    for g, p in expected.items():
        of_context[g[:-1]] += p
    assert all(0 < p <= 1 + 1e-9 for p in of_context.values())
    assert toxicity.with_shared(grams.limit(0), toxicity.shared_counts(docs.limit(0))).count() == 0


def test_backoff_orders_are_planned_one_by_one(spark):
    docs = spark.createDataFrame([("some words of a few letters",), (None,)], "text string")
    plan = toxicity.with_shared(toxicity.corpus_grams(docs).distinct(), toxicity.shared_counts(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_pipeline_stages_keep_columns_and_copies_go(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    poor = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in ids for i in poor) <= 0.1 * len(poor)
    assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, kept, folder).collect()} == ids
