import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runloom.llm import runs
from runloom.llm.queries import QUERIES


def brute(words, least):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, 2 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_texts(count, seed):
    rnd, texts = random.Random(seed), []
    for _ in range(count):
        kinds, n = rnd.choice([1, 2, 2, 3, 6]), rnd.randrange(0, 70)
        words = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randrange(1, 12)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        texts.append(words)
    a, b = "0", "01"
    while len(b) < 300:
        a, b = b, b + a
    return [*texts, [c.encode() for c in b], [b"x"] * 500]


@pytest.mark.parametrize("least", [4, 5, 12, 13])
def test_all_runs_of_random_words(least):
    texts = random_texts(500, least)
    assert runs.text_runs(texts, least) == [brute(t, least) for t in texts]


def test_extension_is_the_common_prefix():
    rnd = random.Random(2)
    text = [rnd.randrange(1, 3) for _ in range(300)]
    tree = runs.SuffixTree(text, 3)
    import numpy as np

    i, j = np.array([(a, b) for a in range(300) for b in range(300) if a != b]).T
    got = tree.extension(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
        assert text[a : a + n] == text[b : b + n] and (max(a, b) + n == 300 or text[a + n] != text[b + n])


def test_odd_texts(odd, odd_rows, none):
    rows = runs.with_runs(odd).collect()
    assert len(rows) == len(odd_rows) and {"doc_id", "text", "score", "simhash"} <= set(rows[0].asDict())
    for r in rows:
        words = (r["text"] or "").encode().split()
        expected = [(0, 30_000, 1)] if len(words) == 30_000 else brute(words, 12)
        assert [tuple(x) for x in r["runs"]] == expected
        assert r["collapsed"] == ("word" if len(words) == 30_000 else " ".join(w.decode() for w in words))
    clash = none.withColumnRenamed("score", "runs").withColumnRenamed("simhash", "Collapsed")
    assert runs.with_runs(clash).count() == 0 and runs.with_runs(clash).columns == ["doc_id", "text", "runs", "collapsed"]


def test_collapsed_drops_all_periods_but_the_first():
    words = "a b c d e f x y z x y z x y z x y z g".split()
    data = [w.encode() for w in words]
    found = runs.text_runs([data])[0]
    assert found == [(6, 12, 3)] and runs.collapsed(data, found) == b"a b c d e f x y z g"


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and any(r["n_runs"] for r in got.values())
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words, 12) if n < 3000 else runs.text_runs([words])[0]
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        one = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *one)
        assert r["exponent_milli"] == (1000 * one[1] // one[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()


def test_planting_leaves_rows_without_id_or_text_alone(spark):
    rows = spark.createDataFrame([(None, "a b c"), (13, None), (13, " "), (14, "")], "doc_id long, text string")
    assert [r[0] for r in rows.select(F.coalesce(runs.plant(), F.lit("null"))).collect()] in (["a b c", "null", " ", ""], ["a b c", "null", "", ""])
