import re
from collections import Counter

import numpy as np
import xxhash

from runloom.llm import sampling, simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and names[i] != names[j]:
                a, b = sorted((names[i], names[j]))
                names = [a if n == b else n for n in names]
    return names


def test_simhash_against_brute_force(odd, odd_rows, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    names = brute_components([brute_print(r[1]) for r in odd_rows])
    smallest = {n: min((r[0] for r, m in zip(odd_rows, names) if m == n and r[0] is not None), default=None) for n in names}
    expected = Counter((r[0], brute_print(r[1]), smallest[n]) for r, n in zip(odd_rows, names))
    assert Counter((r["doc_id"], r["simhash"] & (2**64 - 1), r["component_id"]) for r in rows) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_keep_first_keeps_one_of_each_component(odd, odd_rows, none):
    kept = simhash.keep_first(odd)
    names = brute_components([brute_print(r[1]) for r in odd_rows])
    assert kept.columns == odd.columns and kept.count() == len(set(names))
    assert kept.filter("simhash = 'h'").count() > 0  # the input's own column
    assert simhash.keep_first(none).count() == 0


def test_large_groups_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # every key is cut into pieces
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = [int(b) ^ sum(1 << int(k) for k in rng.choice(24, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)]
    chain = [int(base[0] >> np.uint64(1)) ^ ((1 << k) - 1) for k in range(0, 60, 3)]
    prints += chain
    rows = spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, simhash long")
    found = {r["simhash"]: r["component_id"] for r in simhash.classes(rows).collect()}
    names = brute_components(prints)
    first = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    assert [found[p - 2**64 if p >> 63 else p] for p in prints] == [first[n] for n in names]


def test_pivots_never_discard_a_near_pair():
    rng = np.random.default_rng(5)
    for x in rng.integers(0, 2**63, 200).tolist():
        y = x ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        assert all(abs((x ^ p).bit_count() - (y ^ p).bit_count()) <= 3 for p in simhash.PIVOTS)


def jaccard(a, b):
    a, b = Counter((a or "").encode().split()), Counter((b or "").encode().split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints_estimate_generalised_jaccard(odd, odd_rows, none):
    rows = [r.asDict() for r in sampling.with_successor(odd).collect()]
    order = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in order)
    following = {}
    for k, (i, text) in enumerate(order):
        following.setdefault((i, len(text)), []).append((text, order[(k + 1) % len(order)][1]))
    for r in rows:
        text, after = following[r["doc_id"], r["n_chars"]].pop(0)
        assert abs(r["near_next"] - jaccard(text, after)) < 0.3
        assert abs(r["near_edited"] - jaccard(text, sampling.edited(text, after))) < 0.3
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (9, 10)}
    assert len(same) == 1
    assert sampling.with_successor(none).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for trial in range(150):
        words = [f"w{trial}-{k}" for k in range(60)]  # fresh words, so that trials draw independently
        a, b = (" ".join(rng.choice(words[s : s + 40], 80)) for s in (0, int(rng.integers(0, 20))))
        signs, _ = sampling.signatures([a, b])
        errors.append((signs[0] == signs[1]).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.09


def test_single_row_follows_itself(spark):
    row = sampling.with_successor(spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 8
