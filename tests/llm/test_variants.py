import random
import re
import zlib
from collections import Counter

import pytest

from runloom.llm import variants
from runloom.llm.queries import QUERIES

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_words(words):
    """All pairs one edit apart, by the words with one place left out."""
    gaps, found = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            for key in ((w[:i], w[i + 1 :]), w[:i] + w[i + 1 :]):
                gaps.setdefault(key, []).append(w)
        gaps.setdefault(w, []).append(w)
    for held in gaps.values():
        for a in held:
            for b in held:
                if a < b and b not in found[a] and near(a, b):
                    found[a].add(b)
                    found[b].add(a)
    return found


def brute(docs, every):
    count = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(UP)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if every and doc_id is not None and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    found, form = near_words(words), {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n, len(found[w]), form[w], words[form[w]] if form[w] else None, root))
    return rows


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("letters, extended", [("ab", 0), ("ab", 300), ("abcé", 40), ("abcdefgh", 2000)])
def test_bounds_and_keys_lose_no_pair(letters, extended):
    """Under any dictionary two words one edit apart share enough grams and a key."""
    rnd = random.Random(len(letters) + extended)
    words = {"".join(rnd.choices(letters, k=rnd.randrange(6, 12))) for _ in range(300)}
    for w in list(words)[:150]:
        i = rnd.randrange(len(w) + 1)
        words |= {w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]}
    words = {w for w in words if len(w) >= 6}
    marked = [f"^{w}$" for w in words]
    long = sorted({m[i : i + k] for m in marked for k in (3, 4) for i in range(len(m) - k + 1)})
    count = Counter(m[i : i + 2] for m in marked for i in range(len(m) - 1)) | Counter(rnd.sample(long, min(extended, len(long))))
    grams = variants.Grams(count)
    entries = {w: grams.entries(w) for w in words}
    pairs = [(a, b) for a, others in near_words(words).items() for b in others if a < b]
    assert pairs and all(e[1] >= 1 for e in entries.values())
    for a, b in pairs:
        (ga, sa, ka), (gb, sb, kb) = entries[a], entries[b]
        assert len(set(ga) & set(gb)) >= max(sa, sb) and set(ka) & set(kb)


def test_near_pairs_of_random_words(spark):
    rnd = random.Random(7)
    words = {"".join(rnd.choices("abc", k=rnd.randrange(6, 10))) for _ in range(1500)}
    got = {tuple(r) for r in variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    found = near_words(words)
    assert len(got) == sum(map(len, found.values())) // 2 and all(b in found[a] and (len(a), a) < (len(b), b) for a, b in got)


def test_forms_and_roots(spark):
    docs = [(1, "colourful " * 700), (2, "colourfull " * 100), (3, "colouurfull " * 6), (4, "Zebra-like"), (5, None), (6, ""), (None, "ÉTÉétéÿ " * 9), (7, "ÉTÉétéÿs " * 60)]
    docs += [(8, "abcdefg " * 30 + "abcdefh " * 30 + "abcdefx " * 5)]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, word string")
    got = rows_of(variants.group_variants(df))
    assert got == brute(docs, None)
    assert {r[5] for r in got if r[0].startswith("colo")} == {"colourful"} and ("abcdefx", 5, 2, "abcdefg", 30, "abcdefg") in got


def test_odd_rows(odd, odd_rows, none):
    assert rows_of(variants.group_variants(odd)) == brute([r[:2] for r in odd_rows], None)
    assert variants.group_variants(none).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_variants"](spark, folder))
    assert got == brute(docs, 199) and any(r[3] for r in got)
