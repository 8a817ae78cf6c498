"""Spelling variants: words one edit apart, found through an index of grams of variable length.

The gram dictionary is pruned by frequency: every gram of two code points belongs to it, a longer one only
where the gram it extends is frequent. A word, with a mark at each end, is decomposed into the longest
dictionary gram at each place, without those that lie inside an earlier one. For each word the most grams
that one edit can affect are counted, so a word one edit apart shares all others: the rarest of them, one
more than can be affected, are looked up. The list of a gram is split by the text on its other side of the
edit, which must be equal. Words that then share too few grams for either's bound are dropped, the rest
are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import stored

#: Words of a task that are counted before they are handed on.
HELD = 200_000
#: Shortest and longest grams. With marks at both ends a word of 6 code points has 2 * LONG places, so
#: whatever is edited, the first or the last gram stays as it is.
SHORT, LONG = 2, 4
#: A gram is extended if more than one of SHARE grams of its length is this one, and an extension counts
#: if it has a sixteenth of that: at most 16 * SHARE grams of each length are in the dictionary.
SHARE = 20_000
BEGIN, END = "^", "$"

#: The letters A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z became a-z.
LETTERS = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


def edited(doc_id, word: bytes, every: int) -> bytes:
    """The word, without one code point where ``every`` divides the checksum of id and word."""
    check = zlib.crc32(b"%d:%b" % (doc_id, word))
    if check % every:
        return word
    text = word.decode()
    at = check % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs: DataFrame, least: int = 6, every: int | None = None) -> DataFrame:
    """word and n of every distinct word of ``docs`` (doc_id, text) with at least ``least`` code points.

    ``every``: where it divides the unsigned CRC-32 of `doc_id:word`, the word loses the code point at that
    checksum modulo its length, before its length counts; rows without an id keep all words.
    """

    def run(batches):
        total: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                for word, n in Counter(LETTERS.findall(text.encode().lower())).items():
                    if len(word) < least:
                        continue
                    if every and doc_id is not None:
                        word = edited(doc_id, word, every)
                    if word.isascii():
                        if len(word) >= least:
                            total[word] += n
                    elif len(word.decode()) >= least:
                        total[word] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The dictionary's grams, each with the number of its places: the short ones, and extensions of frequent ones.

    Counted in Spark; its size is bounded by the alphabet's square and 16 * ``SHARE`` for each longer length.
    """
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    places = F.transform(F.sequence(F.lit(1), F.length(marked) - (SHORT - 1)), lambda i: F.struct(*[F.substring(marked, i, F.lit(k)).alias(f"g{k}") for k in range(SHORT, LONG + 1)]))
    rows = words.select(F.explode(places).alias("g")).select("g.*")
    kinds = F.explode(F.array(*[F.struct(F.col(f"g{k}").alias("gram"), F.lit(k).alias("k")) for k in range(SHORT, LONG + 1)]))
    counts = rows.select(kinds.alias("x")).select("x.*").filter(F.length("gram") == F.col("k")).groupBy("gram", "k").count()
    counts = stored(counts, "grams")
    total = counts.groupBy().pivot("k", list(range(SHORT, LONG + 1))).agg(F.sum("count")).first()
    found, frequent = {}, None
    for k in range(SHORT, LONG + 1):
        limit = (total[str(k)] or 0) // SHARE
        level = counts.filter((F.col("k") == k) & (F.col("count") >= (0 if k == SHORT else limit // 16)))
        if frequent is not None:
            level = level.join(frequent, F.substring("gram", 1, k - 1) == F.col("extended"), "left_semi")
        rows = level.select("gram", "count").toArrow()
        found |= dict(zip(rows["gram"].to_pylist(), rows["count"].to_pylist()))
        frequent = level.filter(F.col("count") > limit).select(F.col("gram").alias("extended"))
    return found


class Grams:
    """Decomposition by one dictionary, and what an edit can affect."""

    def __init__(self, dictionary: dict[str, int]):
        self.count = dictionary
        longer = [g for g in dictionary if len(g) > SHORT]
        #: What a longer gram of the dictionary may begin with, and hold behind its first code point.
        self.heads = {g[:k] for g in longer for k in range(2, len(g))}
        self.inner = {g[i:k] for g in longer for i in range(1, len(g) - 1) for k in range(i + 1, len(g) + 1)}

    def decompose(self, marked: str) -> list[tuple[int, int]]:
        """(first, last) place of each gram."""
        found, reach, n = [], -1, len(marked)
        for p in range(n - SHORT + 1):
            size = next((k for k in range(min(LONG, n - p), SHORT, -1) if marked[p : p + k] in self.count), SHORT)
            if p + size - 1 > reach:
                reach = p + size - 1
                found.append((p, reach))
        return found

    def affected(self, marked: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit between the marks can affect.

        An edit affects the grams that it lies in. A gram to its left may come to lie inside a longer one that
        begins at or before it and reaches the edit, a gram to its right inside one that begins at or before the
        edit: only if the dictionary has a gram with the text between.
        """
        most, n = 0, len(marked)
        for i in range(1, n):
            # what is left of i may be extended from here on
            left = min((p for p in range(max(0, i - LONG + 1), i - 1) if marked[p:i] in self.heads), default=n)
            for right in (i + 1, i) if i < n - 1 else (i,):  # i is replaced or deleted; something comes in before i
                hit = 0
                for p, e in grams:
                    if e < i:
                        hit += p >= left
                    elif p >= right:
                        hit += e - right + 1 < LONG and marked[right : e + 1] in self.inner
                    else:
                        hit += 1
                most = max(most, hit)
        return most

    def entries(self, word: str) -> tuple[list[str], int, list[int]]:
        """The word's grams (repeats numbered), how many of them a near word shares, and the keys to look it up by."""
        marked = BEGIN + word + END
        grams = self.decompose(marked)
        bound = self.affected(marked, grams)
        texts = [marked[p : e + 1] for p, e in grams]
        seen: Counter = Counter()
        numbered = []
        for g in texts:
            numbered.append(f"{g}{seen[g]}")
            seen[g] += 1
        order = sorted(set(texts), key=lambda g: (self.count.get(g, 0), g))
        kept, used = set(), 0
        for g in order:
            if used > bound:
                break
            kept.add(g)
            used += seen[g]
        keys = set()
        for (p, e), g in zip(grams, texts):
            if g in kept:
                keys.add(key(f"l{len(g)}" + marked[: e + 1]))
                keys.add(key(f"r{len(g)}" + marked[p:]))
        return numbered, len(grams) - bound, sorted(keys)


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def index_words(words: DataFrame) -> DataFrame:
    """``words`` (word) with grams, shared (how many of them a near word has at least) and keys."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))

    def run(batches):
        grams = Grams(shared.value)
        for batch in batches:
            found = [grams.entries(w) for w in batch.column(0).to_pylist()]
            columns = zip(*found) if found else [[]] * 3
            kinds = (pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=["word", "grams", "shared", "keys"])

    return words.select("word").mapInArrow(run, "word string, grams array<string>, shared int, keys array<bigint>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): the distinct ``words`` that differ by one inserted, deleted or replaced code point, each pair once, the shorter or smaller first.

    Words have at least 6 code points and none of the two marks.
    """
    index = stored(index_words(words), "gram-index").withColumn("size", F.length("word"))
    listed = index.select("word", "size", F.explode("keys").alias("key"))
    asked = listed.select(F.col("word").alias("a"), "key", F.col("size").alias("own"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    lists = listed.select(F.col("word").alias("b"), "key", "size")
    met = asked.join(lists, ["key", "size"]).filter((F.col("own") < F.col("size")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    of = lambda side: index.select(F.col("word").alias(side), F.col("grams").alias(f"{side}_grams"), F.col("shared").alias(f"{side}_shared"))
    both = met.join(of("a"), "a").join(of("b"), "b")
    merged = both.filter(F.size(F.array_intersect("a_grams", "b_grams")) >= F.greatest("a_shared", "b_shared"))
    return merged.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, form; no cycles) lead to. Paths double in length each round."""
    roots = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def group_variants(docs: DataFrame, every: int | None = None, least: int = 6, fewest: int = 5, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text).

    Words are runs of the letters A-Z, a-z, U+00C0 to U+00FF with A-Z lower-cased, of at least ``least`` code points (6 or
    more) and ``fewest`` occurrences. A word's form is its near word of most occurrences (ties: the smallest in code-point
    order) if that has ``times`` as many as the word, and its root the last form that its forms lead to, or itself.
    Null and empty texts have no words, repeated rows count each, other columns are left aside; no words give an
    empty table. ``every``: see :func:`count_words`.
    """
    if least + 2 < 2 * LONG or times < 2:
        raise ValueError("words are too short for the grams, or forms could lead in a circle")
    words = stored(count_words(docs, least, every).filter(F.col("n") >= fewest), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.minus") >= times * F.col("n"), -F.col("best.minus")))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n")
    rows = stored(rows, "forms")
    return rows.join(follow(rows.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
