"""Document fingerprints by consistent weighted sampling.

A text is a bag of words weighted by their counts. For sample k every word draws r and c from
Gamma(2, 1) and b uniformly; with t = floor(ln w / r + b) the word with the smallest
ln c - r (t - b) - r is sampled, and (word, t) is the k-th element of the fingerprint. Two texts agree
in an element with the probability of their generalised Jaccard similarity, sum of smaller weights
over sum of larger ones. The draws come from a pool of 65,536 entries; a word reads a different entry
for every sample, by two parts of its hash, so they are computed once and never stored by word.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import extend, texts

#: Elements of a fingerprint; 16 bits of each are kept, so unlike elements agree once in 65,536 times.
SAMPLES = 64
#: Words weighed at once: the bound of the arrays in a task, unless one text has more distinct words.
STEP = 100_000

_draw = np.random.default_rng(20_240)
_R, _LOG_C, _B = _draw.gamma(2, 1, 65_536), np.log(_draw.gamma(2, 1, 65_536)), _draw.random(65_536)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers as integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


#: What a word of weight 1 gets: t is 0.
_ONCE = _ordered(_LOG_C + _R * _B - _R)


def _signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    start, step = hashes.astype(np.uint16), (hashes >> np.uint64(16)).astype(np.uint16) | np.uint16(1)
    name = hashes >> np.uint64(32)
    many = np.flatnonzero(weights > 1)
    log_w = np.log(weights[many])
    out = np.empty((len(starts), SAMPLES), np.uint16)
    for k in range(SAMPLES):
        at = start + np.uint16(k) * step
        packed = _ONCE[at] | name
        r, b = _R[at[many]], _B[at[many]]
        t = np.floor(log_w / r + b)
        # the element's name depends on t as well
        own = (name[many] ^ (t.astype(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
        packed[many] = _ordered(_LOG_C[at[many]] - r * (t - b) - r) | own
        out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint16)
    return out


def signatures(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each text's fingerprint, and whether it has any word."""
    out, filled = np.zeros((len(rows), SAMPLES), np.uint16), np.zeros(len(rows), bool)
    hashes, weights, starts, docs = [], [], [], []

    def flush():
        if docs:
            out[docs] = _signatures(np.array(hashes, np.uint64), np.array(weights, np.float64), np.array(starts))
            for held in (hashes, weights, starts, docs):
                held.clear()

    for i, text in enumerate(rows):
        counts = Counter(text.encode().split())
        if counts:
            filled[i] = True
            starts.append(len(hashes))
            docs.append(i)
            hashes += map(xxhash.xxh64_intdigest, counts)
            weights += counts.values()
            if len(hashes) >= STEP:
                flush()
    flush()
    return out, filled


def _hex(elements: np.ndarray, filled: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() if full else "" for row, full in zip(elements, filled)]


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of equal elements; two texts without words are alike."""
    both, none = a[1] & b[1], ~a[1] & ~b[1]
    return np.where(both, (a[0] == b[0]).mean(1), none.astype(float))


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of the whole text: four hexadecimal digits an element, none without words (null is empty)."""
    return extend(df, [text], [T.StructField(into, T.StringType())], lambda column: [pa.array(_hex(*signatures(texts(column))), pa.string())])


def likeness(a, b):
    """Estimated generalised Jaccard similarity of two fingerprint columns."""
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), lambda n, k: n + F.when(F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4)), 1).otherwise(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / SAMPLES)


OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successor(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its text edited with the next one's, and their likeness.

    The next document is that of the next smaller doc_id (null ids last, rows of one id by text), and
    after the last comes the first; a single row follows itself. Documents are dealt by ranges of
    doc_id between exact ids; the row that opens a range also closes the range before it, so one
    exchange brings neighbours together and no task sees more than its range. A null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions")) * 3
    first, found = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / count for i in range(1, count)], F.lit(10_000))).first()
    edges = np.array(sorted({s for s in found or [] if s < first}), np.int64)
    last, none = len(edges), first is None

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        """Twice the row's range, plus one where the row closes a range."""
        value = ids.to_numpy(np.float64, na_value=np.nan) if ids.isna().any() else ids.to_numpy(np.int64)
        missing = np.isnan(value) if value.dtype == np.float64 else np.zeros(len(ids), bool)
        exact = ids.fillna(0).to_numpy(np.int64) if missing.any() else value
        at = np.where(missing, last, last - np.searchsorted(edges, exact, "left"))
        opens = np.isin(exact, edges) & ~missing
        top = np.full(len(ids), none) if none else (exact == first) & ~missing
        return pd.Series([[2 * a, *([2 * a - 1] if o else []), *([2 * last + 1] if t else [])] for a, o, t in zip(at.tolist(), opens.tolist(), top.tolist())])

    placed = rows.withColumn("place", F.explode(ranges("doc_id")))
    placed = placed.withColumn("range", F.shiftright("place", 1)).repartition(F.col("range")).sortWithinPartitions("place", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        held: list = []
        for batch in batches:
            ids, whole, place = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(ids), 512):
                now = [*held, *zip(ids[a : a + 512], whole[a : a + 512], place[a : a + 512])]
                held = [now[-1]]
                yield from solve(now)

    def solve(now: list):
        pairs = [i for i in range(len(now) - 1) if now[i][2] % 2 == 0 and now[i + 1][2] // 2 == now[i][2] // 2]
        if not pairs:
            return
        own = signatures([text for _, text, _ in now])
        changed = [edited(now[i][1], now[i + 1][1]) for i in pairs]
        new = signatures(changed)
        here, after = (own[0][pairs], own[1][pairs]), (own[0][[i + 1 for i in pairs]], own[1][[i + 1 for i in pairs]])
        yield pa.RecordBatch.from_arrays([
            pa.array([now[i][0] for i in pairs], pa.int64()), pa.array([len(now[i][1]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(*here)), pa.array(_hex(*new)),
            pa.array(_likeness(here, new)), pa.array(_likeness(here, after)),
        ], names=OUT.names)

    return placed.select("doc_id", "text", "place").mapInArrow(run, OUT)
