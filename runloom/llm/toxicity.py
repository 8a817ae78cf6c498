"""Toxicity by class-conditional Kneser-Ney models.

Two models give the letters of a word, one learned from toxic and one from ordinary documents. The
highest order has counts of its own class; below it both back off to the same continuation counts,
gathered from every text of the corpus, so an expression that is rare in a class is judged by what is
common to all. A text's features are its log-likelihood ratio per word, over the whole text and over
its most toxic stretches; a logistic curve fitted across folds turns them into a probability.

Counts of the classes come from a bounded sample of labelled rows. The corpus counts grow with the
corpus and stay in Spark tables; of them the driver sees the probabilities of the sample's n-grams
only, as an n-gram that neither class has seen gets the same shared probability in both models and
that cancels out. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import by_size, extend, stored, texts

WORDS = re.compile(r"\w+")
#: Letters of the highest order, and what stands before and after a word.
ORDER, BEFORE, AFTER = 6, "\x02", "\x03"
#: Labelled documents of each class that the models are fitted on: the bound of what the driver sees.
SAMPLE = 3_000
#: Words of the stretches whose mean counts besides the whole text's.
STRETCHES = (1, 6, 24)
FEATURES = len(STRETCHES) + 2
#: Scores of words kept per worker.
MEMO = 200_000
#: Corpus n-grams that a task holds before it hands them on, and letters of a word it remembers as done.
HELD, SHORT = 100_000, 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts


def _hashes(codes: np.ndarray) -> np.ndarray:
    """One number for each row of letters."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out = (out ^ (codes[:, j].astype(np.uint64) + np.uint64(1))) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_grams(words: Counter) -> Counter:
    grams: Counter = Counter()
    for word, n in words.items():
        padded = BEFORE * (ORDER - 1) + word + AFTER
        for i in range(len(word) + 1):
            grams[padded[i : i + ORDER]] += n
    return grams


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of the n-grams seen, and of an unseen letter after a context seen."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's log-likelihood under the toxic model less that under the ordinary one."""
        if not words or not len(self.grams):
            return np.zeros(len(words))
        pad = BEFORE * (ORDER - 1)
        codes = _codes("".join(f"{pad}{w}{AFTER}" for w in words))
        sizes = np.array([len(w) + ORDER for w in words])
        ends = np.cumsum(sizes)
        at = np.arange(len(codes) - ORDER + 1)
        inside = np.ones(len(codes), bool)
        for k in range(1, ORDER):
            inside[ends[:-1] - k] = False  # windows that reach into the next word
        at = at[inside[: len(at)]]
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at]
        found = _lookup(self.grams, self.gram_ratio, _hashes(windows))
        missing = np.isnan(found)
        found[missing] = np.nan_to_num(_lookup(self.contexts, self.context_ratio, _hashes(windows[missing, :-1])))
        starts = np.r_[0, np.cumsum(sizes - ORDER + 1)[:-1]]
        return np.add.reduceat(found, starts)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


def model_ratios(counts: DataFrame, pairs: list[tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """For each pair of a toxic and an ordinary count column of ``counts`` (gram, shared) the models' log-likelihood ratios.

    One table of n-grams and one of contexts, as (key, r0, r1 ...): the hash, and for each pair the ratio or null where
    neither class has the n-gram or context. Absolute discounting; what it leaves goes to ``shared``.
    """
    names = [f"{side}{k}" for k in range(len(pairs)) for side in "to"]
    rows = counts.select("gram", "shared", F.substring("gram", 1, ORDER - 1).alias("context"), *[c.alias(f"{side}{k}") for k, pair in enumerate(pairs) for side, c in zip("to", pair)])
    once_twice = rows.agg(*[F.count_if(F.col(n) == m).alias(f"{n}_{m}") for n in names for m in (1, 2)]).first()
    share = {n: once_twice[f"{n}_1"] / (once_twice[f"{n}_1"] + 2 * once_twice[f"{n}_2"]) if once_twice[f"{n}_1"] else 0.5 for n in names}
    contexts = rows.groupBy("context").agg(*[F.sum(n).alias(f"{n}_total") for n in names], *[F.count_if(F.col(n) > 0).alias(f"{n}_kinds") for n in names])
    back = lambda n: F.when(F.col(f"{n}_total") > 0, share[n] * F.col(f"{n}_kinds") / F.col(f"{n}_total")).otherwise(1.0)
    own = lambda n: F.greatest(F.col(n) - share[n], F.lit(0.0)) / F.greatest(F.col(f"{n}_total"), F.lit(1)) + back(n) * F.col("shared")
    log_back = lambda n: F.log(F.greatest(back(n), F.lit(1e-9)))
    log_own = lambda n: F.log(F.greatest(own(n), F.lit(1e-12)))

    def keyed(df: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                codes = [_codes(n) for n in batch.column(0).to_pylist()]
                keys = _hashes(np.stack(codes)).view(np.int64) if codes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns[1:]], names=["key", *batch.schema.names[1:]])

        return df.mapInArrow(run, "key bigint, " + ", ".join(f"r{k} double" for k in range(len(pairs))))

    some = lambda k, end="": F.col(f"t{k}{end}") + F.col(f"o{k}{end}") > 0
    grams = rows.join(contexts, "context").select("gram", *[F.when(some(k), log_own(f"t{k}") - log_own(f"o{k}")).alias(f"r{k}") for k in range(len(pairs))])
    return keyed(grams), keyed(contexts.select("context", *[F.when(some(k, "_total"), log_back(f"t{k}") - log_back(f"o{k}")).alias(f"r{k}") for k in range(len(pairs))]))


def fit_words(counts: DataFrame, pairs: list[tuple[Column, Column]]) -> list[Model]:
    """A pair of models for each pair of count columns. The driver gets hashes and ratios of the sample's n-grams, no text."""
    tables = []
    for df in model_ratios(counts, pairs):
        rows = df.toArrow()
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tables.append((keys[order], [rows[f"r{k}"].to_numpy()[order] for k in range(len(pairs))]))
    models = []
    for k in range(len(pairs)):
        packed = []
        for keys, ratios in tables:
            known = ~np.isnan(ratios[k])
            packed += [keys[known], ratios[k][known]]
        models.append(Model(*packed))
    return models


class Scorer:
    """Features of texts, each distinct word scored once while the memo holds."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def features(self, rows: list[str]) -> np.ndarray:
        split = [WORDS.findall(t.lower()) for t in rows]
        new = list(set().union(*split) - self.memo.keys()) if split else []
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(set().union(*split))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.memo.update(zip(part, self.model.words(part).tolist()))
        return np.array([self._text(words) for words in split]).reshape(len(rows), FEATURES)

    def _text(self, words: list[str]) -> tuple[float, ...]:
        """Ratio per distinct word: of the whole text and of its most toxic stretches; the second best single word shows whether it stands alone."""
        if not words:
            return (0.0,) * FEATURES
        own = list(dict.fromkeys(words))  # a repeated line or word speaks once
        ratio = np.fromiter(map(self.memo.__getitem__, own), float, len(own))
        sums = np.r_[0, np.cumsum(ratio)]
        stretches = [float((sums[w:] - sums[:-w]).max()) if w <= len(own) else float(sums[-1]) for w in STRETCHES]
        second = float(np.partition(ratio, -2)[-2]) if len(own) > 1 else 0.0
        return (sums[-1] / len(own), *[s / w for s, w in zip(stretches, STRETCHES)], second)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features, and the weights with the constant last (Newton's method)."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * len(x) * np.r_[w[:-1], 0]
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return middle, spread, w


def probability(x: np.ndarray, curve) -> np.ndarray:
    middle, spread, w = curve
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - middle) / spread, np.ones(len(x))] @ w, -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, sample: int) -> DataFrame:
    """text, label, fold and weight of at most ``sample`` labelled documents of each class, the smallest by hash of the id.

    Rows whose remainder is ``held_out`` are never taken. weight undoes the choice: labelled rows of
    the class over those taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), parts) != held_out)).select("doc_id", F.col(label).alias("label")).dropDuplicates(["doc_id"])
    known = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    one = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("weight", F.lit(max(1.0, counts.get(c, 0) / sample)))
    chosen = one(0).unionByName(one(1))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", (F.xxhash64("doc_id", F.lit("fold")) % 2 == 0).cast("int").alias("fold"), "weight")


GRAMS = T.StructType([T.StructField("gram", T.StringType()), *[T.StructField(f"c{k}", T.LongType()) for k in range(4)]])


def gram_counts(sample: DataFrame) -> DataFrame:
    """Documents with each n-gram's words by fold and class: a word counts once a document, so repeated lines don't weigh more."""

    def run(batches):
        for batch in batches:
            words = [Counter() for _ in range(4)]
            for text, label, fold in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words[2 * fold + label].update(set(WORDS.findall(text.lower())))
            grams = [word_grams(w) for w in words]
            names = list(set().union(*grams))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([g[n] for n in names], pa.int64()) for g in grams]], names=GRAMS.names)

    counted = sample.select("text", "label", "fold").mapInArrow(run, GRAMS)
    return counted.groupBy("gram").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])


def corpus_grams(docs: DataFrame) -> DataFrame:
    """Every n-gram of the highest order in the words of all texts, repeats dropped within a task only."""

    def run(batches):
        done, found = set(), set()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["gram"])
        for batch in batches:
            for text in texts(batch.column(0)):
                new = set(WORDS.findall(text.lower())) - done
                done.update(w for w in new if len(w) <= SHORT)
                for word in new:
                    padded = BEFORE * (ORDER - 1) + word + AFTER
                    for a in range(0, len(word) + 1, HELD):
                        found.update(padded[i : i + ORDER] for i in range(a, min(a + HELD, len(word) + 1)))
                        if len(found) > HELD:
                            yield out()
                            found = set()
                if len(done) > MEMO:
                    done = set()
        yield out()

    return docs.select("text").mapInArrow(run, "gram string")


def shared_counts(docs: DataFrame) -> dict[int, DataFrame]:
    """By order, below the highest: of how many distinct longer n-grams of the whole corpus each n-gram is the end (gram, n)."""
    levels, above = {}, corpus_grams(docs).distinct()
    for k in range(ORDER - 1, 0, -1):
        above = levels[k] = stored(above.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"shared-{k}")
    return levels


def with_shared(grams: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """``grams`` (gram, of the highest order) with ``shared``, the probability of the last letter after all but the first.

    Kneser-Ney over ``levels``: each order's discounted share of its context, and the next lower order for the rest. Each order
    is stored: as one plan they would be planned anew, whole, on the driver after every stage.
    """
    rare = [level.agg(F.lit(k).alias("k"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")) for k, level in levels.items() if k > 1]
    discount = {r["k"]: r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] else 0.5 for r in reduce(DataFrame.unionAll, rare).collect()}
    for k in sorted(levels):
        level, last = levels[k], F.substring("gram", ORDER - k + 1, k)
        of_context = level.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = grams.select(last.alias("gram")).distinct().join(level, "gram").withColumn("context", F.substring("gram", 1, k - 1)).join(of_context, "context")
        if k == 1:
            below = stored(rows.select("gram", ((F.col("n") + 1) / (F.col("total") + F.col("kinds") + 1)).alias("shared")), "backoff-1")
            continue
        d = discount[k]
        rows = rows.withColumn("lower", F.substring("gram", 2, k - 1)).join(below.select(F.col("gram").alias("lower"), F.col("shared").alias("rest")), "lower")
        below = stored(rows.select("gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("rest")).alias("shared")), f"backoff-{k}")
    return grams.withColumn("last", F.substring("gram", 2, ORDER - 1)).join(below.withColumnRenamed("gram", "last"), "last").drop("last")


@dataclass(frozen=True)
class Classifier:
    model: Model
    curve: tuple[np.ndarray, np.ndarray, np.ndarray]


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Classifier | None:
    """The models and the curve from ``labels`` (doc_id, toxic) and the texts of all ``docs``; None without both classes.

    Each fold is scored by the models of the other one, and the curve is fitted on these scores. Rows without an id are never
    labelled but count for the corpus, as do empty and repeated texts (an n-gram counts once whatever holds it); of several
    labels of one id one counts. Other columns are left aside; no rows or no labels give None.
    """
    chosen = stored(sample_of(docs, labels, "toxic", parts, held_out, sample), "labelled")
    counts = stored(with_shared(stored(gram_counts(chosen), "class-counts"), shared_counts(docs)), "class-shared")
    c = [F.col(f"c{k}") for k in range(4)]
    any_toxic, any_ordinary = counts.agg(F.sum(c[1] + c[3]), F.sum(c[0] + c[2])).first()
    if not any_toxic or not any_ordinary:
        return None
    *by_fold, whole = fit_words(counts, [(c[3], c[2]), (c[1], c[0]), (c[1] + c[3], c[0] + c[2])])
    shared, features = docs.sparkSession.sparkContext.broadcast(by_fold), [f"x{k}" for k in range(FEATURES)]

    def cross(batches):
        scorers = [Scorer(m) for m in shared.value]
        for batch in batches:
            rows, folds = texts(batch.column(0)), np.array(batch.column(2).to_pylist(), int)
            x = np.stack([s.features(rows) for s in scorers])[folds, np.arange(len(rows))] if rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(FEATURES)], batch.column(1), batch.column(3)], names=[*features, "label", "weight"])

    scored = chosen.mapInArrow(cross, ", ".join(f"{n} double" for n in features) + ", label int, weight double").toArrow()
    label = scored["label"].to_numpy().astype(float)
    if len(np.unique(label)) < 2:
        return None
    curve = fit_logistic(np.stack([scored[n].to_numpy() for n in features], axis=1), label, scored["weight"].to_numpy())
    return Classifier(whole, curve)


def score(docs: DataFrame, classifier: Classifier | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic in ``into``; without a classifier it is 0. A null text is empty.

    Every row is scored by itself, so repeated rows get equal scores, and an empty table stays empty. A column named as ``into``
    is replaced, all others are kept.
    """
    if classifier is None:
        return docs.withColumn(into, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    scorer: list[Scorer] = []

    def compute(column):
        if not scorer:
            scorer.append(Scorer(shared.value.model))
        rows = texts(column)
        # a few documents at a time keep the sets of new words small
        parts = [scorer[0].features(part) for part in by_size(rows, 500)]
        return [pa.array(probability(np.concatenate(parts), shared.value.curve) if parts else np.zeros(0), pa.float64())]

    return extend(docs, [text], [T.StructField(into, T.DoubleType())], compute)
