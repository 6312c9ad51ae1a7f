"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the hashed words and word beginnings of a
text and the probabilities of the categories before it. For training, those probabilities come from
models that did not see the row (out of fold), so a later model learns how far earlier ones can be
trusted on new texts; for scoring, from models fitted on all training rows.

Models are fitted on at most ``SAMPLE`` labelled documents, the ones with the smallest key hashes; their
hashed features, a few numbers per distinct word, are all that passes through the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import claim_cache, give_back_memory

SAMPLE = 6_000
FOLDS = 3
FEATURES = 1 << 18
STEM = 4
MIN_TEXTS = 5
ROUNDS = 60
SELECT_STEP, REFIT_STEP = 0.3, 0.5
LASSO = 3e-3
SUPPORT = 0.05
RIDGE = 1e-4
THRESHOLD = 0.3
CACHE_WORDS = 250_000
#: Category and its training label; the labels tell toxic texts only as such, so the first two split them by language.
CATEGORIES = (("toxic_en", "toxic = 1 AND lang = 'en'"), ("toxic_other", "toxic = 1 AND NOT lang <=> 'en'"), ("toxic", "toxic = 1"))

_WORD = re.compile(r"[^\W\d_]+")
_feature_cache: dict[str, tuple[int, int]] = {}


def _hash(term: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term.encode()) % (FEATURES - 1)


def features(text: str | None) -> np.ndarray:
    """Two numbers per distinct lower-case word: the word's and its first ``STEM`` letters' (short words repeat theirs)."""
    words = set(_WORD.findall((text or "").lower()))
    if len(_feature_cache) > CACHE_WORDS:
        _feature_cache.clear()
    out = []
    for word in words:
        pair = _feature_cache.get(word)
        if pair is None:
            pair = _feature_cache[word] = (_hash(word), _hash("^" + word[:STEM]) if len(word) > STEM else FEATURES - 1)
        out.append(pair)
    return np.sort(np.array(out, np.int32).reshape(-1))


def _sums(weights: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row; rows lie between consecutive starts and may be empty."""
    total = np.concatenate([[0.0], np.cumsum(weights[index])])
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """Logistic model over hashed features and a few dense columns.

    Features of fewer than ``MIN_TEXTS`` texts are left out. A first fit with an absolute penalty chooses
    the features that matter, a second one without it gives their weights.
    """

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    @classmethod
    def fit(cls, index: np.ndarray, starts: np.ndarray, dense: np.ndarray, y: np.ndarray) -> "Linear":
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
        model = cls(np.zeros(FEATURES), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
        if not 0 < y.sum() < len(y):
            return model  # a single class: its rate is all there is to learn
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
        pairs = np.unique(index.astype(np.int64) * len(y) + row)
        allowed = np.bincount(pairs // len(y), minlength=FEATURES) >= MIN_TEXTS
        allowed[FEATURES - 1] = False  # stands for "no stem"
        model._descend(index, row, dense, y, allowed, SELECT_STEP, LASSO, 0.0)
        support = np.abs(model.weights) > SUPPORT
        model = cls(np.zeros(FEATURES), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
        model._descend(index, row, dense, y, support, REFIT_STEP, 0.0, RIDGE)
        return model

    def _descend(self, index, row, dense, y, allowed, step, lasso, ridge) -> None:
        """Full-batch gradients, each weight with its own adaptive step; ``lasso`` shrinks weights to 0."""
        use = allowed[index]
        index, row = index[use], row[use]
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
        square, square_dense, square_bias = np.full(FEATURES, 1e-8), np.full(len(self.dense), 1e-8), 1e-8
        for _ in range(ROUNDS):
            error = (self.score(index, starts, dense) - y) / len(y)
            gradient = np.bincount(index, error[row], FEATURES) + ridge * self.weights
            gradient_dense, gradient_bias = dense.T @ error + ridge * self.dense, error.sum()
            square += gradient**2
            square_dense += gradient_dense**2
            square_bias += gradient_bias**2
            pace = step / np.sqrt(square)
            self.weights -= pace * gradient * allowed
            self.weights = np.sign(self.weights) * np.maximum(np.abs(self.weights) - lasso * pace, 0)
            self.dense -= step * gradient_dense / np.sqrt(square_dense)
            self.bias -= step * gradient_bias / np.sqrt(square_bias)

    def score(self, index: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return _sigmoid(_sums(self.weights, index, starts) + dense @ self.dense + self.bias)


def fit_chain(index: np.ndarray, starts: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """A model per label column; later ones get the earlier ones' out-of-fold probabilities."""
    models, dense = [], np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(Linear.fit(index, starts, dense, y))
        out = np.zeros(len(y))
        for f in range(FOLDS if k + 1 < labels.shape[1] else 0):
            held, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            part = Linear.fit(*_rows(index, starts, others), dense[others], y[others])
            out[held] = part.score(*_rows(index, starts, held), dense[held])
        dense = np.column_stack([dense, out])
    return models


def _rows(index: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)[chosen]
    new = np.concatenate([[0], np.cumsum(sizes)])
    return index[np.repeat(starts[chosen] - new[:-1], sizes) + np.arange(new[-1])], new


def score_chain(models: list[Linear], index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A probability per row and category; a text without words is no evidence of anything and gets 0."""
    dense, worded = np.zeros((len(starts) - 1, 0)), np.diff(starts) > 0
    for model in models:
        dense = np.column_stack([dense, np.where(worded, model.score(index, starts, dense), 0.0)])
    return dense


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, lang, toxic`` of at most ``sample`` labelled documents; of a repeated key one row is used."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most ``sample`` keys are broadcast


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> list[Linear]:
    """The chain, fitted on the bounded sample."""

    def work(batches):
        claim_cache("toxicity", _feature_cache.clear)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], ["f", "fold", *names])

    names = [f"y{k}" for k in range(len(categories))]
    rows = labelled(docs, labels, sample)
    rules = [F.coalesce(F.expr(rule).cast("double"), F.lit(0.0)).alias(name) for name, (_, rule) in zip(names, categories)]
    rows = rows.select("text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), *rules)
    found = rows.mapInArrow(work, "f array<int>, fold long, " + ", ".join(f"{n} double" for n in names)).toArrow()
    lists = found.column("f").combine_chunks()
    index = lists.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(np.array([len(x) for x in lists], np.int64))]) if len(lists) else np.zeros(1, np.int64)
    y = np.column_stack([found.column(n).to_numpy() for n in names])
    models = fit_chain(index, starts, y, found.column("fold").to_numpy())
    del found, lists, index
    give_back_memory()  # the fit runs in the driver, which stays small
    return models


def score(docs: DataFrame, models: list[Linear], categories=CATEGORIES) -> DataFrame:
    """``doc_id`` and a probability per category for every row."""
    names = [name for name, _ in categories]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches):
        claim_cache("toxicity", _feature_cache.clear)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            starts = np.concatenate([[0], np.cumsum(np.array([len(x) for x in found], np.int64))])
            chance = score_chain(shared.value, np.concatenate(found) if found else np.zeros(0, np.int32), starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(chance[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Probabilities and ``kept`` per row: the last category, toxic at all, stays below the threshold.

    Null or empty text has no words, gets probability 0 and is kept. Null or repeated ``doc_id`` are scored
    row by row. Without labelled rows every row is kept. An empty table gives no rows. Other columns are
    ignored.
    """
    return score(docs, fit(docs, labels)).withColumn("kept", F.col("toxic") < threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns; texts do not move between tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        claim_cache("toxicity", _feature_cache.clear)
        found = [features(t) for t in text]
        starts = np.concatenate([[0], np.cumsum(np.array([len(x) for x in found], np.int64))])
        return pd.Series(score_chain(shared.value, np.concatenate(found) if found else np.zeros(0, np.int32), starts)[:, -1] < threshold)

    return docs.filter(clean(F.col("text").cast("string")))
