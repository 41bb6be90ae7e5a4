"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regression over word
presence. Each later model also sees the probabilities of the categories before it;
in training these come from models that didn't see the row (out of fold), so that
they look as they will in prediction. Labels give the last category, `toxic`, and the
first, `poor` (quality 0); those between are kinds of toxic rows, found by clustering
the labelled toxic rows by their words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import documents, free_name

#: Labelled rows that the model is fitted on, words that it may use, folds.
SAMPLE, FEATURES, FOLDS = 10_000, 512, 5
#: Texts whose words are held at a time.
ROWS = 64
#: A feature needs so many rows and so large a chi-square statistic.
LEAST_ROWS, LEAST_CHI = 4, 15.0
#: Beginnings of words are features too: inflected forms share them.
STEMS = (4, 5)
THRESHOLD = 0.5
#: Kinds of toxic rows, and rounds of clustering them.
KINDS, ROUNDS = 3, 10
WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    """The words of a text in lower case, and the stems of longer words, marked by a hyphen."""
    found = set(WORD.findall(text.lower())) if text else set()
    return found.union(*({w[:k] + "-" for w in found if len(w) > k} for k in STEMS))


@dataclass(frozen=True)
class Rows:
    """Sparse presence matrix with a constant column and dense extra columns."""

    row: np.ndarray
    col: np.ndarray
    n: int
    width: int
    extra: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        flat = np.bincount(self.row, weights=w[self.col], minlength=self.n) if len(self.row) else np.zeros(self.n)
        return flat + w[self.width] + self.extra @ w[self.width + 1 :]

    def back(self, g: np.ndarray) -> np.ndarray:
        flat = np.bincount(self.col, weights=g[self.row], minlength=self.width) if len(self.row) else np.zeros(self.width)
        return np.concatenate([flat, [g.sum()], self.extra.T @ g])

    def only(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        keep = new[self.row] >= 0
        return Rows(new[self.row[keep]], self.col[keep], len(rows), self.width, self.extra[rows])

    def with_extra(self, column: np.ndarray) -> Rows:
        return Rows(self.row, self.col, self.n, self.width, np.column_stack([self.extra, column]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Rows, y: np.ndarray, steps: int = 200, penalty: float = 2e-4) -> np.ndarray:
    """Weights by accelerated gradient descent; the classes weigh alike."""
    w = np.zeros(x.width + 1 + x.extra.shape[1])
    positive = y.mean() if len(y) else 0.0
    if positive in (0.0, 1.0):
        w[x.width] = -6.0 if positive == 0.0 else 6.0
        return w
    share = np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)) / len(y)
    per_row = np.bincount(x.row, minlength=x.n) + 1 + (x.extra**2).sum(axis=1) if len(x.row) else np.ones(x.n)
    rate = 4.0 / max(float(np.quantile(per_row, 0.95)), 1.0)
    ridge = np.full(len(w), penalty)
    ridge[x.width] = 0.0
    ahead, before = w.copy(), w
    for t in range(1, steps + 1):
        grad = x.back(share * (_sigmoid(x.dot(ahead)) - y)) + ridge * ahead
        now = ahead - rate * grad
        ahead = now + (t - 1) / (t + 2) * (now - before)
        before = now
    return before


@dataclass(frozen=True)
class Chain:
    words: Mapping[str, int]
    names: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def matrix(self, texts: list[str | None]) -> Rows:
        return self.matrix_of([word_set(t) for t in texts])

    def matrix_of(self, word_sets: list[set[str]]) -> Rows:
        rows, cols = [], []
        for i, own in enumerate(word_sets):
            for word in self.words.keys() & own:
                rows.append(i)
                cols.append(self.words[word])
        return Rows(np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), len(word_sets), len(self.words), np.zeros((len(word_sets), 0)))

    def probabilities(self, x: Rows) -> np.ndarray:
        out = []
        for w in self.weights:
            out.append(_sigmoid(x.dot(w)))
            x = x.with_extra(out[-1])
        return np.column_stack(out)


def fit_chain(x: Rows, words: Mapping[str, int], targets: Mapping[str, np.ndarray], folds: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain over `targets` in order, and its out-of-fold probabilities."""
    weights, seen = [], []
    for y in targets.values():
        held = np.zeros(x.n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(outside):
                held[outside] = _sigmoid(x.only(outside).dot(logistic(x.only(inside), y[inside])))
        weights.append(logistic(x, y))
        seen.append(held)
        x = x.with_extra(held)
    return Chain(dict(words), tuple(targets), tuple(weights)), np.column_stack(seen)


def kinds(x: Rows, toxic: np.ndarray, k: int = KINDS) -> np.ndarray:
    """The kind (0 to k - 1) of each toxic row, -1 of others: spherical k-means over the words, from farthest-first starts."""
    out, at = np.full(x.n, -1), np.flatnonzero(toxic > 0)
    if not len(at) or not x.width:
        return out
    own = x.only(at)
    dense = np.zeros((own.n, own.width))
    dense[own.row, own.col] = 1.0
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    centres = dense[:1]
    while len(centres) < min(k, own.n):
        centres = np.vstack([centres, dense[(dense @ centres.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        nearest = (dense @ centres.T).argmax(axis=1)
        means = [dense[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]
        centres = np.array([m / max(np.linalg.norm(m), 1e-12) for m in means])
    out[at] = (dense @ centres.T).argmax(axis=1)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[Chain, pd.DataFrame]:
    """Fits on at most `sample` labelled documents (by hash of the id); also gives their ids, labels and out-of-fold probabilities.

    Labels (doc_id, toxic, quality) without a toxic value or a document are left out; an
    id that is labelled twice is toxic if one label says so, and poor if one says quality
    0. Of rows that repeat an id the one whose text has the least hash counts. The
    features are the words whose presence tells most about the label (chi-square),
    `features` at most.
    """
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.min("quality") == 0, F.lit(False)).cast("int").alias("poor"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "poor": part["poor"], "name": part["name"], "words": [sorted(word_set(t)) for t in part["text"]]})

    named = rows.withColumn("name", F.xxhash64("text"))
    one = named.groupBy("doc_id").agg(F.min("name").alias("name"))
    single = named.join(F.broadcast(one), ["doc_id", "name"]).dropDuplicates(["doc_id", "name"])
    labelled = single.select("doc_id", "toxic", "poor", "name", "text").mapInPandas(tokens, f"doc_id {kind}, toxic int, poor int, name long, words array<string>")
    n, n1 = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = labelled.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("a"), F.sum("toxic").cast("double").alias("b"))
    expected = F.col("a") * (n1 / max(n, 1))
    chi = F.pow(F.col("b") - expected, 2) / (expected * (F.lit(1.0) - F.col("a") / (n + 1.0)) + 1e-9)
    best = each.filter((F.col("a") >= LEAST_ROWS) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "word").limit(features).collect() if n1 else []
    words = {w: i for i, w in enumerate(sorted(r.word for r in best))}
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    held = labelled.select("doc_id", "toxic", "poor", F.array_intersect("words", wanted).alias("words")).orderBy("doc_id").collect()
    x = Chain(words, (), ()).matrix_of([set(r.words) for r in held])
    toxic, poor = (np.array([float(r[c]) for r in held]) for c in ("toxic", "poor"))
    found = kinds(x, toxic)
    targets = {"poor": poor} | {f"kind_{k + 1}": (found == k).astype(float) for k in range(KINDS)} | {"toxic": toxic}
    folds = np.array([hash_fold(r.doc_id) for r in held], dtype=int)
    fitted, out = fit_chain(x, words, targets, folds)
    return fitted, pd.DataFrame({"doc_id": [r.doc_id for r in held], "toxic": toxic} | {f"p_{k}": out[:, j] for j, k in enumerate(targets)})


def hash_fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs and p_<category> of every link and toxic (p_toxic of threshold or more).

    Whole texts count. Texts without known words, empty or null, get the chain's
    probabilities for no word. Repeated rows and other columns are kept; existing columns of
    these names are replaced. docs may be empty.
    """
    names = [f"p_{k}" for k in chain.names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [texts.iloc[at : at + ROWS].tolist() for at in range(0, len(texts), ROWS)] or [[]]
            yield pd.DataFrame(np.concatenate([shared.value.probabilities(shared.value.matrix(part)) for part in parts]), columns=names)

    base = docs.drop(*names, "toxic")
    found = free_name(docs, "_p")
    out = base.withColumn(found, predict("text"))
    return out.select(*base.columns, *[F.col(f"{found}.{n}").alias(n) for n in names], (F.col(f"{found}.p_toxic") >= threshold).alias("toxic"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).drop("text")
