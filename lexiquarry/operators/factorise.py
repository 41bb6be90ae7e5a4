"""Non-negative factorisation of document-word weights, with both factors as tables.

Documents lie in parts, words in slices of SLICE. In a round each part meets the slices
of the word factors, solves the factors of its documents and gives back products per
slice; products are summed by slice, and each slice's word factors are solved from the
sums. Both solutions are coordinate descents on a convex problem, so the loss falls from
round to round. Between rounds there are the word factors only: the documents' follow from
them. Several fits, told apart by `seed`, go through the same jobs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.operators.state import kept

SLICE = 2048
#: Documents of a part; their weights are a task's working set.
PART = 8192
CHUNK = 512
DOCUMENT_SWEEPS, WORD_SWEEPS = 40, 4
EPS = 1e-12


class Factors(NamedTuple):
    """documents: seed, key, topic, weight; words: seed, topic, word, weight; losses: per round, the squared error of each seed."""

    documents: DataFrame
    words: DataFrame
    losses: list[dict[int, float]]


def descend(x: np.ndarray, products: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
    """x (rows x k, not negative) moved towards least x gram x' / 2 - products x', one column at a time."""
    for _ in range(sweeps):
        for t in range(len(gram)):
            if gram[t, t] > EPS:
                x[:, t] = np.maximum(x[:, t] + (products[:, t] - x @ gram[:, t]) / gram[t, t], 0)
    return x


def _chunks(docs: pd.DataFrame):
    """(first, word numbers, weights, documents of the entries) of a few documents at a time."""
    for at in range(0, len(docs), CHUNK):
        part = docs.iloc[at : at + CHUNK]
        sizes = part["ids"].map(len).to_numpy()
        yield part, np.concatenate(part["ids"].to_list()), np.concatenate(part["weights"].to_list()), np.repeat(np.arange(len(part)), sizes)


def _stacked(slices: pd.DataFrame, k: int) -> np.ndarray:
    """The word factors, words x k, of slices in order."""
    return np.concatenate([np.frombuffer(h).reshape(-1, k) for h in slices.sort_values("slice")["h"]])


def _solved(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, h: np.ndarray, gram: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    products = np.add.reduceat(h[ids] * x[:, None], starts)
    return descend(products / max(np.trace(gram), EPS), products, gram, DOCUMENT_SWEEPS)


def nmf(weights: DataFrame, k: int, seed: int = 0, rounds: int = 600, tolerance: float = 1e-4, key: str = "row_id") -> Factors:
    """Factors of weights (key, word, weight, and seed where there are several fits), started at random by seed.

    Ends after rounds, or once no fit's loss falls by more than tolerance of its first
    one. A fit's vocabulary must be bounded (as tfidf bounds it): its words are numbered by
    one task, and a part's task holds words x k numbers. Documents without weights are
    in no row, words no topic uses have weight 0.
    """
    own = weights if "seed" in weights.columns else weights.withColumn("seed", F.lit(seed))
    own = own.withColumn("seed", F.col("seed").cast("int"))
    words = own.select("seed", "word").distinct().withColumn("id", (F.row_number().over(Window.partitionBy("seed").orderBy("word")) - 1).cast("int"))
    words = kept(words.withColumn("slice", F.expr(f"id div {SLICE}").cast("int")))
    parts = max(1, math.ceil(own.select("seed", key).distinct().count() / PART))
    entries = own.join(words.select("seed", "word", "id"), ["seed", "word"]).groupBy("seed", key).agg(F.collect_list(F.struct("id", F.col("weight").cast("double").alias("x"))).alias("_e"))
    docs = kept(entries.select("seed", key, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col("_e.id").alias("ids"), F.col("_e.x").alias("weights")))

    def begin(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, j = map(int, group)
        return pd.DataFrame({"seed": [s], "slice": [j], "h": [(np.random.default_rng([s, j]).random((len(rows), k)) + 0.01).tobytes()], "loss": [0.0]})

    shape = "seed int, slice int, h binary, loss double"
    h = kept(words.groupBy("seed", "slice").applyInPandas(begin, shape))
    places = docs.select("seed", "part").distinct()

    def met(table: DataFrame, work, schema: str) -> DataFrame:
        sent = table.join(places, "seed").select(F.col("seed").alias("_seed"), F.col("part").alias("_part"), "slice", "h")
        return docs.groupBy("seed", "part").cogroup(sent.groupBy("_seed", "_part")).applyInPandas(work, schema)

    def products(group: tuple, rows: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["seed", "slice", "products", "gram", "square"])
        factors = _stacked(slices, k)
        own, out, gram, square = factors.T @ factors, np.zeros((k, len(factors))), np.zeros((k, k)), 0.0
        for _, ids, x, at in _chunks(rows):
            w = _solved(ids, x, at, factors, own)
            for t in range(k):
                out[t] += np.bincount(ids, weights=x * w[at, t], minlength=len(factors))
            gram += w.T @ w
            square += float(x @ x)
        cells = [(int(group[0]), j, np.ascontiguousarray(out[:, a : a + SLICE].T).tobytes(), gram.tobytes(), square if j == 0 else 0.0) for j, a in enumerate(range(0, len(factors), SLICE))]
        return pd.DataFrame(cells, columns=["seed", "slice", "products", "gram", "square"])

    def solve(group: tuple, found: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        factors = np.frombuffer(old["h"].iloc[0]).reshape(-1, k).copy()
        total = sum(np.frombuffer(p).reshape(-1, k) for p in found["products"])
        gram = sum(np.frombuffer(g).reshape(k, k) for g in found["gram"])
        loss = found["square"].sum() - 2 * (total * factors).sum() + ((factors @ gram) * factors).sum()
        return pd.DataFrame({"seed": [group[0]], "slice": [group[1]], "h": [descend(factors, total, gram, WORD_SWEEPS).tobytes()], "loss": [loss]})

    losses: list[dict[int, float]] = []
    for _ in range(rounds):
        found = met(h, products, "seed int, slice int, products binary, gram binary, square double")
        h = kept(found.groupBy("seed", "slice").cogroup(h.groupBy("seed", "slice")).applyInPandas(solve, shape))
        losses.append({r["seed"]: r["loss"] for r in h.groupBy("seed").agg(F.sum("loss").alias("loss")).collect()})
        if len(losses) > 1 and all(losses[-2][s] - x <= tolerance * losses[0][s] for s, x in losses[-1].items()):
            break

    def assign(group: tuple, rows: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"seed": [], key: [], "topic": [], "weight": []})]
        factors = _stacked(slices, k) if len(rows) else None
        for part, ids, x, at in _chunks(rows):
            w = _solved(ids, x, at, factors, factors.T @ factors)
            out.append(pd.DataFrame({"seed": int(group[0]), key: np.repeat(part[key].to_numpy(), k), "topic": np.tile(np.arange(k), len(part)), "weight": w.ravel()}))
        return pd.concat(out[1:] or out)

    def listed(group: tuple, names: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        factors = np.frombuffer(slices["h"].iloc[0]).reshape(-1, k)
        names = names.sort_values("id")
        return pd.DataFrame({"seed": int(group[0]), "topic": np.tile(np.arange(k), len(names)), "word": np.repeat(names["word"].to_numpy(), k), "weight": factors.ravel()})

    kind = dict(docs.dtypes)[key]
    documents = met(h, assign, f"seed int, {key} {kind}, topic int, weight double")
    table = words.groupBy("seed", "slice").cogroup(h.groupBy("seed", "slice")).applyInPandas(listed, "seed int, topic int, word string, weight double")
    return Factors(documents, table, losses)


def labelled(documents: DataFrame, min_weight: float = 0.0, unassigned: int = -1, key: str = "row_id") -> DataFrame:
    """seed, key, topic, share: the topic of the largest weight (the first of equal ones) and its share; weak ones are unassigned."""
    best = documents.groupBy("seed", key).agg(F.max(F.struct("weight", (-F.col("topic")).alias("t"))).alias("_b"), F.sum("weight").alias("_s"))
    share = F.when(F.col("_s") > 0, F.col("_b.weight") / F.col("_s")).otherwise(F.lit(0.0))
    out = best.select("seed", key, (-F.col("_b.t")).alias("topic"), share.alias("share"))
    return out.withColumn("topic", F.when(F.col("share") >= min_weight, F.col("topic")).otherwise(F.lit(unassigned)))
