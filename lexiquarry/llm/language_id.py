"""Language ID by nearest centroid over TF-IDF vectors of byte n-grams.

A bounded sample of labelled rows gives document frequencies and, per language, a
few spherical k-means centroids. A text gets the language of the centroid with the
largest cosine; texts that lie farther from every centroid than nearly all training
texts of their language are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import documents, free_name

DIMENSIONS = 4096
#: Rows per language that the model is fitted on, and centroids per language.
SAMPLE, CENTROIDS, ROUNDS = 800, 4, 8
#: Rejected: a cosine below this share of the language's 1 % quantile in training.
MARGIN = 0.5
#: Texts are counted in pieces of so many bytes, so a long one needs no more memory.
PIECE = 1 << 18
#: Rows that are vectors at a time.
ROWS = 64


def _gram_counts(pieces: list[bytes], out: np.ndarray) -> None:
    """Adds the hashed 1- to 3-grams of each piece of bytes to its row of out."""
    lengths = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    for n in (1, 2, 3):
        if len(data) < n:
            break
        same = owner[: len(data) - n + 1] == owner[n - 1 :]
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
        code = (((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount(owner[: len(code)][same] * DIMENSIONS + code[same], minlength=out.size).reshape(out.shape)


def counts(texts: list[str | None]) -> np.ndarray:
    """Term frequencies (rows x DIMENSIONS) of texts; letters count in lower case, digits and other signs not at all."""
    out = np.zeros((len(texts), DIMENSIONS))
    batch: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            rows = [i for i, _ in batch]
            own = np.zeros((len(batch), DIMENSIONS))
            _gram_counts([b for _, b in batch], own)
            np.add.at(out, rows, own)
            batch.clear()
            size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        raw = _letters(text)
        for at in range(0, len(raw), PIECE):
            piece = raw[max(0, at - 2) : at + PIECE] if at else raw[:PIECE]
            batch.append((i, piece))
            size += len(piece)
            if size >= PIECE or len(batch) >= 64:
                flush()
    flush()
    return out


_BLANK = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def _letters(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1).astype(x.dtype)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    floors: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return _unit(np.log1p(counts(texts)) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text; `und` without letters."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, dtype=bool)
        likeness = np.clip(self.vectors(texts) @ self.centroids.T, 0.0, 1.0)
        best = likeness.argmax(axis=1)
        score = likeness[np.arange(len(texts)), best]
        known = np.array([has_letter(t) for t in texts])
        langs = [self.languages[k] if ok else "und" for k, ok in zip(best, known)]
        return langs, np.where(known, score, 0.0), ~known | (score < self.floors[best])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts; at most k centroids."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).sum() > 0 else c[j] for j in range(len(c))])
    sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    large = sizes >= max(1, len(x) // 100)
    return c[large] if large.any() else c


def fit(tf: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Model:
    """A model of the counts of labelled texts. Languages are taken in code point order, one at a time."""
    idf = (np.log((1 + len(tf)) / (1 + np.count_nonzero(tf, axis=0))) + 1.0).astype(np.float32)
    names, cents, floors = [], [], []
    for lang in sorted(set(langs)):
        own = _unit(np.log1p(tf[[i for i, v in enumerate(langs) if v == lang]]) * idf)
        c = _clusters(own, centroids)
        names += [lang] * len(c)
        cents.append(c)
        floors += [MARGIN * float(np.quantile((own @ c.T).max(axis=1), 0.01))] * len(c)
    return Model(idf, np.concatenate(cents) if cents else np.zeros((1, DIMENSIONS)), tuple(names) or ("und",), np.array(floors or [0.0]))


def held_out_column() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and lang of at most `sample` rows per language that aren't held out, by hash of id and text.

    Rows that repeat id, text and lang count once.
    """
    name = F.xxhash64("doc_id", "text", F.lit("language_id"))
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_column())
    rows = rows.select("doc_id", "text", "lang", name.alias("name"))
    ranked = rows.select("lang", "name", F.dense_rank().over(Window.partitionBy("lang").orderBy("name")).alias("place"))
    picked = ranked.filter(F.col("place") <= sample).select("lang", "name").distinct()
    return rows.join(F.broadcast(picked), ["lang", "name"]).dropDuplicates(["lang", "name"]).select("doc_id", "text", "lang")


def _packed(tf: np.ndarray) -> bytes:
    at = np.flatnonzero(tf)
    return at.astype(np.uint16).tobytes() + tf[at].astype(np.float32).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n, out = len(raw) // 6, np.zeros(DIMENSIONS, dtype=np.float32)
    out[np.frombuffer(raw[: 2 * n], dtype=np.uint16)] = np.frombuffer(raw[2 * n :], dtype=np.float32)
    return out


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fits on at most `sample` rows per language of docs (doc_id, text, lang).

    Texts are counted whole on the executors; the driver gets a vector of at most
    DIMENSIONS numbers for each row of the sample.
    """

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([_packed(counts([t])[0]) for t in texts], dtype=object)

    rows = training_sample(docs, sample).select("lang", vector("text").alias("tf")).orderBy("lang", "tf").collect()
    tf, langs = np.zeros((len(rows), DIMENSIONS), dtype=np.float32), [r.lang for r in rows]
    for i in range(len(rows)):
        tf[i], rows[i] = _unpacked(bytes(rows[i].tf)), None
    return fit(tf, langs, centroids)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs and lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are `und`, score 0 and rejected. Only the
    text is used. Whole texts count, in pieces. Existing columns of these names are
    replaced; all others, and repeated rows, are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, score, rejected = [], [], []
            values = texts.tolist()
            for at in range(0, len(values), ROWS):
                a, b, c = shared.value.predict(values[at : at + ROWS])
                langs += a
                score.append(b)
                rejected.append(c)
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.concatenate(score) if score else [], "rejected": np.concatenate(rejected) if rejected else []})

    names = ("lang_pred", "score", "rejected")
    rest, found = docs.drop(*names), free_name(docs, "_p")
    return rest.withColumn(found, predict("text")).select(*rest.columns, *[F.col(f"{found}.{n}").alias(n) for n in names])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "rejected")
