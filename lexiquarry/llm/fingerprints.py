"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a text is cut where it matches a mask, a
hard one while the chunk is shorter than normal, an easy one after (normalised
chunking), between a least and a largest size. The cuts follow the content, so an
insertion changes the chunks around it only. A fingerprint is the set of chunk
digests with their lengths; containment is the share of one set's bytes in another.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import documents

LEAST, NORMAL, LARGEST = 16, 32, 128
HARD_BITS, EASY_BITS = 7, 4
#: Texts of at least so many bytes together are cut in one go.
BATCH_BYTES = 1 << 21
#: So many id ranges at most, and partitions: the driver and every task hold the first row's id and hash of each.
MAX_BUCKETS = 65_536

_x = np.arange(256, dtype=np.uint64)
_x = (_x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_x ^= _x >> np.uint64(31)
_x *= np.uint64(0xBF58476D1CE4E5B9)
#: Random value of each byte; the last entry stands between texts.
GEAR = np.append((_x >> np.uint64(32)).astype(np.uint32), np.uint32(0))


def _cuts(texts: list[bytes]) -> list[list[int]]:
    """End offsets of the chunks of each text."""
    pad, at, total = 32, [], 0
    for t in texts:
        at.append(total)
        total += len(t) + pad
    ids = np.full(total, 256, dtype=np.uint16)
    for start, t in zip(at, texts):
        ids[start : start + len(t)] = np.frombuffer(t, dtype=np.uint8)
    h = GEAR[ids]
    for step in (1, 2, 4, 8, 16):  # sum over j < 32 of gear[i - j] << j, by doubling
        h[step:] += h[:-step] << np.uint32(step)
    top = h >> np.uint32(32 - HARD_BITS)
    found = np.flatnonzero((top >> np.uint32(HARD_BITS - EASY_BITS)) == 0)
    hard = (top[found] == 0).tolist()
    starts = np.array(at + [total])
    edges = np.searchsorted(found, starts).tolist()
    places = found.tolist()
    out = []
    for k, t in enumerate(texts):
        base, n, begin, ends = at[k], len(t), 0, []
        i, last = edges[k], edges[k + 1]
        while n - begin > LEAST:
            limit = min(n, begin + LARGEST)
            end = limit
            while i < last:
                cut = places[i] - base + 1
                if cut >= limit:
                    break
                size = cut - begin
                if size >= LEAST and (size >= NORMAL or hard[i]):
                    end = cut
                    break
                i += 1
            ends.append(end)
            begin = end
        if begin < n:
            ends.append(n)
        out.append(ends)
    return out


def chunk_sets(texts: list[str]) -> list[dict[int, int]]:
    """Digest and length of the distinct chunks of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    digest, out = xxhash.xxh3_64_intdigest, []
    for t, ends in zip(raw, _cuts(raw)):
        own, begin = {}, 0
        for end in ends:
            own[digest(t[begin:end])] = end - begin
            begin = end
        out.append(own)
    return out


def as_string(chunks: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes that lie in chunks of b; empty sets are like each other only."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / total


def edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text) from rows in order; each bucket ends with the first row of the next one."""
    last = None
    for batch in batches:
        for bucket, guest, doc_id, null, text in zip(*(batch[c].tolist() for c in ("_bucket", "_guest", "doc_id", "_null", "text"))):
            if last is not None and last[0] == bucket:
                yield last[1], last[2], text
            last = None if guest else (bucket, None if null else doc_id, text)


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting, size = [], 0

    def flush() -> pd.DataFrame:
        texts: list[str] = []
        for k, (_, text, following) in enumerate(waiting):
            texts += [text, edited(text, following)]
            if k + 1 == len(waiting) or waiting[k + 1][1] is not following:
                texts.append(following)
        sets, at, rows = chunk_sets(texts), 0, []
        for k, (doc_id, text, following) in enumerate(waiting):
            own, new = sets[at], sets[at + 1]
            at += 2
            follower = sets[at]
            if k + 1 == len(waiting) or waiting[k + 1][1] is not following:
                at += 1
            sha = hashlib.sha256(texts_of_edit(text, following)).hexdigest()
            rows.append((doc_id, len(text), sha, as_string(own), as_string(new), containment(own, new), containment(own, follower)))
        out = pd.DataFrame([r[1:] for r in rows], columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
        return out

    for doc_id, text, following in _pairs(batches):
        waiting.append((doc_id, text, following))
        size += 2 * len(text)
        if size >= BATCH_BYTES or len(waiting) >= 2000:
            yield flush()
            waiting, size = [], 0
    if waiting:
        yield flush()


def texts_of_edit(text: str, following: str) -> bytes:
    return edited(text, following).encode("utf-8", "surrogatepass")


class Ranges:
    """Numbers of ranges in descending order of id, then of hash.

    Ids at or above the k-th cut, and below the one before, are a range. An id that is several
    quantiles has as many ranges of the hash after its own; null ids come last, in so many.
    """

    def __init__(self, quantiles: list[float], nulls: int):
        cuts = sorted(Counter(quantiles).items(), reverse=True)
        self.cuts = -np.array([c for c, _ in cuts])
        # Ids beyond 2 ** 53 aren't told apart as doubles, so none of them is split.
        self.split = np.array([k if k > 1 and abs(c) < 1 << 53 else 0 for c, k in cuts] + [0])
        self.first = np.cumsum(1 + self.split) - (1 + self.split)
        self.nulls = max(nulls, 1)

    def number(self, ids: pd.Series, hashes: np.ndarray) -> np.ndarray:
        value = -ids.to_numpy(dtype=float, na_value=np.nan)
        null, at = np.isnan(value), np.searchsorted(self.cuts, value, side="left")
        at = np.minimum(at, len(self.cuts))
        equal = value == np.append(self.cuts, np.nan)[at]
        pieces = np.where(null, self.nulls, np.where(equal, self.split[at], 0))
        piece = np.minimum(np.floor((2.0**63 - hashes.astype(float)) / 2.0**64 * pieces), pieces - 1)
        base = np.where(null, self.first[-1], self.first[at])
        return (base + np.where(pieces > 0, 1 + piece, 0)).astype(np.int32)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts; see SCHEMA.

    The edited text has its last third replaced by the start of the next document in
    descending doc_id order, the first one after the last. Null texts are empty; rows
    with equal ids follow each other by the hash of the text, rows with null ids come
    last. Other columns aren't read; an empty table gives no rows.

    Rows are dealt over id ranges; an id that many rows repeat, and the null ids, have ranges
    of the hash instead. Only the first row of each range is copied into the range before
    it, so texts are shuffled once. Ids are whole numbers (or text of them).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    chars, some, all_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("doc_id"), F.count("*")).first()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // (32 << 20)), MAX_BUCKETS)
    n = min(8 * parts, MAX_BUCKETS)
    quantiles = rows.approxQuantile("doc_id", [k / n for k in range(1, n)], min(0.001, 0.5 / n))
    ranges = spark.sparkContext.broadcast(Ranges(quantiles, n * (all_rows - some) // max(all_rows, 1)))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.value.number(ids, hashes.to_numpy()))

    dealt = rows.withColumn("_bucket", bucket("doc_id", "_h"))
    firsts = sorted((r["_bucket"], r["f"][0], r["f"][1]) for r in dealt.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_h")).alias("f")).collect())
    before = [(firsts[k - 1][0], *firsts[k][1:]) for k in range(len(firsts))]
    guests = spark.createDataFrame(before, "_bucket int, _id long, _hash long")
    first = dealt["doc_id"].eqNullSafe(guests["_id"]) & (dealt["_h"] == guests["_hash"])
    extra = dealt.drop("_bucket").join(F.broadcast(guests), first).dropDuplicates(["_bucket"]).select("doc_id", "text", "_h", "_bucket", F.lit(1).alias("_guest"))
    ordered = dealt.withColumn("_guest", F.lit(0)).select(*extra.columns).union(extra).repartition(parts, "_bucket")
    ordered = ordered.sortWithinPartitions("_bucket", "_guest", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    # A null among numbers would make doubles of them.
    ordered = ordered.withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    return ordered.select("_bucket", "_guest", "doc_id", "_null", "text").mapInPandas(_profile, SCHEMA)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(documents(spark, sf_dir))
