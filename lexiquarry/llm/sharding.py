"""Reproducible sharding: a Feistel permutation over global row numbers.

Each row has a global number r in 0..n-1. A balanced Feistel network permutes the
smallest even-bit domain that holds n; numbers that leave 0..n-1 are fed in again
(cycle walking), so the result is a permutation p of 0..n-1. Row r goes to shard
p mod k, slot p div k: both can be computed, and inverted, from r, n and the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexiquarry.llm.common import documents, global_row_numbers

ROUNDS = 6
SHARDS = 24


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & (2**63 - 1))]


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[int], invert: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if invert else keys:
        if invert:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, invert: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 at `numbers` (all in 0..n-1), or its inverse."""
    half, keys = _half_bits(n), _keys(seed)
    out = _feistel(np.asarray(numbers, dtype=np.uint64), half, keys, invert)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _feistel(out[outside], half, keys, invert)
    return out.astype(np.int64)


def place(row_number: int, n: int, shards: int = SHARDS, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = 0) -> int:
    """The row number that lies at (shard, slot)."""
    return int(permute(np.array([slot * shards + shard]), n, seed, invert=True)[0])


def shard_manifest(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Where each row of docs (doc_id, text) goes: one row per input row.

    Columns: doc_id, size (UTF-8 bytes + 8; null text has 0 bytes), text_crc32,
    row_number, n_rows, position (the permuted number), shard, slot. Shard counts
    differ by one at most and slots are gapless. Null ids and texts are values like
    others; rows that repeat id and text get neighbouring row numbers, in any
    order. Other columns of docs are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_text"),
    )

    @F.pandas_udf(LongType())
    def position(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(n.iloc[0]), seed) if len(n) else number)

    numbered = global_row_numbers(slim, ["doc_id", "size", "text_crc32", "_text"])
    placed = numbered.withColumn("position", position("row_number", "n_rows")).drop("_text")
    return placed.withColumns(
        {"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.expr(f"position div {shards}")}
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_manifest(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "n_rows"
    )
