"""Periodic runs of words in whole texts, and texts without their repetitions.

A run is a stretch of words with smallest period q, at least max(LEAST, FOLD * q) words
long, that can't be extended. The suffix automaton of the words has a state for each
class of substrings with the same end positions. Going up its links, the ordered end
positions of a state's children are merged, the smaller set into the larger one. Two
positions that have become neighbours, at a distance d of at most the state's length,
end the same substring twice: a square of period d, which is extended both ways to its
run. The rightmost pair of a run meets in the state of its length less q, so states and
distances that can only seed shorter runs are passed over.

Only stretches covered by windows of words that occur twice go into an automaton. They
hold every run whole: of a run, the first and the last length - q words (WINDOW or more)
occur twice, and together they cover it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiquarry.llm.common import documents

LEAST, FOLD = 24, 3
#: The fewest words of a run that occur a period later, over all periods.
WINDOW = min(max(LEAST - q, (FOLD - 1) * q) for q in range(1, LEAST))
ROWS = 256
Run = tuple[int, int, int]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (begin, end) covered by windows that occur at least twice; a window has the power of two up to WINDOW words."""
    width, h = 1, ids.astype(np.uint64) + np.uint64(1)
    while 2 * width <= WINDOW:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        width *= 2
        if not len(h):
            return []
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(h, twice))
    parts = np.split(at, np.flatnonzero(np.diff(at) > width) + 1)
    return [(int(p[0]), int(p[-1]) + width) for p in parts]


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, link and own end position (-1 for clones) of each state of the suffix automaton."""
    length, link, own = [0], [-1], [-1]
    step: list[dict[int, int]] = [{}]
    last = 0
    for i, c in enumerate(ids):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        own.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return length, link, own


def _merged(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The union of two ordered sets, and the smaller of them."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 8 * len(small) > len(large):
        return sorted(large + small), small
    for x in small:
        insort(large, x)
    return large, small


def runs_of(ids: list[int]) -> list[Run]:
    """(start, length, period) of the runs of a list of words, given as numbers."""
    length, link, own = automaton(ids)
    n = len(ids)
    # End positions are negated: those of shorter states are mostly smaller, so that they are appended.
    ends: dict[int, list[int]] = {v: [-i] for v, i in enumerate(own) if i >= 0 and length[v] >= WINDOW}
    found: dict[int, list[tuple[int, int]]] = {}

    def seed(end: int, d: int) -> None:
        known = found.setdefault(d, [])
        k = bisect_right(known, (end - d, n)) - 1
        if k >= 0 and end < known[k][1]:
            return
        start, stop = end - d, end + 1
        while start > 0 and ids[start - 1] == ids[start - 1 + d]:
            start -= 1
        while stop < n and ids[stop] == ids[stop - d]:
            stop += 1
        insort(known, (start, stop))

    for v in np.argsort(-np.array(length), kind="stable").tolist():
        if length[v] < WINDOW:
            break
        up, below = link[v], ends.pop(v)
        size = length[up]
        if size < WINDOW:
            continue
        if up not in ends:
            ends[up] = below
            continue
        ends[up], new = _merged(ends[up], below)
        both = ends[up]
        for x in new:
            k = bisect_left(both, x)
            for i in (k - 1, k):
                if i >= 0 and i + 1 < len(both):
                    d = both[i + 1] - both[i]
                    if (FOLD - 1) * d <= size and size + d >= LEAST:
                        seed(-both[i], d)
    return [(a, b - a, d) for d, spans in found.items() for a, b in spans]


def find_runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if len(words) < LEAST:
        return []
    ids = pd.factorize(np.array(words, dtype=object))[0]
    return sorted((a + s, n, q) for a, b in stretches(ids) if b - a >= LEAST for s, n, q in runs_of(ids[a:b].tolist()))


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: not those that any run has after its first period."""
    stay = np.ones(n, dtype=bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def collapse(docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, all in words) and collapsed, the words that stay, of each row of docs (doc_id, text).

    Words are parted by ASCII white space; collapsed has single blanks. edit may change
    the words of a row first. Whole texts are read. Null and empty texts have no words
    and no runs; repeated rows are rows of their own, null ids stay null, other columns
    aren't read, an empty table gives no rows. Rows are independent: nothing is
    shuffled. A text's automaton takes about 400 bytes for each word that lies in a
    stretch which occurs twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                numbers, runs, texts = [], [], []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["_input"].to_pylist()):
                    words = text.encode().split()
                    if edit is not None:
                        words = edit(doc_id, words)
                    own = find_runs(words)
                    numbers.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    stay = kept(len(words), own) if own else None
                    texts.append(b" ".join(words if stay is None else [w for w, k in zip(words, stay.tolist()) if k]).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(numbers, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_input")).mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten made periodic from some word on; a null id plants nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = collapse(documents(spark, sf_dir), planted)
    # Runs are in order, so that of equal exponents the first one stays; they are compared as fractions.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
