"""Mixing sources to target weights with the cube method.

Every document of a source has the same inclusion: target words / words of the
source. Its whole part is taken outright. Its fraction is an inclusion probability
that the cube method's flight moves to 0 or 1 inside the null space of two
constraints, number of documents and number of words, three documents at a time.
Documents that hold much of their source are drawn first, and the probabilities of the
others make up for them. Blocks of a source fly on their own; the at most two open
documents of each block fly again with those of other blocks, then with all of the
source. About ten documents of each source stay out of the flight; with the at most two
that it left open they make the landing problem, solved by the corner nearest to the
words wanted.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import checkpointed, documents, free_name, global_row_numbers, words

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2.0
BLOCK, FAN = 2048, 1024
#: A document with more than this part of its source's words is settled before the flight, which then makes up for it.
LARGE = 1 / 20
#: Documents of a source kept for the landing: about so many are drawn, at most so many used.
HELD, LANDED = 10, 12
#: Up to so many sources the table of sources is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
EPS = 1e-9


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p after the flight: 0 or 1 but for two values at most; sums of p and p * sizes stay."""
    p = [float(x) for x in p]
    s = [float(x) for x in sizes]
    draws = iter(rng.random(3 * len(p) + 3).tolist())
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) < 2:
            break
        a, b = active[0], active[1]
        if len(active) == 3 and not s[a] == s[b] == s[active[2]]:
            c = active[2]
            move = [s[c] - s[b], s[a] - s[c], s[b] - s[a]]
        elif len(active) == 3 or s[a] == s[b]:
            move = [1.0, -1.0, 0.0]
        else:
            break
        up = down = float("inf")
        for i, u in zip(active, move):
            if u > 0:
                up, down = min(up, (1 - p[i]) / u), min(down, p[i] / u)
            elif u < 0:
                up, down = min(up, p[i] / -u), min(down, (1 - p[i]) / -u)
        step = up if next(draws) * (up + down) < down else -down
        for i, u in zip(active, move):
            p[i] += step * u
        still = [i for i in active if EPS < p[i] < 1 - EPS]
        for i in active:
            if i not in still:
                p[i] = float(round(p[i]))
        active = still
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The open values of p (few) at the corner that changes the sum of p * sizes least, then that of p."""
    p = np.array(p, dtype=float)
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(left):
        corners = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words_off = np.abs((corners - p[left]) @ np.asarray(sizes, dtype=float)[left])
        best = min(range(len(corners)), key=lambda k: (words_off[k], abs((corners[k] - p[left]).sum()), k))
        p[left] = corners[best]
    return p


def source_plan(sized: DataFrame, weights: Iterable[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source: source, source_rank, source_rows, source_size, target.

    Sources by code point, null last, take the weights in turn. share times all
    words is dealt by weight, no source above ceiling times its own words: the
    level is found from the sources sorted by the level at which they are full.
    The table has a row per source and is handled by one task.
    """
    weights = list(weights)
    by_source = sized.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_rank", F.lit(len(weights))))
    full = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0.0)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), none)) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), none))
    open_at = full.withColumn("_level", level)
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    final = open_at.withColumn("_final", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), "source_rank", "_level"))).over(all_rows)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    return final.select("source", "source_rank", "source_rows", "source_size", target.alias("target"))


def _settle_large(start: DataFrame, seed: int, few: bool) -> DataFrame:
    """start (checkpointed) with the large documents of each source drawn one by one, and the rest's p such that the expected words stay.

    A source whose rest can't make up for the draw is flown as it is.
    """
    is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    draw = F.pmod(F.xxhash64(F.lit(seed), "row_number"), F.lit(2**31)) / 2**31
    marked = checkpointed(start.withColumn("_large", is_open & (F.col("size") > F.col("source_size") * LARGE)).withColumn("_open", is_open).withColumn("_drawn", (draw < F.col("p")).cast("double")))
    rest = F.sum(F.when(F.col("_open") & ~F.col("_large"), F.col("size")))
    owed = F.sum(F.when(F.col("_large"), (F.col("p") - F.col("_drawn")) * F.col("size")))
    shifts = marked.filter("_open").groupBy("source_rank").agg((owed / rest).alias("_shift"), F.min(F.when(~F.col("_large"), F.col("p"))).alias("_least"), F.max(F.when(~F.col("_large"), F.col("p"))).alias("_most"))
    shifts = checkpointed(shifts.filter("_least + _shift > 0 AND _most + _shift < 1").select("source_rank", "_shift"))
    joined = marked.join(F.broadcast(shifts) if few else shifts, "source_rank", "left")
    p = F.when(F.col("_shift").isNull() | ~F.col("_open"), F.col("p")).when(F.col("_large"), F.col("_drawn")).otherwise(F.col("p") + F.col("_shift"))
    return joined.withColumn("p", p).select(*start.columns)


def mix(docs: DataFrame, weights: Iterable[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 0) -> DataFrame:
    """How often the mix takes each row of docs (doc_id, text, source): one row per input row.

    Columns: doc_id, source, _text (64-bit hash of the text), size (words; null
    text has none), source_size, target, copies (0 to ceiling), taken (size times
    copies). Sums of a source differ from its target by less than one document at
    most. Null sources form the last source. Rows equal in id, text and source are
    drawn one by one and are interchangeable. An empty table gives no rows; sources
    without words have target 0. Other columns of docs are not read.
    """
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("_text"), F.size(words(F.col("text"))).cast("long").alias("size"))
    slim = checkpointed(global_row_numbers(slim, ["doc_id", "source", "_text", "size"]))
    plan = checkpointed(source_plan(slim, weights, share, ceiling))
    few = plan.count() <= BROADCAST_SOURCES
    same = slim["source"].eqNullSafe(plan["source"])
    planned = slim.join(F.broadcast(plan) if few else plan, same).drop(plan["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS)
    blocks = F.ceil(F.col("source_rows") / BLOCK)
    start = planned.select(
        "doc_id", "source", "_text", "size", "source_size", "target", "row_number", F.col("source_rank").cast("long").alias("source_rank"),
        whole.cast("long").alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"), F.pmod("row_number", blocks).cast("long").alias("block"),
        (F.pmod("row_number", F.ceil(F.col("source_rows") / HELD)) == 0).alias("held"),
    )
    schema = start.schema

    def fly(last: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["held", "size", "row_number"], ascending=[True, False, True], kind="stable")
            p, sizes = rows["p"].to_numpy().copy(), rows["size"].to_numpy()
            flies = len(p) - min(LANDED, int(rows["held"].sum())) if last else len(p)
            p[:flies] = flight(p[:flies], sizes[:flies], np.random.default_rng([seed, *map(int, key)]))
            rows["p"] = landing(p, sizes) if last else p
            return rows

        return run

    is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    start = _settle_large(start, seed, few)
    done, left = [start.filter(~is_open)], start.filter(is_open & ~F.col("held"))
    for _ in range(2):
        flown = checkpointed(left.groupBy("source_rank", "block").applyInPandas(fly(False), schema))
        done.append(flown.filter(~is_open))
        left = flown.filter(is_open).withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
    held = start.filter(is_open & F.col("held"))
    out = left.union(held).groupBy("source_rank").applyInPandas(fly(True), schema)
    for part in done:
        out = out.union(part)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "source", "_text", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row repeated as often as mixed takes it; rows taken 0 times go.

    Of rows equal in id, source and text, those with the smaller hash of all columns are
    taken as the first ones of mixed, so that reruns agree. All columns stay as they are.
    """
    key = ["doc_id", "source", "_text"]
    text, name, count, nth = (free_name(docs, x) for x in ("_text", "_k", "_c", "_i"))
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    keyed = docs.withColumn(text, F.xxhash64("text")).withColumn(name, F.xxhash64("doc_id", "source", text))
    taken = mixed.groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies")).select(F.xxhash64(*key).alias(name), F.col("_copies").alias(count))
    place = F.when(F.size(count) == 1, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(name).orderBy(whole)) - 1)
    joined = keyed.join(taken.filter(F.exists(count, lambda c: c > 0)), name).withColumn(count, F.get(count, place))
    return joined.filter(F.col(count) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), count))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
