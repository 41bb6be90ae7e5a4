"""Vectors: normalising, pooling, chunking, neighbours and how well a projection keeps them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors, and of its product with another one at a time.
BLOCK, ROWS = 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def pool(pieces: DataFrame, owner: str, vector: str, weight: str) -> DataFrame:
    """owner and the weighted mean of its pieces' vectors at length 1."""
    x = pieces.select(owner, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    mean = x.groupBy(owner, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    whole = mean.groupBy(owner).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"))
    return whole.select(owner, normalise(F.col("_v")).alias(vector))


def chunks(frame: DataFrame, key: str, tokens: str, most: int, overlap: int) -> DataFrame:
    """key, chunk, tokens, weight: windows of at most `most` tokens, each `overlap` into the one before."""
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the window")
    step = most - overlap
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int")
    out = frame.select(key, tokens, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    own = F.slice(F.col(tokens), F.col("chunk") * step + 1, F.lit(most))
    return out.select(key, "chunk", own.alias("tokens"), F.greatest(F.size(own), F.lit(1)).alias("weight"))


def neighbours(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """query, neighbour, score, rank: the k nearest of each query, itself left out; ties by id.

    The queries are a stated set. Queries and corpus are cut into blocks of BLOCK rows by
    hash; each two blocks meet in one task, as a product of matrices, which passes on k
    rows per query.
    """
    kind = dict(corpus.dtypes)[key]
    n_q, n_c = (max(1, -(-x.count() // BLOCK)) for x in (queries, corpus))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = normalise(F.col(vector)) if metric == "cosine" else F.col(vector).cast("array<double>")
    left = queries.select(F.col(key).alias("id"), unit.alias("v"), block(n_q).alias("a"), every(n_c).alias("b"))
    right = corpus.select(F.col(key).alias("id"), unit.alias("v"), every(n_q).alias("a"), block(n_c).alias("b"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(columns=["query", "neighbour", "score"])
        x, y = (np.stack(t["v"].to_numpy()).astype(float) for t in (q, c))
        asked, ids, out = q["id"].to_numpy(), c["id"].to_numpy(), []
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            # far is small for near rows: a cosine turned round, or a distance.
            far = -(part @ y.T) if metric == "cosine" else np.sqrt(np.maximum((part * part).sum(1)[:, None] + (y * y).sum(1) - 2 * (part @ y.T), 0))
            far = np.round(far, 9)
            far[asked[at : at + ROWS, None] == ids] = np.inf
            last = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            rows, columns = np.nonzero((far <= last[:, None]) & np.isfinite(far))  # with all ties of the last one
            order = np.lexsort((ids[columns], far[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, columns = rows[place < k], columns[place < k]
            score = far[rows, columns]
            out.append(pd.DataFrame({"query": asked[at + rows], "neighbour": ids[columns], "score": -score if metric == "cosine" else score}))
        return pd.concat(out)

    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, f"query {kind}, neighbour {kind}, score double")
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(best, "neighbour")))
    return ranked.filter(F.col("rank") <= k)


def neighbour_summary(found: DataFrame, attributes: DataFrame, key: str, value: str) -> DataFrame:
    """queries, median top-1 score, share of top-1 neighbours with the query's value, and the base rate of values."""
    a = attributes.select(F.col(key).alias("query"), F.col(value).alias("_qv"))
    b = attributes.select(F.col(key).alias("neighbour"), F.col(value).alias("_nv"))
    first = found.filter("rank = 1").join(a, "query").join(b, "neighbour")
    return first.agg(F.count("*").alias("queries"), F.round(F.median("score"), 6).alias("median_score"), F.round(F.avg(F.col("_qv").eqNullSafe(F.col("_nv")).cast("double")), 6).alias("same"))


def neighbour_hits(found: DataFrame, attributes: DataFrame, key: str, flag: str, same: list[str]) -> DataFrame:
    """One row: queries, median top-1 score, shares of flagged rows among top-1 neighbours, all neighbours and all of attributes, and per column of same the share of top-1 neighbours with the query's value.

    A null is equal to nothing. Without neighbours the shares are null.
    """
    a = attributes.select(F.col(key).alias("query"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(same)])
    b = attributes.select(F.col(key).alias("neighbour"), F.col(flag).alias("_flag"), *[F.col(c).alias(f"_n{i}") for i, c in enumerate(same)])
    both, first = found.join(a, "query").join(b, "neighbour"), F.col("rank") == 1
    share = lambda x, among: F.round(F.avg(F.when(among, F.coalesce(x, F.lit(False)).cast("double"))), 4)
    hits = both.agg(
        F.count_if(first).alias("queries"), F.round(F.median(F.when(first, F.col("score"))), 4).alias("top1_score_median"), share(F.col("_flag"), first).alias(f"top1_{flag}"),
        share(F.col("_flag"), F.lit(True)).alias(f"any_{flag}"), *[share(F.col(f"_q{i}") == F.col(f"_n{i}"), first).alias(f"top1_same_{c}") for i, c in enumerate(same)],
    )
    return hits.crossJoin(attributes.agg(share(F.col(flag), F.lit(True)).alias(f"corpus_{flag}")))


def purity(found: DataFrame, attributes: DataFrame, key: str, value: str) -> DataFrame:
    """mean share of neighbours with the point's value, base_rate, lift, points, distinct_values, missing; null is a value."""
    a = attributes.select(F.col(key).alias("query"), F.col(value).alias("_qv"))
    b = attributes.select(F.col(key).alias("neighbour"), F.col(value).alias("_nv"))
    mean = found.join(a, "query").join(b, "neighbour").agg(F.avg(F.col("_qv").eqNullSafe(F.col("_nv")).cast("double")).alias("m"))
    sizes = attributes.groupBy(value).agg(F.count("*").alias("c"))
    base = sizes.agg(F.sum("c").alias("points"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s"), F.count("*").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("c"))), F.lit(0)).alias("missing"))
    both = base.join(mean).withColumn("b", F.try_divide(F.col("s"), F.col("points") * (F.col("points") - 1)))
    return both.select(F.round("m", 4).alias("mean"), F.round("b", 4).alias("base_rate"), F.when(F.col("b") > 0, F.round(F.col("m") / F.col("b"), 2)).alias("lift"), "points", "distinct_values", "missing")


def neighbour_loss(first: DataFrame, second: DataFrame) -> DataFrame:
    """loss: the share of first's (query, neighbour) pairs that second lacks."""
    kept = first.join(second.select("query", "neighbour", F.lit(1).alias("_hit")), ["query", "neighbour"], "left")
    return kept.agg(F.round(1 - F.count("_hit") / F.count("*"), 6).alias("loss"))


def trustworthiness(points: DataFrame, key: str, high: str, low: str, k: int) -> DataFrame:
    """Venna and Kaski's measure of the neighbours that low adds to high.

    Ranks of all pairs are needed, so this is for a sample of points: the caller
    chooses it.
    """
    n = points.count()
    if n < 3:
        return points.sparkSession.range(1).select(F.lit(1.0).alias("trustworthiness"))
    k = max(1, min(k, n - 2, (2 * n - 2) // 3))
    ranks = neighbours(points, points, key, high, n, "euclidean").select("query", "neighbour", F.col("rank").alias("r"))
    near = neighbours(points, points, key, low, k, "euclidean").select("query", "neighbour")
    charged = near.join(ranks, ["query", "neighbour"]).agg(F.sum(F.greatest(F.col("r") - k, F.lit(0))).alias("p"))
    return charged.select(F.round(1 - F.col("p") * (2.0 / (n * k * (2 * n - 3 * k - 1))), 6).alias("trustworthiness"))


def store_error(frame: DataFrame, vector: str) -> DataFrame:
    """largest: the largest difference that storing at half precision makes (11 significant bits)."""

    def half(x: Column) -> Column:
        v = x.cast("double")
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
        return F.when(v == 0, 0.0).otherwise(F.abs(v - F.rint(v / unit) * unit))

    return frame.agg(F.max(F.array_max(F.transform(vector, half))).alias("largest"))


#: The largest difference that storing may make.
LOSS = 1e-2


def packed(vector: str, kind: str = "float16") -> Column:
    """vector as bytes, little-endian, at half or single precision; a null stays. Raises where half precision would lose more than LOSS of a component."""
    if kind not in ("float16", "float32"):
        raise ValueError(f"vectors aren't stored as {kind}")

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            x = np.asarray(v, dtype=np.float32)
            with np.errstate(over="ignore"):
                out = x.astype(f"<{'f2' if kind == 'float16' else 'f4'}")
            lost = float(np.abs(out.astype(np.float32) - x).max(initial=0))
            if not lost <= LOSS:
                raise ValueError(f"{kind} would lose {lost:.4f} of a component; store float32")
            return out.tobytes()

        return pd.Series([one(v) for v in vectors], dtype=object)

    return run(F.col(vector))


def unpacked(bytes_: str, kind: str = "float16") -> Column:
    """The vector in what packed made, at single precision."""
    width = "<f2" if kind == "float16" else "<f4"

    @F.pandas_udf("array<float>")
    def run(stored: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype=width).astype(np.float32) for b in stored], dtype=object)

    return run(F.col(bytes_))


def write_store(frame: DataFrame, path: str, key: str, vector: str, kind: str = "float16") -> None:
    """A store of vectors: key, bytes and kind as Parquet. Raises, before anything takes the place of an old store, if precision would be lost."""
    gone = frame.agg(F.max(F.octet_length(packed(vector, kind)))).first()  # every vector is packed once to find out
    if gone is not None:
        frame.select(key, packed(vector, kind).alias("bytes"), F.lit(kind).alias("kind")).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """key and vector of a store; rows that say they are of different kinds are read each as their own."""
    rows = spark.read.parquet(path)
    half, single = rows.filter("kind = 'float16'"), rows.filter("kind = 'float32'")
    names = [c for c in rows.columns if c not in ("bytes", "kind")]
    return half.select(*names, unpacked("bytes", "float16").alias(vector)).union(single.select(*names, unpacked("bytes", "float32").alias(vector)))


def strongest(measured: DataFrame) -> DataFrame:
    """attribute and lift of the row of measured with the largest lift; ties by name, null lifts left out."""
    return measured.filter("lift IS NOT NULL").orderBy(F.desc("lift"), "attribute").limit(1).select("attribute", "lift")


def projection_agreement(points: DataFrame, key: str, clustered: str, projected: str, k: int) -> DataFrame:
    """points, loss and trustworthiness of a projection of a sample: neighbours that it loses, and ranks that those it adds cost."""
    first, second = (neighbours(points, points, key, v, k, "euclidean") for v in (clustered, projected))
    sizes = points.agg(F.count("*").alias("points"))
    return sizes.join(F.broadcast(neighbour_loss(first, second))).join(F.broadcast(trustworthiness(points, key, clustered, projected, k)))


def for_sample(sample: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """embeddings of the sample's keys; raises, with the first of them, if any has none. Keys of the sample are distinct."""
    missing = [r[0] for r in sample.select(key).join(embeddings.select(key), key, "left_anti").orderBy(key).limit(8).collect()]
    if missing:
        raise ValueError(f"no vector for {missing}")
    return embeddings.join(sample.select(key), key, "left_semi")
