"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores and an exact draw.

A feature falls into one of BUCKETS buckets. The gain of a bucket is the log ratio of
its smoothed shares in the target and in the source; the gains are one array, and a
document's weight is the mean of its features' gains. With Gumbel noise from the id the
highest scores are a sample without replacement in proportion to exp(weight).

Scores are integers in a bounded range (gains lie within some 100,000 of each other, the
noise within 26,000), so the draw needs no sort: a histogram of scores, counts summed
from the top as rank offsets, the cutoff score where they reach the number to draw, and
row numbers by id inside each score that survives. All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import checkpointed, documents

BUCKETS, LONGEST, SEED = 10_000, 1, "2024"
LEAST_WORDS, PERCENT = 20, 10
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of one drawn row are written out in blocks of so many.
COPIES = 4096


def words(text: Column) -> Column:
    """Letters, digits and whatever isn't ASCII, A-Z in lower case; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS), "")


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, joined by a blank."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return found if longest == 1 else F.concat(found, *map(runs, range(2, longest + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """How many features of all rows of texts (text) fall into each bucket; only these numbers reach the driver."""
    each = texts.select(F.explode(features(words(F.col("text")), longest)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * buckets
    for row in each.collect():
        out[row["b"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Per bucket floor(1000 ln) of its smoothed share in the target over that in the source."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source, target)]


def weighted(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs (doc_id, text)."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one constant array
    found = docs.select("doc_id", words(F.col("text")).alias("_w")).select("doc_id", F.size("_w").alias("n_words"), features(F.col("_w"), longest).alias("_f"))
    total = F.aggregate("_f", F.lit(0).cast("long"), lambda a, f: a + F.get(table, bucket(f, len(gain))))
    summed = found.select("doc_id", "n_words", F.size("_f").cast("long").alias("n_features"), total.alias("_sum"))
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return summed.select("doc_id", "n_words", "n_features", mean.alias("weight"), (mean + noise).alias("score"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3... of the percent of its rows (least_words words or more) with the highest scores, ties to the smaller doc_id; null for others.

    Reads scored three times, so it should be materialised.
    """
    enough = F.col("n_words") >= least_words
    histogram = scored.filter(enough).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.col("score").desc())  # one row a score: a bounded table
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = histogram.select("score", (F.sum("n").over(above) - F.col("n")).alias("_before"), F.sum("n").over(everything).alias("_all"))
    offsets = checkpointed(offsets.withColumn("_drawn", F.expr(f"{percent} * _all div 100")).filter("_before < _drawn").select("score", "_before", "_drawn"))
    cutoff = offsets.agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    survive = enough & (F.col("score") >= cutoff)
    # Rows that agree in all columns are counted first, so that a row repeated without end is one row of a window.
    alike = scored.filter(survive).groupBy(*columns).agg(F.count("*").alias("_n")).join(F.broadcast(offsets), "score")
    upto = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    first = alike.withColumn("_first", F.col("_before") + F.sum("_n").over(upto) - F.col("_n") + 1)
    blocks = first.withColumn("_lo", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    each = blocks.withColumn("rank", F.explode(F.sequence("_lo", F.least(F.col("_lo") + COPIES - 1, F.col("_first") + F.col("_n") - 1))))
    drawn = each.select(*columns, F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")).alias("rank"))
    return drawn.union(scored.filter(~survive).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Weight, score and rank of each row of docs (doc_id, text), drawn to resemble the texts of target (text).

    Columns: doc_id, n_words, n_features, weight, score, rank (null: not drawn). Null and
    empty texts have no features and weight 0; a null id counts as an empty one in the
    noise and as the smallest in ties; repeated rows are drawn one by one. Other columns
    aren't read; empty tables are allowed on both sides. Texts are read twice and never
    shuffled.
    """
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    return ranked(checkpointed(weighted(docs, gain, longest, seed)), percent, least_words)


def op13_importance(spark, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is computed from its polynomial, for each distinct word once.
OP13_SQL = r"""
WITH bytes AS (SELECT range AS b FROM range(256)),
table_of AS (SELECT list(list_reduce(list_prepend(b::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t FROM bytes),
said AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
parts AS (SELECT side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM said),
each AS (SELECT side, doc_id, unnest(w) AS f FROM parts),
codes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM each)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::INT])), 4294967295) % 10000 AS k FROM codes, table_of),
found AS (SELECT side, doc_id, k FROM each JOIN hashed USING (f)),
sums AS (SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY k),
alls AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gain AS (SELECT k, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM sums, alls),
sized AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM found JOIN gain USING (k) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN ((total - ((total % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
  ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN sized USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM scored),
numbered AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r,
  count(*) FILTER (n_features >= 20) OVER () AS m FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * m // 100 THEN r END::BIGINT AS rank FROM numbered
"""
