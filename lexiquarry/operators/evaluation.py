"""Topic models compared: fits over seeds, their agreement, and what a report of a model holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats
from lexiquarry.operators.state import kept
from lexiquarry.operators.topics import UNASSIGNED
from lexiquarry.operators.vectors import dot, normalise

FRACTION = 0.9


def resamples(frame: DataFrame, seeds: list[int], fraction: float = FRACTION, key: str = "row_id") -> DataFrame:
    """frame once for each seed (a column) whose draw takes the row: those whose hash lies in the first fraction of its range."""
    every = frame.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    drawn = F.conv(F.substring(stats.hash_order(F.col("seed"), "resample", F.col(key)), 1, 8), 16, 10).cast("long")
    return every.filter(drawn < int(fraction * 16**8))


def anchored(points: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """seed, key, topic, share of points (seed, key, vector): the most alike of k points drawn by hash as anchors of each seed.

    A cheap model whose answer moves with the data and the seed. share is the part of the
    best affinity (cosines above 0) in all; ties go to the anchor with the smaller key.
    """
    unit = points.select("seed", key, normalise(F.col(vector)).alias("_v"))
    order = Window.partitionBy("seed").orderBy(stats.hash_order(F.col("seed"), "anchor", F.col(key)), key)
    drawn = unit.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    anchors = drawn.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_v").alias("v")))).alias("_a"))
    near = unit.join(F.broadcast(anchors), "seed").withColumn("_w", F.transform("_a", lambda a: F.round(F.greatest(dot(F.col("_v"), a["v"]), F.lit(0.0)), 9)))
    best = F.array_max("_w")
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    share = F.when(total > 0, best / total).otherwise(F.lit(0.0))
    return near.select("seed", key, (F.array_position("_w", best) - 1).cast("int").alias("topic"), share.alias("share"))


def agreement(labels: DataFrame, key: str = "row_id") -> DataFrame:
    """a, b, shared, ari: each two seeds of labels (seed, key, topic), over the rows that both have; pairs that share fewer than two are left out.

    All pairs at once: a row meets itself under the other seeds, so a key has as many
    rows as there are seeds. Unassigned is a label like others.
    """
    first = labels.select(key, F.col("seed").alias("a"), F.col("topic").alias("x"))
    second = labels.select(key, F.col("seed").alias("b"), F.col("topic").alias("y"))
    cells = first.join(second, key).filter("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    two = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    whole = cells.groupBy("a", "b").agg(two.alias("i"), F.sum("n").alias("shared"))
    rows = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two.alias("ra"))
    columns = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two.alias("rb"))
    both = whole.filter("shared >= 2").join(rows, ["a", "b"]).join(columns, ["a", "b"])
    by_chance = F.col("ra") * F.col("rb") / (F.col("shared") * (F.col("shared") - 1) / 2)
    most = (F.col("ra") + F.col("rb")) / 2
    return both.select("a", "b", "shared", F.when(most == by_chance, F.lit(1.0)).otherwise((F.col("i") - by_chance) / (most - by_chance)).alias("ari"))


def stability(pairs: DataFrame) -> DataFrame:
    """pairs, adjusted_rand_mean, _min and _max of agreement's rows; 0 where there are none."""
    value = lambda f: F.coalesce(F.round(f("ari"), 4), F.lit(0.0))
    return pairs.agg(F.count("*").alias("pairs"), value(F.avg).alias("adjusted_rand_mean"), value(F.min).alias("adjusted_rand_min"), value(F.max).alias("adjusted_rand_max"))


def fits(labels: DataFrame) -> DataFrame:
    """seed, documents, topics, unassigned_share of each fit."""
    none = F.col("topic") == UNASSIGNED
    return labels.groupBy("seed").agg(F.count("*").alias("documents"), F.countDistinct(F.when(~none, F.col("topic"))).alias("topics"), F.round(F.avg(none.cast("double")), 4).alias("unassigned_share"))


def average_ranks(frame: DataFrame, column: str) -> DataFrame:
    """column (distinct values, no nulls) and rank: the mean of the places its rows have in the order of the values.

    Values are counted, then numbered globally: ranges of values are summed apart and
    shifted by the few totals of the ranges before them.
    """
    return _mean_places(frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), column)


def _mean_places(counted: DataFrame, column: str) -> DataFrame:
    dealt = kept(counted.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_p").agg(F.sum("_n").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_c", F.sum("_n").over(upto)).join(F.broadcast(bases), "_p")
    return placed.select(column, (F.col("_base") + F.col("_c") - (F.col("_n") - 1) / 2).alias("rank"))


def rank_correlation(frame: DataFrame, a: str, b: str) -> DataFrame:
    """rho (Spearman's, ties at their mean rank) of two columns over the rows that have both; null if one doesn't vary.

    Rows are counted by their pair of values before ranks are joined.
    """
    cells = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cells = kept(cells)
    x, y = (_mean_places(cells.groupBy(c).agg(F.sum("n").alias("_n")), c).withColumnRenamed("rank", f"r{c}") for c in ("a", "b"))
    ranked = cells.join(x, "a").join(y, "b")
    total = lambda e: F.sum(F.col("n") * e)
    p, q = F.col("ra"), F.col("rb")
    s = ranked.agg(F.sum("n").alias("n"), total(p).alias("p"), total(q).alias("q"), total(p * p).alias("pp"), total(q * q).alias("qq"), total(p * q).alias("pq"))
    spread = F.sqrt((F.col("n") * F.col("pp") - F.col("p") * F.col("p")) * (F.col("n") * F.col("qq") - F.col("q") * F.col("q")))
    return s.select(F.when(spread > 0, F.round((F.col("n") * F.col("pq") - F.col("p") * F.col("q")) / spread, 6)).alias("rho"))


def length_correlation(frame: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """rho of topic numbers and their median tokens: a smoke alarm for topics that are bands of length; 0 below three topics."""
    medians = frame.select(key, "tokens").join(labels.filter(F.col("topic") != UNASSIGNED).select(key, "topic"), key).groupBy("topic").agg(F.median("tokens").alias("_m"))
    count = medians.agg(F.count("*").alias("_k"))
    return rank_correlation(medians, "topic", "_m").join(F.broadcast(count)).select(F.when(F.col("_k") < 3, 0.0).otherwise(F.round("rho", 4)).alias("length_correlation"))


def formulaic_shares(terms: DataFrame, formulaic: DataFrame, key: str = "row_id") -> DataFrame:
    """key and formulaic_share: the part of each document's words that are formulaic (word).

    Words in half of the documents are few, whatever the corpus, so they are broadcast.
    """
    marked = terms.join(F.broadcast(formulaic.select("word", F.lit(1).alias("_f"))), "word", "left")
    return marked.groupBy(key).agg((F.sum(F.when(F.col("_f") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("formulaic_share"))


def composition(frame: DataFrame, labels: DataFrame, slice_column: str, bearing: str, key: str = "row_id") -> DataFrame:
    """Per topic: documents, median and 90 % tokens, mean formulaic_share, leading slice and its share, leading year, share bearing a term.

    frame has tokens, year, formulaic_share (null where a document has no words), the
    slice and the flag. Of equally frequent slices and years the first one leads.
    """
    x = frame.join(labels.select(key, "topic"), key)

    def leading(column: str, name: str) -> DataFrame:
        counted = x.groupBy("topic", column).agg(F.count("*").alias("_c"))
        first = F.min(F.struct((-F.col("_c")).alias("c"), F.col(column).alias("v")))
        return counted.groupBy("topic").agg(first.alias("_l")).select("topic", F.col("_l.v").alias(name), (-F.col("_l.c")).alias(f"_{name}"))

    q = F.percentile("tokens", F.array(F.lit(0.5), F.lit(0.9)))
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4)
    out = x.groupBy("topic").agg(F.count("*").alias("documents"), q.alias("_q"), share("formulaic_share").alias("formulaic_share"), share(bearing).alias("bearing_share"))
    out = out.join(leading(slice_column, "dominant_period"), "topic").join(leading("year", "dominant_year"), "topic")
    return out.select(
        "topic", "documents", F.floor(F.get("_q", F.lit(0))).alias("median_tokens"), F.floor(F.get("_q", F.lit(1))).alias("p90_tokens"), "formulaic_share",
        "dominant_period", F.round(F.col("_dominant_period") / F.col("documents"), 4).alias("dominant_period_share"), "dominant_year", "bearing_share",
    )


def payload(name: str, params: dict[str, str], words: DataFrame, coherence: DataFrame, made_of: DataFrame) -> DataFrame:
    """One record of a model: model, params, topics (an array of nested records), unassigned and its share, coherence (mean and min).

    words: topic, word, score, rank; coherence: topic, npmi; made_of: composition's rows.
    A topic's record has its words in order, scored words, npmi and composition. The
    record has a row per topic inside, whatever the size of the corpus.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word", "score")))
    listed = words.groupBy("topic").agg(ordered.alias("_w")).select("topic", F.col("_w.word").alias("words"), F.transform("_w", lambda w: F.struct(w["word"].alias("word"), w["score"].alias("score"))).alias("words_scored"))
    per_topic = made_of.select("topic", "documents", F.struct(*[c for c in made_of.columns if c != "topic"]).alias("composition")).join(listed, "topic", "left").join(coherence, "topic", "left")
    assigned = F.col("topic") != UNASSIGNED
    record = F.when(assigned, F.struct("topic", "words", "words_scored", "npmi", "composition"))
    sizes = per_topic.agg(
        F.sort_array(F.collect_list(record)).alias("topics"), F.coalesce(F.sum(F.when(~assigned, F.col("documents"))), F.lit(0)).alias("unassigned"), F.sum("documents").alias("_n"),
        F.round(F.avg(F.when(assigned, F.col("npmi"))), 4).alias("_mean"), F.min(F.when(assigned, F.col("npmi"))).alias("_min"),
    )
    given: Column = F.create_map(*[F.lit(x) for pair in params.items() for x in pair])
    share = F.round(stats.rate(F.col("unassigned"), F.col("_n")), 4)
    return sizes.select(F.lit(name).alias("model"), given.alias("params"), "topics", "unassigned", share.alias("unassigned_share"), F.struct(F.col("_mean").alias("mean"), F.col("_min").alias("min")).alias("coherence"))
