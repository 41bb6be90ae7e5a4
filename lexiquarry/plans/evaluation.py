"""Queries that fit topic models and compare fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators import density, evaluation, factorise, tokens, topics
from lexiquarry.plans import core
from lexiquarry.plans.adapter import FLAGGED_SQL, SLICES, SPEECHES_SQL, flagged, speeches
from lexiquarry.plans.analysis import TERMS_SQL
from lexiquarry.plans.models import _ctfidf, _dot, _embeddings, _labels, _topic, _topic_words, _unit
from lexiquarry.plans.registry import query

WITH, WITH_FLAGS = f"WITH {SPEECHES_SQL}", f"WITH {FLAGGED_SQL}"
SEEDS = [1, 2, 3, 4, 5]
ANCHORS = 10
#: Documents of a sample, topics, rounds at most, and the part of the first loss that a round must gain to be followed by another.
SAMPLE, TOPICS, ROUNDS, TOLERANCE = 20_000, 25, 600, 1e-3

# --- fits of a cheap model over embeddings --------------------------------


def _anchored_sql(name: str, unit: str, seeds: list[int], resampled: bool = True) -> str:
    drawn = f"WHERE ('0x' || substr(md5(seed || ':resample:' || vec_id), 1, 8))::BIGINT < {int(evaluation.FRACTION * 16**8)}" if resampled else ""
    return f"""{name}_in AS (SELECT seed, vec_id, u FROM {unit}, (SELECT unnest({seeds}) AS seed) {drawn}),
{name}_anchors AS (SELECT seed, vec_id AS a, u AS au FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':anchor:' || vec_id), vec_id) AS r FROM {name}_in) WHERE r <= {ANCHORS}),
{name}_near AS (SELECT i.seed, i.vec_id, list(round(greatest({_dot.format('i.u', 'c.au')}, 0), 9) ORDER BY c.a) AS w FROM {name}_in i JOIN {name}_anchors c ON i.seed = c.seed GROUP BY i.seed, i.vec_id),
{name} AS (SELECT seed, vec_id, (list_position(w, list_max(w)) - 1)::INT AS topic, CASE WHEN list_sum(w) > 0 THEN list_max(w) / list_sum(w) ELSE 0 END AS share FROM {name}_near)"""


_turned = "flipped AS (SELECT vec_id, label, list_reverse(u) AS u FROM v)"
_fits_sql = f"WITH {_unit}, {_anchored_sql('fitted', 'v', SEEDS)}"
_shares_sql = f"WITH {_unit}, {_turned}, {_anchored_sql('own', 'v', [1], False)}, {_anchored_sql('own_null', 'flipped', [2], False)}, share AS (SELECT vec_id, topic, share FROM own), nulls AS (SELECT share FROM own_null)"
POINTS = (0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4)


def _fits(spark, d):
    points = evaluation.resamples(_embeddings(spark, d), SEEDS, key="vec_id")
    return evaluation.anchored(points, ANCHORS, "vec_id", "embedding")


def _shares(spark, d):
    """Topics and shares of all vectors under one fit, and shares of a null: the same vectors with their components turned round, under another one."""
    e = _embeddings(spark, d)
    own = evaluation.anchored(e.withColumn("seed", F.lit(1)), ANCHORS, "vec_id", "embedding").drop("seed")
    turned = e.select("vec_id", F.reverse("embedding").alias("embedding"), F.lit(2).alias("seed"))
    return own, evaluation.anchored(turned, ANCHORS, "vec_id", "embedding").select("share")


@query("anchored_fits", f"{_fits_sql} SELECT seed, vec_id, topic, round(share, 6) AS share FROM fitted")
def anchored_fits(spark, d):
    return _fits(spark, d).withColumn("share", F.round("share", 6))


_pairs_sql = f"""{_fits_sql}, cells AS (SELECT x.seed AS a, y.seed AS b, x.topic AS x, y.topic AS y, count(*) AS n FROM fitted x JOIN fitted y ON x.vec_id = y.vec_id AND x.seed < y.seed GROUP BY ALL),
whole AS (SELECT a, b, sum(n * (n - 1) / 2) AS i, sum(n) AS shared FROM cells GROUP BY a, b),
xs AS (SELECT a, b, sum(n * (n - 1) / 2) AS ra FROM (SELECT a, b, x, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY a, b),
ys AS (SELECT a, b, sum(n * (n - 1) / 2) AS rb FROM (SELECT a, b, y, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY a, b),
pairs AS (SELECT a, b, shared, (i - ra * rb / (shared * (shared - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (shared * (shared - 1) / 2)) AS ari FROM whole JOIN xs USING (a, b) JOIN ys USING (a, b))"""


@query("fit_agreement", f"{_pairs_sql} SELECT a, b, shared::BIGINT AS shared, round(ari, 6) AS ari FROM pairs")
def fit_agreement(spark, d):
    return evaluation.agreement(_fits(spark, d), "vec_id").withColumn("ari", F.round("ari", 6))


@query("fit_stability", f"{_pairs_sql} SELECT count(*)::BIGINT AS pairs, round(avg(ari), 4) AS adjusted_rand_mean, round(min(ari), 4) AS adjusted_rand_min, round(max(ari), 4) AS adjusted_rand_max FROM pairs")
def fit_stability(spark, d):
    return evaluation.stability(evaluation.agreement(_fits(spark, d), "vec_id"))


@query("fits_described", f"{_fits_sql}, cut AS (SELECT seed, CASE WHEN share >= 0.15 THEN topic ELSE -1 END AS topic FROM fitted) SELECT seed, count(*)::BIGINT AS documents, count(DISTINCT nullif(topic, -1))::BIGINT AS topics, round(avg((topic = -1)::INT), 4) AS unassigned_share FROM cut GROUP BY seed")
def fits_described(spark, d):
    return evaluation.fits(topics.relabel(_fits(spark, d), 0.15))


@query("share_spread", f"{_shares_sql} SELECT " + ", ".join(f"round(quantile_cont(share, {q}), 4) AS {n}" for n, q in (("p05", 0.05), ("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", round(avg(share), 4) AS mean FROM share")
def share_spread(spark, d):
    return topics.spread(_shares(spark, d)[0])


@query("abstention_curve", f"{_shares_sql}, t AS (SELECT quantile_cont(share, 0.95) AS t FROM nulls), p AS (SELECT DISTINCT x FROM (SELECT unnest([{', '.join(map(str, POINTS))}])::DOUBLE AS x UNION ALL SELECT t FROM t) WHERE x >= 1 / 10.0::DOUBLE) SELECT round(x, 6) AS min_weight, round((SELECT count(*) FROM share WHERE share < x) / (SELECT count(*) FROM share), 6) AS unassigned, x = (SELECT t FROM t) AS chosen FROM p")
def abstention_curve(spark, d):
    return topics.abstention_curve(*_shares(spark, d), ANCHORS, POINTS)


@query("calibrated", f"{_shares_sql}, t AS (SELECT quantile_cont(share, 0.95) AS t FROM nulls) SELECT round(t, 6) AS threshold, 0.1::DOUBLE AS floor, t > 0.1 AS binds, round((SELECT count(*) FROM share WHERE share < t) / (SELECT count(*) FROM share), 6) AS unassigned FROM t")
def calibrated(spark, d):
    return topics.calibration(*_shares(spark, d), ANCHORS)


@query("relabelled", f"{_shares_sql} SELECT vec_id, CASE WHEN share >= 0.15 THEN topic ELSE -1 END::INT AS topic, round(share, 6) AS share FROM share")
def relabelled(spark, d):
    return topics.relabel(_shares(spark, d)[0], 0.15).withColumn("share", F.round("share", 6))


# --- factorisation and density --------------------------------------------


def _sample(spark, d):
    return topics.frozen_sample(speeches(spark, d).withColumn("slice", text.slice_label(F.col("year"), SLICES)), SAMPLE, 3, "slice")


def _sampled_terms(spark, d):
    return tokens.document_terms(tokens.token_table(_sample(spark, d), ["row_id"]))


@query("nmf")
def nmf(spark, d):
    """Topic weights of the frozen sample."""
    return factorise.nmf(topics.tfidf(_sampled_terms(spark, d)), TOPICS, 1, ROUNDS, TOLERANCE).documents


@query("nmf_stability")
def nmf_stability(spark, d):
    """Three fits of resamples, all in the same jobs, and how far they agree."""
    drawn = evaluation.resamples(_sampled_terms(spark, d), SEEDS[:3])
    found = factorise.nmf(topics.tfidf(drawn, by="seed"), TOPICS, rounds=ROUNDS, tolerance=TOLERANCE)
    return evaluation.stability(evaluation.agreement(factorise.labelled(found.documents, 0.2)))


LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñáíóú"


@query("density_clusters")
def density_clusters(spark, d):
    """Speeches of the frozen sample by their shares of letters, in five principal components: languages are what is dense in them."""
    low = F.lower("text")
    shares = F.array(*[(F.length("_t") - F.length(F.replace("_t", F.lit(c)))) / F.length("_t") for c in LETTERS])
    points = density.reduced(_sample(spark, d).withColumn("_t", low), "row_id", shares)
    return density.density_clusters(points, "row_id", F.col("reduced")).withColumn("strength", F.round("strength", 6))


# --- what topics are made of: the language of a document stands in for its topic


_formulaic_sql = f"{TERMS_SQL}, fw AS (SELECT word FROM dt GROUP BY word HAVING count(*) > 0.5 * (SELECT count(*) FROM speeches)), fs AS (SELECT row_id, sum(n) FILTER (word IN (SELECT word FROM fw)) / sum(n) AS formulaic_share FROM dt GROUP BY row_id)"
_made_sql = f"""x AS (SELECT f.row_id, f.tokens, f.year, f.has_hea, {core.SLICE_CASE} AS sl, topic, coalesce(formulaic_share, 0) AS fshare FROM flagged f JOIN lab USING (row_id) LEFT JOIN fs USING (row_id)),
per AS (SELECT topic, sl, count(*) AS c, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, sl) AS r FROM x GROUP BY topic, sl),
yrs AS (SELECT topic, year, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, year) AS r FROM x GROUP BY topic, year),
made AS (SELECT x.topic, count(*)::BIGINT AS documents, floor(quantile_cont(tokens, 0.5))::BIGINT AS median_tokens, floor(quantile_cont(tokens, 0.9))::BIGINT AS p90_tokens, round(avg(fshare), 4) AS formulaic_share,
  any_value(per.sl) AS dominant_period, round(any_value(per.c) / count(*), 4) AS dominant_period_share, any_value(yrs.year) AS dominant_year, round(avg(has_hea::INT), 4) AS bearing_share
  FROM x JOIN per ON per.topic = x.topic AND per.r = 1 JOIN yrs ON yrs.topic = x.topic AND yrs.r = 1 GROUP BY x.topic)"""


def _made_of(spark, d):
    s = speeches(spark, d)
    terms = tokens.occurring(s, ["row_id"])
    common = topics.formulaic(tokens.distinct_words(s, ["row_id"]), spark.read.parquet(f"{d}/documents.parquet").count())
    f = flagged(spark, d).withColumn("slice0", text.slice_label(F.col("year"), SLICES)).join(evaluation.formulaic_shares(terms, common), "row_id", "left")
    return evaluation.composition(f, _labels(spark, d), "slice0", "has_hea")


@query("topic_composition", f"{WITH_FLAGS}, {_topic}, {_formulaic_sql}, {_made_sql} SELECT * FROM made")
def topic_composition(spark, d):
    return _made_of(spark, d)


@query("length_correlation", f"{WITH}, {_topic}, m AS (SELECT topic, median(tokens) AS m FROM speeches JOIN lab USING (row_id) WHERE topic <> -1 GROUP BY topic), r AS (SELECT rank() OVER (ORDER BY topic) AS a, rank() OVER (ORDER BY m) AS b FROM m) SELECT CASE WHEN count(*) < 3 THEN 0 ELSE round(corr(a, b), 4) END AS length_correlation FROM r")
def length_correlation(spark, d):
    return evaluation.length_correlation(speeches(spark, d), _labels(spark, d))


@query("rank_correlation", f"{WITH}, r AS (SELECT rank() OVER (ORDER BY tokens) + (count(*) OVER (PARTITION BY tokens) - 1) / 2 AS a, rank() OVER (ORDER BY speech_number) + (count(*) OVER (PARTITION BY speech_number) - 1) / 2 AS b FROM speeches) SELECT round(corr(a, b), 6) AS rho FROM r")
def rank_correlation(spark, d):
    return evaluation.rank_correlation(speeches(spark, d), "tokens", "speech_number")


@query("topic_payload", f"""{WITH_FLAGS}, {_formulaic_sql}, {_ctfidf}, {_made_sql}
SELECT 'lang' AS model, made.topic, string_agg(word, '|' ORDER BY rank) AS words, round(sum(score), 6) AS scores, any_value(documents) AS documents, any_value(dominant_period) AS dominant_period,
  any_value(coalesce((SELECT documents FROM made WHERE topic = -1), 0))::BIGINT AS unassigned FROM made JOIN tw USING (topic) WHERE rank <= 12 GROUP BY made.topic""")
def topic_payload(spark, d):
    words = _topic_words(spark, d)
    coherence = topics.coherence(words, tokens.occurring(speeches(spark, d), ["row_id"]), spark.read.parquet(f"{d}/documents.parquet").count())
    record = evaluation.payload("lang", {"k": "3"}, words, coherence, _made_of(spark, d))
    each = record.select("model", "unassigned", F.explode("topics").alias("t"))
    scores = F.round(F.aggregate("t.words_scored", F.lit(0.0), lambda s, w: s + w["score"]), 6)
    return each.select("model", "t.topic", F.array_join("t.words", "|").alias("words"), scores.alias("scores"), "t.composition.documents", "t.composition.dominant_period", "unassigned")
