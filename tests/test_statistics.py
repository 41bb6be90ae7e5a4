"""Hand-worked numbers of FIXTURES.md."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.functions import stats, text
from lexiquarry.operators import changepoint, kwic, lexical, quality, series, topics, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_log_likelihood_and_ratio(spark):
    n = lambda *v: [F.lit(x) for x in v]
    assert one(spark, stats.log_likelihood(*n(10, 100, 1000, 10000))) == pytest.approx(0)
    assert one(spark, stats.log_likelihood(*n(30, 70, 1000, 9000))) == pytest.approx(30.732717, abs=1e-6)
    assert one(spark, stats.log_ratio(*n(20, 10, 1000, 1000))) == pytest.approx(1.0)
    assert one(spark, stats.log_ratio(*n(10, 0, 1000, 1000))) == pytest.approx(4.321928, abs=1e-6)
    assert one(spark, stats.log_likelihood(*n(0, 0, 5, 5))) == 0


def test_zero_ceiling_and_interval(spark):
    assert one(spark, stats.zero_ceiling(F.lit(100))) == pytest.approx(0.0295130, abs=1e-7)
    assert one(spark, stats.informative_minimum(F.lit(3273 / 106302))) == 96
    w = one(spark, stats.wilson(F.lit(80), F.lit(1600)))
    assert (round(w["low"], 6), round(w["high"], 6)) == (0.040357, 0.061798)


def test_addresses_and_languages(spark):
    said = "Mr. Levitte (France) (spoke in French): I thank you."
    row = spark.createDataFrame([(said,), ("I thank the President for this.",), (None,)], "t string").select(text.body_start(F.col("t")).alias("b"), text.exact_language(text.language_marker(text.address(F.col("t")))).alias("l")).collect()
    assert said[row[0].b :] == "I thank you." and row[0].l == "French"
    assert row[1].b == 0 and row[2].b == 0
    assert text.resolve_language(" in F rench") == ("French", False)
    assert text.resolve_language("from Snaniah") == ("Spanish", False)
    assert text.resolve_language("in Russlan")[0] == "Russian"
    assert text.resolve_language("zzz") == (None, False)


@pytest.mark.parametrize("source,n", [("The Council met. It adjourned.", 2), ("Mr. Smith spoke.", 1), ("See para. 12 of it.", 1), ("The U.S. Mission spoke.", 1), ("Mr. B. Traore came.", 1), ("", 0)])
def test_sentences(source, n):
    assert len(kwic.split_sentences(source)) == n


def test_sentence_offsets():
    assert kwic.split_sentences("One.   Two.") == [(0, 4), (7, 11)]


def test_gains():
    plan = changepoint.split_plan(6, 3)
    assert changepoint.split_gains(np.array([1, 1, 1, 4, 4, 4.0]), plan).max() == pytest.approx(13.5)
    assert len(changepoint.split_plan(5, 3)) == 0
    assert {(0, 12), (0, 6), (6, 12)} <= {(a, b) for a, _, b in changepoint.split_plan(12, 3).tolist()}


LABELS = [str(y) for y in range(1992, 2024)]


def yearly(spark, values, exposure=None):
    rows = [("s", x, float(v), int(v), n) for x, v, n in zip(LABELS, values, exposure or [1] * len(values))]
    return spark.createDataFrame(rows, "name string, year string, value double, k long, n long").repartition(2)


def test_change_points(spark):
    found = changepoint.change_points(yearly(spark, [1] * 16 + [6] * 16), "name", "year", "value", trials=99).collect()
    assert [(r["index"], r.label, r.p_value, r.before, r.after) for r in found] == [(16, "2008", 0.01, 1, 6)]
    bump = changepoint.change_points(yearly(spark, [1] * 11 + [5] * 10 + [1] * 11), "name", "year", "value", trials=199).collect()
    assert {"2003", "2013"} <= {r.label for r in bump}
    steps = changepoint.change_points(yearly(spark, [1] * 11 + [4] * 10 + [9] * 11), "name", "year", "value", trials=199).collect()
    assert [r.label for r in steps] == ["2003", "2013"]
    assert changepoint.change_points(yearly(spark, [1] * 32), "name", "year", "value", trials=50).count() == 0
    assert changepoint.change_points(yearly(spark, [1, 9, 1]), "name", "year", "value", trials=50).count() == 0


def test_rate_change(spark):
    r = changepoint.rate_change_points(yearly(spark, [5] * 16 + [200] * 16, [100] * 16 + [1000] * 16), "name", "year", "k", "n", "binomial", trials=99).first()
    assert r.label == "2008" and r.gain == pytest.approx(279.801063, abs=1e-5) and r.before == 0.05 and r.after == 0.2 and r.ratio == 4 and r.accepted
    p = changepoint.rate_change_points(yearly(spark, [2] * 16 + [20] * 16, [100_000] * 32), "name", "year", "k", "n", "poisson", trials=99).first()
    assert p.label == "2008" and p.accepted
    with pytest.raises(Exception, match="out of range"):
        changepoint.rate_change_points(yearly(spark, [2] * 8, [1] * 8), "name", "year", "k", "n", "binomial").collect()


def test_span_merge_keeps_touching_apart(spark):
    rows = [(1, 0, 4, "a"), (1, 2, 6, "b"), (1, 6, 8, "c"), (2, 0, 1, "a")]
    df = spark.createDataFrame(rows, "row_id int, start int, end int, term string")
    assert [(r.row_id, r.start, r.end, r.terms) for r in kwic.merged_spans(df).orderBy("row_id", "start").collect()] == [(1, 0, 6, ["a", "b"]), (1, 6, 8, ["c"]), (2, 0, 1, ["a"])]


def test_matched_pairs(spark):
    rows = [(i, 1994, "Rwanda", i < 3) for i in range(6)] + [(6 + i, 2000, None, i < 2) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id int, year int, agenda string, hit boolean")
    pairs = lexical.matched_pairs(df, "hit", ["year", "agenda"], 1).collect()
    assert len(pairs) == 4 and len({p.control_id for p in pairs}) == 4
    assert lexical.coverage(lexical.matched_pairs(df, "hit", ["year", "agenda"], 1), df, "hit").first().coverage == 0.8
    assert [(r.year, r.wanted, r.matched) for r in lexical.short_strata(df, "hit", ["year", "agenda"]).collect()] == [(2000, 2, 1)]


def test_adjusted_rand(spark):
    rows = list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2]))
    assert topics.adjusted_rand(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().ari == pytest.approx(0.242424, abs=1e-6)


def test_vectors(spark):
    v = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(vectors.normalise(F.col("v")).alias("u")).collect()
    assert v[0].u == [0, 0] and v[1].u == pytest.approx([0.6, 0.8])


def test_grid_and_refusals(spark):
    assert series.month_grid(spark, 1992, 1993).count() == 24
    with pytest.raises(ValueError):
        series.month_grid(spark, 1993, 1992)
    with pytest.raises(ValueError):
        text.period(F.col("d"), "week")
    with pytest.raises(ValueError):
        quality.gate(["bad"])


def test_shapes(spark):
    promised = quality.shape({"a": [1, None], "b": {"x": {"y": 1.0}}})
    assert quality.shape_differences(promised, quality.shape({"a": [1], "b": {"x": {"y": 2.0}}, "c": 1})) == []
    assert quality.shape_differences(promised, quality.shape({"a": [], "b": {"x": {"y": 2.0}}})) == []
    assert quality.shape_differences(promised, quality.shape({"a": ["x"]})) == [".a[] holds str", ".b is missing"]
    names = quality.shape({"by": {"one": {"n": 1}}}, frozenset({"by"}))
    assert quality.shape_differences(names, quality.shape({"by": {"two": {"n": 2}}}, frozenset({"by"}))) == []
    a, b = (spark.createDataFrame([], x) for x in ("x int, y array<struct<z:string>>", "x long, y array<struct<w:string>>"))
    assert quality.schema_differences(a, a) == [] and quality.schema_differences(a, b) == [".x holds bigint", ".y[].z is missing"]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, score in (("cosine", -(unit @ unit.T)), ("euclidean", np.linalg.norm(x[:, None] - x[None], axis=2))):
        np.fill_diagonal(score, np.inf)
        got = vectors.neighbours(d.filter("id % 50 = 0"), d, "id", "v", 3, metric).collect()
        assert {(r["query"], r["rank"], r.neighbour) for r in got} == {(i, k + 1, int(j)) for i in range(0, 300, 50) for k, j in enumerate(score[i].argsort()[:3])}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 50), st.integers(0, 50), st.integers(51, 500), st.integers(51, 500))
def test_gain_identity(a, b, n1, n2):
    k = np.array([a, b, a, b, a, b, b, b], dtype=float)
    n = np.array([n1, n2] * 4, dtype=float)
    assert (changepoint._scan(k, n, 2, "binomial") > -1e-6).all() and math.isfinite(changepoint._scan(k, n, 2, "poisson").sum())
