"""What travels: counts of words and whole texts, not every token of the corpus."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import lexical, tokens, topics
from lexiquarry.plans import analysis, core, evaluation, models, registry, tables  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["compare_ranked", "keyness_bars", "keyness_unmatched", "keyness_matched", "matching_effect", "speaker_keyness"])
def test_no_term_table_travels(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\(row_id#\d+L?, word#", plan)


def test_keyness_of_texts_and_terms(spark):
    """Texts that are parted at their pairs give what the term table gives; a text may be in several pairs."""
    rows = [(k, " ".join(f"w{'abcdefg'[j % (k % 5 + 2)]}" for j in range(40 + k)) if k % 7 else None) for k in range(30)]
    speeches = spark.createDataFrame(rows, "row_id long, text string")
    pairs = spark.createDataFrame([(k % 2, k, (k * 5 + 1) % 30) for k in range(20)], "g long, target_id long, control_id long")
    terms = tokens.document_terms(tokens.token_table(speeches, ["row_id"]))
    for by in ([], ["g"]):
        a, b = (sorted(map(tuple, lexical.keyness(x, pairs, ["wa"], by, 5).collect())) for x in (terms, speeches))
        assert a == b and a


def test_counts_without_term_table(spark):
    frame = spark.createDataFrame([(1, "a b b c", 0), (2, "b c", None), (3, None, 1), (4, "b", 1), (5, "b x", -1)], "row_id long, text string, topic int")
    own, whole = tokens.subset_counts(frame, F.col("topic") == 0)
    assert dict(own.collect()) == {"a": 1, "b": 2, "c": 1} and dict(whole.collect()) == {"a": 1, "b": 5, "c": 2, "x": 1}
    assert sorted(map(tuple, tokens.distinct_words(frame, ["row_id"]).collect()))[:3] == [(1, "a"), (1, "b"), (1, "c")]
    terms = tokens.document_terms(tokens.token_table(frame, ["row_id"]))
    x, y = topics.ctfidf(terms, frame.select("row_id", "topic"), minimum=1), topics.ctfidf(tokens.occurring(frame, ["topic"]), minimum=1)
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) and x.count() == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["lemma_align", "lemma_layer", "token_offsets"])
def test_offsets_stay_in_their_row(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["kwic_lines", "kwic_sort_agenda", "collocates_w5", "collocates_w15", "collocates_sliced"])
def test_matches_come_row_by_row(spark, name):
    """Texts with all their matches are not gathered by the 10,000 in a Python worker."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython [found(" in plan and "ArrowEvalPython [found(" not in plan


def test_deal_by_hash(spark):
    """Words at the places that the digits of their hashes give; the digits travel as numbers, not as text."""
    rows = [(k, p, f"w{(k * 7 + p) % 11}") for k in range(30) for p in range(20)]
    dealt = topics.deal_words(spark.createDataFrame(rows, "row_id long, pos int, word string"), 5)
    of = lambda salt, r: (hashlib.md5(f"{salt}{r[0]}:{r[1]}".encode()).hexdigest(), r[0], r[1])
    words, places = sorted(rows, key=lambda r: of("5:deal:", r)), sorted(rows, key=lambda r: of("", r))
    assert {(r.row_id, r.pos): r.word for r in dealt.collect()} == {p[:2]: w[2] for p, w in zip(places, words)}
    orders = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)\)", dealt._jdf.queryExecution().optimizedPlan().toString())
    assert orders and all("_p#" in o for o in orders)
