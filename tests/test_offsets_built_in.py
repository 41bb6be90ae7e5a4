"""Token offsets and the tagger's spans are looked up by built-in functions: no worker of Python holds thousands of texts."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators import lemmas, tokens
from lexiquarry.plans import analysis, core, evaluation, models, registry, tables  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["lemma_align", "token_offsets", "lemma_mapping", "lemma_layer", "lemma_mismatched", "stopword_leaks"])
def test_offsets_without_python(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert plan.count("A$1") <= 1  # the offsets are found once


def test_starts_of_odd_texts(spark):
    rng = random.Random(1)
    texts = ["", "'a", "--ab'c -d’", "a", "-", "\n\na\nb", "x" * 70_000 + " y -z", "é " * 40_000 + "İa😀b"]
    texts += ["".join(rng.choice("abz'’- \n\x01éİ😀A") for _ in range(rng.randint(1, 3000))) for _ in range(50)]
    frame = spark.createDataFrame([*enumerate(texts), (-1, None)], "row_id long, text string")
    for r in frame.select(F.lower("text").alias("low"), tokens.located(F.col("text")).alias("found")).collect():
        assert [tuple(x) for x in r.found] == [(m[0], m.start()) for m in re.finditer(text.TOKEN, r.low or "")]


def test_spans_out_of_order(spark):
    """Without an order, with none, with nulls and before the text; the longest of equal starts counts."""
    spans = [(6, 9, "c"), (0, 1, "x"), (0, 3, "A"), (None, 2, "n"), (-4, 2, "m"), (20, None, "e")]
    frame = spark.createDataFrame([(1, "abs de-f ghs", spans), (2, "one two", []), (3, "three", None), (4, "", [(0, 4, "y")])], "row_id long, text string, spans array<struct<start:int,end:int,lemma:string>>")
    got = [tuple(r) for r in lemmas.align(frame).orderBy("row_id", "pos").collect()]
    assert got == [(1, 0, "abs", "a", False), (1, 1, "de-f", "de-f", False), (1, 2, "ghs", "ghs", False), (2, 0, "one", "one", False), (2, 1, "two", "two", False), (3, 0, "three", "three", False)]
