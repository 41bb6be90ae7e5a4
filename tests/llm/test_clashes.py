"""Columns of the caller whose names the operators use inside, and a document that holds a third of its source."""

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import language_id, line_dedup, mixing, ngram_join, quality_rules, sentencepiece_fst, toxicity

NAMES = ["_p", "_P_", "_k", "_i", "_c", "_text", "_input", "row", "_row", "_l", "_r", "_h"]
TEXTS = ["the cat sat on the mat and looked around for more of it", "der hund lief durch den garten und bellte sehr laut dabei", "idiot scum " * 8, ""]


@pytest.fixture(scope="module")
def rows(spark):
    base = [(i, TEXTS[i % 4] + f" {i}", ("en", "de", "en", "en")[i % 4], "s", *[f"{n}-{i}" for n in NAMES]) for i in range(60)]
    return spark.createDataFrame(base, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def results(rows):
    labels = rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 2).cast("int").alias("toxic"))
    yield "identify", language_id.identify(rows, language_id.train(rows))
    yield "score", toxicity.score(rows, toxicity.train(rows, labels)[0])
    yield "encode", sentencepiece_fst.encode(rows)
    yield "mix", mixing.apply_mix(rows, mixing.mix(rows))
    yield "rules", quality_rules.line_frequency_rules(rows)
    yield "lines", line_dedup.dedup_lines(rows)
    yield "join", ngram_join.keep_one(rows)


def test_clashing_names(rows):
    for name, out in results(rows):
        kept = out.select("doc_id", *[f"`{n}`" for n in NAMES]).collect()
        assert kept, name
        for r in kept:
            assert [r[n] for n in NAMES] == [f"{n}-{r.doc_id}" for n in NAMES], name


@pytest.mark.parametrize("seed", range(4))
def test_large_document(spark, seed):
    """A document of more than its source's target left over is made up for by the others."""
    rows = [(i, "w " * (100 + 7 * (i % 13)), "z") for i in range(120)] + [(1000, "w " * 6000, "z")] + [(2000 + i, "w " * 40, "ab"[i % 7 > 2]) for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs, seed=seed).groupBy("source", "target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 110 and (r.source != "z" or r.source_size < r.target < 1.9 * r.source_size)


def test_mix_takes_the_same_of_equal_rows(spark):
    rows = [(1, "a b c", "s", f"lang{i}") for i in range(40)] + [(i, "x " * 10, "s", "en") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one, two = (sorted(map(tuple, mixing.apply_mix(d, mixing.mix(d)).collect())) for d in (docs, docs.repartition(7)))
    assert one == two
