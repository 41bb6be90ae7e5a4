"""The stages of the corpus pipeline on small tables: nulls, empty and repeated rows, clashing names, no rows at all."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(8)
    out = [(i, "\n".join(" ".join(rng.choices(WORDS, k=9)) for _ in range(6)), ("en", "de")[i % 2], ("a", "b", None)[i % 3], 0) for i in range(80)]
    out += [(90, out[3][1], "en", "a", 0), (91, out[4][1] + " more", "en", "b", 0), (3, *out[3][1:])]
    return out + [(92, None, None, None, None), (93, "", "en", "a", 0), (None, "no id " * 9, "en", "a", 0), (94, "word " * 30_000, "en", "b", 0)]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    identified = corpus_pipeline.identify_languages(spark, docs, "")
    assert identified.columns == docs.columns
    ids = {r.doc_id for r in identified.collect()}
    assert ids >= set(range(80)) and not ids & {92, 93}
    cut = corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()
    assert len(cut) == len(rows()) and [r.text for r in cut if r.doc_id == 90] == [""] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert kept.count(3) == 1 and 90 not in kept and 91 not in kept and set(range(80)) <= set(kept) and {92, 93, 94, None} <= set(kept)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    encoded = corpus_pipeline.encode_texts(spark, docs, "").collect()
    assert len(encoded) == len(rows()) and all(r.round_trip for r in encoded)


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and all(r.round_trip and len(r.ids) == r.n_tokens for r in out.collect())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
