"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexiquarry.plans import analysis, core, evaluation, models, registry, tables  # noqa: F401

DATA = "/root/testdata/sf0.001"
SAMPLE = ["series_annual", "lexicon_counts", "breakdown_topn", "by_country_periods", "standing_pivot", "compare_ranked", "matched_pairs", "kwic_filtered", "span_merge", "wbs_gains", "neighbourhood_purity", "ctfidf", "tar_texts", "ocr_finds", "audit_units", "neighbour_hits", "lemma_mismatched"]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    mine = registry.QUERIES[name](spark, DATA)
    theirs = con.sql(registry.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(cell(r[c]) for c in columns) for r in mine.collect())
    at = [theirs.columns.index(c) for c in columns]
    assert a == sorted(tuple(cell(r[i]) for i in at) for r in theirs.fetchall())
