"""Labels rounded as SQL does, and vocabularies without a bound."""

from pyspark.sql import functions as F
from lexiquarry.functions import text
from lexiquarry.operators import topics


def test_byte_labels_at_ties(spark):
    """395.95 and 1.25 are ties as written; only the second one is a tie as a double."""
    n = [50_000 * k for k in range(20, 4000, 3)] + [5 * 10**7 * k for k in range(20, 2000, 7)] + [500 * k for k in range(2, 1999)] + [395_950_000, 999_950_000, 999_949_999, 8_123_456_789_012_345]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", text.byte_label(F.col("n"))).collect()
    unit = lambda x: ("%.1f GB", 1e9) if x >= 1e9 else ("%.1f MB", 1e6) if x >= 1e6 else ("%.0f kB", 1e3)
    assert [(k, v) for k, v in rows] == [(x, unit(x)[0] % (x / unit(x)[1])) for x in n]
    assert dict(rows)[395_950_000] == "395.9 MB"


def test_tfidf_without_a_bound(spark):
    """As many words as there are in bounds of frequency, beyond the usual 50,000."""
    docs = spark.range(10).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(1), F.when(F.col("id") < 5, 50_003).otherwise(1))).alias("i"))
    terms = docs.select("row_id", F.concat(F.lit("w"), F.when(F.col("row_id") < 5, F.col("i")).otherwise(-F.col("row_id"))).alias("word"), F.lit(1).alias("n"))
    count = lambda **k: {r[0]: r[1] for r in topics.tfidf(terms, **k).groupBy("row_id").count().collect()}
    assert count(features=None) == dict.fromkeys(range(5), 50_003) and count() == dict.fromkeys(range(5), 50_000)
