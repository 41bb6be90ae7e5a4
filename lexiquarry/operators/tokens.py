"""The token table, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text


def token_starts(low: Column) -> Column:
    """Where the tokens of a text in lower case start, in code points.

    The first letter of each token becomes a capital, which no such text has, and the
    capitals are looked up by pieces of 65,536 characters: time grows with the text, and
    what a task holds besides the tokens is one piece.
    """
    marked = F.regexp_replace(low, "[a-z]([a-z'’-]*)", "A$1")
    pieces = F.regexp_extract_all(marked, F.lit("(?s).{1,65536}"), F.lit(0))

    def found(piece: Column, k: Column) -> Column:
        return F.filter(F.transform(F.split(piece, ""), lambda c, i: F.when(c == "A", k * 65536 + i)), lambda x: x.isNotNull())

    return F.flatten(F.transform(pieces, found))


def located(body: Column) -> Column:
    """The tokens of a text as an array of (word, start)."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.arrays_zip(F.regexp_extract_all(low, F.lit(text.TOKEN), F.lit(0)).alias("word"), token_starts(low).alias("start"))


def token_table(frame: DataFrame, keep: list[str], body: str = "text", offsets: bool = False) -> DataFrame:
    """keep, pos and word of every token; with offsets also start."""
    if not offsets:
        return frame.select(*keep, F.posexplode(text.tokens(F.col(body))).alias("pos", "word"))
    # posexplode would have the optimiser compute the tokens once more, for a filter on their number.
    rows = frame.select(*keep, F.posexplode_outer(located(F.col(body))).alias("pos", "z"))
    return rows.filter("pos IS NOT NULL").select(*keep, "pos", F.col("z.word").alias("word"), F.col("z.start").alias("start"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def document_terms(tokens: DataFrame, key: str = "row_id") -> DataFrame:
    return tokens.groupBy(key, "word").agg(F.count("*").alias("n"))


def totals(terms: DataFrame, chosen: DataFrame, key: str = "row_id") -> DataFrame:
    """Word counts over the chosen documents."""
    return terms.join(chosen.select(key).distinct(), key, "left_semi").groupBy("word").agg(F.sum("n").alias("n"))


def occurring(frame: DataFrame, keep: list[str], body: str = "text") -> DataFrame:
    """keep, word and n = 1 of every token: its sums are those of document_terms, without a shuffle of the tokens."""
    return token_table(frame, keep, body).select(*keep, "word", F.lit(1).cast("long").alias("n"))


def distinct_words(frame: DataFrame, keep: list[str], body: str = "text") -> DataFrame:
    """keep and word, once for each row of frame and word in it, without a shuffle."""
    return frame.select(*keep, F.explode(F.array_distinct(text.tokens(F.col(body)))).alias("word"))


def subset_counts(frame: DataFrame, chosen: Column, body: str = "text") -> tuple[DataFrame, DataFrame]:
    """(word, n) over the rows of frame that chosen holds for, and over all of them.

    Words are counted where the texts lie, so that only counts of words travel.
    """
    rows = occurring(frame.select(body, F.coalesce(chosen, F.lit(False)).alias("_in")), ["_in"], body)
    both = rows.groupBy("word").agg(F.sum("n").alias("_all"), F.count_if("_in").alias("_own"))
    return both.filter("_own > 0").select("word", F.col("_own").alias("n")), both.select("word", F.col("_all").alias("n"))


def self_reference(word: Column, name: Column) -> Column:
    return F.array_contains(text.tokens(name), word)
