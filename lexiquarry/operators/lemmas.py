"""Lemma layers: aligning a tagger's spans with tokens, and what lemmas merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators.tokens import located


def last_spans(tokens: Column, spans: Column) -> Column:
    """Per token start the last span (start, end, lemma) that starts at or before it, or null; both are in order.

    Sorted together, spans first, a token has as many spans before it as its place has moved.
    """
    starts = spans["start"]
    events = F.sort_array(F.concat(F.transform(starts, lambda a: a.cast("long") * 2), F.transform(tokens, lambda t: t.cast("long") * 2 + 1)))
    moved = F.filter(F.transform(events, lambda e, place: F.when(e % 2 != 0, place)), lambda x: x.isNotNull())
    return F.when(starts == tokens, spans).otherwise(F.transform(moved, lambda place, k: F.get(spans, place - k - 1)))


def aligned(
    frame: DataFrame, tagged: DataFrame | None = None, key: str = "row_id", body: str = "text", spans: str = "spans", keep: tuple[str, ...] = (), tokens: str | None = None
) -> DataFrame:
    """key, keep and aligned: an array of (word, lemma, refused) of the row's tokens.

    tagged has (key, start, end, lemma). Without it, frame has them itself, as an array in
    the column spans: a tagger's answer to one text. Then nothing is shuffled; else one
    array per text is. tokens names a column of what tokens.located gives for body, if
    frame has it.

    Of the tagger's spans the last one that starts at or before a token counts (of equal
    starts the longest). Its lemma is taken if it covers the whole token and the lemma is
    itself one word; a span that covers only the token's start, or another lemma, is
    refused and the word stands. Texts that change length in lower case keep their words.
    """
    found = (F.col(tokens) if tokens else located(F.col(body))).alias("_tokens")
    if tagged is not None:
        listed = tagged.groupBy(key).agg(F.collect_list(F.struct("start", "end", "lemma")).alias("_given"))
        rows = frame.select(key, *keep, body, found).join(listed, key, "left")
    else:
        rows = frame.select(key, *keep, body, found, F.col(spans).alias("_given"))
    given = F.coalesce("_given", F.array().cast("array<struct<start:int,end:int,lemma:string>>"))
    ordered = F.sort_array(F.filter(given, lambda s: s["start"].isNotNull()))
    steady = F.coalesce(F.length(F.lower(body)) == F.length(body), F.lit(False))
    # A generator of one row: else the optimiser may compute the spans anew for every token that looks one up.
    once = F.inline(F.array(F.struct(F.col("_tokens").alias("_found"), steady.alias("_ok"), ordered.alias("_spans"))))
    rows = rows.select(key, *keep, once)

    def judged(token: Column, span: Column) -> Column:
        lemma, covered = F.lower(F.trim(span["lemma"])), F.coalesce(span["end"] > token["start"], F.lit(False))
        good = covered & F.col("_ok") & (span["end"] >= token["start"] + F.length(token["word"])) & lemma.rlike(f"^{text.TOKEN}$")
        return F.struct(token["word"].alias("word"), F.when(good, lemma).alias("lemma"), covered.alias("covered"))

    def settled(x: Column) -> Column:
        return F.struct(x["word"].alias("word"), F.coalesce(x["lemma"], x["word"]).alias("lemma"), (x["covered"] & x["lemma"].isNull()).alias("refused"))

    last = last_spans(F.col("_found")["start"], F.col("_spans"))
    return rows.select(key, *keep, F.transform(F.zip_with("_found", last, judged), settled).alias("aligned"))


def align(frame: DataFrame, tagged: DataFrame | None = None, key: str = "row_id", body: str = "text", spans: str = "spans", tokens: str | None = None) -> DataFrame:
    """key, pos, word, lemma, refused for every token; see aligned."""
    # posexplode would have the optimiser compute the array once more, for a filter on its size.
    rows = aligned(frame, tagged, key, body, spans, tokens=tokens).select(key, F.posexplode_outer("aligned").alias("pos", "_x"))
    return rows.filter("pos IS NOT NULL").select(key, "pos", "_x.*")


def layer(
    frame: DataFrame, tagged: DataFrame | None = None, key: str = "row_id", body: str = "text", spans: str = "spans", keep: tuple[str, ...] = (), tokens: str | None = None
) -> DataFrame:
    """key, keep and the lemmas of each text with words, as of encode, without exploding the tokens."""
    rows = aligned(frame.filter(F.lower(body).rlike("[a-z]")), tagged, key, body, spans, keep, tokens)
    return rows.select(key, *keep, F.array_join("aligned.lemma", " ").alias("lemmas"))


def encode(aligned: DataFrame, key: str = "row_id") -> DataFrame:
    """key and its lemmas in token order, joined by blanks."""
    return aligned.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "lemma")))["lemma"], " ").alias("lemmas"))


def decode(lemmas: Column) -> Column:
    return F.when(F.length(lemmas) > 0, F.split(lemmas, " ")).otherwise(F.array().cast("array<string>"))


def mismatched(frame: DataFrame, layer: DataFrame, key: str = "row_id", body: str = "text") -> DataFrame:
    """Rows whose layer is missing or has another number of words than the text."""
    held = layer.select(key, F.size(decode(F.coalesce("lemmas", F.lit("")))).alias("lemmas"))
    j = frame.select(key, F.size(text.tokens(F.col(body))).alias("tokens")).join(held, key, "left")
    return j.select(key, "tokens", F.coalesce("lemmas", F.lit(0)).alias("lemmas")).filter("tokens != lemmas")


def mapping(aligned: DataFrame) -> DataFrame:
    """lemma, surface, n, forms (surfaces of the lemma) of every pair."""
    pairs = aligned.groupBy("lemma", F.col("word").alias("surface")).agg(F.count("*").alias("n"))
    return pairs.withColumn("forms", F.count("*").over(Window.partitionBy("lemma")))


def stopword_leaks(pairs: DataFrame, stop: list[str]) -> DataFrame:
    """Stop words whose lemma is none."""
    return pairs.filter(F.col("surface").isin(stop) & ~F.col("lemma").isin(stop)).select("surface", "lemma", "n")
