"""Concordances: lines, sentences, filters, sorts and reader segments."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexiquarry.operators.lexicon import Lexicon, scan, term_columns

# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "hon", "amb", "gen", "capt",
    "no", "nos", "art", "arts", "para", "paras", "pp", "p", "vol", "ch", "chap",
    "fig", "sect", "sec", "ibid", "op", "cit", "ed", "eds", "cf", "viz", "al",
    "e.g", "i.e", "etc", "approx", "incl", "min", "max", "est",
    "inc", "ltd", "co", "corp", "u.s", "u.n", "u.k", "a.m", "p.m",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec",
)
# Fixed value: what ends a sentence and what may begin the next. Before it, the letters and full stops that it follows.
BOUNDARY = re.compile("(?<![^\\W\\d_.])((?:[^\\W\\d_]|\\.)*?)([.!?]+)[\"'’”)\\]]*(\\s+)(?=[\"'‘“(\\[]*[A-Z0-9])")
# Fixed value: white space as Unicode has it.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def split_sentences(source: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences, without the white space between them; neither an initial nor an abbreviation ends one."""
    source, gaps = source or "", []
    for m in BOUNDARY.finditer(source):
        word, marks = m[1], m[2]
        initial = len(word) == 1 and word.isupper()
        if not (marks[0] == "." and (initial or word.strip(".").lower() in ABBREVIATIONS)):
            gaps.append(m.span(3))
    begins, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(source)]
    return [span for span in zip(begins, ends) if span[0] < span[1]]


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def sentence_spans(texts: pd.Series) -> pd.Series:
    """split_sentences of a column: what an abbreviation joins can't be said by a built-in expression."""
    return pd.Series([[{"start": a, "end": b} for a, b in split_sentences(t)] for t in texts], dtype=object)


def flat(source: str) -> str:
    return BLANKS.sub(" ", source).strip(" ")


LINE = "array<struct<i:int,ordinal:int,start:int,end:int,left:string,kw:string,right:string,sent:string>>"


def review_sheet(drawn: DataFrame, speeches: DataFrame, key: str = "row_id", body: str = "text", width: int = 150, keep: tuple[str, ...] = ()) -> DataFrame:
    """drawn (of lexicon.audit_units) with columns of the speeches, the match in its context, and the reviewer's columns, empty.

    What is drawn is bounded by the sizes asked for, so it is broadcast to the texts.
    """
    rows = speeches.select(key, *keep, F.col(body).alias("_body")).join(F.broadcast(drawn), key)
    begin = F.greatest(F.col("start") - width, F.lit(0))
    cuts = {"left": (begin, F.col("start") - begin), "keyword": (F.col("start"), F.col("end") - F.col("start")), "right": (F.col("end"), F.lit(width))}
    parts = {c: F.trim(F.regexp_replace(F.substring("_body", at + 1, n), BLANKS.pattern, " ")) for c, (at, n) in cuts.items()}
    return rows.withColumns(parts | {c: F.lit("") for c in ("verdict", "source_checked", "phenomenon", "comment")}).drop("_body")


def lines(speeches: DataFrame, lexicon: Lexicon, keep: list[str], width: int = 150, sentences: bool = True, body: str = "text") -> DataFrame:
    """One concordance line per match: keep, term, ordinal, start, end, id, left, kw, right, sent.

    The id is the meeting, the speech number and the match's place in the speech; sent is
    the last sentence that starts at or before the match. One scan of a text gives all its
    lines, so that the text isn't copied to each of them. Rows go to Python by the hundred
    and come back as tuples, not as Arrow batches of 10,000 texts with all their lines, so
    that a worker's memory doesn't grow with the table.
    """
    terms = lexicon.active

    @F.udf(LINE, useArrow=False)
    def found(source: str | None) -> list[tuple] | None:
        if source is None:
            return None
        spans = split_sentences(source) if sentences else []
        begins, said, out = [a for a, _ in spans], {-1: ""}, []
        for i, k, start, end in scan(source, terms):
            at = bisect_right(begins, start) - 1
            if at not in said:
                said = {-1: "", at: flat(source[slice(*spans[at])])}
            context = (source[max(start - width, 0) : start], source[start:end], source[end : end + width])
            left, kw, right = map(flat, context)
            out.append((i, k, start, end, left, kw, right, said[at]))
        return out

    rows = speeches.select(*keep, "meeting_symbol", "speech_number", F.explode(found(F.col(body))).alias("_m"))
    last = ["_m.sent"] if sentences else []
    name = F.format_string("%s_spch%04d#%d", "meeting_symbol", "speech_number", "_m.ordinal").alias("id")
    return rows.select(*keep, "meeting_symbol", "speech_number", term_columns(terms, F.col("_m.i"))[0], "_m.ordinal", "_m.start", "_m.end", name, "_m.left", "_m.kw", "_m.right", *last)


def index(concordance: DataFrame) -> DataFrame:
    """Per term: lines, speeches, and the lengths of its sentences."""
    n = F.length("sent")
    q = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95)))
    out = concordance.groupBy("term").agg(F.count("*").alias("lines"), F.countDistinct("row_id").alias("speeches"), q.alias("_q"), F.max(n).alias("longest"), F.count_if(n > 500).alias("over_500"))
    return out.select("term", "lines", "speeches", F.get("_q", F.lit(0)).alias("median"), F.round(F.get("_q", F.lit(1)), 6).alias("p95"), "longest", "over_500")


def filtered(concordance: DataFrame, years: tuple[int | None, int | None] = (None, None), month: str | int | None = None, group: str | None = None, speaker: str | None = None, agenda: str | None = None, meeting: str | None = None, query: str | None = None, regex: bool = False) -> DataFrame:
    """Lines that pass every filter given. A malformed month or pattern filters nothing."""
    out = concordance
    if years[0] is not None:
        out = out.filter(F.col("year") >= years[0])
    if years[1] is not None:
        out = out.filter(F.col("year") <= years[1])
    if month is not None and re.fullmatch("0?[1-9]|1[0-2]", str(month)):
        out = out.filter(F.col("month") == int(month))
    for column, value in (("speaker_group", group), ("country_org", speaker), ("agenda", agenda), ("meeting_symbol", meeting)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if query:
        whole = F.concat_ws(" ", "left", "kw", "right")
        if not regex:
            out = out.filter(F.lower(whole).contains(query.lower()))
        else:
            try:
                re.compile(query)
                out = out.filter(whole.rlike(f"(?i){query}"))
            except re.error:
                pass
    return out


def sort_keys(order: str) -> list[Column]:
    """Orderings of a concordance; ids break ties. `left` reads the left context backwards."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z ]", "")
    keys = {
        "date": [F.col("date")],
        "country": [F.col("country_org"), F.col("date")],
        "agenda": [F.col("agenda").asc_nulls_last(), F.col("date")],
        "left": [F.reverse(plain("left"))],
        "right": [F.lower("right")],
    }
    if order not in keys:
        raise ValueError(f"unknown ordering {order!r}")
    return [*keys[order], F.col("id"), F.col("term")]


def page(concordance: DataFrame, order: str, number: int, size: int = 60) -> DataFrame:
    return concordance.orderBy(*sort_keys(order)).offset(number * size).limit(size)


def merged_spans(occurrence_rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Overlapping spans of a speech as one: key, start, end, terms (sorted). Spans that only touch stay apart."""
    w = Window.partitionBy(key).orderBy("start", "end", "term")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = occurrence_rows.withColumn("_new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    islands = islands.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("term")).alias("terms")).drop("_i")


def reader_segments(speeches: DataFrame, spans: DataFrame, key: str = "row_id", body: str = "text") -> DataFrame:
    """The text of each speech as runs (key, segment, text, terms); plain runs have no terms."""
    per = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "terms"))).alias("_s"))
    j = speeches.select(key, body).join(per, key, "left")
    none = F.array().cast("array<string>")
    s = F.coalesce("_s", F.array().cast("array<struct<start:int,end:int,terms:array<string>>>"))
    j = j.withColumn("_s", s)
    edge = F.col("_s")

    def both(x: Column, i: Column) -> Column:
        begin = F.coalesce(F.get(edge, i - 1)["end"], F.lit(0))
        return F.array(F.struct(begin.alias("a"), x["start"].alias("b"), none.alias("terms")), F.struct(x["start"].alias("a"), x["end"].alias("b"), x["terms"].alias("terms")))

    tail = F.struct(F.coalesce(F.get(edge, F.size(edge) - 1)["end"], F.lit(0)).alias("a"), F.length(body).alias("b"), none.alias("terms"))
    runs = F.filter(F.concat(F.flatten(F.transform(edge, both)), F.array(tail)), lambda r: r["b"] > r["a"])
    return j.select(key, body, F.posexplode(runs).alias("segment", "r")).select(key, "segment", F.substr(body, F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("text"), "r.terms")


def meeting_summary(occurrence_rows: DataFrame, speeches: DataFrame) -> DataFrame:
    """meeting_symbol, speeches, terms (distinct, sorted), occurrences."""
    own = occurrence_rows.groupBy("meeting_symbol").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.count("*").alias("occurrences"))
    held = speeches.groupBy("meeting_symbol").agg(F.count("*").alias("speeches"))
    return held.join(own, "meeting_symbol", "left").select("meeting_symbol", "speeches", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def speech_export(speeches: DataFrame, occurrence_rows: DataFrame, only_bearing: bool = False) -> DataFrame:
    """A row per meeting: its speeches in order with text and {term: spans}, as JSON."""
    hits = occurrence_rows.groupBy("row_id", "term").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("spans"))
    hits = hits.groupBy("row_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "spans")))).alias("hits"))
    rows = speeches.join(hits, "row_id", "left")
    if only_bearing:
        rows = rows.join(rows.filter("hits IS NOT NULL").select("meeting_symbol").distinct(), "meeting_symbol", "left_semi")
    speech = F.to_json(F.struct("speech_number", "row_id", "country_org", "text", "hits")).alias("json")
    ordered = F.sort_array(F.collect_list(F.struct("speech_number", "row_id", speech)))
    return rows.groupBy("meeting_symbol").agg(F.concat(F.lit("["), F.array_join(ordered["json"], ","), F.lit("]")).alias("speeches"))
