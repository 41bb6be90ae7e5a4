"""Quality rules: per-text statistics, and lines that too many documents of a host share.

Built-in Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import SPACE_CHARS, documents, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line goes if more than MIN_DOCS documents of its host have it, and more than MAX_SHARE of them or MAX_DOCS.
MIN_DOCS, MAX_SHARE, MAX_DOCS = 20, 0.005, 10_000
#: A document is depleted if less than this share of its line characters stays.
MIN_KEPT = 0.3
SALTS = 16


def _covered(w: Column) -> Column:
    """Sum of the word positions that windows starting at the sorted positions w cover."""
    steps = F.transform(w, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(w, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs (text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null texts count as empty. A window that occurs twice or more in a text marks
    all words of all its occurrences; windows are compared by a 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.withColumns({"_w": words(F.col("text")), "_chars": F.translate(text, SPACE_CHARS, "")})
    one = one.withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0))
    n = F.size("_w")
    two = one.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length("_chars").cast("long"),
            "n_symbols": (F.length("_chars") - F.length(F.translate("_chars", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))),
        }
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    three = two.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]))
    four = three.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = four.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_p")), F.lit(0)).cast("long")).withColumn("base_failed", failed)
    return out.drop("_w", "_chars", "_l", "_h", "_s", "_p")


def normal_lines(text: Column) -> Column:
    """Lines that hold a word: lower case, runs of digits as 0, runs of white space as one blank."""
    one = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    two = F.regexp_replace(one, r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(two, "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Hashes of the lines above the limits: _host, _line, n_docs (distinct documents of the host), host_docs.

    docs has _row, a hash of id, host and text: rows equal in these are one document.
    """
    hosts = F.xxhash64(host)
    seen = docs.select(hosts.alias("_host"), "_row", F.explode(F.array_distinct(F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("_line"))
    many = seen.groupBy("_host", "_line").agg(F.count_distinct("_row").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    sizes = docs.groupBy(hosts.alias("_host")).agg(F.count_distinct("_row").alias("host_docs"))
    return many.join(sizes, "_host").filter(F.col("n_docs") > F.least(F.col("host_docs") * max_share, F.lit(MAX_DOCS)))


def line_frequency_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """docs and base statistics, line_chars, removed_chars, n_removed_lines, kept, clean_text.

    A line is removed if more than min_docs documents of its host, and more than
    max_share of them or MAX_DOCS, have it; a document is depleted, and not kept, if less than
    min_kept of its line characters stays. clean_text is the text without removed
    lines (costs a shuffle of the texts, and only if it is selected). A row is a
    document, except that rows equal in id, host and text share one verdict. Null
    hosts form a host of their own; null texts have no lines. Columns of docs whose
    names clash with the new ones are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed_chars", "n_removed_lines", "kept", "clean_text")
    whole = docs.drop(*new)
    # Under names of their own, so that columns of any name are kept and those not asked for are left unread.
    own = [(f"_kept{i}", c) for i, c in enumerate(whole.columns)]
    docs = whole.select(*(F.col(c).alias(k) for k, c in own), "doc_id", host, "text", F.xxhash64("doc_id", host, "text").alias("_row"))
    often = frequent_lines(docs, host, min_docs, max_share)
    salted = often.select("_host", "_line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    lines = docs.select("_row", F.xxhash64(host).alias("_host"), F.explode(F.transform(normal_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))).alias("_x"))
    lines = lines.select("_row", "_host", F.col("_x.h").alias("_line"), F.col("_x.n").alias("_n"), F.pmod("_row", F.lit(SALTS)).cast("int").alias("_salt"))
    found = lines.join(salted, ["_host", "_line", "_salt"])
    copies = docs.groupBy("_row").agg(F.count("*").alias("_copies"))
    hits = found.groupBy("_row").agg(F.sum("_n").alias("_chars"), F.count("*").alias("_lines"), F.collect_set("_line").alias("_gone"))
    hits = hits.join(copies, "_row").select("_row", (F.col("_chars") / F.col("_copies")).cast("long").alias("removed_chars"), (F.col("_lines") / F.col("_copies")).cast("long").alias("n_removed_lines"), "_gone")
    rows = base_statistics(docs).withColumn("line_chars", F.aggregate(normal_lines(F.col("text")), F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    out = rows.join(hits, "_row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("removed_chars", "n_removed_lines")})
    depleted = (F.col("line_chars") - F.col("removed_chars")) < F.col("line_chars") * min_kept
    done = out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumn("clean_text", _without(F.col("text"), F.col("_gone")))
    return done.select(*(F.col(k).alias(c) for k, c in own), *new)


def _without(text: Column, gone: Column) -> Column:
    norm = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "))
    left = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, F.xxhash64(norm(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_frequency_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars", "n_removed_lines"
    )


OP2_SQL = r"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, min(rid) OVER (PARTITION BY doc_id, source, t) AS one FROM d0),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
raw AS (SELECT rid, one, source, unnest(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS l FROM d),
ln AS (SELECT rid, one, source, trim(l, ' ') AS l FROM raw WHERE trim(l, ' ') <> ''),
host AS (SELECT source, count(DISTINCT one) AS host_docs FROM d GROUP BY source),
often AS (SELECT f.source, f.l FROM (SELECT source, l, count(DISTINCT one) AS c FROM ln GROUP BY source, l) f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE c > 20 AND c > least(host_docs * 0.005, 10000)),
sums AS (SELECT ln.rid, sum(length(ln.l))::BIGINT AS line_chars, coalesce(sum(length(ln.l)) FILTER (o.l IS NOT NULL), 0)::BIGINT AS removed_chars, count(o.l)::BIGINT AS n_removed_lines
         FROM ln LEFT JOIN often o ON ln.l = o.l AND ln.source IS NOT DISTINCT FROM o.source GROUP BY ln.rid),
s AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
             coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN sums USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_chars - removed_chars >= line_chars * 0.3 AS kept, line_chars, removed_chars, n_removed_lines
FROM s
"""
