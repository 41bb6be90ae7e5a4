"""Line dedup by winnowing over line hashes.

The window at a line is the shortest run of lines from there that has MIN_LINES
lines or MIN_WORDS words. Its fingerprint is the smallest line hash in it: equal
runs select equal fingerprints, wherever they stand. Fingerprints that are selected
at one position only are set aside; at the others the match is extended both ways,
window by window, against the first occurrence of the same window, and the lines of
every later occurrence go. The windows that start at the lines reach as far left as a
repeated run does, but may stop short of its end; for that, the shortest run up to each
line is a window too. Any line of a repeated run lies in a window of one kind or the
other inside the run. Built-in Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import documents

MIN_LINES, MIN_WORDS = 3, 50
SALTS = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _normal(text: Column) -> Column:
    """Lines of text in lower case with single blanks, trimmed."""
    one = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(_lines(one), lambda x: F.btrim(x))


def windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per window: _row, doc_id, i (first line, blank lines not counted), n (lines), fp, fp_at, key.

    A run that is the shortest from its first line and up to its last is one window.
    """
    lines = F.filter(_normal(F.col("text")), lambda x: x != "")
    base = docs.filter(F.col("text").isNotNull()).select("_row", "doc_id", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w"))).alias("_l"))

    def window_at(x: Column, i: Column) -> Column:
        n, total = F.lit(min_lines), x["w"]
        stops = [(1, total)]
        for k in range(1, min_lines - 1):
            total = total + F.coalesce(F.get("_l", i + k)["w"], F.lit(0))
            stops.append((k + 1, total))
        for k, total in reversed(stops):
            n = F.when(total >= min_words, F.lit(k)).otherwise(n)
        return F.struct(i.alias("i"), n.alias("n"))

    def window_to(x: Column, j: Column) -> Column:
        total = x["w"]
        stops = [(1, total)]
        for k in range(1, min_lines):
            total = total + F.coalesce(F.get("_l", j - k)["w"], F.lit(0))
            stops.append((k + 1, total))
        n, words = F.lit(min_lines), total
        for k, total in reversed(stops[:-1]):
            n, words = F.when(total >= min_words, F.lit(k)).otherwise(n), F.when(total >= min_words, total).otherwise(words)
        return F.struct((j - n + 1).alias("i"), n.alias("n"), (words - x["w"]).alias("before"))

    starts = F.filter(F.transform("_l", window_at), lambda x: x["i"] + x["n"] <= F.size("_l"))
    # Without its last line it has the words still: not the shortest run from its first line, so not among the starts.
    ends = F.filter(F.transform("_l", window_to), lambda x: (x["i"] >= 0) & (x["before"] >= min_words))
    both = F.concat(starts, F.transform(ends, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"))))
    spans = F.when(F.exists("_l", lambda x: x["w"] * (min_lines - 1) >= min_words), both).otherwise(starts)
    rows = base.withColumn("_h", F.transform("_l", lambda x: x["h"])).select("_row", "doc_id", "_h", F.explode(spans).alias("_s"))
    run = F.slice("_h", F.col("_s.i") + 1, F.col("_s.n"))
    low = F.array_min(run)
    return rows.select("_row", "doc_id", F.col("_s.i").alias("i"), F.col("_s.n").alias("n"), low.alias("fp"), (F.col("_s.i") + F.array_position(run, low) - 1).cast("int").alias("fp_at"), F.xxhash64(run, "_s.n").alias("key"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """_row and the numbers (blank lines not counted) of its lines that repeat an earlier run: _gone."""
    rows = windows(docs, min_lines, min_words).withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int"))
    place = F.struct("_row", "fp_at")
    shared = rows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("fp")
    candidates = rows.join(_salted(shared), ["fp", "_salt"], "left_semi")
    at = F.struct("doc_id", "_row", "i", "n")
    firsts = candidates.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first != last").select("key", "first")
    later = candidates.join(_salted(firsts), ["key", "_salt"]).filter(at != F.col("first"))
    inside = F.when(F.col("first._row") == F.col("_row"), F.greatest("i", F.col("first.i") + F.col("first.n"))).otherwise(F.col("i"))
    gone = later.select("_row", inside.alias("a"), (F.col("i") + F.col("n") - 1).alias("b")).filter("a <= b")
    return gone.groupBy("_row").agg(F.collect_set(F.struct("a", "b")).alias("_r")).select("_row", F.array_distinct(F.flatten(F.transform("_r", lambda x: F.sequence(x["a"], x["b"])))).alias("_gone"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) without the lines of later repeated runs; also n_lines, n_deleted_lines.

    A run counts from min_lines lines or min_words words on. Earlier means a
    smaller doc_id (null before all), then the hash of id and text, then the place
    in the text; a run that overlaps its own first occurrence loses only what goes
    beyond it. Lines are compared in lower case with single blanks, blank lines
    neither count nor part a run. Null texts stay null, texts whose lines all go
    become empty, no row is dropped. Rows that repeat id and text are one document.
    Other columns are kept; those named n_lines or n_deleted_lines are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted_lines")]
    rows = docs.select(F.struct(*kept).alias("others"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    joined = rows.join(repeated_lines(rows, min_lines, min_words), "_row", "left")
    numbers = F.transform(_normal(F.col("text")), lambda x, i: F.when(x != "", i))
    full = F.filter(numbers, lambda i: i.isNotNull())
    lines = joined.withColumn("n_lines", F.coalesce(F.size(full), F.lit(0)).cast("long"))
    lines = lines.withColumn("n_deleted_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    cut = lines.filter(F.col("_gone").isNotNull()).withColumn("_full", full).withColumn("_all", _lines(F.col("text")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.transform("_gone", lambda i: F.get("_full", i)))
    cut = cut.withColumn("text", F.array_join(F.transform(keep, lambda i: F.get("_all", i)), "\n"))
    new = ("text", "n_lines", "n_deleted_lines")
    both = lines.filter(F.col("_gone").isNull()).select("others", *new).union(cut.select("others", *new))
    names = [c for c in docs.columns if c not in new[1:]]
    return both.select(*(F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in names), *new[1:])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted_lines", "text")


OP8_SQL = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
norm AS (SELECT doc_id, p, l, trim(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS x FROM raw),
full_lines AS (SELECT doc_id, p, x, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, length(x) - length(replace(x, ' ', '')) + 1 AS w FROM norm WHERE x <> ''),
ahead AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, coalesce(lead(w, 1) OVER o, 0) AS w1 FROM full_lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ok AS (SELECT doc_id, i, 1 AS n, x AS k FROM ahead WHERE w >= 50
       UNION ALL SELECT doc_id, i, 2, x || chr(10) || x1 FROM ahead WHERE x1 IS NOT NULL AND w + w1 >= 50
       UNION ALL SELECT doc_id, i, 3, x || chr(10) || x1 || chr(10) || x2 FROM ahead WHERE x2 IS NOT NULL),
first AS (SELECT k, n, min({'d': doc_id, 'i': i}) AS f FROM ok GROUP BY k, n),
later AS (SELECT ok.doc_id, CASE WHEN f.d = ok.doc_id THEN greatest(ok.i, f.i + ok.n) ELSE ok.i END AS a, ok.i + ok.n - 1 AS b FROM ok JOIN first USING (k, n) WHERE f.d <> ok.doc_id OR f.i <> ok.i),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later),
gone_p AS (SELECT g.doc_id, fl.p FROM gone g JOIN full_lines fl ON fl.doc_id = g.doc_id AND fl.i = g.i),
kept AS (SELECT n.doc_id, string_agg(n.l, chr(10) ORDER BY n.p) AS t FROM norm n LEFT JOIN gone_p g ON g.doc_id = n.doc_id AND g.p = n.p WHERE g.p IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
       coalesce((SELECT count(*) FROM gone_p g WHERE g.doc_id = d.doc_id), 0)::BIGINT AS n_deleted_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
