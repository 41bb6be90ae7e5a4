"""Speeches, dimensions and a lexicon out of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators.lexicon import Lexicon, Term, flag

SLICES = ((1992, 1999), (2000, 2007), (2008, 2015), (2016, 2023))
STOP = ["the", "of", "and", "to", "in", "a", "that", "de", "la", "der", "die", "und"]

LEXICON = Lexicon(
    terms=(
        Term("that", r"\bthat[a-z]*", ("that",), "core", "plain", examples=("That", "thatness")),
        Term("of_the", r"\bof\s+the\b", ("of the",), "core", "plain", examples=("of the",)),
        Term("license", r"\blicense[a-z]*", ("license",), "core", "legal", examples=("Licensed",)),
        Term("mit_license", r"\bmit\s+license\b", ("mit license",), "core", "legal", nested_under="license", examples=("MIT License",)),
        Term("hea", r"\bhea[a-z]*", ("hea",), "wide", "sound", examples=("heart",)),
        Term("and_word", r"\band\b", ("and",), "wide", "sound", examples=("and",)),
        Term("in_the", r"\bin\s+the\b", ("in the",), "wide", "sound", examples=("in the",)),
        Term("hea_split", r"\bh\s?ea[a-z]*", ("hea", "h ea"), "wide", "sound", enabled=False, examples=("h ear",)),
    ),
    sets={"legal": ("license", "mit_license"), "mixed": ("that", "in_the", "hea_split")},
    version="1",
)

GROUP_OF = {"en": "P5", "fr": "E10", "es": "Non-member state", "de": "UN"}

SPEECHES_SQL = r"""
speeches AS (
  SELECT doc_id AS row_id, 'M' || (doc_id // 10) AS meeting_symbol, (doc_id % 10 + 1)::INT AS speech_number,
         (DATE '1992-01-01' + (doc_id * 37 % 11688)::INT) AS date, source AS country_org, lang,
         CASE lang WHEN 'en' THEN 'P5' WHEN 'fr' THEN 'E10' WHEN 'es' THEN 'Non-member state' WHEN 'de' THEN 'UN' ELSE 'Non-state' END AS speaker_group,
         CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 'A' || (doc_id % 7) END AS agenda,
         len(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'))::BIGINT AS tokens, text
  FROM documents),
dated AS (SELECT *, year(date)::INT AS year, month(date)::INT AS month, strftime(date, '%Y-%m') AS ym, year(date) || 'Q' || quarter(date) AS yq FROM speeches)
"""


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated, attributed speeches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    date = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("doc_id") * 37 % 11688).cast("int"))
    group = F.lit("Non-state")
    for lang, name in GROUP_OF.items():
        group = F.when(F.col("lang") == lang, name).otherwise(group)
    rows = docs.select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("M"), F.expr("doc_id div 10").cast("string")).alias("meeting_symbol"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("speech_number"), date.alias("date"), F.col("source").alias("country_org"), "lang",
        group.alias("speaker_group"), F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("A"), (F.col("doc_id") % 7).cast("string"))).alias("agenda"),
        F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"), "text",
    )
    return rows.withColumns({"year": F.year("date"), "month": F.month("date"), "ym": text.period(F.col("date"), "month"), "yq": text.period(F.col("date"), "quarter")})


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(speeches(spark, sf_dir), LEXICON)


def _count_sql(t: Term, prefilter: bool = True) -> str:
    n = f"len(regexp_extract_all(text, '(?i){t.pattern}'))"
    gate = " OR ".join(f"contains(lower(text), '{x}')" for x in t.literals)
    return f"CASE WHEN {gate} THEN {n} ELSE 0 END" if prefilter else n


def flagged_sql() -> str:
    lex = LEXICON
    counts = ", ".join(f"({_count_sql(t)})::BIGINT AS n_{t.name}" for t in lex.terms)
    cols = [f"n_{t.name} > 0 AS has_{t.name}" for t in lex.active]
    for r, own in lex.by("register").items():
        s = " + ".join(f"n_{t.name}" for t in own)
        cols += [f"({s})::INT AS n_register_{r}", f"({s}) > 0 AS has_register_{r}"]
    active = {t.name for t in lex.active}
    for name, own in lex.sets.items():
        cols.append("(" + " + ".join(f"n_{m}" for m in own if m in active) + f") > 0 AS has_set_{name}")
    cols.append("(" + " + ".join(f"n_{t.name}" for t in lex.active) + ")::INT AS n_lexicon_total")
    cols.append("(" + " + ".join(f"(n_{t.name} > 0)::INT" for t in lex.active) + ")::INT AS n_lexicon_terms")
    return f"{SPEECHES_SQL}, counted AS (SELECT *, {counts} FROM dated), flagged AS (SELECT *, {', '.join(cols)} FROM counted)"


FLAGGED_SQL = flagged_sql()


def long_sql(by: str, source: str = "flagged", grid: str | None = None) -> str:
    """The long form of all measures by a label, as SQL over `flagged`."""
    rows = LEXICON.measures()
    parts = []
    for kind, name, has, n in rows:
        occ = f"sum({n})::BIGINT" if n else "NULL::BIGINT"
        parts.append(f"SELECT {by} AS period, '{kind}' AS kind, '{name}' AS name, count(*)::BIGINT AS held, sum(tokens)::BIGINT AS tokens, count(*) FILTER ({has})::BIGINT AS speeches, {occ} AS occurrences FROM {source} GROUP BY {by}")
    union = " UNION ALL ".join(parts)
    if grid:
        names = ", ".join(f"('{k}', '{v}', {'true' if n else 'false'})" for k, v, _, n in rows)
        union = f"""SELECT g.period, m.kind, m.name, coalesce(u.held, 0)::BIGINT AS held, coalesce(u.tokens, 0)::BIGINT AS tokens, coalesce(u.speeches, 0)::BIGINT AS speeches,
          CASE WHEN m.counted THEN coalesce(u.occurrences, 0) END::BIGINT AS occurrences
          FROM {grid} g CROSS JOIN (VALUES {names}) m(kind, name, counted) LEFT JOIN ({union}) u ON u.period = g.period AND u.kind = m.kind AND u.name = m.name"""
    return f"SELECT *, CASE WHEN held > 0 THEN round(speeches / held, 6) END AS speech_rate, CASE WHEN tokens > 0 THEN round(occurrences * 100000.0 / tokens, 4) END AS token_rate FROM ({union})"


def entities(spark: SparkSession) -> DataFrame:
    """A crosswalk of the 20 sources: two share a code, one has no place, one is no state."""
    rows = []
    for k in range(20):
        name, state = f"src{k}", k not in (18, 19)
        iso = f"S{min(k, 16):02d}" if state else None
        placed = state and k != 15
        rows.append((name, "state" if state else "un" if k == 18 else "other", iso, f"G{k % 5}" if state else None, 10.0 + k if placed else None, 20.0 - k if placed else None))
    return spark.createDataFrame(rows, "country_org string, entity_type string, iso3 string, un_regional_group string, lat double, lon double")


ENTITIES_SQL = """
entities AS (SELECT 'src' || k AS country_org, CASE WHEN k = 18 THEN 'un' WHEN k = 19 THEN 'other' ELSE 'state' END AS entity_type,
  CASE WHEN k < 18 THEN 'S' || lpad(least(k, 16)::VARCHAR, 2, '0') END AS iso3, CASE WHEN k < 18 THEN 'G' || (k % 5) END AS un_regional_group,
  CASE WHEN k < 18 AND k <> 15 THEN 10.0 + k END::DOUBLE AS lat, CASE WHEN k < 18 AND k <> 15 THEN 20.0 - k END::DOUBLE AS lon FROM range(20) t(k))
"""


def terms_of_office(spark: SparkSession) -> DataFrame:
    """Seats: src0 to src4 permanent from 1992 to 2023, the others elected for two years in turn."""
    rows = [(f"src{k}", 1992, 2023, "permanent") for k in range(5)]
    rows += [(f"src{5 + k}", y, y + 1, "elected") for k in range(13) for y in range(1992 + k % 3, 2023, 4)]
    return spark.createDataFrame(rows, "country_org string, start_year int, end_year int, seat string")


MEMBERSHIP_SQL = """
terms AS (SELECT 'src' || k AS country_org, 1992 AS start_year, 2023 AS end_year, 'permanent' AS seat FROM range(5) t(k)
  UNION ALL SELECT 'src' || (5 + k), y::INT, y::INT + 1, 'elected' FROM range(13) t(k), LATERAL (SELECT unnest(range(1992 + k % 3, 2023, 4)) AS y)),
membership AS (SELECT DISTINCT country_org, unnest(range(start_year, end_year + 1))::INT AS year, seat FROM terms)
"""


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src1", "src0"), ("src17", "src16")], "alias string, canonical string")
