"""Queries over text, lexicon, dimensions, series and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import stats, text
from lexiquarry.operators import actors, dims, kwic, lexicon, normalise, quality, series
from lexiquarry.plans.adapter import ENTITIES_SQL, FLAGGED_SQL, LEXICON, MEMBERSHIP_SQL, SLICES, SPEECHES_SQL, STOP, aliases, entities, flagged, long_sql, speeches, terms_of_office
from lexiquarry.plans.registry import query

MEASURES = LEXICON.measures()
SLICE_CASE = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in SLICES) + " ELSE 'outside' END"
WITH = f"WITH {SPEECHES_SQL}"
WITH_FLAGS = f"WITH {FLAGGED_SQL}"


# --- scans and text -------------------------------------------------------


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("adapter_speeches", f"{WITH} SELECT row_id, meeting_symbol, speech_number, date, year, month, yq, ym, country_org, speaker_group, agenda, tokens FROM dated")
def adapter_speeches(spark, d):
    return speeches(spark, d).select("row_id", "meeting_symbol", "speech_number", "date", "year", "month", "yq", "ym", "country_org", "speaker_group", "agenda", "tokens")


@query("project_body", "SELECT doc_id, substr(text, (doc_id % 7)::INT + 1) AS body FROM documents")
def project_body(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", text.body(F.col("text"), (F.col("doc_id") % 7).cast("int")).alias("body"))


@query("newline_norm", "SELECT conv_id, turn, length(replace(replace(replace(text, chr(10), chr(13) || chr(10)) || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10)))::INT AS n_chars FROM conversations")
def newline_norm(spark, d):
    raw = spark.read.parquet(f"{d}/conversations.parquet")
    crlf = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    return raw.select("conv_id", "turn", F.length(text.newlines(crlf)).alias("n_chars"))


@query("text_length", "SELECT page_id, length(coalesce(html, ''))::INT AS n FROM pages")
def text_length(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.text_length(F.col("html")).alias("n"))


@query("tokenise_counts", f"{WITH} SELECT row_id, tokens FROM speeches")
def tokenise_counts(spark, d):
    return speeches(spark, d).select("row_id", "tokens")


@query("content_tokens", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''’-]*')) AS word FROM documents) SELECT d.doc_id, count(w.word)::INT AS n FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id AND w.word NOT IN ({', '.join(repr(s) for s in STOP)}) GROUP BY d.doc_id")
def content_tokens(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.size(text.without(text.tokens(F.col("text")), STOP)).alias("n"))


@query("modal_case", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(source) ELSE source END AS label FROM documents), c AS (SELECT lower(label) AS k, label AS v, count(*) AS n FROM s WHERE label IS NOT NULL GROUP BY ALL), b AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r FROM c) WHERE r = 1) SELECT s.doc_id, b.v AS label FROM s LEFT JOIN b ON lower(s.label) = b.k")
def modal_case(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.upper("source")).otherwise(F.col("source")).alias("label"))
    return dims.modal_case(docs, "label")


@query("period_labels", f"{WITH} SELECT row_id, year::VARCHAR AS y, yq AS q, ym AS m, month AS month_of_year, (year // 10 * 10) || 's' AS decade, {SLICE_CASE} AS slice FROM dated")
def period_labels(spark, d):
    date, year = F.col("date"), F.col("year")
    return speeches(spark, d).select("row_id", text.period(date, "year").alias("y"), text.period(date, "quarter").alias("q"), text.period(date, "month").alias("m"), F.col("month").alias("month_of_year"), text.decade(year).alias("decade"), text.slice_label(year, SLICES).alias("slice"))


@query("delivery_language", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'French' END AS spoken, CASE doc_id % 5 WHEN 0 THEN 'In-Person' WHEN 1 THEN 'VTC' WHEN 2 THEN 'Written' END AS mode FROM documents) SELECT doc_id, CASE WHEN spoken IS NOT NULL THEN spoken WHEN mode = 'In-Person' THEN 'English (inferred, in-person)' WHEN mode = 'VTC' THEN 'Unknown (VTC)' ELSE 'Unknown' END AS language FROM s")
def delivery_language(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    spoken = F.when(i % 3 == 0, "French")
    mode = F.when(i % 5 == 0, "In-Person").when(i % 5 == 1, "VTC").when(i % 5 == 2, "Written")
    return docs.select("doc_id", text.delivery_language(spoken, mode).alias("language"))


# Openings put before the texts: three forms of address, and none.
OPENINGS = ("Mr. Levitte (France) (spoke in French): ", "The President: ", "Mrs. Ivanova (spoke in Russlan):\n", "")
_said_sql = "said AS (SELECT *, CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {repr(o) if chr(10) not in o else repr(o[:-1]) + ' || chr(10)'}" for i, o in enumerate(OPENINGS)) + " END || coalesce(text, '') AS whole FROM documents)"
_address_sql = f"addressed AS (SELECT *, regexp_extract(substr(whole, 1, {text.ADDRESS_WITHIN}), '{text.ADDRESS}') AS address FROM said)"
_body_sql = "CASE WHEN address <> '' THEN length(address) + length(regexp_extract(substr(whole, length(address) + 1), '^[ \\t\\n]*')) ELSE 0 END::INT"
_marker_sql = r"regexp_extract(address, '(?i)\(\s*(?:spoke|spoken|interpretation|interpreted)([^)]{0,90})\)', 1)"


def _said():
    which = F.col("doc_id") % len(OPENINGS)
    opening = F.lit("")
    for i, words in enumerate(OPENINGS):
        opening = F.when(which == i, words).otherwise(opening)
    return F.concat(opening, F.coalesce("text", F.lit("")))


@query("form_of_address", f"WITH {_said_sql}, {_address_sql} SELECT doc_id, address, {_body_sql} AS body_start, nullif({_marker_sql}, '') AS marker, CASE WHEN {_marker_sql} = ' in French' THEN 'French' END AS language FROM addressed")
def form_of_address(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("whole", _said())
    marker = text.language_marker(F.col("address"))
    opened = docs.withColumn("address", text.address(F.col("whole")))
    return opened.select("doc_id", "address", text.body_start(F.col("whole")).alias("body_start"), marker.alias("marker"), text.exact_language(marker).alias("language"))


_spoken_sql = f"CASE {_marker_sql} WHEN ' in French' THEN 'French' WHEN ' in Russlan' THEN 'Russian' END"


@query(
    "normalised",
    f"""WITH {_said_sql}, {_address_sql}, {ENTITIES_SQL},
    spoken AS (SELECT doc_id, {_body_sql} AS body_start, {_spoken_sql} AS spoken_language, coalesce({_marker_sql} = ' in Russlan', false) AS spoken_fuzzy,
      CASE source WHEN 'src1' THEN 'src0' WHEN 'src17' THEN 'src16' ELSE source END AS country_org FROM addressed)
    SELECT doc_id, body_start, spoken_language, spoken_fuzzy, coalesce(spoken_language, CASE WHEN doc_id % 5 = 0 THEN 'English (inferred, in-person)' WHEN doc_id % 5 = 1 THEN 'Unknown (VTC)' ELSE 'Unknown' END) AS delivery_language,
      'A' || (doc_id % 7) AS agenda, country_org, entity_type,
      CASE WHEN entity_type = 'state' THEN CASE WHEN substr(country_org, 4)::INT < 5 THEN 'P5' WHEN substr(country_org, 4)::INT < 15 THEN 'E10' ELSE 'Non-member state' END WHEN entity_type = 'un' THEN 'UN' ELSE 'Non-state' END AS speaker_group
    FROM spoken LEFT JOIN entities USING (country_org)""",
)
def normalised(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    agenda = F.concat(F.lit("A"), (i % 7).cast("string"))
    raw = docs.select(
        "doc_id", _said().alias("text"), F.col("source").alias("country_org"), (1992 + i % 32).cast("int").alias("year"),
        F.when(i % 5 == 0, "In-Person").when(i % 5 == 1, "VTC").alias("participation"), F.when(i % 9 == 0, F.lower(agenda)).otherwise(agenda).alias("agenda"),
    )
    state = F.col("entity_type") == "state"
    placed = entities(spark).withColumns({c: F.when(state, F.coalesce(c, F.lit(0.0))) for c in ("lat", "lon")})
    seats = spark.createDataFrame([(f"src{k}", 1992, 2023, "permanent" if k < 5 else "elected") for k in range(15)], "country_org string, start_year int, end_year int, seat string")
    out = normalise.normalise(raw, aliases(spark), placed, seats, ("state", "un", "other"), cased=("agenda",), silent=True)
    return out.select("doc_id", "body_start", "spoken_language", "spoken_fuzzy", "delivery_language", "agenda", "country_org", "entity_type", "speaker_group")


@query("join_keys", "SELECT doc_id, 'S_PV_' || (doc_id // 10) AS document FROM documents")
def join_keys(spark, d):
    name = F.format_string("S_PV_%d_spch%04d.txt", F.expr("doc_id div 10"), F.col("doc_id") % 10 + 1)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.join_key(name).alias("document"))


@query("slugs", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slugs(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("labels_formatted", r"""SELECT page_id, replace(url, '_', ' ') AS label, CASE WHEN page_id * 7919 >= 1e9 THEN format('{:.1f} GB', page_id * 7919 / 1e9) WHEN page_id * 7919 >= 1e6 THEN format('{:.1f} MB', page_id * 7919 / 1e6) WHEN page_id * 7919 >= 1e3 THEN format('{:.0f} kB', page_id * 7919 / 1e3) ELSE page_id * 7919 || ' B' END AS size,
  strftime(DATE '1992-01-01' + (page_id % 900)::INT, '%B %Y') AS month, strftime(DATE '1992-01-01' + (page_id % 900)::INT, '%-d %B %Y') AS day, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), '"', '&quot;') AS escaped,
  trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') || '-' || page_id || '.csv' AS file, CASE page_id % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'year and agenda' ELSE 'year, agenda and group' END AS matched FROM pages""")
def labels_formatted(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    date = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("page_id") % 900).cast("int"))
    names = F.slice(F.array(F.lit("year"), F.lit("agenda"), F.lit("group")), 1, (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(
        "page_id", text.label(F.col("url")).alias("label"), text.byte_label(F.col("page_id") * 7919).alias("size"), text.month_label(F.date_format(date, "yyyy-MM")).alias("month"),
        text.day_label(date.cast("string")).alias("day"), text.escaped(F.col("url")).alias("escaped"), text.file_name([F.col("url"), F.lit(" "), F.col("page_id"), F.lit(None)], ".csv").alias("file"), text.listed(names).alias("matched"),
    )


@query("names_folded", "SELECT c_custkey, trim(regexp_replace(lower(replace(replace(c_name || ' Émile Żak, ' || c_mktsegment, 'É', 'E'), 'Ż', 'Z')), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer")
def names_folded(spark, d):
    name = F.concat("c_name", F.lit(" Émile Żak, "), "c_mktsegment")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.name_fold(name).alias("name"))


@query("orphans", "WITH l AS (SELECT doc_id FROM documents WHERE doc_id % 3 > 0), r AS (SELECT doc_id FROM labels) SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM l EXCEPT SELECT doc_id FROM r) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM r EXCEPT SELECT doc_id FROM l)")
def orphans(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return quality.orphans(docs.filter("doc_id % 3 > 0"), labels, "doc_id")


@query("build_problems", "WITH r AS (SELECT doc_id % 900 AS id, CASE WHEN doc_id % 11 > 0 THEN source END AS source, lang FROM documents), n AS (SELECT 'rows' AS \"check\", count(*) - 500 AS count FROM r UNION ALL SELECT 'repeated id', count(id) - count(DISTINCT id) FROM r UNION ALL SELECT 'missing source', count(*) FILTER (source IS NULL) FROM r UNION ALL SELECT 'missing lang', count(*) FILTER (lang IS NULL) FROM r) SELECT * FROM n WHERE count <> 0")
def build_problems(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 900).alias("id"), F.when(F.col("doc_id") % 11 > 0, F.col("source")).alias("source"), "lang")
    return quality.build_problems(rows, 500, "id", ["source", "lang"])


@query("line_id_parts", "SELECT doc_id, 'M' || (doc_id // 10) AS meeting, (doc_id % 10 + 1)::INT AS speech, (doc_id % 3 + 1)::INT AS ordinal FROM documents")
def line_id_parts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    line = F.format_string("M%d_spch%04d#%d", F.expr("doc_id div 10"), F.col("doc_id") % 10 + 1, F.col("doc_id") % 3 + 1)
    return docs.select("doc_id", text.id_parts(line).alias("p")).select("doc_id", "p.*")


@query("tolerant_cast", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(user_id || CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END AS INT) AS user_number FROM events")
def tolerant_cast(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    noisy = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 9 == 0, "x").otherwise(""))
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), noisy.try_cast("int").alias("user_number"))


@query("rule_classifier", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'special' WHEN regexp_matches(source, '1[0-9]$') THEN 'teens' WHEN regexp_matches(source, '[02468]$') THEN 'even' ELSE 'other' END AS kind, NOT (source = 'src3' OR regexp_matches(source, '1[0-9]$') OR regexp_matches(source, '[02468]$')) AS needs_review FROM documents")
def rule_classifier(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kind = text.classify(F.col("source"), {"src3": "special"}, [("1[0-9]$", "teens"), ("[02468]$", "even")], "other")
    return docs.select("doc_id", kind.alias("k")).select("doc_id", "k.*")


# --- lexicon --------------------------------------------------------------

_counts = [f"n_{t.name}" for t in LEXICON.active]


@query("lexicon_counts", f"{WITH_FLAGS} SELECT row_id, {', '.join(_counts)} FROM flagged")
def lexicon_counts(spark, d):
    return flagged(spark, d).select("row_id", *_counts)


@query("lexicon_prefilter_effect", f"{WITH} , b AS (SELECT row_id, CASE WHEN row_id % 4 = 0 THEN replace(text, 'of the', 'of' || chr(10) || 'the') ELSE text END AS t FROM speeches) SELECT row_id, (CASE WHEN contains(lower(t), 'of the') THEN len(regexp_extract_all(t, '(?i)\\bof\\s+the\\b')) ELSE 0 END)::BIGINT AS gated, len(regexp_extract_all(t, '(?i)\\bof\\s+the\\b'))::BIGINT AS ungated FROM b")
def lexicon_prefilter_effect(spark, d):
    term = next(t for t in LEXICON.terms if t.name == "of_the")
    s = speeches(spark, d).withColumn("t", F.when(F.col("row_id") % 4 == 0, F.replace("text", F.lit("of the"), F.lit("of\nthe"))).otherwise(F.col("text")))
    return s.select("row_id", term.count(F.col("t")).alias("gated"), term.count(F.col("t"), prefilter=False).alias("ungated"))


DOCUMENTED = {"that": (1, 1), "hea": (0, 0), "unheard_of": (3, 3)}


@query("documented_figures", f"{WITH_FLAGS}, e(term, es, eo) AS (VALUES ('that', 1, 1), ('hea', 0, 0)), n AS (SELECT 'that' AS term, count(*) FILTER (has_that) AS s, sum(n_that) AS o FROM flagged UNION ALL SELECT 'hea', count(*) FILTER (has_hea), sum(n_hea) FROM flagged) SELECT term, s::BIGINT AS speeches, o::BIGINT AS occurrences, es::BIGINT AS expected_speeches, eo::BIGINT AS expected_occurrences, s = es AND o = eo AS agrees FROM n JOIN e USING (term)")
def documented_figures(spark, d):
    return lexicon.documented_figures(flagged(spark, d), LEXICON, DOCUMENTED)


@query("register_rollup", f"{WITH_FLAGS} SELECT row_id, {', '.join(f'n_register_{r}, has_register_{r}' for r in LEXICON.by('register'))} FROM flagged")
def register_rollup(spark, d):
    return flagged(spark, d).select("row_id", *[c for r in LEXICON.by("register") for c in (f"n_register_{r}", f"has_register_{r}")])


@query("set_flags", f"{WITH_FLAGS} SELECT row_id, {', '.join(f'has_set_{s}' for s in LEXICON.sets)} FROM flagged")
def set_flags(spark, d):
    return flagged(spark, d).select("row_id", *[f"has_set_{s}" for s in LEXICON.sets])


@query("lexicon_totals", f"{WITH_FLAGS} SELECT row_id, n_lexicon_total, n_lexicon_terms FROM flagged")
def lexicon_totals(spark, d):
    return flagged(spark, d).select("row_id", "n_lexicon_total", "n_lexicon_terms")


_wide = " OR ".join(f"has_{t.name}" for t in LEXICON.active if t.tier == "wide")


@query("ocr_delta", f"{WITH_FLAGS} SELECT 'hea_split' AS term, 'wide' AS tier, count(*)::BIGINT AS speeches, count(*) FILTER (NOT ({_wide}))::BIGINT AS extra, coalesce(array_to_string((SELECT list(row_id ORDER BY row_id) FROM (SELECT row_id FROM flagged WHERE n_hea_split > 0 AND NOT ({_wide}) ORDER BY row_id LIMIT 5)), '|'), '') AS examples FROM flagged WHERE n_hea_split > 0")
def ocr_delta(spark, d):
    return lexicon.tolerant_delta(flagged(spark, d), LEXICON).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), "|"))


@query("ocr_finds", f"{WITH_FLAGS} SELECT row_id, 'hea_split' AS term, 'wide' AS tier, n_hea_split AS n, NOT ({_wide}) AS extra FROM flagged WHERE n_hea_split > 0")
def ocr_finds(spark, d):
    return lexicon.tolerant_finds(flagged(spark, d), LEXICON)


_summary = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{v}' AS name, count(*) FILTER ({h})::BIGINT AS speeches, round(count(*) FILTER ({h}) / count(*), 6) AS share, {f'sum({n})::BIGINT' if n else 'NULL::BIGINT'} AS occurrences FROM flagged" for k, v, h, n in MEASURES)


@query("lexicon_summary", f"{WITH_FLAGS} {_summary}")
def lexicon_summary(spark, d):
    return lexicon.summary(flagged(spark, d), LEXICON)


def _spans_sql() -> str:
    """Offsets of all matches: lengths of the pieces between them and of the matches before."""
    parts = []
    for t in LEXICON.active:
        gate = " OR ".join(f"contains(lower(text), '{x}')" for x in t.literals)
        parts.append(f"SELECT row_id, '{t.name}' AS term, '{t.tier}' AS tier, '{t.register}' AS register, regexp_split_to_array(text, '(?i){t.pattern}') AS pieces, regexp_extract_all(text, '(?i){t.pattern}') AS hits FROM dated WHERE {gate}")
    return f"""found AS ({' UNION ALL '.join(parts)}),
    hit AS (SELECT row_id, term, tier, register, unnest(range(1, len(hits) + 1)) AS i, pieces, hits FROM found),
    occ AS (SELECT row_id, term, tier, register, i::INT AS ordinal, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS s, length(hits[i])::INT AS n FROM hit)"""


OCC_SQL = _spans_sql()


@query("occurrences_exploded", f'{WITH}, {OCC_SQL} SELECT row_id, term, tier, register, ordinal, s AS "start", s + n AS "end" FROM occ')
def occurrences_exploded(spark, d):
    return lexicon.occurrences(speeches(spark, d), LEXICON, ["row_id"])


@query("audit_sample", f"""{WITH}, {OCC_SQL}, o AS (SELECT row_id, term, s, (d.year // 10 * 10) || 's' AS decade, md5('7:audit:' || row_id || ':' || term || ':' || s) AS h FROM occ JOIN dated d USING (row_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY term, decade ORDER BY h, row_id, s) AS r FROM o) SELECT row_id, term, decade, s AS "start" FROM k ORDER BY (r > 1)::INT, h, row_id, s LIMIT 40""")
def audit_sample(spark, d):
    s = speeches(spark, d).withColumn("decade", text.decade(F.col("year")))
    return lexicon.audit_sample(lexicon.occurrences(s, LEXICON, ["row_id", "decade"]), 40, 7).select("row_id", "term", "decade", "start")


def _drawn_sql(unit: str, seed: int, of: str) -> str:
    """The audit's draw of one unit, as SQL over `dec`."""
    return f"""(SELECT row_id, term, register, decade, s, n, '{unit}' AS unit FROM (SELECT *, row_number() OVER (PARTITION BY term, decade ORDER BY h, row_id, s) AS r FROM (SELECT *, md5('{seed}:audit:' || row_id || ':' || term || ':' || s) AS h FROM dec WHERE {of})) ORDER BY (r > 1)::INT, h, row_id, s LIMIT 60)"""


@query("body_occurrences", f"{WITH}, {OCC_SQL.replace('FROM dated', 'FROM cut').replace('found AS', 'cut AS (SELECT row_id, substr(text, row_id % 7 * 9 + 1) AS text FROM speeches), found AS', 1)} SELECT row_id, term, ordinal, (s + row_id % 7 * 9)::INT AS \"start\", (s + n + row_id % 7 * 9)::INT AS \"end\" FROM occ")
def body_occurrences(spark, d):
    """Matches behind an address of 0 to 54 characters, in the whole text's offsets."""
    s = speeches(spark, d).withColumn("body_start", F.col("row_id") % 7 * 9)
    return lexicon.occurrences(s, LEXICON, ["row_id"], begin="body_start").select("row_id", "term", "ordinal", "start", "end")


@query("load_problems", f"""{WITH}, {ENTITIES_SQL}, x AS (SELECT country_org FROM entities WHERE country_org <> 'src3' UNION ALL SELECT 'src4')
SELECT 'rows' AS "check", NULL::VARCHAR AS "value", 1::BIGINT AS "rows" UNION ALL SELECT 'missing country_org', NULL, count(*) FROM speeches WHERE country_org IS NULL HAVING count(*) > 0
UNION ALL SELECT 'not in crosswalk', country_org, count(*) FROM speeches WHERE country_org IS NOT NULL AND country_org NOT IN (SELECT country_org FROM x) GROUP BY country_org
UNION ALL SELECT 'twice in crosswalk', country_org, count(*) FROM x GROUP BY country_org HAVING count(*) > 1
UNION ALL SELECT CASE WHEN year = 2008 THEN 'in several periods' ELSE 'in no period' END, year::VARCHAR, count(*) FROM dated WHERE year IN (2008, 2000) GROUP BY year
UNION ALL SELECT 'keys not 0 to n - 1', NULL, count(row_id) FROM speeches HAVING min(row_id) <> 0 OR max(row_id) <> count(row_id) - 1 OR count(DISTINCT row_id) <> count(row_id)""")
def load_problems(spark, d):
    """A crosswalk without src3 and with src4 twice, periods that skip 2000 and share 2008, one speech too many."""
    s, e = speeches(spark, d), entities(spark).select("country_org")
    crosswalk = e.filter("country_org != 'src3'").union(e.filter("country_org = 'src4'"))
    return quality.load_problems(s, crosswalk, [(1992, 1999), (2001, 2008), (2008, 2030)], s.count() - 1)


@query("audit_units", f"""{WITH}, {OCC_SQL}, dec AS (SELECT occ.*, (d.year // 10 * 10) || 's' AS decade FROM occ JOIN dated d USING (row_id)),
  drawn AS ({_drawn_sql('occurrence', 11, 'true')} UNION ALL {_drawn_sql('speech', 13, 'ordinal = 1')})
  SELECT unit, row_id, country_org, agenda, term, register, decade, s AS "start", trim(regexp_replace(substr(text, greatest(s - 60, 0) + 1, s - greatest(s - 60, 0)), '\\s+', ' ', 'g')) AS "left", trim(regexp_replace(substr(text, s + 1, n), '\\s+', ' ', 'g')) AS keyword,
  trim(regexp_replace(substr(text, s + n + 1, 60), '\\s+', ' ', 'g')) AS "right" FROM drawn JOIN speeches USING (row_id)""")
def audit_units(spark, d):
    """The reviewers' sheet: occurrences and speeches by term and decade, in their context."""
    s = speeches(spark, d).withColumn("decade", text.decade(F.col("year")))
    drawn = lexicon.audit_units(lexicon.occurrences(s, LEXICON, ["row_id", "decade"]), 60, 11)
    sheet = kwic.review_sheet(drawn, s, width=60, keep=("country_org", "agenda"))
    return sheet.select("unit", "row_id", "country_org", "agenda", "term", "register", "decade", "start", "left", "keyword", "right")


# --- dimensions -----------------------------------------------------------


@query("alias_canonicalise", "SELECT doc_id, CASE source WHEN 'src1' THEN 'src0' WHEN 'src17' THEN 'src16' ELSE source END AS source FROM documents")
def alias_canonicalise(spark, d):
    return dims.canonicalise(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "source", aliases(spark))


@query("entity_join", f"{WITH}, {ENTITIES_SQL} SELECT row_id, s.country_org, entity_type, iso3, un_regional_group, lat, lon FROM speeches s LEFT JOIN entities e ON s.country_org = e.country_org")
def entity_join(spark, d):
    return dims.attach(speeches(spark, d).select("row_id", "country_org"), entities(spark))


_grouped = "SELECT row_id, s.country_org, s.year, CASE WHEN entity_type = 'state' AND seat = 'permanent' THEN 'P5' WHEN entity_type = 'state' AND seat = 'elected' THEN 'E10' WHEN entity_type = 'state' THEN 'Non-member state' WHEN entity_type = 'un' THEN 'UN' ELSE 'Non-state' END AS speaker_group FROM dated s LEFT JOIN entities e ON s.country_org = e.country_org LEFT JOIN membership m ON m.country_org = s.country_org AND m.year = s.year"


@query("speaker_group", f"{WITH}, {ENTITIES_SQL}, {MEMBERSHIP_SQL} {_grouped}")
def speaker_group(spark, d):
    s = dims.attach(speeches(spark, d).select("row_id", "country_org", "year"), entities(spark))
    return dims.with_group(s, dims.membership_by_year(terms_of_office(spark))).select("row_id", "country_org", "year", "speaker_group")


@query("silent_members_anti", f"{WITH}, {MEMBERSHIP_SQL} SELECT m.country_org, m.year FROM membership m WHERE NOT EXISTS (SELECT 1 FROM dated s WHERE s.country_org = m.country_org AND s.year = m.year)")
def silent_members_anti(spark, d):
    return dims.silent_members(dims.membership_by_year(terms_of_office(spark)), speeches(spark, d))


@query("unseen_speakers", f"{WITH}, {ENTITIES_SQL} SELECT DISTINCT country_org FROM speeches WHERE country_org NOT IN (SELECT country_org FROM entities WHERE country_org <> 'src7')")
def unseen_speakers(spark, d):
    return dims.unseen(speeches(spark, d), entities(spark).filter("country_org <> 'src7'"))


# --- series ---------------------------------------------------------------


def _long(spark, d, by: str, grid=None):
    f = flagged(spark, d).withColumn("period", F.col(by).cast("string"))
    return series.measures(f, MEASURES, ["period"], grid)


@query("series_annual", f"{WITH_FLAGS}, long AS ({long_sql('year::VARCHAR')}) SELECT * FROM long")
def series_annual(spark, d):
    return _long(spark, d, "year")


@query("series_quarterly", f"{WITH_FLAGS}, long AS ({long_sql('yq')}) SELECT * FROM long WHERE kind = 'terms'")
def series_quarterly(spark, d):
    return _long(spark, d, "yq").filter("kind = 'terms'")


GRID_SQL = "grid AS (SELECT y || '-' || lpad(m::VARCHAR, 2, '0') AS period FROM range(1992, 2024) a(y), range(1, 13) b(m))"


@query("series_monthly_grid", f"{WITH_FLAGS}, {GRID_SQL}, long AS ({long_sql('ym', grid='grid')}) SELECT * FROM long")
def series_monthly_grid(spark, d):
    return _long(spark, d, "ym", series.month_grid(spark, 1992, 2023))


@query("series_withheld", f"{WITH_FLAGS}, {GRID_SQL}, long AS ({long_sql('ym', grid='grid')}) SELECT period, kind, name, held, tokens, speeches, occurrences, CASE WHEN held >= 3 THEN speech_rate END AS speech_rate, CASE WHEN held >= 3 THEN token_rate END AS token_rate, held >= 3 AS sufficient FROM long")
def series_withheld(spark, d):
    return series.withhold(_long(spark, d, "ym", series.month_grid(spark, 1992, 2023)), 3)


@query("series_sets", f"{WITH_FLAGS}, long AS ({long_sql('year::VARCHAR')}) SELECT * FROM long WHERE kind = 'sets'")
def series_sets(spark, d):
    return _long(spark, d, "year").filter("kind = 'sets'")


@query("denominators", f"{WITH}, {GRID_SQL} SELECT g.period, count(row_id)::BIGINT AS speeches, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(DISTINCT meeting_symbol)::BIGINT AS meetings FROM grid g LEFT JOIN dated ON ym = g.period GROUP BY g.period")
def denominators(spark, d):
    return series.denominators(speeches(spark, d).withColumn("period", F.col("ym")), ["period"], series.month_grid(spark, 1992, 2023))


def _breakdown_sql(by: str, top: int | None) -> str:
    label = f"coalesce({by}, 'Unknown')"
    largest = f", l AS (SELECT c FROM (SELECT {label} AS c, count(*) AS n FROM flagged GROUP BY c ORDER BY n DESC, c LIMIT {top}))" if top else ""
    category = f"CASE WHEN {label} IN (SELECT c FROM l) THEN {label} ELSE 'Other' END" if top else label
    return f"{WITH_FLAGS}{largest}, b AS (SELECT year::VARCHAR AS period, {category} AS category, tokens, has_that, n_that FROM flagged) SELECT period, category, count(*)::BIGINT AS held, sum(tokens)::BIGINT AS tokens, count(*) FILTER (has_that)::BIGINT AS speeches, sum(n_that)::BIGINT AS occurrences, round(count(*) FILTER (has_that) / count(*), 6) AS speech_rate, CASE WHEN sum(tokens) > 0 THEN round(sum(n_that) * 100000.0 / sum(tokens), 4) END AS token_rate FROM b GROUP BY period, category"


@query("breakdown", _breakdown_sql("agenda", None))
def breakdown(spark, d):
    return series.breakdown(flagged(spark, d), F.col("year").cast("string"), "agenda", "has_that", "n_that")


@query("breakdown_topn", _breakdown_sql("country_org", 5))
def breakdown_topn(spark, d):
    return series.breakdown(flagged(spark, d), F.col("year").cast("string"), "country_org", "has_that", "n_that", top=5)


BROKEN_DOWN = {"agenda": 4, "country_org": 5, "speaker_group": None}
_measures = {"that": ("has_that", "n_that"), "legal": ("has_set_legal", None)}


def _breakdowns_sql() -> str:
    parts = []
    for c, top in BROKEN_DOWN.items():
        label = f"coalesce({c}, 'Unknown')"
        largest = f"(SELECT c FROM (SELECT {label} AS c, count(*) AS n FROM flagged GROUP BY c ORDER BY n DESC, c LIMIT {top}))"
        category = f"CASE WHEN {label} IN {largest} THEN {label} ELSE 'Other' END" if top else label
        for name, (has, n) in _measures.items():
            parts.append(f"SELECT '{c}' AS \"column\", '{name}' AS measure, year::VARCHAR AS period, {category} AS category, tokens, {has} AS h, {n or 'NULL::BIGINT'} AS n FROM flagged")
    return f"""{WITH_FLAGS}, b AS ({' UNION ALL '.join(parts)}) SELECT "column", measure, period, category, count(*)::BIGINT AS held, sum(tokens)::BIGINT AS tokens, count(*) FILTER (h)::BIGINT AS speeches, sum(n)::BIGINT AS occurrences,
      round(count(*) FILTER (h) / count(*), 6) AS speech_rate, CASE WHEN sum(tokens) > 0 THEN round(sum(n) * 100000.0 / sum(tokens), 4) END AS token_rate FROM b GROUP BY ALL"""


@query("breakdowns", _breakdowns_sql())
def breakdowns(spark, d):
    return series.breakdowns(flagged(spark, d), F.col("year").cast("string"), BROKEN_DOWN, _measures)


@query("breakdown_orders", "WITH b AS (SELECT year(o_orderdate)::VARCHAR AS period, c_mktsegment AS category, o_totalprice > 250000 AS h FROM orders JOIN customer ON o_custkey = c_custkey) SELECT period, category, count(*)::BIGINT AS held, count(*) FILTER (h)::BIGINT AS speeches, round(count(*) FILTER (h) / count(*), 6) AS speech_rate FROM b GROUP BY ALL")
def breakdown_orders(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    frame = o.join(c, o.o_custkey == c.c_custkey).select("o_orderdate", "c_mktsegment", F.lit(0).alias("tokens"), (F.col("o_totalprice") > 250000).alias("h"))
    return series.breakdown(frame, text.period(F.col("o_orderdate"), "year"), "c_mktsegment", "h", None).select("period", "category", "held", "speeches", "speech_rate")


def _calendar_sql(excluded: str) -> str:
    return f"{WITH_FLAGS} SELECT m::INT AS month, count(row_id)::BIGINT AS held, count(*) FILTER (has_that)::BIGINT AS speeches, count(row_id) FILTER (year NOT IN ({excluded}))::BIGINT AS held_control, count(*) FILTER (has_that AND year NOT IN ({excluded}))::BIGINT AS speeches_control, CASE WHEN count(row_id) > 0 THEN round(count(*) FILTER (has_that) / count(row_id), 6) END AS speech_rate, CASE WHEN count(row_id) FILTER (year NOT IN ({excluded})) > 0 THEN round(count(*) FILTER (has_that AND year NOT IN ({excluded})) / count(row_id) FILTER (year NOT IN ({excluded})), 6) END AS speech_rate_control FROM range(1, 13) r(m) LEFT JOIN flagged ON month = m GROUP BY m"


@query("calendar_pooled", _calendar_sql("0"))
def calendar_pooled(spark, d):
    return series.calendar(flagged(spark, d), "has_that")


@query("calendar_excluding", _calendar_sql("1994, 1995"))
def calendar_excluding(spark, d):
    return series.calendar(flagged(spark, d), "has_that", (1994, 1995))


@query("agenda_behind_month", f"{WITH_FLAGS}, c AS (SELECT month, coalesce(agenda, '(unlabelled)') AS item, count(*)::BIGINT AS speeches FROM flagged WHERE has_that GROUP BY ALL), r AS (SELECT *, round(speeches / sum(speeches) OVER (PARTITION BY month), 6) AS share, row_number() OVER (PARTITION BY month ORDER BY speeches DESC, item)::INT AS rank FROM c) SELECT month, item, speeches, share, rank FROM r WHERE rank <= 3")
def agenda_behind_month(spark, d):
    return series.leading_items(flagged(spark, d), "has_that", "month", "agenda")


@query("coverage_block", f"{WITH}, {GRID_SQL}, g AS (SELECT g.period, count(row_id) AS speeches FROM grid g LEFT JOIN dated ON ym = g.period GROUP BY g.period) SELECT count(*)::BIGINT AS months, count(*) FILTER (speeches > 0)::BIGINT AS observed, count(*) FILTER (speeches >= 3)::BIGINT AS at_minimum, round(coalesce(sum(speeches) FILTER (speeches >= 3), 0) / sum(speeches), 6) AS speech_share FROM g")
def coverage_block(spark, d):
    return series.coverage(series.denominators(speeches(spark, d).withColumn("period", F.col("ym")), ["period"], series.month_grid(spark, 1992, 2023)), 3)


@query("peak_period", f"{WITH_FLAGS}, long AS ({long_sql('year::VARCHAR')}), a AS (SELECT kind, name, period AS by_count FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY speeches DESC, period) AS r FROM long) WHERE r = 1), b AS (SELECT kind, name, period AS by_rate FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY speech_rate DESC, period) AS r FROM long) WHERE r = 1) SELECT kind, name, by_count, by_rate FROM a JOIN b USING (kind, name)")
def peak_period(spark, d):
    return series.peaks(_long(spark, d, "year"))


@query("top_rates", f"{WITH_FLAGS}, t AS (SELECT country_org AS category, count(*)::BIGINT AS held, count(*) FILTER (has_hea)::BIGINT AS speeches, round(count(*) FILTER (has_hea) / count(*), 6) AS speech_rate FROM flagged GROUP BY country_org) SELECT * FROM t WHERE held >= 20 ORDER BY speech_rate DESC, category LIMIT 8")
def top_rates(spark, d):
    return series.top_rates(flagged(spark, d), "country_org", "has_hea", 20)


@query("zero_ceiling", f"{WITH_FLAGS}, y AS (SELECT year, count(*) AS held, count(*) FILTER (has_hea) / count(*) AS p FROM flagged GROUP BY year) SELECT year, round(1 - pow(0.05, 1.0 / held), 6) AS ceiling, CASE WHEN p > 0 AND p < 1 THEN greatest(1, ceil(ln(0.05) / ln(1 - p))) END::INT AS minimum FROM y")
def zero_ceiling(spark, d):
    y = flagged(spark, d).groupBy("year").agg(F.count("*").alias("held"), (F.count_if("has_hea") / F.count("*")).alias("p"))
    return y.select("year", F.round(stats.zero_ceiling(F.col("held")), 6).alias("ceiling"), F.when((F.col("p") > 0) & (F.col("p") < 1), stats.informative_minimum(F.col("p"))).alias("minimum"))


@query("reconcile_totals", f"{WITH_FLAGS}, y AS (SELECT count(*) + 3 AS s FROM flagged) SELECT 'speeches' AS \"column\", s - 3 AS parts, s AS whole FROM y")
def reconcile_totals(spark, d):
    f = flagged(spark, d)
    parts = f.groupBy("year").agg(F.count("*").alias("speeches"), F.sum("tokens").alias("tokens")).withColumn("k", F.lit(1))
    whole = f.agg((F.count("*") + 3).alias("speeches"), F.sum("tokens").alias("tokens")).withColumn("k", F.lit(1))
    return series.reconcile(parts, whole, ["k"], ["speeches", "tokens"]).drop("k")


@query("long_serialised", f"{WITH_FLAGS}, long AS ({long_sql('year::VARCHAR')}) SELECT kind, name, count(*)::BIGINT AS rows, count(occurrences)::BIGINT AS counted, count(token_rate)::BIGINT AS rated FROM long GROUP BY kind, name")
def long_serialised(spark, d):
    return _long(spark, d, "year").groupBy("kind", "name").agg(F.count("*").alias("rows"), F.count("occurrences").alias("counted"), F.count("token_rate").alias("rated"))


# --- speakers -------------------------------------------------------------

_speaker_cells = f"s AS (SELECT country_org, {SLICE_CASE} AS period, tokens, has_that, n_that FROM flagged)"
_speaker_rows = f"{_speaker_cells}, u AS (SELECT country_org, period, tokens, has_that, n_that FROM s WHERE period <> 'outside' UNION ALL SELECT country_org, 'whole', tokens, has_that, n_that FROM s), by_speaker AS (SELECT country_org, period, count(*)::BIGINT AS held, sum(tokens)::BIGINT AS tokens, count(*) FILTER (has_that)::BIGINT AS speeches, sum(n_that)::BIGINT AS occurrences, CASE WHEN count(*) >= 12 THEN round(count(*) FILTER (has_that) / count(*), 6) END AS speech_rate, CASE WHEN count(*) >= 12 AND sum(tokens) > 0 THEN round(sum(n_that) * 100000.0 / sum(tokens), 4) END AS token_rate, count(*) >= 12 AS sufficient FROM u GROUP BY country_org, period)"


def _by_speaker(spark, d):
    return actors.by_speaker(flagged(spark, d), "has_that", "n_that", SLICES, 12)


@query("by_country_periods", f"{WITH_FLAGS}, {_speaker_rows} SELECT * FROM by_speaker")
def by_country_periods(spark, d):
    return _by_speaker(spark, d)


@query("period_totals", f"{WITH_FLAGS}, {_speaker_rows} SELECT period, sum(held)::BIGINT AS speeches, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS speakers, count(*) FILTER (sufficient)::BIGINT AS speakers_at_minimum, coalesce(sum(held) FILTER (sufficient), 0)::BIGINT AS speeches_at_minimum FROM by_speaker GROUP BY period")
def period_totals(spark, d):
    return actors.period_totals(_by_speaker(spark, d))


@query("actor_ranking", f"{WITH_FLAGS}, {_speaker_rows} SELECT country_org, token_rate, row_number() OVER (ORDER BY token_rate DESC, country_org)::INT AS rank, 'token_rate' AS ordering FROM by_speaker WHERE period = 'whole' AND sufficient")
def actor_ranking(spark, d):
    return actors.ranking(_by_speaker(spark, d).filter("period = 'whole'"), "token_rate").select("country_org", "token_rate", "rank", "ordering")


_standing = f"SELECT country_org, count(*) FILTER (speaker_group = 'P5')::BIGINT AS \"P5\", count(*) FILTER (speaker_group = 'E10')::BIGINT AS \"E10\", count(*) FILTER (speaker_group = 'Non-member state')::BIGINT AS \"Non-member state\", count(*) FILTER (speaker_group = 'UN')::BIGINT AS \"UN\", count(*) FILTER (speaker_group = 'Non-state')::BIGINT AS \"Non-state\", count(*)::BIGINT AS held, count(*) FILTER (speaker_group IN ('P5', 'E10'))::BIGINT AS seated, round(count(*) FILTER (speaker_group IN ('P5', 'E10')) / count(*), 6) AS seated_share, CASE WHEN count(*) FILTER (speaker_group IN ('P5', 'E10')) = 0 THEN 'never' WHEN count(*) FILTER (speaker_group IN ('P5', 'E10')) = count(*) THEN 'always' ELSE 'changed' END AS category FROM grouped GROUP BY country_org"


def _grouped_speeches(spark, d):
    s = dims.attach(speeches(spark, d).select("row_id", "country_org", "year"), entities(spark))
    return dims.with_group(s, dims.membership_by_year(terms_of_office(spark)))


@query("standing_pivot", f"{WITH}, {ENTITIES_SQL}, {MEMBERSHIP_SQL}, grouped AS ({_grouped}) {_standing}")
def standing_pivot(spark, d):
    return actors.standing(_grouped_speeches(spark, d))


@query("standing_category", f"{WITH}, {ENTITIES_SQL}, {MEMBERSHIP_SQL}, grouped AS ({_grouped}) SELECT category, count(*)::BIGINT AS speakers FROM ({_standing}) GROUP BY category")
def standing_category(spark, d):
    return actors.standing(_grouped_speeches(spark, d)).groupBy("category").agg(F.count("*").alias("speakers"))


_described = "described AS (SELECT s.country_org, count(*)::BIGINT AS speeches, min(year) AS first_year, max(year) AS last_year, any_value(entity_type) AS entity_type, any_value(iso3) AS iso3, any_value(un_regional_group) AS un_regional_group, any_value(lat) AS lat, any_value(lon) AS lon, coalesce(any_value(entity_type) = 'state' AND any_value(iso3) IS NOT NULL AND any_value(lat) IS NOT NULL AND any_value(lon) IS NOT NULL, false) AS mappable FROM dated s LEFT JOIN entities e ON s.country_org = e.country_org GROUP BY s.country_org)"


@query("describe_speakers", f"{WITH}, {ENTITIES_SQL}, {_described} SELECT * FROM described")
def describe_speakers(spark, d):
    return actors.describe(speeches(spark, d), entities(spark))


@query("iso3_collisions", f"{WITH}, {ENTITIES_SQL}, {_described} SELECT iso3, array_to_string(list_sort(list(country_org)), '|') AS speakers FROM described WHERE iso3 IS NOT NULL GROUP BY iso3 HAVING count(*) > 1")
def iso3_collisions(spark, d):
    return actors.collisions(actors.describe(speeches(spark, d), entities(spark))).withColumn("speakers", F.array_join("speakers", "|"))


@query("eligible_speakers", f"{WITH} SELECT country_org, count(*)::BIGINT AS speeches FROM speeches GROUP BY country_org HAVING count(*) >= 30")
def eligible_speakers(spark, d):
    return actors.eligible(speeches(spark, d), 30)


@query("agenda_composition", f"{WITH}, c AS (SELECT country_org, coalesce(agenda, '(unlabelled)') AS item, count(*) AS n FROM speeches GROUP BY ALL), r AS (SELECT *, sum(n) OVER p AS held, count(*) OVER p AS items, row_number() OVER (PARTITION BY country_org ORDER BY n DESC, item) AS r FROM c WINDOW p AS (PARTITION BY country_org)), t AS (SELECT *, sum(n) FILTER (r <= 3) OVER (PARTITION BY country_org) AS top3 FROM r) SELECT country_org, held::BIGINT AS held, items::BIGINT AS items, CASE WHEN r <= 4 THEN item ELSE 'other' END AS item, least(r, 5)::INT AS rank, sum(n)::BIGINT AS speeches, round(sum(n) / held, 6) AS share, round(top3 / held, 6) AS top3_share FROM t GROUP BY country_org, held, items, top3, CASE WHEN r <= 4 THEN item ELSE 'other' END, least(r, 5)")
def agenda_composition(spark, d):
    return actors.composition(speeches(spark, d), "agenda", k=4)
