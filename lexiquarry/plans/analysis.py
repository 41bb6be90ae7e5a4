"""Queries over tokens, keyness, concordances and change points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats, text
from lexiquarry.operators import changepoint, kwic, lexical, lexicon, tokens, views
from lexiquarry.plans.adapter import FLAGGED_SQL, LEXICON, SLICES, SPEECHES_SQL, STOP, flagged, speeches
from lexiquarry.plans.core import OCC_SQL, SLICE_CASE
from lexiquarry.plans.registry import query

WITH, WITH_FLAGS = f"WITH {SPEECHES_SQL}", f"WITH {FLAGGED_SQL}"
STRATA = ["year", "agenda", "speaker_group"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

TOKEN_SQL = "tok AS (SELECT row_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT row_id, regexp_extract_all(lower(text), '[a-z][a-z''’-]*') AS ws FROM speeches))"
TERMS_SQL = f"{TOKEN_SQL}, vocab AS (SELECT word, count(*) AS n FROM tok GROUP BY word), dt AS (SELECT row_id, word, count(*) AS n FROM tok GROUP BY ALL)"


def g2_sql(a: str, b: str, n1: str, n2: str) -> str:
    def part(x: str, n: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * ln({x} * ({n1} + {n2})::DOUBLE / ({n}::DOUBLE * ({a} + {b}))) ELSE 0 END"

    return f"CASE WHEN {n1} > 0 AND {n2} > 0 AND {a} + {b} > 0 THEN (CASE WHEN {a} * {n2} >= {b} * {n1} THEN 2.0 ELSE -2.0 END) * ({part(a, n1)} + {part(b, n2)}) ELSE 0 END"


def lr_sql(a: str, b: str, n1: str, n2: str) -> str:
    return f"CASE WHEN {n1} > 0 AND {n2} > 0 THEN log2((greatest({a}, 0.5) / {n1}::DOUBLE) / (greatest({b}, 0.5) / {n2}::DOUBLE)) ELSE 0 END"


def scored_sql(source: str, by: str = "", limit: int | None = None) -> str:
    """g2, log_ratio and rank of rows (by, word, a, b, n1, n2)."""
    over = f"PARTITION BY {by} " if by else ""
    cut = f" WHERE rank <= {limit}" if limit else ""
    lead = f"{by}, " if by else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER ({over}ORDER BY g2 DESC, word)::INT AS rank FROM (SELECT {lead}word, a::BIGINT AS target, b::BIGINT AS reference, round({g2_sql('a', 'b', 'n1', 'n2')}, 3) AS g2, round({lr_sql('a', 'b', 'n1', 'n2')}, 3) AS log_ratio FROM {source})){cut}"


def _tokens(spark, d, offsets=False):
    return tokens.token_table(speeches(spark, d), ["row_id"], offsets=offsets)


_offsets_sql = """SELECT row_id, i - 1 AS pos, word, sum(length(piece) + length(word)) OVER (PARTITION BY row_id ORDER BY i) - length(word) AS st
    FROM (SELECT row_id, unnest(range(1, len(ws) + 1)) AS i, unnest(pieces[1:len(ws)]) AS piece, unnest(ws) AS word FROM (SELECT row_id, regexp_split_to_array(lower(text), '[a-z][a-z''’-]*') AS pieces, regexp_extract_all(lower(text), '[a-z][a-z''’-]*') AS ws FROM speeches{where}))"""


@query("token_offsets", f"{WITH}, o AS ({_offsets_sql.format(where='')}) SELECT row_id, pos::INT AS pos, word, st::INT AS \"start\" FROM o")
def token_offsets(spark, d):
    return _tokens(spark, d, offsets=True)


@query("vocabulary", f"{WITH}, {TERMS_SQL} SELECT word, n::BIGINT AS n FROM vocab")
def vocabulary(spark, d):
    return tokens.vocabulary(_tokens(spark, d))


@query("doc_terms", f"{WITH}, {TERMS_SQL} SELECT row_id, word, n::BIGINT AS n FROM dt")
def doc_terms(spark, d):
    return tokens.document_terms(_tokens(spark, d))


@query("subset_totals", f"{WITH}, {TERMS_SQL} SELECT word, sum(n)::BIGINT AS n FROM dt WHERE row_id IN (SELECT row_id FROM speeches WHERE lang = 'fr') GROUP BY word")
def subset_totals(spark, d):
    return tokens.totals(tokens.document_terms(_tokens(spark, d)), speeches(spark, d).filter("lang = 'fr'"))


@query("g2_log_ratio", f"{WITH}, {TERMS_SQL}, f AS (SELECT word, sum(n) AS a FROM dt WHERE row_id IN (SELECT row_id FROM speeches WHERE lang = 'en') GROUP BY word), x AS (SELECT v.word, coalesce(f.a, 0) AS a, v.n - coalesce(f.a, 0) AS b, (SELECT sum(a) FROM f) AS n1, (SELECT sum(n) FROM vocab) - (SELECT sum(a) FROM f) AS n2 FROM vocab v LEFT JOIN f USING (word)) SELECT word, round({g2_sql('a', 'b', 'n1', 'n2')}, 3) AS g2, round({lr_sql('a', 'b', 'n1', 'n2')}, 3) AS log_ratio FROM x")
def g2_log_ratio(spark, d):
    t = _tokens(spark, d).join(speeches(spark, d).select("row_id", (F.col("lang") == "en").alias("en")), "row_id")
    c = t.groupBy("word").agg(F.count_if("en").alias("a"), F.count_if(~F.col("en")).alias("b"))
    n = c.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    x = [F.col(k) for k in ("a", "b", "n1", "n2")]
    return c.join(F.broadcast(n)).select("word", F.round(stats.log_likelihood(*x), 3).alias("g2"), F.round(stats.log_ratio(*x), 3).alias("log_ratio"))


_compare_src = "c AS (SELECT f.word, a, v.n - a AS b, (SELECT sum(a) FROM f) AS n1, greatest((SELECT sum(n) FROM vocab) - (SELECT sum(a) FROM f), 1) AS n2 FROM f JOIN vocab v USING (word) WHERE a >= 5 AND word NOT IN ({0}))".format(STOP_SQL)


_compare_sql = f"{WITH}, {TERMS_SQL}, f AS (SELECT word, sum(n) AS a FROM dt WHERE row_id IN (SELECT row_id FROM speeches WHERE lang = 'fr') GROUP BY word), {_compare_src} {scored_sql('c', limit=100)}"


@query("compare_ranked", _compare_sql)
def compare_ranked(spark, d):
    return _compared(spark, d)


@query("keyness_bars", f"SELECT word, rank, g2, round(g2 / max(g2) OVER (), 6) AS width FROM ({_compare_sql}) WHERE rank <= 20")
def keyness_bars(spark, d):
    return views.bars(_compared(spark, d), 20).select("word", "rank", "g2", "width")


def _compared(spark, d):
    target, whole = tokens.subset_counts(speeches(spark, d), F.col("lang") == "fr")
    return lexical.compare(target, whole, [], STOP, limit=100)


# The node of the collocation queries is the term of_the: two tokens, `of` and `the`.
_node_sql = """{tok}, offs AS ({offsets}),
  {occ}, span AS (SELECT row_id, s, s + n AS e FROM occ WHERE term = 'of_the'),
  node AS (SELECT DISTINCT o.row_id, o.pos FROM offs o JOIN span ON o.row_id = span.row_id AND o.st >= span.s AND o.st < span.e),
  near AS (SELECT o.row_id, o.pos, o.word, min(abs(o.pos - node.pos)) AS dist FROM offs o JOIN node ON o.row_id = node.row_id AND abs(o.pos - node.pos) <= 15 GROUP BY ALL)"""
NODE_SQL = _node_sql.format(tok=TERMS_SQL, occ=OCC_SQL, offsets=_offsets_sql.format(where=" WHERE contains(lower(text), 'of the')"))


def _near(spark, d):
    some = speeches(spark, d).filter("contains(lower(text), 'of the')")
    toks = tokens.token_table(some, ["row_id"], offsets=True)
    spans = lexicon.occurrences(some, LEXICON, ["row_id"]).filter("term = 'of_the'")
    return lexical.span_contexts(toks, spans, 15)


@query("context_tokens", f"{WITH}, {NODE_SQL} SELECT row_id, pos::INT AS pos, word, dist::INT AS dist FROM near WHERE dist > 0")
def context_tokens(spark, d):
    return _near(spark, d).select("row_id", "pos", "word", "dist")


def _collocates_sql(width: int) -> str:
    return f"{WITH}, {NODE_SQL}, f AS (SELECT word, count(*) AS a FROM near WHERE dist BETWEEN 1 AND {width} GROUP BY word), {_compare_src} {scored_sql('c', limit=100)}"


def _collocates(width: int):
    def run(spark, d):
        target = _near(spark, d).filter(F.col("dist") <= width).groupBy("word").agg(F.count("*").alias("n"))
        return lexical.compare(target, tokens.vocabulary(_tokens(spark, d)), [], STOP, limit=100)

    return run


for _w in (5, 8, 15):
    query(f"collocates_w{_w}", _collocates_sql(_w))(_collocates(_w))


@query("collocates_sliced", f"{WITH}, {NODE_SQL}, f AS (SELECT {SLICE_CASE.replace('year', 'd.year')} AS slice, word, count(*) AS a FROM near JOIN dated d USING (row_id) WHERE dist BETWEEN 1 AND 8 GROUP BY ALL), t AS (SELECT slice, sum(a) AS n1 FROM f GROUP BY slice), c AS (SELECT slice, word, a, v.n - a AS b, n1, greatest((SELECT sum(n) FROM vocab) - n1, 1) AS n2 FROM f JOIN t USING (slice) JOIN vocab v USING (word) WHERE a >= 5 AND word NOT IN ({STOP_SQL})) {scored_sql('c', 'slice', 40)}")
def collocates_sliced(spark, d):
    years = speeches(spark, d).select("row_id", text.slice_label(F.col("year"), SLICES).alias("slice"))
    target = _near(spark, d).filter("dist <= 8").join(years, "row_id").groupBy("slice", "word").agg(F.count("*").alias("n"))
    return lexical.compare(target, tokens.vocabulary(_tokens(spark, d)), ["slice"], STOP, limit=40)


def _collocates_by_sql(label: str, source: str = "dated d") -> str:
    """collocates_sliced with another label of the speech, over the speeches of source."""
    return f"{WITH}, {NODE_SQL}, top AS (SELECT country_org FROM dated GROUP BY country_org ORDER BY count(*) DESC, country_org LIMIT 5), f AS (SELECT {label} AS label, word, count(*) AS a FROM near JOIN {source} USING (row_id) WHERE dist BETWEEN 1 AND 8 GROUP BY ALL), t AS (SELECT label, sum(a) AS n1 FROM f GROUP BY label), c AS (SELECT label, word, a, v.n - a AS b, n1, greatest((SELECT sum(n) FROM vocab) - n1, 1) AS n2 FROM f JOIN t USING (label) JOIN vocab v USING (word) WHERE a >= 5 AND word NOT IN ({STOP_SQL})) {scored_sql('c', 'label', 40)}"


def _collocates_by(spark, d, labels):
    """labels: row_id and label of the speeches that count."""
    target = _near(spark, d).filter("dist <= 8").join(labels, "row_id").groupBy("label", "word").agg(F.count("*").alias("n"))
    return lexical.compare(target, tokens.vocabulary(_tokens(spark, d)), ["label"], STOP, limit=40)


@query("collocates_grouped", _collocates_by_sql("d.speaker_group"))
def collocates_grouped(spark, d):
    return _collocates_by(spark, d, speeches(spark, d).select("row_id", F.col("speaker_group").alias("label")))


@query("collocates_speakers", _collocates_by_sql("d.country_org", "(SELECT row_id, country_org FROM dated JOIN top USING (country_org)) d"))
def collocates_speakers(spark, d):
    rows = speeches(spark, d).select("row_id", F.col("country_org").alias("label"))
    top = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(5).select("label")
    return _collocates_by(spark, d, rows.join(F.broadcast(top), "label"))


# --- matched controls -----------------------------------------------------

WIDE = ["speaker_group", "month"]


def pairs_sql(strata: list[str], flag: str, seeds: str = "SELECT 11 AS seed", name: str = "pairs") -> str:
    cols = ", ".join(strata)
    same = " AND ".join(f"t.{c} IS NOT DISTINCT FROM c.{c}" for c in strata)
    return f"""seeds AS ({seeds}), ranked_{name} AS (SELECT seed, row_id, {flag} AS flag, {cols}, row_number() OVER (PARTITION BY seed, {flag}, {cols} ORDER BY md5(seed || ':pair:' || row_id), row_id) AS k FROM flagged CROSS JOIN seeds),
    {name} AS (SELECT t.seed, {', '.join('t.' + c for c in strata)}, t.k, t.row_id AS target_id, c.row_id AS control_id FROM ranked_{name} t JOIN ranked_{name} c ON t.flag AND NOT c.flag AND t.seed = c.seed AND t.k = c.k AND {same})"""


@query("matched_pairs", f"{WITH_FLAGS}, {pairs_sql(STRATA, 'has_hea')} SELECT year, agenda, speaker_group, k::INT AS k, target_id, control_id FROM pairs")
def matched_pairs(spark, d):
    return lexical.matched_pairs(flagged(spark, d).select("row_id", "has_hea", *STRATA), "has_hea", STRATA, 11)


@query("short_strata", f"{WITH_FLAGS} SELECT year, agenda, speaker_group, count(*) FILTER (has_hea)::BIGINT AS wanted, least(count(*) FILTER (has_hea), count(*) FILTER (NOT has_hea))::BIGINT AS matched FROM flagged GROUP BY ALL HAVING count(*) FILTER (NOT has_hea) < count(*) FILTER (has_hea)")
def short_strata(spark, d):
    return lexical.short_strata(flagged(spark, d), "has_hea", STRATA)


@query("matched_coverage", f"{WITH_FLAGS}, {pairs_sql(WIDE, 'has_hea')} SELECT (SELECT count(*) FROM flagged WHERE has_hea)::BIGINT AS wanted, count(*)::BIGINT AS matched, round(count(*) / (SELECT count(*) FROM flagged WHERE has_hea), 6) AS coverage FROM pairs")
def matched_coverage(spark, d):
    f = flagged(spark, d).select("row_id", "has_hea", *WIDE)
    return lexical.coverage(lexical.matched_pairs(f, "has_hea", WIDE, 11), f, "has_hea")


_keyness_cells = f"t AS (SELECT word, sum(n) AS a FROM dt JOIN pairs ON row_id = target_id GROUP BY word), c AS (SELECT word, sum(n) AS b FROM dt JOIN pairs ON row_id = control_id GROUP BY word), k AS (SELECT word, a, coalesce(b, 0) AS b, (SELECT sum(a) FROM t) AS n1, (SELECT sum(b) FROM c) AS n2 FROM t LEFT JOIN c USING (word) WHERE a >= 5 AND word NOT IN ({STOP_SQL}))"
_keyness_sql = f"{WITH_FLAGS}, {TERMS_SQL}, {pairs_sql(WIDE, 'has_hea')}, {_keyness_cells}"


def _matched(spark, d):
    f = flagged(spark, d).select("row_id", "has_hea", *WIDE)
    return f, lexical.matched_pairs(f, "has_hea", WIDE, 11)


@query("keyness_matched", f"{_keyness_sql} SELECT word, target, reference AS control, g2, log_ratio, rank FROM ({scored_sql('k', limit=60)})")
def keyness_matched(spark, d):
    return lexical.keyness(speeches(spark, d).select("row_id", "text"), _matched(spark, d)[1], STOP, [], limit=60)


@query("keyness_unmatched", f"{WITH_FLAGS}, {TERMS_SQL}, f AS (SELECT word, sum(n) AS a FROM dt WHERE row_id IN (SELECT row_id FROM flagged WHERE has_hea) GROUP BY word), {_compare_src} {scored_sql('c', limit=60)}")
def keyness_unmatched(spark, d):
    target, whole = tokens.subset_counts(flagged(spark, d), F.col("has_hea"))
    return lexical.compare(target, whole, [], STOP, limit=60)


_unmatched = f"uf AS (SELECT word, sum(n) AS a FROM dt WHERE row_id IN (SELECT row_id FROM flagged WHERE has_hea) GROUP BY word), uc AS (SELECT uf.word, a, v.n - a AS b, (SELECT sum(a) FROM uf) AS n1, greatest((SELECT sum(n) FROM vocab) - (SELECT sum(a) FROM uf), 1) AS n2 FROM uf JOIN vocab v USING (word) WHERE a >= 5 AND word NOT IN ({STOP_SQL}))"


@query("matching_effect", f"{_keyness_sql}, {_unmatched}, u AS ({scored_sql('uc', limit=15)}), m AS ({scored_sql('k', limit=60)}) SELECT count(*)::BIGINT AS words, round(median(u.log_ratio - coalesce(m.log_ratio, 0)), 3) AS median_drop FROM u LEFT JOIN m USING (word)")
def matching_effect(spark, d):
    return lexical.matching_effect(keyness_unmatched(spark, d), keyness_matched(spark, d))


@query("keyness_stability", f"{WITH_FLAGS}, {TERMS_SQL}, {pairs_sql(WIDE, 'has_hea', 'SELECT unnest(range(11, 16)) AS seed')}, both_sides AS (SELECT seed, target_id AS row_id, true AS t FROM pairs UNION ALL SELECT seed, control_id, false FROM pairs), w AS (SELECT word FROM vocab WHERE word NOT IN ({STOP_SQL}) ORDER BY n DESC, word LIMIT 20), tot AS (SELECT seed, sum(n) FILTER (t) AS n1, sum(n) FILTER (NOT t) AS n2 FROM both_sides JOIN dt USING (row_id) GROUP BY seed), cnt AS (SELECT seed, word, sum(n) FILTER (t) AS a, sum(n) FILTER (NOT t) AS b FROM both_sides JOIN dt USING (row_id) GROUP BY ALL), r AS (SELECT w.word, tot.seed, {lr_sql('coalesce(a, 0)', 'coalesce(b, 0)', 'n1', 'n2')} AS r FROM w CROSS JOIN tot LEFT JOIN cnt ON cnt.word = w.word AND cnt.seed = tot.seed) SELECT word, round(quantile_cont(r, 0.5), 3) AS median, round(quantile_cont(r, 0.05), 3) AS p05, round(quantile_cont(r, 0.95), 3) AS p95 FROM r GROUP BY word")
def keyness_stability(spark, d):
    f, terms = _matched(spark, d)[0], tokens.occurring(speeches(spark, d), ["row_id"])
    words = terms.groupBy("word").agg(F.sum("n").alias("n")).filter(~F.col("word").isin(STOP)).orderBy(F.desc("n"), "word").limit(20)
    return lexical.stability(f, terms, words, "has_hea", WIDE, 11, 5)


_speaker_pairs = """own AS (SELECT row_id, country_org, speaker_group, month, md5('11:pair:' || row_id) AS h, row_number() OVER (PARTITION BY country_org, speaker_group, month ORDER BY md5('11:pair:' || row_id), row_id) AS k FROM dated),
  want AS (SELECT country_org AS who, speaker_group, month, count(*) AS w FROM dated GROUP BY ALL),
  ctl AS (SELECT who, c.speaker_group, c.month, row_id, row_number() OVER (PARTITION BY who, c.speaker_group, c.month ORDER BY c.h, row_id) AS k FROM own c JOIN want ON c.country_org <> who AND c.speaker_group IS NOT DISTINCT FROM want.speaker_group AND c.month = want.month),
  sp AS (SELECT own.country_org, own.speaker_group, own.month, own.k, own.row_id AS target_id, ctl.row_id AS control_id FROM own JOIN ctl ON own.country_org = ctl.who AND own.speaker_group IS NOT DISTINCT FROM ctl.speaker_group AND own.month = ctl.month AND own.k = ctl.k)"""


@query("speaker_pairs", f"{WITH}, {_speaker_pairs} SELECT country_org, speaker_group, month, k::INT AS k, target_id, control_id FROM sp")
def speaker_pairs(spark, d):
    return lexical.speaker_pairs(speeches(spark, d), WIDE, 11)


_gates = "gates AS (SELECT h.country_org, held::BIGINT AS held, coalesce(pairs, 0)::BIGINT AS pairs, round(coalesce(pairs, 0) / held, 6) AS coverage FROM (SELECT country_org, count(*) AS held FROM speeches GROUP BY ALL) h LEFT JOIN (SELECT country_org, count(*) AS pairs FROM sp GROUP BY ALL) p USING (country_org))"


@query("speaker_gates", f"{WITH}, {_speaker_pairs}, {_gates} SELECT country_org, held, pairs, coverage, array_to_string(list_filter([CASE WHEN pairs < 45 THEN 'pairs' END, CASE WHEN coverage < 0.9 THEN 'coverage' END], lambda x: x IS NOT NULL), '|') AS withheld_because FROM gates")
def speaker_gates(spark, d):
    s = speeches(spark, d)
    gates, _ = lexical.speaker_keyness(s, s.select("row_id", "text"), WIDE, 11, STOP, 45, 0.9, 40)
    return gates.withColumn("withheld_because", F.array_join("withheld_because", "|"))


@query("speaker_keyness", f"{WITH}, {TERMS_SQL}, {_speaker_pairs}, {_gates}, p AS (SELECT sp.* FROM sp JOIN gates USING (country_org) WHERE gates.pairs >= 45 AND coverage >= 0.9), t AS (SELECT country_org, word, sum(n) AS a FROM dt JOIN p ON row_id = target_id GROUP BY ALL), c AS (SELECT country_org, word, sum(n) AS b FROM dt JOIN p ON row_id = control_id GROUP BY ALL), k AS (SELECT t.country_org, word, a, coalesce(b, 0) AS b, n1, n2 FROM t JOIN (SELECT country_org, sum(a) AS n1 FROM t GROUP BY ALL) USING (country_org) JOIN (SELECT country_org, sum(b) AS n2 FROM c GROUP BY ALL) USING (country_org) LEFT JOIN c USING (country_org, word) WHERE a >= 5 AND word NOT IN ({STOP_SQL})) SELECT country_org, word, target, reference AS control, g2, log_ratio, rank, list_contains(regexp_extract_all(lower(country_org), '[a-z][a-z''’-]*'), word) AS self_reference FROM ({scored_sql('k', 'country_org', 20)})")
def speaker_keyness(spark, d):
    s = speeches(spark, d)
    return lexical.speaker_keyness(s, s.select("row_id", "text"), WIDE, 11, STOP, 45, 0.9, 20)[1]


def _pmi_sql(by: str, minimum: int) -> str:
    names = sorted(t.name for t in LEXICON.active)
    nested = {(t.name, t.nested_under) for t in LEXICON.active} | {(t.nested_under, t.name) for t in LEXICON.active}
    lead, group = (f"{by} AS slice, ", f" GROUP BY {by}") if by else ("", "")
    parts = [f"SELECT {lead}'{a}' AS source, '{b}' AS target, count(*) FILTER (has_{a} AND has_{b})::BIGINT AS speeches, count(*) FILTER (has_{a}) AS a, count(*) FILTER (has_{b}) AS b, count(*) AS n FROM flagged{group}" for i, a in enumerate(names) for b in names[i + 1 :] if (a, b) not in nested]
    pmi = "log2((speeches / n) / ((a / n) * (b / n)))"
    return f"{WITH_FLAGS}, e AS ({' UNION ALL '.join(parts)}) SELECT {'slice, ' if by else ''}source, target, speeches, round({pmi}, 4) AS pmi, round(CASE WHEN speeches = n THEN 1 ELSE {pmi} / -log2(speeches / n) END, 4) AS npmi FROM e WHERE speeches >= {minimum}"


@query("pmi_network", _pmi_sql("", 20))
def pmi_network(spark, d):
    return lexical.pmi_network(flagged(spark, d), LEXICON.active, 20)


_term_sums = " UNION ALL ".join(f"SELECT '{t.name}' AS term, sum(n_{t.name})::BIGINT AS occurrences FROM flagged" for t in LEXICON.active)


@query("network_nodes", f"{WITH_FLAGS}, e AS (SELECT unnest([source, target]) AS term FROM ({_pmi_sql('', 20)})), o AS ({_term_sums}) SELECT term, count(*)::BIGINT AS degree, any_value(occurrences)::BIGINT AS occurrences FROM e JOIN o USING (term) GROUP BY term")
def network_nodes(spark, d):
    f = flagged(spark, d)
    counts = lexicon.summary(f, LEXICON).filter("kind = 'terms'").select(F.col("name").alias("term"), "occurrences")
    return views.network_view(lexical.pmi_network(f, LEXICON.active, 20), counts)


@query("pmi_by_period", _pmi_sql(SLICE_CASE, 10))
def pmi_by_period(spark, d):
    f = flagged(spark, d).withColumn("slice", text.slice_label(F.col("year"), SLICES))
    return lexical.pmi_network(f, LEXICON.active, 10, ["slice"])


@query("term_cooccurrence", f"{WITH}, {OCC_SQL}, h AS (SELECT DISTINCT row_id, term FROM occ) SELECT a.term AS source, b.term AS target, count(*)::BIGINT AS speeches FROM h a JOIN h b ON a.row_id = b.row_id AND a.term < b.term GROUP BY ALL")
def term_cooccurrence(spark, d):
    h = lexicon.occurrences(speeches(spark, d), LEXICON, ["row_id"]).select("row_id", F.col("term").alias("source")).distinct()
    other = h.select("row_id", F.col("source").alias("target"))
    return h.join(other, "row_id").filter("source < target").groupBy("source", "target").agg(F.count("*").alias("speeches"))


# --- concordances ---------------------------------------------------------

_flat = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
LINES_SQL = f"""{OCC_SQL}, lines AS (SELECT o.row_id, d.country_org, d.agenda, d.speaker_group, d.date, d.year, d.month, d.meeting_symbol, d.speech_number, o.term, o.ordinal, o.s AS st, o.s + o.n AS en,
   d.meeting_symbol || '_spch' || lpad(d.speech_number::VARCHAR, 4, '0') || '#' || o.ordinal AS id,
   {_flat('substr(d.text, greatest(o.s - 40, 0) + 1, o.s - greatest(o.s - 40, 0))')} AS "left", {_flat('substr(d.text, o.s + 1, o.n)')} AS kw, {_flat('substr(d.text, o.s + o.n + 1, 40)')} AS "right" FROM occ o JOIN dated d USING (row_id))"""
KEEP = ["row_id", "country_org", "agenda", "speaker_group", "date", "year", "month"]


def _lines(spark, d):
    return kwic.lines(speeches(spark, d), LEXICON, KEEP, width=40, sentences=False)


@query("kwic_lines", f'{WITH}, {LINES_SQL} SELECT row_id, country_org, agenda, date, term, ordinal, st AS "start", en AS "end", id, "left", kw, "right" FROM lines')
def kwic_lines(spark, d):
    return _lines(spark, d).select("row_id", "country_org", "agenda", "date", "term", "ordinal", "start", "end", "id", "left", "kw", "right")


@query("kwic_filtered", f"{WITH}, {LINES_SQL} SELECT id, term FROM lines WHERE year BETWEEN 1995 AND 2015 AND month = 7 AND speaker_group = 'P5' AND contains(lower(\"left\" || ' ' || kw || ' ' || \"right\"), 'er')")
def kwic_filtered(spark, d):
    return kwic.filtered(_lines(spark, d), (1995, 2015), "07", group="P5", query="ER").select("id", "term")


_plain = "regexp_replace(lower(\"left\"), '[^a-z ]', '', 'g')"


@query("kwic_sort_left", f"{WITH}, {LINES_SQL} SELECT id, term FROM lines ORDER BY reverse({_plain}), id, term LIMIT 60 OFFSET 60")
def kwic_sort_left(spark, d):
    return kwic.page(_lines(spark, d), "left", 1).select("id", "term")


@query("kwic_sort_right", f'{WITH}, {LINES_SQL} SELECT id, term FROM lines ORDER BY lower("right"), id, term LIMIT 60')
def kwic_sort_right(spark, d):
    return kwic.page(_lines(spark, d), "right", 0).select("id", "term")


@query("kwic_sort_agenda", f"{WITH}, {LINES_SQL} SELECT id, term FROM lines ORDER BY agenda NULLS LAST, date, id, term LIMIT 60")
def kwic_sort_agenda(spark, d):
    return kwic.page(_lines(spark, d), "agenda", 0).select("id", "term")


@query("kwic_reconciled", f"{WITH_FLAGS}, {OCC_SQL}, l AS (SELECT term, count(*)::BIGINT AS lines, count(DISTINCT row_id)::BIGINT AS speeches FROM occ GROUP BY term), f AS ({' UNION ALL '.join(f'''SELECT '{t.name}' AS term, sum(n_{t.name})::BIGINT AS counted FROM flagged''' for t in LEXICON.active)}) SELECT term, lines, speeches, counted, lines = counted AS agrees FROM l JOIN f USING (term)")
def kwic_reconciled(spark, d):
    l = lexicon.occurrences(speeches(spark, d), LEXICON, ["row_id"]).groupBy("term").agg(F.count("*").alias("lines"), F.countDistinct("row_id").alias("speeches"))
    counts = lexicon.summary(flagged(spark, d), LEXICON).filter("kind = 'terms'").select(F.col("name").alias("term"), F.col("occurrences").alias("counted"))
    return l.join(counts, "term").withColumn("agrees", F.col("lines") == F.col("counted"))


@query("kwic_index")
def kwic_index(spark, d):
    return kwic.index(kwic.lines(speeches(spark, d), LEXICON, ["row_id"]))


@query("sentence_spans")
def sentence_spans(spark, d):
    s = speeches(spark, d).select("row_id", F.posexplode(kwic.sentence_spans(F.col("text"))).alias("i", "s"))
    return s.select("row_id", "i", "s.start", "s.end")


MERGED_SQL = f"""{OCC_SQL}, m AS (SELECT *, s + n AS e, max(s + n) OVER (PARTITION BY row_id ORDER BY s, s + n, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM occ),
  isl AS (SELECT *, sum((before IS NULL OR s >= before)::INT) OVER (PARTITION BY row_id ORDER BY s, e, term ROWS UNBOUNDED PRECEDING) AS g FROM m),
  merged AS (SELECT row_id, min(s)::INT AS st, max(e)::INT AS en, array_to_string(list_sort(list_distinct(list(term))), '|') AS terms FROM isl GROUP BY row_id, g)"""


@query("span_merge", f'{WITH}, {MERGED_SQL} SELECT row_id, st AS "start", en AS "end", terms FROM merged')
def span_merge(spark, d):
    return kwic.merged_spans(lexicon.occurrences(speeches(spark, d), LEXICON, ["row_id"])).withColumn("terms", F.array_join("terms", "|"))


@query("reader_segments", f"""{WITH}, {MERGED_SQL}, e AS (SELECT m.row_id, st, en, terms, lag(en, 1, 0) OVER (PARTITION BY m.row_id ORDER BY st) AS prev, s.text FROM merged m JOIN speeches s USING (row_id)),
  r AS (SELECT row_id, prev AS a, st AS b, '' AS terms, text FROM e UNION ALL SELECT row_id, st, en, terms, text FROM e UNION ALL SELECT s.row_id, coalesce(max(m.en), 0), length(any_value(s.text)), '', any_value(s.text) FROM speeches s LEFT JOIN merged m USING (row_id) GROUP BY s.row_id)
  SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY a, b) - 1)::INT AS segment, substr(text, a + 1, b - a) AS text, terms FROM r WHERE b > a""")
def reader_segments(spark, d):
    s = speeches(spark, d)
    spans = kwic.merged_spans(lexicon.occurrences(s, LEXICON, ["row_id"]))
    return kwic.reader_segments(s, spans).withColumn("terms", F.array_join("terms", "|"))


@query("meeting_summary", f"{WITH}, {OCC_SQL}, o AS (SELECT meeting_symbol, array_to_string(list_sort(list_distinct(list(term))), '|') AS terms, count(*) AS n FROM occ JOIN speeches USING (row_id) GROUP BY ALL) SELECT s.meeting_symbol, count(*)::BIGINT AS speeches, coalesce(any_value(o.terms), '') AS terms, coalesce(any_value(o.n), 0)::BIGINT AS occurrences FROM speeches s LEFT JOIN o USING (meeting_symbol) GROUP BY s.meeting_symbol")
def meeting_summary(spark, d):
    s = speeches(spark, d)
    return kwic.meeting_summary(lexicon.occurrences(s, LEXICON, ["row_id", "meeting_symbol"]), s).withColumn("terms", F.array_join("terms", "|"))


@query("speech_export")
def speech_export(spark, d):
    s = speeches(spark, d)
    return kwic.speech_export(s, lexicon.occurrences(s, LEXICON, ["row_id"]), only_bearing=True)


@query("highlight", "WITH h AS (SELECT item_id, string_split(lower(text), 'en') AS p FROM benchmark) SELECT item_id, (len(p) - 1)::INT AS hits FROM h")
def highlight(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    seg = text.highlight(F.col("text"), "EN", limit=10_000)
    return b.select("item_id", F.size(F.filter(seg, lambda s: s["hit"])).alias("hits"))


# --- change points --------------------------------------------------------

_yearly = "y0 AS (SELECT o_orderpriority AS series, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY q) - 1 AS i0 FROM y0), p AS (SELECT *, round(k / n, 6) AS r FROM y)"


def _quarters(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    y = o.groupBy(F.col("o_orderpriority").alias("series"), text.period(F.col("o_orderdate"), "quarter").alias("q")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    return y.withColumns({"i0": F.row_number().over(Window.partitionBy("series").orderBy("q")) - 1, "r": F.round(F.col("k") / F.col("n"), 6)})


def _gain_sql() -> str:
    lengths = ", ".join(f"({n}, {x})" for n in range(8, 81) for x in changepoint.interval_lengths(n, 4))
    return f"WITH {_yearly}, lens(n, len) AS (VALUES {lengths}), size AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM p GROUP BY series)), s AS (SELECT series, i0 + 1 AS i, sum(r) OVER (PARTITION BY series ORDER BY i0) AS s FROM p UNION ALL SELECT DISTINCT series, 0, 0.0 FROM p), g AS (SELECT a.series, a.i AS a, t.i AS t, b.i AS b, (t.i - a.i) * (b.i - t.i) / (b.i - a.i)::DOUBLE * pow((t.s - a.s) / (t.i - a.i) - (b.s - t.s) / (b.i - t.i), 2) AS gain FROM s a JOIN s b ON a.series = b.series AND b.i - a.i IN (SELECT len FROM lens JOIN size USING (n)) JOIN s t ON t.series = a.series AND t.i - a.i >= 4 AND b.i - t.i >= 4)"


def _gains(spark, d):
    """Gains over the series of the orders' quarters; the plan is that of the longest one."""
    q = _quarters(spark, d)
    longest = q.agg(F.coalesce(F.max("i0") + 1, F.lit(0))).first()[0]
    return changepoint.gain_table(q, "r", ["series"], longest, 4)


@query("wbs_gains", f"{_gain_sql()} SELECT series, a::INT AS a, t::INT AS t, b::INT AS b, round(gain, 6) AS gain FROM g")
def wbs_gains(spark, d):
    g = _gains(spark, d)
    return g.withColumn("gain", F.round("gain", 6))


@query("best_split", f"{_gain_sql()} SELECT series, a::INT AS a, t::INT AS t, b::INT AS b, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(gain, 6) DESC, b - a, a, t) AS k FROM g WHERE round(gain, 6) > 0) WHERE k = 1")
def best_split(spark, d):
    return changepoint.best_split(_gains(spark, d), ["series"]).withColumn("gain", F.round("gain", 6))


_cut = "c AS (SELECT a.series, a.i0 AS t, sum(b.k) FILTER (b.i0 < a.i0) AS k1, sum(b.n) FILTER (b.i0 < a.i0) AS n1, sum(b.k) FILTER (b.i0 >= a.i0) AS k2, sum(b.n) FILTER (b.i0 >= a.i0) AS n2, sum(b.k) AS k, sum(b.n) AS n FROM p a JOIN p b USING (series) GROUP BY ALL), d AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series) AS points FROM c) WHERE t BETWEEN 4 AND points - 4)"


def _ll(f: str, k: str, n: str) -> str:
    a = f"(CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}::DOUBLE) ELSE 0 END)"
    return f"({a} + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(({n} - {k}) / {n}::DOUBLE) ELSE 0 END)" if f == "binomial" else f"({a} - {k})"


def _gain_of(f: str) -> str:
    return f"WITH {_yearly}, {_cut} SELECT series, t::INT AS t, round(2 * ({_ll(f, 'k1', 'n1')} + {_ll(f, 'k2', 'n2')} - {_ll(f, 'k', 'n')}), 4) + 0 AS gain FROM d"


@query("binomial_gain", _gain_of("binomial"))
def binomial_gain(spark, d):
    return changepoint.likelihood_gains(_quarters(spark, d), "k", "n", ["series"], 4, "binomial").select("series", "t", F.round("gain", 4).alias("gain"))


@query("poisson_gain", _gain_of("poisson"))
def poisson_gain(spark, d):
    return changepoint.likelihood_gains(_quarters(spark, d), "k", "n", ["series"], 4, "poisson").select("series", "t", F.round("gain", 4).alias("gain"))


_z = "1.959963984540054"


@query("rate_intervals", f"WITH {_yearly} SELECT series, q, round(greatest(0, ((k / n + {_z} * {_z} / (2 * n)) - {_z} * sqrt((k / n) * (1 - k / n) / n + {_z} * {_z} / (4.0 * n * n))) / (1 + {_z} * {_z} / n)), 6) AS low, round(least(1, ((k / n + {_z} * {_z} / (2 * n)) + {_z} * sqrt((k / n) * (1 - k / n) / n + {_z} * {_z} / (4.0 * n * n))) / (1 + {_z} * {_z} / n)), 6) AS high, round(CASE WHEN k = 0 THEN 0 ELSE k / n / exp({_z} / sqrt(k)) END, 6) AS poisson_low, round(CASE WHEN k = 0 THEN -ln(0.05) / n ELSE k / n * exp({_z} / sqrt(k)) END, 6) AS poisson_high FROM y")
def rate_intervals(spark, d):
    q = _quarters(spark, d)
    w, p = changepoint.rate_interval(F.col("k"), F.col("n"), "binomial"), changepoint.rate_interval(F.col("k"), F.col("n"), "poisson")
    return q.select("series", "q", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.round(p["low"], 6).alias("poisson_low"), F.round(p["high"], 6).alias("poisson_high"))


@query("change_points_perm")
def change_points_perm(spark, d):
    return changepoint.change_points(_quarters(spark, d), "series", "q", "r")


@query("rate_bootstrap")
def rate_bootstrap(spark, d):
    return changepoint.rate_change_points(_quarters(spark, d), "series", "q", "k", "n", "binomial")
