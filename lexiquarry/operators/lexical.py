"""Collocates, matched controls, keyness and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats
from lexiquarry.operators.tokens import occurring, self_reference

MIN_COUNT = 5


def _with_total(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (by, word, n) and _tt, the sum of n in the group."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_tt"))
    return counts.join(totals, by) if by else counts.join(F.broadcast(totals))


def _ranked(scored: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    """scored and rank, by g2, ties by word. Without groups, only the rows up to the limit are numbered in one task."""
    order = [F.desc("g2"), F.col("word")]
    if not by and limit is not None:
        scored = scored.orderBy(*order).limit(limit)
    ranked = scored.withColumn("rank", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def compare(target: DataFrame, reference: DataFrame, by: list[str], stop: list[str], minimum: int = MIN_COUNT, limit: int | None = None, target_total: Column | None = None, reference_total: Column | None = None) -> DataFrame:
    """Words of target (by, word, n) against a reference (word, n) that contains it.

    Columns: by, word, target, reference (the rest), g2, log_ratio, rank (by g2, ties
    by word). Words below the minimum and stop words are left out of the list, not of
    the totals.
    """
    whole = reference.agg(F.sum("n").alias("_rt"))
    counted = target.withColumn("_tt", target_total) if target_total is not None else _with_total(target, by)
    counted = counted.filter((F.col("n") >= minimum) & (~F.col("word").isin(stop) if stop else F.lit(True)))
    joined = counted.join(reference.select("word", F.col("n").alias("_ref")), "word", "left").join(F.broadcast(whole))
    rest = F.greatest(F.coalesce("_ref", F.lit(0)) - F.col("n"), F.lit(0))
    rest_total = reference_total if reference_total is not None else F.greatest(F.col("_rt") - F.col("_tt"), F.lit(1))
    scored = joined.select(*by, "word", F.col("n").alias("target"), rest.alias("reference"), F.col("_tt"), rest_total.alias("_n2"))
    scored = scored.withColumns(
        {
            "g2": F.round(stats.log_likelihood(F.col("target"), F.col("reference"), F.col("_tt"), F.col("_n2")), 3),
            "log_ratio": F.round(stats.log_ratio(F.col("target"), F.col("reference"), F.col("_tt"), F.col("_n2")), 3),
        }
    ).drop("_tt", "_n2")
    return _ranked(scored, by, limit)


def _opened(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, pos, word, start) and _node: whether a span (key, start, end) is open at its start.

    Tokens and spans are merged by offset, spans first; a token lies in a span if the
    furthest end so far is beyond its start. One sort, whatever the number of spans.
    """
    none = F.lit(None).cast("int")
    events = tokens.select(key, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("pos").cast("int").alias("pos"), "word", none.alias("_end"))
    events = events.union(spans.select(key, "start", F.lit(0), none, F.lit(None).cast("string"), F.col("end").cast("int")))
    so_far = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_node", F.coalesce(F.max("_end").over(so_far) > F.col("_at"), F.lit(False)))
    return marked.filter("pos IS NOT NULL").select(key, "pos", "word", "_at", "_node")


def node_tokens(tokens: DataFrame, spans: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, pos) of the tokens that start inside a span (key, start, end)."""
    return _opened(tokens, spans, key).filter("_node").select(key, "pos")


def span_contexts(tokens: DataFrame, spans: DataFrame, width: int, key: str = "row_id") -> DataFrame:
    """Tokens (key, pos, word) within `width` of a token inside a span, each once, those inside left out, with dist to the nearest one.

    One pass serves all narrower windows: filter on dist. The last such token before a
    token and the first one after it are carried along, so that nothing is joined.
    """
    node = F.when(F.col("_node"), F.col("pos"))
    up = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    placed = _opened(tokens, spans, key).withColumn("_before", F.last(node, ignorenulls=True).over(up)).withColumn("_after", F.last(node, ignorenulls=True).over(down))
    dist = F.least(F.col("pos") - F.col("_before"), F.col("_after") - F.col("pos"))
    return placed.select(key, "pos", "word", dist.alias("dist")).filter((F.col("dist") > 0) & (F.col("dist") <= width))


def matched_pairs(frame: DataFrame, is_target: str, strata: list[str], seed: int | Column, key: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """Pairs (by, strata, k, target_id, control_id) without replacement inside each stratum, by hash order.

    Null strata are strata. frame has one row per (by, document).
    """
    by = by or []
    order = stats.hash_order(seed, "pair", F.col(key))
    w = Window.partitionBy(*by, *strata, is_target).orderBy("_o", key)
    ranked = frame.withColumn("_o", order).withColumn("k", F.row_number().over(w))
    t = ranked.filter(F.col(is_target)).select(*by, *strata, "k", F.col(key).alias("target_id"))
    c = ranked.filter(~F.col(is_target)).select(*[F.col(x).alias(f"_{x}") for x in by + strata], F.col("k").alias("_k"), F.col(key).alias("control_id"))
    same = F.col("k") == F.col("_k")
    for x in by + strata:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return t.join(c, same).select(*by, *strata, "k", "target_id", "control_id")


def short_strata(frame: DataFrame, is_target: str, strata: list[str]) -> DataFrame:
    """Strata with more targets than controls: wanted and matched."""
    out = frame.groupBy(*strata).agg(F.count_if(is_target).alias("wanted"), F.count_if(~F.col(is_target)).alias("_c"))
    return out.withColumn("matched", F.least("wanted", "_c")).filter("matched < wanted").drop("_c")


def coverage(pairs: DataFrame, frame: DataFrame, is_target: str) -> DataFrame:
    return frame.agg(F.count_if(is_target).alias("wanted")).join(pairs.agg(F.count("*").alias("matched"))).withColumn("coverage", F.round(stats.rate(F.col("matched"), F.col("wanted")), 6))


def keyness(terms: DataFrame, pairs: DataFrame, stop: list[str], by: list[str], limit: int | None = None, minimum: int = MIN_COUNT) -> DataFrame:
    """Words of the targets of pairs against those of targets and controls.

    terms is a table (row_id, word, n), or the speeches themselves (row_id, text): then a
    text travels once to the pairs that it is in, and is parted into words only there.
    """
    member = lambda c, target: F.struct(F.col(c).alias("row_id"), F.lit(target).alias("_t"))
    members = pairs.select(*by, F.explode(F.array(member("target_id", True), member("control_id", False))).alias("_m")).select(*by, "_m.*")
    rows = terms.join(members.hint("shuffle_hash"), "row_id")
    rows = rows if "word" in terms.columns else occurring(rows, [*by, "_t"])
    counted = rows.groupBy(*by, "word").agg(F.sum(F.when(F.col("_t"), F.col("n"))).alias("n"), F.sum(F.when(~F.col("_t"), F.col("n"))).alias("_c"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_tt"), F.sum("_c").alias("_ct"))
    joined = counted.filter((F.col("n") >= minimum) & (~F.col("word").isin(stop) if stop else F.lit(True)))
    joined = joined.join(totals, by) if by else joined.join(F.broadcast(totals))
    ref, total = F.coalesce("_c", F.lit(0)), F.coalesce("_ct", F.lit(0))
    scored = joined.select(*by, "word", F.col("n").alias("target"), ref.alias("control"), F.round(stats.log_likelihood(F.col("n"), ref, F.col("_tt"), total), 3).alias("g2"), F.round(stats.log_ratio(F.col("n"), ref, F.col("_tt"), total), 3).alias("log_ratio"))
    return _ranked(scored, by, limit)


def stability(frame: DataFrame, terms: DataFrame, words: DataFrame, is_target: str, strata: list[str], first_seed: int, draws: int) -> DataFrame:
    """Median, 5 % and 95 % of each word's log ratio over re-drawn controls; the first draw is the published one."""
    seeds = F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + draws - 1))).alias("seed")
    many = frame.select("row_id", is_target, *strata, seeds)
    pairs = matched_pairs(many, is_target, strata, F.col("seed"), by=["seed"])
    both = pairs.select("seed", F.explode(F.array(F.struct(F.col("target_id").alias("row_id"), F.lit(True).alias("t")), F.struct(F.col("control_id").alias("row_id"), F.lit(False).alias("t")))).alias("m")).select("seed", "m.row_id", "m.t")
    size = terms.groupBy("row_id").agg(F.sum("n").alias("size"))
    totals = both.join(size, "row_id").groupBy("seed").agg(F.sum(F.when(F.col("t"), F.col("size"))).alias("n1"), F.sum(F.when(~F.col("t"), F.col("size"))).alias("n2"))
    chosen = terms.join(F.broadcast(words.select("word")), "word").groupBy("row_id", "word").agg(F.sum("n").alias("n"))
    counts = both.join(chosen, "row_id").groupBy("seed", "word").agg(F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("t"), F.col("n"))), F.lit(0)).alias("b"))
    grid = words.select("word").join(totals)
    ratios = grid.join(counts, ["seed", "word"], "left").fillna(0, ["a", "b"]).withColumn("r", stats.log_ratio(F.col("a"), F.col("b"), F.col("n1"), F.col("n2")))
    q = F.percentile("r", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)))
    return ratios.groupBy("word").agg(q.alias("q")).select("word", *[F.round(F.get("q", F.lit(i)), 3).alias(c) for i, c in enumerate(("median", "p05", "p95"))])


def speaker_pairs(frame: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """Matched pairs of every speaker against all others: country_org, strata, k, target_id, control_id.

    A stratum's rows are ranked once. A speaker with n rows there needs the first n of the
    others, which are among the first 2 n of all, so only these ranks are joined.
    """
    order = stats.hash_order(seed, "pair", F.col("row_id"))
    rows = frame.select("row_id", "country_org", *strata).withColumn("_o", order)
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("country_org", *strata).orderBy("_o", "row_id")))
    wanted = own.groupBy("country_org", *strata).agg(F.count("*").alias("_want")).select(F.col("country_org").alias("_who"), *[F.col(c).alias(f"_{c}") for c in strata], "_want")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", "row_id")))
    asked = wanted.withColumn("_at", F.explode(F.sequence(F.lit(1), (2 * F.col("_want")).cast("int"))))
    same = (F.col("_r") == F.col("_at")) & (F.col("country_org") != F.col("_who"))
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    control = ranked.join(asked, same)
    place = Window.partitionBy("_who", *[f"_{c}" for c in strata]).orderBy("_o", "row_id")
    control = control.withColumn("_k", F.row_number().over(place)).filter("_k <= _want")
    control = control.select("_who", *[f"_{c}" for c in strata], "_k", F.col("row_id").alias("control_id"))
    match = (F.col("country_org") == F.col("_who")) & (F.col("k") == F.col("_k"))
    for c in strata:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(control, match).select("country_org", *strata, "k", F.col("row_id").alias("target_id"), "control_id")


def speaker_keyness(frame: DataFrame, terms: DataFrame, strata: list[str], seed: int, stop: list[str], minimum: int, least_coverage: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """(speakers with pairs, held, coverage, withheld_because; published keywords with self_reference)."""
    pairs = speaker_pairs(frame, strata, seed)
    held = frame.groupBy("country_org").agg(F.count("*").alias("held"))
    gates = held.join(pairs.groupBy("country_org").agg(F.count("*").alias("pairs")), "country_org", "left").fillna(0, ["pairs"])
    gates = gates.withColumn("coverage", F.round(stats.rate(F.col("pairs"), F.col("held")), 6))
    because = F.array_compact(F.array(F.when(F.col("pairs") < minimum, "pairs"), F.when(F.col("coverage") < least_coverage, "coverage")))
    gates = gates.withColumn("withheld_because", because)
    passed = pairs.join(gates.filter(F.size("withheld_because") == 0).select("country_org"), "country_org", "left_semi")
    words = keyness(terms, passed, stop, ["country_org"], limit)
    return gates, words.withColumn("self_reference", self_reference(F.col("word"), F.col("country_org")))


def matching_effect(unmatched: DataFrame, matched: DataFrame, top: int = 15) -> DataFrame:
    """Median drop of the log ratio of the top unmatched words when controls are matched; an absent word counts 0."""
    best = unmatched.filter(F.col("rank") <= top).select("word", F.col("log_ratio").alias("u"))
    joined = best.join(matched.select("word", F.col("log_ratio").alias("m")), "word", "left")
    return joined.agg(F.count("*").alias("words"), F.round(F.median(F.col("u") - F.coalesce("m", F.lit(0.0))), 3).alias("median_drop"))


def pmi_network(flags: DataFrame, terms: list, minimum: int, by: list[str] | None = None) -> DataFrame:
    """Edges (by, source, target, speeches, pmi, npmi) between terms of the same speeches, by npmi, then name.

    flags has a has_<term> column per term. Nested pairs and pairs below the minimum
    are left out. Counts of single terms and pairs come from one pass.
    """
    by = by or []
    nested = {(t.name, t.nested_under) for t in terms} | {(t.nested_under, t.name) for t in terms}
    names = sorted(t.name for t in terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (a, b) not in nested]
    agg = [F.count("*").alias("_n")] + [F.count_if(f"has_{a}").alias(f"s_{a}") for a in names]
    agg += [F.count_if(F.col(f"has_{a}") & F.col(f"has_{b}")).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)]
    wide = flags.groupBy(*by).agg(*agg) if by else flags.agg(*agg)
    cells = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"p_{i}").alias("speeches"), F.col(f"s_{a}").alias("a"), F.col(f"s_{b}").alias("b")) for i, (a, b) in enumerate(pairs)])
    rows = wide.select(*by, "_n", F.explode(cells).alias("e")).select(*by, "_n", "e.*").filter(F.col("speeches") >= minimum)
    x = [F.col(c) for c in ("speeches", "a", "b", "_n")]
    return rows.withColumns({"pmi": F.round(stats.pmi(*x), 4), "npmi": F.round(stats.npmi(*x), 4)}).drop("_n", "a", "b").orderBy(*by, F.desc("npmi"), "source", "target")
