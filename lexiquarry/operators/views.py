"""Queries behind the pages of a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heatmap(monthly: DataFrame, rate: str = "speech_rate") -> DataFrame:
    """monthly (period, held, sufficient, rates) with year, month, state, value, weight and tone.

    unobserved: nothing held; withheld: too little; the ramp ends at the largest drawn value.
    """
    state = F.when(F.col("held") == 0, "unobserved").when(F.col("sufficient") & F.col(rate).isNotNull(), "drawn").otherwise("withheld")
    cells = monthly.withColumn("state", state).withColumn("value", F.when(F.col("state") == "drawn", F.col(rate)))
    top = F.max("value").over(Window.partitionBy("kind", "name"))
    weight = F.when(F.col("value").isNotNull() & (top > 0), F.least(F.col("value") / top, F.lit(1.0))).otherwise(F.lit(0.0))
    cells = cells.withColumn("weight", F.round(weight, 6)).withColumn("tone", F.round(F.sqrt(weight), 6))
    return cells.withColumns({"year": F.substring("period", 1, 4).cast("int"), "month": F.substring("period", 6, 2).cast("int")})


def calendar_shared(items: DataFrame, months: DataFrame) -> DataFrame:
    """Whether the two strongest months (by speech_rate, ties by month) have the same leading item."""
    w = Window.orderBy(F.desc_nulls_last("speech_rate"), "month")
    two = months.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").select("month")
    lead = items.filter("rank = 1").join(two, "month")
    return lead.agg((F.count("*") == 2).alias("both"), (F.countDistinct("item") == 1).alias("one")).select((F.col("both") & F.col("one")).alias("shared"))


def choropleth(rows: DataFrame, described: DataFrame, rate: str = "speech_rate") -> DataFrame:
    """iso3, state (drawn, contested, withheld), holders, value, tone: one patch per code of a mappable speaker."""
    j = rows.join(described.filter("mappable").select("country_org", "iso3"), "country_org")
    g = j.groupBy("iso3").agg(F.count_if("sufficient").alias("_d"), F.array_join(F.array_sort(F.collect_list("country_org")), "|").alias("holders"), F.max(F.when(F.col("sufficient"), F.col(rate))).alias("_v"))
    out = g.withColumn("state", F.when(F.col("_d") > 1, "contested").when(F.col("_d") == 1, "drawn").otherwise("withheld")).withColumn("value", F.when(F.col("_d") == 1, F.col("_v")))
    top = F.max("value").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("tone", F.round(F.when(F.col("value").isNotNull() & (top > 0), F.sqrt(F.least(F.col("value") / top, F.lit(1.0)))).otherwise(F.lit(0.0)), 6)).drop("_d", "_v")


def patches_without_shape(patches: DataFrame, shapes: DataFrame) -> DataFrame:
    return patches.join(shapes, "iso3", "left_anti").select("iso3")


def map_points(described: DataFrame) -> DataFrame:
    """lat, lon, speakers and whether more than one speaker stands there."""
    g = described.filter("mappable").groupBy("lat", "lon").agg(F.array_join(F.sort_array(F.collect_set("country_org")), "|").alias("speakers"), F.count("*").alias("_n"))
    return g.withColumn("shared", F.col("_n") > 1).drop("_n")


def actor_plan(rows: DataFrame, described: DataFrame) -> DataFrame:
    """drawable, under (the minimum), absent (speakers without a row), refusal."""
    one = rows.agg(F.count_if("sufficient").alias("drawable"), F.count_if(~F.col("sufficient")).alias("under"))
    all_of = described.agg(F.count("*").alias("_a"))
    out = one.join(all_of).withColumn("absent", F.greatest(F.col("_a") - F.col("drawable") - F.col("under"), F.lit(0)))
    return out.withColumn("refusal", F.when(F.col("drawable") == 0, "none-sufficient")).drop("_a")


def standing_bands(standing: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """country_org, grp, count, from, to: the shares of a speaker's groups laid end to end, the last to 100."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("grp"), F.col(f"`{g}`").alias("count")) for i, g in enumerate(groups)])
    long = standing.select("country_org", "held", F.explode(cells).alias("c")).select("country_org", "held", "c.*").filter(F.col("count") > 0)
    w = Window.partitionBy("country_org").orderBy("i")
    upto = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(F.lead("i").over(w).isNull(), 100.0).otherwise(F.least(upto * 100.0 / F.col("held"), F.lit(100.0)))
    return long.withColumns({"from": F.round((upto - F.col("count")) * 100.0 / F.col("held"), 6), "to": F.round(end, 6)}).drop("i", "held")


def bars(words: DataFrame, limit: int = 20) -> DataFrame:
    """The first words with their width relative to the largest g2."""
    kept = words.filter(F.col("rank") <= limit)
    return kept.withColumn("width", F.round(F.col("g2") / F.max("g2").over(Window.partitionBy(F.lit(1))), 6))


def pivot_lines(breakdown: DataFrame, categories: list[str], value: str = "speech_rate") -> DataFrame:
    """period and a column per category; a missing cell is null."""
    return breakdown.groupBy("period").pivot("category", categories).agg(F.first(value))


def available_units(long: DataFrame) -> DataFrame:
    """kind, name, units: token_rate and occurrences only where there are counts."""
    has = F.count("occurrences") > 0
    return long.groupBy("kind", "name").agg(F.when(has, "speech_rate|token_rate|occurrences").otherwise("speech_rate").alias("units"))


def artefact_problems(monthly: DataFrame, periods: int) -> DataFrame:
    """kind, name and problem: an incomplete grid, more bearing than held, a rate that is missing or shouldn't be."""
    g = monthly.groupBy("kind", "name").agg(
        (F.countDistinct("period") != periods).alias("incomplete grid"), (F.count_if(F.col("speeches") > F.col("held")) > 0).alias("more than held"),
        (F.count_if(F.col("sufficient") & F.col("speech_rate").isNull()) > 0).alias("rate missing"), (F.count_if(~F.col("sufficient") & F.col("speech_rate").isNotNull()) > 0).alias("rate not withheld"),
    )
    names = ("incomplete grid", "more than held", "rate missing", "rate not withheld")
    return g.select("kind", "name", F.explode(F.array_compact(F.array(*[F.when(F.col(f"`{c}`"), c) for c in names]))).alias("problem"))


def word_cloud(words: DataFrame, floor: int, limit: int, value: str = "target") -> DataFrame:
    """word, n, size (square root, 0 to 1) of the first words above the floor, with what each step removed.

    The vocabulary is counted by an aggregate and cut by a top-k; only the words shown
    meet in one task.
    """
    enough = F.col(value) >= floor
    counts = words.agg(F.count_if(~enough).alias("below_floor"), F.greatest(F.count_if(enough) - limit, F.lit(0)).alias("cut"))
    kept = words.filter(enough).orderBy(F.desc(value), "word").limit(limit)
    bounds = kept.agg(F.sqrt(F.min(value)).alias("_low"), F.sqrt(F.max(value)).alias("_high"))
    rows = kept.join(F.broadcast(bounds)).join(F.broadcast(counts))
    size = F.when(F.col("_high") > F.col("_low"), (F.sqrt(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(1.0))
    return rows.select("word", F.col(value).alias("n"), F.round(size, 6).alias("size"), "below_floor", "cut")


def cloud_refusal(words: DataFrame, floor: int, value: str = "target") -> DataFrame:
    """Why there is nothing to draw: no-rows, below-minimum, or null."""
    one = words.agg(F.count("*").alias("n"), F.count_if(F.col(value) >= floor).alias("k"))
    return one.select(F.when(F.col("n") == 0, "no-rows").when(F.col("k") == 0, "below-minimum").alias("refusal"))


def concordance_links(cells: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """A drill-down per term and cell: a set gives one link for each member; cells without speeches none."""
    table = F.create_map(*[x for k, v in members.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    terms = F.when(F.col("kind") == "sets", F.try_element_at(table, F.col("name"))).when(F.col("kind") == "terms", F.array("name"))
    return cells.filter("speeches >= 1").select("kind", "name", "period", F.explode(terms).alias("term"))


def network_view(edges: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Nodes of the edges with their degree; terms without an edge are left out."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))
    return ends.join(occurrences, "term", "left")


def register_shares(long: DataFrame) -> DataFrame:
    """name, bearing share of all that was held, over all periods."""
    return long.filter("kind = 'registers'").groupBy("name").agg(F.round(F.sum("speeches") / F.sum("held"), 6).alias("share"))


def reader_tally(occurrences: DataFrame, meeting: str) -> DataFrame:
    """Spans per register in one meeting."""
    return occurrences.filter(F.col("meeting_symbol") == meeting).groupBy("register").agg(F.count("*").alias("spans"))


def grid_export(cells: DataFrame) -> DataFrame:
    """kind, name, year, month, state, measure and value: a heatmap (held, value, weight) in long form."""
    long = cells.select("kind", "name", "year", "month", "state", F.col("held").cast("double").alias("held"), F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight"))
    return long.unpivot(["kind", "name", "year", "month", "state"], ["held", "value", "weight"], "measure", "amount").withColumnRenamed("amount", "value")


def publishing_order(keyness: DataFrame) -> DataFrame:
    """keyness (speaker, pairs, withheld) with section and place: published ones by most pairs, withheld ones by fewest, then `unpaired`; ties by name."""
    pairs = F.coalesce("pairs", F.lit(0))
    section = F.when(pairs == 0, "unpaired").when(F.col("withheld"), "withheld").otherwise("published")
    order = Window.partitionBy("section").orderBy(F.when(F.col("section") == "published", -pairs).otherwise(pairs), "speaker")
    return keyness.withColumn("section", section).withColumn("place", F.row_number().over(order))
