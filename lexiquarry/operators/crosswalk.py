"""Proposing a crosswalk of speakers, and attributing items whose origin was lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators.quality import gate

COLUMNS = ["country_org", "entity_type", "iso3", "un_regional_group", "lat", "lon", "needs_review", "note", "source"]


def read_reference(spark: SparkSession, table: str, points: str) -> DataFrame:
    """name, iso2, iso3, region, lat, lon: a CSV of countries with the points of a GeoJSON collection, joined on the two-letter code.

    Only an empty field is null: `NA` is a country's code. Countries without a point keep
    null coordinates; features without a geometry are passed over.
    """
    rows = spark.read.csv(table, header=True, nullValue="", encoding="UTF-8")
    countries = rows.select("name", F.col("`alpha-2`").alias("iso2"), F.col("`alpha-3`").alias("iso3"), "region")
    feature = "features array<struct<properties:struct<ISO:string>,geometry:struct<coordinates:array<double>>>>"
    found = spark.read.schema(feature).option("multiLine", True).json(points).select(F.explode("features").alias("f")).filter("f.geometry IS NOT NULL")
    at = F.col("f.geometry.coordinates")
    # Of several features of a code the last one counts, as in a file that is read in order.
    placed = found.select(F.col("f.properties.ISO").alias("iso2"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"))
    return countries.join(placed.groupBy("iso2").agg(F.last("lat").alias("lat"), F.last("lon").alias("lon")), "iso2", "left").select("name", "iso2", "iso3", "region", "lat", "lon")


def folded(name):
    """A name for matching only: `&` is a word, marks and punctuation go."""
    return text.name_fold(F.replace(name, F.lit("&"), F.lit(" and ")))


def propose(speakers: DataFrame, reference: DataFrame, aliases: DataFrame, by_hand: DataFrame, groups: DataFrame, exceptions: DataFrame, overrides: dict[str, str], rules: list[tuple[str, str]], default: str = "civil_society") -> DataFrame:
    """One proposed row per speaker (country_org, speeches; names are unique): COLUMNS and speeches.

    The first of these that knows a name answers, and `source` says which one did:
    by_hand (country_org, iso3, un_regional_group, lat, lon), always a state; the
    reference (name, iso3, region, lat, lon), by the name's alias (alias, name) or the
    name itself; overrides; rules, in order, whatever their case; the default, which alone needs
    review. A state's group is that of its code in exceptions (iso3, group; an empty one
    is an answer), else that of its region (region, group), else `other`. The small tables
    are broadcast. Raises if names of the reference are the same once folded.
    """
    keyed = reference.withColumn("_key", folded(F.col("name")))
    gate([f"the reference has {r['_key']!r} {r['count']} times" for r in keyed.groupBy("_key").count().filter("count > 1").limit(9).collect()])
    alias = aliases.select(F.col("alias").alias("country_org"), F.col("name").alias("_alias"))
    hand = by_hand.select("country_org", F.struct("iso3", "un_regional_group", "lat", "lon").alias("_hand"))
    known = keyed.select("_key", F.struct("iso3", "region", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).alias("_ref"))
    named = speakers.join(F.broadcast(alias), "country_org", "left").join(F.broadcast(hand), "country_org", "left")
    rows = named.withColumn("_key", folded(F.coalesce("_alias", "country_org"))).join(F.broadcast(known), "_key", "left")
    rows = rows.join(F.broadcast(exceptions.select(F.col("iso3").alias("_iso"), F.col("group").alias("_own"))), F.col("_ref.iso3") == F.col("_iso"), "left")
    rows = rows.join(F.broadcast(groups.select(F.col("region").alias("_region"), F.col("group").alias("_usual"))), F.col("_ref.region") == F.col("_region"), "left")
    by_rule = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        by_rule = F.when(F.col("country_org").rlike(f"(?i){pattern}"), kind).otherwise(by_rule)
    by_name = F.lit(None).cast("string")
    for name, kind in overrides.items():
        by_name = F.when(F.col("country_org") == name, kind).otherwise(by_name)
    rows = rows.withColumns({"_rule": by_rule, "_override": by_name})
    source = F.when(F.col("_hand").isNotNull(), "hand").when(F.col("_ref").isNotNull(), F.when(F.col("_alias").isNotNull(), "alias").otherwise("reference"))
    source = source.when(F.col("_override").isNotNull(), "override").when(F.col("_rule").isNotNull(), "rule").otherwise("default")
    rows = rows.withColumn("source", source)
    of_reference = F.col("source").isin("alias", "reference")
    answer = lambda own, other: F.when(F.col("source") == "hand", own).when(of_reference, other)
    return rows.select(
        "country_org", F.when(F.col("source").isin("hand", "alias", "reference"), "state").otherwise(F.coalesce("_override", "_rule", F.lit(default))).alias("entity_type"),
        answer(F.col("_hand.iso3"), F.col("_ref.iso3")).alias("iso3"), answer(F.col("_hand.un_regional_group"), F.coalesce("_own", "_usual", F.lit("other"))).alias("un_regional_group"),
        answer(F.col("_hand.lat"), F.col("_ref.lat")).alias("lat"), answer(F.col("_hand.lon"), F.col("_ref.lon")).alias("lon"), (F.col("source") == "default").alias("needs_review"),
        F.when(F.col("source") == "alias", F.concat(F.lit("reference name: "), "_alias")).alias("note"), "source", "speeches",
    )


def review_order(proposed: DataFrame) -> DataFrame:
    """proposed and place: what needs review first, then by speeches, ties by name, so that review lands where the speeches are. One task numbers the speakers."""
    order = Window.orderBy(F.desc("needs_review"), F.desc("speeches"), "country_org")
    return proposed.withColumn("place", F.row_number().over(order))


def attributed(items: DataFrame, published: DataFrame) -> DataFrame:
    """items (item, topic, words, intruder) and model, matches: the model of published (model, topic, words in order) they came from.

    An item's own words are those without the intruder; a model matches if its first so
    many words of the topic are the same set. model is null unless exactly one matches.
    """
    own = items.withColumn("_own", F.array_sort(F.array_distinct(F.filter("words", lambda w: (w != "") & ~w.eqNullSafe(F.col("intruder"))))))
    sizes = own.select("topic", F.size("_own").alias("_n")).distinct()
    sets = published.select("model", "topic", "words").join(sizes, "topic").select("topic", "model", F.array_sort(F.array_distinct(F.slice("words", 1, F.col("_n")))).alias("_own")).distinct()
    counted = sets.groupBy("topic", "_own").agg(F.min("model").alias("_model"), F.count("*").alias("_c"))
    joined = own.join(counted, ["topic", "_own"], "left").withColumn("matches", F.coalesce("_c", F.lit(0)))
    return joined.select(*items.columns, F.when(F.col("matches") == 1, F.col("_model")).alias("model"), "matches")


def checked_attribution(items: DataFrame, published: DataFrame) -> DataFrame:
    """attributed, or an error that names items without a single origin: nothing is guessed."""
    out = attributed(items, published)
    gate([f"{r['item']}: {r['matches']} models match" for r in out.filter("model IS NULL").orderBy("item").limit(9).collect()])
    return out
