"""Measures by speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats, text
from lexiquarry.operators.series import PER

GROUPS = ("P5", "E10", "Non-member state", "UN", "Non-state")
SEATED = ("P5", "E10")
WHOLE = "whole"


def by_speaker(frame: DataFrame, has: str, count: str | None, slices: tuple[tuple[int, int], ...], minimum: int) -> DataFrame:
    """country_org x period (each slice and the whole corpus) from one scan by grouping sets.

    Columns: held, tokens, speeches, occurrences, rates (null below the minimum), sufficient.
    """
    base = frame.select("country_org", text.slice_label(F.col("year"), slices).alias("period"), "tokens", F.col(has).alias("_h"), (F.col(count) if count else F.lit(None).cast("long")).alias("_n"))
    grouped = base.groupingSets([["country_org"], ["country_org", "period"]], "country_org", "period").agg(
        F.grouping("period").alias("_g"), F.count("*").alias("held"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count_if("_h").alias("speeches"), F.sum("_n").cast("long").alias("occurrences")
    )
    out = grouped.withColumn("period", F.when(F.col("_g") == 1, WHOLE).otherwise(F.col("period"))).drop("_g").filter(F.col("period") != "outside")
    enough = F.col("held") >= minimum
    return out.withColumns(
        {
            "speech_rate": F.when(enough, F.round(stats.rate(F.col("speeches"), F.col("held")), 6)),
            "token_rate": F.when(enough, F.round(stats.rate(F.col("occurrences"), F.col("tokens"), PER), 4)),
            "sufficient": enough,
        }
    )


def standing(frame: DataFrame, groups: tuple[str, ...] = GROUPS, seated: tuple[str, ...] = SEATED) -> DataFrame:
    """country_org, a column per group (zeros kept), held, seated, seated_share, category."""
    wide = frame.groupBy("country_org").pivot("speaker_group", list(groups)).agg(F.count(F.lit(1))).fillna(0, list(groups))
    held = sum((F.col(f"`{g}`") for g in groups), F.lit(0))
    sat = sum((F.col(f"`{g}`") for g in seated), F.lit(0))
    out = wide.withColumns({"held": held.cast("long"), "seated": sat.cast("long")}).withColumn("seated_share", F.round(stats.rate(F.col("seated"), F.col("held")), 6))
    return out.withColumn("category", F.when(F.col("seated") == 0, "never").when(F.col("seated") == F.col("held"), "always").otherwise("changed"))


def unknown_groups(frame: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Rows whose group is none of the declared ones."""
    return frame.filter(F.col("speaker_group").isNull() | ~F.col("speaker_group").isin(*groups))


def describe(frame: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """country_org, speeches, first_year, last_year, crosswalk attributes, mappable."""
    own = frame.groupBy("country_org").agg(F.count("*").alias("speeches"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    mappable = (F.col("entity_type") == "state") & F.col("iso3").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return own.join(crosswalk, "country_org", "left").withColumn("mappable", F.coalesce(mappable, F.lit(False)))


def collisions(described: DataFrame) -> DataFrame:
    """iso3 codes of more than one speaker and their sorted names."""
    out = described.filter(F.col("iso3").isNotNull()).groupBy("iso3").agg(F.sort_array(F.collect_set("country_org")).alias("speakers"))
    return out.filter(F.size("speakers") > 1)


def period_totals(by_speaker_rows: DataFrame) -> DataFrame:
    return by_speaker_rows.groupBy("period").agg(
        F.sum("held").alias("speeches"), F.sum("tokens").alias("tokens"), F.count("*").alias("speakers"),
        F.count_if("sufficient").alias("speakers_at_minimum"), F.coalesce(F.sum(F.when(F.col("sufficient"), F.col("held"))), F.lit(0)).alias("speeches_at_minimum"),
    )


def eligible(frame: DataFrame, minimum: int) -> DataFrame:
    return frame.groupBy("country_org").agg(F.count("*").alias("speeches")).filter(F.col("speeches") >= minimum)


def composition(frame: DataFrame, item: str, k: int = 8, missing: str = "(unlabelled)") -> DataFrame:
    """country_org, held, items, top3_share and per item of the k largest: item, speeches, share, the tail as `other`."""
    counts = frame.groupBy("country_org", F.coalesce(item, F.lit(missing)).alias("item")).agg(F.count("*").alias("speeches"))
    w = Window.partitionBy("country_org")
    ranked = counts.withColumns({"held": F.sum("speeches").over(w), "items": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("speeches"), "item"))})
    ranked = ranked.withColumn("_top3", F.sum(F.when(F.col("_r") <= 3, F.col("speeches"))).over(w))
    label = F.when(F.col("_r") <= k, F.col("item")).otherwise("other")
    out = ranked.groupBy("country_org", "held", "items", "_top3", label.alias("item"), F.least("_r", F.lit(k + 1)).alias("rank")).agg(F.sum("speeches").alias("speeches"))
    return out.withColumns({"share": F.round(F.col("speeches") / F.col("held"), 6), "top3_share": F.round(F.col("_top3") / F.col("held"), 6)}).drop("_top3")


def ranking(rows: DataFrame, order: str = "speech_rate") -> DataFrame:
    """Sufficient rows by an ordering (speech_rate, speeches, token_rate, occurrences), names break ties.

    Orderings that need counts fall back to speech_rate if the measure has none; the
    ordering used is in `ordering`, the place in `rank`. One row per speaker.
    """
    if order not in ("speech_rate", "speeches", "token_rate", "occurrences"):
        raise ValueError(f"unknown ordering {order!r}")
    usable = F.lit(order) if order in ("speech_rate", "speeches") else F.when(F.count("occurrences").over(Window.partitionBy(F.lit(1))) > 0, order).otherwise("speech_rate")
    kept = rows.filter("sufficient").withColumn("ordering", usable)
    value = F.when(F.col("ordering") == order, F.col(order).cast("double")).otherwise(F.col("speech_rate"))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(value.desc_nulls_last(), "country_org")))


def standing_order(standing: DataFrame) -> DataFrame:
    """standing and place: by most speeches held, then the largest seated share, then the name.

    One row a speaker, so they are numbered in one task.
    """
    order = Window.orderBy(F.desc("held"), F.desc_nulls_last("seated_share"), "country_org")
    return standing.withColumn("place", F.row_number().over(order))


def period_problems(frame: DataFrame, slices: tuple[tuple[int, int], ...]) -> DataFrame:
    """year, rows and slices of the years of frame that lie in no slice or in several (both ends belong to a slice)."""
    inside = sum((F.col("year").between(a, b).cast("int") for a, b in slices), F.lit(0))
    years = frame.groupBy("year").agg(F.count("*").alias("rows")).withColumn("slices", F.coalesce(inside, F.lit(0)))
    return years.filter("slices != 1")
