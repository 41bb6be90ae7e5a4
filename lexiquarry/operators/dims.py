"""Dimensions: aliases, entities, membership, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_case(df: DataFrame, column: str) -> DataFrame:
    """df with each spelling of a label replaced by the most frequent one of its case class.

    Ties go to the smaller spelling; nulls stay. The table of labels is joined, so its
    size decides whether it is broadcast.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("_k"), F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("_n"), "_v"))).filter("_r = 1").select("_k", "_v")
    return df.withColumn("_k", F.lower(column)).join(best, "_k", "left").withColumn(column, F.col("_v")).drop("_k", "_v")


def canonicalise(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with column mapped by aliases (alias, canonical); other values pass."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return df.join(a, F.col(column) == F.col("_a"), "left").withColumn(column, F.coalesce("_c", column)).drop("_a", "_c")


def bad_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that map to themselves or to another alias, or are given twice."""
    names = aliases.select(F.col("alias").alias("canonical")).distinct()
    chain = aliases.join(names, "canonical", "left_semi").select("alias", F.lit("chain").alias("problem"))
    own = aliases.filter("alias = canonical").select("alias", F.lit("self").alias("problem"))
    twice = aliases.groupBy("alias").count().filter("count > 1").select("alias", F.lit("twice").alias("problem"))
    return chain.filter("true").join(own.select("alias"), "alias", "left_anti").union(own).union(twice)


def attach(df: DataFrame, entities: DataFrame, key: str = "country_org") -> DataFrame:
    """df with the attributes of its entity; many rows to one entity, checked."""
    twice = [r[0] for r in entities.groupBy(key).count().filter("count > 1").select(key).limit(8).collect()]
    if twice:
        raise ValueError(f"entities list {twice} more than once")
    return df.join(entities, key, "left")


def entity_problems(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """country_org and problem of every row that breaks a rule of the crosswalk."""
    none = F.lit(None).cast("string")
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    is_state = F.col("entity_type") == "state"
    found = F.array_compact(
        F.array(
            F.when(F.col("entity_type").isNull() | ~F.col("entity_type").isin(*kinds), "type").otherwise(none),
            F.when(is_state & F.col("iso3").isNull(), "state without iso3").otherwise(none),
            F.when(is_state & ~placed, "state without place").otherwise(none),
            F.when(~is_state & (F.col("lat").isNotNull() | F.col("lon").isNotNull()), "place without state").otherwise(none),
        )
    )
    return entities.select("country_org", F.explode(found).alias("problem"))


def unseen(df: DataFrame, entities: DataFrame, key: str = "country_org") -> DataFrame:
    """Distinct values of key that entities doesn't list."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().join(entities, key, "left_anti")


def membership_by_year(terms: DataFrame) -> DataFrame:
    """(country_org, year, seat) of terms (country_org, start_year, end_year, seat)."""
    years = F.explode(F.sequence("start_year", "end_year")).alias("year")
    return terms.filter("start_year <= end_year").select("country_org", years, "seat").distinct()


def roster(membership: DataFrame, first: int, last: int, permanent: int, elected: int) -> DataFrame:
    """year, permanent, elected, valid for every year of the range."""
    years = membership.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    held = membership.groupBy("year").agg(F.count_if(F.col("seat") == "permanent").alias("permanent"), F.count_if(F.col("seat") == "elected").alias("elected"))
    full = years.join(held, "year", "left").fillna(0, ["permanent", "elected"])
    return full.withColumn("valid", (F.col("permanent") == permanent) & (F.col("elected") == elected))


def speaker_group(entity_type: Column, seat: Column) -> Column:
    state = entity_type == "state"
    return F.when(state & (seat == "permanent"), "P5").when(state & (seat == "elected"), "E10").when(state, "Non-member state").when(entity_type == "un", "UN").otherwise("Non-state")


def with_group(speeches: DataFrame, membership: DataFrame) -> DataFrame:
    """speeches (country_org, year, entity_type) and speaker_group."""
    joined = speeches.join(membership.select("country_org", "year", "seat"), ["country_org", "year"], "left")
    return joined.withColumn("speaker_group", speaker_group(F.col("entity_type"), F.col("seat"))).drop("seat")


def silent_members(membership: DataFrame, speeches: DataFrame) -> DataFrame:
    """Members (country_org, year) that never spoke in a year of their term."""
    return membership.select("country_org", "year").join(speeches.select("country_org", "year").distinct(), ["country_org", "year"], "left_anti")


def drift(stored: DataFrame, now: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """column and how many rows of stored differ from now (joined one to one by key); nulls are equal."""
    joined = stored.select(key, *columns).join(now.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key)
    kinds = dict(stored.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(c), F.col(f"_{c}")
        near = F.abs(a - b) <= tolerance if kinds[c] in ("double", "float") else F.lit(False)
        return ~(a.eqNullSafe(b) | F.coalesce(near, F.lit(False)))

    one = joined.agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])).alias("d")).select("d.*")
