"""Series: denominators, measures, breakdowns and withholding."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats
from lexiquarry.operators.state import kept

PER = 100_000


def denominators(frame: DataFrame, by: list[str], grid: DataFrame | None = None) -> DataFrame:
    """speeches, tokens, meetings per label; with a grid every label of it, 0 where nothing is."""
    out = frame.groupBy(*by).agg(F.count("*").alias("speeches"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.countDistinct("meeting_symbol").alias("meetings"))
    return out if grid is None else grid.join(out, by, "left").fillna(0, ["speeches", "tokens", "meetings"])


def measures(frame: DataFrame, rows: list[tuple[str, str, str, str | None]], by: list[str], grid: DataFrame | None = None) -> DataFrame:
    """All measures of all labels in long form from one scan.

    Columns: by, kind, name, held and tokens (of the whole label), speeches,
    occurrences (null for sets), speech_rate, token_rate. A label without a hit is a
    row of zeros; a label of the grid without speeches has null rates.
    """
    agg = [F.count("*").alias("held"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")]
    for i, (_, _, has, n) in enumerate(rows):
        agg.append(F.count_if(F.col(has)).alias(f"h{i}"))
        if n:
            agg.append(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"c{i}"))
    wide = frame.groupBy(*by).agg(*agg)
    if grid is not None:
        wide = grid.join(wide, by, "left").fillna(0)
    none = F.lit(None).cast("long")
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("name"), F.col(f"h{i}").alias("speeches"), (F.col(f"c{i}") if n else none).alias("occurrences")) for i, (k, v, _, n) in enumerate(rows)])
    out = wide.select(*by, "held", "tokens", F.explode(cells).alias("m")).select(*by, "m.kind", "m.name", "held", "tokens", "m.speeches", "m.occurrences")
    return out.withColumns({"speech_rate": F.round(stats.rate(F.col("speeches"), F.col("held")), 6), "token_rate": F.round(stats.rate(F.col("occurrences"), F.col("tokens"), PER), 4)})


def withhold(frame: DataFrame, minimum: int, held: str = "held", rates: tuple[str, ...] = ("speech_rate", "token_rate")) -> DataFrame:
    """frame with sufficient, and null rates where fewer than `minimum` are held; counts stay."""
    enough = F.col(held) >= minimum
    return frame.withColumns({r: F.when(enough, F.col(r)) for r in rates if r in frame.columns} | {"sufficient": enough})


def month_grid(spark, first: int, last: int) -> DataFrame:
    """period 'yyyy-MM' of every month of the years."""
    if first > last:
        raise ValueError("the grid runs backwards")
    return spark.range((last - first + 1) * 12).select(F.format_string("%d-%02d", (F.lit(first) + F.floor(F.col("id") / 12)).cast("int"), (F.col("id") % 12 + 1).cast("int")).alias("period"))


def breakdown(frame: DataFrame, period: Column, by: str, has: str, count: str | None, top: int | None = None, other: str = "Other", missing: str = "Unknown") -> DataFrame:
    """period, category, held, tokens, speeches, occurrences and rates; no row where nothing is.

    Null categories are named; beyond the `top` largest (ties by label) they are folded.
    """
    base = frame.select(period.alias("period"), F.coalesce(by, F.lit(missing)).alias("category"), "tokens", F.col(has).alias("_h"), (F.col(count) if count else F.lit(None).cast("long")).alias("_n"))
    if top is not None:
        largest = base.groupBy("category").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "category").limit(top).select("category", F.lit(True).alias("_top"))
        base = base.join(F.broadcast(largest), "category", "left").withColumn("category", F.when(F.col("_top"), F.col("category")).otherwise(other))
    out = base.groupBy("period", "category").agg(F.count("*").alias("held"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count_if("_h").alias("speeches"), F.sum("_n").cast("long").alias("occurrences"))
    return out.withColumns({"speech_rate": F.round(stats.rate(F.col("speeches"), F.col("held")), 6), "token_rate": F.round(stats.rate(F.col("occurrences"), F.col("tokens"), PER), 4)})


def breakdowns(frame: DataFrame, period: Column, columns: dict[str, int | None], measures: dict[str, tuple[str, str | None]], other: str = "Other", missing: str = "Unknown") -> DataFrame:
    """breakdown of many columns and measures: column, measure, period, category and what breakdown gives.

    columns maps a column to how many of its categories are kept; measures maps a name
    to its flag and its count, if any. The frame is scanned once and aggregated by every
    category; the rest works on those sums. Columns that the frame lacks are left out with a warning.
    """
    lacking = sorted(set(columns) - set(frame.columns))
    if lacking:
        warnings.warn(f"no column {', '.join(lacking)}", stacklevel=2)
    columns = {c: top for c, top in columns.items() if c not in lacking}
    no_cells = F.array().cast("array<struct<column:string,category:string>>")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("category")) for c in columns]) if columns else no_cells
    flags = [F.col(has).alias(f"_h{i}") for i, (has, _) in enumerate(measures.values())]
    counts = [(F.col(n) if n else F.lit(None)).cast("long").alias(f"_n{i}") for i, (_, n) in enumerate(measures.values())]
    long = frame.select(period.alias("period"), "tokens", *flags, *counts, F.explode(cells).alias("_c")).select("*", "_c.column", "_c.category")
    each = range(len(measures))
    sums = [F.count("*").alias("held"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")] + [F.count_if(f"_h{i}").alias(f"_h{i}") for i in each] + [F.sum(f"_n{i}").alias(f"_n{i}") for i in each]
    full = kept(long.groupBy("column", "period", "category").agg(*sums))
    limit = F.lit(None).cast("int")
    for c, top in columns.items():
        limit = F.when(F.col("column") == c, top).otherwise(limit)
    sizes = full.groupBy("column", "category").agg(F.sum("held").alias("_s"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("_s"), "category"))
    largest = sizes.filter(limit.isNotNull()).withColumn("_r", place).filter(F.col("_r") <= max([t for t in columns.values() if t is not None], default=0))
    largest = largest.filter(F.col("_r") <= limit).select("column", "category", F.lit(True).alias("_top"))
    folded = full.join(F.broadcast(largest), ["column", "category"], "left").withColumn("category", F.when(limit.isNull() | F.col("_top"), F.col("category")).otherwise(other))
    again = folded.groupBy("column", "period", "category").agg(*[F.sum(c).cast("long").alias(c) for c in ("held", "tokens", *[f"_h{i}" for i in each], *[f"_n{i}" for i in each])])
    rows = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"_h{i}").alias("speeches"), F.col(f"_n{i}").alias("occurrences")) for i, name in enumerate(measures)])
    out = again.select("column", "period", "category", "held", "tokens", F.explode(rows).alias("_m")).select("column", "_m.measure", "period", "category", "held", "tokens", "_m.speeches", "_m.occurrences")
    return out.withColumns({"speech_rate": F.round(stats.rate(F.col("speeches"), F.col("held")), 6), "token_rate": F.round(stats.rate(F.col("occurrences"), F.col("tokens"), PER), 4)})


def calendar(frame: DataFrame, has: str, excluded: tuple[int, ...] = ()) -> DataFrame:
    """month 1 to 12, pooled over years, all and without the excluded years."""
    keep = ~F.col("year").isin(*excluded) if excluded else F.lit(True)
    out = frame.groupBy("month").agg(F.count("*").alias("held"), F.count_if(F.col(has)).alias("speeches"), F.count_if(keep).alias("held_control"), F.count_if(F.col(has) & keep).alias("speeches_control"))
    months = frame.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    full = months.join(out, "month", "left").fillna(0)
    return full.withColumns({"speech_rate": F.round(stats.rate(F.col("speeches"), F.col("held")), 6), "speech_rate_control": F.round(stats.rate(F.col("speeches_control"), F.col("held_control")), 6)})


def leading_items(frame: DataFrame, has: str, group: str, item: str, k: int = 3, missing: str = "(unlabelled)") -> DataFrame:
    """The k items behind the bearing speeches of each group, with their share of these."""
    counts = frame.filter(F.col(has)).groupBy(group, F.coalesce(item, F.lit(missing)).alias("item")).agg(F.count("*").alias("speeches"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"share": F.round(F.col("speeches") / F.sum("speeches").over(w), 6), "rank": F.row_number().over(w.orderBy(F.desc("speeches"), "item"))})
    return ranked.filter(F.col("rank") <= k)


def coverage(grid: DataFrame, minimum: int) -> DataFrame:
    """months, observed, at_minimum and the share of speeches in months at the minimum."""
    enough = F.col("speeches") >= minimum
    return grid.agg(
        F.count("*").alias("months"), F.count_if(F.col("speeches") > 0).alias("observed"), F.count_if(enough).alias("at_minimum"),
        F.round(stats.rate(F.sum(F.when(enough, F.col("speeches")).otherwise(0)), F.sum("speeches")), 6).alias("speech_share"),
    )


def peaks(long: DataFrame) -> DataFrame:
    """Per measure the period with most speeches and that with the largest rate; ties go to the first."""
    first = lambda value: F.min_by("period", F.struct(-F.coalesce(F.col(value), F.lit(-1.0)), "period"))
    return long.groupBy("kind", "name").agg(first("speeches").alias("by_count"), first("speech_rate").alias("by_rate"))


def top_rates(frame: DataFrame, by: str, has: str, minimum: int, k: int = 8) -> DataFrame:
    out = frame.groupBy(F.col(by).alias("category")).agg(F.count("*").alias("held"), F.count_if(F.col(has)).alias("speeches")).filter(F.col("held") >= minimum)
    out = out.withColumn("speech_rate", F.round(stats.rate(F.col("speeches"), F.col("held")), 6))
    return out.orderBy(F.desc("speech_rate"), "category").limit(k)


def reconcile(parts: DataFrame, whole: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, parts and whole for each total that the parts don't add up to."""
    summed = parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"p_{c}") for c in columns])
    both = whole.select(*keys, *[F.col(c).cast("long").alias(f"w_{c}") for c in columns]).join(summed, keys, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("parts"), F.col(f"w_{c}").alias("whole")) for c in columns])
    return both.select(*keys, F.explode(cells).alias("d")).select(*keys, "d.*").filter(~F.col("parts").eqNullSafe(F.col("whole")))


def require_reconciled(parts: DataFrame, whole: DataFrame, keys: list[str], columns: list[str]) -> None:
    problems = reconcile(parts, whole, keys, columns).limit(8).collect()
    if problems:
        raise ValueError(f"totals differ: {problems}")
