"""From raw speeches to attributed ones in one call, stopped by what its checks find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators import dims
from lexiquarry.operators.quality import gate

SHOWN = 9


def opened(raw: DataFrame) -> DataFrame:
    """raw (text, participation) with LF newlines, body_start, spoken_language, spoken_fuzzy and delivery_language.

    Nothing is shuffled: only markers that no exact rule resolves go to Python, which
    remembers them.
    """
    clean = raw.withColumn("text", text.newlines(F.col("text")))
    marked = clean.withColumns({"body_start": text.body_start(F.col("text")), "_marker": text.language_marker(text.address(F.col("text")))})
    exact = marked.withColumn("_exact", text.exact_language(F.col("_marker")))
    near = exact.withColumn("_near", text.fuzzy_language(F.when(F.col("_exact").isNull(), F.col("_marker"))))
    spoken = F.coalesce("_exact", F.col("_near.language"))
    out = near.withColumns({"spoken_language": spoken, "spoken_fuzzy": F.col("_exact").isNull() & F.col("_near.language").isNotNull()})
    return out.withColumn("delivery_language", text.delivery_language(F.col("spoken_language"), F.col("participation"))).drop("_marker", "_exact", "_near")


def problems(rows: DataFrame, aliases: DataFrame, entities: DataFrame, membership: DataFrame, kinds: tuple[str, ...], seats: tuple[int, int], silent: bool = False) -> list[str]:
    """What speaks against attributing rows (country_org canonical, year); the first few of each kind.

    Aliases that chain or repeat, a crosswalk that breaks its rules or lacks a speaker,
    years with other numbers of (permanent, elected) seats, and, unless silent, members
    without a speech in a year of their term.
    """

    def some(found: DataFrame, *columns: str) -> list[str]:
        return [" ".join(map(str, r)) for r in found.select(*columns).orderBy(*columns).limit(SHOWN).collect()]

    first, last = rows.agg(F.min("year"), F.max("year")).first()
    held = membership.filter(F.col("year").between(first, last)) if first is not None else membership.limit(0)
    found = [f"alias {x}" for x in some(dims.bad_aliases(aliases), "alias", "problem")]
    found += [f"entity {x}" for x in some(dims.entity_problems(entities, kinds), "country_org", "problem")]
    found += [f"no entity for {x}" for x in some(dims.unseen(rows, entities), "country_org")]
    if first is not None:
        found += [f"seats of {x}" for x in some(dims.roster(held, first, last, *seats).filter("NOT valid"), "year", "permanent", "elected")]
    if not silent:
        found += [f"no speech of {x}" for x in some(dims.silent_members(held, rows), "country_org", "year")]
    return found


def normalise(
    raw: DataFrame, aliases: DataFrame, entities: DataFrame, terms: DataFrame, kinds: tuple[str, ...], cased: tuple[str, ...] = (), seats: tuple[int, int] = (5, 10), silent: bool = False
) -> DataFrame:
    """raw (text, participation, country_org, year) opened, its labels in one case, speakers canonical, with entity and group.

    Raises if there are problems. The tables of configuration are small; rows are
    read by the checks for their speakers and years only.
    """
    out = dims.canonicalise(opened(raw), "country_org", aliases)
    membership = dims.membership_by_year(terms)
    gate(problems(dims.canonicalise(raw, "country_org", aliases).select("country_org", "year"), aliases, entities, membership, kinds, seats, silent))
    for column in cased:
        out = dims.modal_case(out, column)
    return dims.with_group(dims.attach(out, entities), membership)
