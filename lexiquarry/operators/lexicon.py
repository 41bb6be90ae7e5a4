"""A lexicon of terms, and counting it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions import stats
from lexiquarry.sources.files import read_object

PREFIX = {"terms": "", "registers": "register_", "sets": "set_"}


@dataclass(frozen=True)
class Term:
    name: str
    pattern: str
    literals: tuple[str, ...]
    tier: str
    register: str
    nested_under: str | None = None
    enabled: bool = True
    examples: tuple[str, ...] = ()

    def present(self, low: Column) -> Column:
        """Whether a text in lower case holds one of the literals."""
        return reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in self.literals])

    def spans(self, source: str, low: str) -> list[tuple[int, int]]:
        """(start, end) of the matches in source, searched only if low (source in lower case) holds a literal."""
        if not any(x.lower() in low for x in self.literals):
            return []
        return [m.span() for m in re.finditer(self.pattern, source, re.I)]

    def count(self, body: Column, prefilter: bool = True, flags: str = "(?iU)", low: Column | None = None) -> Column:
        """Matches in body; without one of the literals none, unless prefilter is off. low is body in lower case, if at hand."""
        n = F.regexp_count(body, F.lit(flags + self.pattern))
        n = F.when(self.present(F.lower(body) if low is None else low), n).otherwise(F.lit(0)) if prefilter else n
        return F.coalesce(n, F.lit(0)).cast("long")

    def problems(self) -> list[str]:
        """A pattern that isn't one, examples it misses or no literal covers, and no examples or literals at all."""
        found = [f"{self.name}: no {what}" for what in ("examples", "literals") if not getattr(self, what)]
        try:
            pattern = re.compile(self.pattern, re.I)
        except re.error as error:
            return [*found, f"{self.name}: {self.pattern!r} is no pattern ({error})"]
        for example in self.examples:
            if not pattern.search(example):
                found.append(f"{self.name}: example {example!r} does not match")
            if not any(x.lower() in example.lower() for x in self.literals):
                found.append(f"{self.name}: no literal covers {example!r}")
        return found


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[Term, ...]
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    version: str = "0"

    def __post_init__(self) -> None:
        names = {t.name for t in self.terms}
        problems = [f"{t.name}: unknown parent {t.nested_under}" for t in self.terms if t.nested_under and t.nested_under not in names]
        problems += [f"{s}: unknown member {m}" for s, own in self.sets.items() for m in own if m not in names]
        for t in self.terms:
            problems += t.problems()
        if len(names) != len(self.terms):
            problems.append("term names repeat")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def active(self) -> list[Term]:
        return [t for t in self.terms if t.enabled]

    @property
    def disabled(self) -> list[Term]:
        return [t for t in self.terms if not t.enabled]

    def by(self, what: str) -> dict[str, list[Term]]:
        out: dict[str, list[Term]] = {}
        for t in self.active:
            out.setdefault(getattr(t, what), []).append(t)
        return out

    def measures(self) -> list[tuple[str, str, str, str | None]]:
        """(kind, name, has column, count column or None)."""
        rows = [("terms", t.name) for t in self.active] + [("registers", r) for r in self.by("register")] + [("sets", s) for s in self.sets]
        return [(kind, name, *columns_for(kind, name)) for kind, name in rows]


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon out of a JSON object or YAML mapping: version, terms (name to the fields of Term) and sets (name to its members).

    Literals may be named prefilters; notes are passed over. Without a tier a term is
    `adjacent`, without a register `other`. Raises if anything is wrong with it.
    """
    raw = read_object(spark, path)
    lists = ("literals", "examples")
    terms = []
    for name, own in raw["terms"].items():
        given = {"tier": "adjacent", "register": "other", "literals": own.get("prefilters") or [], "examples": []} | own
        terms.append(Term(name, **{k: tuple(map(str, v or ())) if k in lists else v for k, v in given.items() if k not in ("note", "prefilters")}))
    return Lexicon(tuple(terms), {k: tuple(v) for k, v in (raw.get("sets") or {}).items()}, str(raw.get("version", "0")))


def columns_for(kind: str, name: str) -> tuple[str, str | None]:
    if kind not in PREFIX:
        raise ValueError(f"unknown kind {kind!r}")
    key = f"{PREFIX[kind]}{name}"
    return f"has_{key}", None if kind == "sets" else f"n_{key}"


def flag(speeches: DataFrame, lexicon: Lexicon, body: str = "text", prefilter: bool = True, flags: str = "(?iU)") -> DataFrame:
    """speeches with counts and flags of every active term, register and set, and the totals, from one scan."""
    low = speeches.withColumn("_low", F.lower(F.col(body)))
    counted = low.withColumns({f"n_{t.name}": t.count(F.col(body), prefilter, flags, F.col("_low")) for t in lexicon.active}).drop("_low")
    active = {t.name for t in lexicon.active}
    total = lambda names: reduce(lambda a, b: a + b, [F.col(f"n_{n}") for n in names], F.lit(0))
    new = {f"has_{n}": F.col(f"n_{n}") > 0 for n in active}
    for register, own in lexicon.by("register").items():
        n = total([t.name for t in own])
        new |= {f"n_register_{register}": n.cast("int"), f"has_register_{register}": n > 0}
    for name, members in lexicon.sets.items():
        new[f"has_set_{name}"] = total([m for m in members if m in active]) > 0
    new["n_lexicon_total"] = total(active).cast("int")
    new["n_lexicon_terms"] = reduce(lambda a, b: a + b, [(F.col(f"n_{n}") > 0).cast("int") for n in active], F.lit(0))
    return counted.withColumns(new)


def tolerant_delta(speeches: DataFrame, lexicon: Lexicon, key: str = "row_id", body: str = "text", flags: str = "(?iU)") -> DataFrame:
    """Per disabled term: speeches it finds, and those beyond the enabled terms of its tier.

    Columns: term, tier, speeches, extra, examples (the five smallest ids of the extra).
    """
    out = None
    for t in lexicon.disabled:
        same = [f"has_{x.name}" for x in lexicon.active if x.tier == t.tier]
        other = reduce(lambda a, b: a | b, [F.col(c) for c in same], F.lit(False))
        found = speeches.filter(t.count(F.col(body), flags=flags) > 0)
        ranked = found.agg(
            F.count("*").alias("speeches"), F.count_if(~other).alias("extra"),
        )
        first = found.filter(~other).select(key).orderBy(key).limit(5).agg(F.sort_array(F.collect_list(key)).alias("examples"))
        row = ranked.crossJoin(F.broadcast(first)).select(F.lit(t.name).alias("term"), F.lit(t.tier).alias("tier"), "speeches", "extra", "examples")
        out = row if out is None else out.unionByName(row)
    return out


def tolerant_finds(speeches: DataFrame, lexicon: Lexicon, key: str = "row_id", body: str = "text", flags: str = "(?iU)") -> DataFrame:
    """key, term, tier, n and extra (whether no enabled term of the tier is there) of every speech that a disabled term finds, from one scan."""
    low = speeches.withColumn("_low", F.lower(F.col(body)))
    cells = [F.lit(None).cast("struct<term:string,tier:string,n:bigint,extra:boolean>")]
    for t in lexicon.disabled:
        n = t.count(F.col(body), flags=flags, low=F.col("_low"))
        known = reduce(lambda a, b: a | b, [F.col(f"has_{x.name}") for x in lexicon.active if x.tier == t.tier], F.lit(False))
        cells.append(F.when(n > 0, F.struct(F.lit(t.name).alias("term"), F.lit(t.tier).alias("tier"), n.alias("n"), (~known).alias("extra"))))
    return low.select(key, F.explode(F.array_compact(F.array(*cells))).alias("_m")).select(key, "_m.*")


def summary(flagged: DataFrame, lexicon: Lexicon) -> DataFrame:
    """kind, name, speeches, share, occurrences (null for sets) in one pass."""
    rows = lexicon.measures()
    agg = [F.count("*").alias("_n")]
    for i, (_, _, has, n) in enumerate(rows):
        agg += [F.count_if(F.col(has)).alias(f"h{i}"), (F.sum(n) if n else F.lit(None)).cast("long").alias(f"c{i}")]
    one = flagged.agg(*agg)
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("name"), F.col(f"h{i}").alias("speeches"), F.col(f"c{i}").alias("occurrences")) for i, (k, v, _, _) in enumerate(rows)])
    out = one.select("_n", F.explode(cells).alias("m"))
    return out.select("m.kind", "m.name", "m.speeches", F.round(stats.rate(F.col("m.speeches"), F.col("_n")), 6).alias("share"), F.coalesce("m.occurrences", F.when(F.col("m.kind") != "sets", F.lit(0).cast("long"))).alias("occurrences"))


def documented_figures(flagged: DataFrame, lexicon: Lexicon, documented: dict[str, tuple[int, int]]) -> DataFrame:
    """term, speeches, occurrences, both as documented, agrees; documented names that are no active term are left out."""
    own = flagged.sparkSession.createDataFrame([(k, *v) for k, v in sorted(documented.items())], "term string, expected_speeches long, expected_occurrences long")
    found = summary(flagged, lexicon).filter("kind = 'terms'").select(F.col("name").alias("term"), "speeches", "occurrences")
    same = (F.col("speeches") == F.col("expected_speeches")) & (F.col("occurrences") == F.col("expected_occurrences"))
    return found.join(own, "term").withColumn("agrees", same)


def scan(source: str, terms: list[Term]) -> list[tuple[int, int, int, int]]:
    """(number of the term, ordinal, start, end) of every match of every term in one text."""
    low = source.lower()
    return [(i, k, start, end) for i, t in enumerate(terms) for k, (start, end) in enumerate(t.spans(source, low), 1)]


def term_columns(terms: list[Term], number: Column) -> list[Column]:
    """term, tier and register of a term's number."""
    return [F.get(F.array(*[F.lit(getattr(t, name)) for t in terms]), number).alias(alias) for alias, name in (("term", "name"), ("tier", "tier"), ("register", "register"))]


def occurrences(speeches: DataFrame, lexicon: Lexicon, keep: list[str], body: str = "text", begin: str | None = None) -> DataFrame:
    """One row per match of an active term: keep, term, tier, register, ordinal, start, end.

    With begin, a column of where the body begins, only what follows is searched; start
    and end count from the start of the whole text all the same.

    All terms are found in one scan of the text, in time that grows with the text and its
    matches, a hundred rows a batch, so that a worker's memory doesn't grow with the table; built-in expressions give matches, but their offsets only
    by summing what lies between them, once more for each match.
    """
    terms = lexicon.active

    @F.udf("array<struct<i:int,ordinal:int,start:int,end:int>>", useArrow=False)
    def found(source: str | None) -> list[tuple] | None:
        return None if source is None else scan(source, terms)

    shift = F.coalesce(F.col(begin).cast("int"), F.lit(0)) if begin else F.lit(0)
    source = F.substr(F.col(body), shift + 1) if begin else F.col(body)
    rows = speeches.select(*keep, shift.alias("_s"), F.explode(found(source)).alias("_m"))
    return rows.select(*keep, *term_columns(terms, F.col("_m.i")), "_m.ordinal", *[(F.col(f"_m.{c}") + F.col("_s")).alias(c) for c in ("start", "end")])


def audit_sample(occurrence_rows: DataFrame, size: int, seed: int, key: str = "row_id", stratum: tuple[str, ...] = ("term", "decade")) -> DataFrame:
    """At most `size` occurrences: one of each stratum first, the rest in hash order."""
    order = stats.hash_order(seed, "audit", F.concat_ws(":", F.col(key).cast("string"), "term", F.col("start").cast("string")))
    ranked = occurrence_rows.withColumn("_o", order).withColumn("_k", F.row_number().over(Window.partitionBy(*stratum).orderBy("_o", key, "start")))
    return ranked.orderBy((F.col("_k") > 1).cast("int"), "_o", key, "start").limit(size).drop("_o", "_k")


def audit_units(occurrence_rows: DataFrame, size: int, seed: int, key: str = "row_id", stratum: tuple[str, ...] = ("term", "decade")) -> DataFrame:
    """occurrence_rows (as of `occurrences`) drawn for review, with unit: at most `size` occurrences, and as many speeches of a term, each by the term's first occurrence in it."""
    each = audit_sample(occurrence_rows, size, seed, key, stratum).withColumn("unit", F.lit("occurrence"))
    whole = audit_sample(occurrence_rows.filter("ordinal = 1"), size, seed + 2, key, stratum).withColumn("unit", F.lit("speech"))
    return each.unionByName(whole)
