"""Text as column expressions. Offsets are code points, half-open, in whole-text coordinates."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Honorifics and offices that open a speech, and the languages and
# spellings of delivery markers.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Sir", "Dame", "Dr", "Judge", "Archbishop", "Monsignor", "Bishop", "Prince", "Princess", "King",
    "Queen", "Lord", "Lady", "Baroness", "Baron", "Nana", "Sheikha", "Sheikh", "Dato", "Major", "Lieutenant", "President",
)
OFFICES = ("President", "PRESIDENT", "Deputy Secretary-General", "Secretary-General", "Acting President", "Vice-President", "Chairman", "Chairperson")
LANGUAGES = (
    "Albanian", "Arabic", "Bengali", "Bosnian", "Chinese", "Croatian", "English", "French", "German", "Greek", "Hebrew", "Hindi",
    "Italian", "Japanese", "Macedonian", "Nepalese", "Persian", "Polish", "Portuguese", "Russian", "Serbian", "Slovak", "Spanish",
    "Turkish", "Ukrainian", "Vietnamese",
)
SPELLINGS = {"france": "French", "russia": "Russian", "china": "Chinese", "spain": "Spanish", "arabia": "Arabic", "preach": "French", "snaniah": "Spanish"}
LEAST_LIKENESS = 0.72
TOKEN = "[a-z][a-z'’-]*"
ADDRESS_WITHIN = 300


def newlines(text: Column) -> Column:
    """CRLF, then CR, become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def text_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def join_key(filename: Column) -> Column:
    """The document a speech file belongs to."""
    return F.regexp_replace(filename, r"_spch\d+\.txt$", "")


def id_parts(line_id: Column) -> Column:
    """(meeting, speech, ordinal) of a concordance line id like M_spch0007#3."""
    head, ordinal = F.element_at(F.split(line_id, "#"), 1), F.get(F.split(line_id, "#"), F.lit(1))
    return F.struct(
        F.regexp_replace(head, r"_spch\d+$", "").alias("meeting"),
        F.regexp_extract(head, r"_spch(\d+)$", 1).try_cast("int").alias("speech"),
        ordinal.try_cast("int").alias("ordinal"),
    )


def _address_pattern() -> str:
    longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: -len(w)))
    who = rf"The\s+(?:{longest(OFFICES)})|(?:{longest(TITLES)})\.?[ \t]*[^\s(:.][^(:\n]{{0,60}}?"
    return rf"^[ \t]*(?:{who})(?:[ \t]*\([^)\n]{{0,90}}\)){{0,3}}[ \t]*:"


ADDRESS = _address_pattern()


def address(text: Column) -> Column:
    """The form of address that opens a text, or ''."""
    return F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, ADDRESS_WITHIN), ADDRESS, 0)


def body_start(text: Column) -> Column:
    """Where the text goes on after its form of address and white space; 0 without one."""
    end = F.length(address(text))
    gap = F.length(F.regexp_extract(F.substr(F.coalesce(text, F.lit("")), end + 1), r"^[ \t\n]*", 0))
    return F.when(end > 0, end + gap).otherwise(F.lit(0))


def body(text: Column, start: Column) -> Column:
    return F.substr(text, start + 1)


def language_marker(opening: Column) -> Column:
    """What follows the marker word in '(spoke in ...)'; null without a marker."""
    return F.nullif(F.regexp_extract(opening, r"(?i)\(\s*(?:spoke|spoken|interpretation|interpreted)([^)]{0,90})\)", 1), F.lit(""))


def _folded(text: Column) -> Column:
    return F.lower(F.substring_index(text, ";", 1))


def exact_language(marker: Column) -> Column:
    """The language whose name or listed spelling comes first among the marker's words and joined neighbours.

    Accents are folded by the fuzzy stage only; null if nothing matches exactly.
    """
    known = {w.lower(): w for w in LANGUAGES} | SPELLINGS
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    tokens = F.filter(F.split(_folded(marker), "[^a-z]+"), lambda x: x != "")
    both = F.flatten(F.transform(tokens, lambda x, i: F.array(x, F.concat(x, F.coalesce(F.get(tokens, i + 1), F.lit(""))))))
    hits = F.filter(F.transform(both, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    return F.get(hits, F.lit(0))


#: What resolves a candidate exactly.
EXACT = SPELLINGS | {name.lower(): name for name in LANGUAGES}


@cache
def nearest_language(candidate: str) -> str | None:
    """The language whose name is most like the candidate, if it is like enough; the first listed of equals."""
    likeness = [difflib.SequenceMatcher(None, candidate, name.lower()).ratio() for name in LANGUAGES]
    most = max(likeness)
    return LANGUAGES[likeness.index(most)] if most >= LEAST_LIKENESS else None


def resolve_language(raw: str | None) -> tuple[str | None, bool]:
    """(language, was fuzzy) of a marker: an exact candidate anywhere comes before a similar one."""
    plain = unicodedata.normalize("NFKD", (raw or "").split(";")[0]).encode("ascii", "ignore").decode()
    words = re.findall("[a-z]+", plain.lower())
    candidates = list(chain.from_iterable(zip(words, map(str.__add__, words, [*words[1:], ""]))))
    exact, near = (next(filter(None, map(rule, candidates)), None) for rule in (EXACT.get, nearest_language))
    return exact or near, exact is None and near is not None


@F.pandas_udf(StructType([StructField("language", StringType()), StructField("fuzzy", BooleanType())]))
def fuzzy_language(markers: pd.Series) -> pd.DataFrame:
    """resolve_language over a column: for the distinct markers that no exact rule resolves."""
    return pd.DataFrame([resolve_language(m) for m in markers], columns=["language", "fuzzy"])


def delivery_language(spoken: Column, participation: Column) -> Column:
    return F.coalesce(spoken, F.when(participation == "In-Person", "English (inferred, in-person)").when(participation == "VTC", "Unknown (VTC)").otherwise("Unknown"))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def slice_label(year: Column, slices: tuple[tuple[int, int], ...]) -> Column:
    """'first-last' of the declared slice that holds the year, else 'outside'."""
    out = F.lit("outside")
    for first, last in slices[::-1]:
        out = F.when(year.between(first, last), f"{first}-{last}").otherwise(out)
    return out


def period(date: Column, frequency: str) -> Column:
    """Label of a date: year ('2014'), quarter ('2014Q3') or month ('2014-07')."""
    if frequency == "year":
        return F.year(date).cast("string")
    if frequency == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    if frequency == "month":
        return F.date_format(date, "yyyy-MM")
    raise ValueError(f"unknown frequency {frequency!r}")


def tokens(text: Column) -> Column:
    """Words of a text in lower case; digits part them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def highlight(text: Column, query: str, regex: bool = False, limit: int = 200) -> Column:
    """(text, hit) segments around case-insensitive matches; an unusable pattern gives one plain segment."""
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    pattern = query if regex else re.escape(query)
    try:
        if not query or re.compile(pattern).match(""):
            return whole
    except re.error:
        return whole
    pattern = f"(?i){pattern}"
    hits = F.slice(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), 1, limit)
    pieces = F.split(text, pattern, limit + 1)
    pair = lambda p, h: F.array(F.struct(p.alias("text"), F.lit(False).alias("hit")), F.struct(h.alias("text"), F.lit(True).alias("hit")))
    both = F.flatten(F.zip_with(pieces, hits, pair))
    return F.filter(both, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def label(name: Column) -> Column:
    """A term's name as readers see it."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def _tenths(x: Column) -> Column:
    """x, at least 1, with one decimal: its exact binary value rounded, half to even, as C prints it.

    format_string rounds the shortest decimal form half up, which differs where n / unit
    is written as a tie (395.95 lies below it). Ten times the 52 bits of the fraction are
    a whole number.
    """
    whole = F.floor(x)
    scaled = F.floor((x - whole) * F.lit(2.0**52)).cast("long") * 10
    rest, down = scaled.bitwiseAND(F.lit(2**52 - 1)), F.shiftright(scaled, 52)
    up = (rest > 2**51) | ((rest == 2**51) & (down % 2 == 1))
    total = whole * 10 + down + up.cast("int")
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def byte_label(n: Column) -> Column:
    """A size in B, whole kB, or MB and GB with one decimal."""
    mega = lambda unit, size: F.concat(_tenths(n / size), F.lit(f" {unit}"))
    kilo = F.concat(F.rint(n / 1e3).cast("long").cast("string"), F.lit(" kB"))
    return F.when(n >= 1e9, mega("GB", 1e9)).when(n >= 1e6, mega("MB", 1e6)).when(n >= 1e3, kilo).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def month_label(period: Column) -> Column:
    """January 1992 for 1992-01; other labels stay."""
    return F.coalesce(F.date_format(F.try_to_timestamp(period, F.lit("yyyy-MM")), "MMMM yyyy"), period)


def day_label(date: Column) -> Column:
    """2 January 1992 for 1992-01-02; what is no date stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), "d MMMM yyyy"), date)


def listed(names: Column) -> Column:
    """Names in a sentence: commas, and before the last one `and`."""
    head = F.array_join(F.slice(names, 1, F.size(names) - 1), ", ")
    return F.when(F.size(names) < 2, F.array_join(names, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def escaped(text: Column) -> Column:
    """text inside markup."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_name(parts: list[Column], extension: str) -> Column:
    """The slugs of the parts that have one, joined, or `export`; with the extension."""
    slugs = F.concat_ws("-", *[F.nullif(F.regexp_replace(slug(p.cast("string")), "^-+|-+$", ""), F.lit("")) for p in parts])
    return F.concat(F.when(slugs == "", "export").otherwise(slugs), F.lit("." + extension.removeprefix(".")))


@F.pandas_udf(StringType())
def name_fold(names: pd.Series) -> pd.Series:
    """Lower-case ASCII letters and digits with single blanks."""
    plain = names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower())
    return plain.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()


def classify(name: Column, overrides: dict[str, str], rules: list[tuple[str, str]], default: str) -> Column:
    """(kind, needs_review): an override, else the first rule whose pattern matches, else the default for review."""
    kind = F.lit(None).cast("string")
    for pattern, value in rules[::-1]:
        kind = F.when(name.rlike(pattern), value).otherwise(kind)
    for key, value in overrides.items():
        kind = F.when(name == key, value).otherwise(kind)
    return F.struct(F.coalesce(kind, F.lit(default)).alias("kind"), kind.isNull().alias("needs_review"))
