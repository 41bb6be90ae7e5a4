import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import text
from lexiquarry.operators import kwic, lexicon, quality, series
from lexiquarry.operators.lexicon import Lexicon, Term


def test_breakdowns(spark):
    """Ties by label, folding, null categories, a missing column, all by hand."""
    rows = [("1", "a", None, 10, True, 2)] * 2 + [("1", "b", "x", 5, False, 0), ("2", "c", "x", 0, True, 1), ("2", None, "y", None, None, None)]
    frame = spark.createDataFrame(rows, "p string, k string, l string, tokens int, has boolean, n int")
    with pytest.warns(UserWarning, match="no column z"):
        out = series.breakdowns(frame, F.col("p"), {"k": 2, "l": None, "z": 3}, {"m": ("has", "n"), "s": ("has", None)})
    got = {(r.column, r.measure, r.period, r.category): (r.held, r.tokens, r.speeches, r.occurrences, r.speech_rate) for r in out.collect()}
    # Of k's single categories `Unknown` comes before b and c.
    want = {("1", "a"): (2, 20, 2, 4, 1.0), ("1", "Other"): (1, 5, 0, 0, 0.0), ("2", "Other"): (1, 0, 1, 1, 1.0), ("2", "Unknown"): (1, 0, 0, None, 0.0)}
    assert {k[2:]: v for k, v in got.items() if k[:2] == ("k", "m")} == want
    assert {k[2:]: v[3] for k, v in got.items() if k[:2] == ("k", "s")} == dict.fromkeys(want)
    assert {k[2:]: v[0] for k, v in got.items() if k[0] == "l"} == {("1", "Unknown"): 2, ("1", "x"): 1, ("2", "x"): 1, ("2", "y"): 1}
    one = series.breakdowns(frame, F.col("p"), {"k": 2}, {"m": ("has", "n")})
    two = series.breakdown(frame, F.col("p"), "k", "has", "n", top=2)
    assert sorted(map(tuple, one.drop("column", "measure").collect()), key=str) == sorted(map(tuple, two.select(one.columns[2:]).collect()), key=str)


def test_breakdowns_of_nothing(spark):
    frame = spark.createDataFrame([], "p string, k string, tokens int, has boolean, n int")
    assert series.breakdowns(frame, F.col("p"), {"k": 2}, {"m": ("has", "n")}).collect() == []
    with pytest.warns(UserWarning):
        assert series.breakdowns(frame, F.col("p"), {"z": 2}, {"m": ("has", "n")}).collect() == []


def test_labels(spark):
    sizes = spark.createDataFrame([(0,), (999,), (1_500,), (2_340_000,), (7_000_000_000,), (None,)], "n long")
    assert [r[0] for r in sizes.select(text.byte_label(F.col("n"))).collect()] == ["0 B", "999 B", "2 kB", "2.3 MB", "7.0 GB", None]
    one = spark.range(1)
    make = lambda c: one.select(c).first()[0]
    assert make(text.month_label(F.lit("1999-03"))) == "March 1999" and make(text.month_label(F.lit("all"))) == "all"
    assert make(text.day_label(F.lit("1999-03-09"))) == "9 March 1999" and make(text.day_label(F.lit("soon"))) == "soon"
    assert [make(text.listed(F.array(*map(F.lit, names)))) for names in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]
    assert make(text.escaped(F.lit("""<a b='"&'>"""))) == "&lt;a b=&#39;&quot;&amp;&#39;&gt;"
    assert make(text.file_name([F.lit(" A, b! "), F.lit(None), F.lit("..")], "csv")) == "a-b.csv" and make(text.file_name([F.lit("?")], ".svg")) == "export.svg"
    assert make(text.label(F.lit("of_the"))) == "of the"


def test_load_gates(spark):
    speeches = lambda rows: spark.createDataFrame(rows, "row_id long, country_org string, year int")
    crosswalk = spark.createDataFrame([("a",), ("b",), ("b",)], "country_org string")
    found = quality.load_problems(speeches([(0, "a", 1999), (2, "c", 2005), (2, None, None)]), crosswalk, [(1990, 2000), (1999, 2004)], 4)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("rows", None, -1), ("repeated row_id", None, 1), ("missing country_org", None, 1), ("missing year", None, 1), ("not in crosswalk", "c", 1), ("twice in crosswalk", "b", 2),
        ("in several periods", "1999", 1), ("in no period", "2005", 1), ("keys not 0 to n - 1", None, 3)], key=str)
    assert quality.load_problems(speeches([(0, "a", 1999), (1, "a", 2001)]), crosswalk.distinct(), [(1990, 2000), (2001, 2004)], 2).collect() == []
    assert quality.load_problems(speeches([]), crosswalk.distinct(), [(1990, 2000)], None).collect() == []


LEXICON = Lexicon((Term("war", "war", ("war",), "t", "r", examples=("war",)), Term("wart", "w ?art", ("wart", "w art"), "t", "r", enabled=False, examples=("w art",))))


def test_finds_and_units(spark):
    rows = [(0, "war war", "x"), (1, "a w art", "x"), (2, "wart", "y"), (3, None, "y"), (4, "WAR\n\tand  war", "y")]
    frame = spark.createDataFrame(rows, "row_id long, text string, decade string")
    finds = lexicon.tolerant_finds(lexicon.flag(frame, LEXICON), LEXICON)
    assert sorted(map(tuple, finds.collect())) == [(1, "wart", "t", 1, True), (2, "wart", "t", 1, False)]
    assert lexicon.tolerant_finds(lexicon.flag(frame, Lexicon(LEXICON.terms[:1])), Lexicon(LEXICON.terms[:1])).collect() == []
    found = lexicon.occurrences(frame, LEXICON, ["row_id", "decade"])
    drawn = lexicon.audit_units(found, 3, 1).collect()
    each, whole = ([r for r in drawn if r.unit == u] for u in ("occurrence", "speech"))
    assert len(each) == 3 and {r.decade for r in each} == {"x", "y"}
    assert sorted((r.row_id, r.ordinal) for r in whole) == [(0, 1), (2, 1), (4, 1)]
    sheet = kwic.review_sheet(lexicon.audit_units(found, 9, 1).filter("unit = 'occurrence'"), frame, width=6).collect()
    assert len(sheet) == 5 and [(r.left, r.keyword, r.right, r.verdict) for r in sheet if r.row_id == 4 and r.ordinal == 1] == [("", "WAR", "and", "")]


def test_body_offsets(spark):
    frame = spark.createDataFrame([(0, "war: war", 4), (1, "war", None), (2, "war", 9)], "row_id long, text string, at int")
    found = lexicon.occurrences(frame, LEXICON, ["row_id"], begin="at")
    assert sorted((r.row_id, r.ordinal, r.start, r.end) for r in found.collect()) == [(0, 1, 5, 8), (1, 1, 0, 3)]
