import json

import pytest

from lexiquarry.operators import lexicon, normalise, quality, topics, vectors

RAW = "text string, participation string, country_org string, year int, agenda string"
ENTITY = "country_org string, entity_type string, iso3 string, un_regional_group string, lat double, lon double"
SEAT = "country_org string, start_year int, end_year int, seat string"
KINDS = ("state", "un")


def tables(spark, rows=None):
    rows = rows or [("Mr. Levitte (France) (spoke in French):\r\n I thank you.", None, "Frankreich", 2001, "Peace"), ("Thank you.", "VTC", "United Nations", 2001, "peace"), (None, "In-Person", "France", 2002, "Peace")]
    raw = spark.createDataFrame(rows, RAW)
    aliases = spark.createDataFrame([("Frankreich", "France")], "alias string, canonical string")
    entities = spark.createDataFrame([("France", "state", "FRA", "WEOG", 46.0, 2.0), ("United Nations", "un", None, None, None, None)], ENTITY)
    seats = spark.createDataFrame([("France", 2001, 2002, "permanent")], SEAT)
    return raw, aliases, entities, seats


def test_normalise(spark):
    out = normalise.normalise(*tables(spark), KINDS, cased=("agenda",), seats=(1, 0)).orderBy("year", "country_org").collect()
    france, un, later = out
    assert france.text[france.body_start :] == "I thank you." and france.spoken_language == france.delivery_language == "French"
    assert (france.speaker_group, un.speaker_group, later.speaker_group) == ("P5", "UN", "P5")
    assert un.agenda == "Peace" and un.delivery_language == "Unknown (VTC)" and un.body_start == 0
    assert later.text is None and later.body_start == 0 and later.spoken_language is None


def test_normalise_stops(spark):
    raw, aliases, entities, seats = tables(spark)
    with pytest.raises(ValueError, match="no entity for United Nations"):
        normalise.normalise(raw, aliases, entities.filter("entity_type = 'state'"), seats, KINDS, seats=(1, 0))
    with pytest.raises(ValueError, match="seats of 2001 1 0"):
        normalise.normalise(raw, aliases, entities, seats, KINDS)
    with pytest.raises(ValueError, match="alias France self"):
        normalise.normalise(raw, spark.createDataFrame([("France", "France"), ("Frankreich", "France")], aliases.schema), entities, seats, KINDS, seats=(1, 0))
    silent = spark.createDataFrame([("France", 2001, 2002, "permanent"), ("Peru", 2002, 2002, "elected")], SEAT)
    with pytest.raises(ValueError, match="no speech of Peru 2002"):
        normalise.normalise(raw, aliases, entities, silent, KINDS, seats=(1, 0))
    assert normalise.normalise(raw.limit(0), aliases, entities, seats, KINDS).count() == 0


def test_lexicon_file(spark, tmp_path):
    def read(**terms):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"version": 3, "terms": terms, "sets": {"all": list(terms)}}, indent=1))
        return lexicon.read_lexicon(spark, str(path))

    good = {"pattern": "genocid[a-z]*", "literals": ["Genocid"], "examples": ["genocide"]}
    lex = read(genocide=good, crime={"pattern": "crimes?", "literals": ["crime"], "examples": ["crimes"], "tier": "core", "nested_under": "genocide"})
    assert lex.version == "3" and [t.tier for t in lex.terms] == ["adjacent", "core"] and lex.sets == {"all": ("genocide", "crime")}
    row = lexicon.flag(spark.createDataFrame([("A Genocide and crimes",), (None,)], "text string"), lex).collect()
    assert [r.n_genocide for r in row] == [1, 0] and [r.has_set_all for r in row] == [True, False]
    for wrong, message in (({"examples": []}, "no examples"), ({"literals": []}, "no literals"), ({"pattern": "("}, "no pattern"), ({"examples": ["murder"]}, "does not match"), ({"literals": ["x"]}, "no literal covers"), ({"nested_under": "y"}, "unknown parent")):
        with pytest.raises(ValueError, match=message):
            read(genocide=good | wrong)


def test_events(spark):
    schema = "date string, label string, kind string, source string, source_url string"
    rows = [("1994-04-07", "a", "war", "s", "https://a"), ("1993-02-30", "b", "war", "s", "https://b"), ("1993-02-22", "c", "peace", "s", "http://c"), (None, "d", None, None, None)]
    events = spark.createDataFrame(rows, schema)
    found = quality.event_problems(events, ("war",)).orderBy("label", "problem").collect()
    assert [tuple(r) for r in found] == [("b", "date"), ("c", "kind"), ("c", "source"), ("d", "date"), ("d", "kind"), ("d", "source")]
    assert [r.year for r in quality.checked_events(events.limit(1), ("war",)).collect()] == [1994]
    with pytest.raises(ValueError, match="b: date"):
        quality.checked_events(events, ("war",))
    with pytest.raises(ValueError, match="no column kind"):
        quality.checked_events(events.drop("kind"), ("war",))


def test_abstention(spark):
    shares = spark.createDataFrame([(x / 10,) for x in range(1, 11)], "share double")
    nulls = spark.createDataFrame([(0.55,)], "share double")
    curve = topics.abstention_curve(shares, nulls, 4, (0.1, 0.3, 0.9)).orderBy("min_weight").collect()
    assert [tuple(r) for r in curve] == [(0.3, 0.2, False), (0.55, 0.5, True), (0.9, 0.8, False)]
    assert topics.spread(shares).first()["median"] == 0.55


def test_vectors_for_a_sample(spark):
    held = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    assert vectors.for_sample(held.filter("id = 2").select("id"), held, "id").first().v == [2.0]
    with pytest.raises(ValueError, match=r"no vector for \[3\]"):
        vectors.for_sample(spark.createDataFrame([(3,), (1,)], "id int"), held, "id")
