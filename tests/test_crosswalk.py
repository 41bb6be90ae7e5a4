"""Proposals with their sources, and attribution that doesn't guess."""

import json

import pytest

from lexiquarry.operators import crosswalk


def test_reference(spark, tmp_path):
    (tmp_path / "iso.csv").write_text('name,alpha-2,alpha-3,region\nNamibia,NA,NAM,Africa\n"Korea, North",KP,PRK,Asia\nNowhere,XX,XXX,\n', encoding="utf-8")
    features = [{"type": "Feature", "properties": {"ISO": "NA"}, "geometry": {"type": "Point", "coordinates": [17.1, -22.5]}}, {"properties": {"ISO": "KP"}, "geometry": None}]
    (tmp_path / "at.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r.iso3: r for r in crosswalk.read_reference(spark, str(tmp_path / "iso.csv"), str(tmp_path / "at.geojson")).collect()}
    assert (rows["NAM"].iso2, rows["NAM"].lat, rows["NAM"].lon) == ("NA", -22.5, 17.1)
    assert rows["PRK"].name == "Korea, North" and rows["PRK"].lat is None and rows["XXX"].region is None


def test_proposals(spark):
    reference = spark.createDataFrame([("Côte & Coast", "CCO", "Africa", 1.23456, None), ("Sea", "SEA", None, None, None), ("Isle", "ISL", "Europe", 0.0, 0.0)], "name string, iso3 string, region string, lat double, lon double")
    speakers = spark.createDataFrame([("COTE and COAST", 5), ("The Isle", 7), ("Sea", 1), ("By Hand", 2), ("Named Body", 9), ("A world bank", 4), ("Somebody", 3), ("Anybody", 30), (None, 1)], "country_org string, speeches long")
    tables = dict(
        aliases=spark.createDataFrame([("The Isle", "isle"), ("Unused", "Sea")], "alias string, name string"),
        by_hand=spark.createDataFrame([("By Hand", None, "", 9.0, 8.0)], "country_org string, iso3 string, un_regional_group string, lat double, lon double"),
        groups=spark.createDataFrame([("Africa", "African"), ("Europe", "Western")], "region string, group string"),
        exceptions=spark.createDataFrame([("ISL", "")], "iso3 string, group string"),
    )
    out = crosswalk.review_order(crosswalk.propose(speakers, reference, overrides={"Named Body": "ngo"}, rules=[(r"\bworld bank\b", "igo"), ("world", "un")], **tables)).orderBy("place").collect()
    assert [r.country_org for r in out] == ["Anybody", "Somebody", None, "Named Body", "The Isle", "COTE and COAST", "A world bank", "By Hand", "Sea"]
    by = {r.country_org: r for r in out}
    assert {k: r.source for k, r in by.items()} == {"Anybody": "default", "Somebody": "default", None: "default", "Named Body": "override", "The Isle": "alias", "COTE and COAST": "reference", "A world bank": "rule", "By Hand": "hand", "Sea": "reference"}
    assert (by["COTE and COAST"].lat, by["COTE and COAST"].un_regional_group, by["COTE and COAST"].note) == (1.2346, "African", None)
    assert (by["The Isle"].un_regional_group, by["The Isle"].note, by["Sea"].un_regional_group) == ("", "reference name: isle", "other")
    assert (by["By Hand"].entity_type, by["By Hand"].lat, by["A world bank"].entity_type, by["A world bank"].iso3) == ("state", 9.0, "igo", None)
    assert [r.country_org for r in out if r.needs_review] == ["Anybody", "Somebody", None]
    twice = reference.union(spark.createDataFrame([("cote and coast", "X", None, None, None)], reference.schema))
    with pytest.raises(ValueError, match="cote and coast"):
        crosswalk.propose(speakers, twice, overrides={}, rules=[], **tables)


def test_attribution(spark):
    published = spark.createDataFrame([("a", 1, list("pqrst")), ("b", 1, list("tsrqu")), ("a", 2, list("vwxyz")), ("b", 2, list("zyxwv")), ("b", 3, list("klmno"))], "model string, topic int, words array<string>")
    items = [("i1", 1, list("sqtprX"), "X"), ("i2", 1, list("uqrstX"), "X"), ("i3", 2, list("vwxyzX"), "X"), ("i4", 3, list("pqrstX"), "X"), ("i5", 3, ["k", "", "l", "m", "X", "m"], "X"), ("i6", 9, list("abcdeX"), "X")]
    frame = spark.createDataFrame(items, "item string, topic int, words array<string>, intruder string")
    out = {r.item: (r.model, r.matches) for r in crosswalk.attributed(frame, published).collect()}
    assert out == {"i1": ("a", 1), "i2": ("b", 1), "i3": (None, 2), "i4": (None, 0), "i5": ("b", 1), "i6": (None, 0)}
    with pytest.raises(ValueError, match="i3: 2 models.*i4: 0 models"):
        crosswalk.checked_attribution(frame, published)
    assert crosswalk.checked_attribution(frame.filter("item < 'i3'"), published).count() == 2
