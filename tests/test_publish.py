"""Releases behind a gate, and stores of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import vectors
from lexiquarry.sources import publish, sinks


def test_failing_gate_leaves_the_old_release(spark, tmp_path):
    root = str(tmp_path)
    first = {"series": spark.createDataFrame([(1, "a", [1.5])], "n int, name string, rates array<double>"), "terms": spark.range(3)}
    with pytest.raises(ValueError, match="no contract"):
        publish.publish(spark, root, first)
    with pytest.raises(ValueError, match="index is absent"):
        publish.declare(spark, root, first, ["series", "index"])
    publish.declare(spark, root, first, ["series", "terms"])
    assert publish.published(spark, root) == {}
    old = publish.publish(spark, root, first)
    paths = publish.published(spark, root)
    assert set(paths) == {"series", "terms"} and all(old in p for p in paths.values())
    for broken in (first["series"].drop("name"), first["series"].withColumn("n", F.lit("x")), first["series"].withColumn("rates", F.array(F.lit("x")))):
        with pytest.raises(ValueError, match="series"):
            publish.publish(spark, root, {"series": broken, "terms": first["terms"]})
    # A table that fails while it is written: nothing points at what is there of it.
    with pytest.raises(Exception, match="halfway"):
        publish.publish(spark, root, {"series": first["series"].withColumn("name", F.raise_error(F.lit("halfway")).cast("string"))})
    assert publish.published(spark, root) == paths and spark.read.parquet(paths["series"]).count() == 1
    more = {"series": first["series"].union(spark.createDataFrame([(2, None, None)], first["series"].schema)).withColumn("extra", F.lit(1))}
    new = publish.publish(spark, root, more)
    now = publish.published(spark, root)
    assert new != old and set(now) == {"series"} and spark.read.parquet(now["series"]).count() == 2 and spark.read.parquet(paths["series"]).count() == 1
    found = {(r.n, r.change) for r in publish.changes(spark, paths["series"], now["series"], ["n"]).collect()}
    assert found == {(1, "changed"), (2, "added")}
    assert {(r.n, r.change) for r in publish.changes(spark, now["series"], paths["series"], ["n"]).collect()} == {(1, "changed"), (2, "removed")}


def test_vector_store(spark, tmp_path):
    path, rng = str(tmp_path / "store"), np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(50)] + [(50, None), (51, [])]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    vectors.write_store(frame, path, "id", "v")
    back = {r.id: r.v for r in vectors.read_store(spark, path, "v").collect()}
    for i, v in rows:
        assert back[i] == v if not v else back[i] == np.float16(v).astype(np.float32).tolist()
    large = spark.createDataFrame([(1, [70000.0, 1.0]), (2, [300.26, 0.0])], "id long, v array<float>")
    for one in (1, 2):
        with pytest.raises(Exception, match="would lose"):
            vectors.write_store(large.filter(F.col("id") == one), path, "id", "v")
    assert vectors.read_store(spark, path).count() == 52
    vectors.write_store(large, path, "id", "v", "float32")
    assert {r.id: [round(x, 3) for x in r.embedding] for r in vectors.read_store(spark, path).collect()} == {1: [70000.0, 1.0], 2: [300.26, 0.0]}
    with pytest.raises(ValueError):
        vectors.packed("v", "int8")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours(spark, metric, monkeypatch):
    """Blocks, ties and copies against all pairs."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, size=(130, 3)).astype(float)
    v[~v.any(axis=1)] = 1.0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in vectors.neighbours(frame.filter("id % 3 = 0"), frame, "id", "v", 6, metric).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.neighbour, r.score)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 130, 3):
        far = np.round(-(u @ u[q]) if metric == "cosine" else np.linalg.norm(v - v[q], axis=1), 9) + 0.0
        want = [int(i) for i in np.lexsort((np.arange(130), far)) if i != q][:6]
        assert [got[q][k][0] for k in range(1, 7)] == want


def test_groups_in_order(spark, tmp_path):
    frame = spark.createDataFrame([(i % 3, 100 - i) for i in range(60)], "g int, n int").repartition(5)
    sinks.write_per_group(frame, str(tmp_path / "g"), "g", ["n"])
    lines = [r.n for r in spark.read.schema("n int").json(str(tmp_path / "g" / "g=1")).collect()]
    assert sorted(lines) == sorted(100 - i for i in range(60) if i % 3 == 1)
