import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import lexicon
from lexiquarry.sources import files, sinks
from lexiquarry.streaming import events


def joined(lines, tabs):
    """Records by the rule, one line after another; None for an error."""
    out, held, parts = [], "", 0
    for line in lines:
        held, parts = (f"{held} {line}" if held else line), parts + 1
        if held.count("\t") > tabs:
            return None
        if held.count("\t") == tabs:
            out.append((held, parts > 1))
            held, parts = "", 0
    return None if held.strip() else out


@pytest.mark.parametrize("seed", range(4))
def test_repair_over_splits(spark, tmp_path, seed):
    """Files cut into many splits, records of several lines, empty lines and lines without tabs."""
    rng, want = random.Random(seed), []
    for name in "ab":
        lines = ["id\tname\tnote"]
        for k in range(300):
            record = f"{k}\t{rng.choice(['', 'x y', 'NA'])}\t{'word ' * rng.randint(0, 9)}"
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randint(0, len(record))
                record = record[:at] + rng.choice(["\n", "\n\n", "\r\n"]) + record[at:]
            lines += record.replace("\r", "").split("\n")
        lines.append("last\tx\ty")  # what is left of the one before joins it
        records = joined(lines, 2)
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
        want += [(*[None if f in ("", "NA") else f for f in value.split("\t")], more) for value, more in records[1:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        frame = files.read_repaired_tsv(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ["a\tb\n1\t2\t3\n", "a\tb\n1\t2\nrest\n", "a\tb\n1\n"])
def test_broken_records(spark, tmp_path, text):
    (tmp_path / "x.tsv").write_text(text)
    with pytest.raises(Exception, match="too many fields|incomplete"):
        files.read_repaired_tsv(spark, str(tmp_path / "x.tsv")).collect()


def test_headers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "b.tsv").write_text("a\tc\n1\t2\n")
    with pytest.raises(Exception, match="another header"):
        files.read_repaired_tsv(spark, str(tmp_path)).collect()
    (tmp_path / "one.tsv").write_text("a\nx\n\ny\n")
    assert sorted(str(r.a) for r in files.read_repaired_tsv(spark, str(tmp_path / "one.tsv")).collect()) == ["None", "x", "y"]


def test_tsv_and_casts(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\tyear\n1\t19\n2\tNA\nthree\nmore\t7\n")
    rows = files.typed(files.read_repaired_tsv(spark, str(tmp_path / "x.tsv")), {"year": "int"}).collect()
    assert [(r.id, r.year, r._repaired) for r in rows] == [("1", 19, False), ("2", None, False), ("three more", 7, True)]


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("d/one.txt")
        info.size = 4
        tar.addfile(info, io.BytesIO("éé".encode()))
    assert [tuple(r) for r in files.read_tar_texts(spark, str(tmp_path / "a.tar")).collect()] == [("one.txt", "éé")]


def tarred(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_tar_by_ranges(spark, tmp_path, mode):
    """Several archives over many tasks: empty and long members, long names, an archive inside, other files, none at all."""
    rng, want = random.Random(3), []
    for a in "ab":
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w") as tar:
            tar.addfile(tarfile.TarInfo("hidden.txt"), io.BytesIO())
        members = [(f"{a}/{'n' * rng.choice([1, 150])}{k}.txt", ("é" * rng.choice([0, 1, 511, 70_000])).encode()) for k in range(40)]
        want += [(name.rpartition("/")[2], raw.decode()) for name, raw in members]
        tarred(tmp_path / f"{a}.tar", [*members, (f"{a}/inner.tar", inner.getvalue()), ("notes.md", b"x")], mode)
    tarred(tmp_path / "empty.tar", [], mode)
    frame = files.read_tar_texts(spark, str(tmp_path), split_bytes=100_000)
    assert sorted(map(tuple, frame.collect())) == sorted(want)
    if mode == "w":
        assert frame.rdd.getNumPartitions() > 20
        assert sum(n > 0 for n in frame.rdd.glom().map(len).collect()) > 10
        assert files.tar_members(spark, str(tmp_path)).count() == len(want)


def test_tar_faults(spark, tmp_path):
    tarred(tmp_path / "latin.tar", [("x.txt", "é".encode("latin-1"))])
    with pytest.raises(Exception, match="x.txt"):
        files.read_tar_texts(spark, str(tmp_path / "latin.tar")).collect()
    tarred(tmp_path / "whole.tar", [("x.txt", b"x" * 5_000), ("y.txt", b"y" * 5_000)])
    (tmp_path / "short.tar").write_bytes((tmp_path / "whole.tar").read_bytes()[:7_000])
    with pytest.raises(Exception, match="breaks off|unexpected end"):
        files.read_tar_texts(spark, str(tmp_path / "short.tar")).collect()


def test_tar_written(spark, tmp_path):
    rows = [("a.txt", "é"), ("b.txt", ""), ("c.txt", None), (None, "x"), ("a.txt", "again")]
    archives = sinks.write_tar(spark.createDataFrame(rows, "filename string, text string"), str(tmp_path / "out"))
    assert len(set(archives)) == len(archives)
    assert sorted(map(tuple, files.read_tar_texts(spark, archives).collect())) == [("a.txt", "again"), ("a.txt", "é"), ("b.txt", "")]


def test_model_registry(spark, tmp_path):
    good = {"version": 1, "default": "m", "models": {"m": {"repo": "a/b", "dimensions": 8, "max_tokens": "512", "batch_size": 4, "note": " n "}}}
    (tmp_path / "m.json").write_text(json.dumps(good))
    found = files.read_models(spark, str(tmp_path / "m.json"))
    assert found.pick() == files.ModelSpec("m", "a/b", 8, 512, 4, note="n") and found.version == 1
    with pytest.raises(ValueError, match="unknown model x"):
        found.pick("x")
    bad = good | {"default": "x", "models": {"m": {"repo": "a/b", "dimensions": 0}, "n": None}}
    (tmp_path / "m.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="m: no max_tokens.*m: dimensions is no positive.*n: no repo.*default x"):
        files.read_models(spark, str(tmp_path / "m.json"))


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    terms = "terms:\n  peace:\n    pattern: 'peace\\w*'\n    prefilters: [peace]\n    examples: [peaceful]\n    note: kept out\nsets: {all: [peace]}\nversion: 2\n"
    (tmp_path / "l.yml").write_text(terms)
    found = lexicon.read_lexicon(spark, str(tmp_path / "l.yml"))
    assert found.terms[0].literals == ("peace",) and found.version == "2" and found.sets == {"all": ("peace",)}
    (tmp_path / "l.yml").write_text("- x\n")
    with pytest.raises(ValueError, match="no object"):
        lexicon.read_lexicon(spark, str(tmp_path / "l.yml"))


def test_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# note\nname,n\nNA,1\n,x\n")
    assert [tuple(r) for r in files.read_config(spark, str(tmp_path / "c.csv"), "name string, n int").collect()] == [("NA", 1), (None, None)]
    with pytest.raises(ValueError):
        files.read_config(spark, str(tmp_path / "c.csv"), "other string")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a", "b"])], "a int, b double, c array<string>")
    sinks.write_artefact(df, str(tmp_path / "x.json"), {"v": 1})
    assert json.loads((tmp_path / "x.json").read_text()) == {"meta": {"v": 1}, "rows": [{"a": 1, "b": None, "c": ["a", "b"]}]}
    assert sinks.csv_with_provenance(df, ["n"]) == "# n\r\na,b,c\r\n1,,a|b\r\n"
    with pytest.raises(RuntimeError):
        with sinks.staged(str(tmp_path / "t")):
            raise RuntimeError
    assert not (tmp_path / "t").exists()
    with sinks.staged(str(tmp_path / "t")) as stage:
        open(f"{stage}/f", "w").close()
    assert (tmp_path / "t" / "f").exists()


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    run = events.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.event_type, r.n, r.total) for r in spark.table("counts").collect()] == [("a", 2, 3.0)]
