"""Sources: record-repaired TSV, tar archives, configuration tables, and their checks."""

from __future__ import annotations

import json
import re
import tarfile
from collections.abc import Iterator
from dataclasses import MISSING, dataclass, field, fields
from itertools import groupby, islice
from typing import Any, BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

try:
    import yaml
except ImportError:  # YAML files can't be read then, all else can
    yaml = None


def repaired_records(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """file, record (number in its file), value and joined: the records of `columns` tab-separated fields that lines make up.

    Lines are joined by a blank until they have enough tabs; empty ones before the first
    word of a record vanish. A record with too many tabs, or one that the end of its file
    cuts off, raises when it is read.

    Files are split like others. A line's record follows from the tabs before it: those of
    earlier splits of the file, one number a split, and a running sum inside its own. Only
    lines that aren't whole records, and the first of each split, are grouped.
    """
    n = columns - 1
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("tabs", tabs.cast("long"))
    split, inside = Window.partitionBy("file", "block"), ["file", "block"]
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.groupBy(*inside).agg(F.sum("tabs").alias("_t")).select(*inside, F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_base"))
    own = F.sum("tabs").over(split.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tabs")
    placed = lines.withColumn("_own", own).join(bases, inside).withColumn("_before", F.col("_base") + F.col("_own"))
    # Without tabs to count (one column) a line is a record.
    record, taken = (F.expr(f"_before div {n}"), F.pmod("_before", F.lit(n))) if n else (F.col("at"), F.lit(0))
    placed = placed.select("file", "block", "at", "value", "tabs", record.alias("record"), taken.alias("_taken"))
    placed = placed.withColumn("_last", F.lag("record").over(split.orderBy("at")))
    whole = (F.col("tabs") == n) & (F.col("_taken") == 0) & F.coalesce(F.col("_last") != F.col("record"), F.lit(False)) | F.lit(n == 0)
    over = F.col("_taken") + F.col("tabs") > n
    checked = F.when(over, F.raise_error(F.concat(F.lit("too many fields in a record: "), "value"))).otherwise(F.col("value"))
    single = placed.filter(whole).select("file", "record", "value", F.lit(False).alias("joined"))
    parts = placed.filter(~whole).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", checked.alias("value")))).alias("_l"), F.sum("tabs").alias("_t"))
    first = F.filter(F.transform("_l", lambda x, i: F.when(x["value"] != "", i + 1)), lambda i: i.isNotNull())
    text = F.array_join(F.transform(F.slice("_l", F.coalesce(F.get(first, F.lit(0)), F.lit(1)), F.size("_l")), lambda x: x["value"]), " ")
    parts = parts.select("file", "record", text.alias("value"), (F.size("_l") > 1).alias("joined"), "_t").filter((F.col("_t") > 0) | (F.trim("value") != ""))
    whole_text = F.when(F.col("_t") == n, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("the last record is incomplete: "), "value")))
    return single.union(parts.select("file", "record", whole_text.alias("value"), "joined"))


def read_repaired_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated files with a header as strings; blank and NA are null; `_repaired` marks joined records.

    A header that isn't that of the other files raises.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head[0].rstrip("\r").split("\t")
    rows = repaired_records(spark, path, len(names))
    top = F.min("record").over(Window.partitionBy("file")) if len(names) == 1 else F.lit(0)
    rows = rows.withColumn("_top", top == F.col("record"))
    wrong = F.col("_top") & (F.col("value") != "\t".join(names))
    below = F.when(wrong, F.raise_error(F.concat(F.lit("another header: "), "value")).cast("boolean")).otherwise(~F.col("_top"))
    rows = rows.filter(below).select(F.split("value", "\t", -1).alias("_f"), "joined")
    field = lambda i: F.get("_f", F.lit(i))
    return rows.select(*[F.when(~field(i).isin("", "NA"), field(i)).alias(name) for i, name in enumerate(names)], F.col("joined").alias("_repaired"))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with columns cast; values that don't fit become null."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def opened(address: str) -> BinaryIO:
    """A file to read at any offset, on the file system that its address names."""
    if re.match(r"file:|/", address):
        return open(re.sub("^file:/*", "/", address), "rb")
    system, inside = pafs.FileSystem.from_uri(address)
    return system.open_input_file(inside)


def _members(tar: tarfile.TarFile, suffix: str) -> Iterator[tarfile.TarInfo]:
    while (member := tar.next()) is not None:
        tar.members.clear()  # the list would grow with the archive
        if member.isreg() and member.name.endswith(suffix):
            if member.issparse():
                raise ValueError(f"{member.name} is sparse")
            yield member


def tar_members(spark: SparkSession, path: str | list[str], suffix: str = ".txt") -> DataFrame:
    """archive, name, offset and size of the files in tar archives, from their headers alone.

    A compressed archive can't be entered in the middle: it is one row without a name,
    at offset -1. One that breaks off raises.
    """

    def index(archive: str) -> Iterator[tuple]:
        with opened(archive) as file:
            try:
                tar = tarfile.open(fileobj=file, mode="r:")
            except tarfile.ReadError:
                yield archive, None, -1, 0
                return
            with tar:
                for member in _members(tar, suffix):
                    yield archive, member.name, member.offset_data, member.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (row for batch in batches for archive in batch["path"] for row in index(archive))
        while rows := list(islice(found, 10_000)):
            yield pd.DataFrame(rows, columns=["archive", "name", "offset", "size"])

    archives = spark.read.format("binaryFile").load(path).select("path")
    return archives.mapInPandas(run, "archive string, name string, offset long, size long")


def read_tar_texts(spark: SparkSession, path: str | list[str], suffix: str = ".txt", split_bytes: int = 64 << 20) -> DataFrame:
    """filename (without its folder) and text (strict UTF-8) of the files in tar archives.

    The headers are read first, one task an archive; its members are then dealt by
    ranges of split_bytes and read from their offsets, so that a large archive is read by many
    tasks and a task holds one member and about 1 MB of texts. Members keep no order.
    Compressed archives are streamed, one task each.
    """

    def decoded(name: str, raw: bytes, size: int) -> tuple[str, str]:
        if len(raw) < size:
            raise ValueError(f"{name} breaks off")
        try:
            return name.rpartition("/")[2], raw.decode("utf-8")
        except UnicodeDecodeError as error:
            raise ValueError(f"{name}: {error}") from error

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str]]:
        members = (m for batch in batches for m in batch.itertuples(index=False))
        for archive, own in groupby(members, key=lambda m: m.archive):
            with opened(archive) as file:
                for m in own:
                    if m.offset < 0:
                        with tarfile.open(fileobj=file, mode="r|*") as tar:
                            for member in _members(tar, suffix):
                                yield decoded(member.name, tar.extractfile(member).read(), member.size)
                    else:
                        file.seek(m.offset)
                        yield decoded(m.name, file.read(m.size), m.size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in texts(batches):
            rows.append(row)
            size += len(row[1])
            if size > 1 << 20 or len(rows) == 1_000:
                yield pd.DataFrame(rows, columns=["filename", "text"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["filename", "text"])

    # The number is given, as adaptive execution would join partitions of rows so small.
    parts = spark.read.format("binaryFile").load(path).agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0]
    dealt = tar_members(spark, path, suffix).repartition(max(parts or 1, 1), "archive", F.expr(f"offset div {split_bytes}"))
    return dealt.sortWithinPartitions("archive", "offset").mapInPandas(run, "filename string, text string")


def read_object(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON object, or a YAML mapping out of a file named .yml or .yaml, if PyYAML is there."""
    raw = spark.read.text(path, wholetext=True).first()
    if not path.endswith((".yml", ".yaml")):
        found = json.loads(raw[0]) if raw else None
    elif yaml is None:
        raise ValueError(f"{path}: reading YAML needs PyYAML")
    else:
        found = yaml.safe_load(raw[0]) if raw else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


@dataclass(frozen=True)
class ModelSpec:
    key: str
    repo: str
    dimensions: int
    max_tokens: int
    batch_size: int
    revision: str = "main"
    torch_dtype: str = "float32"
    licence: str = "unknown"
    note: str = ""
    tokenizer_kwargs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ModelRegistry:
    version: int
    default: str
    models: dict[str, ModelSpec]

    def pick(self, key: str | None = None) -> ModelSpec:
        """The model named, or the default one."""
        if (key or self.default) not in self.models:
            raise ValueError(f"unknown model {key}; there are {', '.join(sorted(self.models))}")
        return self.models[key or self.default]


def read_models(spark: SparkSession, path: str) -> ModelRegistry:
    """The registry of embedding models: version, default and models, each by the fields of ModelSpec. Raises with all that is wrong."""
    raw = read_object(spark, path)
    problems = [f"no {k}" for k in ("version", "default", "models") if k not in raw]
    given = raw.get("models") if isinstance(raw.get("models"), dict) else {}
    if not given:
        problems.append("models is no mapping or empty")
    shape = {f.name: f for f in fields(ModelSpec) if f.name != "key"}
    specs = {}
    for key, own in given.items():
        own = own or {}
        wrong = [f"{key}: no {k}" for k, f in shape.items() if f.default is MISSING and f.default_factory is MISSING and k not in own]
        wrong += [f"{key}: {k} is no positive whole number" for k in ("dimensions", "max_tokens", "batch_size") if k in own and not (str(own[k]).isdigit() and int(own[k]) > 0)]
        problems += wrong
        if not wrong:
            kept = {k: v for k, v in own.items() if k in shape and v is not None}
            kinds = {"int": int, "str": lambda v: str(v).strip()}
            specs[key] = ModelSpec(key, **{k: kinds.get(shape[k].type, dict)(v) for k, v in kept.items()})
    if given and raw.get("default") not in given:
        problems.append(f"default {raw.get('default')} is none of the models")
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    return ModelRegistry(int(raw["version"]), str(raw["default"]), specs)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and # comments; blanks are null, NA is a value. A header without a declared column is an error.

    Columns declared as arrays are split at |.
    """
    first = next((r[0] for r in spark.read.text(path).toLocalIterator() if not r[0].startswith("#")), "")
    missing = [f.name for f in StructType.fromDDL(schema).fields if f.name not in first.lstrip("﻿").split(",")]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    rows = spark.read.csv(path, header=True, comment="#", nullValue="", encoding="UTF-8")
    value = lambda f: F.transform(F.split(f.name, r"\|"), lambda x: x.try_cast(f.dataType.elementType)) if isinstance(f.dataType, ArrayType) else F.col(f.name).try_cast(f.dataType)
    return rows.select(*[value(f).alias(f.name) for f in StructType.fromDDL(schema).fields])


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word per line in lower case; comments and blank lines are skipped."""
    word = F.lower(F.trim("value"))
    return sorted({r[0] for r in spark.read.text(path).select(word.alias("w")).filter("w != '' AND w NOT LIKE '#%'").collect()})


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def verify_digests(spark: SparkSession, path: str, expected: dict[str, str]) -> list[str]:
    """Names whose file is absent or has another MD5."""
    found = {r.path.rpartition("/")[2]: r.md5 for r in spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5")).collect()}
    return sorted(n for n, digest in expected.items() if found.get(n) != digest)
