"""Publishing tables behind a gate: staged, checked against a declared contract, then pointed at.

Under a root lie `data` (a folder for each release and table), `contract` (the declared
shapes) and `manifest` (a record for each release). A release is what the newest record
of the manifest points at; it's appended by one write of one file, so that a release
that fails on its way leaves the one before it as it was. All of it goes through Spark's
readers and writers, on any store they reach.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators.quality import Shape, gate, schema_shape, shape_differences

CONTRACT = "table string, path string, kind string"
MANIFEST = "number long, release string, table string, path string"


def _read(spark: SparkSession, path: str, schema: str) -> list:
    """Rows of a small JSON table; none where it isn't yet."""
    try:
        return spark.read.schema(schema).json(path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def declared(spark: SparkSession, root: str) -> dict[str, Shape]:
    """The shape of each table that the contract promises."""
    out: dict[str, set] = {}
    for r in _read(spark, f"{root}/contract", CONTRACT):
        out.setdefault(r["table"], set()).add((r["path"], r["kind"]))
    return {k: frozenset(v) for k, v in out.items()}


def declare(spark: SparkSession, root: str, tables: dict[str, DataFrame], tracked: list[str]) -> None:
    """Writes the contract from the tables that are there; a run of its own, never part of publish. Raises if a tracked one is absent."""
    gate([f"{name} is absent" for name in tracked if name not in tables])
    rows = [(name, path, kind) for name in sorted(tables) for path, kind in sorted(schema_shape(tables[name].schema))]
    spark.createDataFrame(rows, CONTRACT).coalesce(1).write.mode("overwrite").json(f"{root}/contract")


def problems(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> list[str]:
    """What keeps tables from being published: no contract, or promised paths and types that they lack. Absent tables aren't checked."""
    promised = declared(spark, root)
    if not promised:
        return ["no contract is declared"]
    return [f"{name}: {p}" for name in sorted(promised) if name in tables for p in shape_differences(promised[name], schema_shape(tables[name].schema))]


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """The path of each table of the newest release."""
    rows = _read(spark, f"{root}/manifest", MANIFEST)
    newest = max((r["number"] for r in rows), default=None)
    last = max((r["release"] for r in rows if r["number"] == newest), default=None)
    return {r["table"]: r["path"] for r in rows if r["release"] == last}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes tables (Parquet) as a new release and returns its name; raises, and changes nothing, if the gate finds a problem.

    The gate reads the staged tables' own schemas, as readers will find them. Staged data
    of a failed release stays in its folder, which nothing points at.
    """
    gate(problems(spark, root, tables))
    release = uuid.uuid4().hex
    paths = {name: f"{root}/data/{release}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    gate(problems(spark, root, {name: spark.read.parquet(path) for name, path in paths.items()}))
    number = max((r["number"] for r in _read(spark, f"{root}/manifest", MANIFEST)), default=0) + 1
    rows = [(number, release, name, path) for name, path in sorted(paths.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return release


def changes(spark: SparkSession, old: str, new: str, key: list[str]) -> DataFrame:
    """key and change (`added`, `removed`, `changed`) of the rows in which two tables, given by path, differ; keys may be null."""
    a, b = spark.read.parquet(old), spark.read.parquet(new)
    whole = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    a, b = a.select(*key, whole(a).alias("_a")).alias("a"), b.select(*key, whole(b).alias("_b")).alias("b")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same, "full").filter("NOT (_a <=> _b)")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), change.alias("change"))
