"""Sinks: Parquet, JSON artefacts, tar archives and staged folders."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import os
import re
import shutil
import tarfile
import tempfile
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=partition_by)


def write_bytes(path: str, payload: bytes) -> None:
    """Replaces a file of the driver in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_artefact(rows: DataFrame, path: str, meta: dict, name: str = "rows") -> None:
    """A small result as {"meta": ..., name: [...]}: compact, other than ASCII kept, nulls for undefined numbers."""
    data = [json.loads(x) for x in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    write_bytes(path, json.dumps({"meta": meta, name: data}, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode())


def write_per_group(df: DataFrame, path: str, key: str, order: list[str] | None = None) -> None:
    """A folder of JSON lines for each value of key, in order within a file; large groups keep several files, cut by range of order."""
    if order:
        df = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    df.write.mode("overwrite").partitionBy(key).json(path)


@contextlib.contextmanager
def staged(target: str) -> Iterator[str]:
    """A folder to write into; it replaces target when the block ends well, which is restored if that fails."""
    target = os.path.abspath(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    stage, old = tempfile.mkdtemp(dir=os.path.dirname(target)), None
    try:
        yield stage
        if os.path.exists(target):
            old = f"{stage}.old"
            os.rename(target, old)
        try:
            os.rename(stage, target)
        except OSError:
            if old:
                os.rename(old, target)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        if old:
            shutil.rmtree(old, ignore_errors=True)


def csv_with_provenance(rows: DataFrame, notes: list[str]) -> str:
    """CSV with # notes first, lists joined by |, CRLF line ends: for results of a screen's size."""
    out = io.StringIO()
    out.write("".join(f"# {n}\r\n" for n in notes))
    writer = csv.writer(out)
    writer.writerow(rows.columns)
    writer.writerows([["|".join(map(str, v)) if isinstance(v, list) else "" if v is None else v for v in r] for r in rows.collect()])
    return out.getvalue()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with array columns joined by |."""
    lists = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c, k in df.dtypes if k.startswith("array")}
    df.withColumns(lists).write.mode("overwrite").csv(path, header=True)


def _created(address: str) -> BinaryIO:
    """A new file, with its folder, on the file system that its address names."""
    if re.match(r"file:|/", address):
        inside = re.sub("^file:/*", "/", address)
        os.makedirs(os.path.dirname(inside), exist_ok=True)
        return open(inside, "wb")
    system, inside = pafs.FileSystem.from_uri(address)
    system.create_dir(os.path.dirname(inside))
    return system.open_output_stream(inside)


def write_tar(df: DataFrame, folder: str) -> list[str]:
    """filename and text as members of tar archives in a folder that all executors see, one archive a task; the archives' addresses.

    Rows without a name or text are left out. A task that runs again writes another
    archive; the one of the attempt that failed is not among the addresses.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        address = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tar"
        with _created(address) as file, tarfile.open(fileobj=file, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for batch in batches:
                for name, text in batch.dropna().itertuples(index=False):
                    raw = text.encode()
                    info = tarfile.TarInfo(name)
                    info.size = len(raw)
                    tar.addfile(info, io.BytesIO(raw))
                    tar.members.clear()
        yield pd.DataFrame({"address": [address]})

    return [r.address for r in df.select("filename", "text").mapInPandas(run, "address string").collect()]
