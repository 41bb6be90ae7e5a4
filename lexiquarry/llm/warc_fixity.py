"""Merkle fixity audit of WARC replicas.

Records lie in volumes of VOLUME records. A leaf is the hash of a record's bytes; a
node hashes up to FAN ordered children with their offset ranges, which count from the
node's own start, so that a record of another length changes the nodes above it and no
others; a volume's root is the hash that two replicas compare first. Only below roots
and nodes that differ are children compared, down to the records. All of it is DataFrame work on hashes: record
bytes are read once per replica and never shuffled.

The first replica's layout numbers records by id and url, which damage to a record's
bytes doesn't change. The records of another replica are hashed on their own and take
the places that the layout has for their id and url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import checkpointed, global_row_numbers

VOLUME, FAN = 1024, 16
LEVELS = 3  # FAN ** 2 < VOLUME <= FAN ** 3


def record_bytes(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def _hashed(pages: DataFrame) -> DataFrame:
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", "url", F.sha2(record, 256).alias("leaf"), F.octet_length(record).cast("long").alias("length"))


def _place(number: Column) -> list[Column]:
    return [F.floor(number / F.lit(VOLUME)).cast("long").alias("volume"), F.pmod(number, F.lit(VOLUME)).cast("int").alias("idx")]


def layout(pages: DataFrame) -> DataFrame:
    """page_id, url, leaf (SHA-256 of the record), length, volume, idx: where each record of pages lies.

    Records are numbered by hash of id and url, so that a record's content moves no
    other one; those with the same id and url follow each other by content. Other
    columns aren't read.
    """
    placed = global_row_numbers(_hashed(pages), ["page_id", "url", "leaf", "length"], by=["page_id", "url"])
    return placed.select("page_id", "url", "leaf", "length", *_place(F.col("row_number")))


def replica_layout(pages: DataFrame, records: DataFrame) -> DataFrame:
    """As layout, for the pages of another replica, at the places that records (a layout) has for them.

    Records with the same id and url take the places of equal content first, the
    others of them what is left in order. Records that find no place lie in volumes
    of their own after all others.
    """
    key = ["page_id", "url"]
    number = F.col("volume") * VOLUME + F.col("idx")
    known = records.groupBy(*key, "leaf").agg(F.min(number).alias("start"), F.count("*").alias("n"))
    found = _hashed(pages).groupBy(*key, "leaf").agg(F.max("length").alias("length"), F.count("*").alias("c"))
    a, b = known.alias("a"), found.alias("b")
    same = F.lit(True)
    for k in (*key, "leaf"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same, "full")
    both = checkpointed(both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*key, "leaf")), "length", "start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0)).alias("c")))

    def spread(first: Column, count: Column) -> Column:
        return F.explode(F.sequence(first, first + count - 1)).alias("number")

    kept = both.filter("n > 0 AND c > 0").select(*key, "leaf", "length", spread(F.col("start"), F.least("n", "c")))
    free = both.filter("n > c").select(*key, spread(F.col("start") + F.col("c"), F.col("n") - F.col("c")))
    homeless = both.filter("c > n").select(*key, "leaf", "length", spread(F.lit(1).cast("long"), F.col("c") - F.col("n"))).drop("number")
    free = free.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("number"))).alias("f")
    homeless = homeless.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("leaf"))).alias("h")
    fits = F.col("f.r") == F.col("h.r")
    for k in key:
        fits = fits & F.col(f"f.{k}").eqNullSafe(F.col(f"h.{k}"))
    settled = checkpointed(homeless.join(free, fits, "left").select(*(f"h.{k}" for k in (*key, "leaf", "length")), "f.number"))
    extra = global_row_numbers(settled.filter("number IS NULL").select(*key, "leaf", "length"), [*key, "leaf", "length"], by=key)
    volumes = records.agg((F.coalesce(F.max("volume"), F.lit(-1)) + 1).alias("_volumes"))
    extra = extra.crossJoin(F.broadcast(volumes)).select(*key, "leaf", "length", (F.col("_volumes") * VOLUME + F.col("row_number")).alias("number"))
    placed = kept.union(settled.filter("number IS NOT NULL")).union(extra)
    return placed.select(*key, "leaf", "length", *_place(F.col("number")))


def manifest(records: DataFrame) -> DataFrame:
    """records (volume, idx, leaf, length, ...) with lo and hi, the byte range of each in its volume."""
    upto = Window.partitionBy("volume").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("hi", F.sum("length").over(upto)).withColumn("lo", F.col("hi") - F.col("length"))


def _leaves(listed: DataFrame) -> DataFrame:
    return listed.select("volume", F.col("idx").cast("long").alias("idx"), "lo", "hi", F.col("leaf").alias("hash"))


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: node idx div FAN hashes its ordered children and their ranges inside it."""
    grouped = nodes.groupBy("volume", F.expr(f"idx div {FAN}").alias("idx"))
    children = grouped.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("idx", "lo", "hi", "hash"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["idx"].cast("string"), (c["lo"] - F.col("lo")).cast("string"), (c["hi"] - F.col("lo")).cast("string"), c["hash"])), "|")
    return children.select("volume", "idx", "lo", "hi", F.sha2(text, 256).alias("hash"))


def tree(listed: DataFrame) -> list[DataFrame]:
    """Levels of nodes (volume, idx, lo, hi, hash), leaves first, roots last."""
    levels = [_leaves(listed)]
    for _ in range(LEVELS):
        levels.append(_parents(levels[-1]))
    return levels


def _differing(a: DataFrame, b: DataFrame, below: DataFrame | None) -> DataFrame:
    if below is not None:
        inside = below.select("volume", F.col("idx").alias("_up"))
        a, b = (x.withColumn("_up", F.expr(f"idx div {FAN}")).join(inside, ["volume", "_up"], "left_semi").drop("_up") for x in (a, b))
    a = a.select("volume", "idx", F.struct("lo", "hi", "hash").alias("a"))
    b = b.select("volume", "idx", F.struct("lo", "hi", "hash").alias("b"))
    return a.join(b, ["volume", "idx"], "full").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records (volume, idx) that differ between two manifests, found by descending both trees.

    Columns: volume, idx, status (`corrupt`: other bytes; `missing` or `extra`: in the
    first or second manifest only), lo and hi of the first and of the second (null where
    there is none). Records that only lie elsewhere, as one before them is longer, shorter
    or lost, aren't listed; shifts() has them by volume.
    """
    bad = None
    for a, b in list(zip(tree(first), tree(second)))[::-1]:
        bad = _differing(a, b, bad)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return bad.select("volume", F.col("idx").cast("int").alias("idx"), status.alias("status"), F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"), F.col("b.lo").alias("replica_lo"), F.col("b.hi").alias("replica_hi"))


def shifts(first: DataFrame, second: DataFrame) -> DataFrame:
    """volume and shift: the bytes that each volume of the second manifest has more than the first's, if not as many."""
    a, b = (x.groupBy("volume").agg(F.sum("length").alias("n")) for x in (first, second))
    both = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), "volume", "full")
    return both.select("volume", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("shift")).filter("shift != 0")


def damaged(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as a failing disk leaves them: of each 997 one has another first byte, one is cut by a character, one is lost.

    The replica is made up: there is one copy of pages only.
    """
    fate = F.pmod(F.xxhash64("page_id", "url"), F.lit(997))
    html = F.coalesce("html", F.lit(""))
    other = F.concat(F.when(html.startswith("X"), "Y").otherwise("X"), F.substring(html, 2, 2**31 - 1))
    cut = F.left(html, F.length(html) - 1)
    return pages.filter(fate != 2).select("page_id", "url", F.when(fate == 0, other).when(fate == 1, cut).otherwise(F.col("html")).alias("html"))


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record of pages and what the audit of a damaged replica, hashed from its own bytes, says of it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = checkpointed(layout(pages))
    first, second = checkpointed(manifest(records)), checkpointed(manifest(replica_layout(damaged(pages), records)))
    found = audit(first, second).select("volume", "idx", "status")
    rows = first.join(found, ["volume", "idx"], "left").join(shifts(first, second), "volume", "left")
    return rows.select("page_id", "volume", "idx", F.col("lo").alias("offset"), "length", F.col("leaf").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"), F.coalesce("shift", F.lit(0)).cast("long").alias("volume_shift"))
