"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct five-word shingles, hashed to 64 bits; two sets link
if they share 80 % of their union. Texts with equal sets form a class, and only
classes are joined.

The index is an R-tree over count vectors: shingles are hashed into groups and the
group counts of a set are a point. The sum of coordinate minima of two points bounds
the overlap of their sets, and of a point and a node's upper corner that with every set
below the node, so subtrees that can't reach the overlap asked for are left out. Long
sets fill few groups so evenly that the bound says little: a set of n shingles has at
least n / PER_GROUP groups. The trees fold the vectors to GROUPS groups; what they leave
is bounded again on all groups that both vectors have, and then verified on the sets.

The tree is sharded. Linked sets share one of the first n - ceil(0.8 n) + 1 of their
shingles in any order common to all; each of these shingles is a block with R-trees
of its own. Shingles go by how often they occur, rare ones first, so that passages
that many documents share make no blocks. The order is read from a count sketch of
fixed size: it may be inexact, as any common order is right. Of blocks with the same
members only one is kept.

Round 1 puts each class into its least and its most crowded block, in chunks of CHUNK
classes, and connects what links there. The leaders of the largest groups of a block's
chunks meet again.
Round 2 looks at all blocks, but only for links between different components. A block's
members are homes; those outside the block's largest component also visit them. A block whose
vectors fit into ROUND_BYTES is one group, so that each member is sent once or twice. A more
crowded one is cut into ranges of sizes first, as only sets of like size link, and each range
into chunks of homes and parties of visitors of ROUND_BYTES, each party for every chunk. In
both rounds the vectors come first: only members that they leave a candidate get their sets
and are verified, in the block, and what leaves the block are the links of a spanning forest.
No pair that could connect two components goes unverified.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import SPACE_CHARS, checkpointed, documents

WORDS = 5
GROUPS = 64
PER_GROUP = 4
CHUNK = 128
#: Bytes of vectors of a chunk or a party of round 2; their sets have about 32 times as many at most.
ROUND_BYTES = 1 << 17
#: Sets of which one is larger by more than a quarter don't link; a little more, so that no rounding parts two that do.
LEVEL = 1.2501
NODE = 8
#: So many of a class's blocks tell in round 2 that a pair meets in an earlier one.
HEADS = 8
SKETCH_BITS = 21
SLICES = 64
BATCH_BYTES = 1 << 18
#: Up to so many rows of documents whose sets are needed are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_R = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_PLACE = _mix(np.arange(1001, 1001 + WORDS, dtype=np.uint64) * np.uint64(_R)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r ** i and r ** -i modulo 2 ** 64 for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, BATCH_BYTES)
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            out = np.full(size, np.uint64(base), dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of about BATCH_BYTES, cut between words; each begins with the last WORDS - 1 words before it."""
    at, back = 0, b""
    while True:
        cut = _SPACE.search(raw, at + BATCH_BYTES) if len(raw) - at > BATCH_BYTES else None
        piece = back + raw[at : cut.start() if cut else len(raw)]
        yield piece
        if cut is None:
            return
        back, at = b" ".join(piece.split()[1 - WORDS :]) + b" ", cut.end()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text; a long one is read in pieces."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    if all(len(r) <= 2 * BATCH_BYTES for r in raw):
        return _sets(raw)
    out = []
    for r in raw:
        pieces = list(_pieces(r)) if len(r) > 2 * BATCH_BYTES else [r]
        found = [_sets([x])[0] for x in pieces if len(pieces) == 1 or len(x.split()) >= WORDS]
        out.append(np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else _sets([r])[0])
    return out


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer((b" ".join(raw) + b" ").translate(_LOWER), dtype=np.uint8)
    doc_at = np.cumsum([0] + [len(r) + 1 for r in raw])
    space = _SPACES[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _power(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    edges = np.searchsorted(starts, doc_at)
    n = len(word) - WORDS + 1
    full = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(WORDS if n > 0 else 0):
        full += word[k : k + n] * _PLACE[k]
    full = _mix(full)
    out = []
    for i in range(len(raw)):
        a, b = int(edges[i]), int(edges[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif b > a:
            own = word[a:b]
            out.append(_mix((own * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def n_groups(size: int) -> int:
    """Groups of the vector of a set: a power of two, GROUPS at least."""
    return max(GROUPS, 1 << (max(size, 1) // PER_GROUP).bit_length())


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles are in each group; a group is the first bits of a shingle."""
    groups = n_groups(len(shingles))
    group = (shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    return np.bincount(group, minlength=groups).astype(np.uint32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The counts in fewer groups."""
    return vector if len(vector) == groups else vector.reshape(groups, -1).sum(axis=1)


def packed(vector: np.ndarray) -> bytes:
    """A byte that tells the width, then the counts in that many bytes each."""
    top = int(vector.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return bytes((np.dtype(kind).itemsize,)) + vector.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether the overlap bound of two vectors reaches a link."""
    groups = min(len(a), len(b))
    return links(n_a, n_b, int(np.minimum(folded(a, groups), folded(b, groups)).sum()))


def links(n_a: int, n_b: int, shared: int) -> bool:
    return 9 * shared >= 4 * (n_a + n_b)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of the batches with about BATCH_BYTES of text each."""
    for batch in batches:
        size, begin = 0, 0
        for i, text in enumerate(batch["text"]):
            size += len(text) if text is not None else 0
            if size >= BATCH_BYTES:
                yield batch.iloc[begin : i + 1]
                size, begin = 0, i + 1
        if begin < len(batch):
            yield batch.iloc[begin:]


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for part in _parts(batches):
        found = np.concatenate(shingle_sets(part["text"].tolist()))
        np.add.at(counts, (found & np.uint64(len(counts) - 1)).astype(np.int64), np.uint32(1))
    yield pd.DataFrame({"slice": range(SLICES), "counts": [x.tobytes() for x in counts.reshape(SLICES, -1)]})


def _sum_slices(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, dtype=np.uint64)
    for batch in batches:
        for raw in batch["counts"]:
            total += np.frombuffer(raw, dtype=np.uint32)
    yield pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def shingle_order(docs: DataFrame) -> np.ndarray:
    """Per slot of the sketch, the magnitude (base 2) of how often its shingles occur: 2 MB, whatever the input."""
    slices = docs.select("text").mapInPandas(_sketch, "slice int, counts binary")
    summed = slices.groupBy("slice").applyInPandas(_sum_slices, "slice int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(bytes(r.counts), dtype=np.uint32) for r in sorted(summed)])
    return np.log2(counts + 1.0).astype(np.uint8)


def prefix(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shingles that a linked set shares one of."""
    n = len(shingles)
    size = order[(shingles & np.uint64(len(order) - 1)).astype(np.int64)]
    at = np.argsort(size, kind="stable")[: n - (4 * n + 4) // 5 + 1]
    return shingles[at]


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(self.root(i), self.root(j))] = min(self.root(i), self.root(j))


class RTree:
    """Count vectors packed into nodes of NODE points or nodes of like size, up to one root node."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.at = np.lexsort((vectors[:, : GROUPS // 2].sum(axis=1), sizes))
        self.levels = [(vectors[self.at], sizes[self.at])]
        while len(self.levels[-1][1]) > NODE:
            points, least = self.levels[-1]
            first = np.arange(0, len(least), NODE)
            self.levels.append((np.maximum.reduceat(points, first, axis=0), np.minimum.reduceat(least, first)))

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Members whose overlap bound with the point reaches a link."""
        rows = np.arange(len(self.levels[-1][1]))
        for points, least in reversed(self.levels):
            if points is not self.levels[-1][0]:
                rows = (rows[:, None] * NODE + np.arange(NODE)).ravel()
                rows = rows[rows < len(least)]
            rows = rows[9 * np.minimum(points[rows], vector).sum(axis=1) >= 4 * (least[rows] + size)]
        return self.at[rows]


def _groups(batches: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of each group of the first k columns, one after another; batches are sorted by them, a group may span batches."""
    rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[:k])


def _frames(rows: Iterator[tuple], columns: list[str], size: int) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=columns)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Chunk:
    """Homes of a block: an R-tree over their vectors, and perhaps their sets."""

    def __init__(self, vectors: list[np.ndarray], sizes: list[int]):
        self.vectors, self.sizes = vectors, sizes
        self.tree = RTree(np.array([folded(v, GROUPS) for v in vectors]), np.array(sizes))

    def near(self, vector: np.ndarray, size: int) -> Iterator[int]:
        """Homes whose vectors leave a link with the point."""
        for j in self.tree.search(folded(vector, GROUPS), size).tolist():
            if may_link(vector, self.vectors[j], size, self.sizes[j]):
                yield j


def _live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows token, chunk, cls, vector, n, chunks -> those whose vectors leave a candidate in the chunk."""

    def rows() -> Iterator[tuple]:
        for _, group in _groups(batches, 2):
            group = list(group)
            vectors, sizes = [unpacked(r[3]) for r in group], [r[4] for r in group]
            live = [False] * len(group)
            if len(group) == 2:
                live = [may_link(*vectors, *sizes)] * 2
            elif len(group) > 2:
                chunk = Chunk(vectors, sizes)
                for i, (v, n) in enumerate(zip(vectors, sizes)):
                    if not live[i]:
                        for j in chunk.near(v, n):
                            if i != j:
                                live[i] = live[j] = True
            yield from ((*r[:3], r[5]) for r, found in zip(group, live) if found)

    return _frames(rows(), ["token", "chunk", "cls", "chunks"], 10_000)


def _round_one(level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows token, chunk, cls, hashes, chunks -> links to the first of each group found, and (first level) the leader of the largest."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for _, group in _groups(batches, 2):
            group = [next(same) for _, same in groupby(group, key=lambda row: row[2])]
            forest = join_block([np.frombuffer(r[3], dtype=np.uint64) for r in group])
            roots = [forest.root(i) for i in range(len(group))]
            yield from ((r[0], r[1], r[2], group[k][2], None) for k, r in zip(roots, group) if group[k] is not r)
            if level == 0 and group[0][4] > 1:
                sizes = Counter(roots)
                leader = group[max(range(len(group)), key=lambda i: (sizes[i], -i))]
                yield (*leader[:3], None, leader[3])

    return lambda batches: _frames(rows(batches), ["token", "chunk", "a", "b", "hashes"], 500)


def join_block(sets: list[np.ndarray]) -> Forest:
    """Connects the members of a block that link; pairs that are connected already aren't verified."""
    forest = Forest(len(sets))
    sizes = [len(s) for s in sets]
    chunk = Chunk([count_vector(s) for s in sets], sizes) if len(sets) > 1 else None
    for i in range(1, len(sets)):
        for j in chunk.near(chunk.vectors[i], sizes[i]):
            if j < i and forest.root(i) != forest.root(j) and links(sizes[i], sizes[j], _shared(sets[i], sets[j])):
                forest.join(i, j)
    return forest


KEYS = ["token", "level", "chunk", "party"]


def _met(visitor: tuple, home: tuple) -> bool:
    """Whether a visitor looks at a home (rows guest, lower, cls, comp, base after the keys): components differ.

    Of two that both visit, the lesser looks at the greater; two that are both of the lower
    range met in a level of their own.
    """
    (_, low_a, a, comp_a, _), (_, low_b, b, comp_b, base) = visitor[4:9], home[4:9]
    return comp_a != comp_b and (comp_b == base or a < b) and not (low_a and low_b)


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of KEYS, guest, lower, cls, comp, base, vector, n, heads -> those whose vectors leave a visitor and a home that may link.

    Two that share one of the first tokens of both meet in that token's block too; they
    are left to it if it comes before this one.
    """

    def rows() -> Iterator[tuple]:
        for _, group in _groups(batches, len(KEYS)):
            homes = []
            for guest, some in groupby(group, key=lambda row: row[4]):
                if not guest:
                    homes = list(some)
                    chunk = Chunk([unpacked(r[9]) for r in homes], [r[10] for r in homes])
                    earlier = [{t for t in r[11] if t < r[0]} for r in homes]
                    live = [False] * len(homes)
                elif homes:
                    for r in some:
                        found = [j for j in chunk.near(unpacked(r[9]), r[10]) if _met(r, homes[j]) and earlier[j].isdisjoint(r[11])]
                        for j in found:
                            live[j] = True
                        if found:
                            yield r[:9]
                    yield from (h[:9] for h, found in zip(homes, live) if found)

    return _frames(rows(), [*KEYS, "guest", "lower", "cls", "comp", "base"], 10_000)


def _round_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of KEYS, guest, lower, cls, comp, base, hashes -> links of a spanning forest of each group's components."""

    def rows() -> Iterator[tuple]:
        for _, group in _groups(batches, len(KEYS)):
            homes, up = [], {}

            def root(c: bytes) -> bytes:
                while up.get(c, c) != c:
                    c = up[c]
                return c

            for guest, some in groupby(group, key=lambda row: row[4]):
                some = (next(same) for _, same in groupby(some, key=lambda row: row[6]))
                if not guest:
                    homes = list(some)
                    sets = [np.frombuffer(r[9], dtype=np.uint64) for r in homes]
                    chunk = Chunk([count_vector(s) for s in sets], [len(s) for s in sets])
                    continue
                for r in some if homes else ():
                    own = np.frombuffer(r[9], dtype=np.uint64)
                    for j in chunk.near(count_vector(own), len(own)):
                        a, b = root(r[7]), root(homes[j][7])
                        if a != b and _met(r, homes[j]) and links(len(own), len(sets[j]), _shared(own, sets[j])):
                            up[max(a, b)] = min(a, b)
                            yield r[6], homes[j][6]

    return _frames(rows(), ["a", "b"], 10_000)


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """v and the smallest vertex connected with it, l: rounds of least neighbour and of following the label."""
    pairs = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    pairs = checkpointed(pairs.union(pairs.select("u", "v")).distinct())
    labels = checkpointed(pairs.groupBy("v").agg(F.min(F.least("v", "u")).alias("l")))
    while True:
        near = pairs.join(labels.select(F.col("v").alias("u"), "l"), "u").groupBy("v").agg(F.min("l").alias("m"))
        lower = checkpointed(labels.join(near, "v", "left").select("v", "l", F.least("l", "m").alias("m")))
        if lower.filter("l != m").isEmpty():
            break
        jump = lower.select(F.col("v").alias("m"), F.col("m").alias("l"))
        labels = checkpointed(lower.select("v", "m").join(jump, "m").select("v", "l"))
    return vertices.join(labels, "v", "left").select("v", F.coalesce("l", "v").alias("l"))


def _by_group(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def row_names() -> list[Column]:
    """row and twin: 128 bits that name a row by its doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit("twin"), "doc_id", "text").alias("twin")]


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, row, twin, n (shingles), cls (digest of the shingle set), vector and tokens (first shingles) of each row; null for an empty set."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            sets = shingle_sets(part["text"].tolist())
            columns = {c: part[c] for c in ("doc_id", "row", "twin")} | {"n": [len(s) for s in sets]}
            some = {"cls": class_of, "vector": lambda s: packed(count_vector(s)), "tokens": lambda s: prefix(s, order.value).view(np.int64)}
            yield pd.DataFrame(columns | {c: [f(s) if len(s) else None for s in sets] for c, f in some.items()})

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, row long, twin long, n long, cls binary, vector binary, tokens array<long>"
    return docs.select("doc_id", "text", *row_names()).mapInPandas(run, shape)


def blocks(classes: DataFrame) -> DataFrame:
    """token, short and members (of the token): the blocks that two or more classes share; of those with the same members, one.

    Blocks are compared by their count, least and greatest member and two checksums of
    64 bits.
    """
    each = classes.select(F.explode("tokens").alias("token"), "short").repartition("token")
    facts = {"members": F.count("*"), "lo": F.min("short"), "hi": F.max("short"), "x": F.bit_xor(F.xxhash64("short")), "y": F.bit_xor(F.xxhash64(F.lit("y"), "short"))}
    shared = each.groupBy("token").agg(*(v.alias(k) for k, v in facts.items())).filter("lo != hi")
    one = shared.groupBy(*facts).agg(F.min("token").alias("token")).select("token", "members")
    return each.join(one, "token").select("token", "short", "members")


def dealt(crossed: DataFrame) -> DataFrame:
    """Rows of crossed blocks (token, cls, comp, base, vector, n, heads, bytes) with their groups of round 2: homes once a party, visitors once a chunk.

    bytes is that of the block's vectors. Of a block beyond ROUND_BYTES a member goes to the
    range of its size and, as one of the lower, to the next; ranges without visitors are left out.
    """
    size, visits = F.length("vector"), F.col("comp") != F.col("base")
    level = F.floor(F.log(LEVEL, "n")).cast("int")
    columns = ["token", "level", "lower", "cls", "comp", "base", "vector", "n", "heads", "chunks", "parties"]
    one = {"level": F.lit(-1), "lower": F.lit(False), "chunks": F.lit(1), "parties": F.lit(1)}
    calm = crossed.filter(F.col("bytes") <= ROUND_BYTES).withColumns(one).select(columns)
    wide = crossed.filter(F.col("bytes") > ROUND_BYTES).withColumn("level", F.explode(F.array(level, level + 1))).withColumn("lower", F.col("level") > level)
    shares = wide.groupBy("token", "level").agg(F.sum(size).alias("home"), F.sum(F.when(visits, size)).alias("visiting")).filter("visiting > 0")
    count = {k: F.ceil(F.col(v) / ROUND_BYTES).cast("int") for k, v in (("chunks", "home"), ("parties", "visiting"))}
    rows = calm.union(wide.join(shares, ["token", "level"]).withColumns(count).select(columns))

    def place(salt: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "cls", "token"), F.col(n)).cast("int")

    at_home = rows.withColumns({"chunk": place("home", "chunks"), "party": F.explode(F.sequence(F.lit(0), F.col("parties") - 1)), "guest": F.lit(False)})
    visiting = rows.filter(visits).withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "party": place("visit", "parties"), "guest": F.lit(True)})
    columns = [*KEYS, "guest", "lower", "cls", "comp", "base", "vector", "n", "heads"]
    return at_home.select(columns).union(visiting.select(columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, row and twin (hashes of id and text) and component of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included;
    null ids are passed over unless there is no other. Null texts and texts without
    words have no shingles and no links; texts of fewer than five words have one,
    their whole word sequence. Rows that repeat an id are documents of their own, so
    that several components may have the same component_id; component (a class's digest,
    null without shingles) tells them apart. Other columns are not read.
    """
    ids = dict(docs.dtypes)["doc_id"]
    described = checkpointed(classify(docs))
    member = described.drop("vector", "tokens")
    first = F.min(F.struct("row", "twin", "n", "vector", "tokens")).alias("first")
    known = described.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), first).select("cls", "rep", "first.*")
    classes = checkpointed(known.withColumn("short", F.monotonically_increasing_id()))

    rows = checkpointed(blocks(classes))
    rank = F.struct("members", "token")
    homes = rows.groupBy("short").agg(F.min(rank).alias("x"), F.max(rank).alias("y"))
    homes = homes.select("short", F.explode(F.array_distinct(F.array("x", "y"))).alias("h")).select("short", F.col("h.token").alias("token"), F.col("h.members").alias("members"))
    points = classes.select("short", "cls", "vector", "n")

    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("cls", "token"), chunks).cast("int")
    placed = homes.join(points, "short").select("token", own.alias("chunk"), "cls", "vector", "n", chunks.alias("chunks"))
    live = checkpointed(_by_group(placed, ["token", "chunk"]).mapInPandas(_live, "token long, chunk int, cls binary, chunks int"))

    def sets_for(names: DataFrame) -> DataFrame:
        """The sets of the classes named (cls, hashes), from the text of one row each; several times if that row is repeated."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _parts(batches):
                found = [(c, s.tobytes()) for s, c in zip(shingle_sets(part["text"].tolist()), part["cls"]) if class_of(s) == bytes(c)]
                yield pd.DataFrame(dict(found).items(), columns=["cls", "hashes"])

        needed = checkpointed(names.distinct().join(classes, "cls").select("cls", "row", "twin"))
        few = needed.count() <= BROADCAST_ROWS
        texts = docs.select("text", *row_names()).join(F.broadcast(needed) if few else needed, ["row", "twin"]).select("cls", "text")
        return texts.mapInPandas(run, "cls binary, hashes binary")

    shape = "token long, chunk int, a binary, b binary, hashes binary"
    asked = live.join(sets_for(live.select("cls")), "cls").select("token", "chunk", "cls", "hashes", "chunks")
    found = checkpointed(_by_group(asked, ["token", "chunk"], "cls").mapInPandas(_round_one(0), shape))
    again = found.filter("b IS NULL").select("token", F.expr(f"chunk div {CHUNK}").cast("int").alias("chunk"), F.col("a").alias("cls"), "hashes", F.lit(1).alias("chunks"))
    upper = _by_group(again, ["token", "chunk"], "cls").mapInPandas(_round_one(1), shape)
    edges = checkpointed(found.union(upper).filter("b IS NOT NULL").select("a", "b"))

    vertices = classes.select(F.col("cls").alias("v"))
    labels = checkpointed(components(edges, vertices))
    heads = rows.groupBy("short").agg(F.slice(F.sort_array(F.collect_list("token")), 1, HEADS).alias("heads"))
    marked = labels.select(F.col("v").alias("cls"), F.col("l").alias("comp")).join(points, "cls").join(heads, "short")
    sized = rows.join(marked.select("short", "comp", F.length("vector").alias("size")), "short")
    inside = sized.groupBy("token", "comp").agg(F.sum("size").alias("s"))
    mixed = inside.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("s", "comp")).alias("top"), F.sum("s").alias("bytes"))
    mixed = mixed.filter("lo != hi").select("token", F.col("top.comp").alias("base"), "bytes")
    crossed = checkpointed(rows.select("token", "short").join(mixed, "token").join(marked, "short").select("token", "cls", "comp", "base", "vector", "n", "heads", "bytes"))
    kinds = "token long, level int, chunk int, party int, guest boolean, lower boolean, cls binary, comp binary, base binary"
    visits = checkpointed(_by_group(dealt(crossed), KEYS, "guest").mapInPandas(_visits, kinds))

    if not visits.isEmpty():
        asked = visits.join(sets_for(visits.select("cls")), "cls").select(*visits.columns, "hashes")
        crossing = checkpointed(_by_group(asked, KEYS, "guest", "cls").mapInPandas(_round_two, "a binary, b binary"))
        if not crossing.isEmpty():
            labels = checkpointed(components(edges.union(crossing), vertices))
    least = labels.join(classes.select(F.col("cls").alias("v"), "rep"), "v").groupBy("l").agg(F.min("rep").alias("least"))
    answer = labels.join(least, "l").select(F.col("v").alias("cls"), "least", F.col("l").alias("component"))
    out = member.join(answer, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").cast(ids).alias("component_id"), "row", "twin", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that link to another: of each component the row with the smallest id stays.

    Null ids come last, ties go by the hash of the text. Rows without shingles stay;
    rows that repeat id and text count once, unless they have neither id nor shingles.
    All columns are kept, whatever their names.
    """
    found = near_duplicates(docs)
    alone = found.filter("n_shingles = 0").select("row", "twin")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "twin"))
    first = found.filter("n_shingles > 0").groupBy("component").agg(best.alias("best")).select("best.row", "best.twin")
    nameless = F.col("doc_id").isNull() & (F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS)) == "")
    named = docs.filter(~nameless).select(F.struct(*docs.columns).alias("whole"), *row_names())
    kept = named.join(first.union(alone).distinct(), ["row", "twin"], "left_semi").dropDuplicates(["row", "twin"])
    return kept.select("whole.*").union(docs.filter(nameless))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("row", "twin", "component")
