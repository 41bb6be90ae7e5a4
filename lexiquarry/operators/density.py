"""Density clustering: mutual reachability, its minimum spanning tree, the condensed tree.

Points lie in blocks; each pair of blocks is one task. A first pass over the pairs gives
each point its core distance, a second one the spanning tree of the two blocks together
under mutual reachability. At any threshold the union of these trees connects what the
complete graph connects, and it has few edges: Boruvka rounds over tables of edges
contract it to one tree. Merging in order of weight gives the hierarchy, equal weights at
once, so that it doesn't depend on which of several trees was found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.operators.state import kept

UNASSIGNED = -1
BLOCK = 1024
#: From so many edges on Boruvka rounds contract the graph; fewer are finished by one task.
FEW = 200_000
NEAREST = 1e-12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows, to nine places, so that a pair has one distance wherever it is met."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.round(np.sqrt(np.maximum(square, 0)), 9)


def _pairs(points: DataFrame, blocks: int) -> DataFrame:
    """points once for each pair of blocks (a <= b) that its own is in; a block meets itself only where it is the only one."""
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_p")
    rows = points.select("*", partner)
    rows = rows.filter("_p != _block") if blocks > 1 else rows
    return rows.withColumns({"_a": F.least("_block", "_p"), "_b": F.greatest("_block", "_p")}).drop("_p")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def core_distances(points: DataFrame, least: int, blocks: int) -> DataFrame:
    """points (_key, _v, _block) and _core: the distance to the least-th nearest point, itself included."""

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        v, at, out = _matrix(rows["_v"]), rows["_block"].to_numpy(), []
        for block in np.unique(at):
            own = at == block
            # A block's points meet each other in the pair with the next block (the last: with the first).
            inside = blocks == 1 or (rows["_a"].iloc[0], rows["_b"].iloc[0]) == tuple(sorted((int(block), (int(block) + 1) % blocks)))
            other = np.ones(len(rows), dtype=bool) if inside else ~own
            d = np.sort(distances(v[own], v[other]), axis=1)[:, :least]
            out.append(pd.DataFrame({"_key": rows["_key"][own].to_numpy(), "_d": list(d)}))
        return pd.concat(out)

    kind = dict(points.dtypes)["_key"]
    found = _pairs(points, blocks).groupBy("_a", "_b").applyInPandas(nearest, f"_key {kind}, _d array<double>")
    every = F.array_sort(F.flatten(F.collect_list("_d")))
    core = found.groupBy("_key").agg(every.alias("_d")).select("_key", F.coalesce(F.get("_d", F.lit(least - 1)), F.array_max("_d")).alias("_core"))
    return points.join(core, "_key")


def spanning_tree(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (a, b, weight) of a minimum spanning tree of a complete graph."""
    n = len(weights)
    near, best, out = np.zeros(n, dtype=int), weights[0].copy(), []
    inside = np.zeros(n, dtype=bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((int(near[j]), j, float(best[j])))
        inside[j] = True
        closer = weights[j] < best
        near[closer], best = j, np.minimum(best, weights[j])
    return out


def reachability_edges(points: DataFrame, blocks: int) -> DataFrame:
    """a, b, w: the spanning trees of all pairs of blocks of points (_key, _v, _core, _block)."""

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        v, core, key = _matrix(rows["_v"]), rows["_core"].to_numpy(), rows["_key"].to_numpy()
        found = spanning_tree(np.maximum(distances(v, v), np.maximum(core[:, None], core[None, :])))
        return pd.DataFrame({"a": [min(key[i], key[j]) for i, j, _ in found], "b": [max(key[i], key[j]) for i, j, _ in found], "w": [w for *_, w in found]})

    kind = dict(points.dtypes)["_key"]
    return _pairs(points, blocks).groupBy("_a", "_b").applyInPandas(tree, f"a {kind}, b {kind}, w double").distinct()


def contracted(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Edges (a, b, w) without those that a minimum spanning tree can do without, by Boruvka rounds while they are more than few.

    A round takes each component's least edge (by weight, then ends), joins the
    components by halving the paths to their roots, and keeps the least edge between any
    two that are left.
    """
    edge = F.struct("w", "a", "b")
    left = kept(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), edge.alias("e")))
    tree = None
    while left.count() > few:
        both = left.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "e").union(left.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "e"))
        best = kept(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e"))
        chosen = best.select("e.*").distinct().select("a", "b", "w")
        tree = kept(chosen if tree is None else tree.union(chosen))
        # Two components that chose each other are a cycle; the smaller one becomes the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("_back"))
        root = kept(best.join(back, "to").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")))
        while True:
            up = root.select(F.col("c").alias("p"), F.col("p").alias("_pp"))
            higher = kept(root.join(up, "p").select("c", F.col("_pp").alias("p"), (F.col("_pp") != F.col("p")).alias("_moved")))
            root = higher.select("c", "p")
            if higher.filter("_moved").isEmpty():
                break
        moved = left.join(root.select(F.col("c").alias("ca"), F.col("p").alias("_a")), "ca").join(root.select(F.col("c").alias("cb"), F.col("p").alias("_b")), "cb").filter("_a != _b")
        left = kept(moved.groupBy(F.least("_a", "_b").alias("ca"), F.greatest("_a", "_b").alias("cb")).agg(F.min("e").alias("e")))
    rest = left.select("e.a", "e.b", "e.w")
    return rest if tree is None else tree.union(rest)


def hierarchy(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[list[list[int]], list[float], list[int]]:
    """Children, weight and size of the nodes above the points 0..n-1, which are nodes too; equal weights merge at once."""
    children, weight, size = [[] for _ in range(n)], [0.0] * n, [1] * n
    up, node = list(range(n)), list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order, at = np.argsort(w, kind="stable"), 0
    while at < len(order):
        level, joined = w[order[at]], {}
        while at < len(order) and w[order[at]] == level:
            x, y = root(int(a[order[at]])), root(int(b[order[at]]))
            if x != y:
                if len(joined.get(x, ())) < len(joined.get(y, ())):
                    x, y = y, x
                joined.setdefault(x, [node[x]]).extend(joined.pop(y, [node[y]]))
                up[y] = x
            at += 1
        for x, own in joined.items():
            node[x] = len(children)
            children.append(own)
            weight.append(float(level))
            size.append(sum(size[c] for c in own))
    return children, weight, size


def condensed(children: list[list[int]], weight: list[float], size: list[int], n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and strength of each point, by excess of mass over the tree of clusters of at least so many points; the root is no cluster."""
    parent, birth, mass = [-1], [0.0], [0.0]
    of, fell = np.zeros(n, dtype=int), np.zeros(n)
    waiting = [(len(children) - 1, 0)] if n > 1 else []
    while waiting:
        top, cluster = waiting.pop()
        level = 1 / max(weight[top], NEAREST)
        large = [c for c in children[top] if size[c] >= least]
        for c in children[top]:
            if c not in large:
                below = [c]
                while below:
                    x = below.pop()
                    below += children[x]
                    if x < n:
                        of[x], fell[x] = cluster, level
                        mass[cluster] += level - birth[cluster]
        if len(large) == 1:
            waiting.append((large[0], cluster))
            continue
        for c in large:
            mass[cluster] += size[c] * (level - birth[cluster])
            waiting.append((c, len(parent)))
            parent.append(cluster)
            birth.append(level)
            mass.append(0.0)
    below, chosen = [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    owner = [UNASSIGNED] * len(parent)
    for c in range(1, len(parent)):
        above = owner[parent[c]]
        owner[c] = above if above != UNASSIGNED else c if chosen[c] else UNASSIGNED
    label = np.array([owner[c] for c in of], dtype=int) if n else np.zeros(0, dtype=int)
    strength = np.zeros(n)
    for c in np.unique(label[label != UNASSIGNED]):
        strength[label == c] = fell[label == c] / fell[label == c].max()
    first = {c: np.flatnonzero(label == c)[0] for c in np.unique(label) if c != UNASSIGNED}
    number = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    return np.array([number.get(c, UNASSIGNED) for c in label], dtype=int), strength


def reduced(points: DataFrame, key: str, vector: Column, components: int = 5) -> DataFrame:
    """key and reduced: the first principal components of vector, in which densities differ where they don't in all dimensions."""
    rows = points.select(key, array_to_vector(vector).alias("_v"))
    return PCA(k=components, inputCol="_v", outputCol="_r").fit(rows).transform(rows).select(key, vector_to_array("_r").alias("reduced"))


def density_clusters(points: DataFrame, key: str, vector: Column, least: int = 60, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """key, topic, strength: clusters of at least so many points, -1 for noise; keys are unique and not null.

    Work grows with the square of the number of points (of a frozen sample, as a rule),
    in tasks of two blocks. The tree, three numbers a point and no vectors, is condensed
    by one task. Clusters are numbered by their smallest key.
    """
    blocks = max(1, math.ceil(points.count() / block))
    own = points.select(F.col(key).alias("_key"), vector.alias("_v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"))
    dense = kept(core_distances(kept(own), least, blocks))
    tree = contracted(reachability_edges(dense, blocks), few)

    def label(edges: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
        half = len(edges)
        topic, strength = condensed(*hierarchy(ends[:half], ends[half:], edges["w"].to_numpy(), len(names)), len(names), least)
        return pd.DataFrame({key: names, "topic": topic, "strength": strength})

    kind = dict(points.dtypes)[key]
    found = tree.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(label, f"{key} {kind}, topic int, strength double")
    none = {"topic": F.coalesce("topic", F.lit(UNASSIGNED)), "strength": F.coalesce("strength", F.lit(0.0))}
    return points.select(key).join(found, key, "left").withColumns(none)
