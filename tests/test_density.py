"""Density clusters and factorisation against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import density, factorise


def blobs(n, seed):
    rng = random.Random(seed)
    centres = [(0, 0, 0), (4, 0, 1), (4.5, 1.2, 1), (-3, 5, 0)]
    out = [tuple(c + rng.gauss(0, 0.3) for c in rng.choice(centres)) for _ in range(n * 9 // 10)]
    out += [tuple(rng.uniform(-8, 8) for _ in range(3)) for _ in range(n - len(out) - 10)]
    return out + out[:10]


def plain_clusters(points, least):
    """By definition: components at every threshold, from the largest down, and the choice with the most mass."""
    n = len(points)
    d = [[round(math.dist(p, q), 9) for q in points] for p in points]
    core = [sorted(row)[least - 1] for row in d]
    reach = np.array([[max(d[i][j], core[i], core[j]) for j in range(n)] for i in range(n)])
    levels = sorted(set(reach[np.triu_indices(n, 1)].tolist()), reverse=True)

    def components(members, level):
        left, out = set(members), []
        while left:
            seen = [left.pop()]
            for x in seen:
                near = [y for y in left if reach[x][y] < level]
                left.difference_update(near)
                seen += near
            out.append(frozenset(seen))
        return out

    def cluster(born, birth, at):
        """(mass, most mass here or below, chosen clusters) of a cluster as it was born."""
        mass, below, chosen, members = 0.0, 0.0, [], born
        while at < len(levels):
            level = 1 / max(levels[at], 1e-12)
            parts = components(members, levels[at])
            at += 1
            if len(parts) == 1:
                continue
            large = [p for p in parts if len(p) >= least]
            if len(large) == 1:
                mass += (len(members) - len(large[0])) * (level - birth)
                members = large[0]
                continue
            mass += len(members) * (level - birth)
            for p in large:
                _, b, c = cluster(p, level, at)
                below += b
                chosen += c
            break
        return (mass, mass, [born]) if birth and mass >= below else (mass, below, chosen)

    _, _, chosen = cluster(frozenset(range(n)), 0.0, 0)
    label = [-1] * n
    for k, members in enumerate(sorted(chosen, key=min)):
        for x in members:
            label[x] = k
    return label


@pytest.mark.parametrize("few", [density.FEW, 0])
def test_density(spark, few):
    points = blobs(160, 3)
    rows = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "id long, v array<double>").repartition(3)
    out = {r.id: r for r in density.density_clusters(rows, "id", F.col("v"), 12, block=50, few=few).collect()}
    want = plain_clusters(points, 12)
    assert [out[i].topic for i in range(len(points))] == want and len(set(want)) >= 4 and -1 in want
    assert all((out[i].strength > 0) == (t >= 0) and out[i].strength <= 1 for i, t in enumerate(want))
    assert density.density_clusters(rows.limit(1), "id", F.col("v"), 12).first().topic == -1
    assert density.density_clusters(rows.limit(0), "id", F.col("v"), 12).count() == 0


def test_factors(spark):
    rng = random.Random(1)
    themes = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(d, w, 1.0 + rng.random()) for d in range(90) for w in sorted(set(rng.choices(themes[d % 3], k=12)))]
    frame = spark.createDataFrame(rows, "row_id long, word string, weight double")
    both = frame.withColumn("seed", F.explode(F.array(F.lit(4), F.lit(9))))
    found = factorise.nmf(both, 3, rounds=25)
    assert len(found.losses) > 2 and all(a[s] >= b[s] - 1e-9 for a, b in zip(found.losses, found.losses[1:]) for s in (4, 9))
    labels = {}
    for r in factorise.labelled(found.documents).collect():
        labels.setdefault(r.seed, {})[r.row_id] = r.topic
    for own in labels.values():
        assert len(own) == 90 and all(own[d] == own[d % 3] for d in own) and len(set(own.values())) == 3
    # The last factors give the loss that the next round would report: the product itself.
    w, h = {}, {}
    for r in found.documents.filter("seed = 4").collect():
        w.setdefault(r.row_id, {})[r.topic] = r.weight
    for r in found.words.filter("seed = 4").collect():
        h.setdefault(r.word, {})[r.topic] = r.weight
    v = {(d, x): y for d, x, y in rows}
    error = sum((v.get((d, x), 0.0) - sum(w[d][t] * h[x][t] for t in range(3))) ** 2 for d in w for x in h)
    assert error <= found.losses[-1][4] + 1e-6 and error < 0.7 * sum(y * y for y in v.values())
    assert {r.seed for r in factorise.nmf(frame, 2, seed=7, rounds=2).documents.collect()} == {7}
