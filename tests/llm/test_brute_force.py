"""Fingerprints, language ID and toxicity against plain loops over bytes, words and dicts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiquarry.llm import fingerprints, language_id, toxicity

ROW = "doc_id long, text string"


def gear_chunks(text):
    """The distinct chunks of a text, byte by byte: hash, then size rules, then mask."""
    raw, begin, out = text.encode(), 0, {}
    while begin < len(raw):
        end = min(len(raw), begin + 128)
        if len(raw) - begin > 16:
            for i in range(begin + 15, end - 1):
                h = 0
                for b in raw[max(0, i - 31) : i + 1]:
                    h = (h * 2 + int(fingerprints.GEAR[b])) % 2**32
                if h >> 28 == 0 and (i + 1 - begin >= 32 or h >> 25 == 0):
                    end = i + 1
                    break
        out[xxhash.xxh3_64_intdigest(raw[begin:end])] = end - begin
        begin = end
    return out


def share(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abcdef  é中\n", k=rng.choice([0, 1, 15, 17, 90, 400, 1500]))) for _ in range(50)]
    ids = [7] * 40 + [None] * 40 + list(range(8, 60)) + [2**60 + k for k in range(5)]
    rows = [(i, rng.choice([*texts, None])) for i in ids] + [(70, "twice")] * 3
    d = spark.createDataFrame(rows, ROW).repartition(3)
    hashed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    expected = []
    for r, following in zip(order, order[1:] + order[:1]):
        m = len(r.t) // 3
        edit = r.t[: len(r.t) - m] + following.t[:m]
        own, new, other = gear_chunks(r.t), gear_chunks(edit), gear_chunks(following.t)
        as_text = [",".join(f"{k:016x}:{n}" for k, n in sorted(c.items())) for c in (own, new)]
        expected.append((r.doc_id, len(r.t), hashlib.sha256(edit.encode()).hexdigest(), *as_text, share(own, new), share(own, other)))
    got = [tuple(r) for r in fingerprints.fingerprint_neighbours(d).collect()]
    assert Counter(got) == Counter(expected)


def test_ranges():
    """Hot ids and null ids are cut by hash, and the numbers follow the order of id and hash."""
    ranges = fingerprints.Ranges([3.0, 5.0, 5.0, 5.0, 9.0, 2.0**60, 2.0**60], 4)
    rng = random.Random(3)
    rows = [(i, rng.randrange(-(2**63), 2**63)) for i in [*[5] * 50, *[None] * 50, 3, 4, 6, 9, 10, 1, 2**60 + 1, 2**60]]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    numbers = ranges.number(pd.Series([i for i, _ in rows], dtype="Int64"), np.array([h for _, h in rows])).tolist()
    assert numbers == sorted(numbers)
    assert len({n for n, (i, _) in zip(numbers, rows) if i == 5}) == 3 and len({n for n, (i, _) in zip(numbers, rows) if i is None}) == 4


def grams(text):
    """Hashed 1- to 3-grams of the bytes, signs and digits blank."""
    raw = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            out[(int.from_bytes(raw[i : i + n], "big") + n) * 2654435761 % 2**32 >> 20] += 1
    return out


def test_language_id(spark):
    """Document frequencies, vectors and cosines with dicts; repeated rows, a long text and clashing names."""
    rng = random.Random(8)
    sound = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ei", "ä"]}
    rows = [(i, " ".join("".join(rng.choices(sound[g], k=3)) for _ in range(30)), g, i) for i in range(80) for g in [("en", "de")[i % 2]]]
    d = spark.createDataFrame(rows + [rows[5], rows[5], (90, rows[3][1] * 3000, None, 1), (91, "42", None, 2)], "doc_id long, text string, lang string, _p long")
    model = language_id.train(d, centroids=1)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counted = [(g, grams(t)) for _, t, g, _ in learned]
    df = Counter(k for _, c in counted for k in c)
    idf = {k: math.log((1 + len(learned)) / (1 + df.get(k, 0))) + 1 for k in range(language_id.DIMENSIONS)}

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    centres = {}
    for g in sound:
        total = Counter()
        for own, c in counted:
            if own == g:
                total.update(unit({k: math.log1p(n) * idf[k] for k, n in c.items()}))
        centres[g] = unit(total)
    out = language_id.identify(d, model).collect()
    assert len(out) == 84 and sorted(r._p for r in out if r.doc_id < 80) == sorted([*range(80), 5, 5])
    for r in out:
        if r.doc_id == 91:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        own = unit({k: math.log1p(n) * idf[k] for k, n in grams(r.text).items()})
        score, lang = max((sum(x * c.get(k, 0.0) for k, x in own.items()), g) for g, c in centres.items())
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_chain_by_hand(spark):
    """Each link's probability from the words' weights and the links before it, added up with dicts."""
    rng = random.Random(6)
    words = [f"word{chr(97 + k)}" for k in range(12)]
    texts = [(i, " ".join(rng.choices(words, k=9) + (["vile", "awful"] if i % 3 == 0 else []))) for i in range(120)]
    d = spark.createDataFrame([*texts, (500, None), (501, "")], ROW)
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 2) for i in range(120)], "doc_id long, toxic boolean, quality int")
    chain, _ = toxicity.train(d, labels)
    weight = {w: [link[k] for link in chain.weights] for w, k in chain.words.items()}
    assert weight
    for r in toxicity.score(d, chain).collect():
        found = {w.lower() for w in (r.text or "").split()}
        found |= {w[:k] + "-" for w in found for k in (4, 5) if len(w) > k}
        before = []
        for j, name in enumerate(chain.names):
            z = sum(weight[w][j] for w in found if w in weight) + chain.weights[j][len(weight)] + sum(x * y for x, y in zip(chain.weights[j][len(weight) + 1 :], before))
            before.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
            assert r[f"p_{name}"] == pytest.approx(before[-1], abs=1e-9)
        assert r.toxic == (before[-1] >= toxicity.THRESHOLD)
