"""Chat trees, periodic runs and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lexiquarry.llm import chat_tree, importance, periodic_runs

SAID = ["hi", "", "\\### Assistant: </turn> ok", "a\\b\\h\\t", "#####", "</turn>\n### user: x", "zwölf ✓", "###: </turn>\n"]
CONV = "conv_id long, turn long, role string, text string, tokens string, n long, key string"


def conversations():
    """Ten openings shared by many conversations, copies, prefixes of others, odd roles, a long one."""
    rng, rows = random.Random(4), []
    openings = [[(rng.choice(["system", "user", "a: b", "##", None]), rng.choice(SAID)) for _ in range(rng.randint(1, 4))] for _ in range(10)]
    for c in range(150):
        turns = rng.choice(openings)[: rng.randint(1, 4)] + [(rng.choice(["user", "assistant"]), rng.choice(SAID)) for _ in range(rng.randint(0, 3))]
        rows += [(c, 3 * k, role, said, "t", 1, "k") for k, (role, said) in enumerate(turns)]
    rows += [(None, k, "assistant", None, "t", 1, "k") for k in range(3)] + [(900, None, "user", "first", "t", 1, "k"), (900, 1, "assistant", "same", "t", 1, "k"), (900, 1, "assistant", "same", "t", 1, "k")]
    rows += [(901, k, ("user", "assistant")[k % 2], f"word {k} " * 40, "t", 1, "k") for k in range(300)] + [(902, 0, "assistant", "long ü" * 30_000, "t", 1, "k")]
    rng.shuffle(rows)
    return rows


def grouped(rows):
    out = {}
    for c, t, role, said, *_ in rows:
        out.setdefault(c, []).append((-1 if t is None else t, role or "", said or ""))
    return {c: [(r, s) for _, r, s in sorted(turns)] for c, turns in out.items()}


def test_chat_digests(spark):
    rows = conversations()
    out = {r.conv_id: r for r in chat_tree.digests(chat_tree.format_tree(spark.createDataFrame(rows, CONV).repartition(3))).collect()}
    want = grouped(rows)
    assert set(out) == set(want)
    for c, turns in want.items():
        learned = "".join(s for r, s in turns if r == "assistant")
        said = "".join(f"{r}\n{s}\n" for r, s in turns)
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_tree.digests(chat_tree.format_tree(spark.createDataFrame([], CONV))).count() == 0


def test_chat_layout(spark):
    """Sequences are gapless, each shared token is there once, and the intervals and positions lead along each path."""
    rows = conversations()
    forest = chat_tree.format_tree(spark.createDataFrame(rows, CONV))
    segments = forest.segments.collect()
    sequences = {}
    for s in sorted(segments, key=lambda s: (s.sequence, s.start)):
        line = sequences.setdefault(s.sequence, bytearray())
        assert s.start == len(line) and s.n_tokens == len(s.tokens)
        line += s.tokens
    def plain(x, more=()):
        for a, b in (("\\", "\\b"), ("</turn>", "\\t"), ("##", "\\h"), *more):
            x = x.replace(a, b)
        return x
    paths = {c: [f"### {plain(r, [(':', chr(92) + 'c')])}: {plain(s)}</turn>\n".encode() for r, s in turns] for c, turns in grouped(rows).items()}
    nodes = {tuple(p[: k + 1]): len(p[k]) for p in paths.values() for k in range(len(p))}
    assert sum(map(len, sequences.values())) == sum(nodes.values()) and len(sequences) == len({p[0] for p in paths.values()})
    by_owner = {s.owner: s for s in segments}
    for m in forest.members.collect():
        s, line = by_owner[m.owner], sequences[by_owner[m.owner].sequence]
        above = b"".join(bytes(line[a.lo : a.hi]) for a in s.ancestors)
        assert len(above) == s.position and (above + bytes(s.tokens) == b"".join(paths[m.conv_id]) or m.conv_id == 900)


@pytest.mark.parametrize("seed", range(20))
def test_walk_in_ranges(seed):
    """A walk cut into ranges that start from each other's ends is the walk in one."""
    rng = random.Random(seed)
    digest = [bytes([k]) * chat_tree.DIGEST for k in range(3)]
    paths = sorted({b"".join(rng.choices(digest, k=rng.randint(1, 6))) for _ in range(60)})
    lengths = [[p[k] + 1 for k in range(0, len(p), chat_tree.DIGEST)] for p in paths]
    one = chat_tree.Walk()
    want = [one.step(str(i), p, n) for i, (p, n) in enumerate(zip(paths, lengths))]
    cuts = sorted(rng.sample(range(1, len(paths)), 5))
    walk, got = chat_tree.Walk(), []
    for a, b in zip([0, *cuts], [*cuts, len(paths)]):
        begin = chat_tree.Walk(walk.offset, walk.path, walk.pieces)
        got += [begin.step(str(i), paths[i], lengths[i]) for i in range(a, b)]
        alone = chat_tree.Walk()
        for i in range(a, b):
            alone.step(str(i), paths[i], lengths[i])
        walk = walk.follow(str(a), paths[a], [sum(lengths[a][:k]) for k in range(len(lengths[a]) + 1)], alone)
        assert (walk.offset, walk.pieces) == (begin.offset, begin.pieces)
    assert got == want


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def texts():
    rng, out = random.Random(8), []
    for k in range(150):
        w = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
                w += (unit * 40)[: rng.randint(10, 120)]
            else:
                w += rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(1, 60))
        if k % 3 == 0:
            w = w + w + w
        out.append(w)
    return out


def test_runs_of_words():
    for w in [*texts(), ["a"] * 500, list("ab") * 200, list("aab") * 8, list("abcdefgh") * 3, list("abcdefgh") * 3 + ["a"], list("abcdefghi") * 2 + list("abcdefg")]:
        assert periodic_runs.find_runs([x.encode() for x in w]) == brute_runs(w)


def test_periodic_query(spark, tmp_path):
    rows = [(k, " ".join(w) + ("\n\t " if k % 2 else "")) for k, w in enumerate(texts())] + [(1000, None), (1001, ""), (None, "x " * 40), (3, "a b " * 30), (3, "a b " * 30), (1002, "é è " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and w and h % 10 == 0:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs = brute_runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sum(w[1] > 0 for w in want) > 50 and sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_runs_columns(spark):
    d = spark.createDataFrame([(1, "x y " * 20, 7, 8)], "doc_id string, text string, runs int, _input int")
    r = periodic_runs.collapse(d).first()
    assert (r.doc_id, r.n_words, r.collapsed) == ("1", 40, "x y") and [tuple(x) for x in r.runs] == [(0, 40, 2)]
    assert periodic_runs.collapse(d.limit(0)).count() == 0


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_importance(rows, target, longest, buckets):
    def found(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(code(f) for _, x in rows for f in found(x)), Counter(code(f) for x in target for f in found(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + buckets) / ((s[k] + 1) * (n_t + buckets)))) for k in range(buckets)]
    out = []
    for i, x in rows:
        own = [gain[code(f)] for f in found(x)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))])
    pool = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    ranks = Counter()
    for k, r in enumerate(pool[: 10 * len(pool) // 100]):
        ranks[(*r[:4], k + 1)] += 1
    for r in [r for r in out if r[4] < 20] + pool[10 * len(pool) // 100 :]:
        ranks[(*r[:4], None)] += 1
    return ranks


@pytest.mark.parametrize("longest", [1, 2])
def test_importance(spark, longest):
    rng = random.Random(6)
    vocabulary = ["Alpha", "beta", "İx", "été", "x9", "l'eau", "naïve-té", "ZZ"] + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(300)] + [(None, "beta " * 30), (500, None), (501, ""), (7, "beta " * 5000)] + [(600, "w1 w2 " * 30)] * 200
    target = ["w1 w2 w3 beta " * 10, None, "Alpha"]
    d = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "doc_id long, text string, score int, _w string")
    b = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.resample(d, b, longest=longest, buckets=500).collect()
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out)
    assert got == brute_importance(rows, target, longest, 500)
    assert importance.resample(d.limit(0), b).count() == 0 and {r["rank"] for r in importance.resample(d.filter("doc_id >= 500 AND doc_id < 600"), b.limit(0)).collect()} == {None}
