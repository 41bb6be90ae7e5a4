"""The operators against brute force, with nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import fingerprints, language_id, line_dedup, mixing, ngram_join, quality_rules, sentencepiece_fst, sharding, toxicity, warc_fixity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0, "clash"))
    base = rows[3][1]
    rows += [(60, base, "en", "a", 0, "c"), (61, base + " extra", "en", "a", 0, "c"), (62, None, None, None, None, None), (63, "", "en", "b", 0, "x")]
    rows += [(64, "one", "en", "b", 0, "x"), (65, " \n\t\n", "en", "b", 0, "x"), (66, "word " * 30_000, "en", "b", 0, "x"), (60, base, "en", "a", 0, "c"), (None, "no id here at all", "en", "a", 0, "c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none):
    rows = sharding.shard_manifest(docs, 7).collect()
    assert len(rows) == len(corpus()) and sorted(r.row_number for r in rows) == list(range(len(rows)))
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(len([r for r in rows if r.shard == s])))
    for r in rows:
        assert sharding.row_at(r.shard, r.slot, len(rows), 7) == r.row_number and sharding.place(r.row_number, len(rows), 7) == (r.shard, r.slot)
    by_id = {i: t for i, t, *_ in corpus()}
    assert all(r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in rows)
    again = sharding.shard_manifest(docs.repartition(5), 7).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shard_manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    x = np.arange(n)
    assert sorted(sharding.permute(x, n, 3)) == list(range(n)) and (sharding.permute(sharding.permute(x, n, 3), n, 3, invert=True) == x).all()


def test_quality(docs, none):
    rows = {(r.doc_id, r.text): r for r in quality_rules.line_frequency_rules(docs).collect()}
    for (_, text), r in rows.items():
        w = (text or "").split()
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        marked = {j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(i, i + 8)} if len(w) < 2000 else set(range(len(w)))
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(marked), sum(map(len, w)))
        assert r.base_failed == (len(w) < 20 or 100 * len(marked) > 30 * len(w))
    assert quality_rules.line_frequency_rules(none).count() == 0


def test_depleted(spark):
    body = "\n".join(" ".join(WORDS[i : i + 6]) for i in range(10))
    rows = [(i, body, "en", "h", 0, "x") for i in range(30)] + [(100, "\n".join(" ".join(WORDS[::-1][i : i + 7]) for i in range(9)), "en", "h", 0, "x")]
    out = {r.doc_id: r for r in quality_rules.line_frequency_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[0].kept and out[0].clean_text == "" and out[100].kept and out[100].removed_chars == 0


def test_quality_counts_documents(spark):
    """Forty copies of one row are one document; other columns stay, whatever their names."""
    body = "\n".join(" ".join(WORDS[i : i + 6]) for i in range(10))
    d = spark.createDataFrame([(1, body, "h", 7, 8, 9)] * 40 + [(2, "other " * 25, "h", 7, 8, 9)], "doc_id long, text string, source string, _row int, _w int, _gone int")
    out = quality_rules.line_frequency_rules(d).collect()
    assert len(out) == 41 and all(r.kept == (r.doc_id == 1) and (r._row, r._w, r._gone) == (7, 8, 9) for r in out) and all(r.removed_chars == 0 for r in out)


def targets(sizes):
    """Source targets by repeated sharing: 150 % of all, twice a source's size at most."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    left, out, capped = 1.5 * sum(sizes.values()), {}, set()
    while len(capped) < len(names):
        share = {x: left * weight[x] / sum(weight[y] for y in names if y not in capped) for x in names if x not in capped}
        over = [x for x in share if share[x] > 2 * sizes[x]]
        if not over:
            return out | share
        for x in over:
            out[x] = 2.0 * sizes[x]
            left -= out[x]
            capped.add(x)
    return out


def test_mixing_targets(docs):
    rows = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(sizes)
    largest = max(r["size"] for r in rows)
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] for r in rows)
    assert all(abs(taken[x] - want[x]) <= largest for x in sizes)


def test_apply_mix(spark, docs, none):
    plan = mixing.mix(docs)
    out = mixing.apply_mix(docs, plan)
    assert out.columns == docs.columns and out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.apply_mix(none, mixing.mix(none)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus()) and all(r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert {(r.doc_id, r._text, r.copies) for r in rows} == {(r.doc_id, r._text, r.copies) for r in mixing.mix(docs.repartition(2)).collect()}
    assert mixing.mix(none).count() == 0


def test_flight():
    rng = np.random.default_rng(1)
    p, s = np.full(200, 0.37), rng.integers(1, 90, 200)
    q = mixing.flight(p, s, rng)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * s).sum() == pytest.approx((p * s).sum())


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=30)) + (" you idiot and pathetic scum" if i % 4 == 0 else ""), "en", "a", 0, "x") for i in range(200)]
    d = spark.createDataFrame([*rows, (900, None, "en", "a", 0, "x")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain, held = toxicity.train(d, labels)
    assert ((held.p_toxic >= 0.5) == (held.toxic == 1)).mean() > 0.97
    out = {r.doc_id: r.toxic for r in toxicity.score(d, chain).collect()}
    assert all(out[i] == (i % 4 == 0) for i in range(200)) and not out[900]
    assert toxicity.score(none, chain).count() == 0
    assert chain.names == ("poor", "kind_1", "kind_2", "kind_3", "toxic")
    texts = [r[1] for r in rows[:40]]
    cut = toxicity.Chain(chain.words, chain.names, (*chain.weights[:-1], np.concatenate([chain.weights[-1][:-4], np.zeros(4)])))
    p, q = (c.probabilities(c.matrix(texts))[:, -1] for c in (chain, cut))
    assert np.abs(np.log(p / (1 - p)) - np.log(q / (1 - q))).max() > 0.5  # of the log odds, as the rows are told apart easily
    odd = spark.createDataFrame([("a", "alpha " * 30_000), ("b", ""), ("b", ""), (None, "you idiot and pathetic scum")], "doc_id string, text string")
    assert odd.count() == toxicity.score(odd, toxicity.train(odd, spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int"))[0]).count()
    empty, _ = toxicity.train(d, labels.limit(0))
    assert toxicity.score(d, empty).filter("toxic").count() == 0


def test_sentencepiece(docs, none):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.DEFAULT_MODEL)
    for r in sentencepiece_fst.encode(docs).collect():
        assert list(r.ids) == lib.encode(r.text or "") and r.round_trip and r.n_words is not None or r.text is None
    with open(sentencepiece_fst.DEFAULT_MODEL, "rb") as f:
        machine = sentencepiece_fst.Transducer(f.read())
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("abeéß漢😀 \n\tin.,01A") for _ in range(rng.randint(0, 25)))
        assert machine.encode(t) == lib.encode(t) and machine.decode(machine.encode(t)) == t
    assert sentencepiece_fst.encode(none).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprint_neighbours(docs).collect()
    assert len(rows) == len(corpus())
    known = sorted({i: t for i, t, *_ in corpus() if i is not None and i != 60}.items(), reverse=True)
    got = {r.doc_id: r for r in rows}
    for (i, t), (j, following) in zip(known, known[1:]):
        if i - j == 1:
            t, following = t or "", following or ""
            e = fingerprints.edited(t, following)
            a, b, c = fingerprints.chunk_sets([t, e, following])
            assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].fingerprint == fingerprints.as_string(a)
            assert (got[i].near_edited, got[i].near_next) == (fingerprints.containment(a, b), fingerprints.containment(a, c))
    assert fingerprints.fingerprint_neighbours(none).count() == 0


def test_jaccard_join(spark, docs, none):
    rng = random.Random(9)
    base = rng.choices(WORDS, k=60)
    near = [(200 + i, " ".join(w if rng.random() > 0.004 * i else "new" for w in base), "en", "a", 0, "x") for i in range(40)]
    rows = [r for r in corpus() if r[0] is not None and r[0] != 66] + near
    rows = list({r[0]: r for r in rows}.values())
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_join.near_duplicates(none).count() == 0
    assert [len(x) for x in ngram_join.shingle_sets(["a b c d e f", "x " * 40, "one two", None])] == [2, 1, 1, 0]
    words = rng.choices(WORDS + [f"w{k}" for k in range(500)], k=400_000)
    parts = ngram_join.shingle_sets([" ".join(words)])[0]
    assert (parts == ngram_join._sets([" ".join(words).encode()])[0]).all() and len(parts) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    kept = ngram_join.keep_one(docs).collect()
    assert len([r for r in kept if r.doc_id in (3, 60)]) == 1


def connected(sets):
    """Each key with the least key that links reach, by brute force."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


@pytest.mark.parametrize("limit", [ngram_join.ROUND_BYTES, 1 << 10])
def test_crowded_blocks(spark, monkeypatch, limit):
    """Hundreds of texts that share a passage but don't link, near copies that do, some of them by a change of size, null ids and a long text: as brute force says."""
    monkeypatch.setattr(ngram_join, "ROUND_BYTES", limit)
    rng = random.Random(31)
    passage, near = [f"p{k}" for k in range(60)], [f"n{k}" for k in range(80)]
    texts = []
    for i in range(300):
        own = [f"d{i}x{k}" for k in range(12)]
        texts.append(" ".join(own[:6] + passage + own[6:]))
    for i in range(240):
        text = list(near)
        text[rng.randrange(80)] = f"own{i}"
        texts.append(" ".join(text))
    for i in range(60):
        texts.append(" ".join(passage + [f"p{60 + k}" for k in range(rng.randrange(60))] + [f"e{i}x{k}" for k in range(rng.randrange(9))]))
    texts.append(" ".join(rng.choices(WORDS + near, k=30_000)))
    texts.append(texts[-1] + " more words at the end of it")
    expected = connected(dict(enumerate(map(shingles, texts))))
    named = [(None if k % 50 == 7 else k, t) for k, t in enumerate(texts)]
    out = ngram_join.near_duplicates(spark.createDataFrame(named, "doc_id long, text string").repartition(4)).collect()
    members = {}
    for k, root in expected.items():
        members.setdefault(root, []).append(named[k][0])
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in members.items()}
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id is not None) == sorted((named[k][0], least[root]) for k, root in expected.items() if named[k][0] is not None)
    assert Counter(r.component_id for r in out if r.doc_id is None) == Counter(least[root] for k, root in expected.items() if named[k][0] is None)
    assert len(set(expected.values())) > 290


def test_rows_of_crowded_blocks(spark, monkeypatch):
    """Texts made of shared passages, next to none of which link: what round 2 sends grows in proportion to them."""
    sent, dealt = [], ngram_join.dealt

    def counted(crossed):
        rows = dealt(crossed)
        sent.append(rows.count())
        return rows

    monkeypatch.setattr(ngram_join, "dealt", counted)
    rng = random.Random(5)
    passages = [[f"s{p}w{k}" for k in range(50)] for p in range(30)]
    for n in (300, 600, 1200):
        texts = [(i, " ".join(w for p in rng.sample(range(30), 4) for w in passages[p])) for i in range(n)]
        expected = connected(dict((i, shingles(t)) for i, t in texts)) if n == 300 else None
        out = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
        assert len(out) == n and (expected is None or {r.doc_id: r.component_id for r in out} == expected)
    assert sent[1] < 3 * sent[0] and sent[2] < 2.4 * sent[1]


def test_keep_one_repeated_ids(spark):
    """Texts that don't link are all kept, whatever ids they share."""
    rng = random.Random(21)
    a, b, c, d = (" ".join(rng.choices(WORDS, k=40)) for _ in range(4))
    rows = [(5, a), (5, b), (6, b + " more"), (None, c), (None, d), (None, d + " more"), (None, a), (None, ""), (None, " "), (None, ""), (None, None), (8, ""), (8, "")]
    out = ngram_join.keep_one(spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], SCHEMA).repartition(3)).collect()
    got = [(r.doc_id, r.text) for r in out]
    assert sorted(t for i, t in got if i == 5) == sorted([a, b]) and not any(i == 6 for i, _ in got)
    nameless = [t for i, t in got if i is None]
    assert nameless.count(c) == 1 and (d in nameless) + (d + " more" in nameless) == 1 and a not in nameless
    assert sorted(t or "" for t in nameless if not (t or "").strip()) == ["", "", "", " "] and got.count((8, "")) == 1


def test_line_dedup(spark, docs, none):
    run = "first line here\nsecond line here\nthird line here"
    rows = [(1, f"a b c\n{run}\nend one", "en", "a", 0, "x"), (2, f"start two\n{run}\n\nlast", "en", "a", 0, "x"), (3, "\n".join(["same"] * 8), "en", "a", 0, "x")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].n_deleted_lines == 0 and out[2].text == "start two\n\nlast" and out[2].n_deleted_lines == 3 and out[3].text == "same\nsame\nsame"
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.count() == len(corpus()) and cleaned.filter("doc_id = 62").first().text is None
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_keeps_columns(spark):
    run = "first line here\nsecond line here\nthird line here"
    d = spark.createDataFrame([(1, 5, run, 6, 7, "x"), (2, 5, run, 6, 7, "y")], "doc_id long, _row int, text string, _gone int, _full int, n_lines string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert all((r._row, r._gone, r._full, r.n_lines) == (5, 6, 7, 3) for r in out.values()) and out[1].text == run and out[2].text == ""


def test_line_dedup_whole_runs(spark):
    """Against the definition: a line goes if a run of 3 lines or 50 words that holds it occurs in an earlier document."""
    rng = random.Random(11)
    pool = [" ".join([f"line{k}", *rng.choices(WORDS, k=rng.choice([2, 5, 24, 30, 55]))]) for k in range(30)]
    texts = {0: [pool[5], *pool[:4]], 1: [pool[6], *pool[:4]]}
    for i in range(2, 60):
        source = texts[rng.randrange(i)]
        a = rng.randrange(len(source))
        run = source[a : a + rng.randint(1, 5)]
        rest = rng.sample([x for x in pool if x not in run], 4)
        at = rng.randint(0, 4)
        texts[i] = rest[:at] + run + rest[at:]
    texts[60], texts[61] = ["w " * 60 + "a", "tail one"], ["w " * 60 + "a", "tail two"]
    texts[62] = list(texts[61])  # its tail repeats the second occurrence of the long line, not the first
    seen, want = set(), {}
    for i, lines in texts.items():
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if b - a >= 3 or sum(len(x.split()) for x in lines[a:b]) >= 50]
        gone = {j for a, b in runs if tuple(lines[a:b]) in seen for j in range(a, b)}
        seen |= {tuple(lines[a:b]) for a, b in runs}
        want[i] = (len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    rows = [(i, "\n".join(lines), "en", "a", 0, "x") for i, lines in texts.items()]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert want[62] == (2, "") and {r.doc_id: (r.n_deleted_lines, r.text) for r in out} == want


def test_language_id(spark, none):
    rng = random.Random(4)
    sound = {"en": ["th", "ing", "er", "wh", "sh"], "de": ["sch", "ung", "ei", "ä", "pf"]}
    rows = [(i, " ".join("".join(rng.choices(sound[g], k=3)) for _ in range(40)), g, "a", 0, "x") for i in range(300) for g in [("en", "de")[i % 2]]]
    d = spark.createDataFrame([*rows, (400, None, "en", "a", 0, "x"), (401, "123 !", None, "a", 0, "x")], SCHEMA)
    out = {r.doc_id: r for r in language_id.identify(d, language_id.train(d)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].lang_pred == ("en", "de")[i % 2] for i in held) / len(held) > 0.95
    assert out[400].lang_pred == out[401].lang_pred == "und" and out[400].rejected and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.identify(none, language_id.train(none)).count() == 0
    same = spark.createDataFrame([(1, "one text here", "en")] * 50 + [(2, f"text {i}", "en") for i in range(50)] + [(3, "ein text", "de")], "doc_id long, text string, lang string")
    assert language_id.training_sample(same, 10).count() == 11


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body " * (i % 50)) for i in range(3000)] + [(None, None, None), (7, "http://x/7", "body " * 7)], "page_id long, url string, html string")
    records = warc_fixity.layout(pages)
    first = warc_fixity.manifest(records)
    assert first.count() == 3002 and warc_fixity.audit(first, first).count() == 0
    hurt = records.withColumn("leaf", F.when(F.col("page_id").isin(5, 2900), F.lit("0" * 64)).otherwise(F.col("leaf")))
    found = warc_fixity.audit(first, warc_fixity.manifest(hurt)).join(first.drop("lo", "hi"), ["volume", "idx"]).collect()
    assert {r.page_id for r in found} == {5, 2900} and {r.status for r in found} == {"corrupt"}
    lost = warc_fixity.audit(first, warc_fixity.manifest(records.filter("page_id IS NULL OR page_id != 5")))
    assert [r.status for r in lost.collect()] == ["missing"]
    assert warc_fixity.layout(pages.limit(0)).count() == 0


def test_warc_replicas(spark, tmp_path):
    """Two page tables hashed on their own: every record that was damaged is reported, and no other."""
    rows = [(i, f"http://x/{i}", "body " * (i % 50) + str(i)) for i in range(3000)]
    rows += [(7, "http://x/7", "second of its id"), (8, "http://x/8", "twice"), (8, "http://x/8", "twice"), (None, None, None), (None, None, "no id")]
    schema = "page_id long, url string, html string"
    hurt = [(i, u, {40: "B" + (h or "")[1:], 2500: "B" + (h or "")[1:]}.get(i, "Second of its id" if h == "second of its id" else h)) for i, u, h in rows]
    first, second = (warc_fixity.layout(spark.createDataFrame(x, schema).repartition(n)) for x, n in ((rows, 3), (hurt, 5)))
    found = warc_fixity.audit(warc_fixity.manifest(first), warc_fixity.manifest(second)).collect()
    at = {(r.volume, r.idx): r.page_id for r in first.collect()}
    assert {at[r.volume, r.idx] for r in found if r.status == "corrupt"} >= {40, 2500} and {at[r.volume, r.idx] for r in found} <= {7, 40, 2500}

    lost = [r for r in hurt if r[0] != 1000 and r[2] != "no id"]
    lost.remove((8, "http://x/8", "twice"))
    lost.append((9000, "http://x/9000", "new"))
    replica = warc_fixity.replica_layout(spark.createDataFrame(lost, schema).repartition(4), first)
    assert replica.count() == len(lost) == replica.select("volume", "idx").distinct().count()
    found = warc_fixity.audit(warc_fixity.manifest(first), warc_fixity.manifest(replica)).collect()
    by = {s: sorted(at.get((r.volume, r.idx)) or 0 for r in found if r.status == s) for s in ("corrupt", "missing", "extra")}
    assert by == {"corrupt": [7, 40, 2500], "missing": [0, 8, 1000], "extra": [0]} and len(found) == 7
    held = {name: {} for name in ("a", "b")}
    for name, table in (("a", first), ("b", replica)):
        for r in table.collect():
            held[name][r.volume] = held[name].get(r.volume, 0) + r.length
    moved = {v: held["b"].get(v, 0) - held["a"].get(v, 0) for v in held["a"] | held["b"]}
    assert {r.volume: r["shift"] for r in warc_fixity.shifts(first, replica).collect()} == {v: n for v, n in moved.items() if n}
    same = warc_fixity.replica_layout(spark.createDataFrame(rows, schema).repartition(2), first)
    assert warc_fixity.audit(warc_fixity.manifest(first), warc_fixity.manifest(same)).count() == 0

    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    told = warc_fixity.op10_warc_fixity(spark, str(tmp_path)).collect()
    fate = {r.page_id: r.f for r in spark.createDataFrame(rows, schema).select("page_id", F.pmod(F.xxhash64("page_id", "url"), F.lit(997)).alias("f")).collect()}
    assert len(told) == len(rows) and all((r.status == "missing") == (fate[r.page_id] == 2) and (r.status == "corrupt") == (fate[r.page_id] in (0, 1)) for r in told)
