"""Small tables with nulls, empties, ties, repeated rows, extra columns and no rows, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import corpus, prose, shingles, table
from pyspark.sql import functions as F

from strandline.llm import common, exact, ftrl, graphs, langid, minhash, mixing, quality, textvec, toxicity

def test_exact(spark):
    rows = corpus() + [(7, corpus()[7][1], "en", "a"), (None, corpus()[7][1], "en", "a"), (None, "only here", "en", "a")]
    df = table(spark, rows)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in exact.classes(df).collect())
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        want.append((str(i), str(min([j for j in ids if j is not None], default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert exact.classes(df.limit(0)).count() == 0


def test_fingerprints_combine():
    r = np.random.Generator(np.random.PCG64(3))
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        body = r.integers(0, 256, n).astype(np.uint8)
        whole = exact.prints(body, np.array([0, n]))[:, 0]
        for k in {0, n // 3, n}:
            left, right = exact.prints(body[:k], np.array([0, k]))[:, 0], exact.prints(body[k:], np.array([0, n - k]))[:, 0]
            assert exact.combine(tuple(map(int, left)), tuple(map(int, right)), k) == tuple(map(int, whole))


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows = [(1, "aa", "en", "a"), (2, "bb", "en", "a"), (3, "aa", "en", "a"), (4, "bb", "en", "a")]
    real = exact._prints

    def same(with_text):
        def run(batches):
            for b in real(with_text)(batches):
                yield b.set_column(b.schema.get_field_index("fp"), "fp", textvec.pa.array([5] * b.num_rows, textvec.pa.int64()))

        return run

    monkeypatch.setattr(exact, "_prints", same)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.classes(table(spark, rows)).collect()) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2)]


@pytest.mark.parametrize("short", [32, 1])
def test_minhash(spark, monkeypatch, short):
    monkeypatch.setattr(minhash, "LIST", short)  # 1: every list is a long one
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), 3, 85).collect()}
    sets = {i: shingles(t, 3) for i, t, *_ in rows}
    low = {i: i for i in sets}
    again = True
    pairs = [(i, j) for i, j in combinations(sets, 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while again:
        again = False
        for i, j in pairs:
            m = min(low[i], low[j])
            again |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    assert got == {i: (len(sets[i]), low[i]) for i in sets}
    assert minhash.near_duplicates(table(spark, rows).limit(0), 3, 85).count() == 0


def crowd(seed):
    """One text of 120 words in 90 variants, nearly similar enough, some of them with variants of their own, ids null or
    repeated, and one text beyond a piece of the word cutter."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in r.sample(range(120), r.choice([3, 4, 5, 6, 7, 8])):
            words[at] = f"x{r.randint(0, 40)}"
        rows.append((k, " ".join(words), "en", "a"))
        if k % 5 == 0:
            for j in range(3):
                words[r.randint(0, 119)] = f"y{r.randint(0, 9)}"
                rows.append((1000 + 10 * k + j, " ".join(words), "en", "a"))
    long = " ".join(f"l{k}" for k in range(5000))
    return rows + [rows[3], (None, rows[8][1], "en", "a"), (5000, long, "en", "b"), (5001, long + " more", "en", "b")]


@pytest.mark.parametrize("short, depth", [(8, 1), (1, 2), (3, 0)])
def test_minhash_crowds(spark, monkeypatch, short, depth):
    monkeypatch.setattr(minhash, "LIST", short)
    monkeypatch.setattr(minhash, "DEPTH", depth)
    monkeypatch.setattr(textvec, "PIECE", 6000)
    rows = crowd(5)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), 3, 85).collect())
    sets = [shingles(t, 3) for _, t, *_ in rows]
    ids = [i for i, *_ in rows]
    root = list(range(len(rows)))
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    low = {}
    for i, k in enumerate(root):
        low[k] = min([x for x in (low.get(k), ids[i]) if x is not None], default=None)
    assert got == sorted((str(ids[i]), len(sets[i]), low[k]) for i, k in enumerate(root))
    assert len(set(root)) > 10


@pytest.mark.parametrize("local", [500_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL_EDGES", local)
    r = random.Random(5)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x.node: x.comp for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == low


def test_mixing(spark):
    rows = corpus(3)
    out = mixing.plan(table(spark, rows)).collect()
    size = {}
    for x in out:
        size.setdefault(x.source, x.source_size)
        assert 0 <= x.copies <= 3
    target = {x.source: x.target for x in out}
    assert sum(size.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows)
    weight = dict(zip(["a", "b", "c", None], [1, 2, 3, 1]))
    held, total = set(), sum(size.values())
    while True:  # share out, hold, and share out again
        rest, w = total - sum(3 * size[s] for s in held), sum(weight[s] for s in size if s not in held)
        more = {s for s in size if s not in held and rest * weight[s] / w > 3 * size[s]}
        if not more:
            break
        held |= more
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in held else rest * weight[s] / w)
        largest = max(x["size"] for x in out if x.source == s)
        assert abs(sum(x.copies * x["size"] for x in out if x.source == s) - target[s]) <= largest / 2 + 1e-6
    assert sorted(map(str, mixing.plan(table(spark, rows)).collect())) == sorted(map(str, out))
    assert mixing.plan(table(spark, rows).limit(0)).count() == 0
    assert [x.copies for x in mixing.plan(table(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()] == [0, 0]


def test_language(spark):
    rows = corpus(4)
    df = table(spark, rows)
    model = langid.learn(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), model).collect()}
    for i in (900, 901, 902, 903):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    seen = [(got[i].lang_pred == lang, got[i].rejected) for i, t, lang, _ in rows if i < 120 and i % 3 == 1]
    assert np.mean([x for x, _ in seen]) > 0.95 and np.mean([y for _, y in seen]) < 0.1
    none = langid.learn(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df.select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.predict(df.select("doc_id", "text").limit(0), model).count() == 0


def test_language_model_sums_to_one():
    r = np.random.Generator(np.random.PCG64(1))
    x = r.integers(1, 6, 3000).astype(np.uint32)
    code, n = np.unique(langid.grams(x, np.array([0, len(x)]), 4)[0], return_counts=True)
    p = langid._kneser_ney(code, n.astype(float))
    model = langid.Model(["x"], [None, *(np.sort(textvec.mix(g)) for g in p["gram"][1:])], [None], [None], np.array([p["floor"]]), np.array([np.inf]))
    for k in range(1, 5):
        order = np.argsort(textvec.mix(p["gram"][k]))
        model.logs.append(p["log"][k][order].astype(np.float32)[:, None])
        back = np.zeros((len(order), 1), np.float32)
        if k < 4:
            at = np.searchsorted(p["context"][k], p["gram"][k])
            ok = (at < len(p["context"][k])) & (p["context"][k][np.minimum(at, len(p["context"][k]) - 1)] == p["gram"][k])
            back[ok, 0] = p["back"][k][at[ok]]
        model.back.append(back[order])
    model.hashes[0] = np.zeros(0, np.uint64)
    s = langid.Scorer(model)
    for context in (0x000100020003, 0x000500010004):
        probs = np.exp(s._order(4, np.array([context << 16 | c for c in range(1, 6)], np.uint64)))
        assert probs.sum() == pytest.approx(1, abs=0.01)


def labelled(seed, n, bad):
    r = random.Random(seed)
    return [(i, prose(r, "en", 40) if i % 3 else bad(r), "en", "a") for i in range(n)]


def test_quality(spark):
    rows = labelled(6, 150, lambda r: "".join(w.upper() + "!! " for w in prose(r, "en", 30).split(" "))) + [(900, None, "en", "a"), (901, "", "en", "a")]
    df = table(spark, rows)
    labels = df.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("label")).where("doc_id % 5 <> 0")
    w, bias = quality.learn(df, labels.unionByName(spark.createDataFrame([(900, None), (None, 1)], "doc_id long, label int")))
    got = {r.doc_id: r.score for r in quality.score(df.select("doc_id", "text"), w, bias).collect()}
    assert all((got[i] >= 0.5) == (i % 3 != 0) for i in range(0, 150, 5)) and got[900] == got[901]
    w, bias = quality.learn(df, labels.where("false"))
    assert {r.score for r in quality.score(df.select("doc_id", "text"), w, bias).collect()} == {0.5}
    assert quality.score(df.select("doc_id", "text").limit(0), w, bias).count() == 0


def test_toxicity_reads_through_disguises(spark):
    clean = "the scoundrel walked along the river and the scoundrel sang of summer"
    rows = [(i, clean if i % 2 else "a quiet walk along the river in summer and a song", "en", "a") for i in range(60)]
    df = table(spark, rows)
    cost = toxicity.language(toxicity.trigrams(df))
    d = toxicity.Decoder(cost)
    for word in ("sc0undr3l", "s.c.o.u.n.d.r.e.l", "scoooundreeel", "$coundre1", "s c o u n d r e l"):
        assert d.restore(word) == "scoundrel", word
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    w, bias = toxicity.learn(df, labels, cost)
    test = table(spark, [(1, "what a sc0undr3l he is", "en", "a"), (2, "a s c o u n d r e l", "en", "a"), (3, "a quiet song", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a")])
    got = {r.doc_id: r.score for r in toxicity.score(test.select("doc_id", "text"), cost, w, bias).collect()}
    assert got[1] >= 0.5 and got[2] >= 0.5 and got[3] < 0.3 and got[4] == got[5]


def test_ftrl_learns_a_rule():
    r = np.random.Generator(np.random.PCG64(2))
    rows = [(np.array([k % 7, 10 + k % 3]), np.ones(2), int(k % 7 < 3)) for k in r.integers(0, 1000, 400)]
    w, bias = ftrl.Ftrl(bits=6).fit(rows)
    assert all((w[i] @ x + bias > 0) == y for i, x, y in rows)


def test_clean_words_stay_and_paths_are_the_best(spark):
    """The lattice's every path on short words; and words of four languages that aren't disguised."""
    clean = "peut-être l'état well-known mother-in-law 3rd ciónasarrr schön größe don't año 21st übermäßig naïve".split()
    words = clean + "the state well known mother in law idiot third stupid peut etre schon grosse garçon".split()
    df = spark.createDataFrame([(k, " ".join(words[k % 7 :] + words)) for k in range(40)], "doc_id long, text string")
    cost = toxicity.language(toxicity.trigrams(df))
    d = toxicity.Decoder(cost)
    assert {w: d.restore(w) for w in clean if w != "ciónasarrr"} == {w: w for w in clean if w != "ciónasarrr"}
    assert [d.restore(w) for w in ("1d10t", "i.d.i.o.t", "st00pid", "idiiiot", "i d i o t")][::4] == ["idiot", "idiot"]
    for word in ("1d10t", "l'é4", "a--b", "3rd", "id!0t"):
        found = []

        def walk(k, a, b, total, out):
            if k == len(word):
                found.append((total + d.step(a, b, 0), out))
                return
            for c, channel, said in d.options(word, k):
                if c < 0:
                    walk(k + 1, a, b, total + channel, out)
                else:
                    walk(k + 1, b, c, total + channel + d.step(a, b, c), out + said)

        walk(0, 0, 0, 0.0, "")
        best = min(found)
        assert abs(min(t for t, o in found if o == d.restore(word)) - best[0]) < 1e-9


def test_trigrams_do_not_cross_texts(spark):
    texts = ["abc", "", None, "de", "f", "ghij k", "abcabc"]

    def counted(df):
        return {r.code: r.n for r in toxicity.trigrams(df).collect()}

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        c = [0, 0] + [ord(x) - 96 if x.isalpha() else 0 for x in t or ""]
        for k in range(2, len(c)):
            code = c[k - 2] * 729 + c[k - 1] * 27 + c[k]
            want[code] = want.get(code, 0) + 1
    assert counted(df.coalesce(1)) == counted(df.repartition(7)) == want
