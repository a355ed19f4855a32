"""op12_spelling against a plain version."""

import random
import re
import zlib

import pytest

from strandline.llm import spelling


def brute(docs):
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def ours(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, word string, n int, root int")
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(df).collect())


def documents(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice(["an", "be", "é", "ÿor", "th", "Ing"]) for _ in range(r.randint(3, 6))) for _ in range(60)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(60):
            w = stems[min(r.randint(0, 59), r.randint(0, 59), r.randint(0, 59))]
            if r.random() < 0.3:
                k = r.randint(0, len(w) - 1)
                w = w[:k] + r.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
            text.append(w)
        docs.append((i, r.choice([" ", ", ", "\n", "1"]).join(text)))
    return docs


def test_groups_are_those_of_the_plain_version(spark):
    docs = documents(1)
    docs += [(None, docs[0][1]), (None, None), (500, ""), (501, "×÷ab ñ"), docs[3], (502, "ABCDEFG abcdefg abcdefh ÀÀÀÀÀÀÀ ààààààà"), (503, "abcdefg")]
    want = brute(docs)
    assert ours(spark, docs) == want
    assert any(w[1] and w[2] != w[1] for w in want) or any(w[1] for w in want)


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_hot_segments_are_spread(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "LIMIT", limit)
    docs = documents(2)
    assert ours(spark, docs) == brute(docs)


def test_chains_of_forms(spark):
    docs = [(i, " ".join(["abcdefg"] * 3000 + ["abcdefgh"] * 250 + ["abcdefghi"] * 22 + ["abcdefghij"] * 2)) for i in range(1)]
    got = {r[0]: r[2] for r in ours(spark, docs)}
    assert ours(spark, docs) == brute(docs) and got["abcdefghij"] == "abcdefg"


def test_very_long_words_and_nothing(spark):
    long = "ab" * 1_500
    docs = [(i, w) for i, w in enumerate([long, long + "c", "x" + long, long[:1000] + "z" + long[1001:]] * 3)]
    docs += [(100 + i, (("k" * n) + " ") * m) for i, (n, m) in enumerate([(64, 30), (65, 3), (66, 2), (127, 40), (128, 3), (129, 4), (130, 50), (200, 4), (201, 30)])]
    want = brute(docs)
    assert ours(spark, docs) == want and max(r[4] for r in want) >= 3
    whole = "q" * 300_000
    assert max(len(r[0]) for r in ours(spark, [(i, whole) for i in range(6)])) == 300_000
    assert ours(spark, []) == [] and ours(spark, [(1, None), (2, "short")]) == []


def test_near():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(2))
        cuts = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
        want = a != b and (a in cuts(b) or b in cuts(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)
        assert spelling.near(a, b) == want
