"""op11_codes against a plain version, on small tables with every defined case."""

import hashlib
import math
import random

from strandline.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double, n int, v string"


def brute(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    size = len(min(rows, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    if not size or size % parts:
        return []
    most, w = vectorcodes.bound(size), size // parts
    rows = [(i, [int(math.floor(min(max(4096 * x, -most), most))) for x in v], label) for i, v, label in rows if len(v) == size]
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))[:entries]
    first = [min(v for j, v, _ in rows if j == i) for i in ids]
    cut = lambda v, p: tuple(v[p * w : (p + 1) * w])
    books = [[cut(v, p) for v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(books[p][e], x), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in rows:
                held[near(p, cut(v, p))].append(cut(v, p))
            new.append([tuple(sum(c) // len(h) for c in zip(*h, strict=True)) if h else books[p][e] for e, h in enumerate(held)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in rows:
        codes = [near(p, cut(v, p)) for p in range(parts)]
        error = sum(dist(books[p][c], cut(v, p)) for p, c in enumerate(codes))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=str)


def ours(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0, 2, "y") for r in rows], SCHEMA)
    coded, books = vectorcodes.encode(df)
    out = vectorcodes.with_label_errors(coded).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, vectorcodes.digest(books)) for r in out), key=str)


def vectors(seed, n, size=16):
    r = random.Random(seed)
    return [(i, [r.choice([-1, 1]) * r.random() for _ in range(size)], r.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_are_those_of_the_plain_version(spark):
    rows = vectors(1, 90)
    rows += [(200 + i, rows[3][1], 1) for i in range(60)]  # a hot vector
    rows += [rows[5], (5, rows[6][1], 2), (None, rows[7][1], None), (-4, [0.0] * 16, None)]  # repeated rows and ids, a null id
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 0), (304, [0.5] * 8, 0), (305, [], 0), (306, [3e38, -3e38] * 8, 0)]
    rows += [(400 + i, [0.25] * 8 + rows[i][1][8:], 0) for i in range(40)]  # hot parts of different vectors
    assert ours(spark, rows) == brute(rows)


def test_few_vectors_and_ties(spark):
    rows = [(3, [0.5] * 16, 0), (1, [-0.5] * 16, 0), (2, [0.0] * 16, 0), (7, [0.25] * 16, None)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows[:1]) == brute(rows[:1])


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0] * 12, 0)]):
        assert ours(spark, rows) == []


def test_labels_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    rows = vectors(2, 50)
    assert ours(spark, rows) == brute(rows)
