import hashlib
import random
from collections import Counter

import numpy as np

from strandline.llm import suffix


def brute(docs, window):
    count, bodies = Counter(), [(i, (t or "").encode()) for i, t in docs]
    for _, b in bodies:
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, b in bodies:
        cover = [False] * len(b)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                cover[k : k + window] = [True] * window
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = [word(r.randint(20, 90)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [r.choice(shared)[r.randint(0, 9) :] if r.random() < 0.5 else word(r.randint(0, 50)) for _ in range(r.randint(0, 7))]
        docs.append((i, "".join(parts)))
    return docs + [(90, None), (91, ""), (92, "x" * 300), (93, "ab" * 100), (94, docs[3][1]), (5, docs[5][1]), (None, docs[7][1])]


def test_classes_of_suffixes_are_equal_windows():
    r = np.random.Generator(np.random.PCG64(1))
    for _ in range(30):
        text = np.r_[r.integers(0, 3, 400), [255]].astype(np.uint8)
        text[200:260] = text[20:80]
        order, cls = suffix.repeats(text, 16)
        body = text.tobytes()
        by = {}
        for place, c in zip(order.tolist(), cls.tolist()):
            by.setdefault(c, set()).add(body[place : place + 16])
        assert all(len(v) == 1 for v in by.values())
        assert len(by) == len({body[k : k + 16] for k in range(len(body))})


def test_removes_what_brute_force_removes(spark):
    for seed, hot in ((1, 3000), (2, 3000), (3, 2)):
        docs = made(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
        got = sorted((tuple(r) for r in suffix.remove_repeats(df, 30, 12, hot).collect()), key=str)
        assert got == brute(docs, 30)


def test_long_rows_are_cut_in_parts(spark, monkeypatch):
    docs = made(4)
    off = np.r_[0, np.cumsum([len((t or "").encode()) for _, t in docs])]
    monkeypatch.setattr(suffix, "PART", 40)
    seen = sorted((s, e) for _, _, s, e in suffix.parts(off, 30))
    assert all(any(s <= k and k + 30 <= e for s, e in seen) for a, b in zip(off, off[1:]) for k in range(a, b - 29))


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
