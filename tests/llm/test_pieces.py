import dataclasses
import os
import random

import pytest
import sentencepiece

from strandline.llm import pieces, textvec

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not here")

TEXTS = ["", None, " ", "Hello world", "  two  spaces ", "línea\nother\n\n", "tab\tand \x00 nul", "日本語 emoji 🙂 ok", "a" * 900, "x" * 300 + " " + "é" * 500, "Don't, stop! https://a.b/c?d=1", "Hello world", "the of and thention ereshn", "under▁line"]


def long_texts(seed=3):
    r = random.Random(seed)
    words = "the of and tion ing er on an ent he re st".split()
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    return [letters, "".join(r.choice(words) for _ in range(1500)), "=" * 1000, letters[:257], letters[:256], letters[:512], letters[:513], letters[:271] + " " + letters[:300]]


def best_path(text, model):
    """The path of the largest sum over the whole text; of equal sums the one of the earlier start, seen from the end."""
    t = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    ids = {model.text[i]: i for i in range(len(model.text)) if model.normal[i]}
    longest = max(map(len, ids))
    best = [(0.0, None, None)]
    for e in range(1, len(t) + 1):
        found = None
        for s in range(max(0, e - longest), e):
            i = ids.get(t[s:e])
            if i is None and e - s > 1:
                continue
            total = best[s][0] + (model.score[i] if i is not None else model.unknown)
            if found is None or total > found[0]:
                found = (total, s, [i] if i is not None else [model.bytes_from + x for x in t[s:e].encode()])
        best.append(found)
    out, e = [], len(t)
    while e:
        out = best[e][2] + out
        e = best[e][1]
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string, exact string, key int, zip string")


def test_best_paths_and_round_trip(spark):
    model = pieces.load()
    texts = TEXTS + long_texts()
    for frequent in (3, 1000):
        out = pieces.encode(table(spark, texts), model, frequent)
        assert out.columns == ["doc_id", "key", "zip", "ids", "exact"]
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            assert rows[i].ids == best_path(t or "", model), (t or "")[:50]
            assert rows[i].exact == (pieces.SPACE not in (t or "")) and (rows[i].key, rows[i].zip) == (1, "z")
        back = {r.doc_id: r.text for r in pieces.decode(out, model).collect()}
        assert back == {i: (t or "").replace(pieces.SPACE, " ") for i, t in enumerate(texts)}
    assert pieces.encode(table(spark, texts).limit(0), model).count() == 0


def test_the_library_finds_the_same_paths(spark):
    """Small whole scores: sums are whole in single precision too, and many paths tie."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # the library's best path over the same scores
    model = pieces.load()
    score = [-1.0 - i % 40 for i in range(len(model.text))]
    for i, x in enumerate(score):
        proto.pieces[i].score = x
    model = dataclasses.replace(model, score=score, used=[])
    best = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for t in TEXTS if t and pieces.SPACE not in t] + long_texts(4)
    rows = {r.doc_id: r for r in pieces.encode(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == best.encode(t), t[:50]


def test_repeated_rows_and_hot_text(spark):
    texts = ["one hot text qzx"] * 40 + ["other zzqk"] + [None] * 3
    rows = pieces.encode(table(spark, texts).repartition(5), pieces.load(), 1).collect()
    assert len(rows) == 44 and len({tuple(r.ids) for r in rows}) == 3 and all(r.exact for r in rows)


def test_hashes_of_a_word_and_its_complement():
    """The classic pair that falls together under any polynomial modulo 2^64."""
    x = "a"
    for _ in range(11):
        x += x.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        data, off = textvec.raw(textvec.pa.array([x[:n], x[:n].translate(str.maketrans("ab", "ba"))]))
        h = textvec.span_hash(data, off[:-1], off[1:])
        assert h[0] != h[1]


def test_piece_path_is_a_setting(spark):
    spark.conf.set(pieces.MODEL_KEY, "/nowhere.model")
    try:
        with pytest.raises((OSError, RuntimeError)):
            pieces.load(spark)
    finally:
        spark.conf.unset(pieces.MODEL_KEY)
    assert pieces.load(spark) is pieces.load()


def test_substrings_hold_every_piece_and_little_else(spark):
    """Every substring that is a piece is made, and each character; of the others less than half."""
    p = pieces.load()
    used = {p.text[i] for i in p.used}
    texts = ["▁interesting", "▁Donaudampfschiff", "▁a", "▁xq", "ééé▁" * 5, "▁zzzzzzzzzzzzzzzzzzzz", "漢字", "▁the"]
    segs = spark.createDataFrame([(k, 1, t, len(t)) for k, t in enumerate(texts)], "h long, i long, t string, starts int")
    got = [(r.h, r.s, r.len, r.piece) for r in pieces.substrings(segs, p).collect()]
    every = {(k, s, n, t[s : s + n]) for k, t in enumerate(texts) for s in range(len(t)) for n in range(1, min(p.longest, len(t) - s) + 1)}
    assert len(got) == len(set(got)) and set(got) <= every
    assert {x for x in every if x[2] == 1 or x[3] in used} <= set(got)
    assert len(got) < 0.5 * len(every), (len(got), len(every))
