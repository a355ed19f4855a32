"""Similar pairs and contained entities against brute force."""

import random

import pytest

from strandline.operators import evaluate, lookup


@pytest.mark.parametrize("least", [0.2, 0.5, 0.7, 1.0])
def test_similar_pairs_are_all_of_them(spark, least):
    r = random.Random(2)
    rows = [(k, [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([4, 12, 26])]) for _ in range(r.randint(0, 12))]) for k in range(70)] + [(100, None), (101, list("abcd")), (102, list("dcba"))]
    got = {(x.a, x.b): round(x.jaccard, 9) for x in evaluate.similar_pairs(spark.createDataFrame(rows, "id long, ts array<string>"), "id", "ts", least).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and (s := len(set(a) & set(b)) / len(set(a) | set(b))) >= least:
                want[(i, j)] = round(s, 9)
    assert got == want and want


@pytest.mark.parametrize("most", [200_000, 3])
def test_contained_entities(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "ENTITIES", most)
    texts = [(1, "the thing within", "x"), (2, None, "y"), (3, "", None), (4, "Ủy ban nhân dân tỉnh", "z"), (4, "thing", "z")]
    entities = ["thing", "hin", "within the", "nhân dân", "", None, "thing", "q", "Ủy", "e t"]
    got = sorted((r.id, r.entity, r.more) for r in lookup.containing(spark.createDataFrame(texts, "id long, text string, more string"), spark.createDataFrame([(e,) for e in entities], "entity string")).collect())
    assert got == sorted((i, e, m) for i, t, m in texts for e in set(entities) if e and e in (t or ""))


def test_first_texts_of_each_entity(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    for kind, key in (("long", lambda i: None if i == 4 else i // 2), ("string", lambda i: f"é{i}" if i % 3 else str(i)), ("double", lambda i: float(-i))):
        rows = [(key(i), None if i == 7 else " ".join(r.choices(words, k=6))) for i in range(300)]
        df = spark.createDataFrame(rows, f"at {kind}, text string").repartition(3)
        got = sorted(((x.at, x.entity) for x in lookup.first_containing(df, spark.createDataFrame([(w,) for w in words], "entity string"), "at", 4).collect()), key=str)
        order = lambda a: (a is not None, a if kind != "string" else (a or "").encode())
        want = [(a, w) for w in words for a in sorted({a for a, t in rows if t and w in t}, key=order)[:4]]
        assert got == sorted(want, key=str)


def test_rows_of_contained_entities_leave_in_bounded_batches():
    import pyarrow as pa

    class Sent:
        value = [a + b for a in "abcdefghij" for b in "abcdefghij"]

    text = "".join(Sent.value) * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text] * 40)], ["id", "text"])
    out = list(lookup._hits(Sent, 1)([batch]))
    assert max(b.nbytes for b in out) < 20 << 20 and sum(b.num_rows for b in out) == 40 * 100
    out = list(lookup._first_hits(Sent, 1, 0, 5)([batch]))
    assert [b.num_rows for b in out] == [5 * 100] and out[0].schema.names == ["id", "entity"]


def test_first_words(spark):
    from pyspark.sql import functions as F

    from strandline.operators import search

    asked = {"What is the  Capital, of (France) and Spain's 5 big towns?": ["capital", "france", "spains", "5", "big"], "the of": ["the", "of"], "?? !": [], None: [], "": []}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.w for r in df.select("q", search.search_words(F.col("q")).alias("w")).collect()} == asked
    plain = df.where("q like 'What%'").select(search.search_words(F.col("q"), False).alias("w")).first().w
    assert plain == ["what", "is", "the", "capital,", "of"]
