"""Triples out of broken answers against the JSON library, the graph that they make, and the reports of the pass that writes."""

import json
import random

from pyspark.sql import functions as F

from strandline.operators import ingest


def rows_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, response string")
    return {r.id: [json.loads(x) for x in r.rows] for r in df.select("id", ingest.complete_rows(F.coalesce("response", F.lit(""))).alias("rows")).collect()}


def test_every_cut_gives_the_whole_rows_before_it(spark):
    rows = [["ACTOR", 'a "quoted" ]name', "REQUIRES", "RIGHT", "đất [1] \\ đai", 0.9], ["A", "b", "C", "D", "{e}", None], {"relation": "X", "n": [1, 2]}, ["short"], [["deep", 1], "b", "c", "d", "e"]]
    whole = "Sure ] } \"here\":\n" + json.dumps(rows, ensure_ascii=False) + " and [more]"
    got = rows_of(spark, [whole[:k] for k in range(len(whole) + 1)] + [None, "", "no list", "[", "[]", "[1, 2]", '["a", "b"]'])
    ends, text = [], whole.index("[") + 1
    for r in rows:
        text = whole.index(json.dumps(r, ensure_ascii=False), text) + len(json.dumps(r, ensure_ascii=False))
        ends.append(text)
    for k in range(len(whole) + 1):
        assert got[k] == [r for r, e in zip(rows, ends, strict=True) if e <= k], k
    assert all(got[len(whole) + 1 + k] == [] for k in range(7))


def test_fields_and_confidence(spark):
    answer = json.dumps([["A", "b", "C", "D", "e"], ["A", "b", "C", "D", "e", "0.5"], ["A", "b", "C", "D", "e", "sure"], ["A", "b", "C", "D"], {"subject_label": "A", "subject_name": "b", "relation": "C", "object_label": "D", "object_name": "e", "confidence": "high"}, {"subject_label": "A"}])
    df = spark.createDataFrame([(1, answer, "x"), (2, None, "y")], "id long, response string, confidential string")
    got = ingest.triples(df, "response").collect()
    assert [r.confidence for r in got] == [1.0, 0.5, 1.0, 0.0, 1.0] and {r.id for r in got} == {1}
    assert ingest.confident(ingest.triples(df, "response")).count() == 3


TRIPLES = "article_id string, subject_label string, subject_name string, relation string, object_label string, object_name string, confidence double, seq long"


def test_graph_of_triples(spark):
    rows = [
        ("a1", "ACTOR", " Ủy Ban  Nhân dân ", "requires", "RIGHT", "Quyền", 0.8, 1), ("a1", "ACTOR", "UBND", "REQUIRES", "RIGHT", "quyền", 0.9, 2), ("a1", "LegalArticle", "ARTICLE_NODE", "GOVERNS", "PENALTY", "Phạt", 1.0, 3),
        ("gone", "LegalArticle", "article_node", "GOVERNS", "PENALTY", "lost", 1.0, 4), ("gone", "ACTOR", "x", "PERMITS", "RIGHT", "y", 1.0, 5), ("a1", "ACTOR", "x", "PERMITS", "LegalArticle", "y", 1.0, 6),
        ("a1", "ACTOR", "", "PERMITS", "RIGHT", "y", 1.0, 7), ("a1", "NOBODY", "x", "PERMITS", "RIGHT", "y", 1.0, 8), ("a1", "ACTOR", "x", "MADE_UP", "RIGHT", "y", 1.0, 9), ("a1", None, None, None, None, None, None, 10),
    ]
    t = ingest.allowed(spark.createDataFrame(rows, TRIPLES), {"ubnd": "ủy ban nhân dân"})
    nodes, edges = ingest.semantic(t, spark.createDataFrame([("a1",), ("a2",)], "article_id string"), "seq")
    assert {(r.label, r.name, r.alias) for r in nodes.collect()} == {("ACTOR", "ủy ban nhân dân", " Ủy Ban  Nhân dân "), ("RIGHT", "quyền", "Quyền"), ("PENALTY", "phạt", "Phạt"), ("ACTOR", "x", "x"), ("RIGHT", "y", "y")}
    assert {(r.src, r.rel, r.dst, r.confidence) for r in edges.collect()} == {
        ("ủy ban nhân dân", "REQUIRES", "quyền", 0.9), ("a1", "GOVERNS", "phạt", 1.0), ("x", "PERMITS", "y", 1.0), ("a1", "MENTIONS", "phạt", None), ("a1", "MENTIONS", "ủy ban nhân dân", None), ("a1", "MENTIONS", "quyền", None),
    }


def test_articles_of_chunks(spark):
    text = "nội dung của điều luật này"
    rows = [("L1::1", True, "L1", "1", "First", text, 1), ("L1::1", True, "L1", "1", None, text + " mới", 2), ("L1::2", False, "L1", "2", "No id", text, 3), ("L2::1", True, "L2", "1", "Short", "  ngắn  ", 4), ("L2::2", True, "L2", "2", "Long", "x" * 9000, 5), ("L2::3", None, "L2", "3", "t", text, 6)]
    docs, articles, edges = ingest.structural(spark.createDataFrame(rows, "canonical_id string, has_canonical_id boolean, law_number string, article_number string, title string, content string, seq long"), "seq", "pd")
    assert {r.doc_id for r in docs.collect()} == {"L1", "L2"}
    assert {(r.article_id, r.title, len(r.content)) for r in articles.collect()} == {("L1::1", "First", len(text) + 4), ("L2::2", "Long", 8000)}
    assert {(r.src, r.dst) for r in edges.collect()} == {("L1", "L1::1"), ("L2", "L2::2")}


def test_seven_reports_equal_seven_aggregates(spark, tmp_path):
    r = random.Random(9)
    labels = [*ingest.LABELS[:4], "OTHER"]
    rows = [(f"a{r.randint(0, 5)}", r.choice(labels), f"Name {r.randint(0, 9)}", r.choice([*ingest.RELATIONS[:5], "X"]), r.choice(labels), f"name  {r.randint(0, 9)}", r.choice([None, 0.5, 0.75, 0.9]), k) for k in range(300)]
    df = spark.createDataFrame(rows, TRIPLES).repartition(3)
    got = ingest.pilot_reports(df, spark.createDataFrame([(f"a{k}",) for k in range(4)], "article_id string"), "seq", str(tmp_path / "kept"))
    assert len(got) == 7
    kept = [x for x in rows if (x[6] or 0.0) >= 0.75]
    norm = lambda s: " ".join(s.lower().split())
    names = {lab: {norm(n) for x in kept for a, n in ((x[1], x[2]), (x[4], x[5])) if a == lab} for lab in labels}
    assert {x.name: x.n for x in got["pilot_report"].collect()} == {"triples_generated": 300, "triples_kept": len(kept), "triples_filtered": 300 - len(kept), "unique_concepts": len(names["LEGAL_CONCEPT"]), "unique_actors": len(names["ACTOR"]), "unique_rights": len(names["RIGHT"]), "unique_obligations": 0, "unique_conditions": 0}
    assert {x.relation: x.n for x in got["top_relations"].collect()} == {rel: n for rel in ingest.RELATIONS if (n := sum(x[3] == rel for x in kept))}
    actors = {}
    for x in kept:
        for a, n in ((x[1], x[2]), (x[4], x[5])):
            if a == "ACTOR":
                actors[norm(n)] = actors.get(norm(n), 0) + 1
    assert {x.name: x.n for x in got["top_actors"].collect()} == actors
    assert got["semantic_audit_samples"].count() == 20 and got["retrieval_readiness_samples"].count() == 50
    fine = [x for x in kept if x[1] in ingest.LABELS and x[4] in ingest.LABELS and x[3] in ingest.RELATIONS]
    there = {lab: {norm(n) for x in fine for a, n in ((x[1], x[2]), (x[4], x[5])) if a == lab} for lab in labels}
    assert {x.label: x.n for x in got["semantic_label_distribution"].collect()} == {lab: len(v) for lab, v in there.items() if v}
    assert got["top_concepts"].count() == len(there["LEGAL_CONCEPT"])
    assert spark.read.parquet(str(tmp_path / "kept")).count() == len(kept)
