"""Vietnamese fixtures of the pattern banks, the decision rules, and the readers."""

import json
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import ambiguity, entities, features, history, routing, text
from strandline.functions import patterns as P
from strandline.operators import dataset, evaluate, graph, search, sessions
from strandline.sources import readers, writers

#: question, chars, words, references, articles, yes/no, negation, conditional, effect, specificity, entities
QUESTIONS = (
    ("Người dưới 18 tuổi đi xe trên 70 cc có bị phạt không?", 53, 13, 0, 0, 1, 1, 0, 0, 0, 1),
    ("Nội dung Điều 56 của văn bản 102/2016/QH13 quy định như thế nào?", 64, 13, 2, 1, 0, 0, 0, 0, 2, 0),
    ("Nghị định 77/2026/NĐ-CP có hiệu lực khi nào?", 44, 8, 3, 0, 0, 0, 1, 1, 1, 0),
    ("Luật đó quy định như thế nào?", 29, 7, 1, 0, 0, 0, 0, 0, 1, 0),
    ("Công ty đó có bị xử phạt không?", 31, 8, 0, 0, 1, 1, 0, 0, 0, 1),
    ("Theo Điều 5 và Điều 7, nếu sửa đổi thì ai chịu trách nhiệm?", 59, 14, 0, 2, 0, 0, 1, 1, 2, 0),
)


def test_features(spark):
    df = spark.createDataFrame([(k, q[0]) for k, q in enumerate(QUESTIONS)] + [(90, None), (91, "")], "id int, query string")
    out = {r.id: r for r in features.with_features(df).collect()}
    for k, q in enumerate(QUESTIONS):
        r = out[k]
        got = (r.query_length_chars, r.query_length_words, r.legal_reference_count, r.dieu_reference_count, r.is_yes_no_question, r.has_negation, r.has_conditional_structure, r.legal_effect_count, r.law_specificity, r.entity_count)
        assert got == q[1:], q[0]
    assert out[2].complexity_level == 1 and out[5].complexity_level == 2
    assert out[90].query_length_words == out[91].query_length_words == 0
    assert len(features.vector(features.with_features(df)).first().features) == 27
    counts = {p: len(re.findall(p, QUESTIONS[5][0], re.I)) for p in (P.VI.authority, P.VI.effect, P.VI.conditional)}
    assert (out[5].authority_chain_count, out[5].legal_effect_count, out[5].conditional_depth) == tuple(counts.values())


def test_question_types(spark):
    rows = [("Tôi có được nghỉ không?", "yes_no"), ("Nếu vi phạm thì sao?", "conditional"), ("So sánh hai luật", "comparison"), ("Hợp đồng là gì?", "definition"), ("Thủ tục ra sao", "procedural"), ("Ai ký?", "factoid")]
    df = spark.createDataFrame(rows, "q string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", features.question_type(F.col("q"))).collect())


def test_history_and_ambiguity(spark):
    law = "Trước đó hỏi về Nghị định 77/2026/NĐ-CP."
    rows = [
        (1, "Nghị định đó quy định gì?", law, "resolved"), (2, "Nghị định đó quy định gì?", None, "no_history"), (3, "Nghị định đó quy định gì?", "Chào bạn", "irrelevant_history"),
        (4, "Nghị định đó quy định gì?", law + " Và Thông tư 10/2015/TT-BKHCN.", "conflicting_history"), (5, "Mức phạt là bao nhiêu?", law, "not_needed"), (6, None, None, "not_needed"),
    ]
    df = history.with_history(spark.createDataFrame([r[:3] for r in rows], "id int, query string, history string"))
    out = {r.id: r for r in ambiguity.detect(df, "query", "history").collect()}
    for k, _, _, status in rows:
        assert out[k].history_resolution_status == status
    assert out[1].resolution.resolved_referent == "Nghị định 77/2026/NĐ-CP"
    assert out[1].ambiguity.formal_score == 0 and out[2].ambiguity.score >= 0.9 and "incomplete_context" in out[2].ambiguity.types
    one = ambiguity.detect(spark.createDataFrame([("Công ty đó có bị xử phạt không?",)], "query string")).first().ambiguity
    assert one.pronoun == "công ty đó" and one.score == 0.9 and one.primary == "pronoun" and "công ty đó" in one.clarification


def test_text_functions(spark):
    row = spark.createDataFrame([("D::5::x", "  a\t b ", '<think>no</think>```json\n{"a": True, "b": [1,2,],}\n```', "1.7", "null", "Theo Điều 56 của văn bản 102/2016/QH13")], "k string, w string, j string, c string, n string, q string")
    r = row.select(
        text.parse_key(F.col("k")).alias("k"), text.word_count(F.col("w")).alias("w"), text.repair_json(F.col("j")).alias("j"), text.clamp(F.col("c")).alias("c"), text.clamp(F.col("n"), 0.3).alias("d"),
        text.null_if_nullish(F.col("n")).alias("n"), text.canonical_id(F.col("q")).alias("q"), text.looks_truncated(F.col("w")).alias("t"),
    ).first()
    assert tuple(r.k) == ("D", "5::x") and r.w == 2 and json.loads(r.j) == {"a": True, "b": [1, 2]} and (r.c, r.d, r.n) == (1.0, 0.3, None) and r.q == "102/2016/QH13::56" and r.t


def test_dataset_steps(spark):
    qa = spark.createDataFrame([(1, "A::1", "ev"), (2, "B::2", "e" * 60), (3, "Z::9", "x")], "id int, article_key string, evidence string")
    art = spark.createDataFrame([("A::1", "old", "A", "1", 1), ("A::1", "new text", "A", "1", 2), ("B::2", "", "B", "2", 3)], "article_key string, content string, law string, article_id string, pos int")
    out = {r.id: r for r in dataset.enrich(qa, art, "article_key", ["pos"]).collect()}
    assert out[1].gold_context == out[1].evidence == "new text" and out[2].gold_context == "" and out[2].supporting_facts == [] and out[3].evidence == "x"
    words = spark.createDataFrame([(1, " ".join(map(str, range(500)))), (2, "")], "id int, t string")
    got = [(r.chunk_idx, len(r.chunk_text.split())) for r in dataset.chunks(words, "t").orderBy("chunk_idx").collect()]
    assert got == [(0, 256), (1, 256), (2, 52)]
    ends = spark.createDataFrame([("Quy định gồm:",), ("Đủ câu.",)], "a string")
    assert [r.b for r in ends.select(dataset.bad_ending(F.col("a")).alias("b")).collect()] == [True, False]


def test_graph_rules(spark):
    e = spark.createDataFrame([("a", "b", "R", 1), ("b", "a", "R", 2), ("b", "c", "S", 3)], "src string, dst string, rel string, eid long")
    p = graph.paths(e, spark.createDataFrame([("a",)], "start string")).collect()
    assert sorted((r.end, r.hops) for r in p) == [("b", 1), ("b", 1), ("c", 2), ("c", 2)]
    pairs = graph.cliques(spark.createDataFrame([(1, k) for k in range(4)], "g int, x int"), "g", "x", "R", 2).collect()
    assert sorted((r.src, r.dst) for r in pairs) == [(a, b) for a in range(4) for b in range(a + 1, 4)]  # beyond the list all the same


def test_routing_rows(spark):
    df = routing.defaults(spark.createDataFrame([("xin chào!",), ("câu hỏi",)], "q string"))
    assert [r.x.route for r in df.select(routing.rule_route(F.col("q")).alias("x")).collect()] == ["chitchat", "dense_retrieval"]


def test_entities_and_metrics(spark):
    found = entities.find("Theo Điều 5 Luật Đất đai 2024, Khoản 2", entities.VI)
    assert [x["text"] for x in found][:2] == ["Điều 5", "Khoản 2"]
    df = spark.createDataFrame([("the cat sat", "the cat"), ("", ""), ("a", "")], "p string, g string")
    got = [round(r.f, 3) for r in df.select(evaluate.token_f1(F.col("p"), F.col("g")).alias("f")).collect()]
    assert got == [0.8, 1.0, 0.0]


def test_readers_and_writers(spark, tmp_path):
    schema = T.StructType().add("id", "string").add("n", "long")
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{bad\n{"id": "y", "n": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema, "drop").count() == 2
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).where("_corrupt_record is not null").count() == 1
    (tmp_path / "b.json").write_text('[{"id": "x", "n": 1}, {"id": null, "n": 2}]')
    assert readers.json_array(spark, str(tmp_path / "b.json"), schema).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "doc7.json").write_text('{"n": 3}')
    assert readers.json_folder(spark, str(tmp_path / "d"), schema, "id").first().id == "doc7"
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "b.json")).endswith("b.json")
    page = "<div><p class='pDieu'>Điều 1.2 Tên</p><p class='pGhiChu'>(Luật A)</p><p class='pNoiDung'>Một <b>hai</b></p><p class='pItem'>ba</p><p class='pDieu'>Khác</p></div>"
    got = readers.html_articles(spark.createDataFrame([(1, page), (2, None)], "id int, html string")).orderBy("pos").collect()
    assert [(r.number, r.note, r.body) for r in got] == [("1.2", "Luật A", "Một hai\nba"), ("", "", "")]
    js = spark.createDataFrame([('var a = [1, "]", {"b": "\\"]"},]; x',), ("none",)], "js string")
    assert [r.v for r in js.select(readers.script_variable("a")(F.col("js")).alias("v")).collect()] == ['[1, "]", {"b": "\\"]"}]', None]
    df = spark.createDataFrame([("q, 1", "graph", "s")], "query string, label string, source string")
    writers.training_csv(df, str(tmp_path / "t"), ["dense", "graph"])
    assert readers.csv(spark, str(tmp_path / "t")).first().label_idx == "1"
    writers.evaluation_csv(spark.createDataFrame([("1", "x")], "ID string, Query string"), str(tmp_path / "e"))
    assert readers.csv(spark, str(tmp_path / "e")).columns == list(writers.EVALUATION)
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert "| q, 1 | graph | s |" in writers.report("R", {"rows": df})


def test_streams(spark, tmp_path):
    from strandline.streaming import sessions as stream

    rows = [(u, f"2024-01-01 {h:02d}:00:00", f"t{h}") for u in (1, 2) for h in (1, 2, 9)]
    df = spark.createDataFrame(rows, "user long, s string, text string").select("user", F.to_timestamp("s").alias("ts"), "text")
    df.write.parquet(str(tmp_path / "in"))
    s = stream.file_stream(spark, str(tmp_path / "in"), df.schema)
    write = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q = write(stream.gap_sessions(s, "user", "ts", "90 minutes"), "gaps", "complete")
    assert q.awaitTermination(90)
    assert sorted(r.n for r in spark.table("gaps").collect()) == [1, 1, 2, 2]
    assert sorted(r.n for r in sessions.gap_sessions(df, "user", "ts", 90).collect()) == [1, 1, 2, 2]
    q = write(stream.last_turns(stream.file_stream(spark, str(tmp_path / "in"), df.schema), "user", "text", 2, None), "turns", "update")
    assert q.awaitTermination(90)
    assert sorted((r.session, r.n, len(r.last_turns)) for r in spark.table("turns").collect()) == [("1", 3, 2), ("2", 3, 2)]


def test_query_terms(spark):
    df = spark.createDataFrame([("Theo 77/2026/NĐ-CP hồ sơ đường bộ",)], "q string")
    got = search.query_terms(df, "q", {"theo"}, {"đường bộ": 7.0}).first().terms
    assert [(t.text, t.weight) for t in got][:3] == [("77/2026/nđ-cp", 10.0), ("77 2026 nđ cp", 9.0), ("đường bộ", 7.0)]
    assert len({t.text for t in got}) == len(got) <= 12


def test_context(spark):
    from strandline.operators import context

    df = spark.createDataFrame([("hf_processed_L1", None, "### Điều 5a. Tên"), ("1/2020/QH::3", "x", "c"), ("", "t", "c")], "a string, b string, c string")
    assert [r.s for r in df.select(context.source_id([F.col("a"), F.col("b")], F.col("c")).alias("s")).collect()] == ["L1::Điều 5a", "1/2020/QH::3", "t"]
    said = "Nguồn gốc ID: 1/2020/NĐ::4\nNguồn gốc: Điều 7 của văn bản số 2/2021/TT-B.\n[Start: Law ID: L9\nArticle ID: 3\n[Start: Doc ID: D1\n pd_001_002_0003"
    got = spark.createDataFrame([(said,)], "c string").select(context.context_sources(F.col("c")).alias("s")).first().s
    assert got[:4] == ["1/2020/NĐ::4", "2/2021/TT-B::7", "L9::3", "D1"] and "pd_001_002_0003" in got
    m = spark.createDataFrame([("v" * 30, "none found"), (None, None), ("a", "g")], "v string, g string")
    assert [r.m for r in m.select(context.merge(F.col("v"), F.col("g"), "V", "G", "none found", (20, 20, 99)).alias("m")).collect()] == ["V\n" + "v" * 20 + "...", "none found", "V\na\n\nG\ng"]
    e = context.embed(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t", context.hash_embedder(8)).collect()
    assert round(sum(x * x for x in e[0].embedding), 6) == 1 and set(e[1].embedding) == {0.0}
    r = context.rerank(spark.createDataFrame([(1, k) for k in range(4)], "q int, k int"), "q", ["k"], None, 2).orderBy("rank").collect()
    assert [(x.k, x.relevance) for x in r] == [(0, 1.0), (1, 0.75)]
    t = spark.createDataFrame([("hi", "vi"), ("hi", "fr"), ("no", "vi")], "k string, l string")
    assert [x.m for x in t.select(context.templates(F.col("k"), F.col("l"), {("hi", "vi"): "chào", ("hi", "en"): "hello"}).alias("m")).collect()] == ["chào", "hello", "no"]
    n = spark.createDataFrame([(1, None), (2, "y")], "id int, e string")
    assert sorted(x.e for x in context.fill_missing(n, "e", spark.createDataFrame([(1, "x"), (2, "z")], "id int, e string"), "id").collect()) == ["x", "y"]
