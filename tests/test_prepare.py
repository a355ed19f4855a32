"""Steps before indexing and training; cliques of large groups."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, prepare


def one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(column).collect()]


def test_values_of_a_models_answer(spark):
    got = one(spark, prepare.string_list(F.col("v")), None, "null", '""', '"one"', '["a", null, "", "b", 3]', "7", "[]")
    assert got == [[], [], [], ["one"], ["a", "b", "3"], ["7"], []]
    rows = one(spark, prepare.flags(F.col("v")), None, '{"missing_entity": true, "pronoun_reference": false, "multi_interpretation": 1, "incomplete_context": "yes"}', '{"missing_entity": null, "pronoun_reference": 0, "multi_interpretation": ""}', "[1]")
    assert [tuple(r) for r in rows] == [(False,) * 4, (True, False, True, True), (False,) * 4, (False,) * 4]


def test_questions_are_rewritten(spark):
    asked = ["Bằng B2 có lái xe máy được không?", "Sổ đỏ và vượt đèn đỏ", "bị tước bằng C thì sao", "không đổi"]
    assert one(spark, prepare.rewritten(F.col("v")), *asked) == ["xe ô tô có lái xe mô tô, xe gắn máy được không?", "Giấy chứng nhận quyền sử dụng đất và không chấp hành hiệu lệnh của đèn tín hiệu giao thông", "bị tước xe ô tô thì sao", "không đổi"]


def test_training_rows_and_sources(spark):
    df = spark.createDataFrame([(1, " q1 ", "graph_traversal"), (2, "q2", "nothing"), (3, "", "clarify"), (4, None, None)], "id long, question string, routing_label string")
    rows = prepare.training_rows(df, "id").collect()
    assert sum(r.source == "synthetic_clarify" for r in rows) == 60 and {r.query for r in rows if r.source != "qa_dataset"} <= set(prepare.CLARIFY) and [r.query for r in rows if r.source == "qa_dataset"] == ["q1"]
    assert [r.query for r in prepare.training_rows(df, "id").orderBy("order").collect()] == [r.query for r in sorted(rows, key=lambda r: r.order)]
    with pytest.raises(ValueError):
        prepare.chosen({"a": df}, "b")
    assert prepare.chosen({"a": df, "b": df.drop("question")}, "b").columns == ["id", "routing_label", "source_name"]
    assert prepare.exists(df) and not prepare.exists(df.where("false"))


def test_titles_go_before_chunks(spark):
    df = spark.createDataFrame([("Tên", "a b c d e", "u1"), ("", "x y", "u2"), (None, None, "u3")], "title string, content string, url string")
    got = [(r.url, r.chunk_idx, r.chunk_text) for r in prepare.titled_chunks(df, "title", "content", 4, 1).collect()]
    assert got == [("u1", 0, "Tên a b c"), ("u1", 1, "c d e"), ("u2", 0, "x y")]


@pytest.mark.parametrize("most", [3, 64])
def test_cliques_of_large_groups(spark, most):
    groups = {"small": [3, 1], "one": [5], "large": list(range(40)), "middle": [7, 8, 9, 10]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("small", 3), ("none", None), (None, 4)]
    got = sorted((r.g, r.src, r.dst, r.rel) for r in graph.cliques(spark.createDataFrame(rows, "g string, x long"), "g", "x", "co", most).collect())
    assert got == sorted((g, a, b, "co") for g, xs in groups.items() for a, b in combinations(sorted(xs), 2))
