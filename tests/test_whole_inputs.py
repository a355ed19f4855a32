"""Queries take all of their input, on small tables against brute force."""

import random

from strandline.functions import history
from strandline.plans import catalogue


def test_history_resolution_reads_every_turn(spark, tmp_path):
    talks = {
        1: ["Xin chào", "Luật Đất đai 2013 quy định gì?", "Có nhiều điều khoản.", "Luật đó quy định như thế nào?"],
        2: ["Xin chào", "Luật Đất đai 2013 quy định gì?", "Luật Nhà ở 2014 thì sao?", "Luật đó quy định như thế nào?"],
        3: ["Luật đó quy định như thế nào?"],
        4: ["Nghị định 77/2026/NĐ-CP có hiệu lực khi nào?", "Chưa rõ.", "Luật đó quy định như thế nào?"],
    }
    rows = [(c, i, t) for c, texts in talks.items() for i, t in enumerate(texts)]
    spark.createDataFrame(rows[::-1], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.status, r.reason, r.candidates) for r in catalogue.queries()["history_resolution"](spark, str(tmp_path)).collect()}
    want = {c: history.resolve(texts[-1], "\n".join(texts[:-1])) for c, texts in talks.items()}
    assert got == {c: (r[4], r[6], len(r[2])) for c, r in want.items()}
    assert got[1][2] > 0 and got[3][0] == "no_history"


def test_searches_start_from_every_row(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i}") for i in range(25)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"word{i} other text") for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["bm25_search"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc) for r in got) == [(i, i) for i in range(25)]
    spark.createDataFrame([(i, i % 2) for i in range(6)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(i, i % 6) for i in range(12)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalogue.queries()["path_expand_1_2"](spark, str(tmp_path)).collect()
    want = [(f"n{i}", None, f"r{i % 2}") for i in range(6)] + [(f"n{c % 6}", None, f"c{c}") for c in range(12)]
    want += [(f"n{i}", f"r{i % 2}", f"n{j}") for i in range(6) for j in range(6) if i != j and i % 2 == j % 2]
    assert sorted(map(str, want)) == sorted(str((r.start, r.mid, r.fin)) for r in got)


def test_band_is_500_characters(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "idiot", "a", "é", "", "there", "longerword", "idiot."]) for _ in range(200))) for i in range(20)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, x.start_a, x.start_b) for x in catalogue.queries()["band_join_500_chars"](spark, str(tmp_path)).collect())
    want = []
    for i, text in rows[:-1]:
        at, starts = 0, {"the": [], "idiot": []}
        for w in text.split(" "):
            starts.get(w, []).append(at)
            at += len(w) + 1
        want += [(i, a, b) for a in starts["the"] for b in starts["idiot"] if abs(a - b) < 500]
    assert got == sorted(want) and want
