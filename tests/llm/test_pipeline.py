import ctypes
import os
import re

import numpy as np
import pytest
from llm_fixtures import corpus, shingles, table

import corpus_pipeline
from strandline.llm import common, pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not here")


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(8) + [corpus(8)[3]]
    docs = table(spark, rows).selectExpr("*", "1 as _key", "2 as _id", "3 as key", "4 as row", "5 as copy", "6 as ids", "7 as n")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {} if not kept else kept
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == columns
        got = docs.collect()
        ids = [r.doc_id for r in got]
        if name == "language_id":
            assert not {900, 901, 902, 903} & set(ids) and len(ids) >= len(rows) - 8
        elif name == "exact_dedup":
            norm = {}
            for i, t in sorted(before.items()):
                norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert sorted(ids) == sorted(norm.values())
        elif name == "near_dedup":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            low = {i: i for i in sets}
            for _ in range(30):
                for a in sets:
                    for b in sets:
                        if a < b and near(a, b):
                            low[a] = low[b] = min(low[a], low[b])
            assert sorted(ids) == sorted(i for i in low if low[i] == i)
        elif name == "mixing":
            assert set(ids) <= set(before) and max(ids.count(i) for i in ids) <= 3
        else:
            assert all(r.exact for r in got) and sorted(ids) == sorted(i for i, n in times.items() for _ in range(n))
            back = {r.doc_id: r.text for r in pieces.decode(docs, pieces.load()).collect()}
            assert back == {i: before[i] for i in back}
        times = {i: ids.count(i) for i in ids}
        kept = {r.doc_id: r.text for r in got} if name != "sentencepiece" else {}
    assert sorted(ids) == sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_empty_table(spark, tmp_path):
    docs = table(spark, corpus(8)).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc's allocator only")
def test_workers_give_memory_back():
    """Freed blocks below one in use stay with the process unless they are handed back."""
    used = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
    held = []

    def run(batches):
        for b in batches:
            blocks = [np.ones(8 << 10) for _ in range(2000)]  # 64 KB each, too small for maps of their own
            held.append(np.ones(8 << 10))
            del blocks
            yield b

    found = []
    for f in (run, common.freeing(run)):
        before = used()
        assert list(f(iter([1, 2]))) == [1, 2]
        found.append(used() - before)
    assert found[0] > 60 and found[1] < 0, found


def test_stages_free_memory(spark, tmp_path, monkeypatch):
    """Every stage that runs Python hands its memory back."""
    seen, freeing = [], common.freeing
    monkeypatch.setattr(common, "freeing", lambda run: seen.append(run) or freeing(run))
    docs = table(spark, corpus(8))
    for name, stage in corpus_pipeline.STAGES:
        del seen[:]
        stage(spark, docs, str(tmp_path))
        assert seen or name == "mixing", name
