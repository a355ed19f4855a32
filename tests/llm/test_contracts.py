"""What each opN query returns over written tables: columns, types, one row a document, and the values a contract fixes."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import corpus, shingles, table

from strandline.llm import pieces, quality, queries
from strandline.llm.textvec import raw

L, B, S, D, I = "bigint", "boolean", "string", "double", "int"
COLUMNS = {
    "op1_quality": [("doc_id", L), ("held_out", B), ("score", D), ("predicted", I)],
    "op2_toxicity": [("doc_id", L), ("held_out", B), ("score", D), ("predicted", I)],
    "op3_pii": [("doc_id", L), ("n_email", L), ("n_ip", L), ("n_card", L), ("n_phone", L), ("base_sha256", S), ("spans", S)],
    "op4_langid": [("doc_id", L), ("held_out", B), ("lang_pred", S), ("score", D)],
    "op5_suffix": [("doc_id", L), ("n_bytes", L), ("n_removed", L), ("n_spans", L), ("kept_sha256", S)],
    "op6_minhash": [("doc_id", L), ("n_shingles", L), ("component_id", L), ("kept", B)],
    "op7_mixing": [("doc_id", L), ("size", L), ("source_size", L), ("target", D), ("taken", L)],
    "op8_pieces": [("doc_id", L), ("n_pieces", L), ("exact", B)],
    "op10_exact": [("doc_id", L), ("keep_id", L), ("group_size", L), ("kept", B), ("text_sha256", S)],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = corpus(11, 60)
    rows += [rows[2], (None, rows[4][1], "en", "b"), (950, " ".join(f"word{k % 700}" for k in range(30_000)), "en", "a")]
    table(spark, rows).repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(i, i % 2, (i // 2) % 2) for i, *_ in rows if i is not None and i % 3] + [(1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), rows


def _held_out(name, i):
    n, rest = {"op1_quality": (5, 0), "op2_toxicity": (4, 2), "op4_langid": (3, 1)}[name]
    return i is not None and zlib.crc32(str(i).encode()) % n == rest


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, tables, name):
    if name == "op8_pieces" and not os.path.exists(pieces.MODEL):
        pytest.skip("the vocabulary file is not here")
    folder, rows = tables
    out = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name]) <= set(out.dtypes)
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        t = text[r.doc_id]
        if name in ("op1_quality", "op2_toxicity", "op4_langid"):
            assert r.held_out == _held_out(name, r.doc_id) and 0 <= r.score <= 1
        if name in ("op1_quality", "op2_toxicity"):
            assert r.predicted == int(r.score >= 0.3)
        if name == "op4_langid":
            assert r.lang_pred in {"en", "fr", "und"} and (r.lang_pred == "und" or re.search(r"[^\W\d_]", t)) and (re.search(r"[^\W\d_]", t) or r.lang_pred == "und")
        if name == "op5_suffix":
            assert r.n_bytes == len(t.encode()) and 0 <= r.n_removed <= r.n_bytes and (r.n_removed == 0) == (r.n_spans == 0)
        if name == "op6_minhash":
            assert r.n_shingles == len(shingles(t, 3)) and r.kept == (r.doc_id == r.component_id)
        if name == "op7_mixing":
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        if name == "op10_exact":
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_quality_scores_are_those_of_dense_vectors(spark, tables):
    """The sparse dot products against vectors written out in full."""
    texts = [t or "" for _, t, *_ in tables[1]][:40]
    r = np.random.Generator(np.random.PCG64(4))
    w = r.normal(size=1 << quality.BITS).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in quality.score(df, w, 0.25).collect()}
    for k, t in enumerate(texts):
        dense = np.zeros(1 << quality.BITS)
        data, off = raw(pa.array([t]))
        for idx, _, scale in quality.features(data, off):
            seen, n = np.unique(idx, return_counts=True)
            dense[seen] += n * scale / max(1, n.sum())
        want = 1 / (1 + np.exp(-(dense @ w.astype(float) + 0.25)))
        assert abs(got[k] - want) < 1e-6
