"""The language model above the size that one process fits, and its limits."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose

from strandline.llm import langid


def _code_rows(n_texts, seed=6):
    r = random.Random(seed)
    return [(i, "".join(chr(0x4E00 + r.randint(0, 2999)) for _ in range(120)) if i % 2 else prose(r, "en", 30), "zh" if i % 2 else "en") for i in range(n_texts)]


@pytest.mark.parametrize("indexed", [1 << 22, 0])
def test_language_model_keeps_every_ngram(spark, monkeypatch, indexed):
    """Many characters: nothing of what is counted is left out, and the model by joins is that of one process."""
    monkeypatch.setattr(langid, "MAX_NGRAMS", 50, raising=False)  # a cut, if there is one, would bite
    df = spark.createDataFrame(_code_rows(60), "doc_id long, text string, lang string")
    found = langid.counts(df).cache()
    small = langid.fit(found)
    assert len(small.hashes[4]) == found.select("gram").distinct().count()
    monkeypatch.setattr(langid, "LOCAL", 0)
    monkeypatch.setattr(langid, "PART", 40)
    monkeypatch.setattr(langid, "INDEXED", indexed)
    large = langid.fit(found)
    assert large.files and large.langs == small.langs
    got = large.opened()
    for k in range(1, 5):
        assert (got.hashes[k] == small.hashes[k]).all()
        np.testing.assert_allclose(got.logs[k], small.logs[k], rtol=1e-5)
        if k < 4:
            np.testing.assert_allclose(got.back[k], small.back[k], rtol=1e-5)
    rows = [{r.doc_id: (r.lang_pred, round(r.entropy, 3)) for r in langid.predict(df.select("doc_id", "text"), m).collect()} for m in (small, large)]
    assert rows[0] == rows[1] and {i: x for i, (x, _) in rows[0].items()} == {i: lang for i, _, lang in _code_rows(60)}


def test_more_than_256_languages(spark):
    df = spark.createDataFrame([(i, f"some text of kind {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}", f"x{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(langid.learn(df).langs) == 300


def test_limits_cover_every_row(spark, monkeypatch):
    """A language's limit is the quantile of all its rows, and for few rows not below that of all languages' rows."""
    monkeypatch.setattr(langid, "SAMPLE", 40, raising=False)  # a sample, if there is one, would miss the rare language
    r = random.Random(9)
    rows = [(i, prose(r, "en", r.randint(5, 40)), "en") for i in range(1500)] + [(5000 + i, prose(r, "fr", r.randint(2, 30)), "fr") for i in range(12)]
    rows += [(9000, "", "de"), (9001, "a", "it"), (9002, None, "fr"), (9003, "some words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.learn(df)
    assert model.langs == ["en", "fr"]
    scorer, own = langid.Scorer(model), {}
    for _, text, lang in rows:
        if text and lang in model.langs:
            e, _ = langid._entropies(scorer, pa.array([text]))
            own.setdefault(lang, []).append(e[0, model.langs.index(lang)])
    everything = sorted(own["en"] + own["fr"])
    top = lambda x: sorted(x)[int(np.ceil((1 - langid.REJECT) * len(x))) - 1]
    want = [top(own["en"]) * langid.MARGIN, max(top(own["fr"]), top(everything)) * langid.MARGIN]
    np.testing.assert_allclose(model.limit, want, atol=2 * langid.MARGIN / 4096)
    assert not langid.predict(df.where("lang = 'fr' and text is not null").select("doc_id", "text"), model).where("rejected").count()
