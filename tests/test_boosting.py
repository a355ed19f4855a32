"""Boosted trees for several classes: against the forest, probabilities, the files of a model, missing features."""

import random

from pyspark.sql import functions as F

from strandline.operators import boosting, evaluate, ml

NAMES = ["a", "b", "c", "noise"]


def rows(n, seed):
    """Three routes by rules that need two features together; some labels are wrong."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = r.random(), r.random(), float(r.randint(0, 3))
        label = "clarify" if (a > 0.5) != (b > 0.5) else "graph_traversal" if c >= 2 else "dense_retrieval"
        out.append((k, a, b, c, r.random(), r.choice(["clarify", "dense_retrieval"]) if r.random() < 0.03 else label))
    return out


def test_boosted_trees(spark, tmp_path):
    kind = "id long, a double, b double, c double, noise double, label string"
    train, test = spark.createDataFrame(rows(900, 1), kind).cache(), spark.createDataFrame(rows(400, 2), kind).cache()
    model = boosting.fit(train.unionByName(spark.createDataFrame([(-1, 0.1, 0.1, 0.0, 0.0, None)], kind)), NAMES, rounds=8, depth=4)
    assert model.labels == ["clarify", "dense_retrieval", "graph_traversal"] and len(model.rounds) == 8
    out = model.predict(test).cache()
    assert out.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0
    ours = evaluate.summary(out, "label", "predicted").first()
    forest = evaluate.summary(ml.predict(ml.pipeline(NAMES, trees=20).fit(ml.weighted(train)), test), "label", "predicted").first()
    assert ours["macro_f1"] >= forest["macro_f1"] - 1e-9 and ours["macro_f1"] > 0.9
    assert [n for n, _ in model.importances()[:3]] != ["noise"] and dict(model.importances())["a"] > 0
    model.save(spark, str(tmp_path / "m"))
    again = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert [r.probabilities for r in again.predict(test).orderBy("id").collect()] == [r.probabilities for r in out.orderBy("id").collect()]
    # a feature that isn't there, or is null, counts as 0; columns in another order are found by name
    some = test.select("noise", "c", F.lit(None).cast("double").alias("b"), "id")
    zero = test.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    assert sorted((r.id, r.confidence) for r in again.predict(some).collect()) == sorted((r.id, r.confidence) for r in again.predict(zero).collect())


def test_one_class_and_a_parsed_tree(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x")], "a double, label string")
    m = boosting.fit(df, ["a"], rounds=1)
    assert [tuple(r.probabilities) for r in m.predict(df).collect()] == [(1.0,), (1.0,)]
    t = boosting._parse("head\n  If (feature 1 <= 0.5)\n   Predict: 1.0\n  Else (feature 1 > 0.5)\n   If (feature 0 <= -2.0)\n    Predict: 2.0\n   Else (feature 0 > -2.0)\n    Predict: 3.0\n")
    assert t.feature == [1, -1, 0, -1, -1] and t.left == [1, -1, 3, -1, -1] and t.right == [2, -1, 4, -1, -1]
