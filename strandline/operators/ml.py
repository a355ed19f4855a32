"""Router training: features to vectors, a forest and baselines, folds, calibration, metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import dataset, evaluate


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: rows / (classes * rows of the class). Classes are few: their counts are a small table."""
    return df.join(F.broadcast(dataset.class_weights(df, label).select(label, "weight")), label)


def pipeline(names: list[str], model: str = "forest", trees: int = 50, seed: int = 42) -> Pipeline:
    index = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
    vec = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    if model == "forest":
        est = RandomForestClassifier(labelCol="label_idx", weightCol="weight", numTrees=trees, maxDepth=8, seed=seed)
    else:
        est = LogisticRegression(labelCol="label_idx", weightCol="weight", maxIter=50, regParam=0.01)
    return Pipeline(stages=[index, vec, est])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted and confidence. df may lack the label."""
    labels = model.stages[0].labels
    x = df if "label" in df.columns else df.withColumn("label", F.lit(labels[0]))
    out = model.transform(x)
    names = F.array(*[F.lit(v) for v in labels])
    p = vector_to_array("probability")
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    return out.withColumn("predicted", F.coalesce(F.get(names, best), F.lit(labels[0]))).withColumn("confidence", F.array_max(p)).withColumn("probabilities", F.slice(p, 1, len(labels)))


def cross_validate(df: DataFrame, names: list[str], key: str, model: str = "forest", k: int = 5, **kw) -> DataFrame:
    """fold, n, accuracy, macro_f1."""
    f = dataset.folds(df, "label", key, k).cache()
    out = None
    for fold in range(k):
        m = pipeline(names, model, **kw).fit(weighted(f.where(F.col("fold") != fold)))
        row = evaluate.summary(predict(m, f.where(F.col("fold") == fold)), "label", "predicted").withColumn("fold", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    return out


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.avg("macro_f1").alias("macro_f1"))


def calibrate(predicted: DataFrame, labels: list[str], label: str = "label"):
    """One isotonic regression per class on rows held out from training."""
    models = []
    for k, name in enumerate(labels):
        x = predicted.select(F.get("probabilities", F.lit(k)).alias("p"), (F.col(label) == name).cast("double").alias("y"))
        vec = VectorAssembler(inputCols=["p"], outputCol="f")
        models.append(IsotonicRegression(featuresCol="f", labelCol="y", predictionCol="c").fit(vec.transform(x)))
    return models


def calibrated(predicted: DataFrame, models: list) -> DataFrame:
    """predicted with probabilities calibrated and made to sum to one."""
    x = predicted
    for k, m in enumerate(models):
        bounds, values = [float(v) for v in m.boundaries.toArray()], [float(v) for v in m.predictions.toArray()]
        p, c = F.get("probabilities", F.lit(k)), F.lit(values[-1])
        for b0, v0, b1, v1 in reversed(list(zip(bounds, values, bounds[1:], values[1:]))):
            c = F.when(p <= b1, F.lit(v0) + (p - b0) * ((v1 - v0) / (b1 - b0) if b1 > b0 else 0.0)).otherwise(c)
        x = x.withColumn(f"_c{k}", F.when(p <= bounds[0], F.lit(values[0])).otherwise(c))
    total = sum((F.col(f"_c{k}") for k in range(len(models))), F.lit(0.0))
    arr = F.array(*[F.when(total > 0, F.col(f"_c{k}") / total).otherwise(1.0 / len(models)) for k in range(len(models))])
    return x.withColumn("probabilities", arr).drop(*[f"_c{k}" for k in range(len(models))])


def majority(df: DataFrame, label: str = "label") -> DataFrame:
    """df with predicted: the commonest label."""
    top = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(1).select(F.col(label).alias("predicted"))
    return df.crossJoin(F.broadcast(top))  # one row


def importances(model: PipelineModel, names: list[str], most: int = 10) -> list[tuple[str, float]]:
    pairs = zip(names, model.stages[-1].featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda x: (-x[1], x[0]))[:most]


def positional_split(df: DataFrame, order: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows in order, and the rest, by a quantile of the order instead of a global row number."""
    cut = df.approxQuantile(order, [share], 0.001)[0]
    return df.where(F.col(order) <= cut), df.where(F.col(order) > cut)
