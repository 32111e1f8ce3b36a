"""Grouped prediction with pyspark.ml: people never fall on both sides of a fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_fold(features: DataFrame, person: str, folds: int, seed: int) -> DataFrame:
    """A fold for every row, the same for all rows of a person."""
    return features.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), person), F.lit(folds)).cast("int"))


def models(inputs: list[str], trees: int = 50) -> dict[str, Pipeline]:
    start = [VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    return {
        "ridge": Pipeline(stages=[*start, LinearRegression(labelCol="y", elasticNetParam=0.0, regParam=0.1)]),
        "forest": Pipeline(stages=[*start, RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=6, seed=1)]),
    }


def held_out_predictions(features: DataFrame, person: str, inputs: list[str], last: str, folds: int = 5, seed: int = 1, trees: int = 50) -> DataFrame:
    """(person, time_min, y, last, ridge, forest): each row predicted by models that never saw its person."""
    rows = with_fold(features, person, folds, seed).cache()
    parts = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        out = test.withColumn("last", F.col(last))
        for name, pipeline in models(inputs, trees).items():
            out = pipeline.fit(train).transform(out).withColumn(name, F.col("prediction")).drop("raw", "features", "prediction")
        part = out.select(person, "time_min", "y", "last", "ridge", "forest")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def tuned_ridge(features: DataFrame, person: str, inputs: list[str], penalties: list[float], folds: int = 4, seed: int = 2):
    """A ridge model whose penalty has the least absolute error over folds of people."""
    pipeline = models(inputs)["ridge"]
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, penalties).build()
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y", metricName="mae"), numFolds=folds, foldCol="fold")
    return search.fit(with_fold(features, person, folds, seed))


def error_table(predictions: DataFrame, person: str) -> DataFrame:
    """MAE and RMSE of each model, weighing windows or people equally."""
    long = predictions.select(person, "y", F.explode(F.create_map(*(v for n in ("last", "ridge", "forest") for v in (F.lit(n), F.col(n))))).alias("model", "p"))
    e = F.abs(F.col("y") - F.col("p"))
    per = long.groupBy("model", person).agg(F.count("*").alias("n"), F.sum(e).alias("a"), F.sum(e * e).alias("q"))
    return per.groupBy("model").agg(
        (F.sum("a") / F.sum("n")).alias("mae_window"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse_window"), F.avg(F.col("a") / F.col("n")).alias("mae_person"), F.sqrt(F.avg(F.col("q") / F.col("n"))).alias("rmse_person")
    )
