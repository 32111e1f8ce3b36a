"""Rosters of resampling jobs, precision of interval endpoints, components of curves from one aggregation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelia.kernels.distributions import rank_interval
from panelia.kernels.functional import trapezoid_weights


def job_roster(spark: SparkSession, cells: list[str], replicates: int, batch: int) -> DataFrame:
    """(job, cell, start, stop): every cell's replicates in batches, in order."""
    if batch < 1 or replicates < 1:
        raise ValueError("batches and replicates must be positive")
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, cells))).alias("place", "cell"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(batch)))
    jobs = rows.select("place", "cell", starts.alias("start"))
    per = -(-replicates // batch)
    return jobs.select((F.col("place") * per + F.col("start") / batch).cast("int").alias("job"), "cell", "start", F.least(F.col("start") + batch, F.lit(replicates)).alias("stop"))


def endpoint_precision(draws: DataFrame, key: str, value: str, probabilities: tuple[float, ...] = (0.025, 0.975), gamma: float = 0.01, low: float | None = None, high: float | None = None) -> DataFrame:
    """For each key the order statistics of rank ceil(B p), with Monte Carlo bounds from exact binomial ranks.

    ``low`` and ``high`` stand in where a rank falls outside the draws.  A key's draws are one statistic's replicates.
    """
    kind = draws.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows[value].to_numpy(float))
        x = x[np.isfinite(x)]
        out = []
        for p in probabilities if len(x) else ():
            r, s = rank_interval(len(x), p, gamma)
            centre = x[max(0, math.ceil(len(x) * p) - 1)]
            a, b = x[r - 1] if r else low, x[s - 1] if s <= len(x) else high
            out.append((rows[key].iloc[0], p, len(rows), len(x), centre, a, b, None if a is None or b is None else max(centre - a, b - centre)))
        return pd.DataFrame(out, columns=[key, "probability", "attempted", "valid", "estimate", "low", "high", "half_width"])

    return draws.select(key, value).groupBy(key).applyInPandas(run, f"{key} {kind}, probability double, attempted long, valid long, estimate double, low double, high double, half_width double")


def observed_intervals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each non-null value's distance to the non-null value before it, with how many rows lie between."""
    every = Window.partitionBy(key).orderBy(order)
    known = rows.withColumn("row", F.row_number().over(every)).where(F.col(value).isNotNull())
    before = lambda c: F.lag(c).over(every)
    return known.select(key, "row", before("row").alias("previous_row"), (F.col(value) - before(value)).alias("interval")).where("previous_row is not null").withColumn("skipped", F.col("row") - F.col("previous_row") - 1)


@dataclass(frozen=True)
class CurveComponents:
    people: int
    mean: np.ndarray
    phi: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def curve_components(curves: DataFrame, column: str, grid: list[float], most: int = 4) -> CurveComponents:
    """Principal functions of any number of complete curves: the covariance is one aggregation of G (G + 3) / 2 sums."""
    n = len(grid)
    y = lambda i: F.get(column, F.lit(i))
    sums: list[Column] = [F.count("*").alias("n"), *(F.sum(y(i)).alias(f"s{i}") for i in range(n)), *(F.sum(y(i) * y(j)).alias(f"q{i}_{j}") for i in range(n) for j in range(i, n))]
    row = curves.where((F.size(column) == n) & F.forall(column, lambda x: x.isNotNull())).agg(*sums).first()
    people = row["n"]
    if people < 2:
        raise ValueError("two complete curves are needed")
    mean = np.array([row[f"s{i}"] for i in range(n)], float) / people
    second = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    covariance = (second - people * np.outer(mean, mean)) / (people - 1)
    root = np.sqrt(trapezoid_weights(grid))
    value, vector = np.linalg.eigh(covariance * np.outer(root, root))
    value, vector = value[::-1], vector[:, ::-1]
    m = min(most, n, people - 1)
    phi = vector[:, :m] / root[:, None]
    phi *= np.sign(phi[np.abs(phi).argmax(0), np.arange(m)])
    return CurveComponents(people, mean, phi, value[:m], value[:m] / value.clip(0).sum())


def component_scores(curves: DataFrame, key: str, column: str, grid: list[float], c: CurveComponents) -> DataFrame:
    """(key, score_1, ...): each curve's scores on the components, as weighted sums of its values."""
    weights = trapezoid_weights(grid)[:, None] * c.phi
    shift = c.mean @ weights
    score = lambda k: sum((F.get(column, F.lit(i)) * float(weights[i, k]) for i in range(len(grid))), F.lit(-float(shift[k])))
    return curves.select(key, *(score(k).alias(f"score_{k + 1}") for k in range(c.phi.shape[1])))
