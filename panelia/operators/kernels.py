"""Kernels applied to groups: one key's rows in memory, keys in parallel.

A key is one record or one subject, whose size the recording bounds; nothing is gathered over keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelia.kernels import intervals, matching, regression, signal, streams


def match_trains(left: DataFrame, right: DataFrame, key: str, time: str, tolerance: float, optimal: bool = True) -> DataFrame:
    """(key, left_time, right_time) of the one-to-one matching of each key's trains."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "left_time": [], "right_time": []})
        x, y = np.unique(a[time].to_numpy(float)), np.unique(b[time].to_numpy(float))
        pairs = matching.optimal_match(x, y, tolerance) if optimal else matching.greedy_match(x, y, tolerance)
        return pd.DataFrame({key: a[key].iloc[0], "left_time": [x[i] for i, _ in pairs], "right_time": [y[j] for _, j in pairs]})

    kind = left.schema[key].dataType.simpleString()
    return left.select(key, time).groupBy(key).cogroup(right.select(key, time).groupBy(key)).applyInPandas(run, f"{key} {kind}, left_time double, right_time double")


def anchored_gaps(times: DataFrame, key: str, time: str, low: float, high: float, jump: float) -> DataFrame:
    """(key, start, gap, status, block, relock): the anchor rule over each key's gaps; a key of one event has none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows[time].to_numpy(float))
        found = intervals.anchored(np.diff(t), low, high, jump)
        return pd.DataFrame({key: rows[key].iloc[0], "start": t[:-1], "gap": np.diff(t), "status": np.array([r["status"] for r in found], object), "block": [r["block"] for r in found], "relock": [r["relock"] for r in found]})

    kind = times.schema[key].dataType.simpleString()
    return times.select(key, time).groupBy(key).applyInPandas(run, f"{key} {kind}, start double, gap double, status string, block long, relock boolean")


def edge_clusters(times: DataFrame, key: str, time: str, span: float) -> DataFrame:
    """(key, cluster, start, end, n): clusters measured from their first event."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(rows[time].to_numpy(float))
        g = pd.DataFrame({"cluster": matching.cluster_from_first(t, span), "t": t}).groupby("cluster")["t"].agg(["min", "max", "size"]).reset_index()
        return pd.DataFrame({key: rows[key].iloc[0], "cluster": g["cluster"], "start": g["min"], "end": g["max"], "n": g["size"]})

    kind = times.schema[key].dataType.simpleString()
    return times.select(key, time).groupBy(key).applyInPandas(run, f"{key} {kind}, cluster long, start double, end double, n long")


def per_record(records: DataFrame, key: str, samples: str, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """``kernel`` of each record's sample array; a record that it refuses gives its message in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.strip().split(" ")[0] for p in schema.split(",")]
        for batch in batches:
            out = []
            for k, x in zip(batch[key], batch[samples], strict=True):
                try:
                    out.append({key: k, **kernel(np.asarray(x, float)), "error": None})
                except ValueError as e:
                    out.append({key: k, "error": str(e)})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, samples).mapInPandas(run, f"{key} {kind}, {schema}, error string")


def welch_summary(records: DataFrame, key: str, samples: str, rate: float, seconds: float, low: float, high: float) -> DataFrame:
    """Band maximum, edge flag and number of inner maxima of each record's Welch spectrum."""

    def kernel(x: np.ndarray) -> dict:
        f, p, n = signal.welch(x, rate, seconds)
        d = signal.spectral_peaks(f, p, low, high)
        return {"segments": n, "area": signal.band_area(f, p, low, high), "maximum_hz": d.get("maximum_hz"), "at_edge": d.get("at_edge"), "n_inner": d.get("n_inner")}

    return per_record(records, key, samples, kernel, "segments long, area double, maximum_hz double, at_edge boolean, n_inner long")


#: The largest panel that is shipped to every worker, in cells.
MOST_CELLS = 1 << 24


def bootstrap_minutes(panel: DataFrame, seed: int, stage: str, replicates: int, minutes: int = 20, partitions: int | None = None) -> DataFrame:
    """(replicate, time_min, mean, fraction): whole-person bootstrap of minute means and observed fractions.

    Draws depend on (seed, stage, replicate) only.  The panel is one matrix that every worker holds: its size is
    checked, and ``poisson_bootstrap`` serves larger ones.
    """
    spark = panel.sparkSession
    people = panel.select("subject_id").distinct().count()
    if people * minutes > MOST_CELLS:
        raise ValueError("the panel is too large to ship to every worker; use poisson_bootstrap")
    rows = panel.where("status = 'observed'").select("subject_id", "time_min", "vas").toPandas()
    names = sorted(r["subject_id"] for r in panel.select("subject_id").distinct().collect())
    place = {s: i for i, s in enumerate(names)}
    matrix = np.full((people, minutes), np.nan)
    matrix[rows["subject_id"].map(place).to_numpy(int), rows["time_min"].to_numpy(int) - 1] = rows["vas"]
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = shared.value
        seen = np.isfinite(values)
        filled = np.where(seen, values, 0.0)
        for batch in batches:
            for r in batch["id"].tolist():
                w = streams.multiplicities(seed, stage, r, len(values)).astype(float)
                n = w @ seen
                mean = np.divide(w @ filled, n, out=np.full(minutes, np.nan), where=n > 0)
                yield pd.DataFrame({"replicate": r, "time_min": np.arange(1, minutes + 1, dtype=np.int32), "mean": mean, "fraction": n / w.sum()})

    frame = spark.range(0, replicates, numPartitions=partitions or spark.sparkContext.defaultParallelism)
    out = frame.mapInPandas(run, "replicate long, time_min int, mean double, fraction double")
    return out.withColumn("mean", F.when(~F.isnan("mean"), F.col("mean")))


def poisson_bootstrap(panel: DataFrame, seed: int, replicates: int) -> DataFrame:
    """(replicate, time_min, mean): each person counts a Poisson(1) number of times in a replicate, by a hash of both.

    One aggregation with map-side sums, for panels of any size.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "subject_id", "replicate"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cuts, total, term = [], 0.0, float(np.exp(-1))
    for k in range(1, 12):
        total += term
        cuts.append(total)
        term /= k
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = panel.where("status = 'observed'").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    return rows.where("w > 0").groupBy("replicate", "time_min").agg((F.sum(F.col("w") * F.col("vas")) / F.sum("w")).alias("mean"))


def bootstrap_intervals(draws: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Interval endpoints as order statistics of rank ceil(B p)."""
    a = (1 - level) / 2
    return draws.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("valid"), F.expr(f"percentile_disc({a}) within group (order by {value})").alias("low"), F.expr(f"percentile_disc({1 - a}) within group (order by {value})").alias("high"))


def fixed_effects(frame: DataFrame, cell: str, person: str, block: str, y: str, x: list[str], seed: int = 0, replicates: int = 999) -> DataFrame:
    """One row a cell and predictor: slope with CR1 and CR3 inference and the wild bootstrap's p-value; a cell is one analysis panel."""
    schema = f"{cell} {frame.schema[cell].dataType.simpleString()}, predictor string, people long, rows long, slope double, se_cr1 double, p_cr1 double, se_cr3 double, p_cr3 double, p_wild double, error string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows[cell].iloc[0]
        try:
            d = regression.prepare(rows[person], rows[block], rows[y], rows[x].to_numpy(float))
            r = regression.estimate(d)
            cr1, cr3 = r.clustered(), regression.jackknife(regression.without_each(d, r))
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([{cell: name, "error": str(e)}], columns=[c.split(" ")[0] for c in schema.split(", ")])
        p1, p3 = r.table(cr1)["p"], r.table(cr3)["p"]
        out = [(name, p, r.people, r.rows, r.value[j], cr1[j], p1[j], cr3[j], p3[j], regression.wild(d, r, j, replicates, streams.generator(seed, str(name), p)), None) for j, p in enumerate(x)]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return frame.groupBy(cell).applyInPandas(run, schema)
