"""Places in a global order, over several parts, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelia.operators import ordered, statistics


@pytest.fixture
def parted(spark):
    """Ranges stay in parts of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark):
    # one key and one value hold much of the table; a key and some values are NULL
    made = [(None if i % 17 == 0 else "a" if i % 3 else "b", None if i % 13 == 0 else float(i * 7919 % 41) if i % 4 else 5.0, i) for i in range(400)]
    return made, spark.createDataFrame(made, "k string, v double, i long")


def test_running_counts(parted):
    made, frame = rows(parted)
    found = ordered.running_counts(frame, ["k"], "v").collect()
    assert len({r.part for r in found}) > 1
    size = lambda v: -math.inf if v is None else v
    want = {(k, v): (sum(x == k and w == v for x, w, _ in made), sum(x == k and size(w) < size(v) for x, w, _ in made)) for k, v, _ in made}
    assert {(r.k, r.v): (r.n, r.below) for r in found} == want


def test_average_rank(parted):
    made, frame = rows(parted)
    found = {r.i: r.rank for r in statistics.average_rank(frame, ["k"], "v", "rank").collect()}
    size = lambda v: -math.inf if v is None else v
    for k, v, i in made:
        group = sorted(size(w) for x, w, _ in made if x == k)
        at = [j + 1 for j, w in enumerate(group) if w == size(v)]
        assert found[i] == sum(at) / len(at)


def test_spearman_of_many_rows(spark):
    # n times the sum of squared ranks is over 2**63
    n = 80_000
    frame = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") / 2).cast("long").alias("x"), (F.col("id") * 7919 % n).alias("y"))
    [r] = statistics.spearman(frame, ["k"], "x", "y").collect()
    i = np.arange(n)
    assert (r.n, r.rho) == (n, pytest.approx(np.corrcoef(i // 2 * 2 + 0.5, i * 7919 % n)[0, 1], abs=1e-12))


@pytest.mark.parametrize("method", ["BH", "BY"])
def test_adjust(parted, method):
    made = [(i, None if i % 50 == 0 else (i * 37 % 101 + 1) / 202.0) for i in range(300)]
    found = {r.i: r.q for r in statistics.adjust(parted.createDataFrame(made, "i long, p double"), "p", method).collect()}
    factor = sum(1 / j for j in range(1, 301)) if method == "BY" else 1
    known = sorted((p, i) for i, p in made if p is not None)
    least = 1.0
    for place in range(len(known), 0, -1):
        p, i = known[place - 1]
        least = min(least, p * 300 * factor / place)
        assert found[i] == pytest.approx(least, abs=1e-12)
    assert all(found[i] is None for i, p in made if p is None)


def test_band_depth_of_uneven_minutes(parted):
    curves = {"a": [1, 1, 9], "b": [2, 2, 2], "c": [3, 5, 3], "d": [4, 4, 4], "e": [9, 0, 5]}
    times = [1, 2, 5]
    frame = parted.createDataFrame([(s, t, float(v)) for s, c in curves.items() for t, v in zip(times, c)] + [("f", 1, 1.0)], "subject_id string, time_min int, vas double")
    weights = [0.5, 2.0, 1.5]

    def depth(s):
        total = 0.0
        for j, w in enumerate(weights):
            pairs = [(x, y) for x in curves for y in curves if x < y]
            total += w * sum(min(curves[x][j], curves[y][j]) <= curves[s][j] <= max(curves[x][j], curves[y][j]) for x, y in pairs) / len(pairs)
        return total / sum(weights)

    want = {s: depth(s) for s in curves}
    cutoff = sorted(want.values(), reverse=True)[math.ceil(len(want) / 2) - 1]
    found = {r.subject_id: r for r in statistics.band_depth(frame, 3).collect()}
    assert found.keys() == want.keys()
    for s in want:
        assert found[s].depth == pytest.approx(want[s]) and found[s].central == (want[s] >= cutoff - 1e-12)
    envelope = {r.time_min: (r.low, r.high) for r in statistics.band_envelope(frame, 3).collect()}
    central = [curves[s] for s in want if want[s] >= cutoff - 1e-12]
    assert envelope == {t: (min(c[j] for c in central), max(c[j] for c in central)) for j, t in enumerate(times)}


def test_empty(parted):
    none = parted.createDataFrame([], "subject_id string, time_min int, vas double")
    assert ordered.running_counts(none, ["time_min"], "vas").count() == 0
    assert statistics.band_depth(none, 3).count() == 0
    assert statistics.adjust(none.select(F.col("vas").alias("p")), "p").count() == 0


def test_harmonic():
    for n in (1, 64, 65, 1000):
        assert ordered.harmonic(n) == pytest.approx(sum(1 / i for i in range(1, n + 1)), abs=1e-12)
