"""Reports, checks of tables, and signals in long form on rows whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from panelia.functions.scalars import relocated_path
from panelia.operators import beats, reports, resampled, waveforms


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_steady_beats_are_all_valid(spark):
    times = [("a", 0.8 * i) for i in range(200)] + [("b", 1.0), ("b", 2.0), ("c", 0.0), ("c", 0.8), ("c", 1.6), ("c", 5.6), ("c", 6.4)]
    found = {r["k"]: r for r in beats.beat_metrics(spark.createDataFrame(times, "k string, t double"), "k", "t").collect()}
    a, b, c = found["a"], found["b"], found["c"]
    assert (a["rr_total"], a["nn_valid"], a["sampen_status"]) == (199, 199, "estimable_candidate")
    assert a["mean_hr_bpm"] == pytest.approx(75) and a["rmssd_ms"] == pytest.approx(0, abs=1e-6) and a["longest_contiguous_s"] == pytest.approx(199 * 0.8)
    assert (b["rr_total"], b["nn_valid"], b["nn_valid_fraction"], b["longest_contiguous_s"], b["mean_hr_bpm"]) == (1, 0, 0.0, 0.0, None)
    assert (c["rr_total"], c["nn_valid"]) == (4, 2)  # the long interval and the one after it leap


def test_windows_at_ends_and_gaps_are_left_out(spark):
    samples = spark.createDataFrame([("r", i, float(i * i % 7)) for i in range(20) if i != 10], "k string, i int, y double")
    events = spark.createDataFrame([("r", i) for i in (0, 3, 9, 15, 19)], "k string, i int")
    w = beats.event_windows(samples, events, "k", "i", "y", -2, 3)
    assert rows(w.select("event").distinct(), "event") == [(3,), (15,)]
    assert rows(beats.morphology_score(w, "k"), "n_windows", "score") == [(2, 0.0)]
    same = spark.createDataFrame([("r", i, float(i % 5 == 0)) for i in range(30)], "k string, i int, y double")
    w = beats.event_windows(same, spark.createDataFrame([("r", i) for i in (5, 10, 15, 20)], "k string, i int"), "k", "i", "y", -2, 3)
    assert rows(beats.morphology_score(w, "k"), "n_windows", "score") == [(4, pytest.approx(1.0))]
    p = beats.projections(w, "k", {-2: 0, -1: 0, 0: 2, 1: 0, 2: 0}).collect()
    assert len(p) == 4 and all(r["correlation"] == pytest.approx(1) and r["factor"] == pytest.approx(0.5) for r in p)
    assert beats.projections(w.withColumn("y", F.lit(1.0)), "k", {0: 2}).count() == 0


def test_a_sine_is_found_again(spark):
    t = [("a", i / 10, 5 * math.sin(2 * math.pi * 3 / 60 * i / 10 + 0.4)) for i in range(1200)] + [("b", 0.0, 1.0), ("b", 1.0, None)]
    found = {r["k"]: r for r in waveforms.sine_fit(spark.createDataFrame(t, "k string, t double, y double"), "k", "t", "y", 3.0).collect()}
    assert found["a"]["amplitude"] == pytest.approx(5, abs=1e-6) and found["a"]["phase"] == pytest.approx(0.4, abs=1e-6)
    assert found["b"]["amplitude"] is None


def test_band_integral_of_a_line(spark):
    f = spark.createDataFrame([("a", x / 2, x / 2) for x in range(11)] + [("b", 1.0, 3.0)], "k string, f double, p double")
    assert rows(waveforms.band_integral(f, "k", "f", "p", 1.3, 3.9), "k", "integral") == [("a", pytest.approx((3.9**2 - 1.3**2) / 2)), ("b", 0.0)]


def test_steps(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 2.0, 2.0, 4.0])] + [("b", 0, 1.0)], "k string, i int, y double")
    assert rows(waveforms.step_profile(s, "k", "i", "y"), "k", "n_steps", "zero_share", "modal_share") == [("a", 4, 0.25, 0.5), ("b", 0, None, 1.0)]


@pytest.mark.parametrize("n", [1, 2, 40, 500])
def test_ranks_by_enumeration(spark, n):
    mass = [math.comb(n, k) * 0.025**k * 0.975 ** (n - k) for k in range(n + 1)]
    low = max(k for k in range(n + 1) if sum(mass[:k]) <= 0.025)
    high = min(s for s in range(1, n + 2) if sum(mass[s:]) <= 0.025)
    sizes = spark.createDataFrame([(n,), (n,), (0,), (None,)], "n int")
    assert rows(resampled.order_ranks(sizes, "n", 0.025, 0.05), "n", "lower_rank", "upper_rank") == [(n, low, high)]


def test_differences_of_cells(spark):
    schema = "k int, x double, s string"
    actual = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0 + 1e-14, "b"), (3, None, None), (4, 1.0, "d"), (6, None, "f")], schema)
    expected = spark.createDataFrame([(1, 1.1, "A"), (2, 2.0, "b"), (3, None, None), (5, 1.0, "e"), (6, 0.0, "f")], schema)
    found = reports.cell_differences(actual, expected, ["k"])
    assert sorted((r["k"], r["cell"] or "", r["reason"]) for r in found.collect()) == [(1, "s", "value"), (1, "x", "number"), (4, "", "unexpected"), (5, "", "absent"), (6, "x", "defined_on_one_side")]
    assert reports.cell_differences(actual.limit(0), expected.limit(0), ["k"]).count() == 0


def test_selected_results_and_modules(spark):
    r = spark.createDataFrame([("a", 1, "m", 20, 0.5), ("a", 2, "n", 19, 0.4), ("a", 2, "m", 20, 0.1), ("a", 2, "m", 20, 0.2), ("a", 3, "q", 20, 0.1), ("b", 1, "m", 20, 0.9)], "cell string, prefix int, model string, repeats int, v double")
    found = reports.selected_results(r, {"cell": "a"}, ["prefix"], "model", ["n", "m"], "repeats", 20, ["v"])
    assert rows(found.withColumn("place", F.coalesce("place", F.lit(-1))), "prefix", "model", "place", "status") == [(1, "m", 1, ""), (2, "m", 1, "repeated_key"), (2, "n", 0, "incomplete_repeats"), (3, "q", -1, "unknown_model")]
    modules = spark.createDataFrame([("x", 10, "r1"), ("y", 20, "r2")], "id string, planned int, run string")
    attempts = spark.createDataFrame([("x", "boot", 5), ("x", "boot", 5), ("x", "fold", 1), ("x", "fold", 2)], "id string, target string, n int")
    found = reports.module_table(modules, "id", "planned", "run", attempts, "target", "n", ["boot", "fold"]).orderBy("id").collect()
    assert [(r["historical_planned_replicates"], r["boot"], r["fold"], r["disagreeing"]) for r in found] == [(10, 5, None, "fold"), (20, None, None, "")]


def test_sparse_curves_and_cohort(spark):
    p = [("a", 2, 5.0, "observed", ""), ("a", 1, 3.0, "observed", ""), ("a", 3, None, "missing", ""), ("b", 1, 1.0, "observed", ""), ("b", 1, 2.0, "observed", ""), ("c", 1, float("nan"), "observed", ""), ("d", 1, None, "termination_E", "E")]
    panel = spark.createDataFrame(p, "subject_id string, time_min int, vas double, status string, termination_code string")
    assert rows(reports.sparse_curves(panel, 1, 10), "subject_id", "minutes", "scores", "reason") == [("a", [1, 2], [3.0, 5.0], ""), ("b", [], [], "duplicate_minute"), ("c", [], [], "invalid_score")]
    table = {r["place"]: r for r in reports.cohort_table(panel).collect()}
    assert (table[1]["participants_or_value"], table[2]["participants_or_value"], table[5]["scores_or_predictions"]) == ("4", "1 / 0 / 3", "1 eligible predictions")
    assert len(reports.cohort_table(panel.limit(0)).collect()) == 6


def test_relocated_paths(spark):
    paths = ["D:\\Study\\raw\\a.csv", "d:/study", "D:/studying/x", "D:/study/../x", "E:/old/y..z", None]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    found = frame.select("i", relocated_path(F.col("p"), ["D:\\study\\", "e:/old"], "/data").alias("x")).orderBy("i").collect()
    assert [tuple(r["x"]) for r in found] == [("/data/raw/a.csv", "relocated"), ("/data", "relocated"), ("D:/studying/x", ""), (None, "parent_traversal"), ("/data/y..z", "relocated"), (None, "")]
