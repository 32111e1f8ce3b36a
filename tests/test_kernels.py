"""Kernels against brute force, closed forms and known identities."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelia.kernels import clustering, distributions, functional, intervals, matching, regression, signal, streams
from panelia.operators import clusters, kernels


def brute_match(a, b, tolerance):
    best = (0, 0.0)
    for k in range(min(len(a), len(b)), 0, -1):
        found = [sum(abs(a[i] - b[j]) for i, j in zip(p, q, strict=True)) for p in itertools.combinations(range(len(a)), k) for q in itertools.combinations(range(len(b)), k) if all(abs(a[i] - b[j]) <= tolerance for i, j in zip(p, q, strict=True))]
        if found:
            return k, min(found)
    return best


def test_optimal_matching():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = np.sort(rng.uniform(0, 5, rng.integers(0, 6))), np.sort(rng.uniform(0, 5, rng.integers(0, 6)))
        pairs = matching.optimal_match(a, b, 0.7)
        k, cost = brute_match(a, b, 0.7)
        assert len(pairs) == k and sum(abs(a[i] - b[j]) for i, j in pairs) == pytest.approx(cost)
        assert len(matching.greedy_match(a, b, 0.7)) == k
    assert matching.event_jaccard([], [], 1) == 1.0
    with pytest.raises(ValueError):
        matching.optimal_match([1, 1], [2], 1)
    assert matching.match_report([1, 2], [2.05], 0.1)["sensitivity"] == 0.5


def test_offsets_and_clusters():
    a = np.array([0.0, 1.0, 2.5, 4.7])
    found = matching.audit_offsets(a, a + 3.2, 0.05)
    assert found["matches"] == 4 and found["offset"] == pytest.approx(3.2) and not found["ambiguous"]
    assert matching.audit_offsets(np.arange(5.0), np.arange(5.0), 0.05)["matches"] == 5
    assert matching.audit_offsets([], [1], 1)["status"] == "missing_events"
    assert matching.cluster_from_first([0, 0.9, 1.8, 3], 1).tolist() == [0, 0, 1, 2]
    assert matching.vote_clusters([[100], [102, 103], [300]], 5) == [(101, 2), (300, 1)]
    assert matching.strongest_apart([1, 3, 9], np.arange(10.0), 5).tolist() == [3, 9]


def test_anchor_rule():
    got = intervals.anchored([0.8, 0.82, 1.5, 0.8, 0.81, 5.0, 0.9], 0.3, 1.8, 0.25)
    assert [r["status"] for r in got] == [intervals.PLAUSIBLE, intervals.PLAUSIBLE, intervals.FLAGGED, intervals.PLAUSIBLE, intervals.PLAUSIBLE, intervals.FLAGGED, intervals.PLAUSIBLE]
    assert [r["block"] for r in got] == [0, 0, 0, 1, 1, 1, 2] and [r["relock"] for r in got] == [False, False, False, True, False, False, True]
    assert intervals.refractory([(0, 2), (5, 3), (50, 2), (60, 1)], 20) == [(5, 3), (50, 2)]
    rows = intervals.gap_rows([(0, 2), (200, 2), (400, 2), (610, 2)], 250)
    assert intervals.gap_statistics(rows)["n_pairs"] == 2
    r = intervals.normal_gaps([0, 1, 2, 3.1, 4], ["normal"] * 5, 0, 10, [(2.5, 2.6)])
    assert r["n"] == 3 and r["n_pairs"] == 1 and r["mean_ms"] == pytest.approx((1000 + 1000 + 900) / 3)


def test_anchored_gaps_of_lone_events(spark):
    frame = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 100.0), (3, 7.0)], "user_id long, t double")
    [r] = kernels.anchored_gaps(frame, "user_id", "t", 60.0, 86_400.0, 0.25).collect()
    assert r == (2, 1.0, 99.0, "plausible", 0, False)
    assert kernels.anchored_gaps(frame.where("user_id <> 2"), "user_id", "t", 60.0, 86_400.0, 0.25).collect() == []


def test_distributions():
    assert distributions.t_sf(0, 5) == pytest.approx(0.5)
    assert distributions.t_sf(1, 1) == pytest.approx(0.25)  # Cauchy
    assert distributions.t_ppf(0.975, 10) == pytest.approx(2.228138851964939)
    for n, p in ((7, 0.3), (40, 0.9)):
        exact = list(itertools.accumulate(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)))
        assert [distributions.binomial_cdf(k, n, p) for k in range(n)] == pytest.approx(exact[:-1])
    for n, p, gamma in ((50, 0.5, 0.05), (200, 0.025, 0.01), (20, 0.025, 0.05)):
        cdf = [distributions.binomial_cdf(k, n, p) for k in range(-1, n + 1)]  # cdf[k]: P(X <= k - 1)
        r = max([k for k in range(n + 1) if cdf[k] <= gamma / 2], default=0)
        s = min([k for k in range(1, n + 2) if 1 - cdf[k] <= gamma / 2], default=n + 1)
        assert distributions.rank_interval(n, p, gamma) == (r, s)


def test_streams_depend_on_names_only():
    assert (streams.multiplicities(1, "a", 7, 20) == streams.multiplicities(1, "a", 7, 20)).all()
    assert streams.integer_seed(1, "a") != streams.integer_seed(1, "b")
    assert streams.multiplicities(1, "a", 0, 20).sum() == 20


def panel(seed=0, people=12, blocks=4):
    rng = np.random.default_rng(seed)
    person, block = np.repeat(np.arange(people), blocks), np.tile(np.arange(blocks), people)
    x = rng.normal(size=(people * blocks, 2))
    y = x @ [1.5, -0.5] + rng.normal(size=people)[person] + block + rng.normal(size=len(x))
    return person, block, y, x


def test_fixed_effects_equal_dummies():
    person, block, y, x = panel()
    d = regression.prepare(person, block, y, x)
    r = regression.estimate(d)
    dummies = np.column_stack([x, person[:, None] == np.arange(12), block[:, None] == np.arange(1, 4)]).astype(float)
    full = np.linalg.lstsq(dummies, y, rcond=None)[0]
    assert r.value[:2] == pytest.approx(full[:2])
    # the sandwich from the rows, without sums by person
    bread = np.linalg.inv(d.x.T @ d.x)
    meat = sum(np.outer(u := d.x[d.person == p].T @ (d.y - d.x @ r.value)[d.person == p], u) for p in range(12))
    assert r.clustered() == pytest.approx(np.sqrt(np.diag(bread @ meat @ bread) * 12 / 11 * (len(d.y) - 1) / (len(d.y) - 12 - d.x.shape[1])))
    counts = np.random.default_rng(1).integers(0, 3, 12)
    again = np.concatenate([np.flatnonzero(person == p) for p in range(12) for _ in range(counts[p])])
    copies = np.repeat(np.arange(counts.sum()), 4)
    repeated = regression.estimate(regression.prepare(copies, block[again], y[again], x[again]))
    assert regression.solve(d, counts)[:2] == pytest.approx(repeated.value[:2])
    left = [regression.estimate(regression.prepare(*(v[person != p] for v in (person, block, y, x)))).value[0] for p in range(12)]
    deleted = regression.without_each(d, r)
    assert deleted[:, 0] == pytest.approx(left)
    assert regression.jackknife(deleted)[0] == pytest.approx(np.sqrt(11 / 12 * np.sum((np.array(left) - np.mean(left)) ** 2)))
    assert 0 < regression.wild(d, r, 0, 999, np.random.default_rng(2)) < 0.05
    # a replicate by refitting rows whose null residuals change sign
    null = np.linalg.lstsq(d.x[:, 1:], d.y, rcond=None)[0]
    sign = np.random.default_rng(5).choice([-1.0, 1.0], 12)
    flipped = d.x[:, 1:] @ null + sign[d.person] * (d.y - d.x[:, 1:] @ null)
    refit = regression.estimate(regression.Design(d.gram, regression.by_person(d, d.x * flipped[:, None]), d.x, flipped, d.person, d.absorbed))

    class Signs:
        def integers(self, low, high, size):
            return np.broadcast_to((1 - sign) / 2, size)

    for share, p in ((1 - 1e-9, 1.0), (1 + 1e-9, 0.5)):
        scaled = regression.Slopes(np.abs(refit.value) * share, refit.influence, refit.inflation, refit.rows)
        assert regression.wild(d, scaled, 0, 1, Signs()) == p
    c = regression.cr2(d)
    assert c["b"] == pytest.approx(r.value[0]) and 0.5 < c["se"] / r.clustered()[0] < 2 and 2 < c["df"] < 12
    with pytest.raises(ValueError):
        regression.prepare([1, 1], [1, 1], [1, 2], [[1], [2]])


def test_polynomial_residuals():
    r = regression.polynomial_residuals([1, 2, 3, 4, 6], [1, 3, 2, 5, 4], 0)
    assert r["residual_variance"] == pytest.approx(np.var([1, 3, 2, 5, 4], ddof=1)) and r["raw_mssd"] == pytest.approx((4 + 1 + 9) / 3)


def test_components():
    rng = np.random.default_rng(4)
    grid = np.array([1.0, 2, 4, 7, 8])
    y = rng.normal(size=(30, 5)) @ rng.normal(size=(5, 5))
    c = functional.components(y, grid)
    assert c.phi.T @ (c.weights[:, None] * c.phi) == pytest.approx(np.eye(4), abs=1e-10)
    errors = [functional.reconstruction_errors(c, y, k).mean() for k in range(5)]
    assert all(a > b for a, b in itertools.pairwise(errors))
    assert functional.principal_angle(c.phi, c.phi, c.weights, 3) == pytest.approx(0, abs=1e-5)
    assert functional.match_axes(c, c)[0] == [0, 1, 2, 3]


def test_splines():
    t = np.linspace(1, 20, 77)
    b, d = functional.spline_basis(t, 1, 20, 10)
    assert b.sum(1) == pytest.approx(np.ones(77)) and d.sum(1) == pytest.approx(np.zeros(77), abs=1e-12)
    h = 1e-6
    up, down = functional.spline_basis(t[1:-1] + h, 1, 20, 10)[0], functional.spline_basis(t[1:-1] - h, 1, 20, 10)[0]
    assert d[1:-1] == pytest.approx((up - down) / (2 * h), abs=1e-4)
    person, time = np.repeat(np.arange(25), 20), np.tile(np.arange(1, 21.0), 25)
    y = 0.3 * time + np.random.default_rng(0).normal(0, 0.1, 500)
    curve = functional.slope_curve(person, time, y, 1, 20)
    low, high = curve.band()
    assert ((low < 0.3) & (0.3 < high)).all() and len(curve.people) == 25 and (curve.support == 25).all()
    left = [functional.slope_curve(person[person != p], time[person != p], y[person != p], 1, 20).slope for p in range(25)]
    assert curve.error == pytest.approx(np.sqrt(24 * np.var(left, axis=0)))
    with pytest.raises(ValueError, match="rank"):
        functional.slope_curve(np.repeat(np.arange(25), 3), np.tile([1.0, 2, 3], 25), np.zeros(75), 1, 20, least_support=0)
    band = functional.simultaneous_band(np.eye(3), np.zeros(3), np.eye(3), np.random.default_rng(1))
    assert 2.2 < band["critical"] < 2.6


def slow_dtw(a, b, radius):
    inf = math.inf
    d = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= radius:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d.get((i - 1, j), inf), d.get((i, j - 1), inf), d.get((i - 1, j - 1), inf))
    return math.sqrt(d[len(a), len(b)])


def test_clustering():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(m, 0.3, (15, 6)) for m in (0, 3, 6)])
    truth = np.repeat([0, 1, 2], 15)
    matrix = clustering.dtw_matrix(x)
    assert matrix[3, 20] == pytest.approx(slow_dtw(x[3], x[20], 2)) and matrix == pytest.approx(matrix.T)
    for labels in (clustering.kmeans(x, 3, rng)[1], clustering.medoids(matrix, 3, rng)[1], clustering.fuzzy(x, 3, rng)[1]):
        assert clustering.adjusted_rand(truth, labels) == 1 and clustering.matched_jaccard(truth, labels, 3) == 1
    assert abs(clustering.adjusted_rand(truth, rng.integers(0, 3, 45))) < 0.2
    runs, notes = clustering.select_shapelets(x, truth, 3, 5, rng)
    assert runs.shape == (3, 3) and [n["label"] for n in notes] == [0, 1, 2]
    assert clustering.shapelet_distances(x[:2], x[:1, 1:4])[0, 0] == 0
    m = clustering.classifier_metrics([0, 0, 1], [0, 1, 1], 3)
    assert m["accuracy"] == pytest.approx(2 / 3) and m["balanced_accuracy"] == 0.75 and m["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 3)


def test_stability_of_many_people(spark):
    n, replicates, seed = 2100, 2, 5
    cell = F.pmod(F.xxhash64("id", "time_min"), F.lit(300)) + 900 * F.pmod("id", F.lit(2))
    panel = spark.range(n).withColumn("time_min", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(F.col("id").cast("string").alias("subject_id"), "time_min", cell.cast("double").alias("vas"))
    found = clusters.stability(panel, 4, "dtw_medoids", 3, replicates, seed).orderBy("replicate").collect()
    rows = panel.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("time_min", "vas"))).alias("y")).orderBy("subject_id").collect()
    x = np.array([[v.vas for v in r.y] for r in rows])
    distance = clustering.dtw_matrix(x)
    _, whole = clustering.medoids(distance, 3, streams.generator(seed, "dtw_medoids", 3, "whole"))
    for r in range(replicates):
        drawn = np.repeat(np.arange(n), streams.multiplicities(seed, "dtw_medoids-3", r, n))
        places, _ = clustering.medoids(distance[np.ix_(drawn, drawn)], 3, streams.generator(seed, "dtw_medoids", 3, r))
        labels = distance[:, drawn[places]].argmin(1)
        out = np.setdiff1d(np.arange(n), drawn)
        assert found[r] == (r, clustering.adjusted_rand(whole, labels), clustering.adjusted_rand(whole[out], labels[out]), clustering.matched_jaccard(whole, labels, 3))


def test_filter_and_resample():
    rate, t = 250, np.arange(0, 20, 1 / 250)
    s = signal.bandpass_sections(3, 5, 20, rate)
    gain = lambda f: np.ptp(signal.zero_phase(s, np.sin(2 * np.pi * f * t))[1000:4000]) / 2
    assert gain(10) == pytest.approx(1, abs=0.02) and gain(0.5) < 0.01 and gain(60) < 0.01 and gain(5) == pytest.approx(0.5, abs=0.02)
    x = np.sin(2 * np.pi * 3 * t) + 0.1 * t
    for target in (100, 50, 125):
        y = signal.resample(x, 250, target)
        at = np.arange(len(y)) / target
        assert len(y) == 20 * target and np.abs(y - np.sin(2 * np.pi * 3 * at) - 0.1 * at)[target:-target].max() < 0.01


def test_spectra():
    rate, t = 10, np.arange(0, 600, 0.1)
    rng = np.random.default_rng(0)
    x = 2 * np.sin(2 * np.pi * 0.05 * t) + rng.normal(0, 0.5, len(t))
    f, p, n = signal.welch(x, rate, 200)
    assert n == 5 and signal.spectral_peaks(f, p, 0.01, 0.15)["maximum_hz"] == pytest.approx(0.05, abs=0.005)
    noise = rng.normal(0, 0.5, len(t))
    f, p, _ = signal.welch(noise, rate, 20)
    assert np.trapezoid(p, f) == pytest.approx(0.25, rel=0.1)
    v = signal.slepians(300, 3, 5)
    assert v @ v.T == pytest.approx(np.eye(5), abs=1e-10)
    m = signal.run_spectrum(np.array([x, x + rng.normal(0, 0.5, len(t))])[:, :1500], rate)
    assert m["peak_cpm"] == pytest.approx(3, abs=0.5) and m["coherence"] > 0.5
    amplitude, phase = signal.fit_sine(x, rate, 3)
    assert amplitude == pytest.approx(2, abs=0.05) and phase == pytest.approx(-np.pi / 2, abs=0.05)


def test_masks():
    x = np.sin(np.arange(1000.0))
    x[200:260] = 1.0
    x[500] = np.nan
    mask = signal.usable_mask(x, 10)
    assert not mask[200:260].any() and not mask[500] and mask[100] and mask[300]
    assert signal.runs([0, 1, 1, 0, 1], 2) == [(1, 3)] and signal.runs([1, 1]) == [(0, 2)]
    y = np.cumsum(np.random.default_rng(0).normal(0, 0.01, 2000))
    y[1000:] += 50
    flag = signal.derivative_flags(y, 10, 8, 2, 60)
    assert flag[985:1015].all() and flag.mean() < 0.2


@pytest.mark.parametrize("case", ["regular", "irregular", "inverted", "line", "motion"])
def test_beats(case):
    rng = np.random.default_rng(5)
    x, beats = signal.synthetic_beats(case, rng)
    found = signal.detect_beats(x, 250) / 250
    report = matching.match_report(beats, found, 0.05)
    assert report["sensitivity"] > 0.95 and report["positive_predictive_value"] > 0.95
    leads = np.array([x, 0.8 * x, -x]) + rng.normal(0, 0.01, (3, len(x)))
    report = matching.match_report(beats, signal.detect_multilead(leads, 250) / 250, 0.08)
    assert report["sensitivity"] > 0.9
    for bad in (leads[:2], leads[:, :100], np.where(np.arange(len(x)) == 5, np.nan, leads)):
        with pytest.raises(ValueError):
            signal.detect_multilead(bad, 250)


def test_flat_has_no_beats_and_shifts_lower_agreement():
    assert len(signal.detect_beats(signal.synthetic_beats("flat", np.random.default_rng(0))[0], 250)) == 0
    places = np.sort(np.random.default_rng(1).choice(60 * 250, 70, replace=False))
    null = signal.shift_null([places, places + 1], 250, 60 * 250, np.random.default_rng(2))
    assert null["ratio"] is None or null["ratio"] > 3


def test_template_subtraction():
    rng = np.random.default_rng(3)
    n, events = 6000, np.arange(100, 5900, 90)
    shape = np.hanning(25) * np.cos(np.linspace(-6, 6, 25))  # symmetric: templates hold no mean and no trend
    shape -= np.hanning(25) * shape.sum() / np.hanning(25).sum()
    clean = np.sin(2 * np.pi * 0.05 * np.arange(n) / 100)
    x = clean.copy()
    for e in events:
        x[e - 10 : e + 15] += shape
    template = signal.estimate_template(x, events, 100)
    out, changed = signal.subtract_template(x + rng.normal(0, 0.01, n), events, template, 100)
    assert changed > 0.9 * len(events) and np.square(out - clean).mean() < 0.1 * np.square(x - clean).mean()
    same, none = signal.subtract_template(clean, events, template, 100)
    assert none <= len(events) and same.shape == clean.shape


def test_components_from_sums(spark):
    from panelia.operators import resampling

    rng = np.random.default_rng(6)
    grid = [1.0, 2.0, 4.0, 7.0]
    y = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) + 5
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(y)] + [(99, [1.0, None, 2.0, 3.0])], "id long, y array<double>")
    got, want = resampling.curve_components(frame, "y", grid, 3), functional.components(y, grid, 3)
    assert got.people == 40 and got.values == pytest.approx(want.values) and got.phi == pytest.approx(want.phi, abs=1e-8) and got.explained == pytest.approx(want.explained)
    scores = {r["id"]: r for r in resampling.component_scores(frame.where("id < 40"), "id", "y", grid, got).collect()}
    assert [scores[i]["score_2"] for i in range(40)] == pytest.approx(want.scores[:, 1], abs=1e-8)


def test_endpoints(spark):
    from panelia.operators import resampling

    frame = spark.createDataFrame([("a", float(i)) for i in range(1, 201)], "k string, v double")
    rows = resampling.endpoint_precision(frame, "k", "v", gamma=0.05).orderBy("probability").collect()
    r, s = distributions.rank_interval(200, 0.025, 0.05)
    assert rows[0]["estimate"] == 5 and rows[0]["low"] == (r or None) and rows[0]["high"] == s and rows[1]["estimate"] == 195
