"""Statistics of panels and pairs: quantiles, areas, fixed effects, ranks, clocks, adjacency of event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.operators.descriptives import in_time, mean
from panelia.operators.ordered import harmonic, least_from, running_counts, same
from panelia.sources.shared import written


def quantile_linear(x: Column, p: float) -> Column:
    """Linear between order statistics (type 7)."""
    return F.percentile(x, F.lit(p))


def quantile_rank(x: str, p: float) -> Column:
    """The order statistic of rank ceil(n p)."""
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def burden(series: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Area, time centroid and share of the area after the midpoint, of series complete over [first, last].

    Pieces are linear; the piece that the midpoint cuts is split there.  A zero area has no centroid and no share.
    """
    order = Window.partitionBy(*keys).orderBy("time_min")
    inside = series.where(F.col("time_min").between(first, last) & F.col("vas").isNotNull())
    t, a, b = F.col("time_min"), F.col("vas"), F.lead("vas").over(order)
    mid = (first + last) / 2
    rows = inside.withColumn("b", b)
    area = (a + F.col("b")) / 2
    # first moment of the piece [t, t + 1]
    moment = (a * (3 * t + 1) + F.col("b") * (3 * t + 2)) / 6
    at_mid = a + (F.col("b") - a) * (mid - t)
    late = F.when(t >= mid, area).when(t + 1 > mid, (at_mid + F.col("b")) / 2 * (t + 1 - mid)).otherwise(0.0)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("vas").alias("low"), F.sum(area).alias("area"), F.sum(moment).alias("m"), F.sum(F.when(F.col("b").isNotNull(), late)).alias("late"))
    whole = out.where((F.col("n") == last - first + 1) & (F.col("low") >= 0))
    positive = F.when(F.col("area") > 0, F.col("area"))
    return whole.select(*keys, "area", (F.col("m") / positive).alias("centroid"), (F.col("late") / positive).alias("late_fraction"))


def standardized(frame: DataFrame, person: str, block: str, value: str, minimum: int = 2) -> DataFrame:
    """Within-person z-scores of people with ``minimum`` distinct blocks and a spread."""
    whole = Window.partitionBy(person)
    n = F.count(value).over(whole)
    total, square = F.sum(value).over(whole), F.sum(F.col(value) * F.col(value)).over(whole)
    sd = F.sqrt((n * square - total * total) / (n * (n - 1)))
    rows = frame.where(F.col(value).isNotNull()).withColumn("_b", F.size(F.collect_set(block).over(whole))).withColumn("_sd", F.when(n > 1, sd)).withColumn("_m", total / n)
    return rows.where((F.col("_b") >= minimum) & (F.col("_sd") > 0)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_sd")).drop("_b", "_sd", "_m")


def fixed_effect_slope(frame: DataFrame, person: str, y: str, x: str) -> DataFrame:
    """The slope of y on x with person effects, its CR1 standard error and the numbers of people and rows.

    A person's sufficient statistics are aggregated once; demeaning is algebra on them, and the score of a person
    needs the slope only, which one more aggregation over people gives.
    """
    per = frame.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(person).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("qx"), F.sum(F.col(x) * F.col(y)).alias("qxy"), F.sum(F.col(y) * F.col(y)).alias("qy")
    )
    per = per.where("n >= 2").select("n", (F.col("qx") - F.col("sx") * F.col("sx") / F.col("n")).alias("h"), (F.col("qxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("c"), (F.col("qy") - F.col("sy") * F.col("sy") / F.col("n")).alias("v"))
    # score_g = c_g - h_g b, so that the sum of its squares needs three sums
    sums = per.agg(F.count("*").alias("people"), F.sum("n").alias("rows"), F.sum("h").alias("H"), F.sum("c").alias("C"), F.sum("v").alias("V"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("h")).alias("ch"), F.sum(F.col("h") * F.col("h")).alias("hh"))
    b = F.try_divide(F.col("C"), F.col("H"))
    meat = F.col("cc") - 2 * b * F.col("ch") + b * b * F.col("hh")
    factor = F.try_divide(F.col("people"), F.col("people") - 1) * F.try_divide(F.col("rows") - 1, F.col("rows") - F.col("people") - 1)
    return sums.select("people", "rows", b.alias("slope"), F.sqrt(F.greatest(factor * meat, F.lit(0.0))).alias("_s"), "H", (F.col("V") - b * F.col("C")).alias("sse")).select("people", "rows", "slope", (F.col("_s") / F.col("H")).alias("se_cr1"), "sse")


def average_rank(frame: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks inside a key, ties at their mean."""
    places = running_counts(frame, keys, value)
    ranked = frame.join(places, same(frame, places, [*keys, value]))
    return ranked.select(*(frame[c] for c in frame.columns), (F.col("below") + (F.col("n") + 1) / 2).alias(name))


def spearman(frame: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each key; NULL under three rows or without a spread."""
    rows = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # twice the ranks, whole; they add up to n (n + 1).  Squares outgrow a long at a million rows of a key
    whole = lambda c: (2 * F.col(c)).cast("decimal(15,0)")
    ranked = average_rank(average_rank(rows, keys, x, "_rx"), keys, y, "_ry").select(*keys, whole("_rx").alias("a"), whole("_ry").alias("b"))
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("a")).alias("qa"), F.sum(F.col("b") * F.col("b")).alias("qb"), F.sum(F.col("a") * F.col("b")).alias("qab"))
    n, up = F.col("n"), (F.col("n") + 1).cast("decimal(12,0)")
    centre = F.col("n").cast("decimal(12,0)") * up * up
    va, vb, vab = ((F.col(q) - centre).cast("double") for q in ("qa", "qb", "qab"))
    rho = vab / (F.sqrt(va) * F.sqrt(vb))
    return s.select(*keys, "n", F.when((n >= 3) & (va > 0) & (vb > 0), rho).alias("rho"))


def adjust(frame: DataFrame, p: str, method: str = "BY", family: int | None = None) -> DataFrame:
    """False-discovery-adjusted q of the p-values (BH or BY); NULL stays NULL.  The table is one family."""
    valid = frame.where(F.col(p).isNotNull() & ~F.isnan(p))
    rest = frame.where(F.col(p).isNull() | F.isnan(p)).withColumn("q", F.lit(None).cast("double"))
    size = family or frame.count()
    factor = harmonic(size) if method == "BY" else 1.0
    # equal p-values share the last of their ranks, which is what the running minimum gives them
    places = running_counts(valid, [], p)
    bounds = places.withColumn("_q", F.col(p) * size * factor / (F.col("below") + F.col("n")))
    q = least_from(bounds, p, "_q").select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.col("least")).alias("q"))
    return valid.join(q, F.col(p) == F.col("_p")).drop("_p").unionByName(rest)


def clock_fit(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares clock (slope, intercept) on the fit anchors, and the largest error on held-out ones.

    ``anchors``: keys, device_time, reference_time, held_out.
    """
    fit = F.when(~F.col("held_out"), F.lit(1.0))
    x, y = F.col("device_time"), F.col("reference_time")
    model = anchors.groupBy(*keys).agg(F.regr_slope(fit * y, fit * x).alias("slope"), F.regr_intercept(fit * y, fit * x).alias("intercept"), F.count(fit).alias("n_fit"))
    error = F.abs(y - (F.col("slope") * x + F.col("intercept")))
    return anchors.join(model, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n_fit").alias("n_fit"), F.max(F.when(F.col("held_out"), error)).alias("max_holdout_error"))


def event_gaps(times: DataFrame, key: str, t: str) -> DataFrame:
    """Each event with the gap to the one before."""
    return times.withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t)))


def gap_summary(times: DataFrame, key: str, t: str, low: float, high: float) -> DataFrame:
    """Rate and successive differences of plausible gaps; a difference never reaches over a gap that is not plausible."""
    gaps = event_gaps(times, key, t).where("gap is not null").withColumn("ok", F.col("gap").between(low, high))
    order = Window.partitionBy(key).orderBy(t)
    d = F.when(F.col("ok") & F.lag("ok").over(order), F.col("gap") - F.lag("gap").over(order))
    ok = F.when(F.col("ok"), F.col("gap"))
    return gaps.withColumn("d", d).groupBy(key).agg(F.count(ok).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_flagged"), mean(ok).alias("mean_gap"), F.count("d").alias("n_pairs"), F.sqrt(mean(F.col("d").cast("double") * F.col("d"))).alias("rmssd"))


def continuity_blocks(times: DataFrame, key: str, t: str, low: float, high: float, jump: float) -> DataFrame:
    """Plausible gaps with a block number that grows where neighbours differ by more than ``jump`` (log ratio) or a gap is flagged."""
    order = Window.partitionBy(key).orderBy(t)
    gaps = event_gaps(times, key, t).where("gap is not null").withColumn("ok", F.col("gap").between(low, high))
    previous = F.lag("gap").over(order)
    edge = ~F.coalesce(F.lag("ok").over(order), F.lit(False)) | (F.abs(F.ln(F.col("gap")) - F.ln(previous)) > F.ln(F.lit(1 + jump)))
    return gaps.withColumn("edge", (F.col("ok") & edge).cast("int")).withColumn("block", F.sum("edge").over(order)).where("ok").select(key, t, "gap", "block")


def time_segments(times: DataFrame, key: str, t: str, factor: float = 1.5) -> DataFrame:
    """Stretches without a gap over ``factor`` times the key's median gap."""
    gaps = event_gaps(times, key, t)
    median = gaps.where("gap is not null").groupBy(key).agg(F.median("gap").alias("m"))
    cut = gaps.join(median, key).withColumn("new", F.coalesce((F.col("gap") > factor * F.col("m")).cast("int"), F.lit(0)))
    return cut.withColumn("segment", F.sum("new").over(Window.partitionBy(key).orderBy(t))).groupBy(key, "segment").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def block_support(panel: DataFrame, size: int = 5, least: int = 3) -> DataFrame:
    """The longest run of observed minutes in each block of ``size`` minutes (the first of equals), if it has ``least``."""
    block = F.floor((F.col("time_min") - 1) / size).cast("int")
    rows = panel.where("status = 'observed'").withColumn("block", block)
    order = Window.partitionBy("subject_id", "block").orderBy("time_min")
    runs = rows.withColumn("i", F.col("time_min") - F.row_number().over(order)).groupBy("subject_id", "block", "i").agg(F.min("time_min").alias("start_min"), F.max("time_min").alias("end_min"), F.count("*").alias("n"), F.sum("vas").alias("s"))
    best = runs.groupBy("subject_id", "block").agg(F.max_by(F.struct("start_min", "end_min", "n", "s"), F.struct("n", -F.col("start_min"))).alias("r"))
    return best.where(F.col("r.n") >= least).select("subject_id", "block", "r.start_min", "r.end_min", (F.col("r.n") == size).alias("complete"), (F.col("r.s") / F.col("r.n")).alias("vas_mean"))


def lagged_features(panel: DataFrame) -> DataFrame:
    """Three consecutive scores before each observed score: training rows of the next-score task."""
    back = lambda k: F.when((F.lag("status", k).over(in_time()) == "observed") & (F.lag("time_min", k).over(in_time()) == F.col("time_min") - k), F.lag("vas", k).over(in_time()))
    rows = panel.select("subject_id", "time_min", "status", back(3).alias("x1"), back(2).alias("x2"), back(1).alias("x3"), F.col("vas").alias("y"))
    return rows.where("status = 'observed' and x1 is not null and x2 is not null and x3 is not null").drop("status")


def last_value_errors(features: DataFrame) -> DataFrame:
    """MAE and mean squared error of the last value, by window and by person."""
    e = F.col("y") - F.col("x3")
    per = features.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("q"))
    return per.agg(F.sum("n").alias("n_windows"), F.count("*").alias("n_people"), (F.sum("a") / F.sum("n")).alias("mae_window"), (F.sum("q") / F.sum("n")).alias("mse_window"), (F.sum(F.col("a") / F.col("n")) / F.count("*")).alias("mae_person"))


def complete_series(series: DataFrame, n_minutes: int) -> DataFrame:
    """The scores of subjects that have ``n_minutes`` of them."""
    whole = Window.partitionBy("subject_id")
    return series.where("vas is not null").withColumn("_n", F.count("*").over(whole)).where(F.col("_n") == n_minutes).drop("_n")


def band_depth(series: DataFrame, n_minutes: int) -> DataFrame:
    """(subject_id, depth, central): modified band depth of complete series, and whether a series is of the deeper half.

    At each minute the share of pairs of series that enclose the score; minutes are weighted by the trapezoid rule.
    NULL with one series or one minute.
    """
    rows = complete_series(series, n_minutes)
    places = running_counts(rows, ["time_min"], "vas")
    # one row a minute
    minutes = places.groupBy("time_min").agg(F.sum("n").alias("people"))
    t = F.col("time_min")
    steps = [F.coalesce(F.lead(t).over(Window.orderBy(t)) - t, F.lit(0)), F.coalesce(t - F.lag(t).over(Window.orderBy(t)), F.lit(0))]
    minutes = minutes.select("time_min", "people", (steps[0] + steps[1]).cast("long").alias("w"))
    less, n = F.col("below"), F.col("people")
    more = n - less - F.col("n")
    pairs = n * (n - 1) / 2
    inside = (pairs - less * (less - 1) / 2 - more * (more - 1) / 2).cast("long")
    marked = rows.select("subject_id", "time_min", "vas").join(places.join(minutes, "time_min").select("time_min", "vas", "w", inside.alias("k"), pairs.cast("long").alias("pairs")), ["time_min", "vas"])
    depths = marked.groupBy("subject_id").agg(F.try_divide(F.sum(F.col("w") * F.col("k")).cast("double"), F.sum(F.col("w") * F.col("pairs"))).alias("depth"))
    depths = written(depths, "depths")
    order = running_counts(depths, [], "depth")
    total = order.agg(F.sum("n").alias("people"))
    half = order.join(F.broadcast(total)).where(F.col("people") - F.col("below") >= F.ceil(F.col("people") / 2)).agg(F.max("depth").alias("cutoff"))
    return depths.join(F.broadcast(half)).select("subject_id", "depth", (F.col("depth") >= F.col("cutoff") - 1e-12).alias("central"))


def band_envelope(series: DataFrame, n_minutes: int) -> DataFrame:
    """(time_min, low, high): the range of the central series at each minute."""
    central = band_depth(series, n_minutes).where("central").select("subject_id")
    return complete_series(series, n_minutes).join(central, "subject_id").groupBy("time_min").agg(F.min("vas").alias("low"), F.max("vas").alias("high"))


def two_way_slope(frame: DataFrame, person: str, block: str, y: str, x: str, sweeps: int = 4) -> DataFrame:
    """The slope after alternately taking person and block means away, ``sweeps`` times."""
    rows = frame.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(person, block, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    for _ in range(sweeps):
        for key in (person, block):
            means = rows.groupBy(key).agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
            rows = rows.join(means, key).select(person, block, (F.col("y") - F.col("my")).alias("y"), (F.col("x") - F.col("mx")).alias("x"))
    return rows.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("slope"))


