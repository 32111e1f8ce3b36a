"""The panel contract, and hand-computed values of its operators."""

import pytest

from panelia.operators import descriptives, joins, kernels, missingness, statistics, stopping
from panelia.sources.panel import ContractError, Scale, classify_wide, read_wide, to_wide

SCALE = Scale(0.0, 10.0)


def wide(spark, *rows, minutes=4):
    names = ["ID", *(f"VAS_{m}min" for m in range(1, minutes + 1))]
    return spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))


def panel(spark, *rows, minutes=4):
    out = classify_wide(wide(spark, *rows, minutes=minutes), SCALE)
    assert out.where("reject is not null").count() == 0
    return out.drop("reject")


def one(frame):
    (row,) = frame.collect()
    return row


def test_statuses(spark):
    rows = panel(spark, ("a", "1", " e ", "", None), ("b", "0", "N/A", "nan", "10")).orderBy("subject_id", "time_min").collect()
    assert [r["status"] for r in rows] == ["observed", "termination_E", "post_termination", "post_termination", "observed", "missing", "missing", "observed"]
    assert [r["termination_code"] for r in rows] == ["", "E", "E", "E", "", "", "", ""]
    assert [r["vas"] for r in rows] == [1.0, None, None, None, 0.0, None, None, 10.0] and rows[1]["raw_token"] == " e "


@pytest.mark.parametrize(
    "cells, reason",
    [(("1", "E", "2", ""), "number after a marker"), (("1", "E", "T", ""), "mixed markers"), (("x", "", "", ""), "unknown token"), (("11", "", "", ""), "score outside the scale"), (("inf", "", "", ""), "unknown token"), (("1d", "", "", ""), "unknown token")],
)
def test_rejects(spark, cells, reason):
    assert reason in {r["reject"] for r in classify_wide(wide(spark, ("a", *cells)), SCALE).collect()}


def test_duplicate_and_blank_ids(spark):
    assert {r["reject"] for r in classify_wide(wide(spark, ("a", *"1234"), ("a", *"1234")), SCALE).collect()} == {"duplicate id"}
    assert {r["reject"] for r in classify_wide(wide(spark, (" ", *"1234")), SCALE).collect()} == {"blank id"}


def test_read_wide_and_back(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("ID,VAS_1min,VAS_2min,VAS_3min\na,1,2.5,E\nb,,NA,0\n")
    rows = read_wide(spark, str(path), SCALE)
    assert rows.count() == 6
    again = {r["ID"]: tuple(r)[1:] for r in to_wide(rows, range(1, 4)).collect()}
    assert again == {"a": ("1.0", "2.5", "E"), "b": ("", "", "0.0")}
    path.write_text("ID,VAS_1min,VAS_1min\na,1,2\n")
    with pytest.raises(ContractError):
        read_wide(spark, str(path), SCALE)
    path.write_text("ID,VAS_1min,VAS_2min\na,E,2\n")
    with pytest.raises(ContractError, match="after a marker"):
        read_wide(spark, str(path), SCALE)


def test_gaps_are_not_bridged(spark):
    r = one(descriptives.subject_summary(panel(spark, ("a", "1", "", "8", "10"))))
    assert (r["raw_mssd"], r["n_adjacent_pairs"], r["observed_adjacent_auc"]) == (4.0, 1, 9.0)
    r = one(descriptives.subject_summary(panel(spark, ("a", "2", "", "6", "8"))))
    assert (r["observed_adjacent_auc"], r["auc_covered_minutes"]) == (7.0, 1)
    r = one(descriptives.subject_summary(panel(spark, ("a", "", "", "", ""))))
    assert r["mean_observed_vas"] is None and r["raw_sd"] is None and r["observed_adjacent_auc"] is None and r["n_observed"] == 0


def test_zero_is_a_value(spark):
    r = one(descriptives.subject_summary(panel(spark, ("a", "0", "0", "0", "0"))))
    assert (r["mean_observed_vas"], r["raw_sd"], r["raw_mssd"], r["peak_at_last_observation"]) == (0.0, 0.0, 0.0, True)


def test_bounds_and_area(spark):
    p = panel(spark, ("a", "4", "E", ""), ("b", "6", "", "8"), minutes=3)
    rows = {r["time_min"]: r for r in stopping.bounded_means(p, SCALE).collect()}
    assert (rows[1]["cohort_mean_lower"], rows[1]["cohort_mean_upper"]) == (5.0, 5.0)
    assert (rows[2]["cohort_mean_lower"], rows[2]["cohort_mean_upper"], rows[2]["width_due_to_E"], rows[2]["width_due_to_other_missing"]) == (0.0, 10.0, 5.0, 5.0)
    area = one(stopping.area_bounds(stopping.bounded_means(p, SCALE)))
    assert (area["candidate_mean_auc_lower"], area["candidate_mean_auc_upper"]) == (4.5, 16.0 + 1.0 - 0.0 - 0.0)


def test_marker_support(spark):
    p = panel(spark, ("a", "0", "0", "E", ""), ("b", "1", "0", "E", ""), ("c", "", "0", "E", ""), ("d", "1", "T", "", ""))
    got = {r["subject_id"]: r["E_recorded_support"] for r in stopping.audit_stopping(p).collect()}
    assert got == {"a": "two_preceding_recorded_zeros", "b": "not_two_preceding_recorded_zeros_requires_review", "c": "preceding_numeric_window_unavailable", "d": "not_applicable"}
    changed = {(r["subject_id"], r["time_min"]) for r in missingness.recode_connected_zeros(p).collect()}
    assert changed == {("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("c", 2), ("c", 3)}


def test_states_and_spells(spark):
    points = missingness.state_points(panel(spark, ("a", "0", "3", "6", "10")), [3.0, 6.0])
    assert [r["state"] for r in points.orderBy("time_min").collect()] == [0, 1, 2, 2]
    spells = missingness.state_spells(points).orderBy("start_min").collect()
    assert [(r["state"], r["n_observed"], r["left_censored"], r["right_censored"]) for r in spells] == [(0, 1, True, False), (1, 1, False, False), (2, 2, False, True)]


def test_composition_identity(spark):
    p = panel(spark, ("a", "1", "3", "", ""), ("b", "", "7", "1", ""), ("c", "5", "6", "2", "4"))
    for r in missingness.adjacent_composition(p, range(1, 5)).where("defined").collect():
        assert r["observed_mean_change"] == pytest.approx(r["paired_observed_change"] + r["composition_total"])


def test_burden(spark):
    r = one(statistics.burden(panel(spark, ("a", "1", "2", "3", "4", "5"), minutes=5), ["subject_id"], 1, 5))
    assert (r["area"], r["late_fraction"]) == (12.0, pytest.approx(8 / 12)) and r["centroid"] == pytest.approx(124 / 36)
    r = one(statistics.burden(panel(spark, ("a", "0", "0", "0", "0")), ["subject_id"], 1, 4))
    assert r["area"] == 0 and r["centroid"] is None and r["late_fraction"] is None


def test_alias_chains(spark):
    frame = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "alias string, canonical string")
    assert {r["alias"]: r["canonical"] for r in joins.canonical_ids(frame).collect()} == {"a": "c", "b": "c", "x": "y"}
    with pytest.raises(ContractError):
        joins.canonical_ids(frame.unionByName(spark.createDataFrame([("c", "a")], frame.schema)))


def test_deidentify(spark):
    a, b = spark.createDataFrame([(1, "x", 5)], "id int, name string, v int"), spark.createDataFrame([(1, 7)], "id int, w int")
    out = joins.deidentify({"a": a, "b": b}, {"a": ["v"], "b": ["w"]}, "id", "0123456789abcdef")
    assert out["a"].columns == ["token", "v"] and one(out["a"])["token"] == one(out["b"])["token"]
    with pytest.raises(ContractError):
        joins.deidentify({"a": a}, {"a": ["none"]}, "id", "0123456789abcdef")


def test_draws_do_not_depend_on_partitions(spark):
    p = panel(spark, *((f"s{i}", str(i % 10), str(i % 7), "", str(i % 3)) for i in range(12)))
    draw = lambda n: {(r["replicate"], r["time_min"]): r["mean"] for r in kernels.bootstrap_minutes(p, 5, "x", 8, 4, partitions=n).collect()}
    assert draw(1) == draw(5)
    assert all(v is None for (_, t), v in draw(2).items() if t == 3)
    assert kernels.poisson_bootstrap(p, 1, 50).count() == 150
