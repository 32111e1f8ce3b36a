"""Sources, sinks, names and the command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelia import cli
from panelia.functions import names, scalars
from panelia.operators import admission, joins, waveforms
from panelia.sources import files
from panelia.sources.panel import ContractError


def test_encodings_and_headers(spark, tmp_path):
    for encoding in ("utf-8-sig", "gb18030"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes("ID,名字\n1,张三\n".encode(encoding))
        frame = files.read_text_table(spark, str(path))
        assert frame.columns == ["ID", "名字"] and frame.first()[1] == "张三"
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ContractError):
        files.read_text_table(spark, str(tmp_path / "d.csv"))


def test_sinks_never_overwrite(spark, tmp_path):
    frame = spark.range(3)
    files.write_table(frame, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        files.write_table(frame, str(tmp_path / "t"))
    with pytest.raises(ContractError):
        files.write_table(frame.select(), str(tmp_path / "u"))


def test_instrument_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(files.instrument_file("2024/01/31", [[0.0, 1, 2, 3, 4, 5, 6], [0.1, 7, 8, 9, 10, 11, 12]]))
    rows = files.read_headed_table(spark, str(tmp_path / "a.txt")).orderBy("t", "channel", "species").collect()
    assert len(rows) == 12 and str(rows[0]["date"]) == "2024-01-31"
    assert {(r["channel"], r["species"]): r["value"] for r in rows if r["t"] == 0.1}[1, "total"] == 12.0
    found = files.scan_files(spark, str(tmp_path), (".txt",)).collect()
    assert [r["name"] for r in found] == ["a.txt"]
    for bad in ("/x", "../x", "c:x"):
        with pytest.raises(ContractError):
            files.confined("r", bad)
    assert files.confined("r", "a\\b") == "r/a/b"


def test_names(spark):
    frame = spark.createDataFrame([("12. Anna Li (late) 14:30", "20240131_007_Abc_N.acq"), ("x", "y")], "line string, file string")
    a, b = frame.select(names.participant_line(F.col("line")).alias("p"), names.recording_name(F.col("file")).alias("r"), names.modality(F.lit("/raw/A.ACQ")).alias("m")).collect()
    assert tuple(a["p"]) == ("12", "Anna Li", "14:30") and (a["r"]["code"], a["r"]["label"], a["r"]["stage"]) == ("7", "abc", "N") and tuple(a["m"]) == ("electrophysiology", "raw")
    assert b["p"] is None and b["r"] is None
    dates = spark.createDataFrame([("see 3/5", datetime(2024, 3, 1), None), ("on 1/2", datetime(2023, 12, 30), None), ("none", datetime(2024, 3, 1), datetime(2024, 3, 9)), ("none", datetime(2024, 3, 1), datetime(2024, 2, 9))], "t string, s timestamp, i timestamp")
    got = [str(r[0]) for r in dates.select(names.target_date(F.col("t"), F.col("s"), F.to_date("i")))
           .collect()]
    assert got == ["2024-03-05", "2024-01-02", "2024-03-09", "2024-03-01"]


def test_scalars(spark):
    frame = spark.createDataFrame([("01:02:03.5",), ("1:60:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in frame.select(scalars.hms_seconds(F.col("t"))).collect()] == [3723.5, None, None, None]
    low, high = spark.range(1).select(scalars.wilson(F.lit(5), F.lit(10)).alias("w")).select("w.*").first()
    assert (low, high) == (pytest.approx(0.236593, abs=1e-6), pytest.approx(0.763407, abs=1e-6))
    assert spark.range(1).select(scalars.wilson(F.lit(0), F.lit(0))["low"]).first()[0] is None


def test_registry_and_claims(spark):
    rows, registry = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int"), spark.createDataFrame([("a", "x")], "path string, owner string")
    with pytest.raises(ContractError, match="no decision"):
        joins.apply_registry(rows, registry, "path", "owner")
    with pytest.raises(ContractError, match="more than one owner"):
        joins.apply_registry(rows, registry.unionByName(spark.createDataFrame([("a", "y")], registry.schema)), "path", "owner")
    assert joins.apply_registry(rows.where("v = 1"), registry, "path", "owner").first()["owner"] == "x"


def test_weights_do_not_cross_gaps(spark):
    frame = spark.createDataFrame([("r", float(t), float(t), False) for t in (1, 2, 3, 9, 10)], "r string, t double, x double, bad boolean")
    w = {x["t"]: x["weight"] for x in waveforms.support_weights(frame, "r", "t", 0.5, 9.5).collect()}
    assert w == {1.0: 0.5, 2.0: 1.0, 3.0: 1.0, 9.0: 0.0, 10.0: 0.5}
    mean = waveforms.supported_mean(waveforms.support_weights(frame, "r", "t", 0.5, 9.5), "r", "x", "bad", 0.5, 9.5).first()
    assert mean["mean"] == pytest.approx((0.5 + 2 + 3 + 5) / 3) and mean["coverage"] == pytest.approx(3 / 9)


def test_complete_scores(spark):
    frame = spark.createDataFrame([("1", "2"), ("1", ""), ("1", "11")], "a string, b string")
    assert [r[0] for r in frame.select(admission.complete_scores(frame, ["a", "b"], 0, 10)).collect()] == [True, False, False]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.csv").write_text("ID,VAS_1min,VAS_2min\na,1,E\nb,0,\n")
    cli.main(["validate", str(tmp_path / "w.csv"), str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"long": 4, "minutes": 2, "subjects": 2}
    with pytest.raises(Exception, match="exists"):
        cli.main(["validate", str(tmp_path / "w.csv"), str(tmp_path / "out")])
    cli.main(["doctor"])
    assert "spark" in json.loads(capsys.readouterr().out.splitlines()[-1])
