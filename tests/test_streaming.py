from datetime import datetime, timedelta

from panelia.streaming import windows


def test_windows_of_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=20 * i), "a" if i % 2 else "b", float(i)) for i in range(60)] + [(start + timedelta(hours=5), "a", 0.0)]
    spark.createDataFrame(rows, "ts timestamp, key string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, key string, value double").parquet(str(tmp_path / "in"))
    for name, make in (("blocks", windows.block_counts), ("epochs", windows.sliding_epochs), ("spells", windows.spells)):
        query = make(stream()).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("select sum(n) from blocks").first()[0] == 60
    assert spark.sql("select count(*) from blocks where n not between 7 and 8").first()[0] == 0
    assert spark.sql("select count(*), sum(n) from spells").first() == (2, 60)
    assert spark.sql("select max(n) from epochs").first()[0] <= 3
