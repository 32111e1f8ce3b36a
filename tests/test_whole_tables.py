"""Queries work on their whole tables."""

from panelia.plans import registry

SF = "/root/testdata/sf0.01"


def test_baseline_rows_reads_every_event(spark):
    rows = registry.queries()["baseline_rows"](spark, SF).select("ID", "status").collect()
    events = [r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    assert len(events) > 3000 and sorted(r["ID"] for r in rows) == sorted(events)

    def status(i):
        if i % 3 == 2:
            return "unknown_flag"
        if i % 3 == 0:
            return "conflict" if i % 4 else "not_applicable"
        return "missing" if i % 4 == 0 else "observed" if 0 < i % 30 <= 24 else "out_of_range"

    assert all(r["status"] == status(r["ID"]) for r in rows)
