"""The first-write ledger: periods above batches, and a batch that reads its own periods only."""

import os

from augury.streaming import jobs

SCHEMA = "k string, saved_at int, month string"


def test_batches_read_their_periods_only(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    write = jobs.first_write(ledger, "k", "month")
    write(spark.createDataFrame([("a", 1, "01"), ("b", 1, "02"), ("n", 1, None), ("o", 3, "03")], SCHEMA), 0)
    second = spark.createDataFrame([("a", 0, "01"), ("c", 5, "01"), ("c", 4, "01"), ("n", 0, None)], SCHEMA)
    known = jobs.known_keys(second, ledger, "k", "month", 1)
    assert sorted(r.k for r in known.collect()) == ["a", "n"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    write(second, 1)
    rows = lambda: sorted((r.k, r.saved_at) for r in spark.read.parquet(ledger).collect())
    want = [("a", 1), ("b", 1), ("c", 4), ("n", 1), ("o", 3)]
    assert rows() == want
    write(second, 1)  # a batch that is run again
    assert rows() == want
    assert {"month=01", "month=02", "month=03"} <= set(os.listdir(ledger))
    assert os.listdir(f"{ledger}/month=02") == ["batch=0"]
    write(second.where("k = '-'"), 2)
    assert rows() == want


def test_more_periods_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "NAMED_PERIODS", 1)
    ledger = str(tmp_path / "ledger")
    write = jobs.first_write(ledger, "k", "month")
    write(spark.createDataFrame([("a", 1, "01"), ("b", 1, "02"), ("n", 1, None)], SCHEMA), 0)
    write(spark.createDataFrame([("a", 0, "01"), ("b", 0, "02"), ("n", 0, None), ("z", 7, "09")], SCHEMA), 1)
    assert sorted((r.k, r.saved_at) for r in spark.read.parquet(ledger).collect()) == [("a", 1), ("b", 1), ("n", 1), ("z", 7)]
