"""The monthly store: which months a version rewrites, what a repeated or broken batch leaves, what readers open."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fundlake.sources import nav as sources
from fundlake.sources.store import MonthlyStore

D = date.fromisoformat
NAV = "fund_code string, date date, nav double, acc_nav double, daily_return double"


def _nav(spark, *rows):
    return spark.createDataFrame([(c, D(d), v, None, None) for c, d, v in rows], NAV)


def _got(df):
    return {(r.fund_code, str(r.date)): r.nav for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    out = MonthlyStore(spark, f"{tmp_path}/s")
    out.upsert(_nav(spark, ("1", "2024-01-10", 1.0), ("2", "2024-01-11", 2.0), ("1", "2024-02-10", 3.0), ("1", "2024-03-10", 4.0)))
    return out


def test_only_touched_months_are_written(spark, store):
    assert store.snapshot().months == {"2024-01": 1, "2024-02": 1, "2024-03": 1}
    before = _got(store.read())
    s = store.upsert(_nav(spark, ("000001", "2024-02-10", None), ("3", "2024-02-12", 9.0), ("3", "2024-04-01", 8.0)))
    assert s.months == {"2024-01": 1, "2024-02": 2, "2024-03": 1, "2024-04": 2}
    assert _got(store.read()) == before | {("000001", "2024-02-10"): None, ("000003", "2024-02-12"): 9.0, ("000003", "2024-04-01"): 8.0}
    assert _got(store.read(version=1)) == before
    assert {r.fund_code: str(r.latest) for r in store.marks().collect()} == {"000001": "2024-03-10", "000002": "2024-01-11", "000003": "2024-04-01"}


def test_reads_open_only_the_months_asked_for(store):
    rows = store.read("2024-02-01", "2024-02-28")
    assert _got(rows) == {("000001", "2024-02-10"): 3.0} and all("month=2024-02" in f for f in rows.inputFiles())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-02-01)" in plan
    assert store.read("2025-01-01").count() == 0


def test_same_as_upsert_of_the_whole_table(spark, store):
    """Nulls overwrite, absent columns stay, the last row by order counts, rows without a date go."""
    whole = store.read()
    batch = spark.createDataFrame([("1", D("2024-01-10"), 5.0, 1), ("1", D("2024-01-10"), None, 2), ("7", D("2024-05-01"), 6.0, 1), ("7", None, 6.0, 1)], "fund_code string, date date, nav double, o int")
    expected = sources.upsert_nav(whole, batch.where("date is not null"), "o").collect()
    store.upsert(batch, "o")
    assert sorted(store.read().select("fund_code", "date", "nav", "acc_nav", "daily_return").collect()) == sorted(expected) or _got(store.read()) == {(r.fund_code, str(r.date)): r.nav for r in expected}


def test_repeated_batches_and_writers(spark, store):
    batch = _nav(spark, ("1", "2024-01-10", 7.0))
    first = store.upsert(batch, writer="a", number=0)
    assert store.upsert(_nav(spark, ("1", "2024-01-10", 8.0)), writer="a", number=0) == first and store.versions() == [1, 2]
    assert store.upsert(_nav(spark, ("1", "2024-01-10", 8.0)), writer="b", number=0).done == {"a": 0, "b": 0}
    store.vacuum(1)
    assert store.upsert(batch, writer="a", number=0).version == 3 and _got(store.read())["000001", "2024-01-10"] == 8.0


def test_a_run_that_fails_before_its_manifest_counts_for_nothing(spark, store, monkeypatch):
    before = _got(store.read())

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(OSError, match="lost"):
            store.upsert(_nav(spark, ("5", "2024-01-01", 1.0), ("5", "2024-06-01", 1.0)))
    assert _got(store.read()) == before and store.versions() == [1]
    s = store.upsert(_nav(spark, ("6", "2024-01-02", 1.0)))
    assert s.version == 2 and _got(store.read()) == before | {("000006", "2024-01-02"): 1.0}
    with pytest.raises(RuntimeError, match="by another"):
        store._commit(s)


def test_vacuum_keeps_what_the_last_versions_need(spark, store):
    for k in range(3):
        store.upsert(_nav(spark, ("1", "2024-02-10", float(k))))
    want = _got(store.read())
    assert store.vacuum(2) == 4 and store.versions() == [3, 4]  # two of the month, two of the marks
    assert _got(store.read()) == want and _got(store.read(version=3))["000001", "2024-02-10"] == 1.0
    with pytest.raises(ValueError, match="no version 1"):
        store.read(version=1)
    with pytest.raises(ValueError, match="is kept"):
        store.vacuum(0)


def test_columns_that_come_later(spark, tmp_path):
    store = MonthlyStore(spark, f"{tmp_path}/s")
    assert store.read().count() == 0 and store.marks().count() == 0 and store.versions() == []
    plain = spark.createDataFrame([("1", D("2024-01-10"), 1.0), ("1", D("2024-02-10"), 2.0)], "fund_code string, date date, nav double")
    store.upsert(plain)
    store.upsert(plain.where("date > '2024-02-01'").withColumn("acc_nav", F.lit(4.0)))
    assert {str(r.date): r.acc_nav for r in store.read().collect()} == {"2024-01-10": None, "2024-02-10": 4.0}
