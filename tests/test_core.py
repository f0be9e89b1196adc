"""Exact fixtures for the fund research operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fundlake.functions.codes import base_name, fix_code, norm_code, share_class, type_reason, zfill_code
from fundlake.operators import backtest, diagnostics, factors, portfolio, quality, returns, scoring
from fundlake.sources import nav as sources

D = date.fromisoformat
NAV = "fund_code string, date date, nav double, acc_nav double, daily_return double"


def near(x, y):
    return x == pytest.approx(y, abs=1e-12)


def test_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("1", "1.0", "sh600000", "1234567", "abc", " ", None)], "c string")
    assert [r[0] for r in df.select(norm_code(F.col("c"))).collect()] == ["000001", "000001", "600000", "1234567", "abc", "", ""]
    assert [r[0] for r in df.select(fix_code(F.col("c"))).collect()] == ["000001", "000010", "600000", "", "000000", "000000", "000000"]
    assert df.select(zfill_code(F.col("c"))).first()[0] == "000001"


def test_names(spark):
    names = spark.createDataFrame([("示例偏股混合A",), ("示例偏股混合C",), ("示例偏股混合(后端)",), ("示例偏股混合",)], "n string")
    assert [r[0] for r in names.select(share_class(F.col("n"))).collect()] == ["A", "C", "B", "original"]
    assert {r[0] for r in names.select(base_name(F.col("n"))).collect()} == {"示例偏股混合"}
    kinds = spark.createDataFrame([("股票型", "x"), ("混合型-偏股", "x"), ("债券型-长债", "x")], "t string, n string")
    assert [r[0] for r in kinds.select(type_reason(F.col("t"), F.col("n"))).collect()] == ["", "", "TYPE_NOT_ALLOWED"]


def test_caps(spark):
    w = spark.createDataFrame([("x", "A", 0.8), ("x", "B", 0.1), ("x", "C", 0.1), ("y", "A", 1.0), ("y", "B", 0.0), ("y", "C", 0.0)], "as_of string, fund_code string, weight double")
    out = {(r[0], r[1]): r[2] for r in portfolio.cap_weights(w, 0.4).collect()}
    assert near(out["x", "A"], 0.4) and near(out["x", "B"], 0.3) and near(out["y", "A"], 1.0)


def _weights(spark, *rows):
    return spark.createDataFrame([("e", D(d), f, w) for d, f, w in rows], "experiment string, as_of date, fund_code string, weight double")


def test_turnover(spark):
    w = _weights(spark, ("2024-01-02", "A", 1.0), ("2024-01-02", "B", 0.0), ("2024-02-01", "A", 0.0), ("2024-02-01", "B", 1.0))
    rows = sorted(backtest.turnover(w).collect(), key=lambda r: r.as_of)
    assert near(rows[0].turnover, 0) and near(rows[1].turnover, 1) and near(rows[1].traded_notional, 2) and near(rows[1].cost, 0.002)


def test_next_day_effect_and_omitted_holding(spark):
    days = ("2024-01-02", "2024-01-03", "2024-01-04")
    w = _weights(spark, ("2024-01-02", "A", 1.0), ("2024-01-02", "B", 0.0), ("2024-01-03", "A", 0.0), ("2024-01-03", "B", 1.0))
    r = spark.createDataFrame([(f, D(d), x) for f, xs in (("A", (0.0, 0.1, 0.0)), ("B", (0.0, 0.0, 0.2))) for d, x in zip(days, xs, strict=True)], "fund_code string, date date, ret double")
    curve, trades = backtest.simulate(r, w)
    c = sorted(curve.collect(), key=lambda x: x.date)
    assert [str(x.date) for x in c] == list(days[1:]) and near(c[0].gross_return, 0.1) and near(c[1].net_return, 0.198)
    assert [str(x.effective_date) for x in sorted(trades.collect(), key=lambda x: x.as_of)] == list(days[1:])


def test_performance(spark):
    rows = spark.createDataFrame([("k", None, 0, 0.1), ("k", None, 1, -0.1)], "k string, date date, pos int, ret double")
    m = backtest.performance(rows, ["k"]).first()
    assert near(m.total_return, -0.01) and near(m.final_equity, 0.99) and near(m.max_drawdown, -0.1)


def test_returns_and_factors(spark):
    nav = spark.createDataFrame([("000001", D("2024-01-01"), 1.0, 1.0, None), ("000001", D("2024-01-02"), 0.8, 1.0, 0.02), ("000001", D("2024-01-03"), 0.7, 1.0, -0.01)], NAV)
    assert [r.ret for r in returns.to_returns(nav).orderBy("date").collect()] == [0.02, -0.01]
    rets = spark.createDataFrame([("A", D(f"2024-01-0{k}"), 0.01) for k in range(1, 6)], "fund_code string, date date, ret double")
    bench = returns.equal_weight_benchmark(rets)
    one = factors.compute_factors(rets, bench, factors.latest(rets), 5).collect()
    assert len(one) == 1 and one[0].sharpe is None and near(one[0].mdd, 0)
    few = rets.where("date < '2024-01-05'")
    assert factors.compute_factors(few, bench, factors.latest(few), 5).count() == 0


def test_score_direction(spark):
    f = spark.createDataFrame([(D("2024-01-01"), k, x) for k, x in (("A", -0.1), ("B", -0.2), ("C", -0.4))], "as_of date, fund_code string, mdd double")
    rows = scoring.score_funds(f, scoring.scheme_table(spark, {"s": {"mdd": 1.0}})).orderBy("rank").collect()
    assert [r.fund_code for r in rows] == ["A", "B", "C"]
    with pytest.raises(ValueError):
        scoring.scheme_table(spark, {"s": {"mdd": 0.0}})


def test_bins(spark):
    n = spark.createDataFrame([(12, 5, i) for i in range(1, 13)] + [(7, 3, i) for i in range(1, 8)], "n int, g int, i int")
    for size, g, expected in ((12, 5, [3, 2, 2, 2, 3]), (7, 3, [2, 2, 3])):
        rows = n.where(F.col("n") == size).select((1 + F.size(F.filter(diagnostics.bin_edges(F.col("n"), g), lambda e: F.col("i") > e))).alias("b")).groupBy("b").count().orderBy("b").collect()
        assert [r[1] for r in rows] == expected


def test_checks(spark):
    nav = spark.createDataFrame([("000001", D("2024-01-01"), 1.0, None, None)], NAV)
    wanted = spark.createDataFrame([("000001",), ("000002",)], "fund_code string")
    found = {r.check for r in quality.check_nav(nav, wanted, "2024-01-10").collect()}
    assert found == {"missing_fund", "stale_pool", "metadata"}


def test_upsert(spark):
    target = spark.createDataFrame([("000001", D("2024-01-01"), 1.0, 5.0, 0.1)], NAV)
    batch = spark.createDataFrame([("1", D("2024-01-01"), None, 1), ("2", D("2024-01-01"), 3.0, 1), ("2", D("2024-01-01"), 4.0, 2)], "fund_code string, date date, nav double, o int")
    rows = {r.fund_code: r for r in sources.upsert_nav(target, batch, "o").collect()}
    assert rows["000001"].nav is None and rows["000001"].acc_nav == 5.0 and rows["000002"].nav == 4.0


def test_dirty_nav(spark):
    raw = spark.createDataFrame([("1", "2024-01-01", "1.1", "1.2", "1.23%", 1), ("1", "2024-01-01", "9", "9", "9%", 2), ("1", "bad", "1", "1", "--", 3), ("1", "2024-01-02", "1.0", "--", "--", 4)], "fund_code string, `净值日期` string, `单位净值` string, `累计净值` string, `日增长率` string, o int")
    rows = sources.clean_raw_nav(raw, "o").orderBy("date").collect()
    assert len(rows) == 2 and near(rows[0].daily_return, 0.0123) and rows[1].acc_nav is None and rows[1].daily_return is None


def test_stream_late_correction_and_restart(spark, tmp_path):
    """A correction wins, rows far behind are dropped, raw codes meet their stored fund, a new checkpoint keeps the old store."""
    from fundlake.streaming.nav import current, stream_upsert_nav

    schema = NAV + ", ts timestamp_ntz"
    store, inbox = f"{tmp_path}/store", f"{tmp_path}/in"

    def arrive(mark, *rows):
        data = [(c, D(d), v, None, None, t) for c, d, v, t in rows]
        spark.createDataFrame(data, schema.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(inbox)
        stream_upsert_nav(spark.readStream.schema(schema).parquet(inbox), store, f"{tmp_path}/{mark}").awaitTermination()
        return {(r.fund_code, str(r.date)): r.nav for r in current(spark, store).collect()}

    first = arrive("a", ("000001", "2024-01-10", 1.0, "2024-01-10 20:00:00"), ("000002", "2024-03-01", 5.0, "2024-03-01 20:00:00"))
    assert first == {("000001", "2024-01-10"): 1.0, ("000002", "2024-03-01"): 5.0}
    second = arrive("a", ("1", "2024-01-10", 1.5, "2024-01-11 20:00:00"), ("1", "2024-01-02", 9.0, "2024-01-11 20:00:00"), ("1", "2024-01-11", None, "2024-01-11 20:00:00"))
    assert second == first | {("000001", "2024-01-10"): 1.5}
    third = arrive("b", ("3", "2024-01-10", 7.0, "2024-01-12 20:00:00"))
    assert third == second | {("000003", "2024-01-10"): 7.0}


def test_stream_benchmark(spark, tmp_path):
    from fundlake.streaming.nav import run_to_table, stream_benchmark

    rows = [("2024-01-01 10:00:00", 0.1), ("2024-01-01 12:00:00", 0.3), ("2024-02-01 10:00:00", 0.5)]
    spark.createDataFrame(rows, "ts string, ret double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/r")
    out = run_to_table(stream_benchmark(spark.readStream.schema("ts timestamp, ret double").parquet(f"{tmp_path}/r")), str(tmp_path)).collect()
    assert [(str(r.date), r.bench_ret, r.funds) for r in out] == [("2024-01-01", pytest.approx(0.2), 2)]


def test_universe_stages(spark, tmp_path):
    from fundlake.operators import universe

    raw = [("000001", "A", "股票型", ""), ("000002", "B", "债券型", "2010-01-01"), ("000003", "C", "混合型-偏股", "2030-01-01"), ("000004", "D", "股票型", "2001-01-01")]
    spark.createDataFrame(raw, ["基金代码", "基金简称", "基金类型", "成立日期"]).coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    catalog = universe.read_catalog(spark, f"{tmp_path}/c")
    audit, keep = universe.build_universe(catalog, None, "2020-01-01", "2021-01-01", stage="prepare", warn=True, as_of="2024-05-01")
    got = {r.fund_code: (r.status, r.exclude_reason) for r in audit.collect()}
    assert got["000002"] == ("excluded", "TYPE_NOT_ALLOWED") and {k for k, v in got.items() if v[0] == "candidate"} == {r.fund_code for r in keep.collect()} and keep.count() > 0
    assert {r.metadata_as_of for r in audit.collect()} == {"2024-05-01"} and {r.fund_code for r in universe.universe_review(audit).collect()} <= {"000001"}


def test_return_ladder_and_few_dates(spark):
    """Provider returns from 80 % of the later rows on, accumulated NAV from 95 % on; gaps with and without filling."""
    rows = []
    for fund, own, acc in (("p80", 80, 0), ("p79", 79, 0), ("a95", 0, 96), ("a94", 0, 95)):
        for k in range(101):
            rows.append((fund, D("2024-01-01") + __import__("datetime").timedelta(days=k), 1.0 + k, 2.0 * (k + 1) ** 2 if k < acc else None, 0.5 if 1 <= k <= own else None))
    rets = returns.to_returns(spark.createDataFrame(rows, NAV))
    first = {r.fund_code: r.ret for r in rets.where("date = '2024-01-02'").collect()}
    assert first == {"p80": 0.5, "p79": 1.0, "a95": 3.0, "a94": 1.0}
    gap = spark.createDataFrame([("x", D(f"2024-01-0{k}"), v, None, None) for k, v in ((1, 1.0), (2, None), (3, 2.0))], NAV)
    assert [r.ret for r in returns.to_returns(gap).orderBy("date").collect()] == [0.0, 1.0] and returns.to_returns(gap, fill="none").count() == 0
    with pytest.raises(Exception, match="fewer than 5 dates"):
        returns.rebalance_dates(gap, "month", 5).collect()


def test_score_checks_and_stores(spark, tmp_path):
    none = spark.createDataFrame([], "as_of date, fund_code string, score double")
    assert [(r.check, r.value) for r in quality.check_scores(none, 10, 5, factors=True).orderBy("check").collect()] == [("empty", 0), ("no_factors", 0)]
    stored = spark.createDataFrame([(D("2024-01-01"), "000001", 0.5, 1.0, 1)], "date date, fund_code string, weight_equal double, score double, rank int")
    batch = spark.createDataFrame([(D("2024-01-01"), "1", 1.0), (D("2024-01-01"), "2", 0.0)], "date date, fund_code string, weight_equal double")
    got = sources.upsert_portfolio(stored, batch)
    sources.write_result(got, f"{tmp_path}/p")
    assert {(r.fund_code, r.weight_equal, r.rank) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {("000001", 1.0, 1), ("000002", 0.0, None)}
    codes = spark.createDataFrame([(1, "b"), (0, "a")], "pos int, fund_code string")
    row = sources.run_manifest(codes, top=3).first()
    assert row.universe_count == 2 and row.universe_sha256 == __import__("hashlib").sha256(b"a\nb").hexdigest() and row.facts == '{"top":3}'
