"""The workflows from NAV to their reports: dates, errors, manifests, and the same result from tables of their own."""

import hashlib
import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fundlake.jobs import research
from fundlake.operators import backtest, factors, portfolio, quality, returns
from fundlake.sources.tables import stored_by_fund

D = date.fromisoformat
NAV = "fund_code string, date date, nav double, acc_nav double, daily_return double"
SETTINGS = research.Settings(universe_limit=6, top_n=2, window=20, since="2023-01-01", min_history=5)


@pytest.fixture(scope="module")
def nav(spark):
    rnd, rows = random.Random(4), []
    for k in range(7):
        v = 1.0
        for d in range(200):
            v *= 1 + rnd.gauss(0.0005 * k, 0.01)
            rows.append((f"{k:06}", D("2023-01-01") + timedelta(days=d), v, None, None))
    return spark.createDataFrame(rows, NAV).cache()


@pytest.fixture(scope="module")
def funds(spark):
    return spark.createDataFrame([(f"{k:06}", 7 - k) for k in range(7)], "fund_code string, pos int")


def test_rolling_job(spark, nav, funds, tmp_path):
    run, manifest = research.rolling_job(spark, nav, funds, SETTINGS, f"{tmp_path}/r", start="2023-02-10", end="2023-06-15")
    facts = json.loads(manifest.first().facts)
    days = sorted(r.date for r in run.curve.collect())
    as_ofs = sorted({r.as_of for r in run.holdings.collect()})
    # the 20th date from the start on is 2023-03-01, so the first month's end is that of March
    assert as_ofs == [D("2023-03-31"), D("2023-04-30"), D("2023-05-31"), D("2023-06-15")]
    assert days[0] == D("2023-04-01") and days[-1] == D("2023-06-15") and len(days) == 76
    assert (facts["requested_start"], facts["requested_end"], facts["effective_start"], facts["effective_end"]) == ("2023-02-10", "2023-06-15", "2023-04-01", "2023-06-15")
    assert facts["nav_rows"] == 6 * 200 and facts["holdings_count"] == 8 and facts["trades_count"] == 4
    order = [f"{k:06}" for k in range(6, 0, -1)]
    assert manifest.first().universe_sha256 == hashlib.sha256("\n".join(order).encode()).hexdigest()
    assert spark.read.parquet(f"{tmp_path}/r/curve").count() == 76 and spark.read.parquet(f"{tmp_path}/r/summary").first().executed_count == 3
    # factors look before the start: they are those of a run without one
    whole, _ = research.rolling_job(spark, nav, funds, SETTINGS)
    at = lambda r: sorted(map(str, r.factors.where("as_of = '2023-04-30'").collect()))
    assert at(run) == at(whole)


@pytest.mark.parametrize(("change", "said"), [
    ({"nav": "fund_code = 'x'"}, "no NAV"), ({"nav": "date = '2023-01-05'"}, "no returns"), ({"start": "2023-07-19"}, "fewer than two dates"),
    ({"start": "2023-07-05"}, "no rebalance date"), ({"end": "2023-01-10"}, "no rebalance date"), ({"start": "2023-06-28", "window": 20, "end": "2023-07-19"}, "no day after"),
])
def test_rolling_errors(spark, nav, funds, change, said):
    s = research.Settings(**{**SETTINGS.__dict__, "window": change.get("window", 20)})
    with pytest.raises(ValueError, match=said):
        research.rolling_job(spark, nav.where(change.get("nav", "true")), funds, s, start=change.get("start"), end=change.get("end"))


def test_work_by_fund_reads_buckets_without_a_shuffle(spark, nav):
    """Returns, factors and the rows' numbers of a table in buckets of its funds: no exchange by fund, the same results."""
    held = stored_by_fund(nav, 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rets = returns.to_returns(held)
    assert "Exchange hashpartitioning(fund_code" not in plan(rets) and "Exchange hashpartitioning(fund_code" in plan(returns.to_returns(nav))
    assert sorted(rets.collect()) == sorted(returns.to_returns(nav).collect())
    kept = stored_by_fund(rets, 4)
    bench, dates = returns.equal_weight_benchmark(kept), returns.rebalance_dates(kept, "month", 20)
    found = factors.compute_factors(kept, bench, dates, 20)
    assert "Exchange hashpartitioning(fund_code" not in plan(found) and "Exchange hashpartitioning(fund_code" not in plan(factors.numbered(kept))
    assert sorted(map(str, found.collect())) == sorted(map(str, factors.compute_factors(rets, bench, dates, 20).collect()))


def test_daily_run(spark, nav, funds, tmp_path):
    out = research.daily_run(spark, nav.where("fund_code <> '000003' or date < '2023-05-01'"), funds, SETTINGS, "2023-07-30")
    facts = json.loads(out["manifest"].first().facts)
    assert facts["run_date"] == "2023-07-30" and facts["scores_count"] == 7 and facts["portfolio_count"] == 2 and facts["nav_rows"] == 7 * 200 - 80
    assert json.loads(facts["warnings"]) == {"metadata": 1, "stale_fund": 1, "stale_pool": 1} and out["score_checks"].count() == 0
    stored = spark.createDataFrame([(D("2023-01-01"), "000001", 1.0)], "date date, fund_code string, weight_equal double")
    research.store_daily(out, stored, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d/portfolio_results").count() == 3


def test_grid_rows_are_those_of_single_runs(spark, nav):
    """Each combination of the grid equals a run with these settings alone."""
    rets = backtest.calendar_returns(nav).where("ret is not null").cache()
    grid = {r.experiment: r for r in research.sensitivity_grid(spark, rets, SETTINGS, tops=(2, 4), weightings=("weight_equal", "weight_mixed"), rebalances=("month", "week"), caps=(1.0, 0.5)).collect()}
    best = [r.experiment for r in research.sensitivity_grid(spark, rets, SETTINGS, tops=(2, 4), weightings=("weight_equal", "weight_mixed"), rebalances=("month", "week"), caps=(1.0, 0.5), best=3).collect()]
    assert len(grid) == 16 and best == sorted(grid, key=lambda k: (-grid[k].excess_cagr, -grid[k].net_sharpe, k))[:3]
    for name, top, w, freq, cap in (("top4_mixed_week_cap50", 4, "weight_mixed", "week", 0.5), ("top2_equal_month_uncapped", 2, "weight_equal", "month", 1.0)):
        run = research.rolling_backtest(spark, rets, research.Settings(**{**SETTINGS.__dict__, "top_n": top, "weight_scheme": w, "rebalance": freq, "max_weight": cap}))
        m, s, r = {x.portfolio: x for x in run.metrics.collect()}, run.summary.first(), grid[name]
        assert (r.top_n, r.weight_scheme, r.rebalance, r.max_weight) == (top, w, freq, cap)
        net, bench = m["strategy_net"], m["equal_weight_benchmark"]
        got = (r.net_total_return, r.net_annual_volatility, r.net_max_drawdown, r.benchmark_sharpe, r.excess_cagr, r.annualized_turnover, r.total_transaction_cost)
        assert got == pytest.approx((net.total_return, net.annual_volatility, net.max_drawdown, bench.sharpe, s.excess_cagr, s.annualized_turnover, s.total_transaction_cost), abs=1e-12)


def test_caps_by_column(spark):
    rows = [("a", 0.4, "x", 0.8), ("a", 0.4, "y", 0.1), ("a", 0.4, "z", 0.1), ("b", 1.0, "x", 0.8), ("b", 1.0, "y", 0.2)]
    w = spark.createDataFrame(rows, "as_of string, cap double, fund_code string, weight double")
    got = {(r.as_of, r.fund_code): r.weight for r in portfolio.cap_weights(w, "cap").collect()}
    assert got == {("a", "x"): pytest.approx(0.4), ("a", "y"): pytest.approx(0.3), ("a", "z"): pytest.approx(0.3), ("b", "x"): 0.8, ("b", "y"): 0.2}
    with pytest.raises(Exception, match="cap is too low"):
        portfolio.cap_weights(w.withColumn("cap", F.lit(0.2)), "cap").collect()


def test_capping_is_what_repeated_cutting_gives(spark):
    """The closed form against the loop: cut what is above the cap, share it among the rest in proportion, until nothing is."""
    rnd, cases = random.Random(3), []
    for k in range(60):
        xs = [rnd.random() ** 4 for _ in range(rnd.randrange(3, 12))]
        cases.append((f"{k}", [x / sum(xs) for x in xs], 1 / len(xs) + rnd.random() * 0.4))
    df = spark.createDataFrame([(k, c, f"{i:02}", x) for k, xs, c in cases for i, x in enumerate(xs)], "as_of string, cap double, fund_code string, weight double")
    got = {(r.as_of, r.fund_code): r.weight for r in portfolio.cap_weights(df, "cap").collect()}
    for k, xs, cap in cases:
        w, fixed = list(xs), set()
        while cap < 1 and any(x > cap + 1e-15 for i, x in enumerate(w) if i not in fixed):
            fixed |= {i for i, x in enumerate(w) if x > cap}
            rest = sum(xs[i] for i in range(len(xs)) if i not in fixed)
            w = [cap if i in fixed else xs[i] * (1 - cap * len(fixed)) / rest for i in range(len(xs))]
        assert [got[k, f"{i:02}"] for i in range(len(xs))] == pytest.approx(w, abs=1e-12)


def test_inverse_volatility_lookback(spark):
    """The lookback is the median history of the held, 20 at least; a fund without rows weighs nothing."""
    rnd, rows = random.Random(1), []
    for f, n in (("a", 10), ("b", 40), ("c", 400)):
        rows += [(f, D("2023-01-01") + timedelta(days=400 - n + k), rnd.gauss(0, 0.01)) for k in range(n)]
    rets = spark.createDataFrame(rows, "fund_code string, date date, ret double")
    held = spark.createDataFrame([(D("2024-06-01"), f) for f in "abcd"], "as_of date, fund_code string")
    got = {r.fund_code: r.weight_risk_parity for r in portfolio.inverse_volatility(held, rets, 252).collect()}
    sd = {}
    for f in "abc":
        xs = [x for g, _, x in rows if g == f][-40:]  # the median of 10, 40 and 400
        m = sum(xs) / len(xs)
        sd[f] = 1 / ((sum((x - m) ** 2 for x in xs) / len(xs)) ** 0.5 + 1e-8)
    assert got == {f: pytest.approx(sd.get(f, 0) / sum(sd.values())) for f in "abcd"}
    alone = portfolio.inverse_volatility(held.where("fund_code = 'd'"), rets).first()
    assert alone.weight_risk_parity == 1.0


def test_metadata_coverage(spark):
    rows = [("1", 0.1, None)] * 19 + [("2", None, None)]
    nav = spark.createDataFrame(rows, "fund_code string, daily_return double, acc_nav double")
    assert quality.has_return_metadata(nav).first()[0] is True
    assert quality.has_return_metadata(nav, nav.where("fund_code = '2'")).first()[0] is False and quality.has_return_metadata(nav.limit(0)).first()[0] is False


def test_return_snapshot(spark):
    rows = [("a", D("2024-01-01"), 1.0), ("a", D("2024-01-02"), 1.1), ("a", D("2024-01-04"), 0.99), ("b", D("2024-01-01"), 5.0)]
    got = backtest.return_snapshot(spark.createDataFrame(rows, "fund_code string, date date, nav double")).collect()
    assert len(got) == 1 and got[0].fund_code == "a" and got[0].total_return == pytest.approx(-0.01) and got[0].max_drawdown == pytest.approx(-0.1) and got[0].observations == 2
