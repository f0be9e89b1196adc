"""Rebalance dates at the borders of periods, targets off the calendar, gaps in calendar returns, costs outside the curve."""

from datetime import date

import pytest

from fundlake.operators import backtest, returns

D = date.fromisoformat


def _dates(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "date date")


def _got(df):
    return sorted(str(r.as_of) for r in df.collect())


def test_period_borders(spark):
    """A Sunday ends its week, a Monday begins one, a year's end those of its month and quarter; the last part of a period counts."""
    days = _dates(spark, "2023-12-29", "2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01", "2024-03-15")
    assert _got(returns.rebalance_dates(days, "month")) == ["2023-12-31", "2024-01-31", "2024-02-01", "2024-03-15"]
    assert _got(returns.rebalance_dates(days, "quarter")) == ["2023-12-31", "2024-03-15"]
    assert _got(returns.rebalance_dates(days, "week")) == ["2023-12-31", "2024-01-01", "2024-02-01", "2024-03-15"]
    assert _got(returns.rebalance_dates(days, "month", 4)) == ["2024-01-31", "2024-02-01", "2024-03-15"]  # from the fourth date on
    assert _got(returns.rebalance_dates(days, "month", 2, "2024-01-01", "2024-02-01")) == ["2024-01-31", "2024-02-01"]
    with pytest.raises(ValueError, match="no such frequency"):
        returns.rebalance_dates(days, "day")


def test_target_off_the_calendar_is_charged_and_not_held(spark):
    rets = spark.createDataFrame([(f, D(d), x) for f, d, x in (("A", "2024-01-02", 0.0), ("B", "2024-01-02", 0.0), ("A", "2024-01-04", 0.1), ("B", "2024-01-04", 0.5), ("A", "2024-01-05", 0.2))], "fund_code string, date date, ret double")
    w = spark.createDataFrame([("e", D("2024-01-02"), "A", 1.0), ("e", D("2024-01-03"), "B", 1.0), ("e", D("2024-01-05"), "A", 1.0)], "experiment string, as_of date, fund_code string, weight double")
    curve, trades = backtest.simulate(rets, w)
    rows = sorted(curve.collect(), key=lambda r: r.date)
    assert [(str(r.date), r.gross_return, r.transaction_cost) for r in rows] == [("2024-01-04", 0.1, pytest.approx(0.002)), ("2024-01-05", 0.2, 0.0)]
    at = {str(t.as_of): (str(t.effective_date), t.cost, t.applied_cost) for t in trades.collect()}
    assert at["2024-01-03"] == ("2024-01-04", pytest.approx(0.002), pytest.approx(0.002))
    assert at["2024-01-05"] == ("None", pytest.approx(0.002), 0.0)  # no date is left: never charged


def test_gaps_in_calendar_returns(spark):
    """A return needs the NAV of the calendar date before; returns of a fund's own rows don't."""
    nav = spark.createDataFrame([(f, D(d), x, None, None) for f, d, x in (("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("A", "2024-01-03", 3.0), ("B", "2024-01-01", 1.0), ("B", "2024-01-03", 4.0))], "fund_code string, date date, nav double, acc_nav double, daily_return double")
    calendar = {(r.fund_code, str(r.date)[-2:]): r.ret for r in returns.calendar_returns(nav).collect()}
    assert calendar == {("A", "01"): None, ("A", "02"): 1.0, ("A", "03"): 0.5, ("B", "01"): None, ("B", "03"): None}
    assert {(r.fund_code, str(r.date)[-2:]): r.ret for r in returns.to_returns(nav).collect()} == {("A", "02"): 1.0, ("A", "03"): 0.5, ("B", "03"): 3.0}


def test_metrics_of_short_and_flat_curves(spark):
    """One day counts as a year's 252nd part at least; a flat curve has no ratio; a total loss is an error."""
    rows = [("one", D("2024-01-01"), 0.1), ("flat", D("2024-01-01"), 0.0), ("flat", D("2024-01-02"), 0.0), ("fall", D("2024-01-01"), -0.5), ("fall", D("2024-01-02"), 0.5)]
    m = {r.k: r for r in backtest.performance(spark.createDataFrame(rows, "k string, date date, ret double"), ["k"]).collect()}
    assert m["one"].cagr == pytest.approx(1.1**252 - 1) and m["flat"].sharpe is None and m["fall"].max_drawdown == 0.0 and m["fall"].total_return == -0.25
    with pytest.raises(Exception, match="-100 %"):
        backtest.performance(spark.createDataFrame([("k", D("2024-01-01"), -1.0)], "k string, date date, ret double"), ["k"]).collect()
