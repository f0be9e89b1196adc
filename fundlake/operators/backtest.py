"""Backtests: turnover, costs, daily curves, metrics. Everything is keyed by ``experiment`` and runs in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.operators.portfolio import WEIGHTS, normalised
from fundlake.operators.returns import calendar_returns, date_index, equal_weight_benchmark
from fundlake.sources.tables import broadcast_if_small, materialised

CURVES = {"strategy_gross": "gross_return", "strategy_net": "net_return", "equal_weight_benchmark": "benchmark_return"}


def turnover(weights: DataFrame, cost_bps: float = 10.0, charge_initial: bool = False) -> DataFrame:
    """(experiment, as_of, turnover, traded_notional, cost, fund_count) between neighbouring target rows of ``weights``
    (experiment, as_of, fund_code, weight). Each weight counts once for its date and once, negative, for the next, so no grid
    of funds and dates is made. The first row is 0 unless ``charge_initial``."""
    if cost_bps < 0:
        raise ValueError("cost_bps is negative")
    w = weights.select("experiment", "as_of", "fund_code", normalised(F.col("weight"), Window.partitionBy("experiment", "as_of")).alias("weight"))
    by = Window.partitionBy("experiment").orderBy("as_of")
    dates = w.select("experiment", "as_of").distinct().withColumn("following", F.lead("as_of").over(by)).withColumn("k", F.row_number().over(by))
    held = w.join(dates, ["experiment", "as_of"])
    moved = held.select("experiment", "as_of", "fund_code", "weight").unionByName(held.where("following is not null").select("experiment", F.col("following").alias("as_of"), "fund_code", (-F.col("weight")).alias("weight")))
    traded = moved.groupBy("experiment", "as_of", "fund_code").agg(F.sum("weight").alias("d")).groupBy("experiment", "as_of").agg(F.sum(F.abs("d")).alias("traded"))
    count = w.groupBy("experiment", "as_of").agg(F.count_if(F.col("weight") != 0).alias("fund_count"))
    out = traded.join(dates, ["experiment", "as_of"]).join(count, ["experiment", "as_of"])
    notional = F.when((F.col("k") > 1) | F.lit(charge_initial), F.col("traded")).otherwise(0.0)
    return out.select("experiment", "as_of", (notional / 2).alias("turnover"), notional.alias("traded_notional"), (notional * cost_bps / 10000).alias("cost"), "fund_count")


def effective_dates(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """``trades`` with effective_date, the first calendar date after as_of (null if none), and applied_cost (then 0)."""
    marks = trades.select(F.col("as_of").alias("date"), F.lit(True).alias("mark")).distinct().unionByName(calendar.select("date", F.lit(False).alias("mark")).distinct())
    after = F.min(F.when(~F.col("mark"), F.col("date"))).over(Window.orderBy("date", F.col("mark")).rowsBetween(1, Window.unboundedFollowing))
    nxt = marks.withColumn("effective_date", after).where("mark").select(F.col("date").alias("as_of"), "effective_date")
    return trades.join(F.broadcast(nxt), "as_of", "left").withColumn("applied_cost", F.when(F.col("effective_date").isNotNull(), F.col("cost")).otherwise(0.0))


def simulate(returns: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None, cost_bps: float = 10.0, charge_initial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(curve, trades) of ``weights`` (experiment, as_of, fund_code, weight) over ``returns`` (fund_code, date, ret).

    Weights act from the next trading date to the next rebalance, that included, undrifted; a held fund without a return counts
    0. A target date that is no trading date is never held, but its cost falls on the next trading date. Only dates with weights
    stay. Without ``benchmark`` it is the mean of all funds that day; a missing benchmark counts 0.
    """
    w = weights.select("experiment", "as_of", "fund_code", normalised(F.col("weight"), Window.partitionBy("experiment", "as_of")).alias("w"))
    w, calendar = materialised(w), materialised(date_index(returns))  # targets and dates are small and used again and again
    trades = materialised(effective_dates(turnover(w.withColumnRenamed("w", "weight"), cost_bps, charge_initial), calendar))
    targets = w.select("experiment", "as_of").distinct().join(F.broadcast(calendar.withColumnRenamed("date", "as_of")), "as_of")
    until = F.coalesce(F.lead("idx").over(Window.partitionBy("experiment").orderBy("idx")), calendar.agg(F.max("idx")).scalar())
    days = targets.withColumn("until", until).where("until > idx").select("experiment", "as_of", F.explode(F.sequence(F.col("idx") + 1, F.col("until"))).alias("idx")).join(F.broadcast(calendar), "idx")
    acting = w.where("w <> 0")
    # only held funds' returns are dealt: a few, unless portfolios hold the whole universe
    funds = broadcast_if_small(materialised(acting.select("fund_code").distinct()))
    known = returns.select("fund_code", "date", "ret").join(funds, "fund_code", "left_semi")
    held = days.join(acting, ["experiment", "as_of"]).join(known, ["fund_code", "date"], "left")
    daily = held.groupBy("experiment", "date").agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross_return"),
        F.try_divide(F.sum(F.when(F.col("ret").isNotNull(), F.abs("w")).otherwise(0.0)), F.sum(F.abs("w"))).alias("return_coverage"),
    )
    costs = trades.where("effective_date is not null").groupBy("experiment", F.col("effective_date").alias("date")).agg(F.sum("applied_cost").alias("c"))
    bench = equal_weight_benchmark(returns) if benchmark is None else benchmark
    curve = daily.join(costs, ["experiment", "date"], "left").join(F.broadcast(bench), "date", "left")
    curve = curve.select("experiment", "date", "gross_return", F.coalesce("c", F.lit(0.0)).alias("transaction_cost"), (F.col("gross_return") - F.coalesce("c", F.lit(0.0))).alias("net_return"), F.coalesce("bench_ret", F.lit(0.0)).alias("benchmark_return"), "return_coverage")
    for name in ("gross", "net", "benchmark"):
        curve = curve.withColumn(f"{name}_equity", wealth(F.col(f"{name}_return"), "experiment"))
    curve = curve.withColumn("relative_equity", F.try_divide("net_equity", "benchmark_equity")).withColumn("daily_excess_return", F.col("net_return") - F.col("benchmark_return"))
    return curve, trades


def wealth(ret: Column, *keys: str, initial: float = 1.0) -> Column:
    """The compounded value of ``ret`` by date for each key; null counts 0."""
    return initial * F.product(1 + F.coalesce(ret, F.lit(0.0))).over(Window.partitionBy(*keys).orderBy("date"))


def performance(rows: DataFrame, keys: list[str], periods: int = 252) -> DataFrame:
    """Metrics of ``rows`` (keys, date, ret) for each key: start, end, observations, final_equity, total_return, cagr,
    annual_volatility, sharpe, max_drawdown. Null returns are dropped; one of -1 or less is an error. ``date`` may be null
    throughout: years then come from the number of rows, and the order from ``pos``, which must be there."""
    order = F.struct("date", *(["pos"] if "pos" in rows.columns else []))
    rows = rows.where("ret is not null").withColumn("ret", F.when(F.col("ret") <= -1, F.raise_error(F.lit("a return of -100 % or less"))).otherwise(F.col("ret"))).withColumn("at", order)
    by = Window.partitionBy(*keys).orderBy("at")
    rows = rows.withColumn("wealth", F.product(1 + F.col("ret")).over(by)).withColumn("drawdown", F.try_divide(F.col("wealth"), F.max("wealth").over(by)) - 1)
    agg = rows.groupBy(*keys).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("observations"), F.count("date").alias("dated"),
        F.max_by("wealth", "at").alias("final_equity"), F.avg("ret").alias("mean"), (F.stddev_pop("ret") * math.sqrt(periods)).alias("annual_volatility"), F.min("drawdown").alias("max_drawdown"),
    )
    years = F.greatest(F.lit(1 / 252), F.when(F.col("dated") > 1, F.date_diff("end", "start") / 365.25).otherwise(F.col("observations") / periods))
    return agg.select(*keys, "start", "end", "observations", "final_equity", (F.col("final_equity") - 1).alias("total_return"), (F.pow("final_equity", 1 / years) - 1).alias("cagr"), "annual_volatility", F.try_divide(F.col("mean") * periods, F.nullif(F.col("annual_volatility"), F.lit(0.0))).alias("sharpe"), "max_drawdown")


def performance_table(curve: DataFrame) -> DataFrame:
    """performance() of the gross, net and benchmark returns of each experiment, as ``portfolio``."""
    long = curve.select("experiment", "date", *(F.col(c).alias(n) for n, c in CURVES.items())).unpivot(["experiment", "date"], list(CURVES), "portfolio", "ret")
    return performance(long, ["experiment", "portfolio"])


def rolling_summary(curve: DataFrame, trades: DataFrame, periods: int = 252) -> DataFrame:
    """One row for each experiment: counts, turnover and costs of executed trades, excess over the benchmark, coverage."""
    t = trades.groupBy("experiment").agg(
        F.count("*").alias("rebalance_count"), F.count("effective_date").alias("executed_count"),
        *(F.avg(F.when(F.col("effective_date").isNotNull(), F.col("turnover"))).alias("average_turnover"), F.coalesce(F.sum(F.when(F.col("effective_date").isNotNull(), F.col("turnover"))), F.lit(0.0)).alias("turnover_sum")),
        F.coalesce(F.sum(F.when(F.col("effective_date").isNotNull(), F.col("traded_notional"))), F.lit(0.0)).alias("total_traded_notional"), F.sum("applied_cost").alias("total_transaction_cost"),
    )
    m = performance_table(curve)
    net = m.where("portfolio = 'strategy_net'").select("experiment", F.col("start"), F.col("end"), F.col("total_return").alias("n"), F.col("cagr").alias("nc"))
    bench = m.where("portfolio = 'equal_weight_benchmark'").select("experiment", F.col("total_return").alias("b"), F.col("cagr").alias("bc"))
    c = curve.groupBy("experiment").agg((F.max_by("gross_equity", "date") - F.max_by("net_equity", "date")).alias("cost_drag"), F.avg("return_coverage").alias("average_coverage"))
    years = F.greatest(F.date_diff("end", "start") / 365.25, F.lit(1 / periods))
    return t.join(net, "experiment").join(bench, "experiment").join(c, "experiment").select(
        "experiment", "start", "end", "rebalance_count", "executed_count", "average_turnover", (F.col("turnover_sum") / years).alias("annualized_turnover"), "total_traded_notional", "total_transaction_cost",
        "cost_drag", (F.col("n") - F.col("b")).alias("excess_total_return"), (F.col("nc") - F.col("bc")).alias("excess_cagr"), (F.col("n") > F.col("b")).alias("beat_benchmark"), "average_coverage",
    )


def replay_backtest(portfolio: DataFrame, nav: DataFrame, weight_col: str = "weight_equal", since: str | None = None, cost_bps: float = 10.0, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """simulate() of stored weights from ``since`` on, over calendar returns of all funds; the curve also has ``equity``."""
    if weight_col not in WEIGHTS:
        raise ValueError(f"no such weights: {weight_col}")
    rows = portfolio.where(F.col("date") >= F.lit(since).cast("date")) if since else portfolio
    last = F.row_number().over(Window.partitionBy("date", "fund_code").orderBy(F.col(order or weight_col).desc_nulls_last()))
    rows = rows.withColumn("_rn", last).where("_rn = 1")
    w = rows.select(F.lit("replay").alias("experiment"), F.col("date").alias("as_of"), "fund_code", F.coalesce(F.col(weight_col), F.lit(0.0)).alias("weight"))
    curve, trades = simulate(calendar_returns(nav).where("ret is not null"), w, cost_bps=cost_bps)
    return curve.withColumn("equity", F.col("net_equity")), trades


def backfill_equity(nav: DataFrame, portfolio: DataFrame, days: int = 365, weight_col: str = "weight_equal") -> DataFrame:
    """(date, ret, equity) of the latest stored weights over the last ``days`` calendar days, in sample by design. Weights are
    those of funds with NAV there; without any all funds weigh the same."""
    recent = nav.where(F.col("date") >= F.date_sub(nav.agg(F.max("date")).scalar(), days)).where("nav is not null")
    funds = recent.select("fund_code").distinct()
    last = portfolio.where(F.col("date") == portfolio.agg(F.max("date")).scalar()).groupBy("fund_code").agg(F.max(weight_col).alias("weight"))
    w = funds.join(last, "fund_code", "left")
    total = w.agg(F.count("weight").alias("stored"), F.count("*").alias("funds"), F.sum(F.abs("weight")).alias("gross"))  # one row
    share = F.when(F.col("stored") > 0, F.coalesce(F.try_divide("weight", "gross"), F.lit(0.0))).otherwise(1 / F.col("funds"))
    w = w.join(F.broadcast(total)).select("fund_code", share.alias("w"))
    daily = calendar_returns(recent).join(w, "fund_code").groupBy("date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    return daily.select("date", "ret", F.product(1 + F.col("ret")).over(Window.orderBy("date")).alias("equity"))  # one row for each trading date


def period_metrics(curve: DataFrame, trades: DataFrame, periods: DataFrame) -> DataFrame:
    """Metrics of each experiment restarted in each of ``periods`` (period, first, last), which include both ends."""
    inside = curve.join(F.broadcast(periods), F.col("date").between(F.col("first"), F.col("last")))
    m = lambda c: performance(inside.select("experiment", "period", "date", F.col(c).alias("ret")), ["experiment", "period"])
    net, bench = m("net_return"), m("benchmark_return").select("experiment", "period", *(F.col(c).alias(f"b_{c}") for c in ("total_return", "cagr", "sharpe")))
    t = trades.join(F.broadcast(periods), F.col("effective_date").between(F.col("first"), F.col("last"))).groupBy("experiment", "period").agg(F.sum("turnover").alias("t"), F.sum("applied_cost").alias("c"))
    years = F.greatest(F.date_diff("end", "start") / 365.25, F.lit(1 / 252))
    return net.join(bench, ["experiment", "period"]).join(t, ["experiment", "period"], "left").select(
        "experiment", "period", F.col("total_return").alias("net_total_return"), F.col("cagr").alias("net_cagr"), F.col("sharpe").alias("net_sharpe"), F.col("max_drawdown").alias("net_max_drawdown"),
        F.col("b_total_return").alias("benchmark_total_return"), F.col("b_cagr").alias("benchmark_cagr"), F.col("b_sharpe").alias("benchmark_sharpe"),
        (F.col("total_return") - F.col("b_total_return")).alias("excess_total_return"), (F.col("cagr") - F.col("b_cagr")).alias("excess_cagr"), (F.col("total_return") > F.col("b_total_return")).alias("beat_benchmark"),
        (F.coalesce("t", F.lit(0.0)) / years).alias("annualized_turnover"), F.coalesce("c", F.lit(0.0)).alias("total_transaction_cost"),
    )


def return_snapshot(nav_series: DataFrame, key: str = "fund_code") -> DataFrame:
    """performance() of the changes of a curve (key, date, nav)."""
    by = Window.partitionBy(key).orderBy("date")
    return performance(nav_series.select(key, "date", (F.try_divide(F.col("nav"), F.lag("nav").over(by)) - 1).alias("ret")), [key])
