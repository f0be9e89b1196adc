"""The workflows end to end: rolling backtest, scheme comparison, sensitivity grid, universe and daily run."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.operators import backtest, diagnostics, factors, portfolio, quality, returns, scoring
from fundlake.sources import nav as sources
from fundlake.sources.tables import materialised, stored_by_fund


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; bad ones are errors."""

    universe_limit: int = 50
    top_n: int = 10
    window: int = 252
    since: str = "2022-01-01"
    min_history: int = 60
    weight_scheme: str = "weight_equal"
    max_weight: float = 1.0
    cost_bps: float = 10.0
    rebalance: str = "month"

    def __post_init__(self) -> None:
        if not (1 <= self.top_n <= self.universe_limit and self.window >= 2 and self.min_history >= 1 and 0 < self.max_weight <= 1):
            raise ValueError(f"bad settings: {self}")


@dataclass
class Run:
    """The parts of a rolling backtest, each made when it is first asked for and then kept. Rebalances and the curve lie between
    ``start`` and ``end``; factors and volatilities also look at the returns before."""

    returns: DataFrame
    settings: Settings
    schemes: DataFrame
    start: str | None = None
    end: str | None = None

    @cached_property
    def factors(self) -> DataFrame:
        return factor_table(self.returns, self.settings, start=self.start, end=self.end)

    @cached_property
    def scores(self) -> DataFrame:
        return materialised(scoring.score_funds(self.factors, self.schemes))

    @cached_property
    def holdings(self) -> DataFrame:
        s = self.settings
        return materialised(portfolio.build_portfolio(self.scores, self.returns, s.top_n, s.window))  # dates times top_n rows

    @cached_property
    def _simulated(self) -> tuple[DataFrame, DataFrame]:
        s = self.settings
        target = portfolio.target_weights(self.holdings, s.weight_scheme, s.max_weight, ("scheme", "as_of")).withColumnRenamed("scheme", "experiment")
        curve, trades = backtest.simulate(within(self.returns, self.start, self.end), target, cost_bps=s.cost_bps)
        return materialised(curve), trades

    @property
    def curve(self) -> DataFrame:
        return self._simulated[0]

    @property
    def trades(self) -> DataFrame:
        return self._simulated[1]

    @property
    def metrics(self) -> DataFrame:
        return backtest.performance_table(self.curve)

    @property
    def summary(self) -> DataFrame:
        return backtest.rolling_summary(self.curve, self.trades)


def within(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """``rows`` dated from ``start`` to ``end``, both included; None is open."""
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.where(F.col("date") <= F.lit(end).cast("date"))


def factor_table(rets: DataFrame, s: Settings, in_order: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """Factors at every rebalance date from the window-th date on; kept, since scores, groups and correlations share them."""
    dates = returns.rebalance_dates(rets, s.rebalance, s.window, start, end)
    return materialised(factors.compute_factors(rets, returns.equal_weight_benchmark(rets), dates, s.window, in_order=in_order))


def rolling_backtest(spark: SparkSession, rets: DataFrame, s: Settings, schemes: dict[str, dict[str, float]] | None = None, start: str | None = None, end: str | None = None) -> Run:
    """All rebalance dates and schemes in one job; the experiment is the scheme."""
    table = scoring.scheme_table(spark, schemes or {scoring.DEFAULT: scoring.SCHEMES[scoring.DEFAULT]})
    return Run(rets, s, table, start, end)


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"the backtest has {what}")
    return df


def rolling_job(spark: SparkSession, nav: DataFrame, universe: DataFrame, s: Settings, folder: str | None = None, start: str | None = None, end: str | None = None) -> tuple[Run, DataFrame]:
    """From NAV to the report: (run, manifest). ``universe``: (fund_code, pos).

    Rebalances lie from ``start`` (``since`` by default) to ``end`` (the last date). No NAV, no returns, fewer than two dates, no
    rebalance date with enough history and no fund to hold are errors. With ``folder`` curve, holdings, trades, metrics, summary
    and manifest are written there.
    """
    start = start or s.since
    funds = universe.orderBy("pos").limit(s.universe_limit)
    rows = _some(stored_by_fund(sources.drop_null_nav(sources.load_nav(nav, funds, s.since, s.min_history))), "no NAV of its funds")
    rets = _some(stored_by_fund(returns.to_returns(rows)), "no returns")
    dates = materialised(within(rets.select("date").distinct(), start, end))
    if dates.limit(2).count() < 2:
        raise ValueError("the backtest has fewer than two dates")
    first = returns.date_index(dates).where(F.col("idx") == s.window)
    if first.isEmpty() or returns.rebalance_dates(dates, s.rebalance, s.window).isEmpty():
        raise ValueError("the backtest has no rebalance date with enough history")
    run = rolling_backtest(spark, rets, s, start=start, end=end)
    _some(run.holdings, "no fund to hold")
    _some(run.curve, "no day after a rebalance")
    days = run.curve.agg(F.min("date"), F.max("date")).first()
    asked = {"requested_start": start, "requested_end": end or str(rets.agg(F.max("date")).first()[0]), "effective_start": str(days[0]), "effective_end": str(days[1])}
    manifest = sources.run_manifest(funds, **asked, **s.__dict__, nav_rows=rows.count(), holdings_count=run.holdings.count(), trades_count=run.trades.count())
    if folder is not None:
        tables = {"curve": run.curve, "holdings": run.holdings, "trades": run.trades, "metrics": run.metrics, "summary": run.summary, "manifest": manifest}
        for name, table in tables.items():
            sources.write_result(table, f"{folder}/{name}")
    return run, manifest


def grid_table(spark: SparkSession, tops: tuple[int, ...], weightings: tuple[str, ...], rebalances: tuple[str, ...], caps: tuple[float, ...]) -> DataFrame:
    """(experiment, top_n, weight_scheme, rebalance, max_weight): a row for each combination."""
    label = lambda cap: "uncapped" if cap == 1 else f"cap{cap * 100:.0f}"
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in {"experiment": f"top{n}_{w.removeprefix('weight_')}_{freq}_{label(cap)}", "top_n": n, "weight_scheme": w, "rebalance": freq, "max_weight": float(cap)}.items())) for n, w, freq, cap in product(tops, weightings, rebalances, caps)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def grid_targets(spark: SparkSession, rets: DataFrame, s: Settings, grid: DataFrame, tops: tuple[int, ...], rebalances: tuple[str, ...]) -> DataFrame:
    """(experiment, as_of, fund_code, weight) of all rows of ``grid``: parameters are columns that rows are joined with, so the plan
    is the same for any number of combinations. Factors and scores are made once for each date, whatever asks for it, portfolios
    once for each date and size."""
    table = scoring.scheme_table(spark, {scoring.DEFAULT: scoring.SCHEMES[scoring.DEFAULT]})
    dates = materialised(reduce(DataFrame.unionByName, [returns.rebalance_dates(rets, f, s.window).withColumn("rebalance", F.lit(f)) for f in rebalances]))
    found = materialised(factors.compute_factors(rets, returns.equal_weight_benchmark(rets), dates, s.window))
    ranked = scoring.score_funds(found, table).where(F.col("rank") <= max(tops))
    sizes = F.filter(F.array(*map(F.lit, sorted(set(tops)))), lambda n: n >= F.col("rank"))
    held = materialised(ranked.select("as_of", "fund_code", F.explode(sizes).alias("top_n")))  # dates times sizes rows
    keys = ("top_n", "as_of")
    equal = held.withColumn("weight_equal", 1 / F.count("*").over(Window.partitionBy(*keys)))
    both = equal.join(portfolio.inverse_volatility(held, rets, s.window, keys), [*keys, "fund_code"])
    both = both.withColumn("weight_mixed", (F.col("weight_equal") + F.col("weight_risk_parity")) / 2)
    weights = both.unpivot([*keys, "fund_code"], list(portfolio.WEIGHTS), "weight_scheme", "weight")
    asked = F.broadcast(grid.join(dates, "rebalance"))  # a row for each combination and date
    rows = weights.join(asked, [*keys, "weight_scheme"])
    rows = rows.withColumn("weight", portfolio.normalised(F.col("weight"), Window.partitionBy("experiment", "as_of")))
    return portfolio.cap_weights(rows, "max_weight", ("experiment", "as_of"))


def sensitivity_grid(
    spark: SparkSession, rets: DataFrame, s: Settings, tops: tuple[int, ...] = (5, 10), weightings: tuple[str, ...] = portfolio.WEIGHTS,
    rebalances: tuple[str, ...] = ("month", "quarter"), caps: tuple[float, ...] = (1.0, 0.4), best: int | None = None,
) -> DataFrame:
    """One row for each combination with its parameters, metrics of it and of the benchmark, excess, turnover and costs, the best
    excess CAGR first; with ``best`` only so many rows. All combinations are one parameter table, simulated together."""
    grid = grid_table(spark, tops, weightings, rebalances, caps)
    curve, trades = backtest.simulate(rets, grid_targets(spark, rets, s, grid, tops, rebalances), cost_bps=s.cost_bps)
    curve = materialised(curve)
    m, t = materialised(backtest.performance_table(curve)), backtest.rolling_summary(curve, trades)
    part = lambda name, to, *cols: m.where(F.col("portfolio") == name).select("experiment", *(F.col(c).alias(f"{to}_{c}") for c in cols))
    out = grid.join(part("strategy_net", "net", "total_return", "cagr", "annual_volatility", "sharpe", "max_drawdown"), "experiment")
    out = out.join(part("equal_weight_benchmark", "benchmark", "total_return", "cagr", "sharpe"), "experiment")
    out = out.join(t.select("experiment", "excess_total_return", "excess_cagr", "annualized_turnover", "total_transaction_cost", "beat_benchmark"), "experiment")
    out = out.orderBy(F.desc("excess_cagr"), F.desc("net_sharpe"), "experiment")
    return out if best is None else out.limit(best)


def factor_diagnostics(run: Run, rets: DataFrame, weights: dict[str, float], groups: int = 5) -> dict[str, DataFrame]:
    """Correlations and their summary, groups and their summary, spreads."""
    forward = returns.forward_returns(rets, run.factors.select("as_of"))
    corr = diagnostics.factor_correlation(run.factors)
    grouped = diagnostics.factor_groups(diagnostics.signals(run.factors, run.scores, weights), forward, groups)
    return {"correlation": corr, "correlation_summary": diagnostics.correlation_summary(corr), "groups": grouped, "group_summary": diagnostics.group_summary(grouped), "spread": diagnostics.factor_spread(grouped, groups)}


def daily_run(spark: SparkSession, nav: DataFrame, universe: DataFrame, s: Settings, as_of: str) -> dict[str, DataFrame]:
    """Loads NAV, scores the latest date, checks data and scores, builds the portfolio to store, and says so in a manifest.
    ``universe``: (fund_code, pos)."""
    funds = materialised(universe)
    rows = materialised(sources.load_nav(nav, funds, s.since, s.min_history))
    rets = materialised(returns.to_returns(rows))
    f = materialised(factors.compute_factors(rets, returns.equal_weight_benchmark(rets), factors.latest(rets), s.window))
    scores = materialised(scoring.score_funds(f, scoring.scheme_table(spark, {scoring.DEFAULT: scoring.SCHEMES[scoring.DEFAULT]})))
    held = materialised(portfolio.build_portfolio(scores, rets, s.top_n, s.window))
    checks = materialised(quality.check_nav(rows, funds, as_of, rets))
    risks = materialised(quality.check_scores(scores, funds.count(), s.top_n, factors=True))
    warnings = checks.groupBy("check").count().unionByName(risks.groupBy("check").count())
    found = {r["check"]: r["count"] for r in warnings.collect()}  # one for each kind of check
    manifest = sources.run_manifest(funds, run_date=as_of, **s.__dict__, nav_rows=rows.count(), scores_count=scores.count(), portfolio_count=held.count(), warnings=json.dumps(found, sort_keys=True))
    return {"scores": scores, "portfolio": held.select(F.col("as_of").alias("date"), "fund_code", *portfolio.WEIGHTS, "score", "rank"), "data_checks": checks, "score_checks": risks, "manifest": manifest}


def store_daily(result: dict[str, DataFrame], stored: DataFrame, folder: str) -> None:
    """Writes what daily_run() gives, and the portfolio upserted into ``stored``, as tables under ``folder``, which isn't where
    ``stored`` is read from."""
    for name, table in (result | {"portfolio_results": sources.upsert_portfolio(stored, result["portfolio"])}).items():
        sources.write_result(table, f"{folder}/{name}")
