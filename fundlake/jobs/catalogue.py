"""All queries over the test tables by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions.codes import type_reason
from fundlake.jobs import adapters, research
from fundlake.operators import backtest, diagnostics, factors, portfolio, quality, returns, scoring
from fundlake.operators import universe as universes
from fundlake.sources import nav as sources
from fundlake.sources.store import MonthlyStore
from fundlake.sources.tables import materialised, shared_folder
from fundlake.streaming.nav import current, run_to_table, stream_benchmark, stream_upsert_nav

WINDOW, TOP, GROUPS = 60, 5, 5
SETTINGS = research.Settings(top_n=TOP, window=WINDOW)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts of the SQL, each a common table expression that builds on the ones before.
_RAW = """raw AS (
  SELECT l_suppkey AS k, lpad(l_suppkey::VARCHAR, 6, '0') AS fund_code, l_shipdate::DATE AS date, avg(l_extendedprice / l_quantity) / 1000 AS nav,
    0.25 * sum(l_extendedprice * (l_discount - l_tax)) / sum(l_extendedprice) - 0.0025 AS r FROM lineitem GROUP BY ALL
), nav AS (
  SELECT fund_code, date, nav, CASE WHEN k % 3 = 1 THEN nav END AS acc_nav, CASE WHEN k % 3 = 0 THEN r END AS daily_return FROM raw
)"""
_OWN_RETURNS = "rets AS (SELECT fund_code, date, r AS ret FROM raw)"
_CALENDAR_RETURNS = """cal0 AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM raw)),
rets AS (SELECT a.fund_code, a.date, a.nav / b.nav - 1 AS ret FROM (SELECT * FROM nav JOIN cal0 USING (date)) a JOIN (SELECT fund_code, nav, idx FROM nav JOIN cal0 USING (date)) b ON a.fund_code = b.fund_code AND b.idx = a.idx - 1)"""


def _dated(where: str = "true") -> str:
    """Dates of returns, those with ``where`` alone, the benchmark of all dates, the calendar."""
    return f"""dates AS (SELECT DISTINCT date FROM rets WHERE {where}), bench AS (SELECT date, avg(ret) AS bench_ret FROM rets GROUP BY date),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM dates)"""


_NAV = ",\n".join((_RAW, _OWN_RETURNS, _dated()))


def _reb(freq: str = "month") -> str:
    return f"""reb AS (
  SELECT as_of FROM (SELECT max(date) AS as_of FROM dates GROUP BY date_trunc('{freq}', date)) WHERE as_of >= (SELECT date FROM cal WHERE idx = {WINDOW}))"""


_FACTORS = f"""rn AS (SELECT r.*, bench_ret, row_number() OVER (PARTITION BY fund_code ORDER BY date) AS rn FROM rets r LEFT JOIN bench USING (date)),
ends AS (SELECT as_of, fund_code, max(rn) AS e FROM reb JOIN rn ON date <= as_of GROUP BY ALL),
held AS (SELECT e.as_of, rn.*, product(1 + ret) OVER (PARTITION BY as_of, rn.fund_code ORDER BY rn) AS w FROM ends e JOIN rn USING (fund_code) WHERE e >= {WINDOW} AND rn > e - {WINDOW} AND rn <= e),
dd AS (SELECT *, w / max(w) OVER (PARTITION BY as_of, fund_code ORDER BY rn) - 1 AS d FROM held),
fac AS (
  SELECT as_of, fund_code, avg(ret) * 252 AS ann_return, stddev_pop(ret) * sqrt(252) AS ann_vol, (stddev_pop(ret) FILTER (ret < 0)) * sqrt(252) AS down_vol, min(d) AS mdd,
    avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252) AS sharpe, avg(ret - bench_ret) / nullif(stddev_pop(ret - bench_ret), 0) * sqrt(252) AS ir FROM dd GROUP BY ALL)"""
_LONG = "lf AS (" + " UNION ALL ".join(f"SELECT as_of, fund_code, '{f}' AS factor, {f} AS x FROM fac" for f in factors.FACTORS) + ")"
_WEIGHTS = "wt(scheme, factor, weight) AS (VALUES " + ", ".join(f"('{s}', '{f}', {w}::DOUBLE)" for s, ws in scoring.SCHEMES.items() for f, w in ws.items()) + ")"
_SCORES = f"""{_LONG},
st AS (SELECT as_of, factor, count(x) AS n, count(DISTINCT x) AS kinds, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM lf GROUP BY ALL),
wz AS (SELECT lf.*, n, kinds, CASE WHEN x IS NULL THEN NULL WHEN n >= 5 THEN least(greatest(x, lo), hi) ELSE x END AS w FROM lf JOIN st USING (as_of, factor)),
c1 AS (SELECT as_of, factor, median(w) AS med, avg(w) AS mean, stddev_pop(w) AS sd FROM wz GROUP BY ALL),
c2 AS (SELECT as_of, factor, median(abs(w - med)) AS mad FROM wz JOIN c1 USING (as_of, factor) GROUP BY ALL),
z AS (SELECT as_of, fund_code, factor, CASE WHEN mad > 0 THEN (w - med) / (1.4826 * mad) WHEN sd > 0 THEN (w - mean) / sd ELSE w - mean END AS z
  FROM wz JOIN c1 USING (as_of, factor) JOIN c2 USING (as_of, factor) WHERE n > 1 AND kinds > 1),
{_WEIGHTS},
sc AS (SELECT scheme, as_of, fund_code, CASE WHEN bool_or(z IS NULL) THEN NULL ELSE round(sum(weight * z) / sum(abs(weight)), 10) END AS score FROM z JOIN wt USING (factor) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY scheme, as_of ORDER BY score DESC NULLS LAST, fund_code) AS rank FROM sc)"""
_TOP = f"""tp AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY scheme, as_of) AS weight_equal FROM rk WHERE rank <= {TOP}),
sp AS (SELECT scheme, as_of, least({WINDOW}, greatest(20, floor(median(e)))) AS span FROM tp JOIN ends USING (as_of, fund_code) GROUP BY ALL),
vol AS (SELECT scheme, as_of, fund_code, 1 / (stddev_pop(ret) + 1e-8) AS i FROM tp JOIN sp USING (scheme, as_of) JOIN ends USING (as_of, fund_code) JOIN rn USING (fund_code) WHERE rn > e - span AND rn <= e GROUP BY ALL),
pf AS (SELECT scheme, as_of, fund_code, score, rank, weight_equal, i / sum(i) OVER (PARTITION BY scheme, as_of) AS weight_risk_parity FROM tp JOIN vol USING (scheme, as_of, fund_code))"""


def _sim(targets: str, held: str = "tk") -> str:
    """Curve and trades of ``targets`` (experiment, as_of, fund_code, w). ``held``: the dates (experiment, as_of, nx) that act."""
    return f"""tw AS ({targets}),
tk AS (SELECT experiment, as_of, row_number() OVER (PARTITION BY experiment ORDER BY as_of) AS k, lead(as_of) OVER (PARTITION BY experiment ORDER BY as_of) AS nx FROM (SELECT DISTINCT experiment, as_of FROM tw)),
mv AS (SELECT experiment, k, fund_code, sum(w) AS d FROM (SELECT experiment, k, fund_code, w FROM tw JOIN tk USING (experiment, as_of) UNION ALL SELECT experiment, k + 1, fund_code, -w FROM tw JOIN tk USING (experiment, as_of)) GROUP BY ALL),
ef AS (SELECT as_of, min(date) AS eff FROM (SELECT DISTINCT as_of FROM tw) LEFT JOIN dates ON date > as_of GROUP BY 1),
tr AS (SELECT experiment, as_of, CASE WHEN k > 1 THEN v ELSE 0 END AS traded, eff FROM (SELECT experiment, k, sum(abs(d)) AS v FROM mv GROUP BY ALL) JOIN tk USING (experiment, k) JOIN ef USING (as_of)),
dy AS (SELECT experiment, as_of, date FROM {held} JOIN dates ON date > as_of AND (nx IS NULL OR date <= nx)),
gr AS (SELECT experiment, date, sum(w * coalesce(ret, 0)) AS gross, sum(CASE WHEN ret IS NOT NULL THEN abs(w) ELSE 0 END) / sum(abs(w)) AS coverage FROM dy JOIN tw USING (experiment, as_of) LEFT JOIN rets USING (fund_code, date) WHERE w <> 0 GROUP BY ALL),
cu AS (SELECT experiment, date, gross, coalesce(c, 0) AS cost, gross - coalesce(c, 0) AS net, bench_ret AS bench, coverage FROM gr LEFT JOIN (SELECT experiment, eff AS date, sum(traded * 0.001) AS c FROM tr WHERE eff IS NOT NULL GROUP BY ALL) USING (experiment, date) JOIN bench USING (date))"""


def _metrics(source: str, keys: str) -> str:
    """Metrics CTE ``me`` of ``source`` (keys, date, ret)."""
    return f"""pw AS (SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS w FROM ({source}) WHERE ret IS NOT NULL),
pd AS (SELECT *, w / max(w) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS d FROM pw),
pa AS (SELECT {keys}, min(date) AS start, max(date) AS "end", count(*) AS observations, max_by(w, date) AS final_equity, avg(ret) AS mean, stddev_pop(ret) * sqrt(252) AS annual_volatility, min(d) AS max_drawdown,
  greatest(1.0 / 252, CASE WHEN count(*) > 1 THEN (max(date) - min(date)) / 365.25 ELSE count(*) / 252.0 END) AS years FROM pd GROUP BY {keys}),
me AS (SELECT {keys}, start, "end", observations, final_equity, final_equity - 1 AS total_return, pow(final_equity, 1 / years) - 1 AS cagr, annual_volatility, mean * 252 / nullif(annual_volatility, 0) AS sharpe, max_drawdown, years FROM pa)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_BASE = _with(_NAV, _reb(), _FACTORS, _SCORES, _TOP)
_DEFAULT_TARGETS = f"SELECT scheme AS experiment, as_of, fund_code, weight_equal AS w FROM pf WHERE scheme = '{scoring.DEFAULT}'"
_ALL_TARGETS = "SELECT scheme AS experiment, as_of, fund_code, weight_equal AS w FROM pf"
_CURVES = " UNION ALL ".join(f"SELECT experiment, '{n}' AS portfolio, date, {c} AS ret FROM cu" for n, c in (("strategy_gross", "gross"), ("strategy_net", "net"), ("equal_weight_benchmark", "bench")))
_METRIC_COLUMNS = ("final_equity", "total_return", "cagr", "annual_volatility", "sharpe", "max_drawdown")


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Doubles rounded, and never -0.0, so that no order of summation shows."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols})


def _r(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in cols)


def _rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(returns.to_returns(adapters.nav(spark, sf_dir, all_returns=True)))


def _run(spark: SparkSession, sf_dir: str, schemes: dict | None = None) -> research.Run:
    return research.rolling_backtest(spark, _rets(spark, sf_dir), SETTINGS, schemes)


@query("SELECT * REPLACE (" + _r("nav", "daily_return") + """) FROM (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS fund_code, l_shipdate::DATE AS date, min_by(l_extendedprice, l_orderkey * 10 + l_linenumber) / 1000 AS nav,
  NULL::DOUBLE AS acc_nav, min_by(l_discount, l_orderkey * 10 + l_linenumber) AS daily_return FROM lineitem GROUP BY ALL)""")
def nav_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as landed NAV text with raw headers, percents and repeated (fund, date) rows, cleaned."""
    raw = adapters.table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("fund_code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("净值日期"), (F.col("l_extendedprice") / 1000).cast("string").alias("单位净值"),
        F.lit("--").alias("累计净值"), F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")).alias("日增长率"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return _rounded(sources.clean_raw_nav(raw, "pos"), "nav", "daily_return")


@query(_with(_NAV) + """SELECT fund_code, date, """ + _r("nav", "acc_nav", "daily_return", places=12) + """ FROM nav JOIN supplier ON fund_code = lpad(s_suppkey::VARCHAR, 6, '0')
WHERE date >= DATE '1997-01-01' AND fund_code IN (SELECT fund_code FROM nav WHERE date >= DATE '1997-01-01' GROUP BY 1 HAVING count(DISTINCT date) >= 60)""")
def load_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sources.load_nav(adapters.nav(spark, sf_dir), adapters.universe(spark, sf_dir), "1997-01-01", 60), "nav", "acc_nav", "daily_return", places=12)


@query(_with(_NAV) + """, p AS (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY date) AS rn, count(*) OVER (PARTITION BY fund_code) AS n FROM nav),
q AS (SELECT *, (sum(CASE WHEN rn > 1 AND daily_return IS NOT NULL THEN 1 ELSE 0 END) OVER f) / (n - 1) >= 0.8 AS own, (count(acc_nav) OVER f) / n >= 0.95 AS acc FROM p WINDOW f AS (PARTITION BY fund_code)),
s AS (SELECT *, CASE WHEN acc THEN acc_nav ELSE nav END AS src FROM q), t AS (SELECT *, CASE WHEN own THEN daily_return ELSE src / lag(src) OVER (PARTITION BY fund_code ORDER BY date) - 1 END AS ret FROM s)
SELECT fund_code, date, """ + _r("ret") + " FROM t WHERE ret IS NOT NULL")
def returns_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(returns.to_returns(adapters.nav(spark, sf_dir)), "ret")


@query(_with(_NAV) + """SELECT a.fund_code, a.date, round(a.nav / b.nav - 1, 6) + 0.0 AS ret FROM (SELECT * FROM nav JOIN cal USING (date)) a
LEFT JOIN (SELECT fund_code, nav, idx FROM nav JOIN cal USING (date)) b ON a.fund_code = b.fund_code AND b.idx = a.idx - 1""")
def calendar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(returns.calendar_returns(adapters.nav(spark, sf_dir)), "ret")


@query(_with(_NAV) + "SELECT date, round(bench_ret, 8) + 0.0 AS bench_ret FROM bench")
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(returns.equal_weight_benchmark(_rets(spark, sf_dir)), "bench_ret", places=8)


def _rebalances(freq: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return returns.rebalance_dates(adapters.nav(spark, sf_dir).select("date"), freq, WINDOW)

    run.__name__ = f"rebalance_{freq}"
    query(_with(_NAV, _reb(freq)) + "SELECT as_of FROM reb")(run)


for _freq in ("month", "quarter", "week"):
    _rebalances(_freq)


@query(_with(_NAV, "reb AS (SELECT max(date) AS as_of FROM dates)", _FACTORS) + "SELECT as_of, fund_code, " + _r(*factors.FACTORS) + " FROM fac")
def factors_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = _rets(spark, sf_dir)
    return _rounded(factors.compute_factors(rets, returns.equal_weight_benchmark(rets), factors.latest(rets), WINDOW), *factors.FACTORS)


@query(_with(_NAV, _reb(), _FACTORS) + "SELECT as_of, fund_code, " + _r(*factors.FACTORS) + " FROM fac")
def factors_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(research.factor_table(_rets(spark, sf_dir), SETTINGS, in_order=True), *factors.FACTORS)


_TIED = "SELECT as_of, fund_code, " + _r(*(f for f in factors.FACTORS if f != "mdd")) + ", round(mdd + 1e-12, 6) + 0.0 AS mdd FROM fac"


@query(_with(_NAV, _reb("week"), _FACTORS) + _TIED)
def factors_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors at every week's end: five times as many windows as monthly ones over the same segments. Drawdowns are compared a
    little above, since exact decimals tie."""
    out = research.factor_table(_rets(spark, sf_dir), research.Settings(top_n=TOP, window=WINDOW, rebalance="week"))
    return _rounded(out.withColumn("mdd", F.col("mdd") + 1e-12), *factors.FACTORS)


@query(_with(_NAV, _reb(), _FACTORS, _SCORES) + f"SELECT as_of, fund_code, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM rk WHERE scheme = '{scoring.DEFAULT}'")
def score_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir).scores.select("as_of", "fund_code", "score", "rank"), "score")


@query(_with(_NAV, _reb(), _FACTORS, _SCORES) + "SELECT scheme, as_of, fund_code, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM rk")
def score_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir, scoring.SCHEMES).scores.select("scheme", "as_of", "fund_code", "score", "rank"), "score")


@query(_with(_NAV, "reb AS (SELECT max(date) AS as_of FROM dates)", _FACTORS, _SCORES) + f"SELECT as_of, fund_code, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank, round(1.0 / count(*) OVER (), 6) AS weight_equal FROM rk WHERE scheme = '{scoring.DEFAULT}' AND rank <= {TOP}")
def topn_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: NAV to the Top-N equal-weight portfolio of the last date."""
    rets = _rets(spark, sf_dir)
    f = materialised(factors.compute_factors(rets, returns.equal_weight_benchmark(rets), factors.latest(rets), WINDOW))
    held = portfolio.equal_weights(scoring.score_funds(f, scoring.scheme_table(spark, {scoring.DEFAULT: scoring.SCHEMES[scoring.DEFAULT]})), TOP)
    return _rounded(held.select("as_of", "fund_code", "score", "rank", "weight_equal"), "score", "weight_equal")


@query(_BASE + "SELECT scheme, as_of, fund_code, round(weight_risk_parity, 6) AS weight_risk_parity FROM pf")
def inverse_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir, scoring.SCHEMES).holdings.select("scheme", "as_of", "fund_code", "weight_risk_parity"), "weight_risk_parity")


@query(_BASE + "SELECT scheme, as_of, fund_code, round((weight_equal + weight_risk_parity) / 2, 6) AS weight_mixed FROM pf")
def mixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir, scoring.SCHEMES).holdings.select("scheme", "as_of", "fund_code", "weight_mixed"), "weight_mixed")


@query("""WITH w AS (SELECT o_custkey::VARCHAR AS as_of, lpad(o_orderkey::VARCHAR, 9, '0') AS fund_code, o_totalprice AS x, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
o AS (SELECT *, x / sum(x) OVER (PARTITION BY as_of) AS w FROM w WHERE n >= 4),
i AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY w DESC, fund_code) AS i, sum(w) OVER (PARTITION BY as_of ORDER BY w DESC, fund_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
k AS (SELECT *, min(CASE WHEN w * (1 - (i - 1) * 0.3) / rest <= 0.3 + 1e-15 THEN i - 1 END) OVER (PARTITION BY as_of) AS k FROM i),
c AS (SELECT *, max(CASE WHEN i = k + 1 THEN rest END) OVER (PARTITION BY as_of) AS l FROM k)
SELECT as_of, fund_code, round(CASE WHEN i <= k THEN 0.3 ELSE w * (1 - k * 0.3) / l END, 6) AS weight FROM c""")
def cap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a portfolio of four positions or more, capped at 30 %."""
    orders = adapters.table(spark, sf_dir, "orders")
    n = orders.groupBy("o_custkey").count().where("count >= 4").select("o_custkey")
    w = orders.join(n, "o_custkey").select(F.col("o_custkey").cast("string").alias("as_of"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("fund_code"), F.col("o_totalprice").alias("weight"))
    return _rounded(portfolio.cap_weights(w, 0.3), "weight")


@query(_BASE.rstrip() + ",\n" + _sim(_DEFAULT_TARGETS) + "\nSELECT as_of, round(traded / 2, 6) AS turnover, round(traded, 6) AS traded_notional, round(traded * 0.001, 8) AS cost, eff AS effective_date FROM tr")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(_run(spark, sf_dir).trades.select("as_of", "turnover", "traded_notional", "cost", "effective_date"), "turnover", "traded_notional"), "cost", places=8)


@query(_BASE.rstrip() + ",\n" + _sim(_DEFAULT_TARGETS) + "\nSELECT date, round(gross + 1e-12, 6) + 0.0 AS gross_return, round(cost, 8) + 0.0 AS transaction_cost, round(net + 1e-12, 6) + 0.0 AS net_return, round(bench + 1e-12, 6) + 0.0 AS benchmark_return, round(coverage + 1e-12, 6) AS return_coverage, round(product(1 + net) OVER (ORDER BY date) + 1e-12, 6) AS net_equity FROM cu")
def simulate_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _run(spark, sf_dir).curve.select("date", "gross_return", "transaction_cost", "net_return", "benchmark_return", "return_coverage", "net_equity")
    c = c.withColumns({x: F.col(x) + 1e-12 for x in ("gross_return", "net_return", "benchmark_return", "return_coverage", "net_equity")})  # exact decimals tie
    return _rounded(_rounded(c, "gross_return", "net_return", "benchmark_return", "return_coverage", "net_equity"), "transaction_cost", places=8)


@query(_BASE.rstrip() + ",\n" + _sim(_ALL_TARGETS) + ",\n" + _metrics(_CURVES, "experiment, portfolio") + '\nSELECT experiment, portfolio, start, "end", observations, ' + _r(*_METRIC_COLUMNS) + " FROM me")
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir, scoring.SCHEMES).metrics, *_METRIC_COLUMNS)


_SUMMARY = """, ts AS (SELECT experiment, count(*) AS rebalance_count, count(eff) AS executed_count, avg(traded / 2) FILTER (eff IS NOT NULL) AS average_turnover, coalesce(sum(traded) FILTER (eff IS NOT NULL), 0) AS total_traded_notional FROM tr GROUP BY 1),
cs AS (SELECT experiment, product(1 + gross) - product(1 + net) AS cost_drag, avg(coverage) AS average_coverage FROM cu GROUP BY 1)
SELECT experiment, n.start, n."end", rebalance_count, executed_count, round(average_turnover, 6) AS average_turnover, round(total_traded_notional / 2 / n.years, 6) AS annualized_turnover, round(total_traded_notional, 6) AS total_traded_notional,
  round(total_traded_notional * 0.001, 6) AS total_transaction_cost, round(cost_drag, 6) AS cost_drag, round(n.total_return - b.total_return, 6) AS excess_total_return, round(n.cagr - b.cagr, 6) AS excess_cagr, n.total_return > b.total_return AS beat_benchmark, round(average_coverage, 6) AS average_coverage
FROM ts JOIN cs USING (experiment) JOIN me n USING (experiment) JOIN me b USING (experiment) WHERE n.portfolio = 'strategy_net' AND b.portfolio = 'equal_weight_benchmark'"""
_SUMMARY_COLUMNS = ("average_turnover", "annualized_turnover", "total_traded_notional", "total_transaction_cost", "cost_drag", "excess_total_return", "excess_cagr", "average_coverage")


@query(_BASE.rstrip() + ",\n" + _sim(_ALL_TARGETS) + ",\n" + _metrics(_CURVES, "experiment, portfolio") + _SUMMARY)
def rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir, scoring.SCHEMES).summary, *_SUMMARY_COLUMNS)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored portfolio: at the first date of each quarter all funds with a NAV in it, each weighing one more than its code."""
    nav = adapters.nav(spark, sf_dir).select("fund_code", "date", F.trunc("date", "quarter").alias("quarter"))
    firsts = nav.groupBy("quarter").agg(F.min("date").alias("date"))
    funds = nav.select("fund_code", "quarter").distinct().join(F.broadcast(firsts), "quarter")  # one row for each quarter
    return funds.select("date", "fund_code", (1.0 + F.col("fund_code").cast("int")).alias("weight_equal"))


_STORED = """tw0 AS (SELECT q.date AS as_of, n.fund_code, 1.0 + n.fund_code::INTEGER AS v FROM (SELECT DISTINCT fund_code, date_trunc('quarter', date) AS quarter FROM nav) n
JOIN (SELECT date_trunc('quarter', date) AS quarter, min(date) AS date FROM nav GROUP BY 1) q USING (quarter))"""
_ON_CALENDAR = "(SELECT experiment, as_of, lead(as_of) OVER (PARTITION BY experiment ORDER BY as_of) AS nx FROM tk WHERE as_of IN (SELECT date FROM dates))"
_REPLAYED = "SELECT 'replay' AS experiment, as_of, fund_code, v / sum(v) OVER (PARTITION BY as_of) AS w FROM tw0 WHERE as_of >= DATE '1996-01-01'"


@query(
    _with(_RAW, _CALENDAR_RETURNS, _dated(), _STORED, _sim(_REPLAYED, _ON_CALENDAR))
    + "SELECT date, round(gross, 6) + 0.0 AS gross_return, round(net, 6) + 0.0 AS net_return, round(bench, 6) + 0.0 AS benchmark_return, round(coverage, 6) AS return_coverage FROM cu"
)
def replay_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve, _ = backtest.replay_backtest(_stored(spark, sf_dir), materialised(adapters.nav(spark, sf_dir)), since="1996-01-01")
    return _rounded(curve.select("date", "gross_return", "net_return", "benchmark_return", "return_coverage"), "gross_return", "net_return", "benchmark_return", "return_coverage")


@query(_with(_NAV, _STORED) + """, rc AS (SELECT * FROM nav WHERE date >= (SELECT max(date) FROM nav) - 365), c AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM rc)),
w AS (SELECT fund_code, v / sum(v) OVER () AS w FROM tw0 WHERE as_of = (SELECT max(as_of) FROM tw0) AND fund_code IN (SELECT fund_code FROM rc)),
x AS (SELECT a.fund_code, a.date, a.nav / b.nav - 1 AS ret FROM (SELECT * FROM rc JOIN c USING (date)) a LEFT JOIN (SELECT fund_code, nav, idx FROM rc JOIN c USING (date)) b ON a.fund_code = b.fund_code AND b.idx = a.idx - 1),
d AS (SELECT date, sum(coalesce(w, 0) * coalesce(ret, 0)) AS ret FROM x LEFT JOIN w USING (fund_code) GROUP BY 1)
SELECT date, round(ret, 6) + 0.0 AS ret, round(ln(product(1 + ret) OVER (ORDER BY date)), 6) + 0.0 AS log_equity FROM d""")
def backfill_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity as a logarithm: unit prices change so wildly from day to day that it spans many powers of ten."""
    out = backtest.backfill_equity(materialised(adapters.nav(spark, sf_dir)), _stored(spark, sf_dir))
    return _rounded(out.select("date", "ret", F.ln("equity").alias("log_equity")), "ret", "log_equity")


_FORWARD = """rb AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nx FROM (SELECT DISTINCT as_of FROM {0})),
fw AS (SELECT as_of, fund_code, product(1 + ret) - 1 AS forward_ret FROM rb JOIN rets ON date > as_of AND date <= nx GROUP BY ALL)"""


@query(_with(_NAV, _reb(), _FORWARD.format("reb")) + "SELECT as_of, fund_code, round(forward_ret + 1e-12, 8) + 0.0 AS forward_ret FROM fw")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = _rets(spark, sf_dir)
    out = returns.forward_returns(rets, returns.rebalance_dates(rets, "month", WINDOW))
    return _rounded(out.withColumn("forward_ret", F.col("forward_ret") + 1e-12), "forward_ret", places=8)  # exact decimals tie often


_SIGNS = "(CASE WHEN factor IN ('ann_vol', 'down_vol') THEN -1 ELSE 1 END)"
_GROUPS = f"""{_FORWARD.format('fac')},
sg AS (SELECT as_of, fund_code, factor, x * {_SIGNS} AS s, forward_ret FROM (SELECT * FROM lf UNION ALL SELECT as_of, fund_code, 'score', score FROM rk WHERE scheme = '{scoring.DEFAULT}') JOIN fw USING (as_of, fund_code) WHERE x IS NOT NULL),
sr AS (SELECT *, row_number() OVER (PARTITION BY as_of, factor ORDER BY s, fund_code) AS i, count(*) OVER (PARTITION BY as_of, factor) AS n, count(DISTINCT s) OVER (PARTITION BY as_of, factor) AS kinds FROM sg),
ed AS (SELECT n, j, CASE WHEN t < 0.5 THEN (1 + lo) + t ELSE (2 + lo) - (1 - t) END AS edge FROM (SELECT n, j, floor(v) AS lo, v - floor(v) AS t FROM (SELECT n, j, (n - 1) * (j * (1.0::DOUBLE / {GROUPS}) * 100 / 100) AS v FROM (SELECT DISTINCT n FROM sr), range(1, {GROUPS}) r(j)))),
bn AS (SELECT as_of, factor, 1 + (SELECT count(*) FROM ed WHERE ed.n = sr.n AND sr.i > edge) AS bin, forward_ret FROM sr WHERE n >= {2 * GROUPS} AND kinds >= {GROUPS}),
gp AS (SELECT as_of, factor, bin, avg(forward_ret) AS mean_forward, count(*) AS funds FROM bn GROUP BY ALL)"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    run = _run(spark, sf_dir)
    return research.factor_diagnostics(run, run.returns, scoring.SCHEMES[scoring.DEFAULT], GROUPS)


@query(_BASE.rstrip() + ",\n" + _GROUPS + "\nSELECT as_of, factor, bin::INTEGER AS bin, round(mean_forward, 6) + 0.0 AS mean_forward, funds FROM gp")
def factor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diagnostics(spark, sf_dir)["groups"], "mean_forward")


@query(_BASE.rstrip() + ",\n" + _GROUPS + "\nSELECT factor, bin::INTEGER AS bin, count(*) AS periods, round(avg(mean_forward), 6) + 0.0 AS mean, round(median(mean_forward), 6) + 0.0 AS median, round(avg((mean_forward > 0)::INTEGER), 6) AS positive_rate, round(product(1 + mean_forward) - 1, 6) + 0.0 AS compounded FROM gp GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diagnostics(spark, sf_dir)["group_summary"], "mean", "median", "positive_rate", "compounded")


@query(_BASE.rstrip() + ",\n" + _GROUPS + f""",
wd AS (SELECT as_of, factor, max(CASE WHEN bin = {GROUPS} THEN mean_forward END) - max(CASE WHEN bin = 1 THEN mean_forward END) AS d FROM gp GROUP BY ALL HAVING count(*) = {GROUPS})
SELECT factor, count(*) AS periods, round(avg(d), 6) + 0.0 AS mean_spread, round(avg((d > 0)::INTEGER), 6) AS win_rate FROM wd GROUP BY 1""")
def factor_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diagnostics(spark, sf_dir)["spread"].select("factor", "periods", "mean_spread", "win_rate"), "mean_spread", "win_rate")


_PLACE = "list_position([" + ", ".join(f"'{f}'" for f in factors.FACTORS) + "], {0})"
_CORR = f"""{_LONG}, pr AS (SELECT as_of, a.factor AS factor_a, b.factor AS factor_b, round(a.x, 10) + 0.0 AS a, round(b.x, 10) + 0.0 AS b FROM lf a JOIN lf b USING (as_of, fund_code) WHERE {_PLACE.format('a.factor')} < {_PLACE.format('b.factor')} AND a.x IS NOT NULL AND b.x IS NOT NULL),
ra AS (SELECT *, rank() OVER (PARTITION BY as_of, factor_a, factor_b ORDER BY a) + (count(*) OVER (PARTITION BY as_of, factor_a, factor_b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY as_of, factor_a, factor_b ORDER BY b) + (count(*) OVER (PARTITION BY as_of, factor_a, factor_b, b) - 1) / 2 AS rb FROM pr),
co AS (SELECT as_of, factor_a, factor_b, corr(ra, rb) AS correlation, count(*) AS n FROM ra GROUP BY ALL HAVING count(*) >= 3 AND min(ra) < max(ra) AND min(rb) < max(rb))"""


@query(_with(_NAV, _reb(), _FACTORS, _CORR) + "SELECT as_of, factor_a, factor_b, round(correlation, 6) + 0.0 AS correlation, n FROM co")
def factor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diagnostics.factor_correlation(research.factor_table(_rets(spark, sf_dir), SETTINGS)), "correlation")


@query(_with(_NAV, _reb(), _FACTORS, _CORR) + 'SELECT factor_a, factor_b, round(avg(correlation), 6) + 0.0 AS mean, round(median(correlation), 6) + 0.0 AS median, round(min(correlation), 6) + 0.0 AS min, round(max(correlation), 6) + 0.0 AS max, count(*) AS "count" FROM co GROUP BY 1, 2')
def corr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diagnostics.correlation_summary(diagnostics.factor_correlation(research.factor_table(_rets(spark, sf_dir), SETTINGS))), "mean", "median", "min", "max")


@query(_with(_NAV) + """, lt AS (SELECT fund_code, max(date) AS latest FROM nav GROUP BY 1), pl AS (SELECT max(latest) AS pool FROM lt)
SELECT 'missing_fund' AS "check", lpad(p_partkey::VARCHAR, 6, '0') AS fund_code, 1.0::DOUBLE AS value FROM part WHERE lpad(p_partkey::VARCHAR, 6, '0') NOT IN (SELECT fund_code FROM lt)
UNION ALL SELECT 'stale_fund', fund_code, (pool - latest)::DOUBLE FROM lt, pl WHERE pool - latest > 7
UNION ALL SELECT 'stale_pool', NULL, (DATE '2001-12-31' - pool)::DOUBLE FROM pl WHERE DATE '2001-12-31' - pool > 7
UNION ALL SELECT 'metadata', NULL, round(c, 6) FROM (SELECT avg((acc_nav IS NOT NULL OR daily_return IS NOT NULL)::INTEGER) AS c FROM nav) WHERE c < 0.95
UNION ALL SELECT 'extreme_returns', NULL, n::DOUBLE FROM (SELECT count(*) AS n FROM (SELECT CASE WHEN k % 3 = 0 THEN r ELSE nav / lag(nav) OVER (PARTITION BY fund_code ORDER BY date) - 1 END AS x FROM raw) WHERE abs(x) > 0.5) WHERE n > 0""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = adapters.nav(spark, sf_dir)
    wanted = adapters.table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("fund_code"))
    return _rounded(quality.check_nav(nav, wanted, "2001-12-31", returns.to_returns(nav)).drop("message"), "value")


@query(_with(_NAV, _reb(), _FACTORS, _SCORES) + f""", s AS (SELECT as_of, count(DISTINCT score) AS kinds, count(*) AS n FROM rk WHERE scheme = '{scoring.DEFAULT}' GROUP BY 1)
SELECT as_of, 'few_values' AS "check", kinds AS value FROM s WHERE kinds <= 3 UNION ALL SELECT as_of, 'few_funds', n FROM s WHERE n < 80 UNION ALL SELECT as_of, 'below_top_n', n FROM s WHERE n < 90""")
def score_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_scores(_run(spark, sf_dir).scores, 100, 90)


_UPSERTED = _with(_NAV) + """, t AS (SELECT * FROM nav WHERE date < DATE '2000-01-01'), b AS (SELECT fund_code, date, nav * 2 AS nav, NULL::DOUBLE AS acc_nav FROM nav WHERE date >= DATE '1999-06-01')
SELECT coalesce(t.fund_code, b.fund_code) AS fund_code, coalesce(t.date, b.date) AS date, round(CASE WHEN b.date IS NULL THEN t.nav ELSE b.nav END, 12) AS nav, round(CASE WHEN b.date IS NULL THEN t.acc_nav END, 12) AS acc_nav, round(t.daily_return, 12) + 0.0 AS daily_return
FROM t FULL JOIN b ON t.fund_code = b.fund_code AND t.date = b.date"""


@query(_UPSERTED)
def upsert_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = adapters.nav(spark, sf_dir)
    batch = nav.where("date >= '1999-06-01'").select("fund_code", "date", (F.col("nav") * 2).alias("nav"), F.lit(None).cast("double").alias("acc_nav"))
    return _rounded(sources.upsert_nav(nav.where("date < '2000-01-01'"), batch), "nav", "acc_nav", "daily_return", places=12)


def _store(spark: SparkSession, sf_dir: str) -> MonthlyStore:
    """A store of the NAV before 2000 with a later batch that overlaps it by seven months."""
    nav, store = materialised(adapters.nav(spark, sf_dir)), MonthlyStore(spark, shared_folder(spark))
    store.upsert(nav.where("date < '2000-01-01'"))
    store.upsert(nav.where("date >= '1999-06-01'").select("fund_code", "date", (F.col("nav") * 2).alias("nav"), F.lit(None).cast("double").alias("acc_nav")))
    return store


@query(_UPSERTED)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert through the monthly store, which leaves the months before June 1999 as they are."""
    return _rounded(_store(spark, sf_dir).read(), "nav", "acc_nav", "daily_return", places=12)


@query(f"SELECT * FROM ({_UPSERTED}) WHERE date BETWEEN DATE '1999-03-15' AND DATE '1999-09-15'")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of the store; the other months aren't opened."""
    return _rounded(_store(spark, sf_dir).read("1999-03-15", "1999-09-15"), "nav", "acc_nav", "daily_return", places=12)


@query(_with(_NAV) + "SELECT fund_code, max(date) AS latest FROM nav GROUP BY 1")
def store_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fund's latest date as the store keeps it from batch to batch."""
    return _store(spark, sf_dir).marks()


@query(_with(_NAV) + "SELECT lpad(p_partkey::VARCHAR, 6, '0') AS fund_code, coalesce(max(date) - 5, DATE '2022-01-01')::DATE AS since FROM part LEFT JOIN nav ON fund_code = lpad(p_partkey::VARCHAR, 6, '0') GROUP BY 1")
def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = adapters.table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("fund_code"))
    return returns.incremental_since(codes, adapters.nav(spark, sf_dir))


_UNIVERSE = _with(_NAV) + r""", cg AS (SELECT lpad(p_partkey::VARCHAR, 6, '0') AS fund_code, p_name || ' ' || p_brand || CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN ' (后端)' ELSE '' END AS fund_name, p_type AS fund_type, make_date(1990 + p_size % 12, 6, 30) AS inception, p_size % 4 AS cls, p_name || p_brand AS stem FROM part),
r1 AS (SELECT *, CASE WHEN NOT (contains(fund_type, 'ECONOMY') OR contains(fund_type, 'STANDARD')) THEN 'TYPE_NOT_ALLOWED' WHEN contains(upper(fund_name), 'RING') THEN 'SPECIAL_PRODUCT' WHEN cls = 2 THEN 'B_SHARE' ELSE '' END AS r FROM cg),
r2 AS (SELECT *, CASE WHEN r = '' THEN first_value(fund_code) OVER (PARTITION BY upper(replace(stem, ' ', '')), r = '' ORDER BY CASE cls WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END, fund_code) ELSE '' END AS base FROM r1),
r3 AS (SELECT *, CASE WHEN r = '' AND base <> fund_code THEN 'DUPLICATE_SHARE' ELSE r END AS r3 FROM r2),
r4 AS (SELECT *, CASE WHEN r3 = '' THEN row_number() OVER (PARTITION BY r3 ORDER BY sha256('42:' || fund_code), fund_code) END AS pick FROM r3),
r5 AS (SELECT *, CASE WHEN r3 <> '' THEN r3 WHEN pick > 40 THEN 'CANDIDATE_LIMIT' WHEN inception > DATE '1998-01-01' THEN 'INCEPTION_AFTER_BACKTEST_START' ELSE '' END AS r5 FROM r4),
nq AS (SELECT fund_code, min(date) AS data_start, max(date) AS data_end, count(*) AS nav_days FROM nav WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-12-31' AND fund_code IN (SELECT fund_code FROM r5 WHERE r5 = '') GROUP BY 1),
dn AS (SELECT count(DISTINCT date) AS days FROM nav WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-12-31' AND fund_code IN (SELECT fund_code FROM r5 WHERE r5 = '')),
r6 AS (SELECT r5.*, coalesce(nav_days, 0) AS nav_days, CASE WHEN r5 <> '' THEN r5 WHEN nav_days IS NULL THEN 'NO_NAV' WHEN nav_days < 100 THEN 'HISTORY_TOO_SHORT' WHEN round(nav_days / days, 6) < 0.1 THEN 'LOW_COVERAGE' ELSE '' END AS r6 FROM r5 LEFT JOIN nq USING (fund_code), dn),
r7 AS (SELECT *, CASE WHEN r6 = '' AND row_number() OVER (PARTITION BY r6 ORDER BY pick) > 5 THEN 'UNIVERSE_LIMIT' ELSE r6 END AS exclude_reason FROM r6)
"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = universes.normalize_catalog(adapters.catalog(spark, sf_dir))
    return universes.build_universe(catalog, adapters.nav(spark, sf_dir), "1998-01-01", "2001-12-31", 5, 40, 42, None, ("ECONOMY", "STANDARD"), ("RING",), "NONE", 100, 0.1, 0.9)[0]


@query(_UNIVERSE + "SELECT fund_code, fund_name, base AS base_fund_code, exclude_reason, CASE WHEN exclude_reason = '' THEN 'retained' ELSE 'excluded' END AS status FROM r7")
def universe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).select("fund_code", "fund_name", "base_fund_code", "exclude_reason", "status")


@query(_UNIVERSE + "SELECT CASE WHEN exclude_reason = '' THEN 'RETAINED' ELSE exclude_reason END AS exclude_reason, count(*) AS funds FROM r7 GROUP BY 1")
def universe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universes.universe_summary(_audit(spark, sf_dir))


@query(_with(_NAV) + """, x AS (SELECT fund_code, date, nav / lag(nav) OVER (PARTITION BY fund_code ORDER BY date) - 1 AS r FROM nav WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-12-31'),
q AS (SELECT fund_code, min(date) AS data_start, max(date) AS data_end, count(*) AS nav_days, coalesce(round(avg((abs(r) < 1e-12)::INTEGER), 6), 1.0) AS zero_return_ratio FROM x GROUP BY 1), d AS (SELECT count(DISTINCT date) AS days FROM x)
SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS fund_code, data_start, data_end, coalesce(nav_days, 0) AS nav_days, round(nav_days / days, 6) AS data_coverage, zero_return_ratio,
  CASE WHEN nav_days IS NULL THEN 'NO_NAV' WHEN nav_days < 290 THEN 'HISTORY_TOO_SHORT' WHEN round(nav_days / days, 6) < 0.2 THEN 'LOW_COVERAGE' WHEN zero_return_ratio >= 0.9 THEN 'SUSPICIOUS_ZERO_RETURN' ELSE '' END AS quality_reason
FROM supplier LEFT JOIN q ON fund_code = lpad(s_suppkey::VARCHAR, 6, '0'), d""")
def nav_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universes.nav_quality(adapters.nav(spark, sf_dir), adapters.universe(spark, sf_dir), "1998-01-01", "2001-12-31", 290, 0.2, 0.9)


_GRID_TOPS, _GRID_RETURNS = (3, 5), ("net_total_return", "net_cagr", "net_annual_volatility", "net_sharpe", "net_max_drawdown", "benchmark_total_return", "benchmark_cagr", "benchmark_sharpe", "excess_total_return", "excess_cagr", "annualized_turnover", "total_transaction_cost")
_GRID = _with(_NAV, _reb().replace("reb AS", "month_reb AS"), _reb("quarter").replace("reb AS", "quarter_reb AS"), f"""rf AS (SELECT 'month' AS rebalance, as_of FROM month_reb UNION ALL SELECT 'quarter', as_of FROM quarter_reb),
reb AS (SELECT DISTINCT as_of FROM rf)""", _FACTORS, _SCORES, f"""hp AS (SELECT top_n, as_of, fund_code FROM rk, (VALUES {', '.join(f'({n})' for n in _GRID_TOPS)}) g(top_n) WHERE scheme = '{scoring.DEFAULT}' AND rank <= top_n),
sp AS (SELECT top_n, as_of, least({WINDOW}, greatest(20, floor(median(e)))) AS span FROM hp JOIN ends USING (as_of, fund_code) GROUP BY ALL),
vol AS (SELECT top_n, as_of, fund_code, 1 / (stddev_pop(ret) + 1e-8) AS i FROM hp JOIN sp USING (top_n, as_of) JOIN ends USING (as_of, fund_code) JOIN rn USING (fund_code) WHERE rn > e - span AND rn <= e GROUP BY ALL),
eq AS (SELECT top_n, as_of, fund_code, 1.0::DOUBLE / count(*) OVER (PARTITION BY top_n, as_of) AS eq, i / sum(i) OVER (PARTITION BY top_n, as_of) AS rp FROM vol),
lw AS (SELECT top_n, as_of, fund_code, 'weight_equal' AS weight_scheme, eq AS w0 FROM eq UNION ALL SELECT top_n, as_of, fund_code, 'weight_risk_parity', rp FROM eq UNION ALL SELECT top_n, as_of, fund_code, 'weight_mixed', (eq + rp) / 2 FROM eq),
gp AS (SELECT 'top' || top_n || '_' || weight_scheme[8:] || '_' || rebalance || '_' || label AS experiment, lw.*, rebalance, max_weight FROM lw JOIN rf USING (as_of), (VALUES (1.0::DOUBLE, 'uncapped'), (0.4::DOUBLE, 'cap40')) c(max_weight, label)),
gi AS (SELECT *, row_number() OVER (PARTITION BY experiment, as_of ORDER BY w0 DESC, fund_code) AS i, sum(w0) OVER (PARTITION BY experiment, as_of ORDER BY w0 DESC, fund_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM gp),
gk AS (SELECT *, min(CASE WHEN w0 * (1 - (i - 1) * max_weight) / rest <= max_weight + 1e-15 THEN i - 1 END) OVER (PARTITION BY experiment, as_of) AS k FROM gi),
gl AS (SELECT *, max(CASE WHEN i = k + 1 THEN rest END) OVER (PARTITION BY experiment, as_of) AS l FROM gk)""",
    _sim("SELECT experiment, as_of, fund_code, CASE WHEN max_weight >= 1 THEN w0 WHEN i <= k THEN max_weight ELSE w0 * (1 - k * max_weight) / l END AS w FROM gl"), _metrics(_CURVES, "experiment, portfolio"), """grid AS (
SELECT experiment, top_n::INTEGER AS top_n, weight_scheme, rebalance, max_weight, n.total_return AS net_total_return, n.cagr AS net_cagr, n.annual_volatility AS net_annual_volatility, n.sharpe AS net_sharpe, n.max_drawdown AS net_max_drawdown,
  b.total_return AS benchmark_total_return, b.cagr AS benchmark_cagr, b.sharpe AS benchmark_sharpe, n.total_return - b.total_return AS excess_total_return, n.cagr - b.cagr AS excess_cagr, traded / 2 / n.years AS annualized_turnover, traded * 0.001 AS total_transaction_cost, n.total_return > b.total_return AS beat_benchmark
FROM (SELECT DISTINCT experiment, top_n, weight_scheme, rebalance, max_weight FROM gp) JOIN me n USING (experiment) JOIN me b USING (experiment) JOIN (SELECT experiment, coalesce(sum(traded) FILTER (eff IS NOT NULL), 0) AS traded FROM tr GROUP BY 1) USING (experiment)
WHERE n.portfolio = 'strategy_net' AND b.portfolio = 'equal_weight_benchmark')""")


@query(_GRID + "SELECT * REPLACE (" + _r(*_GRID_RETURNS) + ") FROM grid")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of two sizes, three weightings, two frequencies and two caps."""
    return _rounded(research.sensitivity_grid(spark, _rets(spark, sf_dir), SETTINGS, tops=_GRID_TOPS), *_GRID_RETURNS)


@query(_GRID + "SELECT * REPLACE (" + _r(*_GRID_RETURNS) + ") FROM (SELECT * FROM grid ORDER BY excess_cagr DESC, net_sharpe DESC, experiment LIMIT 10)")
def sensitivity_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of these."""
    return _rounded(research.sensitivity_grid(spark, _rets(spark, sf_dir), SETTINGS, tops=_GRID_TOPS, best=10), *_GRID_RETURNS)


_PERIODS = (("early", "1990-01-01", "1998-12-31"), ("full", "1990-01-01", "2009-12-31"), ("late", "1999-01-01", "2009-12-31"))
_IN_PERIODS = "SELECT experiment, period, portfolio, date, ret FROM (" + _CURVES + ") JOIN pp ON date BETWEEN first AND last"


@query(_BASE.rstrip() + ",\n" + _sim(_ALL_TARGETS) + ",\npp(period, first, last) AS (VALUES " + ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in _PERIODS) + "),\n" + _metrics(_IN_PERIODS, "experiment, period, portfolio") + """
SELECT experiment, period, round(n.total_return, 6) AS net_total_return, round(n.cagr, 6) AS net_cagr, round(n.sharpe, 6) AS net_sharpe, round(n.max_drawdown, 6) AS net_max_drawdown, round(n.total_return - b.total_return, 6) AS excess_total_return,
  round(n.cagr - b.cagr, 6) AS excess_cagr, n.total_return > b.total_return AS beat_benchmark, round(coalesce(t, 0) / n.years, 6) AS annualized_turnover, round(coalesce(t, 0) * 0.002, 6) AS total_transaction_cost
FROM me n JOIN me b USING (experiment, period) LEFT JOIN (SELECT experiment, period, sum(traded / 2) AS t FROM tr JOIN pp ON eff BETWEEN first AND last GROUP BY ALL) USING (experiment, period)
WHERE n.portfolio = 'strategy_net' AND b.portfolio = 'equal_weight_benchmark'""")
def scheme_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, scoring.SCHEMES)
    periods = spark.createDataFrame(list(_PERIODS), "period string, first string, last string").select("period", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    cols = ("net_total_return", "net_cagr", "net_sharpe", "net_max_drawdown", "excess_total_return", "excess_cagr", "annualized_turnover", "total_transaction_cost")
    return _rounded(backtest.period_metrics(run.curve, run.trades, periods).select("experiment", "period", *cols, "beat_benchmark"), *cols)


_RANGE = ("1997-03-15", "2000-06-20")


@query(
    _with(_RAW, _OWN_RETURNS, _dated(f"date BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}'"), _reb(), _FACTORS, _SCORES, _TOP, _sim(_ALL_TARGETS), _metrics(_CURVES, "experiment, portfolio"))
    + 'SELECT experiment, portfolio, start, "end", observations, ' + _r(*_METRIC_COLUMNS) + " FROM me"
)
def rolling_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling backtest from one date to another; factors look at the returns before."""
    run = research.rolling_backtest(spark, _rets(spark, sf_dir), SETTINGS, scoring.SCHEMES, *_RANGE)
    return _rounded(run.metrics, *_METRIC_COLUMNS)


@query(
    _BASE.rstrip() + ",\n" + _GROUPS + """, mb AS (SELECT factor, bin, avg(mean_forward) AS m FROM gp GROUP BY 1, 2),
rb2 AS (SELECT factor, rank() OVER (PARTITION BY factor ORDER BY bin) AS ra, rank() OVER (PARTITION BY factor ORDER BY m) + (count(*) OVER (PARTITION BY factor, m) - 1) / 2 AS rb FROM mb)
SELECT factor, round(corr(ra, rb), 6) + 0.0 AS monotonic FROM rb2 GROUP BY 1 HAVING count(*) >= 3"""
)
def factor_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the bins' mean forward returns rise with their numbers."""
    return _rounded(_diagnostics(spark, sf_dir)["spread"].select("factor", "monotonic"), "monotonic")


@query(_with(_RAW) + "SELECT u.fund_code, u.date, round(u.nav, 12) AS nav, round(a.acc_nav, 12) AS acc_nav, round(u.daily_return, 12) + 0.0 AS daily_return FROM nav u LEFT JOIN nav a ON a.fund_code = u.fund_code AND a.date = u.date AND a.acc_nav IS NOT NULL")
def merged_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit NAV and accumulated NAV as two feeds, joined."""
    nav = materialised(adapters.nav(spark, sf_dir))
    out = sources.merge_nav_feeds(nav.drop("acc_nav"), nav.where("acc_nav is not null").select("fund_code", "date", "acc_nav"))
    return _rounded(out, "nav", "acc_nav", "daily_return", places=12)


_SNAPSHOT = ("total_return", "annual_volatility", "max_drawdown")


@query(
    _with(_RAW, _metrics("SELECT fund_code, date, nav / lag(nav) OVER (PARTITION BY fund_code ORDER BY date) - 1 AS ret FROM nav", "fund_code"))
    + 'SELECT fund_code, start, "end", observations, ' + ", ".join(f"round({c} + 1e-12, 6) AS {c}" for c in _SNAPSHOT) + " FROM me"
)
def return_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fund's own NAV has earned."""
    out = backtest.return_snapshot(adapters.nav(spark, sf_dir)).select("fund_code", "start", "end", "observations", *((F.col(c) + 1e-12).alias(c) for c in _SNAPSHOT))
    return _rounded(out, *_SNAPSHOT)


@query(_with(_RAW) + "SELECT fund_code, avg((acc_nav IS NOT NULL OR daily_return IS NOT NULL)::INTEGER) >= 0.95 AS has_metadata FROM nav GROUP BY 1 UNION ALL SELECT 'all', avg((acc_nav IS NOT NULL OR daily_return IS NOT NULL)::INTEGER) >= 0.95 FROM nav")
def return_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether returns can be had of provider or accumulated data: for each fund, and for all together."""
    nav = materialised(adapters.nav(spark, sf_dir))
    return quality.has_return_metadata(nav, keys=("fund_code",)).unionByName(quality.has_return_metadata(nav).select(F.lit("all").alias("fund_code"), "has_metadata"))


@query("""WITH a AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS fund_code, 0 AS source, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS nth FROM supplier UNION ALL
SELECT lpad(p_partkey::VARCHAR, 6, '0'), 1, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) FROM part),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY fund_code ORDER BY source) = 1)
SELECT fund_code, source, (row_number() OVER (ORDER BY source, nth) - 1)::INTEGER AS pos FROM f QUALIFY pos < 1200""")
def universe_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by balance, filled up with parts by price to 1,200 codes."""
    source = lambda name, key, by: adapters.table(spark, sf_dir, name).select(F.lpad(F.col(key).cast("string"), 6, "0").alias("code"), F.struct((-F.col(by)).alias("by"), F.col(key).alias("key")).alias(sources.POSITION))
    return sources.load_universe([source("supplier", "s_suppkey", "s_acctbal"), source("part", "p_partkey", "p_retailprice")], 1200)


@query(_UNIVERSE + """SELECT r.fund_code, CASE WHEN pick <= 40 AND p_size % 3 <> 0 THEN 'new ' || p_name ELSE fund_name END AS fund_name, CASE WHEN pick <= 40 THEN 'house ' || p_brand ELSE p_brand END AS fund_company,
  CASE WHEN pick <= 40 THEN (2000 + p_size % 10) || '-01-01' ELSE (1990 + p_size % 12) || '-06-30' END AS inception_date FROM r4 r JOIN part ON r.fund_code = lpad(p_partkey::VARCHAR, 6, '0')""")
def catalog_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed facts, one of three with a blank name, override what the catalogue says of sampled funds."""
    code, name = F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.lit("new "), "p_name"))
    facts = (("基金名称", name), ("基金公司", F.concat(F.lit("house "), "p_brand")), ("成立时间", F.concat((2000 + F.col("p_size") % 10).cast("string"), F.lit("-01-01"))))
    info = adapters.table(spark, sf_dir, "part").select(code, F.inline(F.array(*(F.struct(F.lit(i).alias("item"), v.alias("value")) for i, v in facts))))
    rows = universes.share_dedupe(universes.normalize_catalog(adapters.catalog(spark, sf_dir)), type_reason(F.col("fund_type"), F.col("fund_name"), ("ECONOMY", "STANDARD"), ("RING",), "NONE"))
    return universes.enrich_catalog(universes.stable_sample(rows, 42, 40), info).select("fund_code", "fund_name", "fund_company", "inception_date")


@query(_UNIVERSE + """SELECT fund_code, r5 AS exclude_reason, CASE WHEN r5 = '' THEN 'candidate' ELSE 'excluded' END AS status, '' AS metadata_warning, '2001-12-31' AS metadata_as_of,
  NULL::DATE AS data_start, NULL::BIGINT AS nav_days, NULL::DOUBLE AS data_coverage FROM r5""")
def universe_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit before NAV is looked at."""
    catalog = universes.normalize_catalog(adapters.catalog(spark, sf_dir))
    audit = universes.build_universe(catalog, None, "1998-01-01", "2001-12-31", 5, 40, 42, None, ("ECONOMY", "STANDARD"), ("RING",), "NONE", stage="prepare", warn=True, as_of="2001-12-31")[0]
    return audit.select("fund_code", "exclude_reason", "status", "metadata_warning", "metadata_as_of", "data_start", "nav_days", "data_coverage")


@query("""SELECT lpad(user_id::VARCHAR, 6, '0') AS fund_code, ts::DATE AS date, round(arg_max(value, ts), 6) AS nav FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def stream_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arriving NAV, streamed into a store: the last of a day counts."""
    folder = shared_folder(spark)
    stream_upsert_nav(adapters.nav_events(spark, sf_dir), f"{folder}/store", f"{folder}/mark").awaitTermination()
    return _rounded(current(spark, f"{folder}/store").select("fund_code", "date", "nav"), "nav")


@query("""SELECT date, round(avg(value), 6) AS bench_ret, count(*) AS funds FROM (SELECT ts::DATE AS date, value FROM events WHERE ts IS NOT NULL) GROUP BY 1
HAVING date + 1 <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each day's events as a stream: days that the watermark has closed."""
    events = adapters.nav_events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("nav").alias("ret"))
    return _rounded(run_to_table(stream_benchmark(events), shared_folder(spark)), "bench_ret")
