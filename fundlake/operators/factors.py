"""Trailing-window factors of every fund at every rebalance date."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlake.sources.tables import materialised, ship_package

TRADING_DAYS = 252
FACTORS = ("ann_return", "ann_vol", "down_vol", "mdd", "sharpe", "ir")
_OLD = {"annual_return": "ann_return", "annual_vol": "ann_vol", "downside_vol": "down_vol", "max_drawdown": "mdd", "information_ratio": "ir"}


def numbered(returns: DataFrame) -> DataFrame:
    """``returns`` with rn, each fund's own rows from 1."""
    return returns.withColumn("rn", F.row_number().over(Window.partitionBy("fund_code").orderBy("date")))


def positions(rows: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(as_of, fund_code, end_rn): the number of each fund's rows up to each rebalance date, from its first row on.

    Each date belongs to the first rebalance on or after it; a fund's last number in a period holds for the periods after it
    until its next rows. No fund meets a date that it doesn't need.
    """
    k = F.row_number().over(Window.orderBy("as_of"))
    numbers = rebalances.select("as_of").distinct().withColumn("k", k).withColumn("after", F.coalesce(F.lag("as_of").over(Window.orderBy("as_of")), F.lit("0001-01-01").cast("date")))
    tag = rows.select("date").distinct().join(F.broadcast(numbers), (F.col("date") > F.col("after")) & (F.col("date") <= F.col("as_of"))).select("date", "k")
    last = numbers.agg(F.max("k")).scalar()
    ends = rows.join(F.broadcast(tag), "date").groupBy("fund_code", "k").agg(F.max("rn").alias("end_rn"))
    until = F.coalesce(F.lead("k").over(Window.partitionBy("fund_code").orderBy("k")) - 1, last)
    spread = ends.withColumn("until", until).select("fund_code", "end_rn", F.explode(F.sequence("k", "until")).alias("k"))
    return spread.join(F.broadcast(numbers.select("k", "as_of")), "k").select("as_of", "fund_code", "end_rn")


def trailing(rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Rows of ``rows`` (fund_code, rn, ...) in each window (fund_code, lo, hi], of ``width`` rows at most.

    Rows fall into buckets of ``width``; a window touches two at most, so this is an equi-join on (fund, bucket)."""
    first, last = F.floor(F.greatest(F.col("lo"), F.lit(0)) / width), F.floor((F.col("hi") - 1) / width)
    touched = windows.withColumn("bucket", F.explode(F.sequence(first, last)))
    return rows.withColumn("bucket", F.floor((F.col("rn") - 1) / width)).join(touched, ["fund_code", "bucket"]).where((F.col("rn") > F.col("lo")) & (F.col("rn") <= F.col("hi"))).drop("bucket")


class _Moments:
    """Counts, means, sums of squared distances, lowest and highest values of the segments of one series.

    ``x`` has a bucket for each row and nan where there is no value. Sums are taken of distances from a value that is always one
    of those summed, the bucket's first for its beginnings and its last for its ends: nothing large is ever subtracted, and
    nothing after a row bears on it.
    """

    def __init__(self, x: np.ndarray) -> None:
        there = ~np.isnan(x)
        filled = np.where(there, x, 0.0)
        self.centres = filled[:, 0], filled[:, -1]
        self.sums = []
        for centre, turn in zip(self.centres, (slice(None), slice(None, None, -1)), strict=True):
            y = np.where(there, filled - centre[:, None], 0.0)
            self.sums.append([np.cumsum(p[:, turn], 1)[:, turn] for p in (there.astype(float), y, y * y)])
        low, high = np.where(there, filled, np.inf), np.where(there, filled, -np.inf)
        self.low = (np.minimum.accumulate(low, 1), np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1])
        self.high = (np.maximum.accumulate(high, 1), np.maximum.accumulate(high[:, ::-1], 1)[:, ::-1])

    def of(self, late: tuple[np.ndarray, np.ndarray], early: tuple[np.ndarray, np.ndarray], both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, deviation) of windows: the beginnings of buckets at ``late`` and, where ``both``, the ends at ``early``. Values that
        are all alike have a deviation of exactly 0; no value gives nan."""
        n, s, q = (x[late] for x in self.sums[0])
        m, t, r = (np.where(both, x[early], 0.0) for x in self.sums[1])
        mean_late, mean_early = self.centres[0][late[0]] + s / np.maximum(n, 1), self.centres[1][early[0]] + t / np.maximum(m, 1)
        total = np.where(n + m > 0, n + m, np.nan)
        apart = np.where((n > 0) & (m > 0), (mean_late - mean_early) ** 2 * n * m / total, 0.0)
        squares = (q - s * s / np.maximum(n, 1)) + (r - t * t / np.maximum(m, 1)) + apart
        lowest = np.minimum(self.low[0][late], np.where(both, self.low[1][early], np.inf))
        highest = np.maximum(self.high[0][late], np.where(both, self.high[1][early], -np.inf))
        return (n * mean_late + m * mean_early) / total, np.where(lowest == highest, 0.0, np.sqrt(np.maximum(squares, 0.0) / total))


def merged_drawdowns(growth: np.ndarray, late: tuple[np.ndarray, np.ndarray], early: tuple[np.ndarray, np.ndarray], both: np.ndarray) -> np.ndarray:
    """The deepest drawdown of windows of two segments: within either, or from the first's peak to the second's lowest.

    ``growth``: 1 + ret by buckets, all positive. Rounded to twelve places, so that it doesn't show where segments meet.
    """
    w = np.cumprod(growth, 1)
    deep = np.minimum.accumulate(w / np.maximum.accumulate(w, 1), 1)
    high = np.maximum.accumulate(w[:, ::-1], 1)[:, ::-1]
    low = np.minimum.accumulate(w[:, ::-1], 1)[:, ::-1]
    rest = np.minimum.accumulate((low / w)[:, ::-1], 1)[:, ::-1]
    # the end of a bucket from a row on, over the product before the row: what is common to product and peak falls out
    across = w[early[0], -1] * np.minimum.accumulate(w, 1)[late] / high[early]
    return np.round(np.minimum(deep[late], np.where(both, np.minimum(rest[early], across), np.inf)) - 1, 12)


def drawdowns_in_order(growth: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """The deepest drawdown of the last ``window`` values up to each of ``ends``, by products taken in order; nan where no product
    before is positive."""
    out = np.empty(len(ends))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.cumprod(growth[:window])  # windows that begin with the series
        deep = np.fmin.accumulate(w / _peak(w))
        out[ends < window] = deep[ends[ends < window]]
        for lo in range(0, len(ends), step := max(1, 2_000_000 // window)):
            some = np.flatnonzero(ends[lo : lo + step] >= window) + lo
            w = np.cumprod(growth[ends[some][:, None] + np.arange(1 - window, 1)], 1)
            out[some] = np.fmin.reduce(w / _peak(w), 1)
    return out - 1


def _peak(w: np.ndarray) -> np.ndarray:
    top = np.maximum.accumulate(w, -1)
    return np.where(top == 0, np.nan, top)


def fund_factors(ret: np.ndarray, excess: np.ndarray, ends: np.ndarray, window: int, in_order: bool) -> list[np.ndarray]:
    """FACTORS of one fund over its last ``window`` rows up to each of ``ends``, places from 0.

    Rows fall into buckets of ``window``: any window is the end of one bucket and the beginning of the next, or one bucket's
    beginning alone. Sums, peaks and lows from both ends of the buckets so give every window, whatever their number.
    """
    n = -(-len(ret) // window)
    folded = lambda x, fill: np.concatenate([x, np.full(n * window - len(x), fill)]).reshape(n, window)
    late = np.divmod(ends, window)
    both = (ends >= window) & ((ends + 1) % window != 0)
    early = np.divmod(np.maximum(ends - window + 1, 0), window)
    at = (late, early, both)
    (mean, sd), (_, loss), (more, spread) = (_Moments(folded(x, np.nan)).of(*at) for x in (ret, np.where(ret < 0, ret, np.nan), excess))
    ruined = in_order or bool((ret <= -1).any())  # products don't merge then
    mdd = drawdowns_in_order(1 + ret, ends, window) if ruined else merged_drawdowns(folded(1 + ret, 1.0), *at)
    year = math.sqrt(TRADING_DAYS)
    ratio = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1.0), np.nan) * year
    return [mean * TRADING_DAYS, sd * year, loss * year, mdd, ratio(mean, sd), ratio(more, spread)]


def _by_fund(group: pa.Table, window: int, required: int, last: int, in_order: bool) -> pa.Table:
    """(fund_code, k, FACTORS) of one fund's (fund_code, date, ret, bench_ret, k); its history is bounded by its days."""
    group = group.take(pc.sort_indices(group, [("date", "ascending")]))
    number = lambda c: group[c].to_numpy(zero_copy_only=False).astype(float)
    ret, k = number("ret"), number("k")
    # a row ends the periods from its own to the one before the next row's; rows after the last rebalance end none
    k = np.where(np.isnan(k), last + 1, k).astype(np.int64)
    until = np.append(k[1:], last + 1) - 1
    ends = np.flatnonzero((until >= k) & (np.arange(len(k)) + 1 >= required))
    values = fund_factors(ret, ret - number("bench_ret"), ends, window, in_order)
    times = until[ends] - k[ends] + 1
    at = np.repeat(np.arange(len(ends)), times)
    periods = k[ends][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    columns = [group["fund_code"].take(pa.array(np.zeros(len(at), np.int64))), pa.array(periods), *(pa.array(v[at], mask=np.isnan(v[at])) for v in values)]
    return pa.table(columns, names=["fund_code", "k", *FACTORS])


def compute_factors(returns: DataFrame, benchmark: DataFrame, rebalances: DataFrame, window: int = 126, min_observations: int | None = None, in_order: bool = False) -> DataFrame:
    """(as_of, fund_code) and FACTORS over each fund's last ``window`` rows up to as_of; funds with fewer than the required rows
    are left out, those that stopped reporting are not. A ratio over a zero deviation is null.

    One shuffle, by fund; no row is copied to the windows that hold it. Drawdowns are merged of two segments; with ``in_order``,
    and for funds that once lost all, they are those of products from each window's first row on, which differ in the last bits.
    """
    required = window if min_observations is None else min_observations
    if not 2 <= required <= window:
        raise ValueError("2 <= min_observations <= window is required")
    ship_package(returns.sparkSession)
    # dates and rebalances: some thousand rows; each date belongs to the first rebalance on or after it
    place = Window.orderBy("as_of")
    numbers = materialised(rebalances.select("as_of").distinct().withColumn("k", F.row_number().over(place)).withColumn("after", F.coalesce(F.lag("as_of").over(place), F.lit("0001-01-01").cast("date"))))
    last = numbers.count()
    dates = returns.select("date").distinct().join(benchmark, "date", "left")
    dates = dates.join(F.broadcast(numbers), (F.col("date") > F.col("after")) & (F.col("date") <= F.col("as_of")), "left").select("date", "bench_ret", "k")
    rows = returns.select("fund_code", "date", "ret").join(F.broadcast(dates), "date")
    one = lambda group: _by_fund(group, window, required, last, in_order)
    kind = "fund_code string, k long, " + ", ".join(f"{f} double" for f in FACTORS)
    out = rows.groupBy("fund_code").applyInArrow(one, kind)
    return out.join(F.broadcast(numbers.select("k", "as_of")), "k").select("as_of", "fund_code", *FACTORS)


def rename_factor_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in _OLD.items() if old in df.columns and new not in df.columns})


def long_factors(factors: DataFrame, names: tuple[str, ...] = FACTORS) -> DataFrame:
    """(as_of, fund_code, factor, x) of the names that are columns."""
    return factors.unpivot(["as_of", "fund_code"], [c for c in names if c in factors.columns], "factor", "x")


def latest(dates: DataFrame) -> DataFrame:
    return dates.agg(F.max("date").alias("as_of"))
