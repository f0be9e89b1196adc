"""Returns, benchmark and calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNITS = {"month": "month", "quarter": "quarter", "week": "week"}


def to_returns(nav: DataFrame, fill: str = "pad", provider: float = 0.80, accumulated: float = 0.95) -> DataFrame:
    """(fund_code, date, ret) by one source for each whole fund: the provider's returns if enough rows after the first have
    them, else changes of accumulated NAV if enough rows have it, else of unit NAV. With fill="pad" a missing value is carried
    forward before the change is taken. Rows without a return are dropped; a change from zero has none."""
    fund, by = Window.partitionBy("fund_code"), Window.partitionBy("fund_code").orderBy("date")
    rows = nav.withColumn("rn", F.row_number().over(by)).withColumn("n", F.count("*").over(fund))
    given = F.sum(((F.col("rn") > 1) & F.col("daily_return").isNotNull()).cast("int")).over(fund)
    share = F.when(F.col("n") > 1, given / (F.col("n") - 1)).otherwise(0.0)
    acc = F.count("acc_nav").over(fund) / F.col("n")
    rows = rows.select("fund_code", "date", "daily_return", (share >= provider).alias("own"), F.when(acc >= accumulated, F.col("acc_nav")).otherwise(F.col("nav")).alias("src"))
    src = F.last("src", ignorenulls=True).over(by) if fill == "pad" else F.col("src")
    rows = rows.withColumn("src", src)
    change = F.try_divide(F.col("src"), F.lag("src").over(by)) - 1
    return rows.select("fund_code", "date", F.when(F.col("own"), F.col("daily_return")).otherwise(change).alias("ret")).where("ret is not null")


def calendar_returns(nav: DataFrame) -> DataFrame:
    """Changes from the calendar date before (of all dates with a NAV); null if the fund has no NAV there; nothing is filled."""
    rows = nav.where("nav is not null")
    dates = date_index(rows)
    by = Window.partitionBy("fund_code").orderBy("idx")
    rows = rows.join(F.broadcast(dates), "date")  # one row for each trading date
    change = F.try_divide(F.col("nav"), F.lag("nav").over(by)) - 1
    return rows.select("fund_code", "date", F.when(F.lag("idx").over(by) == F.col("idx") - 1, change).alias("ret"))


def date_index(df: DataFrame) -> DataFrame:
    """(date, idx): the distinct dates numbered from 1. A calendar has some thousand rows, so one task orders them."""
    return df.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def equal_weight_benchmark(returns: DataFrame) -> DataFrame:
    """(date, bench_ret): the mean return of the funds present that day."""
    return returns.groupBy("date").agg(F.avg("ret").alias("bench_ret"))


def period_start(date: Column, freq: str) -> Column:
    if freq not in _UNITS:
        raise ValueError(f"no such frequency: {freq}")
    return F.trunc(date, _UNITS[freq])


def rebalance_dates(dates: DataFrame, freq: str = "month", window: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(as_of): the last date of each period within [start, end], the last one's part included; with ``window``, only from the
    window-th date on, and fewer dates than that are an error."""
    if window is not None and window < 2:
        raise ValueError("a window has two dates at least")
    rows = dates.select("date").distinct()
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    out = rows.groupBy(period_start(F.col("date"), freq).alias("period")).agg(F.max("date").alias("as_of")).select("as_of")
    if window is not None:
        first = date_index(rows).where(F.col("idx") == window).agg(F.max("date")).scalar()
        few = F.raise_error(F.lit(f"there are fewer than {window} dates")).cast("date")
        out = out.where(F.col("as_of") >= F.coalesce(first, few))
    return out


def forward_returns(returns: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(as_of, fund_code, forward_ret): the compounded return from after one rebalance to the next, that included."""
    nxt = F.lead("as_of").over(Window.orderBy("as_of"))
    spans = rebalances.select("as_of").distinct().withColumn("until", nxt).where("until is not null")
    days = returns.select("date").distinct().join(F.broadcast(spans), (F.col("date") > F.col("as_of")) & (F.col("date") <= F.col("until"))).select("date", "as_of")
    return returns.join(F.broadcast(days), "date").groupBy("as_of", "fund_code").agg((F.product(1 + F.col("ret")) - 1).alias("forward_ret"))


def latest_nav_dates(nav: DataFrame) -> DataFrame:
    return nav.groupBy("fund_code").agg(F.max("date").alias("latest"))


def incremental_since(codes: DataFrame, nav: DataFrame, lookback: int = 5, fallback: str = "2022-01-01") -> DataFrame:
    """(fund_code, since): each fund's latest date less ``lookback`` days, or ``fallback``."""
    return codes.select("fund_code").distinct().join(latest_nav_dates(nav), "fund_code", "left").select("fund_code", F.coalesce(F.date_sub("latest", lookback), F.lit(fallback).cast("date")).alias("since"))
