"""Data-quality and risk checks as rows (check, fund_code, value, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.functions.codes import norm_code
from fundlake.operators.factors import FACTORS


def _row(df: DataFrame, check: str, value: Column, message: Column | str, code: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(check).alias("check"), (code if code is not None else F.lit(None).cast("string")).alias("fund_code"), value.cast("double").alias("value"), text.alias("message"))


def check_nav(nav: DataFrame, universe: DataFrame, as_of: str, returns: DataFrame | None = None, stale_days: int = 7) -> DataFrame:
    """Warnings on missing funds, stale funds, a stale pool, little metadata and extreme returns; empty NAV gives one row."""
    rows = nav.withColumn("fund_code", norm_code(F.col("fund_code"))).withColumn("date", F.col("date").cast("date"))
    present = rows.groupBy("fund_code").agg(F.max("date").alias("latest"))
    pool = present.agg(F.max("latest").alias("pool"))
    some = pool.where("pool is not null")
    wanted = universe.select(norm_code(F.col("fund_code")).alias("fund_code")).where("fund_code <> ''").distinct()
    filled = F.coalesce(pool.scalar(), F.lit(None).cast("date")).isNotNull()
    empty = _row(nav.agg(F.count("*").alias("n")).where("n = 0"), "empty", F.lit(0), "NAV data is empty")
    missing = _row(wanted.join(present, "fund_code", "left_anti").where(filled), "missing_fund", F.lit(1), "fund has no NAV", F.col("fund_code"))
    lag = F.date_diff(pool.scalar(), F.col("latest"))
    stale = _row(present.where(lag > stale_days), "stale_fund", lag, "fund is behind the pool", F.col("fund_code"))
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("pool"))
    old = _row(some.where(age > stale_days), "stale_pool", age, "latest NAV of the pool is old")
    meta = [c for c in ("daily_return", "acc_nav") if c in nav.columns]
    out = empty.unionByName(missing).unionByName(stale).unionByName(old)
    if meta:
        cover = rows.agg(F.avg(F.coalesce(*(F.col(c).cast("double") for c in meta)).isNotNull().cast("double")).alias("c")).where("c < 0.95")
        out = out.unionByName(_row(cover, "metadata", F.col("c"), "few rows have total-return data"))
    else:
        out = out.unionByName(_row(some, "metadata", F.lit(0), "total-return data is unavailable"))
    if returns is not None:
        extreme = returns.agg(F.count_if(F.abs("ret") > 0.5).alias("n")).where("n > 0")
        out = out.unionByName(_row(extreme, "extreme_returns", F.col("n"), "daily returns above 50 %"))
    return out


def has_return_metadata(nav: DataFrame, codes: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, has_metadata): true if 95 % of the rows, of ``codes`` if they are given, have a daily return or accumulated NAV; one
    row without keys, false if there are no rows."""
    rows = nav if codes is None else nav.join(codes.select("fund_code").distinct(), "fund_code", "left_semi")
    covered = F.avg((F.col("daily_return").isNotNull() | F.col("acc_nav").isNotNull()).cast("double"))
    return rows.groupBy(*keys).agg((F.coalesce(covered, F.lit(0.0)) >= 0.95).alias("has_metadata"))


def check_scores(scores: DataFrame, expected: int, top: int, factors: bool = False) -> DataFrame:
    """(as_of, check, value) for each date whose scores are few or hardly differ; one row without a date if there are no scores,
    and with ``factors`` one if no factor's column is there, by its own name or as z_<name>, with a value in it."""
    s = scores.groupBy("as_of").agg(F.count_distinct("score").alias("kinds"), F.count("*").alias("n"))
    tests = (("few_values", F.col("kinds"), F.col("kinds") <= 3), ("few_funds", F.col("n"), F.col("n") < max(1, int(0.8 * expected))), ("below_top_n", F.col("n"), F.col("n") < top))
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(c).alias("check"), v.alias("value"))) for c, v, bad in tests)), lambda x: x.isNotNull())
    out = s.select("as_of", F.explode(found).alias("x")).select("as_of", "x.check", "x.value")
    none = lambda df, check: df.select(F.lit(None).cast(scores.schema["as_of"].dataType).alias("as_of"), F.lit(check).alias("check"), F.lit(0).cast("long").alias("value"))
    total = scores.agg(F.count("*").alias("n"))
    out = out.unionByName(none(total.where("n = 0"), "empty"))
    if not factors:
        return out
    named = [c for f in FACTORS for c in (f, f"z_{f}") if c in scores.columns]
    known = F.max(F.coalesce(*named).isNotNull()) if named else F.lit(False)
    return out.unionByName(none(scores.agg(F.count("*").alias("n"), known.alias("known")).where("not coalesce(known, false)"), "no_factors"))
