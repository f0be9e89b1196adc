"""Top-N portfolios and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.operators.factors import numbered, positions, trailing

WEIGHTS = ("weight_equal", "weight_risk_parity", "weight_mixed")


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """The n highest scores of each date; null scores only fill up."""
    return scores.where(F.col("rank") <= n)


def inverse_volatility(held: DataFrame, returns: DataFrame, lookback_max: int = 252, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """(keys, fund_code, weight_risk_parity) of ``held`` (keys with as_of, fund_code), a portfolio for each key.

    Over each fund's last L rows: L is the median length of the held funds' histories, 20 at least and ``lookback_max`` at most.
    A fund without rows weighs 0; if none has any, all weigh the same.
    """
    held = held.select(*keys, "fund_code").distinct()
    rows = numbered(returns).select("fund_code", "date", "rn", "ret")
    place = held.join(positions(rows, held.select("as_of").distinct()), ["as_of", "fund_code"])
    span = place.groupBy(*keys).agg(F.least(F.lit(lookback_max), F.greatest(F.lit(20), F.floor(F.median("end_rn")))).cast("int").alias("span"))
    windows = place.join(span, list(keys)).select(*keys, "fund_code", (F.col("end_rn") - F.col("span")).alias("lo"), F.col("end_rn").alias("hi"))
    sd = trailing(rows, windows, lookback_max).groupBy(*keys, "fund_code").agg(F.stddev_pop("ret").alias("sd"))
    out = held.join(sd, [*keys, "fund_code"], "left").withColumn("i", F.coalesce(1 / (F.col("sd") + 1e-8), F.lit(0.0)))
    over = Window.partitionBy(*keys)
    total = F.sum("i").over(over)
    return out.select(*keys, "fund_code", F.when(total > 0, F.col("i") / total).otherwise(1 / F.count("*").over(over)).alias("weight_risk_parity"))


def equal_weights(scores: DataFrame, n: int) -> DataFrame:
    """(scheme, as_of, fund_code, score, rank, weight_equal) of the top n."""
    top = top_n(scores, n).select("scheme", "as_of", "fund_code", "score", "rank")
    return top.withColumn("weight_equal", 1 / F.count("*").over(Window.partitionBy("scheme", "as_of")))


def build_portfolio(scores: DataFrame, returns: DataFrame, n: int, lookback_max: int = 252) -> DataFrame:
    """(scheme, as_of, fund_code, score, rank) of the top n with equal, inverse-volatility and mixed weights."""
    keys = ("scheme", "as_of")
    top = equal_weights(scores, n)
    out = top.join(inverse_volatility(top, returns, lookback_max, keys), [*keys, "fund_code"])
    return out.withColumn("weight_mixed", (F.col("weight_equal") + F.col("weight_risk_parity")) / 2)


def normalised(weight: Column, over) -> Column:  # noqa: ANN001
    """Weights over the sum of their absolute values; a sum of zero leaves zeros."""
    return F.coalesce(F.try_divide(weight, F.sum(F.abs(weight)).over(over)), F.lit(0.0))


def cap_weights(weights: DataFrame, cap: float | str, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """``weights`` (keys, fund_code, weight) clipped at 0, summing to 1 with none above ``cap``, a number or the name of a column
    that has one for each of the keys; a cap of 1 or more changes nothing.

    In closed form: by falling weight, the first k are capped, k the smallest for which the next weight, with what the capped
    ones leave shared among the rest in proportion, stays within the cap. If no positive weight is left to take the excess, the
    final scaling exceeds the cap. Too few funds for the cap are an error.
    """
    if not isinstance(cap, str) and cap >= 1:
        return weights
    over = Window.partitionBy(*keys)
    by = over.orderBy(F.col("w").desc(), "fund_code")
    most = F.col("_cap")
    rows = weights.withColumn("_cap", F.col(cap) if isinstance(cap, str) else F.lit(float(cap))).withColumn("w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(over)), F.lit(0.0)))
    rows = rows.withColumn("i", F.row_number().over(by)).withColumn("rest", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("n", F.count("*").over(over))
    rows = rows.withColumn("w", F.when(F.col("n") * most < 1 - 1e-12, F.raise_error(F.lit("the cap is too low for the number of funds"))).otherwise(F.col("w")))
    share = lambda w, k, rest: F.coalesce(F.try_divide(w * (1 - k * most), rest), F.lit(0.0))
    fits = share(F.col("w"), F.col("i") - 1, F.col("rest")) <= most + 1e-15
    rows = rows.withColumn("k", F.coalesce(F.min(F.when(fits, F.col("i") - 1)).over(over), F.col("n")))
    left = F.max(F.when(F.col("i") == F.col("k") + 1, F.col("rest"))).over(over)
    rows = rows.withColumn("capped", F.when(F.col("i") <= F.col("k"), most).otherwise(share(F.col("w"), F.col("k"), left)))
    return rows.select(*keys, "fund_code", F.when(most >= 1, F.col("weight")).otherwise(normalised(F.col("capped"), over)).alias("weight"))


def target_weights(portfolio: DataFrame, scheme: str = "weight_equal", max_weight: float = 1.0, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """(keys, fund_code, weight): one of WEIGHTS over the sum of absolute values, capped if ``max_weight`` is below 1."""
    if scheme not in WEIGHTS:
        raise ValueError(f"no such weights: {scheme}")
    out = portfolio.select(*keys, "fund_code", normalised(F.col(scheme), Window.partitionBy(*keys)).alias("weight"))
    return cap_weights(out, max_weight, keys) if max_weight < 1 else out
