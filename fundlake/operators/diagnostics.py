"""Factor diagnostics: rank correlation, quantile groups and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.operators.factors import FACTORS, long_factors
from fundlake.operators.ranks import HELD, row_numbers
from fundlake.sources.tables import materialised


def average_rank(x: str, *keys: str) -> Column:
    """Rank by ``x`` within the keys, ties at their mean."""
    over = Window.partitionBy(*keys)
    return F.rank().over(over.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def rank_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correlation, n) of ``pairs`` (keys, a, b) by Spearman; groups of fewer than three or with a constant side go."""
    ranked = pairs.where("a is not null and b is not null").withColumn("ra", average_rank("a", *keys)).withColumn("rb", average_rank("b", *keys))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ra").alias("ma"), F.avg("rb").alias("mb"), F.avg(F.col("ra") * F.col("rb")).alias("ab"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"), (F.min("ra") < F.max("ra")).alias("va"), (F.min("rb") < F.max("rb")).alias("vb"))
    return sums.where("n >= 3 and va and vb").select(*keys, ((F.col("ab") - F.col("ma") * F.col("mb")) / (F.col("sa") * F.col("sb"))).alias("correlation"), "n")


def factor_correlation(factors: DataFrame) -> DataFrame:
    """(as_of, factor_a, factor_b, correlation, n) of all pairs in the order of FACTORS; values alike to ten places are ties.

    Each factor is ranked once for each date, ties at their mean, less the mean rank; then one aggregation sums the products of
    all pairs. Pairs of which a fund has one value and not the other are ranked anew among the funds that have both.
    """
    names = [f for f in FACTORS if f in factors.columns]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    if not pairs:
        raise ValueError("a correlation takes two factors")
    wide = factors.select("as_of", "fund_code", *((F.round(f, 10) + F.lit(0.0)).alias(f) for f in names))
    date = Window.partitionBy("as_of")

    def centred(f: str) -> Column:
        by = date.orderBy(F.col(f).asc_nulls_last())
        ties = F.count("*").over(by.rangeBetween(Window.currentRow, Window.currentRow))
        return F.when(F.col(f).isNotNull(), F.rank().over(by) + (ties - 1) / 2 - (F.count(f).over(date) + 1) / 2).alias(f)

    ranks = wide.select("as_of", *map(centred, names))
    sums = ranks.groupBy("as_of").agg(
        *(F.struct(F.count(f).alias("n"), F.coalesce(F.sum(F.col(f) * F.col(f)), F.lit(0.0)).alias("s")).alias(f) for f in names),
        *(F.struct(F.count(F.col(a) * F.col(b)).alias("n"), F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias("s")).alias(f"{a}*{b}") for a, b in pairs),
    )
    entry = lambda a, b: F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a)["n"].alias("na"), F.col(b)["n"].alias("nb"), F.col(f"`{a}*{b}`")["n"].alias("n"), F.col(a)["s"].alias("saa"), F.col(b)["s"].alias("sbb"), F.col(f"`{a}*{b}`")["s"].alias("sab"))
    gram = materialised(sums.select("as_of", F.inline(F.array(*(entry(a, b) for a, b in pairs)))))  # a row for each date and pair
    whole = (F.col("na") == F.col("n")) & (F.col("nb") == F.col("n"))
    usual = gram.where(whole & (F.col("n") >= 3) & (F.col("saa") > 0) & (F.col("sbb") > 0))
    usual = usual.select("as_of", "factor_a", "factor_b", (F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb"))).alias("correlation"), "n")
    apart = wide.join(F.broadcast(gram.where(~whole).select("as_of", "factor_a", "factor_b")), "as_of")
    value = lambda c: F.coalesce(*(F.when(F.col(c) == f, F.col(f)) for f in names))
    ranked = rank_correlation(apart.select("as_of", "factor_a", "factor_b", value("factor_a").alias("a"), value("factor_b").alias("b")), ["as_of", "factor_a", "factor_b"])
    return usual.unionByName(ranked)


def correlation_summary(correlations: DataFrame) -> DataFrame:
    c = F.col("correlation")
    return correlations.groupBy("factor_a", "factor_b").agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.count("*").alias("count")).orderBy(F.desc("mean"))


def bin_edges(n: Column, groups: int) -> Column:
    """The inner edges of ``groups`` quantile bins of the ranks 1..n, in the double arithmetic that decides where an edge falls
    on a whole rank."""

    def edge(j: Column) -> Column:
        v = (n - 1) * (j * F.lit(1 / groups) * 100 / 100)
        lo = F.floor(v).cast("double")
        t = v - lo
        return F.when(t < 0.5, (1 + lo) + t).otherwise((2 + lo) - (1 - t))

    return F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), edge)


def factor_groups(signals: DataFrame, forward: DataFrame, groups: int = 5, held: int = HELD) -> DataFrame:
    """(as_of, factor, bin, mean_forward, funds) of ``signals`` (as_of, fund_code, factor, x, sign).

    Only dates with forward returns; a factor needs 2 * groups rows and as many distinct values as groups there. Ranks go by
    x times sign, ties by code; bins are cut at the ranks' quantiles. Cross-sections of more than ``held`` funds are ranked by
    ranges instead of by one task each.
    """
    keys = ["as_of", "factor"]
    rows = signals.withColumn("s", F.col("x") * F.col("sign")).where("s is not null").join(forward, ["as_of", "fund_code"]).where("forward_ret is not null")
    rows = materialised(rows.select(*keys, "fund_code", "s", "forward_ret"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("s").alias("kinds")).where((F.col("n") >= 2 * groups) & (F.col("kinds") >= groups))
    sizes = sizes.withColumn("edges", bin_edges(F.col("n"), groups))  # a row for each date and factor
    rows = row_numbers(rows, keys, ["s", "fund_code"], "i", held).join(F.broadcast(sizes), keys)
    rows = rows.withColumn("bin", 1 + F.size(F.filter("edges", lambda e: F.col("i") > e)))
    return rows.groupBy(*keys, "bin").agg(F.avg("forward_ret").alias("mean_forward"), F.count("*").alias("funds"))


def signals(factors: DataFrame, scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(as_of, fund_code, factor, x, sign) of each weighted factor and the score."""
    sign = F.lit(1.0)
    for f, w in weights.items():
        sign = F.when(F.col("factor") == f, F.lit(1.0 if w >= 0 else -1.0)).otherwise(sign)
    long = long_factors(factors, tuple(weights)).unionByName(scores.select("as_of", "fund_code", F.lit("score").alias("factor"), F.col("score").alias("x")))
    return long.withColumn("sign", sign)


def group_summary(groups: DataFrame) -> DataFrame:
    m = F.col("mean_forward")
    return groups.groupBy("factor", "bin").agg(F.count("*").alias("periods"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.avg((m > 0).cast("double")).alias("positive_rate"), (F.product(1 + m) - 1).alias("compounded"))


def factor_spread(groups: DataFrame, n: int = 5) -> DataFrame:
    """(factor, periods, mean_spread, win_rate, monotonic): top less bottom bin at dates with all bins; monotonic: the rank
    correlation of the bins' numbers and mean returns."""
    wide = groups.groupBy("as_of", "factor").agg(F.count("*").alias("bins"), F.max(F.when(F.col("bin") == n, F.col("mean_forward"))).alias("top"), F.max(F.when(F.col("bin") == 1, F.col("mean_forward"))).alias("low")).where(F.col("bins") == n)
    spread = wide.withColumn("d", F.col("top") - F.col("low")).groupBy("factor").agg(F.count("*").alias("periods"), F.avg("d").alias("mean_spread"), F.avg((F.col("d") > 0).cast("double")).alias("win_rate"))
    means = groups.groupBy("factor", "bin").agg(F.avg("mean_forward").alias("b")).select("factor", F.col("bin").cast("double").alias("a"), "b")
    mono = rank_correlation(means, ["factor"]).select("factor", F.col("correlation").alias("monotonic"))
    return spread.join(mono, "factor", "left").orderBy(F.desc("mean_spread"))
