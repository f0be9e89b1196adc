"""Cross-sectional standardisation and scores, for every date and scheme at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.operators.factors import FACTORS, long_factors
from fundlake.operators.quantiles import exact_quantiles, sorted_quantile
from fundlake.sources.tables import materialised

#: The named weightings (fixed values).
SCHEMES = {
    "baseline_corrected": {"ann_return": 0.35, "ann_vol": -0.15, "down_vol": -0.10, "mdd": 0.10, "sharpe": 0.35, "ir": 0.15},
    "return_ir": {"ann_return": 0.40, "ir": 0.60},
    "sharpe_ir": {"sharpe": 0.50, "ir": 0.50},
    "return_sharpe_ir": {"ann_return": 0.40, "sharpe": 0.30, "ir": 0.30},
}
DEFAULT = "baseline_corrected"


def scheme_table(spark: SparkSession, schemes: dict[str, dict[str, float]]) -> DataFrame:
    """(scheme, factor, weight); empty names or weights and weights that are all zero are errors."""
    for name, weights in schemes.items():
        if not name or not weights or not sum(abs(float(w)) for w in weights.values()) > 0:
            raise ValueError(f"bad scheme: {name!r}")
    rows = [F.struct(F.lit(s).alias("scheme"), F.lit(f).alias("factor"), F.lit(float(w)).alias("weight")) for s, ws in schemes.items() for f, w in ws.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


_GROUP = ["as_of", "factor"]
#: Values of a cross-section up to which one array may hold it: some MB.
HELD = 200_000


def _held_statistics(values: DataFrame, p: float) -> DataFrame:
    """cross_section() by one aggregation that gathers each cross-section in a sorted array."""
    s = values.groupBy(*_GROUP).agg(F.sort_array(F.collect_list("x")).alias("s")).withColumn("n", F.size("s").cast("long"))
    s = s.withColumn("differ", F.get("s", F.lit(0)) < F.element_at("s", -1))
    s = s.withColumn("lo", F.when(F.col("n") >= 5, sorted_quantile(F.col("s"), p))).withColumn("hi", F.when(F.col("n") >= 5, sorted_quantile(F.col("s"), 1 - p)))
    # clipping keeps the order
    s = s.withColumn("w", F.when(F.col("n") >= 5, F.transform("s", lambda x: F.least(F.greatest(x, F.col("lo")), F.col("hi")))).otherwise(F.col("s")))
    s = s.withColumn("med", sorted_quantile(F.col("w"), 0.5)).withColumn("mean", F.try_divide(F.aggregate("w", F.lit(0.0), lambda t, x: t + x), F.col("n")))
    s = s.withColumn("off", F.sort_array(F.transform("w", lambda x: F.abs(x - F.col("med"))))).withColumn("mad", sorted_quantile(F.col("off"), 0.5))
    squares = F.aggregate("w", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean")))
    alike = F.get("w", F.lit(0)) == F.element_at("w", -1)
    s = s.withColumn("sd", F.when(alike, 0.0).otherwise(F.sqrt(F.try_divide(squares, F.col("n")))))
    return s.select(*_GROUP, "n", F.coalesce("differ", F.lit(False)).alias("differ"), "lo", "hi", "med", "mean", "sd", "mad")


def _clipped() -> Column:
    return F.when(F.col("n") >= 5, F.least(F.greatest(F.col("x"), F.col("lo")), F.col("hi"))).otherwise(F.col("x"))


def _spread_statistics(values: DataFrame, p: float) -> DataFrame:
    """cross_section() without a task that holds one: exact quantiles by exact_quantiles(), each after what it builds on."""
    known = materialised(values.where("x is not null").select(*_GROUP, "x"))
    base = known.groupBy(*_GROUP).agg(F.count("*").alias("n"), (F.min("x") < F.max("x")).alias("differ"))
    ends = exact_quantiles(known, _GROUP, "x", (p, 1 - p)).select(*_GROUP, F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    base = materialised(base.join(ends, _GROUP).select(*_GROUP, "n", "differ", *(F.when(F.col("n") >= 5, F.col(c)).alias(c) for c in ("lo", "hi"))))
    w = materialised(known.join(F.broadcast(base), _GROUP).select(*_GROUP, _clipped().alias("w")))  # a row for each date and factor
    moments = w.groupBy(*_GROUP).agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"))
    middle = materialised(exact_quantiles(w, _GROUP, "w", (0.5,)).withColumnRenamed("q0", "med"))
    off = materialised(w.join(F.broadcast(middle), _GROUP).select(*_GROUP, F.abs(F.col("w") - F.col("med")).alias("off")))
    mad = exact_quantiles(off, _GROUP, "off", (0.5,)).withColumnRenamed("q0", "mad")
    return base.join(middle, _GROUP).join(moments, _GROUP).join(mad, _GROUP).select(*_GROUP, "n", "differ", "lo", "hi", "med", "mean", "sd", "mad")


def cross_section(values: DataFrame, p: float = 0.01, held: int = HELD) -> DataFrame:
    """(as_of, factor, n, differ, lo, hi, med, mean, sd, mad) of ``values`` (as_of, factor, x, ...), stored or cheap to read again.

    n: known values; differ: whether they aren't all alike; lo and hi: their quantiles p and 1 - p, of five values or more; then,
    of the values clipped to these, median, mean, deviation and median distance from the median. Cross-sections of ``held`` values
    or fewer are each gathered in a row; if there is a larger one, all are taken by distributed exact quantiles.
    """
    largest = values.groupBy(*_GROUP).agg(F.count("x").alias("n")).agg(F.max("n")).first()[0] or 0
    return _held_statistics(values, p) if largest <= held else _spread_statistics(values, p)


def winsorize(values: DataFrame, p: float = 0.01, held: int = HELD) -> DataFrame:
    """``values`` (as_of, factor, x, ...) with w, x clipped to its quantiles p and 1 - p where five values or more are known, and
    the columns of cross_section()."""
    return values.join(F.broadcast(cross_section(values, p, held)), _GROUP, "left").withColumn("w", F.when(F.col("x").isNotNull(), _clipped()))


def _z(x: Column, s: Callable[[str], Column]) -> Column:
    """The distance of a clipped value from the median in scaled median distances, or else from the mean in deviations."""
    return F.when(s("mad") > 0, (x - s("med")) / (1.4826 * s("mad"))).when(s("sd") > 0, (x - s("mean")) / s("sd")).otherwise(x - s("mean"))


def mad_zscore(values: DataFrame, held: int = HELD) -> DataFrame:
    """winsorize() with z: distance from the median in scaled median deviations, or else from the mean in deviations."""
    return winsorize(values, held=held).withColumn("z", _z(F.col("w"), F.col))


def score_funds(factors: DataFrame, weights: DataFrame, pure_sharpe_only: bool = False, held: int = HELD) -> DataFrame:
    """(scheme, as_of, fund_code, score, rank) and z_<factor> for each factor a scheme names.

    A factor with one value or fewer, or one distinct value, is not used at that date. The score is the weighted sum of the used
    factors' z over the sum of absolute weights, null if one of them is; 0 if all weights are 0; a date without a usable factor
    has no rows. Scores are rounded to ten places before ranks, so that no order of summation decides; ties go by code.

    Funds stay rows of all factors: what a date's cross-sections say, a row each, is broadcast to them, and the few schemes are one array.
    """
    if pure_sharpe_only:
        weights = weights.where("factor = 'sharpe'")
    names = [f for f in FACTORS if f in factors.columns]
    parts = ("n", "differ", "lo", "hi", "med", "mean", "sd", "mad")
    found = cross_section(long_factors(factors), held=held).where("n > 1 and differ")
    found = found.groupBy("as_of").agg(*(F.max(F.when(F.col("factor") == f, F.struct(*parts))).alias(f"_{f}") for f in names))  # a row for each date
    by = (F.max(F.when(F.col("factor") == f, F.col("weight"))).alias(f"w_{f}") for f in names)
    schemes = weights.groupBy("scheme").agg(*by).agg(F.collect_list(F.struct("scheme", *(f"w_{f}" for f in names)))).scalar()

    def z(f: str) -> Column:
        s = F.col(f"_{f}")
        w = F.when(s["n"] >= 5, F.least(F.greatest(F.col(f), s["lo"]), s["hi"])).otherwise(F.col(f))
        return F.when(s.isNotNull() & F.col(f).isNotNull(), _z(w, lambda k: s[k])).alias(f"z_{f}")

    rows = factors.join(F.broadcast(found), "as_of").select("as_of", "fund_code", *map(z, names), *(F.col(f"_{f}").isNotNull().alias(f"_{f}") for f in names))
    rows = rows.select("*", F.inline(schemes))
    rows = rows.withColumns({f"w_{f}": F.when(F.col(f"_{f}"), F.col(f"w_{f}")) for f in names})  # null where it isn't used
    weight = {f: F.col(f"w_{f}") for f in names}
    sums = lambda xs: reduce(lambda a, b: a + b, xs)
    counts = {f: F.coalesce(w != 0, F.lit(False)) for f, w in weight.items()}
    total = sums(F.when(counts[f], weight[f] * F.coalesce(F.col(f"z_{f}"), F.lit(0.0))).otherwise(0.0) for f in names)
    every = sums(F.coalesce(F.abs(w), F.lit(0.0)) for w in weight.values())
    lost = reduce(lambda a, b: a | b, (counts[f] & F.col(f"z_{f}").isNull() for f in names))
    used = reduce(lambda a, b: a | b, (w.isNotNull() for w in weight.values()))
    score = F.when(every == 0, 0.0).when(~lost, F.round(F.try_divide(total, every), 10))
    named = (F.when(weight[f].isNotNull(), F.col(f"z_{f}")) if f in names else F.lit(None).cast("double") for f in FACTORS)
    scored = rows.where(used).select("scheme", "as_of", "fund_code", score.alias("score"), *(c.alias(f"z_{f}") for c, f in zip(named, FACTORS, strict=True)))
    rank = F.row_number().over(Window.partitionBy("scheme", "as_of").orderBy(F.desc_nulls_last("score"), "fund_code"))
    return scored.select("scheme", "as_of", "fund_code", "score", rank.alias("rank"), *(f"z_{f}" for f in FACTORS))
