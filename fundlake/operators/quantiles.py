"""Exact quantiles of large groups without a task that holds a group.

A mergeable sketch of each group brackets the values around each rank asked for. One pass counts the values below the bracket and
gathers those inside, equal ones as one row; only these, a few thousandths of the group, are put in order. Where a bracket has
missed its rank, which the counts show, it is widened and tried again, at last to the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.sources.tables import broadcast_if_small, materialised


def between(lower: Column, upper: Column, share: Column) -> Column:
    """Linear interpolation from one value to the next."""
    return lower + (upper - lower) * share


def sorted_quantile(values: Column, p: float) -> Column:
    """The p-quantile of a sorted array, by linear interpolation; null if it is empty."""
    place = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(place).cast("int")
    lower, upper = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return between(lower, upper, place - low)


def exact_quantiles(values: DataFrame, keys: list[str], x: str, shares: tuple[float, ...], accuracy: int = 2000) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles of the known ``x`` of each group at ``shares``, by linear interpolation.

    ``values`` should be a stored table, for it is read twice, and once more for each widening. No shuffle carries more of a
    group than its sketches and the distinct values inside the brackets, about 4 / ``accuracy`` of them.
    """
    rows = values.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    missed, found, slack = None, [], 2.0 / accuracy
    while True:
        mine = rows if missed is None else rows.join(broadcast_if_small(missed.select(*keys).distinct()), keys, "left_semi")
        if slack < 1:
            around = [min(max(p + s * slack, 0.0), 1.0) for p in shares for s in (-1, 1)]
            sketch = mine.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", around, accuracy).alias("_a"))
            edges = [F.struct(F.lit(k).alias("_k"), *(F.when(F.lit(0 < p - slack) if side == 0 else F.lit(p + slack < 1), F.col("_a")[2 * k + side]).alias(name) for side, name in ((0, "_lo"), (1, "_hi")))) for k, p in enumerate(shares)]
        else:
            sketch = sizes if missed is None else sizes.join(broadcast_if_small(missed.select(*keys).distinct()), keys, "left_semi")
            edges = [F.struct(F.lit(k).alias("_k"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi")) for k in range(len(shares))]
        place = (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("_k") + 1)
        brackets = sketch.select(*keys, "_n", F.inline(F.array(*edges))).withColumn("_place", place).withColumn("_rank", F.floor("_place"))
        if missed is not None:
            brackets = brackets.join(broadcast_if_small(missed.select(*keys, "_k")), [*keys, "_k"], "left_semi")
        brackets = materialised(brackets)
        # rows below a bracket are counted, rows inside counted by value, rows above left out
        seen = mine.join(broadcast_if_small(brackets.select(*keys, "_k", "_lo", "_hi")), keys)
        seen = seen.where(F.col("_hi").isNull() | (F.col("_x") <= F.col("_hi")))
        below = F.col("_lo").isNotNull() & (F.col("_x") < F.col("_lo"))
        held = materialised(seen.groupBy(*keys, "_k", F.when(~below, F.col("_x")).alias("_v"), below.alias("_below")).agg(F.count("*").alias("_c")))
        up = Window.partitionBy(*keys, "_k").orderBy(F.desc("_below"), "_v")
        placed = held.withColumn("_end", F.sum("_c").over(up)).withColumn("_next", F.lead("_v").over(up))
        placed = placed.join(broadcast_if_small(brackets.select(*keys, "_k", "_n", "_place", "_rank")), [*keys, "_k"])
        rank = F.col("_rank") + 1  # from 1
        at = placed.where((F.col("_end") >= rank) & (F.col("_end") - F.col("_c") < rank))
        share = F.col("_place") - F.col("_rank")
        upper = F.when((share == 0) | (F.col("_end") > rank), F.col("_v")).otherwise(F.col("_next"))
        result = materialised(at.select(*keys, "_k", F.when(~F.col("_below"), between(F.col("_v"), upper, share)).alias("_q")).where(F.col("_q").isNotNull()))
        found.append(result)
        missed = materialised(brackets.select(*keys, "_k").join(result.select(*keys, "_k"), [*keys, "_k"], "left_anti"))
        if slack >= 1 or missed.isEmpty():
            break
        slack = min(1.0, slack * 16)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy(*keys).agg(*(F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(f"q{k}") for k in range(len(shares))))
