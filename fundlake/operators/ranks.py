"""Numbers of rows in the order of each key, also of keys that no task can hold.

Rows are dealt by ranges of (key, order), so that a large key spans many partitions, and sorted there. A row's number is its place
in its partition, less the place where its key begins, plus the rows of the key in the partitions before: sums over a table of a
row for each partition and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlake.sources.tables import broadcast_if_small, materialised

#: Rows of a key up to which one task may order it.
HELD = 1_000_000


def by_ranges(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` in the order of (keys, by) over partitions ``_part``, with ``_at``, which grows within one by one from row to row.
    Stored, since ranges are drawn from a sample and a repeated task must see the same ones."""
    dealt = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    return materialised(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _spread_numbers(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``."""
    held = by_ranges(rows, keys, by)
    parts = held.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialised(parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).select(*keys, "_part", "_shift"))
    null_safe = [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_part")]
    out = held.alias("h").join(broadcast_if_small(shift).alias("s"), null_safe)
    return out.select(*(F.col(f"h.{c}") for c in rows.columns), (F.col("h._at") + F.col("s._shift")).alias(name))


def row_numbers(rows: DataFrame, keys: list[str], by: list[str], name: str, held: int = HELD) -> DataFrame:
    """``rows``, a stored table, with ``name``, 1 and up in the order of the columns ``by`` (rising, nulls first) within ``keys``.

    By a window if no key has more than ``held`` rows; else by ranges, whatever the size of a key. ``by`` should order rows fully.
    """
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= held:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))
    return _spread_numbers(rows, keys, by, name)


def average_ranks(rows: DataFrame, keys: list[str], by: str, tie: str, name: str, held: int = HELD) -> DataFrame:
    """``rows`` with ``name``, the rank by ``by`` within ``keys``, ties at their mean; ``tie``, a column that tells ties apart, spreads
    a value that many rows share over partitions."""
    numbered = row_numbers(rows, keys, [by, tie], "_number", held)
    numbered = materialised(numbered)
    mean = numbered.groupBy(*keys, by).agg(((F.min("_number") + F.max("_number")) / 2).alias(name))
    null_safe = [F.col(f"h.{k}").eqNullSafe(F.col(f"m.{k}")) for k in (*keys, by)]
    return numbered.alias("h").join(mean.alias("m"), null_safe).select(*(F.col(f"h.{c}") for c in rows.columns), F.col(f"m.{name}"))
