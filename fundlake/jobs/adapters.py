"""The test tables as NAV, universe and catalogue: a supplier is a fund, a ship date a trading date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nav(spark: SparkSession, sf_dir: str, all_returns: bool = False) -> DataFrame:
    """(fund_code, date, nav, acc_nav, daily_return); unless ``all_returns``, a third of the funds each have provider returns,
    accumulated NAV, and neither."""
    price, k = F.col("l_extendedprice"), F.col("k")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.avg(price / F.col("l_quantity")) / 1000).alias("nav"), (0.25 * F.sum(price * (F.col("l_discount") - F.col("l_tax"))) / F.sum(price) - 0.0025).alias("r")
    )
    own = F.lit(True) if all_returns else k % 3 == 0
    return rows.select(F.lpad(k.cast("string"), 6, "0").alias("fund_code"), "date", "nav", F.when(k % 3 == 1, F.col("nav")).alias("acc_nav"), F.when(own, F.col("r")).alias("daily_return"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("fund_code"), F.col("s_suppkey").alias("pos"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as funds; the last letter of the name is the share class."""
    suffix = F.element_at(F.array(*map(F.lit, ("A", "C", " (后端)", ""))), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("fund_code"), F.concat("p_name", F.lit(" "), "p_brand", suffix).alias("fund_name"), F.col("p_type").alias("fund_type"),
        F.col("p_brand").alias("fund_company"), F.concat(1990 + F.col("p_size") % 12, F.lit("-06-30")).alias("inception_date"),
    )


def nav_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of (fund_code, date, nav, acc_nav, daily_return, ts): a user is a fund, an event's value its NAV at that time."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a file by a pattern only
    missing = F.lit(None).cast("double")
    return rows.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("fund_code"), F.to_date("ts").alias("date"), F.col("value").alias("nav"), missing.alias("acc_nav"), missing.alias("daily_return"), "ts")
