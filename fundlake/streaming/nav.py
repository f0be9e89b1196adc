"""Streaming refresh of NAV and a streaming benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundlake.functions.codes import norm_code
from fundlake.sources.store import MonthlyStore


def stream_upsert_nav(source: DataFrame, store: str, checkpoint: str, lookback: int = 5, fallback: str = "1900-01-01") -> StreamingQuery:
    """Upserts arriving (fund_code, date, nav, acc_nav, daily_return, ts) rows into the MonthlyStore under ``store``.

    Codes are normalised and rows without a date or NAV dropped. Rows more than ``lookback`` days before a fund's latest stored
    date are dropped; the last row by ts wins, so a correction does. A batch reads the marks, one row for each fund, and the
    months that it touches. Each stores its number under the checkpoint's name: one that is run again after a restart changes
    nothing, and a stream with a new checkpoint goes on from what the store has.
    """

    def apply(batch: DataFrame, number: int) -> None:
        kept = MonthlyStore(batch.sparkSession, store)
        clean = batch.withColumn("fund_code", norm_code(F.col("fund_code"))).dropna(subset=["date", "nav"])
        since = F.coalesce(F.date_sub("latest", lookback), F.lit(fallback).cast("date"))
        fresh = clean.join(kept.marks(), "fund_code", "left").where(F.col("date") >= since).drop("latest")
        kept.upsert(fresh, "ts", writer=checkpoint, number=number)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """What a store has now."""
    return MonthlyStore(spark, store).read()


def stream_benchmark(returns: DataFrame, delay: str = "7 days") -> DataFrame:
    """(date, bench_ret, funds) of a stream of returns (ts, ret): one-day windows, closed ``delay`` after the latest time."""
    return returns.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.avg("ret").alias("bench_ret"), F.count("*").alias("funds")).select(F.col("window.start").cast("date").alias("date"), "bench_ret", "funds")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has arrived into parquet files under ``folder`` and reads them."""
    out, mark = f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/mark-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)
