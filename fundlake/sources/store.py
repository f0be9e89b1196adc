"""A NAV store by month: upserts rewrite the months they touch, a manifest names the version of each month that counts.

    data/month=2024-01/v=3/...    rows of a month as version 3 left them, sorted by fund and date
    marks/v=3/...                 each fund's latest date
    manifest/00000003.json        {month: version}, the schema, and the last batch of each writer

A version appears with its manifest and is never changed afterwards, so that readers see whole versions. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundlake.functions.codes import norm_code
from fundlake.sources.nav import upsert_nav
from fundlake.sources.tables import materialised

_SCHEMA = "fund_code string, date date, nav double, acc_nav double, daily_return double"
_MONTH = F.date_format  # of a date, as yyyy-MM


@dataclass(frozen=True)
class Snapshot:
    """A version: the version of each month's rows and of the marks, the schema, each writer's last batch."""

    version: int = 0
    months: dict[str, int] = field(default_factory=dict)
    schema: str = ""
    done: dict[str, int] = field(default_factory=dict)


class MonthlyStore:
    """The store under ``path``, which every executor sees."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs  # Hadoop's file systems, for names and moves of single files
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, pattern: str) -> list[str]:
        return [str(s.getPath()) for s in self._fs.globStatus(self._jvm.Path(f"{self.path}/{pattern}")) or []]

    def versions(self) -> list[int]:
        """The versions that have a manifest, rising."""
        return sorted(int(p.rpartition("/")[2].removesuffix(".json")) for p in self._list("manifest/*.json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the last one by default; an empty one for a new store."""
        found = self.versions()
        if version is None and not found:
            return Snapshot()
        if version is not None and version not in found:
            raise ValueError(f"the store has no version {version}")
        text = self.spark.read.text(f"{self.path}/manifest/{version or found[-1]:08d}.json", wholetext=True).first()[0]
        return Snapshot(**json.loads(text))

    def _rows(self, s: Snapshot, months: list[str]) -> DataFrame:
        """The rows of some months: only their folders are listed and read."""
        schema = StructType.fromJson(json.loads(s.schema)) if s.schema else StructType.fromDDL(_SCHEMA)
        if not months:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/month={m}/v={s.months[m]}" for m in months]
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, since: str | None = None, until: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version from ``since`` to ``until``, both included; other months aren't opened, and within the months the
        dates reach the scan. Columns that a month was stored without are null."""
        s = self.snapshot(version)
        out = self._rows(s, [m for m in sorted(s.months) if (since is None or m >= since[:7]) and (until is None or m <= until[:7])])
        if since is not None:
            out = out.where(F.col("date") >= F.lit(since).cast("date"))
        return out if until is None else out.where(F.col("date") <= F.lit(until).cast("date"))

    def marks(self, version: int | None = None) -> DataFrame:
        """(fund_code, latest): each fund's latest date, one row for each fund."""
        s = self.snapshot(version)
        if not s.version:
            return self.spark.createDataFrame([], "fund_code string, latest date")
        return self.spark.read.schema("fund_code string, latest date").parquet(f"{self.path}/marks/v={s.version}")

    def upsert(self, batch: DataFrame, order: str | None = None, writer: str = "", number: int | None = None) -> Snapshot:
        """Upserts ``batch`` as upsert_nav() does and gives the new version.

        Only the months that the batch has dates in are read and written anew. Rows without a date are dropped. A ``writer``'s
        batch ``number`` that has been stored before isn't stored again, so a stream that repeats one after a restart changes
        nothing. A run that fails before its manifest is there leaves nothing that counts; the next one overwrites it.
        """
        last = self.snapshot()
        if number is not None and number <= last.done.get(writer, -1):
            return last
        rows = materialised(batch.dropna(subset=["date"]).withColumns({"fund_code": norm_code(F.col("fund_code")), "date": F.col("date").cast("date")}))
        touched = sorted(r.m for r in rows.select(_MONTH("date", "yyyy-MM").alias("m")).distinct().collect())  # one for each month
        version = last.version + 1
        done = last.done | ({writer: number} if number is not None else {})
        new = upsert_nav(self._rows(last, [m for m in touched if m in last.months]), rows, order)
        if touched:
            # months of any size: Spark splits and joins the partitions it writes by their measured sizes
            parts = new.withColumns({"month": _MONTH("date", "yyyy-MM"), "v": F.lit(version)}).hint("rebalance", "month")
            self._write(parts.sortWithinPartitions("month", "fund_code", "date"), "data", "month", "v")
        marks = self.marks().unionByName(rows.groupBy("fund_code").agg(F.max("date").alias("latest"))) if last.version else rows.groupBy("fund_code").agg(F.max("date").alias("latest"))
        self._write(marks.groupBy("fund_code").agg(F.max("latest").alias("latest")).withColumn("v", F.lit(version)), "marks", "v")
        return self._commit(Snapshot(version, last.months | dict.fromkeys(touched, version), new.schema.json(), done))

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        """Writes partitions that no version has yet; what a failed run left there goes."""
        df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{folder}")

    def _commit(self, s: Snapshot) -> Snapshot:
        part, final = self._jvm.Path(f"{self.path}/manifest/.{s.version:08d}"), self._jvm.Path(f"{self.path}/manifest/{s.version:08d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(s.__dict__, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"version {s.version} of {self.path} has been written by another")
        return s

    def vacuum(self, keep: int = 2) -> int:
        """Removes what none of the last ``keep`` versions needs; how many folders went."""
        if keep < 1:
            raise ValueError("the last version is kept")
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-keep:]]
        needed = {f"month={m}/v={v}" for s in kept for m, v in s.months.items()} | {f"marks/v={s.version}" for s in kept}
        gone = [p for p in self._list("data/month=*/v=*") + self._list("marks/v=*") if "/".join(p.split("/")[-2:]) not in needed]
        for v in versions[:-keep]:  # first the names, then what they name
            self._fs.delete(self._jvm.Path(f"{self.path}/manifest/{v:08d}.json"), False)
        for p in gone:
            self._fs.delete(self._jvm.Path(p), True)
        return len(gone)
