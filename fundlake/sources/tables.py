"""Intermediate tables in the shared folder, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few columns counts as small: some tens of MB.
SMALL = 500_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. A temporary one serves only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fundlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/fundlake-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once for a session, where they were not started with it on their path."""
    context = spark.sparkContext
    if getattr(context, "_fundlake_shipped", False):
        return
    context._fundlake_shipped = True
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="fundlake-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps start from a short plan, share the work and
    survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has ``rows`` rows at most; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored_by_fund(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """``df`` as materialised() has it, in buckets of its funds, each sorted by fund and date: whatever works by fund afterwards,
    windows, groups and joins, reads it without a shuffle. ``buckets``: as many as shuffles have partitions, unless told."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark)
    name = "fundlake_" + path.rpartition("-")[2]
    df.repartition(n, "fund_code").write.bucketBy(n, "fund_code").sortBy("fund_code", "date").option("path", path).saveAsTable(name)
    return spark.table(name)
