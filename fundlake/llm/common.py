"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
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


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that nothing is learnt from: crc32 of the id as text is 0 modulo 5. Null ids are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees; a temporary one only where that is unset and Spark runs
    in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fundlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/fundlake-{uuid.uuid4().hex}"


def written(df: DataFrame, per_file: int = 0) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: cuts lineage and survives lost executors. ``per_file``: rows
    in a file at most (0: any number), for rows so large that a task should neither write nor read many at once."""
    ship(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 17) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled training rows at most.

    Rows without an id or a label and those of the held-out fold never enter; of several labels for one id the
    largest counts. The sample is by a hash of the id, so that it doesn't depend on the order of rows. Its bound
    is also what bounds the broadcast. Where ids repeat, equal rows count once, and more than twice the bound are thinned by a
    hash of the text.
    """
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    if (many := chosen.select("doc_id").count()) > 2 * bound:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(1 << 20)) < int(bound / many * (1 << 20)))
    return chosen.distinct()


def with_hot(rows: DataFrame, table: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """``rows`` left-joined with ``cols`` of ``table``, which has one row for each key ``on``. Its rows marked ``hot``, whose number
    must be bounded, are looked up in a broadcast table, so that no task gets all rows of such a key."""
    mine = [c for c in rows.columns if c not in cols]
    hot = table.where("hot").select(*(F.col(c).alias(f"_hot_{c}") for c in (*on, *cols)))
    match = [F.col(c) == F.col(f"_hot_{c}") for c in on]
    seen = rows.select(*mine).join(F.broadcast(hot), match, "left")
    common = seen.where(F.col(f"_hot_{on[0]}").isNotNull()).select(*mine, *(F.col(f"_hot_{c}").alias(c) for c in cols))
    rest = seen.where(F.col(f"_hot_{on[0]}").isNull()).select(*mine).join(table.where("not hot").select(*on, *cols), on, "left")
    return common.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (src, dst).

    Each round takes the neighbours' minimum, hooks a root onto the lowest label that its members see, and jumps to the root's
    root, until nothing changes; labels only fall, so that it ends, whatever the number of rounds. Minima are aggregated before
    they are dealt out, and each round's labels are written to the shared folder.
    """
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links = written(both)
    ids = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = written(ids.select("node", F.col("node").alias("component")))
    sym = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    while True:
        near = sym.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # hook the old root onto the lowest label seen by any of its members, then jump to the root's root
        root = low.groupBy(F.col("was").alias("node")).agg(F.min("component").alias("hook"))
        low = low.join(root.select(F.col("node").alias("was"), "hook"), "was").select("node", "was", F.least("component", "hook").alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(low.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        label = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return label
