"""NAV, universe and catalogue sources: alias resolution, cleaning, loading and keyed upserts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.functions.codes import norm_code, six_digits

#: Candidate names in order of preference (fixed values).
FUND_COLUMNS = ("fund_code", "code", "基金代码", "基金代码(6位)", "证券代码")
DATE_COLUMNS = ("date", "trade_date", "pricedate", "净值日期", "交易日期", "日期")
NAV_COLUMNS = ("nav", "单位净值", "净值", "unit_nav", "nav_unit", "单位净值(元)", "复权单位净值")
ACC_NAV_COLUMNS = ("acc_nav", "累计净值", "累计净值(元)", "adjusted_nav")
PREFERRED_TABLES = ("fund_nav_daily", "fund_data_raw", "fund_nav_raw", "fund_nav", "fund_price")
UNIVERSE_COLUMNS = ("fund_code", "代码", "基金代码", "symbol", "code")


def as_date(col: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(col.cast("string")).cast("date"), F.to_date(F.lit(None)))


def as_double(col: Column) -> Column:
    """The number, null for bad text, NaN and infinities: nothing but null stands for a missing value."""
    x = F.expr("try_cast(null as double)") if col is None else col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def pick(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first alias that is one of ``columns``."""
    return next((a for a in aliases if a in columns), None)


#: A row's place in its files, where it has been kept: files by name, their parts in order, rows as they come in a part.
POSITION = "_position"


def with_position(df: DataFrame) -> DataFrame:
    """``df``, just read from files, with POSITION. A file's parts may be read anywhere: a number that Spark gives to rows orders
    those of one part only, so the file and where its part begins come first."""
    return df.withColumn(POSITION, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")))


def resolve_nav_source(tables: dict[str, DataFrame]) -> DataFrame:
    """The first table, preferred names first, with a fund, a date and a NAV column, as (fund_code, date, nav, acc_nav,
    daily_return) strings and numbers as they are, and POSITION where it is; absent optional columns are null. No such table is an
    error."""
    names = [n for n in PREFERRED_TABLES if n in tables] + [n for n in tables if n not in PREFERRED_TABLES]
    for name in names:
        df = tables[name]
        found = [pick(df.columns, a) for a in (FUND_COLUMNS, DATE_COLUMNS, NAV_COLUMNS)]
        if all(found):
            acc = pick(df.columns, ACC_NAV_COLUMNS)
            optional = [F.col(f"`{acc}`") if acc else F.lit(None), F.col("daily_return") if "daily_return" in df.columns else F.lit(None)]
            named = [F.col(f"`{c}`").alias(n) for c, n in zip(found, ("fund_code", "date", "nav"), strict=True)]
            place = [POSITION] if POSITION in df.columns else []
            return df.select(*named, as_double(optional[0]).alias("acc_nav"), as_double(optional[1]).alias("daily_return"), *place)
    raise ValueError("no table holds a fund, a date and a NAV column")


def read_nav(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """NAV rows of files, with POSITION, which is an order for load_nav()."""
    reader = spark.read.format(fmt)
    return resolve_nav_source({"input": with_position((reader.option("header", True) if fmt == "csv" else reader).load(path))})


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """The first row for each key by ``order``; without an order, by all other columns, since Spark has no row order."""
    order = order or [c for c in df.columns if c not in keys] or [F.lit(1)]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def clean_raw_nav(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Landed rows with raw headers to (fund_code, date, nav, acc_nav, daily_return): bad text is null, percents are shares,
    rows without a date or NAV are dropped, the first row of a fund and date stays (by ``order`` if it is given)."""
    words = (("日期", "date"), ("单位", "nav"), ("累计", "acc_nav"), ("增长率", "daily_return"))
    names: dict[str, str] = {}
    for c in raw.columns:
        new = next((n for w, n in words if w in c), None)
        if new and new not in names.values():
            names[c] = new
    old = {n: F.col(f"`{c}`") for c, n in names.items()}
    missing = F.lit(None).cast("string")
    percent = F.regexp_replace(F.trim(old.get("daily_return", missing).cast("string")), "%", "")
    df = raw.select(
        F.col("fund_code"), as_date(old.get("date", missing)).alias("date"), as_double(old.get("nav", missing).cast("string")).alias("nav"),
        as_double(old.get("acc_nav", missing).cast("string")).alias("acc_nav"), (as_double(percent) / 100).alias("daily_return"),
        *([F.col(order).alias("_order")] if order else []),
    ).where("date is not null and nav is not null")
    return first_rows(df, ["fund_code", "date"], ["_order"] if order else None).drop("_order")


def merge_nav_feeds(unit: DataFrame, accumulated: DataFrame) -> DataFrame:
    """Unit NAV with accumulated NAV of the same fund and date, null where there is none."""
    return unit.drop("acc_nav").join(accumulated.select("fund_code", "date", "acc_nav"), ["fund_code", "date"], "left").select("fund_code", "date", "nav", "acc_nav", "daily_return")


def extract_codes(df: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct six-digit codes of the likeliest column, with ``pos``, the place of the first by ``order``, or by POSITION, or else
    by the code itself, since rows have no order of their own."""
    order = order or (POSITION if POSITION in df.columns else None)
    df, place = (df.withColumn("_pos", F.col(order)).drop(POSITION), F.col("_pos")) if order else (df, None)
    names = [c for c in df.columns if c != "_pos"]
    column = pick(names, UNIVERSE_COLUMNS)
    if column is None:
        has = df.agg(*(F.max(six_digits(F.col(f"`{c}`")) != "").alias(str(k)) for k, c in enumerate(names))).first()
        column = next((c for k, c in enumerate(names) if has[k]), names[0])
    code = six_digits(F.col(f"`{column}`"))
    rows = df.select(code.alias("fund_code"), (code if place is None else place).alias("pos"))
    return rows.where("fund_code <> ''").groupBy("fund_code").agg(F.min("pos").alias("pos"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The codes of CSV files with a header, in the order of their rows."""
    return extract_codes(with_position(spark.read.option("header", True).csv(path)))


def load_universe(sources: list[DataFrame], limit: int) -> DataFrame:
    """(fund_code, source, pos): codes of the sources in priority order, each code once, ``limit`` at most: a later source only fills
    up. ``pos`` counts from 0 in the order of all."""
    parts = [extract_codes(s).select("fund_code", F.lit(k).alias("source"), "pos") for k, s in enumerate(sources)]
    # places of different sources differ in type: each source's codes are numbered, ``limit`` of them at most
    first = [p.orderBy("pos", "fund_code").limit(limit) for p in parts]
    rows = None
    for p in first:
        numbered = p.withColumn("nth", F.row_number().over(Window.orderBy("pos", "fund_code"))).select("fund_code", "source", "nth")
        rows = numbered if rows is None else rows.unionByName(numbered)
    rows = first_rows(rows, ["fund_code"], ["source", "nth"]).orderBy("source", "nth").limit(limit)
    return rows.select("fund_code", "source", (F.row_number().over(Window.orderBy("source", "nth")) - 1).alias("pos"))


def load_nav(nav: DataFrame, universe: DataFrame | None = None, since: str | None = None, min_history: int = 0, order: str | None = None) -> DataFrame:
    """Cleaned NAV of the universe's funds from ``since`` on; if the whole table has no such row, from 365 days before.

    Codes are normalised and the first row of a (fund, date) stays. Funds with fewer than ``min_history`` dates go, unless all do.
    """
    rows = nav.select(norm_code(F.col("fund_code")).alias("fund_code"), F.col("date").cast("date").alias("date"), *(as_double(F.col(c)).alias(c) for c in ("nav", "acc_nav", "daily_return")), *([F.col(order).alias("_order")] if order else []))
    if since is not None:
        start = F.lit(since).cast("date")
        # a bound that the scan knows beforehand; which of the two counts is decided above it
        rows = rows.where(F.col("date") >= F.lit(date.fromisoformat(since) - timedelta(days=365)))
        fresh = nav.agg((F.max(F.col("date").cast("date")) >= start).alias("fresh")).scalar()
        rows = rows.where(F.col("date") >= F.when(fresh, start).otherwise(F.date_sub(start, 365)))
    if universe is not None:
        rows = rows.join(universe.select(norm_code(F.col("fund_code")).alias("fund_code")).distinct(), "fund_code", "left_semi")
    rows = first_rows(rows, ["fund_code", "date"], ["_order"] if order else None).drop("_order")
    return min_history_filter(rows, min_history) if min_history > 1 else rows


def min_history_filter(nav: DataFrame, n: int) -> DataFrame:
    """Funds with ``n`` distinct dates or more; all of them if none has."""
    days = nav.groupBy("fund_code").agg(F.count_distinct("date").alias("days"))
    least = F.least(F.lit(n), F.when(days.agg(F.max("days")).scalar() >= n, F.lit(n)).otherwise(F.lit(0)))
    return nav.join(days.where(F.col("days") >= least), "fund_code", "left_semi")


def drop_null_nav(nav: DataFrame) -> DataFrame:
    return nav.dropna(subset=["date", "nav"])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None, codes: tuple[str, ...] = ("fund_code",)) -> DataFrame:
    """``target`` with the batch's rows: a row with a known key overwrites the columns the batch has, nulls too, and keeps the
    others; another is inserted. Of several batch rows with one key the last by ``order`` counts, by all columns without it.
    A batch of keys alone inserts or is ignored."""
    for c in codes:
        if c in batch.columns:
            batch = batch.withColumn(c, norm_code(F.col(c)))
    rest = [c for c in batch.columns if c not in keys and c != order]
    by = [F.col(c).desc_nulls_last() for c in ([order] if order else rest)] or [F.lit(1)]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    new = batch.withColumn("_rn", rn).where("_rn = 1").select(*keys, F.struct(F.lit(True).alias("_new"), *rest).alias("b"))
    joined = target.join(new, keys, "full_outer")
    columns = [*target.columns, *(c for c in rest if c not in target.columns)]
    value = lambda c: F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(c) if c in target.columns else F.lit(None)) if c in rest else F.col(c)
    return joined.select(*(c if c in keys else value(c).alias(c) for c in columns))


def upsert_nav(target: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert by (fund_code, date) of nav and, where the batch has them, acc_nav and daily_return."""
    if missing := {"fund_code", "date", "nav"} - set(batch.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    keep = [c for c in ("fund_code", "date", "nav", "acc_nav", "daily_return") if c in batch.columns]
    return upsert(target, batch.select(*keep, *([order] if order else [])), ["fund_code", "date"], order)


def upsert_portfolio(target: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    if missing := {"date", "fund_code"} - set(batch.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return upsert(target, batch, ["date", "fund_code"], order)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).format(fmt).option("header", True).save(path)


def run_manifest(universe: DataFrame, **facts: object) -> DataFrame:
    """One row: the number of codes, the sha256 of the codes in order (a line each), and the given facts as JSON."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "fund_code"))), lambda x: x["fund_code"])
    return universe.agg(F.count("*").alias("universe_count"), F.sha2(F.concat_ws("\n", codes), 256).alias("universe_sha256")).withColumn("facts", F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(facts.items())))) if facts else F.lit("{}"))
