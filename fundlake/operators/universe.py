"""The fund universe: catalogue, share classes, sampling, NAV quality and an audit that gives each fund's reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.functions.codes import EQUITY_TYPES, INDEX_TYPE, SPECIAL, base_name, share_class, six_digits, type_reason
from fundlake.sources.nav import POSITION, as_date, first_rows, with_position, write_result
from fundlake.sources.tables import materialised

#: Catalogue column -> candidate names, any case, then as a part of a name (fixed values).
ALIASES = {
    "fund_code": ("fund_code", "基金代码", "代码", "code", "symbol"),
    "fund_name": ("fund_name", "基金简称", "基金名称", "名称", "name"),
    "fund_type": ("fund_type", "基金类型", "类型", "type"),
    "fund_company": ("fund_company", "基金公司", "管理人", "company"),
    "inception_date": ("inception_date", "成立日期", "成立日", "date"),
}
#: Items of landed facts (fixed values).
ITEMS = {"基金名称": "fund_name", "基金类型": "fund_type", "基金公司": "fund_company", "成立时间": "inception_date"}


#: What nav_quality() adds to the audit, null before NAV is looked at.
NAV_FACTS = {"data_start": "date", "data_end": "date", "nav_days": "long", "data_coverage": "double", "zero_return_ratio": "double"}
#: Columns of the audit and of the list of retained funds as they are written (fixed values).
AUDIT_COLUMNS = (
    "fund_code", "fund_name", "fund_type", "base_fund_code", "share_class", "fund_company", "inception_date", "data_start", "data_end",
    "data_coverage", "nav_days", "zero_return_ratio", "metadata_warning", "status", "exclude_reason", "metadata_as_of",
)
RETAINED_COLUMNS = AUDIT_COLUMNS[:12]


def _column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    columns = [c for c in df.columns if c != POSITION]
    lower = {c.strip().lower(): c for c in columns}
    exact = next((lower[n] for n in names if n in lower), None)
    return exact or next((c for c in columns if any(n in c.lower() for n in names)), None)


def normalize_catalog(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Strings (fund_code, fund_name, fund_type, fund_company, inception_date); the first row of a six-digit code stays, by
    ``order``, or by POSITION where it is, or by all columns."""
    order = order or (POSITION if POSITION in raw.columns else None)
    found = {new: _column(raw, names) for new, names in ALIASES.items()}
    if found["fund_code"] is None:
        raise ValueError("the catalogue has no code column")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c else F.lit("")
    rows = raw.select(six_digits(F.col(f"`{found['fund_code']}`")).alias("fund_code"), *(text(found[n]).alias(n) for n in list(ALIASES)[1:]), *([F.col(order).alias("_order")] if order else []))
    return first_rows(rows.where("fund_code <> ''"), ["fund_code"], ["_order"] if order else None).drop("_order")


def share_dedupe(catalog: DataFrame, reason: Column) -> DataFrame:
    """``catalog`` with share_class, base_fund_code and exclude_reason: back-end shares and all but one share of a name go."""
    rows = catalog.withColumn("share_class", share_class(F.col("fund_name"))).withColumn("exclude_reason", reason)
    rows = rows.withColumn("exclude_reason", F.when((F.col("exclude_reason") == "") & (F.col("share_class") == "B"), "B_SHARE").otherwise(F.col("exclude_reason")))
    free = F.col("exclude_reason") == ""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (("A", 0), ("original", 1), ("C", 2), ("B", 3)) for x in kv)), F.col("share_class")), F.lit(9))
    over = Window.partitionBy("_base", "_free").orderBy("_rank", "fund_code")
    rows = rows.withColumn("_base", base_name(F.col("fund_name"))).withColumn("_free", free).withColumn("_rank", rank)
    rows = rows.withColumn("_kept", F.first("fund_code").over(over))
    return rows.withColumn("base_fund_code", F.when(F.col("_free"), F.col("_kept")).otherwise("")).withColumn(
        "exclude_reason", F.when(F.col("_free") & (F.col("fund_code") != F.col("_kept")), "DUPLICATE_SHARE").otherwise(F.col("exclude_reason"))
    ).drop("_base", "_free", "_rank", "_kept")


def stable_sample(rows: DataFrame, seed: int, n: int) -> DataFrame:
    """``rows`` with sample_key and pick: 1..n for the n free rows with the smallest sha256 of seed and code, null else; the
    other free rows get CANDIDATE_LIMIT. Only the smallest n keys are gathered."""
    rows = rows.withColumn("sample_key", F.sha2(F.concat_ws(":", F.lit(str(seed)), "fund_code"), 256))
    top = rows.where("exclude_reason = ''").orderBy("sample_key", "fund_code").limit(n).select("fund_code", F.row_number().over(Window.orderBy("sample_key", "fund_code")).alias("pick"))
    rows = rows.join(top, "fund_code", "left")
    return rows.withColumn("exclude_reason", F.when((F.col("exclude_reason") == "") & F.col("pick").isNull(), "CANDIDATE_LIMIT").otherwise(F.col("exclude_reason")))


def enrich_catalog(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Landed facts (code, item, value) override sampled rows' columns where they aren't empty."""
    facts = info.groupBy(F.col("code").alias("fund_code")).pivot("item", list(ITEMS)).agg(F.max("value"))
    facts = facts.select("fund_code", *(F.col(i).alias(f"_{n}") for i, n in ITEMS.items()))
    joined = rows.join(facts, "fund_code", "left")
    for n in ITEMS.values():
        joined = joined.withColumn(n, F.when(F.col("pick").isNotNull(), F.coalesce(F.nullif(F.trim(f"_{n}"), F.lit("")), F.col(n))).otherwise(F.col(n)))
    return joined.drop(*(f"_{n}" for n in ITEMS.values()))


def inception_filter(rows: DataFrame, start: str) -> DataFrame:
    late = (F.col("exclude_reason") == "") & (as_date(F.col("inception_date")) > F.lit(start).cast("date"))
    return rows.withColumn("exclude_reason", F.when(late, "INCEPTION_AFTER_BACKTEST_START").otherwise(F.col("exclude_reason")))


def nav_quality(nav: DataFrame, codes: DataFrame, start: str, end: str, min_history: int = 252, min_coverage: float = 0.95, zero_share: float = 0.995) -> DataFrame:
    """(fund_code, data_start, data_end, nav_days, data_coverage, zero_return_ratio, quality_reason) for each code."""
    rows = nav.select("fund_code", F.col("date").cast("date").alias("date"), "nav").where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("nav").isNotNull())
    rows = first_rows(rows.join(codes.select("fund_code").distinct(), "fund_code", "left_semi"), ["fund_code", "date"])
    days = rows.agg(F.count_distinct("date")).scalar()
    ret = F.try_divide(F.col("nav"), F.lag("nav").over(Window.partitionBy("fund_code").orderBy("date"))) - 1
    stats = rows.withColumn("r", ret).groupBy("fund_code").agg(
        F.min("date").alias("data_start"), F.max("date").alias("data_end"), F.count("*").alias("nav_days"),
        F.coalesce(F.round(F.avg((F.abs("r") < 1e-12).cast("double")), 6), F.lit(1.0)).alias("zero_return_ratio"),
    )
    stats = stats.withColumn("data_coverage", F.round(F.try_divide(F.col("nav_days").cast("double"), days), 6))
    out = codes.select("fund_code").distinct().join(stats, "fund_code", "left")
    reason = (
        F.when(F.col("nav_days").isNull(), "NO_NAV").when(F.col("nav_days") < min_history, "HISTORY_TOO_SHORT")
        .when(F.col("data_coverage") < min_coverage, "LOW_COVERAGE").when(F.col("zero_return_ratio") >= zero_share, "SUSPICIOUS_ZERO_RETURN").otherwise("")
    )
    return out.select("fund_code", "data_start", "data_end", F.coalesce("nav_days", F.lit(0)).alias("nav_days"), "data_coverage", "zero_return_ratio", reason.alias("quality_reason"))


def build_universe(
    catalog: DataFrame, nav: DataFrame | None, start: str, end: str, limit: int = 50, candidate_limit: int = 100, seed: int = 20260821,
    info: DataFrame | None = None, allowed: tuple[str, ...] = EQUITY_TYPES, excluded: tuple[str, ...] = SPECIAL, index: str = INDEX_TYPE,
    min_history: int = 252, min_coverage: float = 0.95, zero_share: float = 0.995, stage: str = "finalize", warn: bool = False, as_of: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(audit, keep): every fund with its reason and status, and the codes kept in sample order.

    stage "prepare" goes without NAV: funds without a reason are candidates, ``candidate_limit`` of them kept; "finalize" judges
    their NAV and retains ``limit`` at most. ``warn`` marks candidates without an inception date; ``as_of`` dates the catalogue.
    """
    if stage not in ("prepare", "finalize"):
        raise ValueError(f"no such stage: {stage}")
    rows = share_dedupe(catalog, type_reason(F.col("fund_type"), F.col("fund_name"), allowed, excluded, index))
    rows = stable_sample(rows, seed, max(candidate_limit, limit))
    if info is not None:
        rows = enrich_catalog(rows, info)
    rows = inception_filter(rows, start)
    unknown = (F.col("exclude_reason") == "") & as_date(F.col("inception_date")).isNull() & F.lit(warn)
    rows = rows.withColumn("metadata_warning", F.when(unknown, "INCEPTION_UNKNOWN").otherwise("")).withColumn("metadata_as_of", F.lit(as_of))
    if stage == "prepare":
        audit = rows.withColumn("status", F.when(F.col("exclude_reason") == "", "candidate").otherwise("excluded"))
        audit = audit.withColumns({c: F.lit(None).cast(t) for c, t in NAV_FACTS.items()})
        return audit, rows.where("exclude_reason = ''").orderBy("pick").limit(candidate_limit).select("fund_code", "pick")
    quality = nav_quality(nav, rows.where("exclude_reason = ''").select("fund_code"), start, end, min_history, min_coverage, zero_share)
    rows = rows.join(quality, "fund_code", "left")
    rows = rows.withColumn("exclude_reason", F.when((F.col("exclude_reason") == "") & F.col("quality_reason").isNotNull(), F.col("quality_reason")).otherwise(F.col("exclude_reason"))).drop("quality_reason")
    keep = rows.where("exclude_reason = ''").orderBy("pick").limit(limit).select("fund_code", "pick", F.lit(True).alias("in"))
    audit = rows.join(keep.select("fund_code", "in"), "fund_code", "left")
    audit = audit.withColumn("exclude_reason", F.when((F.col("exclude_reason") == "") & F.col("in").isNull(), "UNIVERSE_LIMIT").otherwise(F.col("exclude_reason")))
    return audit.withColumn("status", F.when(F.col("exclude_reason") == "", "retained").otherwise("excluded")).drop("in"), keep.drop("in")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue in CSV files with a header, all strings, normalised; a code's first row stays."""
    return normalize_catalog(with_position(spark.read.csv(path, header=True)))


def universe_summary(audit: DataFrame) -> DataFrame:
    reason = F.when(F.col("exclude_reason") == "", "RETAINED").otherwise(F.col("exclude_reason"))
    return audit.groupBy(reason.alias("exclude_reason")).agg(F.count("*").alias("funds")).orderBy(F.desc("funds"), "exclude_reason")


def universe_review(audit: DataFrame) -> DataFrame:
    odd = F.col("exclude_reason").isin("UNKNOWN_SHARE_CLASS", "METADATA_MISSING", "NAME_COLLISION")
    return audit.where(odd | (F.col("metadata_warning") != "") if "metadata_warning" in audit.columns else odd)


def retained_funds(audit: DataFrame) -> DataFrame:
    """RETAINED_COLUMNS of the funds that a finalised audit retains, by code."""
    return audit.where("status = 'retained'").select(*RETAINED_COLUMNS).orderBy("fund_code")


def write_universe(audit: DataFrame, keep: DataFrame, folder: str) -> None:
    """The audit, the kept codes, what is to be reviewed, the summary and, once finalised, the retained funds, as tables under
    ``folder``."""
    audit = materialised(audit)
    tables = {"audit": audit.select(*AUDIT_COLUMNS), "pool": keep.select("fund_code"), "review": universe_review(audit).select(*AUDIT_COLUMNS), "summary": universe_summary(audit)}
    if audit.where("status = 'candidate'").isEmpty():
        tables["retained"] = retained_funds(audit)
    for name, table in tables.items():
        write_result(table, f"{folder}/{name}")
