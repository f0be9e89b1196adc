"""Readers, code rules, universe sources and the first of several rows, with exact results."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fundlake.functions.codes import base_name, share_class
from fundlake.operators import factors, universe
from fundlake.sources import nav as sources

D = date.fromisoformat


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_read_nav_resolves_columns(spark, tmp_path):
    """The first alias in the list's order counts, optional columns may be missing, daily_return goes by its own name alone."""
    spark.createDataFrame([("1", "2024-01-02", "1.5", "x", "0.1")], ["基金代码", "净值日期", "净值", "单位净值", "日增长率"]).write.csv(f"{tmp_path}/a", header=True)
    got = sources.read_nav(spark, f"{tmp_path}/a", "csv").drop(sources.POSITION)
    assert got.columns == ["fund_code", "date", "nav", "acc_nav", "daily_return"] and _rows(got) == [("1", "2024-01-02", "x", None, None)]
    spark.createDataFrame([("1", D("2024-01-02"), 1.5, 2.5, 0.1)], "code string, trade_date date, nav double, adjusted_nav double, daily_return double").write.parquet(f"{tmp_path}/b")
    assert _rows(sources.read_nav(spark, f"{tmp_path}/b").drop(sources.POSITION)) == [("1", D("2024-01-02"), 1.5, 2.5, 0.1)]


def test_resolve_nav_source_prefers_tables(spark):
    make = lambda **cols: spark.createDataFrame([tuple(cols.values())], list(cols))
    tables = {"other": make(code="o", date="d", nav=1.0), "fund_nav": make(code="late", date="d", nav=1.0), "fund_data_raw": make(code="early", date="d", nav=1.0), "fund_nav_daily": make(code="no nav", date="d")}
    assert sources.resolve_nav_source(tables).first().fund_code == "early"
    assert sources.resolve_nav_source({"z": make(code="z", date="d", nav=1.0), "other": tables["other"]}).first().fund_code == "z"
    with pytest.raises(ValueError, match="no table"):
        sources.resolve_nav_source({"x": make(code="x", date="d")})


def test_the_first_row_is_that_of_the_file(spark, tmp_path):
    """Of rows with one key the first in the file stays, also where the file is read in many parts."""
    rnd = random.Random(2)
    lines = [(f"{rnd.randrange(40):06}", f"2024-01-{rnd.randrange(1, 28):02}", round(rnd.uniform(1, 9), 4)) for _ in range(6000)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/nav.csv").write_text("fund_code,date,nav\n" + "".join(f"{c},{d},{v}\n" for c, d, v in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        raw = sources.read_nav(spark, f"{tmp_path}/n", "csv")
        assert raw.rdd.getNumPartitions() > 4
        got = {(r.fund_code, str(r.date)): r.nav for r in sources.load_nav(raw.withColumn("date", F.to_date("date")), order=sources.POSITION).collect()}
        codes = [r.fund_code for r in sources.read_universe(spark, f"{tmp_path}/n").orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for c, d, v in lines:
        want.setdefault((c, d), v)
    assert got == want and codes == list(dict.fromkeys(c for c, _, _ in lines))


def test_merge_nav_feeds(spark):
    unit = spark.createDataFrame([("1", "d1", 1.0, 9.0, 0.1), ("1", "d2", 2.0, None, None), ("2", "d1", 3.0, None, None)], "fund_code string, date string, nav double, acc_nav double, daily_return double")
    more = spark.createDataFrame([("1", "d1", 5.0), ("2", "d2", 6.0)], "fund_code string, date string, acc_nav double")
    assert _rows(sources.merge_nav_feeds(unit, more)) == [("1", "d1", 1.0, 5.0, 0.1), ("1", "d2", 2.0, None, None), ("2", "d1", 3.0, None, None)]


def test_extract_codes(spark):
    """A known name comes first, else the first column that has a code, else the first; six digits in a row, others are lost."""
    named = spark.createDataFrame([(1, "999999", "x000002y"), (0, "888888", "1"), (2, "777777", "000001")], "o int, other string, `基金代码` string")
    assert _rows(sources.extract_codes(named, "o")) == [("000001", 2), ("000002", 1)]
    unnamed = spark.createDataFrame([("a", "b 123456 c", "654321")], "p string, q string, r string")
    assert [r.fund_code for r in sources.extract_codes(unnamed).collect()] == ["123456"]
    assert sources.extract_codes(spark.createDataFrame([("a", "b")], "p string, q string")).count() == 0


def test_load_universe_fills_up(spark):
    one = spark.createDataFrame([(0, "000003"), (1, "000001"), (2, "000003")], "o int, fund_code string")
    first = sources.extract_codes(one, "o").select("fund_code", F.col("pos").alias(sources.POSITION))
    second = spark.createDataFrame([("b", "000001"), ("a", "000009"), ("c", "000007")], f"{sources.POSITION} string, symbol string")
    got = [(r.fund_code, r.source, r.pos) for r in sources.load_universe([first, second], 3).orderBy("pos").collect()]
    assert got == [("000003", 0, 0), ("000001", 0, 1), ("000009", 1, 2)]
    assert sources.load_universe([first, second], 1).count() == 1 and sources.load_universe([first], 9).count() == 2


def test_drop_null_nav_and_renamed_factors(spark):
    rows = spark.createDataFrame([("1", None, 1.0), ("1", "d", None), ("1", "d", 2.0)], "fund_code string, date string, nav double")
    assert _rows(sources.drop_null_nav(rows)) == [("1", "d", 2.0)]
    old = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], ["annual_return", "annual_vol", "downside_vol", "max_drawdown", "information_ratio", "ann_vol"])
    assert factors.rename_factor_columns(old).columns == ["ann_return", "annual_vol", "down_vol", "mdd", "ir", "ann_vol"]


def test_min_history_and_since_fall_back(spark):
    rows = [("a", D(f"2020-01-{k:02}"), 1.0, None, None) for k in (1, 2, 3)] + [("b", D("2020-06-01"), 1.0, None, None)]
    nav = spark.createDataFrame(rows, "fund_code string, date date, nav double, acc_nav double, daily_return double")
    assert {r.fund_code for r in sources.load_nav(nav, min_history=2).collect()} == {"a"}
    assert {r.fund_code for r in sources.load_nav(nav, min_history=9).collect()} == {"a", "b"}  # none has so many: all stay
    assert sources.load_nav(nav, since="2020-02-01").count() == 1  # some row is as late
    assert sources.load_nav(nav, since="2021-01-02").count() == 2  # none is: 365 days before, 2020-01-03 at the earliest
    assert sources.load_nav(nav, since="2022-01-01").count() == 0


def test_share_classes_and_names(spark):
    names = {"示例Ａ混合 a ": "A", "示例(C)": "C", "示例（B）": "B", "示例 ( A )": "A", "示例　C　": "C", "示例(后端)A": "B", "示例（ 后端 ）": "B", "示例ETF": "original", "A": "A", "": "original", "示例)": "original", "示例A))": "original"}
    df = spark.createDataFrame([(k,) for k in names] + [(None,)], "n string")
    got = {r.n: r.c for r in df.select("n", share_class(F.col("n")).alias("c")).collect()}
    assert got == names | {None: "original"}
    bases = {"示例混合A": "示例混合", "示例混合 (c)": "示例混合", "示例 混合（后端）": "示例混合", "示例混合(后端)B": "示例混合", "示例混合（A）": "示例混合", "示例ETF": "示例ETF", "A": "", "x)": "X)"}
    df = spark.createDataFrame([(k,) for k in bases], "n string")
    assert {r.n: r.b for r in df.select("n", base_name(F.col("n")).alias("b")).collect()} == bases


def _catalogue(spark):
    rows = [
        ("000001", "甲混合A", "股票型", "2001-01-01"), ("000002", "甲混合C", "股票型", "2001-01-01"), ("000003", "乙混合(后端)", "股票型", "2001-01-01"), ("000004", "丙", "债券型", "2001-01-01"),
        ("000005", "丁ETF", "股票型", "2001-01-01"), ("000006", "戊", "股票型", "2030-01-01"), ("000007", "己", "股票型", ""), ("000008", "庚", "股票型", "2001-01-01"), ("000009", "辛", "股票型", "2001-01-01"),
        ("000010", "壬", "股票型", "2001-01-01"), ("000011", "癸", "股票型", "2001-01-01"), ("000012", "", "混合型-偏股", "2001-01-01"), ("000013", None, "混合型-偏股", "2001-01-01"), ("000014", "子", "股票型", "2001-01-01"), ("000014", "第二行", "债券型", ""),
    ]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "o int, code string, name string, type string, `date` string")


def test_every_exclude_reason(spark, tmp_path):
    """Each reason once, in the order in which they are tried; the audit written as it should be."""
    catalog = universe.normalize_catalog(_catalogue(spark), "o")
    days = [date.fromordinal(D("2020-01-01").toordinal() + k) for k in range(300)]
    nav = []
    for code, n, flat in (("000001", 300, False), ("000007", 300, False), ("000008", 100, False), ("000009", 270, False), ("000010", 300, True), ("000012", 300, False), ("000014", 300, False)):
        nav += [(code, d, 1.0 if flat else 1.0 + 0.01 * (k % 7)) for k, d in enumerate(days[:n])]
    nav = spark.createDataFrame(nav, "fund_code string, date date, nav double")
    info = spark.createDataFrame([("000001", "基金公司", "某公司"), ("000001", "基金名称", " "), ("000004", "基金公司", "没有"), ("000012", "成立时间", "2002-02-02")], "code string, item string, value string")
    audit, keep = universe.build_universe(catalog, nav, "2019-01-01", "2020-12-31", limit=3, candidate_limit=20, seed=1, info=info, warn=True, as_of="2024-01-01")
    got = {r.fund_code: (r.exclude_reason, r.status) for r in audit.collect()}
    reasons = {k: v[0] for k, v in got.items()}
    free = ["000001", "000007", "000012", "000014"]
    assert {k: v for k, v in reasons.items() if k not in free} == {
        "000002": "DUPLICATE_SHARE", "000003": "B_SHARE", "000004": "TYPE_NOT_ALLOWED", "000005": "SPECIAL_PRODUCT", "000006": "INCEPTION_AFTER_BACKTEST_START", "000008": "HISTORY_TOO_SHORT",
        "000009": "LOW_COVERAGE", "000010": "SUSPICIOUS_ZERO_RETURN", "000011": "NO_NAV", "000013": "DUPLICATE_SHARE",
    }
    assert sorted(reasons[k] for k in free) == ["", "", "", "UNIVERSE_LIMIT"] and {r.fund_code for r in keep.collect()} == {k for k in free if reasons[k] == ""}
    rows = {r.fund_code: r for r in audit.collect()}
    assert rows["000001"].fund_company == "某公司" and rows["000001"].fund_name == "甲混合A" and rows["000004"].fund_company == "" and rows["000012"].inception_date == "2002-02-02"
    assert {r.fund_code for r in universe.universe_review(audit).collect()} == {"000007"}  # the only one without an inception date
    universe.write_universe(audit, keep, f"{tmp_path}/u")
    assert tuple(spark.read.parquet(f"{tmp_path}/u/audit").columns) == universe.AUDIT_COLUMNS and spark.read.parquet(f"{tmp_path}/u/review").count() == 1
    retained = spark.read.parquet(f"{tmp_path}/u/retained")
    assert tuple(retained.columns) == universe.RETAINED_COLUMNS and sorted(r.fund_code for r in retained.collect()) == sorted(k for k in free if reasons[k] == "")
    assert {r.exclude_reason: r.funds for r in spark.read.parquet(f"{tmp_path}/u/summary").collect()}["RETAINED"] == 3


def test_prepare_stage(spark, tmp_path):
    catalog = universe.normalize_catalog(_catalogue(spark), "o")
    audit, keep = universe.build_universe(catalog, None, "2019-01-01", "2020-12-31", limit=2, candidate_limit=4, stage="prepare", as_of="2024-01-01")
    assert set(universe.AUDIT_COLUMNS) <= set(audit.columns) and audit.where("data_start is not null or nav_days is not null").isEmpty()
    reasons = {r.fund_code: (r.exclude_reason, r.status) for r in audit.collect()}
    assert sum(s == "candidate" for _, s in reasons.values()) == keep.count() <= 4 and ("CANDIDATE_LIMIT", "excluded") in reasons.values()
    universe.write_universe(audit, keep, f"{tmp_path}/u")
    assert not (tmp_path / "u/retained").exists() and spark.read.parquet(f"{tmp_path}/u/pool").columns == ["fund_code"]
    with pytest.raises(ValueError, match="no code column"):
        universe.normalize_catalog(spark.createDataFrame([(1,)], "x int"))
