"""Numbers and ranks within keys by ranges of rows, against plain sorting."""

import random
from datetime import date

import pytest

from fundlake.operators import diagnostics, ranks

RND = random.Random(9)


@pytest.fixture(scope="module")
def table(spark):
    """A key with most rows, a value that half of them share, small keys, a null key, null values."""
    rows = [("big", RND.choice([0.5, 0.5, RND.random()]), f"{k:05}") for k in range(4000)]
    rows += [(f"k{k % 7}", RND.random(), f"{k:05}") for k in range(90)] + [(None, 1.0, "a"), (None, 0.5, "b"), ("k1", None, "n")]
    RND.shuffle(rows)
    return spark.createDataFrame(rows, "g string, x double, code string").repartition(5).cache(), rows


def _order(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        out |= {(g, r[2]): k for k, r in enumerate(own, 1)}
    return out


@pytest.mark.parametrize("held", [ranks.HELD, 100])
def test_row_numbers(table, held):
    df, rows = table
    got = {(r.g, r.code): r.i for r in ranks.row_numbers(df, ["g"], ["x", "code"], "i", held).collect()}
    assert got == _order(rows)


@pytest.mark.parametrize("held", [ranks.HELD, 100])
def test_average_ranks(table, held):
    df, rows = table
    number = _order(rows)
    got = {(r.g, r.code): r.rank for r in ranks.average_ranks(df, ["g"], "x", "code", "rank", held).collect()}
    for g, x, code in rows:
        same = [number[g, c] for h, y, c in rows if (h, y) == (g, x)] if g != "big" else None
        if same:
            assert got[g, code] == (min(same) + max(same)) / 2
    big = sorted(x for g, x, _ in rows if g == "big")
    for g, x, code in rows:
        if g == "big" and x != 0.5:
            assert got[g, code] == big.index(x) + 1
    half = [k for k, x in enumerate(big, 1) if x == 0.5]
    assert {v for (g, c), v in got.items() for h, x, d in rows if (g, c) == (h, d) == ("big", d) and x == 0.5} == {(half[0] + half[-1]) / 2}


def test_no_task_holds_a_large_key(spark, table):
    """Where Spark doesn't join small partitions, the large key's rows lie in several, and numbers are right across them."""
    df, rows = table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranks.by_ranges(df, ["g"], ["x", "code"]).where("g = 'big'").groupBy("_part").count().collect()]
        out = {(r.g, r.code): r.i for r in ranks.row_numbers(df, ["g"], ["x", "code"], "i", 100).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2500 and out == _order(rows)


@pytest.mark.parametrize("held", [ranks.HELD, 5])
def test_groups(spark, held):
    """Bins of the ranks' quantiles; too few funds, too few values and dates without forward returns have none."""
    day = [date(2024, 1, k) for k in (1, 2, 3)]
    signals = [(day[0], f"{k:02}", "a", float(k % 9), -1.0) for k in range(12)] + [(day[0], f"{k:02}", "b", float(k // 6), 1.0) for k in range(12)] + [(day[1], f"{k:02}", "a", float(k), 1.0) for k in range(9)]
    forward = [(day[0], f"{k:02}", 0.01 * k) for k in range(12)] + [(day[1], f"{k:02}", 0.5) for k in range(9)]
    got = diagnostics.factor_groups(spark.createDataFrame(signals, "as_of date, fund_code string, factor string, x double, sign double"), spark.createDataFrame(forward, "as_of date, fund_code string, forward_ret double"), 5, held)
    order = sorted(range(12), key=lambda k: (-(k % 9), k))
    bins = [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    want = {b: [0.01 * k for k, c in zip(order, bins, strict=True) if c == b] for b in range(1, 6)}
    assert {(r.as_of, r.factor, r.bin): (r.mean_forward, r.funds) for r in got.collect()} == {(day[0], "a", b): (pytest.approx(sum(v) / len(v)), len(v)) for b, v in want.items()}
