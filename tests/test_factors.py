"""Factors by merged segments, correlations as sums of products, and exact quantiles, against plain loops."""

import math
import random
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlake.operators import diagnostics, factors, quality, quantiles, returns, scoring

RND = random.Random(7)
DAY = date(2024, 1, 1)


def _returns(spark, wild):
    """Funds with gaps, a short one, one that stops early, one of constants, one that only rises; if wild also total losses."""
    rows = []
    for fund, n in (("A", 120), ("B", 90), ("C", 4), ("D", 30), ("E", 60), ("F", 60), *([("G", 60), ("H", 60)] if wild else [])):
        days = sorted(RND.sample(range(120 if fund != "D" else 45), n))
        for k, d in enumerate(days):
            x = {"E": 0.01, "F": RND.uniform(0.001, 0.02)}.get(fund, RND.gauss(0, 0.02))
            if fund == "G" and k in (5, 20, 21):
                x = -1.0
            if fund == "H" and k % 17 == 3:
                x = -1.5
            rows.append((fund, DAY + timedelta(days=d), x))
    return spark.createDataFrame(rows, "fund_code string, date date, ret double"), rows


def _sd(xs):
    m = math.fsum(xs) / len(xs)
    return math.sqrt(math.fsum((x - m) ** 2 for x in xs) / len(xs))


def _expected(rows, as_ofs, window, required, bench):
    out = {}
    for fund in {r[0] for r in rows}:
        own = sorted((d, x) for f, d, x in rows if f == fund)
        for r in as_ofs:
            held = [(d, x) for d, x in own if d <= r][-window:]
            if len(held) < required:
                continue
            xs, ex = [x for _, x in held], [x - bench[d] for d, x in held if d in bench]
            w, top, deep = 1.0, -math.inf, None
            for x in xs:
                w *= 1 + x
                top = max(top, w)
                deep = deep if top == 0 else min(deep, w / top) if deep is not None else w / top
            loss, sd = [x for x in xs if x < 0], _sd(xs) if len(set(xs)) > 1 else 0.0
            out[fund, r] = (252 * math.fsum(xs) / len(xs), sd * math.sqrt(252), _sd(loss) * math.sqrt(252) if loss else None, None if deep is None else deep - 1, math.fsum(xs) / len(xs) / sd * math.sqrt(252) if sd else None, math.fsum(ex) / len(ex) / _sd(ex) * math.sqrt(252) if ex and _sd(ex) > 1e-15 else None)
    return out


@pytest.mark.parametrize(("wild", "window", "required", "in_order"), [(False, 20, 20, False), (False, 20, 20, True), (True, 20, 20, False), (False, 50, 7, False), (True, 7, 2, False), (False, 200, 3, False)])
def test_factors_are_those_of_each_window(spark, wild, window, required, in_order):
    """Whole buckets, windows over two, funds shorter than a window, periods without rows, dates without a benchmark."""
    df, rows = _returns(spark, wild)
    as_ofs = [DAY + timedelta(days=d) for d in (3, 10, 25, 44, 60, 61, 90, 119, 200)]
    bench = {d: 0.001 * (d.day % 5) for _, d, _ in rows if d.day != 9}
    got = factors.compute_factors(df, spark.createDataFrame(list(bench.items()), "date date, bench_ret double"), spark.createDataFrame([(d,) for d in as_ofs], "as_of date"), window, required, in_order)
    want = _expected(rows, as_ofs, window, required, bench)
    found = {(r.fund_code, r.as_of): tuple(r[2:]) for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 5
    for k, v in want.items():
        for name, x, y in zip(factors.FACTORS, found[k], v, strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-10)), (k, name)


def test_no_look_ahead(spark):
    df, _ = _returns(spark, False)
    bench = returns.equal_weight_benchmark(df)
    r = DAY + timedelta(days=70)
    dates = spark.createDataFrame([(r,)], "as_of date")
    cut = df.where(F.col("date") <= r)
    run = lambda x: sorted(map(str, factors.compute_factors(x, bench, dates, 20).collect()))
    assert run(df) == run(cut)


def test_one_shuffle_of_the_returns(spark):
    """Returns are dealt by fund, and not again: the other exchanges are of dates and rebalances."""
    df, _ = _returns(spark, False)
    bench = returns.equal_weight_benchmark(df)
    out = factors.compute_factors(df, bench, spark.createDataFrame([(DAY,)], "as_of date"), 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(fund_code") == 1


def test_no_large_value_spoils_later_windows():
    """A return of a million before a window leaves no trace in it, also in the same bucket."""
    rng = np.random.default_rng(1)
    ret = rng.normal(0, 0.01, 95)
    ends = np.arange(19, 95)
    clean = factors.fund_factors(ret, ret, ends, 20, False)
    spoilt = ret.copy()
    spoilt[3] = 1e6
    got = factors.fund_factors(spoilt, spoilt, ends, 20, False)
    for x, y in zip(clean, got, strict=True):
        assert np.allclose(x[ends >= 23], y[ends >= 23], rtol=1e-9, atol=1e-12)


def _rank(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def _spearman(a, b):
    a, b = _rank(a), _rank(b)
    return statistics.correlation(a, b) if len(set(a)) > 1 and len(set(b)) > 1 else None


def test_correlations(spark):
    """Ties at their mean, a constant factor, two funds, values that only one of a pair has, no fund at all."""
    rows = []
    for k in range(6):
        for f in range((2, 12, 12, 12, 12, 30)[k]):
            x = [RND.choice([0.1, 0.2, 0.2, 0.3, RND.random()]) for _ in factors.FACTORS]
            if k == 2:
                x[1] = 0.5
            if k == 3:
                x[2] = None if f % 3 == 0 else x[2]
                x[4] = None if f == 1 else x[4]
            if k == 4:
                x[0] = None
            rows.append((DAY + timedelta(days=k), f"{f:02}", *x))
    df = spark.createDataFrame(rows, "as_of date, fund_code string, " + ", ".join(f"{f} double" for f in factors.FACTORS))
    want = {}
    for d in {r[0] for r in rows}:
        for i, a in enumerate(factors.FACTORS):
            for j, b in list(enumerate(factors.FACTORS))[i + 1 :]:
                both = [(r[2 + i], r[2 + j]) for r in rows if r[0] == d and r[2 + i] is not None and r[2 + j] is not None]
                c = _spearman(*zip(*both, strict=True)) if len(both) >= 3 else None
                if c is not None:
                    want[d, a, b] = (pytest.approx(c), len(both))
    got = {(r.as_of, r.factor_a, r.factor_b): (r.correlation, r.n) for r in diagnostics.factor_correlation(df).collect()}
    assert got == want and diagnostics.factor_correlation(df.limit(0)).count() == 0


def _quantile(xs, p):
    xs = sorted(xs)
    v = (len(xs) - 1) * p
    lo = math.floor(v)
    return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (v - lo)


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_exact_quantiles(spark, accuracy):
    """Ties that a third of the group are, one value, nulls, quantiles at both ends, brackets that miss."""
    groups = {"u": [RND.random() for _ in range(3000)], "t": [0.5] * 900 + [RND.gauss(0, 1) for _ in range(1800)], "one": [4.0], "two": [1.0, 2.0], "c": [3.0] * 50, "i": [float(k) for k in range(1001)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("u", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r.g: list(r)[1:] for r in quantiles.exact_quantiles(df, ["g"], "x", shares, accuracy).collect()}
    assert got == {g: [pytest.approx(_quantile(xs, p), abs=1e-12) for p in shares] for g, xs in groups.items()}


def _sections(spark):
    values = {"four": [1.0, 2.0, 3.0, 100.0], "five": [1.0, 2.0, 3.0, 4.0, 100.0], "null": [1.0, None, 2.0, 3.0, 9.0, 4.0], "flat": [2.0] * 6, "mad0": [1.0] * 9 + [1.5, 9.0], "one": [7.0], "none": [None, None], "many": [RND.gauss(0, 1) for _ in range(400)]}
    return spark.createDataFrame([(DAY, f, f"{k:03}", x) for f, xs in values.items() for k, x in enumerate(xs)], "as_of date, factor string, fund_code string, x double"), values


@pytest.mark.parametrize("held", [scoring.HELD, 3])
def test_standardised(spark, held):
    """Below five values nothing is clipped; a median distance of 0 gives way to the deviation, that to the distance alone. Gathered
    in rows or by distributed quantiles, the values are the same."""
    df, values = _sections(spark)
    got = {(r.factor, r.fund_code): (r.w, r.z) for r in scoring.mad_zscore(df, held).collect()}
    assert len(got) == sum(map(len, values.values()))
    for f, xs in values.items():
        known = [x for x in xs if x is not None]
        lo, hi = (_quantile(known, 0.01), _quantile(known, 0.99)) if len(known) >= 5 else (-math.inf, math.inf)
        w = [min(max(x, lo), hi) for x in known]
        med = _quantile(w, 0.5) if w else None
        mad = _quantile([abs(x - med) for x in w], 0.5) if w else None
        mean, sd = (math.fsum(w) / len(w), _sd(w)) if w else (None, None)
        for k, x in enumerate(xs):
            if x is None:
                assert got[f, f"{k:03}"] == (None, None)
                continue
            c = min(max(x, lo), hi)
            z = (c - med) / (1.4826 * mad) if mad > 0 else (c - mean) / sd if sd > 1e-15 else c - mean
            assert got[f, f"{k:03}"] == (pytest.approx(c), pytest.approx(z, abs=1e-9)), f


def test_scores(spark):
    """Only sharpe on demand, weights of zero, a factor that is all alike, one that a fund lacks, schemes apart."""
    rows = [(DAY, f"{k}", float(k), 5.0, None if k == 2 else -float(k), 0.1 * k * k) for k in range(6)]
    f = spark.createDataFrame(rows, "as_of date, fund_code string, ann_return double, ann_vol double, mdd double, sharpe double")
    table = scoring.scheme_table(spark, {"a": {"ann_return": 1.0, "ann_vol": 0.5}, "b": {"mdd": 0.5, "sharpe": 0.5}, "flat": {"ann_vol": 1.0}, "zero": {"sharpe": 0.0, "ann_vol": 1.0}})
    for held in (scoring.HELD, 2):
        got = {(r.scheme, r.fund_code): r for r in scoring.score_funds(f, table, held=held).collect()}
        assert {k[0] for k in got} == {"a", "b", "zero"} and len(got) == 18
        assert [k[1] for k in sorted((r.rank, r.fund_code) for (s, _), r in got.items() if s == "a")] == ["5", "4", "3", "2", "1", "0"]
        assert got["b", "2"].score is None and got["b", "2"].rank == 6 and got["b", "1"].z_mdd is not None
        assert got["a", "5"].score == round(2.5 / (1.4826 * 1.5) * 1 if False else got["a", "5"].z_ann_return, 10) and got["a", "5"].z_ann_vol is None and got["a", "5"].z_sharpe is None
        assert {r.score for (s, _), r in got.items() if s == "zero"} == {0.0}
    only = scoring.score_funds(f, scoring.scheme_table(spark, {"m": {"ann_return": 1.0, "sharpe": 1.0}}), pure_sharpe_only=True).collect()
    assert all(r.z_ann_return is None and r.score == round(r.z_sharpe, 10) for r in only)
    few = quality.check_scores(scoring.score_funds(f, table).where("scheme = 'a'"), 6, 5, factors=True)
    assert few.count() == 0
    bare = spark.createDataFrame([(DAY, "1", 0.5, 1)], "as_of date, fund_code string, score double, rank int")
    assert {r.check for r in quality.check_scores(bare, 1, 1, factors=True).collect()} == {"few_values", "no_factors"}
