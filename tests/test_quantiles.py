"""Quantiles, running sums and places from counts by value, in one range and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import tables


@pytest.fixture(params=[20_000, 0])
def ranges(request, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", request.param)
    monkeypatch.setattr(tables, "IN_RANGE", 2)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(x)) for k, n in (("a", 901), ("b", 40), ("c", 1)) for x in np.round(rng.normal(size=n) * 20, 1)]
    rows += [("a", 7.0)] * 500 + [("d", None), ("a", None), ("b", float("nan"))]
    return rows, spark.createDataFrame(rows, "k string, x double")


def known(rows, key=None):
    return np.array([x for k, x in rows if x is not None and x == x and key in (None, k)])


def test_quantiles(values, ranges):
    rows, df = values
    shares = {"least": 0.0, "q1": 0.25, "some": 0.333, "half": 0.5, "most": 1.0}
    for r in tables.quantiles(tables.counted(df, "x", ("k",)), "v", "n", shares, ("k",)).collect():
        assert [r[n] for n in shares] == pytest.approx(list(np.quantile(known(rows, r["k"]), list(shares.values()))))
    assert list(tables.quantiles(tables.counted(df, "x"), "v", "n", shares).first()) == pytest.approx(list(np.quantile(known(rows), list(shares.values()))))


def test_medians(values, ranges):
    rows, df = values
    found = {r["k"]: (r["median"], r["mad"]) for r in tables.medians(df, "x", ("k",)).collect()}
    assert set(found) == {"a", "b", "c"}
    for k, (median, mad) in found.items():
        x = known(rows, k)
        assert (median, mad) == pytest.approx((np.median(x), np.median(np.abs(x - np.median(x)))))


def test_described(values, spark):
    rows, df = values
    r, x = tables.described(df, "x").first(), known(rows)
    assert (r["n"], r["median"], r["iqr"], r["sd"]) == pytest.approx((len(x), np.median(x), np.subtract(*np.quantile(x, [0.75, 0.25])), x.std(ddof=1)))
    empty = tables.described(df.where("false"), "x").first()
    assert empty["n"] == 0 and empty["median"] is None and empty["iqr"] is None


def test_running(values, ranges):
    rows, df = values
    for r in tables.running(tables.counted(df, "x", ("k",)), "v", ["n"], ("k",), ascending=False).collect():
        assert r["run_n"] == (known(rows, r["k"]) >= r["v"]).sum()


def test_range_of(spark):
    cuts = [float(i * i) for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 99.0, 100.0, 998001.0, 1e9, 480249.0)], "x double")
    assert [r[0] for r in df.select(tables.range_of(F.col("x"), cuts)).collect()] == [sum(c <= x for c in cuts) for (x,) in df.collect()]


@pytest.mark.parametrize("small", [20_000, 10])
def test_base_intervals_match_a_plain_scan(spark, monkeypatch, small):
    """Runs of neighbouring values with one share of positives, by one task and by ranges of values; missing numbers take no part."""
    monkeypatch.setattr(tables, "SMALL", small)
    rng = np.random.default_rng(2)
    rows = [(float(v), bool(rng.random() < 0.5)) for v in rng.integers(0, 300, 700)] + [(None, True), (float("nan"), True)]
    seen: dict = {}
    for v, hit in rows[:-2]:
        n, h = seen.get(v, (0, 0))
        seen[v] = n + 1, h + hit
    plain: list = []
    for v in sorted(seen):
        n, h = seen[v]
        if plain and plain[-1][3] == h / n:
            plain[-1] = [v, plain[-1][1] + n, plain[-1][2] + h, h / n]
        else:
            plain.append([v, n, h, h / n])
    df = spark.createDataFrame(rows, "x double, hit boolean")
    assert sorted(tuple(r) for r in tables.base_intervals(df, "x", F.col("hit")).collect()) == [tuple(map(float, p[:3])) for p in plain]
    assert tables.base_intervals(df.where("false"), "x", F.col("hit")).count() == 0
