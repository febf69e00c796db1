"""Kendall's tau by ranges against all pairs."""

import random

import numpy as np
import pytest

from sieveline.operators import rank_agreement


def plain(rows):
    sign = lambda x: (x > 0) - (x < 0)
    return sum(sign(p[0] - q[0]) * sign(p[1] - q[1]) for i, p in enumerate(rows) for q in rows[:i])


def test_agreement_of_arrays():
    rng = random.Random(3)
    for n, values in ((0, 5), (1, 5), (2, 2), (50, 4), (200, 1000), (300, 7)):
        rows = [(rng.randrange(values), rng.randrange(values)) for _ in range(n)]
        a, b = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
        assert rank_agreement.agreement(a, b) == plain(rows)


@pytest.mark.parametrize("size", [20, 10_000])
def test_tau_of_a_table(spark, monkeypatch, size):
    """With many ranges and with one; a third of the rows has one value in each column."""
    monkeypatch.setattr(rank_agreement, "RANGE_ROWS", size)
    rng = random.Random(6)
    rows = [(5.0 if rng.random() < 0.35 else float(rng.randrange(60)), 2.0 if rng.random() < 0.35 else float(rng.randrange(40))) for _ in range(400)]
    rows += [(x, x) for x in map(float, range(80))]
    df = spark.createDataFrame(rows + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "x double, y double")
    tau, n = rank_agreement.kendall(df, "x", "y")
    assert n == 480 and tau == plain(rows) / (480 * 479 // 2)
    assert rank_agreement.kendall(df.limit(0), "x", "y") == (None, 0)
