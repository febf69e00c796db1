"""Cover patterns: sums added up by tasks against sums on the driver and against plain loops over rows."""

import os

import numpy as np
import pytest

from sieveline.model import Condition
from sieveline.operators import patterns, post
from sieveline.operators.tables import shared_folder


@pytest.fixture(scope="module")
def covered(spark):
    """Rows of 60 subgroups that overlap irregularly: nearly every row is a pattern of its own; nulls and repeats included."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 4))
    rows = [tuple(float(v) for v in r) for r in x] + [(None, 0.5, None, 0.1)] * 3 + [tuple(float(v) for v in x[0])] * 4
    groups = [(Condition(f"x{i % 4}", "<=" if i % 3 else ">=", float(rng.normal())), Condition(f"x{(i + 1) % 4}", ">=", float(rng.normal() - 1))) for i in range(59)] + [(Condition("x0", ">=", 99.0),)]
    holds = lambda r, c: r[int(c.attribute[1])] is not None and (r[int(c.attribute[1])] <= c.value if c.operator == "<=" else r[int(c.attribute[1])] >= c.value)
    cover = np.array([[all(holds(r, c) for c in g) for g in groups] for r in rows])
    return spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double").repartition(3), groups, cover


def written(spark):
    return sorted(x for x in os.listdir(shared_folder(spark).replace("file:", "")) if x.startswith("written-"))


def _entropy(cover):
    _, n = np.unique(cover, axis=0, return_counts=True)
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum())


@pytest.mark.parametrize("local", [patterns.LOCAL, 0])
def test_sums_match_plain_loops(covered, local):
    df, groups, cover = covered
    with patterns.Patterns(df, groups, local) as p:
        assert (p.own is None) == (local == 0) and p.rows() == len(cover)
        for chosen in ([], [3], [3, 7, 11]):
            times = cover[:, chosen].sum(1)
            assert p.by_times(chosen).tolist() == [[int((cover[:, i] & (times == t)).sum()) for t in range(len(chosen) + 1)] for i in range(60)]
            assert p.entropies(chosen) == pytest.approx([_entropy(cover[:, [*chosen, i]]) for i in range(60)], abs=1e-6)
        assert p.together([2, 9]).tolist() == (cover.T.astype(int) @ cover[:, [2, 9]].astype(int)).tolist()
        assert p.times().tolist() == np.bincount(cover.sum(1), minlength=61).tolist() and p.entropy() == pytest.approx(_entropy(cover))


def test_choices_are_the_same_on_both_ways(covered, spark, monkeypatch):
    df, groups, cover = covered
    rows = [{"conditions": g, "quality": 1.0 + 0.01 * (i % 7)} for i, g in enumerate(groups)]
    plain, left, times = [], list(range(60)), np.zeros(len(cover))
    while len(plain) < 8:
        best = max(left, key=lambda i: (rows[i]["quality"] * (0.9**times)[cover[:, i]].sum() / max(1, cover[:, i].sum()), -i))
        plain.append(best)
        left.remove(best)
        times += cover[:, best]
    results, before = [], written(spark)
    for local in (patterns.LOCAL, 0):
        monkeypatch.setattr(patterns.Patterns.__init__, "__defaults__", (local,))
        team = post.pattern_team(df, rows, 4)
        results.append((post.cover_choice(df, rows, 8)[0], team, post.group_by_team(df, rows, team), post.cover_redundancy(df, rows)[0]))
    assert results[0] == results[1] and results[0][0] == plain
    team = results[0][1]
    with np.errstate(invalid="ignore"):
        phi = np.abs(np.nan_to_num(np.corrcoef(cover.T.astype(float))))
    assert all(phi[i, own] == pytest.approx(phi[i, team].max()) for i, own in enumerate(results[0][2]))
    assert written(spark) == before


def test_empty_tables_and_lists(covered):
    df, groups, _ = covered
    for local in (patterns.LOCAL, 0):
        with patterns.Patterns(df.where("false"), groups, local) as p:
            assert p.rows() == 0 and not p.by_times([1]).any() and not p.entropies([1]).any()
    assert post.pattern_team(df, [], 3) == [] and post.group_by_team(df, [], []) == [] and post.cover_choice(df, [], 3) == ([], True)
