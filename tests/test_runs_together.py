"""Runs of one search find what each finds alone; permuted targets are permutations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.model import Settings, Target, text_of
from sieveline.operators import post, runs_together, validation
from sieveline.operators.search import SubgroupDiscovery, per_target_value

TARGET = Target("single_nominal", ("t",), "a")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 12)), None if i % 37 == 0 else "xyz"[rng.integers(3)], bool(rng.integers(2)), None if i % 53 == 0 else "abc"[rng.integers(3)], i % 4) for i in range(400)]
    rows += [(None, "x", None, "a", None), (float("nan"), "y", True, "b", 2)] + rows[:30]
    return spark.createDataFrame(rows, "n double, k string, b boolean, t string, fold int").cache()


def plain(results):
    return [(r["conditions"], r["depth"], r["coverage"], pytest.approx(r["quality"]), r["tertiary"]) for r in results]


SETTINGS = [Settings(minimum=-1.0), Settings(minimum=-1.0, depth=2, width=3, max_results=7), Settings(minimum=0.0, depth=2, strategy="breadth", numeric_strategy="bins", bins=4, min_coverage=30, measure="chi_squared", max_coverage_share=0.5),
            Settings(minimum=-1.0, numeric_strategy="intervals", numeric_operators="intervals", min_support=5)]


@pytest.mark.parametrize("settings", SETTINGS)
def test_folds(table, settings):
    found = validation.results_by_fold(table, "fold", 4, TARGET, settings)
    for i, own in enumerate(found):
        alone = SubgroupDiscovery(table.where(~F.col("fold").eqNullSafe(i)).drop("fold"), TARGET, settings).run()
        assert own and plain(own) == plain(alone)


def test_target_values(table):
    df = table.drop("fold")
    found = per_target_value(df, "t", SETTINGS[1]).collect()
    assert [r["target_value"] for r in found] == [v for v in "abc" for _ in range(7)]
    for v in "abc":
        alone = SubgroupDiscovery(df, Target("single_nominal", ("t",), v), SETTINGS[1]).table().collect()
        assert [(r["conditions"], r["coverage"], round(r["quality"], 9)) for r in found if r["target_value"] == v] == [(r["conditions"], r["coverage"], round(r["quality"], 9)) for r in alone]
    assert per_target_value(df.where("false"), "t", Settings()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    made = [tuple(runs_together.permutation(np.arange(n), n, seed)) for seed in range(4)]
    assert all(sorted(p) == list(range(n)) for p in made) and (n < 16 or len(set(made)) == 4)


def test_permuted_targets(table):
    df = table.drop("fold").repartition(5)
    rows, runs = runs_together.of_permutations(df, TARGET, 3, 10)
    pdf = rows.toPandas()
    assert sorted(pdf["__place"]) == list(range(df.count()))
    labels = runs.label(pa.array(pdf["__place"]), None)[1]
    assert labels.sum(axis=1).tolist() == [h for _, h in runs.sizes] == [df.where("t = 'a'").count()] * 3
    settings = Settings(minimum=-1.0, depth=2, width=2)
    found = validation.swap_randomised(df, TARGET, settings, 3, 10)
    assert len(set(found)) > 1 and len(found) == 3
    # each is the best of a run on the table with that permutation's labels
    where = {int(p): [bool(x[i]) for x in labels] for i, p in enumerate(pdf["__place"])}
    swapped = df.sparkSession.createDataFrame([(r["n"], r["k"], r["b"], *where[r["__place"]]) for r in rows.collect()], "n double, k string, b boolean, y0 boolean, y1 boolean, y2 boolean")
    for i in range(3):
        alone = SubgroupDiscovery(swapped.select("n", "k", "b", f"y{i}"), Target("single_nominal", (f"y{i}",)), settings).run()
        assert found[i] == pytest.approx(alone[0]["quality"])


@pytest.mark.parametrize("together", [256, 3])
def test_searches_by_threshold_match_single_runs(table, together):
    """Every threshold finds what a search for its own binary target finds, in groups of any size; corners and areas follow from its points."""
    settings = Settings(minimum=-0.5, depth=2, width=3, max_results=6)
    df = table.select("n", "k", "b", F.concat(F.lit("f"), "fold").alias("f"))
    got: dict = {}
    for r in runs_together.threshold_searches(df, "n", settings, together).collect():
        got.setdefault(r["threshold"], []).append(r)
    known = df.where("n is not null and not isnan(n)")
    assert sorted(got) == sorted(r[0] for r in known.select("n").distinct().collect())[1:]
    for t in sorted(got)[::5]:
        rows = known.withColumn("t", F.when(F.col("n") >= t, "1").otherwise("0")).drop("n")
        alone = SubgroupDiscovery(rows, Target("single_nominal", ("t",), "1"), settings).run()
        assert [(r["conditions"], r["coverage"], r["quality"]) for r in got[t]] == [(text_of(x["conditions"]), x["coverage"], pytest.approx(x["quality"])) for x in alone]
        points, area = post.roc(alone, float(rows.count()), float(rows.where("t = '1'").count()))
        assert [r["on_hull"] for r in got[t]] == post.on_roc_hull(points) and got[t][0]["area"] == pytest.approx(area)
    assert runs_together.threshold_searches(df.where("n = 3"), "n", settings).count() == 0


def test_rounds_of_permutations_come_from_tables(monkeypatch):
    """The same places as without tables; a task hashes a run's rounds once, not for every block of rows."""
    places = np.random.default_rng(1).integers(0, 70_001, 500)
    kept = {}
    found = [runs_together.permutation(places, n, 3, k) for n, k in ((70_001, kept), (1 << 20, {}))]
    with monkeypatch.context() as m:
        m.setattr(runs_together, "TABLED", 0)
        assert all((runs_together.permutation(places, n, 3) == x).all() for n, x in zip((70_001, 1 << 20), found))
    monkeypatch.setattr(runs_together, "_mixed", lambda *a: pytest.fail("hashed again"))
    assert (runs_together.permutation(places[:9], 70_001, 3, kept) == found[0][:9]).all()
