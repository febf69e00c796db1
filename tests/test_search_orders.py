"""The index of conditions, and the orders of search, against plain expressions and the exhaustive search."""

import itertools
import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from sieveline import model
from sieveline.model import Condition as C
from sieveline.model import Settings, Target
from sieveline.operators import cover_index, refine
from sieveline.operators.search import SubgroupDiscovery
from sieveline.operators.stats import statistics

T = Target("single_nominal", ("t",))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        x, y, n, f = rng.choice([None, 1.0, 2.0, 3.5, math.nan]), rng.random() * 1000 if rng.random() > 0.1 else None, rng.choice(["a", "b", "?", None]), rng.choice([True, False, None])
        rows.append((x, y, n, f, rng.random() < 0.3 + 0.4 * (n == "a" and (y or 0) > 600), f"s{rng.randrange(300)}"))
    path = str(tmp_path_factory.mktemp("mixed"))
    spark.createDataFrame(rows, "x double, y double, n string, f boolean, t boolean, m string").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def beam():
    one = [C("x", "<=", 2.0), C("x", ">=", 2.0), C("x", "=", 1.0), C("y", "<=", 500.0), C("y", ">=", 300.0), C("y", "between", (100.0, 700.0)), C("y", "between", (-math.inf, 700.0)), C("y", "between", (100.0, math.inf)),
           C("n", "=", "a"), C("n", "in", frozenset({"a", "?"})), C("f", "=", True), C("f", "=", False), C("m", "=", "s7"), C("m", "=", "none")]
    return [(c,) for c in one] + random.Random(2).sample(list(itertools.combinations(one, 2)), 20) + [()]


def test_index_equals_expressions(spark, mixed, beam):
    types, stats = model.attribute_types(mixed, ("t",)), statistics(mixed, T)
    codes = cover_index.number_values(mixed, types, few=64)
    assert codes["y"].ranged and not codes["x"].ranged and "m" not in codes
    columns = ["cand", "attr", "v", "s", "B", "HB"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(cover_index.values(mixed, beam, types, codes, stats)) == rows(refine.values(mixed, beam, types, stats))


@pytest.mark.parametrize(("measure", "least", "minimum"), [("wracc", 2, None), ("chi_squared", 60, None), ("information_gain", 2, 0.01)])
def test_coarse_to_fine_finds_the_best_cuts(spark, mixed, beam, measure, least, minimum):
    types, stats = model.attribute_types(mixed, ("t",)), statistics(mixed, T)
    codes = cover_index.number_values(mixed, types, few=64, ranges=16)
    settings = Settings(measure=measure, minimum=-1.0, depth=3, min_coverage=least)
    counts = mixed.agg(*(F.count_if(model.conjunction(c)).alias(f"c{i}") for i, c in enumerate(beam))).first()
    parents = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "cand int, parent long")

    def best(rows):
        rows = rows.join(F.broadcast(parents), "cand").where(f"coverage < parent and coverage > {least} and quality > {-1 if minimum is None else minimum}")
        return sorted(map(tuple, refine.best_per_operator(rows).select("cand", "attr", "op", "v", "s", "coverage", F.round("quality", 9)).collect()), key=str)

    exact = refine.level(mixed, beam, types, stats, settings, {}, best=True)
    index = refine.level(mixed, beam, types, stats, settings, {}, best=True, codes=codes, last=minimum)
    assert best(index) == best(exact)


def run(df, **settings):
    search = SubgroupDiscovery(df, T, Settings(min_coverage=20, **settings))
    return search, [(model.text_of(r["conditions"]), r["depth"], r["coverage"], round(r["quality"], 9)) for r in search.run()]


def test_orders_find_the_same_and_bounds_save_work(mixed):
    df = mixed.drop("m", "x")
    breadth, full = run(df, strategy="breadth", depth=3, minimum=0.0)
    assert any(d == 3 for _, d, _, _ in full)
    _, deep = run(df, strategy="depth_first", depth=3, minimum=0.0)
    assert deep == full
    best, top = run(df, strategy="best_first", depth=3, minimum=0.0, max_results=5)
    assert [r[2:] for r in top] == [r[2:] for r in full[:5]] and set(top) <= set(full)
    assert best.expanded < breadth.expanded
    _, rest = run(df, strategy="best_first", depth=3, minimum=0.0)
    assert rest == full


def test_depth_first_tables_go(mixed, tmp_path):
    df = mixed.select("n", "f", "t")
    spark = mixed.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    left = lambda: [str(x.getPath()) for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if "written-" in str(x.getPath())]
    before = left()
    _, found = run(df, strategy="depth_first", depth=3, minimum=-1.0)
    assert found and left() == before


@pytest.mark.parametrize("strategy", ["beam", "depth_first"])
def test_time_limit_interrupts_a_round(spark, mixed, strategy):
    """Every row takes 20 ms from the second round on: a round alone is longer than the limit."""
    df = mixed.select("n", "f", "t", "y")
    search = SubgroupDiscovery(df, T, Settings(min_coverage=2, depth=4, minimum=-1.0, strategy=strategy, numeric_strategy="all", max_minutes=12 / 60))
    rounds = search._level

    def slow(table, beam, last):
        out = rounds(table, beam, last)
        return out if beam == [()] else out.where(F.udf(lambda x: time.sleep(0.02) or True, "boolean")("cand"))

    search._level = slow
    began = time.time()
    found = search.run()
    assert time.time() - began < 40 and search.cancelled
    assert found and all(r["depth"] == 1 for r in found)
    exact = {r["conditions"]: r["coverage"] for r in SubgroupDiscovery(df, T, Settings(min_coverage=2, depth=1, minimum=-1.0, numeric_strategy="all")).run()}
    assert {r["conditions"]: r["coverage"] for r in found} == exact
    assert spark.range(3).count() == 3  # the session's other jobs run


def test_cancel_from_another_thread(mixed):
    search = SubgroupDiscovery(mixed.select("n", "f", "t"), T, Settings(depth=4, minimum=-1.0, strategy="breadth"))
    rounds = search._level
    search._level = lambda df, beam, last: rounds(df, beam, last).where(F.udf(lambda x: time.sleep(5) or True, "boolean")("cand"))
    threading.Timer(3, search.cancel).start()
    began = time.time()
    assert search.run() == [] and time.time() - began < 30


@pytest.mark.parametrize("measure", ["wracc", "chi_squared"])
def test_best_interval_of_ranges_equals_one_group(spark, monkeypatch, measure):
    """Ranges of about 12 values, hulls merged three at a time, against one group and against all pairs."""
    rng = random.Random(4)
    rows = [(float(rng.randrange(400)), float(i % 90), rng.random() < (0.8 if 100 < i < 200 else 0.3)) for i in range(1500)]
    df = spark.createDataFrame([(x, y, t if x > 40 else x % 2 == 0) for x, y, t in rows], "x double, y double, t boolean")
    types, stats = {"x": model.NUMERIC, "y": model.NUMERIC}, statistics(df, T)
    settings = Settings(measure=measure, minimum=-1.0, numeric_strategy="intervals")
    beam = [(), (C("y", "<=", 50.0),)]
    best = lambda: sorted(map(tuple, refine.best_per_operator(refine.level(df, beam, types, stats, settings, {}, best=True)).select("cand", "attr", "lo", "hi", "coverage", F.round("quality", 9)).collect()))
    one = best()
    monkeypatch.setattr(refine, "GROUP_CUTS", 12)
    monkeypatch.setattr(refine, "FAN", 3)
    assert best() == one and len(one) == 4
    monkeypatch.setattr(refine, "CONVEX", set())
    assert [r[-1] for r in best()] == [r[-1] for r in one]
