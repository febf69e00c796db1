"""Semantics of conditions, refinement, search, post-processing, validation and sources on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import kernels
from sieveline.model import Condition, Settings, Target
from sieveline.operators import post, tables, validation
from sieveline.operators.search import SubgroupDiscovery, discover
from sieveline.sources import arff, runs, text

#: The small selection case with known results.
ROWS = [(1.0, "A", 1.0, "a", "t"), (2.0, "A", 2.0, "b", "t"), (3.0, "A", 3.0, "a", "f"), (4.0, "A", 4.0, "b", "t"), (5.0, "A", 5.0, "a", "f"), (6.0, "B", 6.0, "a", "t"), (7.0, "B", 7.0, "b", "f")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "id double, selector1 string, selector2 double, descriptor string, target string").cache()


def test_number_text():
    assert [model.number_text(x) for x in (33.0, 0.1, 1e7, 1.5e-4, -2.0, math.inf)] == ["33.0", "0.1", "1.0E7", "1.5E-4", "-2.0", "inf"]


def test_condition_text_and_order():
    cs = [Condition("a", "<=", 33.0), Condition("b", "=", "x"), Condition("a", "between", (1.0, math.inf)), Condition("c", "=", True), Condition("b", "in", frozenset({"y", "x"}))]
    assert model.text_of(tuple(cs)) == "a <= 33.0 AND b = 'x' AND a in (1.0, inf) AND c = '1' AND b in {x,y}"
    order = {"a": 0, "b": 1, "c": 2}
    assert [str(c) for c in sorted(cs, key=lambda c: c.key(order))][:2] == ["a <= 33.0", "a in (1.0, inf)"]


def test_canonical_and_specialises():
    order = {"a": 0, "b": 1}
    assert model.canonical((Condition("b", "=", "x"), Condition("a", "<=", 5.0), Condition("a", "<=", 3.0)), order) == (Condition("a", "<=", 3.0), Condition("b", "=", "x"))
    narrow = (Condition("a", "<=", 3.0), Condition("b", "=", "x"))
    assert model.specialises(narrow, (Condition("a", "<=", 5.0),))
    assert not model.specialises((Condition("a", "<=", 5.0),), narrow)
    assert not model.specialises(narrow, narrow)


def test_predicates_and_missing(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, "x", True), (None, "y", False)], "n double, s string, b boolean")
    count = lambda *c: df.where(model.conjunction(c)).count()
    assert count(Condition("n", "<=", 2.0)) == 2
    assert count(Condition("n", "between", (1.0, 2.0))) == 1
    assert count(Condition("s", "=", "x")) == 1
    assert count(Condition("s", "in", frozenset({"?", "x"}))) == 2  # a missing nominal is a set member
    assert count(Condition("b", "=", False)) == 2  # a missing binary counts as false
    assert count() == 3


def test_known_selection_case(small):
    found = SubgroupDiscovery(small, Target("single_nominal", ("target",), "t"), Settings(measure="normalised_wracc", minimum=0.1, max_results=2, min_coverage=2), selection=F.col("selector1") == "A").run()
    assert [model.text_of(r["conditions"]) for r in found] == ["id <= 2.0", "selector2 <= 2.0"]
    for r in found:
        assert r["coverage"] == 2 and r["quality"] == pytest.approx(0.6666667) and r["secondary"] == 1.0 and r["tertiary"] == 2.0


def test_selection_is_a_filter(small):
    t, s = Target("single_numeric", ("selector2",)), Settings(measure="z_score", minimum=-10, numeric_strategy="all")
    a = SubgroupDiscovery(small, t, s, selection=F.col("selector1") == "A").run()
    b = SubgroupDiscovery(small.where("selector1 = 'A'"), t, s).run()
    assert a == b and a


def test_depth_two_narrows_coverage(small):
    found = SubgroupDiscovery(small, Target("single_nominal", ("target",), "t"), Settings(minimum=-1, depth=2, numeric_strategy="all", min_coverage=1)).run()
    by = {r["conditions"]: r for r in found}
    assert any(r["depth"] == 2 for r in found)
    for c, r in by.items():
        assert small.where(model.conjunction(c)).count() == r["coverage"]


def test_result_schema_and_sink(small, tmp_path):
    out = discover(small, Target("single_nominal", ("target",), "t"), Settings(minimum=-1, max_results=3))
    assert out.columns == ["nr", "depth", "coverage", "quality", "secondary", "tertiary", "p_value", "conditions"]
    text.write_results(out, str(tmp_path / "r"))
    assert out.sparkSession.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 3


def test_text_reader(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("A;B;C;D\n1;x;'p; q';\n0;2;y;3\n1; ;z;4.5\n")
    df = text.read_text(spark, str(p))
    assert model.attribute_types(df) == {"A": "binary", "B": "nominal", "C": "nominal", "D": "numeric"}
    assert [r["D"] for r in df.collect()] == [None, 3.0, 4.5] and df.where("B is null").count() == 1
    with pytest.raises(ValueError):
        text.read_text(spark, str(p), {"B": "numeric"})
    assert text.delimiter_of(["a\tb,c", "1\t2"]) == "\t"


def test_arff_reader(spark, tmp_path):
    p = tmp_path / "x.arff"
    p.write_text("% c\n@relation r\n@attribute 'a b' numeric\n@attribute c {0,1}\n@attribute d {x,y,z}\n@attribute e date\n@data\n1.5,1,x,2020-01-01\n?,0,?,2020-01-02\n% done\n")
    df = arff.read_arff(spark, str(p))
    assert model.attribute_types(df) == {"a b": "numeric", "c": "binary", "d": "nominal", "e": "nominal"}
    assert [tuple(r) for r in df.collect()] == [(1.5, True, "x", "2020-01-01"), (None, False, None, "2020-01-02")]


def test_runs_round_trip(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("n,s,t\n" + "".join(f"{i},{'ab'[i % 2]},{'yn'[i < 5]}\n" for i in range(10)))
    run = runs.Run(Target("single_nominal", ("t",), "y"), Settings(minimum=0.0, max_results=4), "t.csv", {"n": "numeric", "s": "nominal", "t": "nominal"}, ("s",))
    path = str(tmp_path / "run.xml")
    runs.write_runs(path, [run])
    runs.write_runs(path, [run], append=True)
    assert runs.read_runs(path) == [run, run]
    out = runs.execute_runs(spark, path)
    assert len(out) == 2 and all("s =" not in r.conditions for r in out[0].collect()) and out[0].count() > 0


def test_parse_descriptions():
    types = {"a": "numeric", "b": "nominal", "c": "binary"}
    for own in [(Condition("a", "<=", 3.0), Condition("b", "=", "x")), (Condition("c", "=", True),), (Condition("b", "in", frozenset({"x", "y"})),), (Condition("a", "between", (1.0, math.inf)),)]:
        assert runs.parse_description(model.text_of(own), types) == own


def test_jdbc_partitions(spark):
    assert "SELECT" in runs.select_text(["a"], "t", ["a > 1"], [], ["a"], True) and runs.create_table_as("x", "SELECT 1") == "CREATE TABLE x AS SELECT 1"


def test_roc_hull():
    hull = post.roc_hull([(0.5, 0.5), (0.1, 0.6), (0.4, 0.5)])
    assert hull == [(0.0, 0.0), (0.1, 0.6), (1.0, 1.0)]
    assert post.area_under(hull) == pytest.approx(0.03 + 0.9 * 0.8)
    assert post.on_roc_hull([(0.1, 0.6), (0.4, 0.5), (0.0, 0.2)]) == [True, False, False]


def test_pattern_team_and_cover(small):
    res = [{"conditions": (Condition("id", "<=", x),), "quality": 1.0} for x in (1.0, 3.0, 4.0)] + [{"conditions": (Condition("descriptor", "=", "a"),), "quality": 0.5}]
    team = post.pattern_team(small, res, 2)
    assert len(set(team)) == 2 and 3 in team
    assert len(post.cover_based(small, res, 2)) == 2
    assert post.alternatives(small, "id", [res[0], {"conditions": (Condition("selector2", "<=", 1.0),)}]) == [[0, 1]]


def test_validation(small, spark):
    df = tables.materialised(validation.numbered(small, 3))
    assert sorted(r["row_id"] for r in df.collect()) == list(range(7))
    p = validation.permuted(small, ("target",), 5)
    assert sorted(r["target"] for r in p.collect()) == sorted(r[4] for r in ROWS) and p.columns == small.columns
    q = [0.1, 0.2, 0.3]
    assert validation.empirical_p(0.2, q) == pytest.approx(2 / 3) and validation.set_p(0.2, q) == pytest.approx(1 / 3)
    assert validation.thresholds(q)[0.05] == pytest.approx(0.2 + 1.6448536 * 0.1)
    assert len(validation.cross_validate(small, Target("single_nominal", ("target",), "t"), Settings(minimum=-1), 2)) == 2


def counted(x):
    return np.unique(x, axis=0, return_counts=True)


def test_kernels():
    rng = np.random.default_rng(0)
    x, n = counted(np.round(rng.normal(size=400), 1))
    rows = np.repeat(x, n)
    h = kernels.bandwidth_of(400, rows.std(ddof=1), *np.percentile(rows, [25, 75]), x.min(), x.max())
    grid = kernels.grid_of(x.min(), x.max(), h)
    p = kernels.density(x, n, grid, h)
    z = (grid[:, None] - rows[None, :]) / h
    assert p == pytest.approx(np.where(np.abs(z) <= 4 + 1e-9, np.exp(-0.5 * z * z), 0).sum(axis=1) / (400 * h * math.sqrt(2 * math.pi)))
    assert p.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=0.01)
    assert kernels.divergence("squared_hellinger", p, p, 1.0) == 0
    zero = np.array([0.0, 1.0]), np.array([1.0, 0.0])
    assert kernels.divergence("kullback_leibler_2d", *zero, 1.0) == math.inf and kernels.divergence("kullback_leibler", np.array([0.5, 0.5]), zero[1], 1.0) == pytest.approx(math.log(2))
    counts = {0b00: 40, 0b11: 40, 0b01: 2, 0b10: 2}
    net = kernels.learn_network(counts, 2)
    assert len(net) == 1 and kernels.edit_distance(net, frozenset(), 2) == 1.0


def test_edit_distance_counts_a_pair_once():
    """a -> c <- b and a -> d <- b make one v-structure of the pair; a connected pair makes none."""
    one, two = frozenset({(0, 2), (1, 2), (0, 3), (1, 3)}), frozenset({(2, 0), (2, 1), (3, 0), (3, 1)})
    assert kernels.v_structures(one) == {frozenset((0, 1))}
    assert kernels.edit_distance(one, two, 4) == pytest.approx((1 + 1) / 6)  # the pairs (0, 1) and (2, 3)
    assert kernels.edit_distance(one, one | {(0, 1)}, 4) == pytest.approx(1 / 6)


def test_log_gamma_and_bayesian_score():
    x = np.array([0.25, 1, 2.5, 9.99, 10, 77.5, 1e6])
    assert kernels.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-12)

    def brute(n, h, b, hb):
        """Both models as integrals over a grid of rates."""
        t = (np.arange(4000) + 0.5) / 4000
        a = hb * np.log(t) + (b - hb) * np.log1p(-t)
        c = (h - hb) * np.log(t) + (n - h - b + hb) * np.log1p(-t)
        inside, outside = np.exp(a), np.exp(c)
        below = np.cumsum(outside) - outside / 2
        up, low = 2 * (inside * below).mean() / 4000, 2 * (inside * (outside.sum() - below)).mean() / 4000
        same = np.exp(a + c).mean()
        return math.log(up / (same + low))

    for case in ((100, 50, 20, 18), (100, 50, 20, 10), (60, 20, 30, 2), (40, 10, 10, 10)):
        assert kernels.bayesian_score(*case) == pytest.approx(brute(*case), abs=1e-3)
    # ten times the evidence scores higher
    assert kernels.bayesian_score(1000, 500, 200, 190) < kernels.bayesian_score(10000, 5000, 2000, 1900) < kernels.bayesian_score(60000, 30000, 12000, 11400)


def test_kernel_functions_can_be_sent_to_tasks_at_any_time():
    from pyspark import cloudpickle

    kernels.bdeu({0: 3, 1: 2}, 0, ())
    for f in vars(kernels).values():
        if callable(f):
            assert cloudpickle.loads(cloudpickle.dumps(f)) is not None


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(1, 21)), float(np.round(rng.random() * 50 + (10 if i % 3 == 0 else 0), 0)), "xyz"[i % 3], float(i % 5)) for i in range(600)]
    rows[7] = (None, 4.0, "x", 1.0)
    return rows, spark.createDataFrame(rows, "p double, q double, k string, a double")


def in_conditions(row, conditions):
    return all({"k": row[2], "a": row[3]}[c.attribute] == c.value if c.operator == "=" else {"a": row[3]}[c.attribute] <= c.value if c.operator == "<=" else {"a": row[3]}[c.attribute] >= c.value for c in conditions)


def split_by(rows, conditions, columns):
    rows = [r for r in rows if all(r[c] is not None for c in columns)]
    take = lambda keep: np.array([[r[c] for c in columns] for r in rows if in_conditions(r, conditions) == keep], float)
    return take(True), take(False)


@pytest.mark.parametrize("measure", ["l2", "squared_hellinger_2d", "kullback_leibler_weighted_2d", "cwracc_2d"])
def test_pair_measures_match_brute_force(pairs, measure):
    rows, df = pairs
    found = SubgroupDiscovery(df, Target("multi_numeric", ("p", "q")), Settings(measure=measure, minimum=float("-inf"), numeric_strategy="all"), types={"k": "nominal", "a": "numeric"}).run()
    assert len(found) == 3 + 8
    for r in found:
        x, y = split_by(rows, r["conditions"], (0, 1))
        if measure == "l2":
            scale = np.sqrt(sum((len(z) ** (-1 / 6) * z.std(axis=0, ddof=1)) ** 2 for z in (x, y)))
            sums = np.exp(-0.5 * (((x[:, None, :] - y[None, :, :]) / scale) ** 2).sum(axis=2)).sum()
            want = sums / (2 * math.pi * np.prod(scale) * math.sqrt(len(x) * len(y)))
        else:
            ha, hb = (np.cov(z, rowvar=False) * len(z) ** (-1 / 3) for z in (x, y))
            both, reach = np.concatenate((x, y)), 3 * np.sqrt(np.maximum(np.diag(ha), np.diag(hb)))
            step = np.sqrt(np.minimum(np.diag(ha), np.diag(hb)) / 2)
            axes = [both[:, i].min() - reach[i] + step[i] * np.arange(int((np.ptp(both[:, i]) + 2 * reach[i]) / step[i])) for i in (0, 1)]
            grid = np.array([(a, b) for a in axes[0] for b in axes[1]])

            def density(z, h):
                d = grid[:, None, :] - z[None, :, :]
                return np.exp(-0.5 * np.einsum("gni,ij,gnj->gn", d, np.linalg.inv(h), d)).sum(axis=1) / (len(z) * 2 * math.pi * math.sqrt(np.linalg.det(h)))

            q, p, cell = density(x, ha), density(y, hb), (axes[0][1] - axes[0][0]) * (axes[1][1] - axes[1][0])
            share = len(x) / len(both)
            want = cell * {"squared_hellinger_2d": 0.5 * ((np.sqrt(p) - np.sqrt(q)) ** 2).sum(), "kullback_leibler_weighted_2d": share * (q * np.log(q / p)).sum(), "cwracc_2d": share * np.abs(p - q).sum()}[measure]
        assert r["quality"] == pytest.approx(want, rel=1e-6)


def test_pair_densities_of_far_and_degenerate_sides(spark):
    rows = [(float(i % 7), float(i % 5), "near") for i in range(70)] + [(1e4 + i % 9, float(i % 4), "far") for i in range(72)] + [(3.0, float(i), "line") for i in range(20)]
    df = spark.createDataFrame(rows, "p double, q double, k string")
    run = lambda m: {r["conditions"][0].value: r for r in SubgroupDiscovery(df, Target("multi_numeric", ("p", "q")), Settings(measure=m, minimum=float("-inf"))).run()}
    found = run("kullback_leibler_2d")
    assert found["far"]["quality"] == math.inf and found["line"]["quality"] == 0.0
    apart = run("squared_hellinger_2d")
    assert apart["line"]["quality"] == 0.0 and 0 < apart["far"]["quality"] <= 1.01
    assert SubgroupDiscovery(df.where("false"), Target("multi_numeric", ("p", "q")), Settings(measure="cwracc_2d")).run() == []


def test_plane_sums_of_wide_grids():
    rng = np.random.default_rng(3)
    rows, counts = np.concatenate((rng.normal(size=(300, 2)), rng.normal(size=(300, 2)) * 0.5 + (150.0, -90.0))), rng.integers(1, 5, 600).astype(float)
    h = np.array([[0.3, 0.1], [0.1, 0.4]])
    axes = [np.arange(-5.0, 160.0, 0.9), np.arange(-100.0, 10.0, 1.1)]
    d = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 1, 2) - rows[None]
    want = np.exp(-0.5 * np.einsum("gni,ij,gnj->gn", d, np.linalg.inv(h), d)) @ counts
    got = kernels.plane_sums(rows, counts, axes, h)
    assert got == pytest.approx(want, rel=1e-9, abs=0.0) and (got > 0).sum() == (want > 0).sum()


@pytest.mark.parametrize("measure", ["squared_hellinger", "kullback_leibler_weighted", "cwracc_unweighted"])
def test_density_measures_match_brute_force(pairs, measure):
    rows, df = pairs
    found = SubgroupDiscovery(df, Target("single_numeric", ("p",)), Settings(measure=measure, minimum=float("-inf"), numeric_strategy="all"), types={"k": "nominal", "a": "numeric"}).run()
    every = np.array([r[0] for r in rows if r[0] is not None])
    h = kernels.bandwidth_of(len(every), every.std(ddof=1), *np.percentile(every, [25, 75]), every.min(), every.max())
    grid = kernels.grid_of(every.min(), every.max(), h)
    p = kernels.density(every, np.ones(len(every)), grid, h)
    assert len(found) == 11
    for r in found:
        x = split_by(rows, r["conditions"], (0,))[0][:, 0]
        assert r["quality"] == pytest.approx(kernels.divergence(measure, p, kernels.density(x, np.ones(len(x)), grid, h), len(x) / len(every)), rel=1e-9)
        assert r["secondary"] == pytest.approx(x.mean()) and r["tertiary"] == pytest.approx(x.std(ddof=1))


def test_rank_measures_match_brute_force(pairs):
    rows, df = pairs
    every = sorted(r[0] for r in rows if r[0] is not None)
    rank = {v: np.mean([i for i, x in enumerate(every, 1) if x == v]) for v in set(every)}
    for measure in ("auc", "mmad"):
        found = SubgroupDiscovery(df, Target("single_ordinal", ("p",)), Settings(measure=measure, minimum=float("-inf"), numeric_strategy="all"), types={"k": "nominal", "a": "numeric"}).run()
        assert len(found) == 11
        for r in found:
            x, y = (z[:, 0] for z in split_by(rows, r["conditions"], (0,)))
            own = np.array([rank[v] for v in x])
            med = np.median(own)
            want = len(x) / (2 * med + np.median(np.abs(own - med))) if measure == "mmad" else np.mean([(a < b) + 0.5 * (a == b) for a in x for b in y])
            assert r["quality"] == pytest.approx(want, rel=1e-9)


def test_tail_and_cook_match_brute_force(pairs):
    rows, df = pairs
    for kind, measure in (("double_correlation", "correlation_p"), ("double_regression", "cooks_distance")):
        found = SubgroupDiscovery(df, Target(kind, ("p", "q")), Settings(measure=measure, minimum=float("-inf"), numeric_strategy="all"), types={"k": "nominal", "a": "numeric"}).run()
        assert len(found) == 11
        for r in found:
            x, y = split_by(rows, r["conditions"], (0, 1))
            if measure == "correlation_p":
                z = abs(math.atanh(np.corrcoef(x.T)[0, 1]) - math.atanh(np.corrcoef(y.T)[0, 1])) / (1 / math.sqrt(len(x) - 3) + 1 / math.sqrt(len(y) - 3))
                want = 0.5 * (1 + math.erf(z / math.sqrt(2)))
            else:
                both = np.concatenate((x, y))
                a = np.stack((np.ones(len(both)), both[:, 0]), axis=1)
                beta = np.linalg.lstsq(a, both[:, 1], rcond=None)[0]
                d = beta - np.linalg.lstsq(np.stack((np.ones(len(y)), y[:, 0]), axis=1), y[:, 1], rcond=None)[0]
                want = d @ a.T @ a @ d / (2 * ((both[:, 1] - a @ beta) ** 2).sum() / (len(both) - 2))
            assert r["quality"] == pytest.approx(want, rel=1e-6)


def test_best_interval_by_corners_equals_all_pairs(spark):
    from sieveline.operators import refine

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40):
        p = np.concatenate(([[0.0, 0.0]], np.cumsum(np.stack((rng.integers(1, 5, n), rng.integers(0, 3, n)), axis=1), axis=0))).astype(float)
        pairs = refine.extreme_intervals(p)
        every = [(i, j) for i in range(len(p)) for j in range(i + 1, len(p))]
        assert set(pairs) <= set(every)
        for w in rng.normal(size=(50, 2)):
            assert max((p[j] - p[i]) @ w for i, j in pairs) == pytest.approx(max((p[j] - p[i]) @ w for i, j in every))
    df = spark.createDataFrame([(float(rng.integers(0, 60)), float(rng.normal()), bool(rng.random() < 0.3 + 0.3 * (i % 7 == 0))) for i in range(400)], "x double, y double, t boolean")
    for measure in ("wracc", "chi_squared", "information_gain"):
        run = lambda **kw: SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(measure=measure, minimum=float("-inf"), min_coverage=1, **kw)).run()
        found = run(numeric_strategy="intervals")
        every = run(numeric_strategy="all", numeric_operators="intervals")
        for a in "xy":
            best = lambda rs: max(r["quality"] for r in rs if r["conditions"][0].attribute == a)
            assert best(found) == pytest.approx(best(every))


def test_best_interval_of_many_values_ends(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("id * 1.0 as x", "pmod(xxhash64(id), 3) = 0 or id between 50000 and 90000 as t")
    (best,) = SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(measure="wracc", numeric_strategy="intervals", minimum=0.0)).run()
    lo, hi = best["conditions"][0].value
    assert abs(lo - 50000) < 50 and abs(hi - 90000) < 50


@pytest.mark.parametrize("name", ["QM08_l2", "QU16_squared_hellinger"])
def test_measures_of_pairs_see_every_row(spark, name):
    from sieveline.plans import catalog

    folder = "/root/testdata/sf0.001"
    found = {r.conditions: r.coverage for r in catalog.QUERIES[name](spark, folder).collect()}
    whole = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert sum(n for c, n in found.items() if c.startswith("l_linestatus")) == whole


def test_kernel_search_keeps_the_strategy(spark):
    df = spark.createDataFrame([(float(i % 20), float((i * 7) % 11 + (5 if i % 20 > 13 else 0)), "xyz"[i % 3]) for i in range(200)], "a double, t double, s string")
    run = lambda **kw: SubgroupDiscovery(df, Target("single_ordinal", ("t",)), Settings(**({"measure": "abs_wmw_ranks", "minimum": float("-inf")} | kw)), types={"a": "numeric"}).run()
    every = run(numeric_strategy="all")
    assert len(every) == 38 and {c.value for r in every for c in r["conditions"]} == {float(i) for i in range(20)}
    best = run()
    assert len(best) == 2 and best[0]["quality"] == max(r["quality"] for r in every)
    assert len(run(numeric_strategy="intervals", numeric_operators="intervals", max_results=0)) == 1 and len(run(numeric_strategy="bins", numeric_operators="leq")) == 7
    with pytest.raises(ValueError):
        SubgroupDiscovery(df, Target("single_ordinal", ("t",)), Settings(measure="mmad", nominal_sets=True), types={"s": "nominal"}).run()


def test_score_order_and_sort_take_every_row(spark):
    from sieveline.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 0 else float(rng.integers(0, 40))) for i in range(700)]
    got = {r.k: r.place for r in tables.score_order(spark.createDataFrame(rows, "k long, x double"), "x", "k", buckets=8).collect()}
    assert got == {k: p for p, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    folder = "/root/testdata/sf0.001"
    want = sorted(spark.read.parquet(f"{folder}/orders.parquet").collect(), key=lambda r: (-r.o_totalprice, r.o_orderkey))
    assert {r.o_orderkey: r.place for r in catalog.QUERIES["WN07_score_order_all"](spark, folder).collect()} == {r.o_orderkey: p for p, r in enumerate(want, 1)}
    assert catalog.QUERIES["TK07_multi_sort_all"](spark, folder).count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_random_descriptions_draw_from_the_whole_domain(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(1500)], "s string")
    drawn = {c.value for cs in validation.random_descriptions(df, {"s": "nominal"}, 1, 200) for c in cs}
    assert drawn <= {f"v{i:04d}" for i in range(1500)} and any(v >= "v1000" for v in drawn)


def test_tables(spark):
    df = spark.createDataFrame([(float("nan"), None, "1"), (2.0, True, "x")], "n double, b boolean, s string")
    assert [tuple(r) for r in tables.clean_missing(df).select("n", "b").collect()] == [(None, False), (2.0, True)]
    assert tables.subset_by_mask(["a", "b", "c"], 0b101) == ["a", "c"]
    assert tables.kendall_tau([1, 2, 3], [1, 2, 3]) == 1.0 and tables.kendall_tau([1, 2, 3], [3, 2, 1]) == -1.0
    assert tables.cast_column(df, "n", "binary").schema["n"].dataType.simpleString() == "boolean"


def test_ranking_target(spark):
    df = spark.createDataFrame([(float(i), "a>b>c" if i < 5 else "c>b>a") for i in range(10)], "x double, r string")
    found = SubgroupDiscovery(df, Target("label_ranking", ("r",)), Settings(measure="lr_norm", minimum=0)).run()
    assert model.text_of(found[0]["conditions"]) in ("x <= 4.0", "x >= 5.0")


def test_scape_matches_brute_force(spark):
    rows = [(float(i % 4), i % 3 == 0, "ab"[i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "score double, t boolean, k string")
    (loss,) = [r["loss"] for r in tables.scape_loss(df, F.col("t"), F.col("score")).collect()]
    pos, neg = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    assert loss == pytest.approx(sum((n > p) + 0.5 * (n == p) for p in pos for n in neg) / len(pos))


def test_bucketed_running_sums_equal_plain_ones(spark, monkeypatch):
    from sieveline.operators import refine
    from sieveline.operators.stats import statistics

    df = spark.createDataFrame([(float(i * 37 % 101), float(i % 3), i % 4 == 0) for i in range(300)], "x double, y double, t boolean")
    target, types = Target("single_nominal", ("t",), True), {"x": "numeric", "y": "numeric"}
    stats = statistics(df, target)
    monkeypatch.setattr(refine, "WIDE", 20)
    monkeypatch.setattr(refine, "BUCKETS", 8)
    wide = refine.wide_bounds(df, types)
    assert list(wide) == ["x"]
    for strategy in ("all", "bins"):
        rows = [sorted((r.attr, r.op, r.v, r.coverage, round(r.quality, 9)) for r in refine.level(df, [()], types, stats, Settings(numeric_strategy=strategy), w).collect()) for w in (wide, None)]
        assert rows[0] == rows[1] and rows[0]


def test_roc_and_cover_beams_see_every_candidate(spark):
    """Against a plain search in Python, with a beam that binds."""
    rng = np.random.default_rng(11)
    rows = [("abcdefgh"[rng.integers(0, 8)], "uvwxyz"[rng.integers(0, 6)], "klmno"[rng.integers(0, 5)]) for _ in range(500)]
    rows = [(*r, bool(rng.random() < (0.7 if r[0] == "a" or r[1] == "u" else 0.25))) for r in rows]
    df = spark.createDataFrame(rows, "a string, b string, c string, t boolean")
    n, h = len(rows), sum(r[3] for r in rows)
    single = [("abc"[i], v) for i in range(3) for v in sorted({r[i] for r in rows})]
    cover = {x: {k for k, r in enumerate(rows) if r["abc".index(x[0])] == x[1]} for x in single}
    score = lambda own: sum(rows[k][3] for k in own) / n - h / n * len(own) / n

    def expected(beam):
        out = {(x,) for x in single}
        for x in beam:
            for y in single:
                both = cover[x] & cover[y]
                if x[0] != y[0] and len(both) >= 2 and len(both) < len(cover[x]):
                    out.add(tuple(sorted((x, y))))
        return out

    def run(**kw):
        found = SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(depth=2, minimum=-1.0, **kw)).run()
        return {tuple((c.attribute, c.value) for c in r["conditions"]) for r in found}

    points = {x: ((len(cover[x]) - sum(rows[k][3] for k in cover[x])) / (n - h), sum(rows[k][3] for k in cover[x]) / h) for x in single}
    corners = set(post.roc_hull(list(points.values())))
    hull = [x for x in single if points[x] in corners and points[x][0] > 0]
    assert hull and run(strategy="roc", width=1) == expected(hull)
    times, chosen = [0] * n, []
    for _ in range(3):
        best = max((x for x in single if x not in chosen), key=lambda x: score(cover[x]) * sum(0.9 ** times[k] for k in cover[x]) / len(cover[x]))
        chosen.append(best)
        for k in cover[best]:
            times[k] += 1
    assert run(strategy="cover", width=3) == expected(chosen)


def test_depth_two_bounds_count_different_descriptions(spark):
    """Many conditions that imply each other must not fill a bounded result list."""
    df = spark.createDataFrame([(float(i % 40), float(i % 7), i % 40 < 9 and i % 7 > 2) for i in range(560)], "x double, y double, t boolean")
    run = lambda k: SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(depth=2, max_results=k, numeric_strategy="all", minimum=0.0)).run()
    every, few = run(0), run(15)
    assert len({r["conditions"] for r in every}) == len(every) > 100
    assert [(r["conditions"], round(r["quality"], 9)) for r in few] == [(r["conditions"], round(r["quality"], 9)) for r in every[:15]]


def test_p_values(spark, small):
    kw = dict(measure="wracc", minimum=-1.0, min_coverage=1, p_values="empirical", repeats=20, seed=3)
    for kind in ("swap", "subsets", "descriptions"):
        found = SubgroupDiscovery(small, Target("single_nominal", ("target",), "t"), Settings(randomised=kind, **kw | ({"repeats": 3} if kind == "swap" else {}))).run()
        assert found and all(0 <= r["p_value"] <= 1 for r in found)
        assert [r["p_value"] for r in found] == sorted(r["p_value"] for r in found)
    qualities = [0.0, 0.1, 0.2, 0.3]
    (a,) = validation.assign_p_values(small, None, Settings(p_values="empirical"), [{"quality": 0.2}], qualities)
    (b,) = validation.assign_p_values(small, None, Settings(p_values="gaussian"), [{"quality": 0.15}], qualities)
    assert a["p_value"] == 0.5 and b["p_value"] == pytest.approx(0.5)


def test_propensity_of_known_descriptions(spark):
    rows = [("ab"[i % 2], "xyz"[i % 3], (i * 7) % 10 < (6 if i % 2 else 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, s string, t boolean")
    found = SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(measure="prop_score_wracc", minimum=-1.0), types={"s": "nominal"}, knowledge=[(Condition("k", "=", "a"),)]).run()
    rate = {k: np.mean([r[2] for r in rows if r[0] == k]) for k in "ab"}
    for r in found:
        own = [x for x in rows if x[1] == r["conditions"][0].value]
        want = (np.mean([x[2] for x in own]) - np.mean([rate[x[0]] for x in own])) * len(own) / len(rows)
        assert r["quality"] == pytest.approx(want, abs=1e-4)


def test_network_rescoring(spark):
    rng = np.random.default_rng(2)
    rows = [(bool(a), bool(a ^ (rng.random() < (0.05 if i % 2 else 0.5))), "uv"[i % 2]) for i, a in enumerate(rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "p boolean, q boolean, k string")
    target = Target("multi_label", ("p", "q"))
    results = [{"conditions": (Condition("k", "=", v),), "quality": 0.0, "coverage": 200} for v in "uv"]
    found = post.rescored_by_networks(df, target, results, "edit_distance", 3)
    counts = lambda keep: {m: sum(int(a) + 2 * int(b) == m for a, b, k in rows if keep(k)) for m in range(4)}
    learn = lambda c, seeds: [kernels.learn_network({k: n for k, n in c.items() if n}, 2, s) for s in seeds]
    for r in found:
        v = r["conditions"][0].value
        want = np.mean([kernels.edit_distance(a, b, 2) for a in learn(counts(lambda k: True), range(3)) for b in learn(counts(lambda k: k == v), range(3, 6))])
        assert r["quality"] == pytest.approx(want)
    assert [r["quality"] for r in found] == sorted((r["quality"] for r in found), reverse=True)


def test_database_tables_and_statement(spark):
    url = "jdbc:derby:memory:sieve;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string").write.format("jdbc").options(url=url, dbtable="things").save()
    assert ("THINGS", "TABLE") in {tuple(r) for r in runs.list_tables(spark, url).collect()}
    assert sorted(r[0] for r in runs.read_jdbc(spark, url, "things").collect()) == [1, 2]
    spark.createDataFrame([(5,)], "k int").createOrReplaceTempView("fives")
    spark.sql("drop table if exists sieve_made")
    runs.run_create_table_as(spark, "sieve_made", "select k + 1 as k from fives")
    assert [r[0] for r in spark.table("sieve_made").collect()] == [6]
    spark.sql("drop table sieve_made")


def test_operators_must_suit_types():
    with pytest.raises(ValueError):
        runs.parse_condition("s <= 3", {"s": "nominal"})
    assert runs.parse_condition("x in (1.0, 2.0]", {"x": "numeric"}).operator == "between"


@pytest.mark.parametrize("target, measure", [(Target("single_nominal", ("l_returnflag",), "R"), "normalised_wracc"), (Target("single_numeric", ("l_extendedprice",)), "z_score"), (Target("single_numeric", ("l_extendedprice",)), "explained_variance")])
def test_a_selection_equals_the_rows_it_keeps(spark, target, measure):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_extendedprice")
    settings = Settings(measure=measure, minimum=0.0, depth=2, width=5, max_results=20)
    kept = F.col("l_linestatus") == "O"
    types = {"l_quantity": "numeric", "l_tax": "numeric"}
    a = SubgroupDiscovery(df, target, settings, types=types, selection=kept).run()
    b = SubgroupDiscovery(df.where(kept), target, settings, types=types).run()
    shown = lambda rs: [(model.text_of(r["conditions"]), r["coverage"], round(r["quality"], 9), round(r["secondary"], 6)) for r in rs]
    assert a and shown(a) == shown(b)


def test_missing_values_are_in_no_condition(spark):
    rows = [(None if i % 5 == 0 else float(i % 10), None if i % 7 == 0 else "ab"[i % 2], None if i % 6 == 0 else i % 2 == 0, float(i)) for i in range(210)]
    df = spark.createDataFrame(rows, "n double, s string, b boolean, y double")
    found = {model.text_of(r["conditions"]): r for r in SubgroupDiscovery(df, Target("single_numeric", ("y",)), Settings(measure="average", minimum=float("-inf"), numeric_strategy="all", min_coverage=1)).run()}
    own = {"s = 'a'": [r[3] for r in rows if r[1] == "a"], "b = '1'": [r[3] for r in rows if r[2]], "b = '0'": [r[3] for r in rows if not r[2]], "n <= 4.0": [r[3] for r in rows if r[0] is not None and r[0] <= 4]}
    for text_, values in own.items():
        assert found[text_]["coverage"] == len(values) and found[text_]["secondary"] == pytest.approx(np.mean(values))
    assert not any("None" in t or "nan" in t for t in found)
    # a missing target counts nowhere
    holes = df.withColumn("y", F.when(F.col("y") % 3 != 0, F.col("y")))
    (r,) = [r for r in SubgroupDiscovery(holes, Target("single_numeric", ("y",)), Settings(measure="average", minimum=float("-inf"), min_coverage=1), types={"s": "nominal"}).run() if r["conditions"][0].value == "a"]
    assert r["coverage"] == sum(x[1] == "a" and x[3] % 3 != 0 for x in rows)


def test_value_sets_are_the_best_prefix(spark):
    rng = np.random.default_rng(9)
    rows = [("abcdefgh"[k], bool(rng.random() < k / 8)) for k in rng.integers(0, 8, 400)]
    df = spark.createDataFrame(rows, "s string, t boolean")
    (best,) = SubgroupDiscovery(df, Target("single_nominal", ("t",)), Settings(measure="wracc", minimum=0.0, nominal_sets=True)).run()
    share = np.mean([r[1] for r in rows])
    score = lambda own: sum(r[1] - share for r in rows if r[0] in own) / len(rows)
    every = [{v for i, v in enumerate("abcdefgh") if m >> i & 1} for m in range(1, 255)]
    assert best["quality"] == pytest.approx(max(map(score, every))) == pytest.approx(score(best["conditions"][0].value))


def test_bayesian_tails_sum_only_terms_that_count(monkeypatch):
    every = lambda c, d, a, b: np.logaddexp.reduce([float(kernels._log_beta(a + k, b + d) - np.log(d + k) - kernels._log_beta(1 + k, d) - kernels._log_beta(a, b)) for k in range(c)])
    for x in [(1, 1, 1, 1), (300, 1, 5, 900), (40, 700, 3, 41), (500, 500, 500, 500), (200, 3, 100_000, 300), (350, 90_000, 2, 400), (250, 250_000, 250, 260_000)]:
        assert kernels.log_exceeds(*x) == pytest.approx(every(*x), rel=1e-12, abs=1e-12)
    seen, plain = [], kernels.log_gamma
    monkeypatch.setattr(kernels, "log_gamma", lambda x: (seen.append(np.size(x)), plain(x))[1])
    kernels.bayesian_score(9e6, 3e6, 4.5e6, 1.501e6)
    assert sum(seen) < 1_000_000


@pytest.mark.parametrize("columns", [1, 2])
def test_l2_is_the_sum_over_all_pairs(spark, columns, monkeypatch):
    """Both sides, small and large ones, against all pairs in one task; a side without rows and a constant column score 0."""
    from sieveline.operators import kernel_search

    rng = np.random.default_rng(5)
    rows = [("abbbbb"[i % 6], "x" if i else "y", float(rng.integers(0, 30)), float(rng.normal() * 40 + (i % 6 == 0) * 30), 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, r string, x double, y double, flat double").repartition(5)
    names = ["x", "y"][:columns]
    run = lambda own: {r["conditions"][0].attribute + r["conditions"][0].value: r for r in SubgroupDiscovery(df, Target("multi_numeric", tuple(own)), Settings(measure="l2", minimum=float("-inf"), min_coverage=1), types={"s": "nominal", "r": "nominal"}).run()}
    monkeypatch.setattr(kernel_search, "MOST_HELD", 1)
    found = run(names)
    assert set(found) == {"sa", "sb", "rx", "ry"}
    data = np.array([r[2 : 2 + columns] for r in rows])
    for key, r in found.items():
        inside = np.array([x["sr".index(key[0])] == key[1] for x in rows])
        a, b = data[inside], data[~inside]
        sd = [x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(columns) for x in (a, b)]
        scale = kernels.l2_scale(len(a), sd[0], len(b), sd[1])
        want = kernels.l2_of(kernels.pair_kernel_sum(a, b, np.ones(len(a)), np.ones(len(b)), scale), scale, len(a), len(b))
        assert r["quality"] == pytest.approx(want, rel=1e-11)
        assert (r["coverage"], r["secondary"], r["tertiary"]) == (len(a), len(a), len(b))
    assert {r["quality"] for r in run(["flat"]).values()} == {0.0}


def test_l2_writes_no_row_for_each_refinement(spark, monkeypatch):
    from sieveline.operators import kernel_search

    monkeypatch.setattr(kernel_search, "_sides", lambda *a: pytest.fail("every row for every refinement"))
    df = spark.range(400).selectExpr("id % 13 * 1.0 as x", "id * 0.5 as y", "string(id % 3) as s")
    assert SubgroupDiscovery(df, Target("multi_numeric", ("x", "y")), Settings(measure="l2", minimum=float("-inf"), min_coverage=20)).run()


def test_arff_in_several_files(spark, tmp_path):
    """The header is in the first file by name, also where others are longer, a file is empty or a name has a space."""
    folder = tmp_path / "two parts"
    folder.mkdir()
    (folder / "part-00000").write_text("")
    (folder / "part-00001").write_text("@relation r\n@attribute n numeric\n@attribute b {0,1}\n@data\n1,0\n")
    (folder / "part-00002").write_text("".join(f"{i},{i % 2}\n" for i in range(2, 3000)))
    got = sorted(map(tuple, arff.read_arff(spark, str(folder)).collect()))
    assert got == [(float(i), i > 1 and i % 2 == 1) for i in range(1, 3000)]


def test_arff_query_writes_no_single_task(spark, tmp_path, monkeypatch):
    from sieveline.plans import catalog

    spark.range(20_000).selectExpr("id as o_orderkey", "id * 1.5 as o_totalprice", "id % 7 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    seen, plain = [], arff.read_arff
    monkeypatch.setattr(arff, "read_arff", lambda s, path: (seen.append(path), plain(s, path))[1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, catalog.QUERIES["IO08_arff"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == [(float(i), i * 1.5, i % 2 == 1, f"c {i % 7}") for i in range(20_000)]
    assert spark.read.text(seen[0]).select("_metadata.file_name").distinct().count() > 1


def test_corners_of_intervals_are_few():
    from sieveline.operators import refine

    rng = np.random.default_rng(2)
    p = np.vstack([[0, 0], np.cumsum(np.stack([np.ones(1500), rng.random(1500) < 0.33], axis=1), axis=0)])
    pairs = refine.extreme_intervals(p)
    assert len(pairs) < 600 and all(i < j for i, j in pairs)
    i, j = np.triu_indices(len(p), 1)
    ways = np.concatenate((rng.normal(size=(2, 50)), [[1, -1, 1, 0, 0], [-3, 3, -2, 1, -1]]), axis=1)
    assert np.allclose((np.array([p[b] - p[a] for a, b in pairs]) @ ways).max(axis=0), ((p[j] - p[i]) @ ways).max(axis=0))
