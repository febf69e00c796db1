"""Delta Lloyd against a plain Lloyd over all pairs."""

import hashlib
import math
import random

import numpy as np

from sieveline.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, block string"


def plain(rows, k, dimensions, rounds=clustering.ROUNDS):
    """(rows (vec_id, cluster, distance), centroids) in Python integers."""
    fine = lambda e: e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) and abs(256 * float(np.float32(x))) <= clustering.MOST for x in e)
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e, *_ in rows if fine(e)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]
    for r in range(rounds + 1):
        owners = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owners) if o == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    return sorted(((i, o, d) for (i, _), (d, o) in zip(kept, owners)), key=str), centroids


def odd_rows(seed, n, dimensions):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + 3 * (i % 4)) for _ in range(dimensions)]) for i in range(n)]
    rows += [(n + j, rows[0][1]) for j in range(n // 3)]  # one very common vector
    rows += [rows[1], rows[1], (None, rows[2][1]), (None, rows[3][1]), (900, None), (901, []), (902, [1.0]), (903, [None] * dimensions), (904, [math.nan] + [0.0] * (dimensions - 1)),
             (905, [math.inf] + [0.0] * (dimensions - 1)), (906, [1e30] + [0.0] * (dimensions - 1)), (907, [2e5] * dimensions), (908, [-2e5] * dimensions), (909, [0.0] * dimensions)]
    return [(*r, 1, "c", "b") for r in rows]


def test_against_plain_lloyd(spark):
    for seed, n, dimensions, k in ((1, 60, 3, 7), (2, 40, 64, 12), (3, 5, 2, 40)):
        rows = odd_rows(seed, n, dimensions)
        found = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, dimensions=dimensions)
        want, centroids = plain(rows, k, dimensions)
        assert sorted(map(tuple, found.rows.collect()), key=str) == want
        assert [tuple(c) for c in found.centroids.tolist()] == centroids
        assert found.inertia == {j: sum(d for _, o, d in want if o == j) for j in {o for _, o, _ in want}}


def test_rounds_compare_less_and_less(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(0, 10) * 100 + rng.normal(size=4)).tolist(), 0, "", "") for i in range(3000)]
    found = clustering.cluster(spark.createDataFrame(rows, SCHEMA), k=10, dimensions=4)
    full = 3000 * 10
    assert found.compared[0] == full and found.compared[-1] < full / 2 and len(found.compared) == clustering.ROUNDS + 1


def test_reassignment_is_exact():
    """Owners that stay, move or are lost, with ties, against a comparison with all; numbers beyond 2^53 too."""
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 24):
        x, c = rng.integers(-scale, scale, (200, 5)).astype(np.int32), rng.integers(-scale, scale, (9, 5)).astype(np.int64)
        c[4] = c[2]
        owner, distance, n = clustering.reassigned(x, np.full(200, -1, np.int32), np.zeros(200, np.int64), c, np.ones(9, bool))
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x])
        assert n == 1800 and (owner == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        new, changed = c.copy(), np.zeros(9, bool)
        changed[[1, 2, 7]] = True
        new[[1, 2, 7]] += rng.integers(-scale, scale, (3, 5))
        after, d, n = clustering.reassigned(x, owner, distance, new, changed)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in new] for v in x])
        assert n < 1800 and (after == exact.argmin(1)).all() and (d == exact.min(1)).all()
        touched, sums = clustering.transfers(x, owner, after, 9)
        total = np.zeros((9, 6), np.int64)
        total[touched] = sums
        for j in range(9):
            gained, lost = x[(after == j) & (owner != j)].astype(np.int64), x[(owner == j) & (after != j)].astype(np.int64)
            assert (total[j] == np.concatenate(([len(gained) - len(lost)], gained.sum(0) - lost.sum(0)))).all()


def test_empty_and_tables_that_go(spark):
    none = clustering.cluster(spark.createDataFrame([], SCHEMA))
    assert none.rows.count() == 0 and none.inertia == {}
    nothing = clustering.cluster(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA))
    assert nothing.rows.columns == ["vec_id", "cluster", "distance"] and nothing.rows.count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sieveline_")]
