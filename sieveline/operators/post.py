"""Post-processing of results: specialisations, cover-based choice, pattern teams, ROC, redundancy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import kernels
from sieveline.model import Target
from sieveline.operators import refine, tables
from sieveline.operators.patterns import Patterns, pattern_counts  # noqa: F401


def without_weak_specialisations(results: list[dict], least: float) -> list[dict]:
    """Leave out subgroups that narrow another one of the list without a gain above ``least``."""
    return [r for r in results if not any(model.specialises(r["conditions"], o["conditions"]) and r["quality"] - o["quality"] <= least for o in results)]


def cover_choice(df: DataFrame, rows: list[dict], k: int, alpha: float = 0.9, others: float = -math.inf) -> tuple[list[int], bool]:
    """Greedy choice of k: a subgroup's quality times the mean of alpha^(times its rows are covered already).

    Returns indices, and whether no subgroup with a quality of ``others`` or less would have been chosen before one of them.
    Subgroups without rows weigh nothing. Of equals the first is chosen.
    """
    if not rows:
        return [], True
    with Patterns(df, [r["conditions"] for r in rows]) as patterns:
        left, chosen = list(range(len(rows))), []
        while left and len(chosen) < k:
            covered = patterns.by_times(chosen)
            weight = covered @ alpha ** np.arange(covered.shape[1]) / np.maximum(covered.sum(1), 1)
            best = max(left, key=lambda i: (rows[i]["quality"] * weight[i], -i))
            if rows[best]["quality"] * weight[best] < others:
                return chosen, False
            chosen.append(best)
            left.remove(best)
    return chosen, len(chosen) == k or others == -math.inf


def cover_based(df: DataFrame, rows: list[dict], k: int, alpha: float = 0.9) -> list[dict]:
    return [rows[i] for i in cover_choice(df, rows, k, alpha)[0]]


def pattern_team(df: DataFrame, results: list[dict], k: int) -> list[int]:
    """Indices of a greedy choice of k subgroups with the greatest joint entropy; of equals the first."""
    team: list[int] = []
    if not results:
        return team
    with Patterns(df, [r["conditions"] for r in results]) as patterns:
        while len(team) < min(k, len(results)):
            h = patterns.entropies(team)
            team.append(max((i for i in range(len(results)) if i not in team), key=lambda i: (h[i], -i)))
    return team


def correlations(both: np.ndarray, size: np.ndarray, team: list[int], total: int) -> np.ndarray:
    """Phi correlations of covers with those of a team, from numbers of rows; 0 where one is constant."""
    p = size / total
    sd = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (both / total - np.outer(p, p[team])) / np.outer(sd, sd[team])
    return np.where(np.isfinite(r), r, 0.0)


def group_by_team(df: DataFrame, results: list[dict], team: list[int]) -> list[int]:
    """For each result the team member whose cover correlates most with its own (absolute value)."""
    if not results:
        return []
    with Patterns(df, [x["conditions"] for x in results]) as patterns:
        r = np.abs(correlations(patterns.together(team), patterns.by_times([])[:, 0], team, patterns.rows()))
    return [team[int(np.argmax(x))] for x in r]


def cover_redundancy(df: DataFrame, results: list[dict]) -> tuple[float, float]:
    """(mean over rows of |times covered - mean| / mean, joint entropy)."""
    with Patterns(df, [r["conditions"] for r in results]) as patterns:
        n, h = patterns.times(), patterns.entropy()
    times = np.arange(len(n))
    mean = (times * n).sum() / n.sum()
    return float((np.abs(times - mean) * n).sum() / n.sum() / mean), h


def roc_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Upper convex hull of ROC points with (0,0) and (1,1)."""
    hull: list[tuple[float, float]] = []
    for p in sorted({(0.0, 0.0), (1.0, 1.0), *points}, key=lambda q: (q[0], q[1])):
        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]) >= 0:
            hull.pop()
        hull.append(p)
    return hull


def on_roc_hull(points: list[tuple[float, float]]) -> list[bool]:
    """Which points lie on the hull; those without false positives are left out."""
    hull = set(roc_hull(points))
    return [p in hull and p[0] > 0 for p in points]


def area_under(hull: list[tuple[float, float]]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(hull, hull[1:]))


def roc(results: list[dict], n: float, h: float) -> tuple[list[tuple[float, float]], float]:
    """Points (false, true positive rate) of nominal results and the area under their hull."""
    points = [((r["coverage"] - r["tertiary"]) / (n - h), r["tertiary"] / h) for r in results]
    return points, area_under(roc_hull(points))


def alternatives(df: DataFrame, key: str, results: list[dict]) -> list[list[int]]:
    """Groups of results with one extent, by count and two order-free hashes of the rows' keys."""
    e = [model.conjunction(r["conditions"]) for r in results]
    aggs = [f for i, c in enumerate(e) for f in (F.count_if(c), F.bit_xor(F.when(c, F.xxhash64(key))), F.sum(F.when(c, F.crc32(F.col(key).cast("string").cast("binary")))))]
    row = df.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()
    groups: dict[tuple, list[int]] = {}
    for i in range(len(results)):
        groups.setdefault(tuple(row[3 * i : 3 * i + 3]), []).append(i)
    return list(groups.values())


def extents(df: DataFrame, results: list[dict], keep: list[str], fold: str | None = None) -> DataFrame:
    """One 0/1 column for each subgroup, beside the kept columns and the fold name."""
    own = [F.lit(fold).alias("fold")] if fold else []
    return df.select(*own, *keep, *(model.conjunction(r["conditions"]).cast("int").alias(f"s{i}") for i, r in enumerate(results, 1)))


def rescored_by_networks(df: DataFrame, target: Target, results: list[dict], measure: str = "weed", networks: int = 20) -> list[dict]:
    """Multi-label results scored anew by the mean over ``networks`` x ``networks`` pairs of networks of all rows and of the subgroup, learned from different seeds, and ranked by it."""
    k = len(target.columns)
    pattern = sum((F.shiftleft(F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("long"), i) for i, c in enumerate(target.columns)), F.lit(0).cast("long"))
    counted = df.select(F.explode(F.concat(F.array(F.lit(-1)), refine.covering([r["conditions"] for r in results]))).alias("i"), pattern.alias("x")).groupBy("i", "x").agg(F.count(F.lit(1)).alias("c"))
    counted = tables.materialised(counted)  # 2^labels patterns a subgroup at most
    everything = {r["x"]: r["c"] for r in counted.where("i = -1").collect()}
    total = sum(everything.values())
    known = [kernels.learn_network(everything, k, seed) for seed in range(networks)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(pdf["x"].tolist(), pdf["c"].tolist()))
        learned = [kernels.learn_network(own, k, networks + seed) for seed in range(networks)]
        mean = sum(kernels.edit_distance(a, b, k) if measure == "edit_distance" else kernels.weed(kernels.edit_distance(a, b, k), sum(own.values()) / total) for a in known for b in learned) / networks**2
        return pd.DataFrame([(int(pdf["i"].iloc[0]), mean)], columns=["i", "quality"])

    scores = {r["i"]: r["quality"] for r in counted.where("i >= 0").groupBy("i").applyInPandas(run, "i int, quality double").collect()}
    return sorted(({**r, "quality": scores.get(i, 0.0)} for i, r in enumerate(results)), key=lambda r: -r["quality"])


def threshold_points(df: DataFrame, column: str, results: list[dict]) -> DataFrame:
    """(threshold, subgroup, fpr, tpr): ROC points of results for the target ``column >= threshold`` at every distinct value but the least."""
    x = F.col(f"`{column}`").cast("double")
    known = df.where(x.isNotNull())
    counts = known.select(F.explode(F.concat(F.array(F.lit(-1)), refine.covering([r["conditions"] for r in results]))).alias("subgroup"), x.alias("v")).groupBy("subgroup", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = tables.materialised(counts)
    whole = tables.running(counts.where("subgroup = -1"), "v", ["n"], ascending=False).select(F.col("v").alias("threshold"), F.col("run_n").alias("H"))
    total = float(known.count())
    size = counts.where("subgroup >= 0").groupBy("subgroup").agg(F.sum("n").alias("B"))
    # each subgroup's count at every threshold, also where it has no row of that value
    every = whole.where(F.col("H") < total).select(F.explode(F.sequence(F.lit(0), F.lit(len(results) - 1))).alias("subgroup"), F.col("threshold").alias("v"), "H")
    filled = every.join(counts, ["subgroup", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    rows = tables.running(filled, "v", ["n"], ("subgroup",), ascending=False).join(F.broadcast(size), "subgroup")
    return rows.select(F.col("v").alias("threshold"), "subgroup", ((F.col("B") - F.col("run_n")) / (total - F.col("H"))).alias("fpr"), (F.col("run_n") / F.col("H")).alias("tpr"))


def threshold_areas(df: DataFrame, column: str, results: list[dict]) -> DataFrame:
    """(threshold, area): area under the hull of the results' ROC points at every threshold."""

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["threshold"].iloc[0], area_under(roc_hull(list(zip(pdf["fpr"], pdf["tpr"])))))], columns=["threshold", "area"])

    return threshold_points(df, column, results).groupBy("threshold").applyInPandas(area, "threshold double, area double")


def bayes_statistics(df: DataFrame, x, t) -> DataFrame:
    """P(X|T), P(X|not T), P(T|X), P(T|not X) of two boolean columns."""
    rate = lambda a, b: F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0))
    return df.agg(rate(x, t).alias("x_given_t"), rate(x, ~t).alias("x_given_not_t"), rate(t, x).alias("t_given_x"), rate(t, ~x).alias("t_given_not_x"))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))
