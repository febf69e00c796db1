"""Randomised qualities, thresholds and p-values, folds."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline import model
from sieveline.model import Condition, Settings, Target
from sieveline.operators import runs_together
from sieveline.operators.post import normal_cdf
from sieveline.operators.refine import quality_of
from sieveline.operators.search import SubgroupDiscovery
from sieveline.operators.stats import statistics
from sieveline.operators.tables import materialised

#: Standard normal quantiles of the 1, 5 and 10 % thresholds.
QUANTILES = {0.01: 2.3263478740408408, 0.05: 1.6448536269514722, 0.1: 1.2815515655446004}


def numbered(df: DataFrame, seed: int, name: str = "row_id") -> DataFrame:
    """A dense number from 0 in a seeded order, without one task for all rows: partition sizes first, then offsets."""
    # written once: sizes and places must see the same random numbers
    parted = materialised(df.withColumn("__r", F.rand(seed)).withColumn("__p", F.floor(F.col("__r") * 4096).cast("int")))
    sizes = parted.groupBy("__p").count()
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__r")) - 1
    return parted.withColumn("__i", place).join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__r", "__p", "__i", "__before")


def sample_exactly(df: DataFrame, k: int, seed: int = 10) -> DataFrame:
    """A uniform sample of k rows."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(k).drop("__r")


def permuted(df: DataFrame, columns: tuple[str, ...], seed: int) -> DataFrame:
    """The table with these columns' rows shuffled against the others."""
    base = materialised(numbered(df, seed))
    other = materialised(numbered(df.select(*columns), seed + 1))
    return base.drop(*columns).join(other, "row_id").drop("row_id").select(*df.columns)


def random_subset_qualities(df: DataFrame, target: Target, settings: Settings, sizes: list[int], seed: int = 10) -> list[float]:
    """Quality of random subsets of about these sizes: replicate ids are group keys of one aggregate."""
    stats = statistics(df, target)
    n = stats.whole["N"]
    members = F.filter(F.array(*(F.when(F.rand(seed + i) < k / n, F.lit(i)) for i, k in enumerate(sizes))), lambda x: x.isNotNull())
    own = df.select(*(v.alias(k) for k, v in stats.parts.items()), members.alias("m")).select(F.explode("m").alias("cand"), *stats.parts)
    g = own.groupBy("cand").agg(*(F.sum(p).alias(p) for p in stats.parts)).withColumns({k: F.lit(float(v)) for k, v in stats.whole.items()})
    return [r[0] for r in g.select(quality_of(stats.measures[settings.measure]), "cand").orderBy("cand").collect()]


def random_descriptions(df: DataFrame, types: dict[str, str], depth: int, count: int, seed: int = 10) -> list[tuple]:
    """Random conjunctions of 1..depth conditions; numeric thresholds lie in the middle 80 % of the range."""
    rng = random.Random(seed)
    numeric = [a for a, t in types.items() if t == model.NUMERIC]
    ranges = dict(zip(numeric, df.agg(*(F.struct(F.min(a), F.max(a)).alias(a) for a in numeric)).first())) if numeric else {}
    domains = {a: df.select(a).where(F.col(a).isNotNull()).distinct() for a, t in types.items() if t != model.NUMERIC}
    sizes = {a: values.count() for a, values in domains.items()}
    out, drawn = [], {a: set() for a in domains}
    for _ in range(count):
        own = []
        for _ in range(rng.randint(1, depth)):
            a = rng.choice(list(types))
            if types[a] == model.NUMERIC:
                lo, hi = (float(x) for x in ranges[a])
                own.append(Condition(a, rng.choice((model.AT_MOST, model.AT_LEAST)), lo + (0.1 + 0.8 * rng.random()) * (hi - lo)))
            else:
                own.append((a, rng.randrange(sizes[a])))
                drawn[a].add(own[-1][1])
        out.append(own)
    # the values at the drawn positions of each sorted domain
    at = {a: domains[a].orderBy(a).rdd.zipWithIndex().filter(lambda r, own=drawn[a]: r[1] in own).map(lambda r: (r[1], r[0][0])).collectAsMap() for a in domains if drawn[a]}
    return [tuple(c if isinstance(c, Condition) else Condition(c[0], model.EQUALS, at[c[0]][c[1]]) for c in own) for own in out]


def description_qualities(df: DataFrame, target: Target, settings: Settings, descriptions: list[tuple]) -> list[float | None]:
    """Quality of each description, in one aggregate over all."""
    stats = statistics(df, target)
    aggs = [F.sum(F.when(model.conjunction(c), v).otherwise(0.0)).alias(f"{k}__{i}") for i, c in enumerate(descriptions) for k, v in stats.parts.items()]
    row = df.agg(*aggs).first().asDict()
    rows = [tuple([i, *(row[f"{k}__{i}"] for k in stats.parts), *map(float, stats.whole.values())]) for i in range(len(descriptions))]
    names = ["i", *stats.parts, *stats.whole]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["i int", *(f"{n} double" for n in names[1:])]))
    e = F.when(F.col(stats.count) > 0, quality_of(stats.measures[settings.measure]))
    return [r[0] for r in table.orderBy("i").select(e).collect()]


def swap_randomised(df: DataFrame, target: Target, settings: Settings, repeats: int, seed: int = 10) -> list[float]:
    """The best quality of a run on each of ``repeats`` tables with a permuted target."""
    quiet = replace(settings, max_results=1, minimum=float("-inf"), p_values="")
    if runs_together.suits(target, quiet):
        own = df.select(*dict.fromkeys([*model.attribute_types(df, target.columns), *target.columns]))
        rows, runs = runs_together.of_permutations(own, target, repeats, seed)
        found = runs_together.SearchTogether(rows, target, quiet, runs).run_all()
    else:
        found = [SubgroupDiscovery(permuted(df, target.columns, seed + 2 * i), target, quiet).run() for i in range(repeats)]
    return [own[0]["quality"] if own else 0.0 for own in found]


def fitted(qualities: list[float]) -> tuple[float, float]:
    """Mean and deviation (n - 1)."""
    x = np.array(qualities, float)
    return float(x.mean()), float(x.std(ddof=1)) if len(x) > 1 else 0.0


def thresholds(qualities: list[float]) -> dict[float, float]:
    mean, sd = fitted(qualities)
    return {a: mean + q * sd for a, q in QUANTILES.items()}


def gaussian_p(quality: float, qualities: list[float]) -> float:
    mean, sd = fitted(qualities)
    return 1 - normal_cdf(quality, mean, sd) if sd else float(quality <= mean)


def empirical_p(quality: float, qualities: list[float]) -> float:
    return sum(x >= quality for x in qualities) / len(qualities)


def randomised_qualities(df: DataFrame, target: Target, settings: Settings, seed: int = 10) -> list[float]:
    """Qualities under the settings' null model: the best of runs on permuted targets, random subsets, or random descriptions."""
    if settings.randomised == "swap":
        return swap_randomised(df, target, settings, settings.repeats, seed)
    total = df.count()
    if settings.randomised == "subsets":
        rng = random.Random(seed)
        least = min(settings.min_coverage, max(total - 1, 1))
        return [q for q in random_subset_qualities(df, target, settings, [rng.randint(least, max(total - 1, least)) for _ in range(settings.repeats)], seed) if q is not None]
    types = model.attribute_types(df, target.columns)
    drawn = random_descriptions(df, types, settings.depth, settings.repeats, seed)
    return [q for q in description_qualities(df, target, settings, drawn) if q is not None]


def assign_p_values(df: DataFrame, target: Target, settings: Settings, results: list[dict], qualities: list[float] | None = None) -> list[dict]:
    """Fills p_value of each result: the share of randomised qualities that are at least as high, or the tail of a normal distribution fitted to them."""
    if settings.p_values not in ("gaussian", "empirical"):
        raise ValueError("p_values is gaussian or empirical")
    qualities = randomised_qualities(df, target, replace(settings, p_values="")) if qualities is None else qualities
    p = gaussian_p if settings.p_values == "gaussian" else empirical_p
    for r in results:
        r["p_value"] = p(r["quality"], qualities)
    return results


def set_p(best: float, qualities: list[float]) -> float:
    return sum(x > best for x in qualities) / len(qualities)


def regression_test(results: list[dict], qualities: list[float], k: int, legacy_sum: bool = False) -> float:
    """Mean quality of the first k results in deviations of the random ones from their mean."""
    mean, sd = fitted(qualities)
    own = [r["quality"] for r in (results if legacy_sum else results[:k])]
    return (sum(own) / k - mean) / sd if sd else math.nan


def with_folds(df: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """Balanced folds 0..k-1 in a seeded order."""
    return numbered(df, seed, "__n").withColumn("fold", (F.col("__n") % k).cast("int")).drop("__n")


def cross_validate(df: DataFrame, target: Target, settings: Settings, k: int = 10, seed: int = 1) -> list[list[dict]]:
    """Results on the rows outside each fold."""
    return results_by_fold(materialised(with_folds(df, k, seed)), "fold", k, target, settings)


def results_by_fold(folded: DataFrame, fold: str, k: int, target: Target, settings: Settings) -> list[list[dict]]:
    """The same for folds 0..k-1 that a column of the table gives: all in one search where the settings allow it."""
    if runs_together.suits(target, settings):
        return runs_together.SearchTogether(folded, target, settings, runs_together.of_folds(folded, target, fold, k)).run_all()
    return [SubgroupDiscovery(folded.where(~F.col(fold).eqNullSafe(i)).drop(fold), target, settings).run() for i in range(k)]
