"""Scoring of targets whose statistics are not sums of a row's numbers.

Refinements come from the same aggregate as elsewhere (coverage gates first);
their conditions then mark rows, which are counted by refinement and distinct
target value. What a measure needs of these counts is again a sum, over grid
points or waves that are fixed from a few moments: tasks add up kernels for the
values they hold, and sums of at most a grid's size meet for each refinement.
Values are never brought to the driver or to one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import kernels, measures
from sieveline.model import Conditions, Settings, Target
from sieveline.operators import refine, tables
from sieveline.operators.stats import Statistics, positive

TARGETS = {"multi_numeric", "multi_label", "scape"}
MEASURES = {*kernels.DENSITY, *kernels.DENSITY_2D, "l2", "edit_distance", "weed", "mmad"}
#: Refinements scored by kernels at one level; more are an error that asks for a higher coverage gate.
MOST = 5000
#: Distinct rows of one side for which ``l2`` of three or more columns compares all pairs; more are an error.
MOST_PAIRED = 20_000
#: Cells of densities of two columns in the smallest deviation of a kernel: a density at z deviations errs by about z^2 / (24 FINE^2).
FINE = 32
#: Numbers of grids that a task adds up before it passes them on.
MOST_HELD = 8_000_000
_SCORES = "i int, quality double, secondary double, tertiary double"


def base(df: DataFrame, target: Target) -> Statistics:
    n = df.count()
    known = {m: measures.Measure(m, m, 0.0) for m in MEASURES} | measures.SCAPE
    return Statistics({"c0": F.lit(1.0)}, {"N": float(n)}, "c0", "c0", "N - c0", known)


def _value_columns(target: Target) -> list[Column]:
    cols = [F.col(f"`{c}`") for c in target.columns]
    if target.type == "multi_label":
        return [sum((F.shiftleft(F.coalesce(c, F.lit(False)).cast("long"), i) for i, c in enumerate(cols)), F.lit(0).cast("long")).alias("x0")]
    if target.type == "scape":
        return [positive(Target("single_nominal", target.columns[:1], target.value)).cast("double").alias("x0"), cols[1].cast("double").alias("x1")]
    return [c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)]


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("c"))


def _dealt(rows: DataFrame, sides: int, *values: str) -> DataFrame:
    """Rows of each refinement together, or, of few refinements, in as many shares as there are partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "i", F.pmod(F.xxhash64(*values), F.lit(max(1, parts // max(1, sides)))))


def _of_one_column(data: DataFrame, marked: DataFrame, found: int, measure: str) -> DataFrame:
    """Densities over a grid fixed from all rows; the whole table counts as refinement -1."""
    row = data.agg(F.count("x0"), F.stddev_samp("x0"), F.min("x0"), F.max("x0")).first()
    counts = tables.materialised(_counted(data, "x0"))
    quartiles = tables.quantiles(counts, "x0", "c", {"q1": 0.25, "q3": 0.75}).first()
    h = kernels.bandwidth_of(row[0], row[1] or 0.0, *quartiles, row[2], row[3])
    grid = kernels.grid_of(row[2], row[3], h)
    everything = counts.select(F.lit(-1).alias("i"), "x0", "c")
    inside = tables.materialised(_counted(marked, "i", "x0"))

    def partial(frames):
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for i, own in pdf.groupby("i"):
                sums[i] = sums.get(i, 0.0) + kernels.kernel_sums(own["x0"].to_numpy(float), own["c"].to_numpy(float), grid, h)
        for i, s in sums.items():
            yield pd.DataFrame({"i": np.int32(i), "g": np.arange(len(s), dtype=np.int32), "s": s})

    sums = _dealt(inside.unionByName(everything), found + 1, "x0").mapInPandas(partial, "i int, g int, s double").groupBy("i", "g").agg(F.sum("s").alias("s"))
    sums = tables.materialised(sums)
    factor = h * math.sqrt(2 * math.pi)
    whole = np.array([r[0] for r in sums.where("i = -1").orderBy("g").select("s").collect()]) / (row[0] * factor)  # one grid
    mean = F.sum(F.col("c") * F.col("x0")) / F.sum("c")
    numbers = inside.groupBy("i").agg(F.sum("c").alias("n"), mean.alias("mean"), F.sum(F.col("c") * F.col("x0") * F.col("x0")).alias("squares"))
    total = float(row[0])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, squares = (float(pdf[c].iloc[0]) for c in ("n", "mean", "squares"))
        own = pdf.sort_values("g")["s"].to_numpy(float) / (n * factor)
        sd = math.sqrt(max(squares - n * mean * mean, 0.0) / (n - 1)) if n > 1 else 0.0
        return pd.DataFrame([(int(pdf["i"].iloc[0]), kernels.divergence(measure, whole, own, n / total), mean, sd)], columns=["i", "quality", "secondary", "tertiary"])

    return sums.where("i >= 0").join(numbers, "i").groupBy("i").applyInPandas(compare, _SCORES)


def _sides(data: DataFrame, marked: DataFrame, found: int, names: list[str]) -> DataFrame:
    """(i, values, c, d): every distinct row for every refinement, counted inside and outside it."""
    inside = _counted(marked, "i", *names)
    everything = _counted(data, *names).select(F.explode(F.sequence(F.lit(0), F.lit(found - 1))).alias("i"), *names, F.col("c").alias("all"))
    both = everything.join(inside, ["i", *names], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    return tables.materialised(both.select("i", *names, "c", (F.col("all") - F.col("c")).alias("d")))


def _moments(sides: DataFrame, names: list[str]) -> list:
    """Counts, sums and sums of products of each refinement and of the rest, about the means of all rows."""
    centre = sides.where("i = 0").agg(*((F.sum((F.col("c") + F.col("d")) * F.col(x)) / F.sum(F.col("c") + F.col("d"))).alias(x) for x in names)).first()
    at = {x: F.col(x) - F.lit(centre[j]) for j, x in enumerate(names)}
    pairs = [(a, b) for j, a in enumerate(names) for b in names[j:]]
    aggs = [F.sum(w).alias(f"n_{w}") for w in "cd"]
    aggs += [F.sum(F.col(w) * at[x]).alias(f"s_{w}_{x}") for w in "cd" for x in names]
    aggs += [F.sum(F.col(w) * at[a] * at[b]).alias(f"s_{w}_{a}_{b}") for w in "cd" for a, b in pairs]
    return sides.groupBy("i").agg(*aggs).orderBy("i").collect()


def _sums_about(rows: DataFrame, names: list[str], centre: list[float], *keys: str) -> list:
    """Counts, sums and sums of products of two columns about a centre, in the order that ``kernels.moments`` takes."""
    x, y = (F.col(n) - F.lit(c) for n, c in zip(names, centre))
    terms = (F.lit(1.0), x, y, x * x, y * y, x * y)
    return rows.groupBy(*keys).agg(*(F.sum(t).alias(f"m{j}") for j, t in enumerate(terms))).collect()


def _in_cells(rows: DataFrame, names: list[str], low: np.ndarray, width: np.ndarray, *keys: str) -> DataFrame:
    """(keys, p0, p1, c, o0, o1): rows counted by cell, with the sums of their places inside it."""
    at = [F.col(n) - F.lit(float(a)) for n, a in zip(names, low)]
    place = [F.floor(x / F.lit(float(w))) for x, w in zip(at, width)]
    own = rows.select(*keys, *(p.alias(f"p{j}") for j, p in enumerate(place)), *((x - p * F.lit(float(w))).alias(f"o{j}") for j, (x, p, w) in enumerate(zip(at, place, width))))
    return own.groupBy(*keys, "p0", "p1").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("o0").alias("o0"), F.sum("o1").alias("o1"))


def _plane_term(name: str) -> tuple[Column, bool]:
    """What a point of a grid of two columns with densities q (subgroup) and p (rest) adds, and whether a point without q makes the sum infinite."""
    p, q = F.col("p"), F.col("q")
    if "hellinger" in name:
        return F.pow(F.sqrt(p) - F.sqrt(q), 2) / 2, False
    if "kullback" in name:
        return F.when(q == 0, 0.0).when(p == 0, math.inf).otherwise(q * (F.ln(q) - F.ln(p))), True
    return F.abs(p - q), False


def _of_two_columns(data: DataFrame, marked: DataFrame, found: int, measure: str, names: list[str]) -> DataFrame:
    """Subgroup against complement on a common grid for each refinement, whose step follows the bandwidths.

    Rows are merged in cells of a FINEth of the smallest deviation; a cell stands at the mean of its rows, of a
    refinement's and of the others each. What is outside is a cell's whole less what is inside, so that no row is
    written for a refinement that does not cover it.
    """
    first = data.agg(*(f(x) for f in (F.avg, F.min, F.max) for x in names)).first()
    if first[0] is None:
        return data.sparkSession.createDataFrame([], _SCORES)
    centre, low, high = list(first[:2]), np.array(first[2:4], float), np.array(first[4:], float)
    whole = np.array(_sums_about(data, names, centre)[0], float)
    planes, flat = {}, []
    for r in _sums_about(marked, names, centre, "i"):
        own = np.array(r[1:], float)
        rest = whole - own
        plane = kernels.plane_of(own[0], kernels.moments(*own)[1], rest[0], kernels.moments(*rest)[1], low, high) if min(own[0], rest[0]) >= 3 else None
        if plane:
            planes[r["i"]] = plane | {"n": own[0], "m": rest[0]}
        else:
            flat.append((r["i"], 0.0, float(own[0]), float(rest[0])))  # degenerate data
    out = data.sparkSession.createDataFrame(flat, _SCORES)
    if not planes:
        return out
    width = np.min([np.sqrt(np.diag(p[k])) for p in planes.values() for k in ("inside", "outside")], axis=0) / FINE
    inside = _in_cells(marked, names, low, width, "i").groupBy("p0", "p1").agg(F.collect_list(F.struct("i", "c", "o0", "o1")).alias("e"))
    entries = [F.coalesce(F.col(f"e.{k}"), F.array().cast(f"array<{t}>")).alias(f"e_{k}") for k, t in (("i", "int"), ("c", "double"), ("o0", "double"), ("o1", "double"))]
    cells = tables.materialised(_in_cells(data, names, low, width).join(inside, ["p0", "p1"], "left").select("p0", "p1", "c", "o0", "o1", *entries))

    def flush(sums):
        for i, pair in sums.items():
            some = np.flatnonzero((pair[0] > 0) | (pair[1] > 0))
            yield pd.DataFrame({"i": np.int32(i), "g": some.astype(np.int64), "s": pair[0][some], "t": pair[1][some]})

    def partial(frames):
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            corner = low + pdf[["p0", "p1"]].to_numpy(float) * width
            c, o = pdf["c"].to_numpy(float), pdf[["o0", "o1"]].to_numpy(float)
            row = np.repeat(np.arange(len(pdf)), pdf["e_i"].str.len())
            member, own_c = np.concatenate(pdf["e_i"].tolist()), np.concatenate(pdf["e_c"].tolist())
            own_o = np.stack([np.concatenate(pdf[k].tolist()) for k in ("e_o0", "e_o1")], axis=1)
            order = np.argsort(member, kind="stable")
            for i, p in planes.items():
                mine = order[slice(*np.searchsorted(member[order], (i, i + 1)))]
                at, d, far = row[mine], c.copy(), o.copy()
                d[at] -= own_c[mine]
                far[at] -= own_o[mine]
                some = d > 0
                new = np.stack([kernels.plane_sums(corner[at] + own_o[mine] / own_c[mine, None], own_c[mine], p["axes"], p["inside"]),
                                kernels.plane_sums(corner[some] + far[some] / d[some, None], d[some], p["axes"], p["outside"])])
                sums[i] = sums[i] + new if i in sums else new
                if sum(x.size for x in sums.values()) > MOST_HELD:
                    yield from flush(sums)
                    sums = {}
        yield from flush(sums)

    sums = cells.mapInPandas(partial, "i int, g long, s double, t double").groupBy("i", "g").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    known = [(i, float(p["n"]), float(p["m"]), kernels.plane_factor(p["n"], p["inside"]), kernels.plane_factor(p["m"], p["outside"]), p["cell"], len(p["axes"][0]) * len(p["axes"][1])) for i, p in planes.items()]
    known = data.sparkSession.createDataFrame(known, "i int, n double, m double, fs double, ft double, cell double, points bigint")
    points = sums.join(F.broadcast(known), "i").select("i", (F.col("s") * F.col("fs")).alias("q"), (F.col("t") * F.col("ft")).alias("p"))
    term, infinite = _plane_term(measure)
    totals = points.groupBy("i").agg(F.sum(term).alias("total"), F.count_if(F.col("q") > 0).alias("covered")).join(F.broadcast(known), "i")
    quality = F.col("total") * F.col("cell") * (F.col("n") / (F.col("n") + F.col("m")) if kernels.weighted(measure) else F.lit(1.0)) / F.lit(kernels.MOST_HELLINGER if "adjusted" in measure else 1.0)
    if infinite:
        quality = F.when(F.col("covered") < F.col("points"), F.lit(math.inf)).otherwise(quality)
    return totals.select("i", quality.alias("quality"), F.col("n").alias("secondary"), F.col("m").alias("tertiary")).union(out)


def _l2_by_waves(data: DataFrame, smaller: Column, found: int, names: list[str], outside: frozenset[int]) -> DataFrame:
    """The sum of kernels over all pairs of a member and another row, of one or two columns, in one pass over the rows.

    All rows, and each refinement's smaller side (``outside``: the rows it does not cover), are spread over one grid; the
    larger side is the difference. The kernel's waves are taken from the grid, so that work grows with rows, not with
    rows times waves, and no row is written for a refinement.
    """
    spark, k = data.sparkSession, len(names)
    first = data.agg(*(f(x) for f in (F.avg, F.min, F.max) for x in names)).first()
    if first[0] is None:
        return spark.createDataFrame([], _SCORES)
    low, high = np.array(first[k : 2 * k], float), np.array(first[2 * k :], float)
    marked = data.select(F.explode(F.concat(F.array(F.lit(-1)), smaller)).alias("i"), *names)
    about = [F.col(x) - F.lit(c) for x, c in zip(names, first)]
    sums = marked.groupBy("i").agg(F.count(F.lit(1)).cast("double"), *(F.sum(x) for x in about), *(F.sum(x * x) for x in about)).collect()
    sums = {r["i"]: np.array(r[1:], float) for r in sums}
    known, flat = {}, []
    for i in range(found):
        own = sums.get(i, np.zeros(1 + 2 * k))
        rest = sums[-1] - own
        sd = [np.sqrt(np.maximum(x[1 + k :] - x[1 : 1 + k] ** 2 / x[0], 0.0) / max(x[0] - 1, 1)) for x in (own, rest) if x[0]]
        scale = kernels.l2_scale(own[0], sd[0], rest[0], sd[1]) if len(sd) == 2 else np.zeros(k)
        n, m = map(float, (rest[0], own[0]) if i in outside else (own[0], rest[0]))
        if (scale > 0).all():
            known[i] = (scale, n, m)
        else:
            flat.append((i, 0.0, n, m))
    out = spark.createDataFrame(flat, _SCORES)
    if not known:
        return out
    grid = kernels.wave_grid(low, high, np.array([scale for scale, _, _ in known.values()]))
    points = int(grid["size"].prod())

    def flush(held):
        for i, s in held.items():
            some = np.flatnonzero(s)
            yield pd.DataFrame({"i": np.int32(i), "g": some.astype(np.int64), "s": s[some]})

    def partial(frames):
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for i, own in pdf.groupby("i"):
                if i not in held and len(held) and (len(held) + 1) * points > MOST_HELD:
                    yield from flush(held)
                    held = {}
                kernels.spread_over(own[names].to_numpy(float), grid, held.setdefault(i, np.zeros(points)))
        yield from flush(held)

    spread = marked.where(F.col("i").isin(-1, *known)).mapInPandas(partial, "i int, g long, s double").groupBy("i", "g").agg(F.sum("s").alias("s"))
    spread = tables.materialised(spread)

    def on_grid(pdf: pd.DataFrame) -> np.ndarray:
        sums = np.zeros(points)
        sums[pdf["g"].to_numpy()] = pdf["s"].to_numpy(float)
        return sums

    whole = on_grid(spread.where("i = -1").select("g", "s").toPandas())  # one grid

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, own = int(pdf["i"].iloc[0]), on_grid(pdf)
        scale, n, m = known[i]
        return pd.DataFrame([(i, kernels.l2_of(kernels.wave_kernel_sum(own, whole - own, grid, scale), scale, n, m), n, m)], columns=["i", "quality", "secondary", "tertiary"])

    return spread.where("i >= 0").groupBy("i").applyInPandas(compare, _SCORES).union(out)


def _l2_by_pairs(data: DataFrame, marked: DataFrame, found: int, names: list[str]) -> DataFrame:
    """The same of three or more columns, from all pairs of a member and another row."""
    sides = _sides(data, marked, found, names)
    known, flat = {}, []
    for r in _moments(sides, names):
        n, m = float(r["n_c"]), float(r["n_d"])
        sd = [np.sqrt([max(r[f"s_{w}_{x}_{x}"] - r[f"s_{w}_{x}"] ** 2 / k, 0.0) / max(k - 1, 1) for x in names]) for w, k in (("c", n), ("d", m)) if k]
        scale = kernels.l2_scale(n, sd[0], m, sd[1]) if len(sd) == 2 else np.zeros(len(names))
        if (scale > 0).all():
            known[r["i"]] = (scale, n, m)
        else:
            flat.append((r["i"], 0.0, n, m))

    def paired(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        if len(pdf) > MOST_PAIRED:
            raise ValueError(f"l2 of three or more columns compares at most {MOST_PAIRED} distinct rows")
        a, b = pdf[pdf["c"] > 0], pdf[pdf["d"] > 0]
        scale, n, m = known[i]
        total = kernels.pair_kernel_sum(a[names].to_numpy(float), b[names].to_numpy(float), a["c"].to_numpy(float), b["d"].to_numpy(float), scale)
        return pd.DataFrame([(i, kernels.l2_of(total, scale, n, m), n, m)], columns=["i", "quality", "secondary", "tertiary"])

    out = sides.where(F.col("i").isin(*known)).groupBy("i").applyInPandas(paired, _SCORES)
    return out.union(data.sparkSession.createDataFrame(flat, _SCORES)) if flat else out


def _losses(data: DataFrame, marked: DataFrame, measure: str) -> DataFrame:
    """Ranking losses of each refinement's rows, and of all."""
    own = tables.scape_loss(marked, F.col("x0") == 1, F.col("x1"), ("i",))
    whole = tables.scape_loss(data, F.col("x0") == 1, F.col("x1")).first()["loss"] or 0.0
    e = F.expr(measures.SCAPE[measure].expression.replace("loss_all", repr(float(whole))))
    return own.withColumn("loss", F.coalesce("loss", F.lit(0.0))).select("i", e.cast("double").alias("quality"), F.col("positives").alias("secondary"), F.col("negatives").alias("tertiary"))


def _networks(data: DataFrame, marked: DataFrame, target: Target, settings: Settings, total: float) -> DataFrame:
    """Distance of each refinement's network from that of all rows, learned from counts by pattern of labels."""
    k, seed, measure = len(target.columns), settings.seed, settings.measure
    everything = kernels.learn_network({int(r[0]): int(r[1]) for r in _counted(data, "x0").collect()}, k, seed)  # 2^labels patterns at most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf["c"].sum())
        d = kernels.edit_distance(everything, kernels.learn_network({int(m): int(c) for m, c in zip(pdf["x0"], pdf["c"])}, k, seed), k)
        return pd.DataFrame([(int(pdf["i"].iloc[0]), d if measure == "edit_distance" else kernels.weed(d, n / total), d, kernels.weed(1.0, n / total, 1.0))], columns=["i", "quality", "secondary", "tertiary"])

    return _counted(marked, "i", "x0").groupBy("i").applyInPandas(run, _SCORES)


def _median_deviations(data: DataFrame, marked: DataFrame) -> DataFrame:
    """mmad of the ranks among all rows: their median and median absolute deviation, from running counts."""
    ranks = tables.mid_ranks(_counted(data, "x0"), "x0", "c").select("x0", "rank")
    rows = tables.materialised(_counted(marked, "i", "x0").join(tables.few(ranks), "x0"))
    own = rows.groupBy("i").agg(F.sum("c").alias("B"), F.sum(F.col("c") * F.col("rank")).alias("S1"))
    far = tables.counted_medians(rows, "rank", "c", ("i",)).withColumnRenamed("median", "med")
    return own.join(far, "i").select("i", F.coalesce(F.expr(measures.ORDINAL["mmad"].expression), F.lit(0.0)).cast("double").alias("quality"), (F.col("S1") / F.col("B")).alias("secondary"), F.col("med").alias("tertiary"))


def level(df: DataFrame, beam: list[Conditions], types: dict[str, str], stats: Statistics, settings: Settings, target: Target) -> DataFrame:
    from sieveline.operators.search import _condition

    spark = df.sparkSession
    if settings.nominal_sets and model.NOMINAL in types.values():
        raise ValueError("value sets need a measure over sums: leave nominal_sets off")
    plain = model.Settings(measure="coverage", numeric_strategy=settings.numeric_strategy, numeric_operators=settings.numeric_operators, bins=settings.bins)
    count = Statistics(stats.parts, stats.whole, "c0", "c0", "N - c0", {"coverage": measures.Measure("coverage", "c0", 0)})
    total = stats.whole["N"]
    rows = refine.level(df, beam, types, count, plain)
    rows = rows.where((F.col("coverage") >= settings.min_coverage) & (F.col("coverage") <= total * settings.max_coverage_share) & (F.col("coverage") < total))
    rows = rows.where(F.col("coverage") <= settings.max_coverage) if settings.max_coverage else rows
    found = rows.orderBy(F.desc("coverage"), "cand", "attr", "op", "v", "s", "lo", "hi").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} refinements at one level: raise min_coverage, lower the width or take numeric_strategy bins")
    schema = "i int, cand int, attr string, op string, v double, lo double, hi double, s string, set array<string>, coverage bigint, support bigint"
    table = spark.createDataFrame([(i, r["cand"], r["attr"], r["op"], r["v"], r["lo"], r["hi"], r["s"], r["set"], r["coverage"], None) for i, r in enumerate(found)], schema)
    if not found:
        return table.drop("i").withColumns({c: F.lit(None).cast("double") for c in ("quality", "secondary", "tertiary")})
    own = [(*beam[r["cand"]], _condition(r, types)) for r in found]
    values = _value_columns(target)
    names = [f"x{i}" for i in range(len(values))]
    data = df.select("*", *values).where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    marked = refine.membership(data.drop("cand") if "cand" in data.columns else data, own).withColumnRenamed("cand", "i").select("i", *names)
    measure = settings.measure
    outside = frozenset(i for i, r in enumerate(found) if 2 * r["coverage"] > total) if measure == "l2" and len(names) < 3 else frozenset()
    smaller = refine.covering(own, outside)
    rows_of, data = data, data.select(*names)
    if target.type == "multi_label":
        scored = _networks(data, marked, target, settings, total)
    elif target.type == "scape":
        scored = _losses(data, marked, measure)
    elif measure == "mmad":
        scored = _median_deviations(data, marked)
    elif measure == "l2":
        scored = _l2_by_waves(rows_of, smaller, len(found), names, outside) if len(names) < 3 else _l2_by_pairs(data, marked, len(found), names)
    elif measure in kernels.DENSITY_2D:
        scored = _of_two_columns(data, marked, len(found), measure, names)
    else:
        scored = _of_one_column(data, marked, len(found), measure)
    return tables.materialised(table.join(scored, "i").drop("i"))
