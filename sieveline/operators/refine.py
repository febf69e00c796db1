"""One search level: all refinements of all candidates by all attributes, in one aggregate and one set of windows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import kernels, measures
from sieveline.model import AT_LEAST, AT_MOST, BETWEEN, BINARY, ELEMENT_OF, EQUALS, NOMINAL, NUMERIC, Conditions
from sieveline.operators import cover_index, tables
from sieveline.operators.stats import Statistics

#: Predicates in one projection; more would overrun generated methods.
CHUNK = 50
#: Distinct values above which an attribute is scanned in buckets, and their number.
WIDE, BUCKETS = 200_000, 256


def covering(beam: list[Conditions], outside: frozenset[int] = frozenset()) -> Column:
    """The numbers of the candidates that cover a row; of those ``outside`` that do not."""
    holds = lambda i, c: ~model.conjunction(c) if i in outside else model.conjunction(c)
    pieces = [F.filter(F.array(*(F.when(holds(i, c), F.lit(i)) for i, c in list(enumerate(beam))[a : a + CHUNK])), lambda x: x.isNotNull()) for a in range(0, len(beam), CHUNK)]
    return F.concat(*pieces)


def membership(df: DataFrame, beam: list[Conditions]) -> DataFrame:
    """Each row once for every candidate that covers it (cand)."""
    if list(beam) == [()]:
        return df.withColumn("cand", F.lit(0))
    return df.withColumn("cand", F.explode(covering(beam)))


def values(df: DataFrame, beam: list[Conditions], types: dict[str, str], stats: Statistics) -> DataFrame:
    """(cand, attr, v, s, statistics...): v holds numbers, s nominal and binary values.

    Rows are first summed by attribute, value and set of covering candidates; only these sums are multiplied by candidates.
    """
    parts = list(stats.parts)
    single = list(beam) == [()]
    df = df.select(F.lit(0).alias("cand") if single else covering(beam).alias("cands"), *(F.col(f"`{a}`") for a in types), *(v.alias("__" + k) for k, v in stats.parts.items()))
    key = "cand" if single else "cands"
    df = df if single else df.where(F.size("cands") > 0)
    cells = []
    for a, kind in types.items():
        c = F.col(f"`{a}`")
        number = c.cast("double") if kind == NUMERIC else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if kind == NUMERIC else F.coalesce(c, F.lit(False)).cast("int").cast("string") if kind == BINARY else c
        cells.append(F.struct(F.lit(a).alias("attr"), number.alias("v"), text.alias("s")))
    long = df.select(key, F.explode(F.array(*cells)).alias("x"), *(F.col("__" + p) for p in parts))
    long = long.select(key, "x.attr", F.when(~F.isnan("x.v"), F.col("x.v")).alias("v"), "x.s", *(F.col("__" + p) for p in parts)).where("v is not null or s is not null")
    summed = long.groupBy(key, "attr", "v", "s").agg(*(F.sum("__" + p).alias(p) for p in parts))
    if single:
        return summed
    return summed.withColumn("cand", F.explode("cands")).groupBy("cand", "attr", "v", "s").agg(*(F.sum(p).alias(p) for p in parts))


def wide_bounds(df: DataFrame, types: dict[str, str]) -> dict[str, list[float]]:
    """For attributes with more than WIDE distinct values, cut points that split them into about BUCKETS equal parts."""
    numeric = [a for a, t in types.items() if t == NUMERIC]
    if not numeric:
        return {}
    row = df.agg(*(F.approx_count_distinct(F.col(f"`{a}`")).alias(f"n{i}") for i, a in enumerate(numeric))).first()
    wide = [a for i, a in enumerate(numeric) if row[i] > WIDE]
    if not wide:
        return {}
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = df.agg(*(F.percentile_approx(F.col(f"`{a}`").cast("double"), shares).alias(f"c{i}") for i, a in enumerate(wide))).first()
    return {a: sorted(set(c)) for a, c in zip(wide, cuts)}


def _running(g: DataFrame, parts: list[str], up: bool, keys: tuple[str, ...] = ("cand", "attr")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("v").asc() if up else F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, "v", *(F.sum(p).over(w).alias(p) for p in parts))


def _cumulative(g: DataFrame, stats: Statistics, up: bool, wide: dict[str, list[float]] | None = None) -> DataFrame:
    """Running sums by value. Attributes with many distinct values are summed in buckets first, so that no task gets them all."""
    parts = list(stats.parts)
    op = F.lit(AT_MOST if up else AT_LEAST).alias("op")
    if not wide:
        return _running(g, parts, up).select("cand", "attr", op, "v", *parts)
    bounds = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for a, c in wide.items() for x in (a, c)))
    many = g.where(F.col("attr").isin(*wide)).withColumn("bucket", F.size(F.filter(bounds[F.col("attr")], lambda x: x <= F.col("v"))))
    order = Window.partitionBy("cand", "attr").orderBy(F.col("bucket").asc() if up else F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = many.groupBy("cand", "attr", "bucket").agg(*(F.sum(p).alias(p) for p in parts))
    before = sums.select("cand", "attr", "bucket", *(F.coalesce(F.sum(p).over(order), F.lit(0.0)).alias("before_" + p) for p in parts))
    inside = _running(many, parts, up, ("cand", "attr", "bucket")).join(before, ["cand", "attr", "bucket"])
    inside = inside.select("cand", "attr", op, "v", *((F.col(p) + F.col("before_" + p)).alias(p) for p in parts))
    return inside.union(_running(g.where(~F.col("attr").isin(*wide)), parts, up).select("cand", "attr", op, "v", *parts))


def bin_boundaries(g: DataFrame, stats: Statistics, bins: int, up: bool, wide: dict[str, list[float]] | None = None) -> DataFrame:
    """(cand, attr, v): equal-height cut values. With <=: least v whose running count passes the boundary; with >=: mirrored."""
    count = stats.count
    family = g.groupBy("cand", "attr").agg(F.sum(count).cast("long").alias("total"), F.min("v").alias("least"))
    c = _cumulative(g, stats, True, wide).select("cand", "attr", "v", F.col(count).cast("long").alias("cover")).join(family, ["cand", "attr"])
    c = c.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))) if bins > 1 else c.withColumn("b", F.lit(1)).where("false")
    if up:
        cut = c.where(f"cover > total * b div {bins} - (case when (total * b) % {bins} = 0 then 1 else 0 end)").groupBy("cand", "attr", "b").agg(F.min_by(F.struct("v", "cover", "total"), "v").alias("x"))
        return cut.where("x.cover < x.total").select("cand", "attr", "x.v").distinct()
    return c.where(f"v > least and total - cover < total - total * b div {bins}").groupBy("cand", "attr", "b").agg(F.min("v").alias("v")).select("cand", "attr", "v").distinct()


def half_intervals(g: DataFrame, stats: Statistics, operators: tuple[str, ...], bins: int = 0, wide: dict[str, list[float]] | None = None) -> DataFrame:
    """<=, >= and = conditions on numbers with their statistics; bins > 0 keeps equal-height cut values only."""
    g = g.where("v is not null")
    out = []
    for op in operators:
        if op == EQUALS:
            out.append(g.select("cand", "attr", F.lit(EQUALS).alias("op"), "v", *stats.parts))
            continue
        scan = _cumulative(g, stats, op == AT_MOST, wide)
        if bins:
            scan = scan.join(bin_boundaries(g, stats, bins, op == AT_MOST, wide), ["cand", "attr", "v"], "left_semi")
        out.append(scan)
    return reduce(DataFrame.unionByName, out)


def _blocks(g: DataFrame, stats: Statistics) -> DataFrame:
    """Sums by value, with neighbouring values of one class ratio merged (single nominal)."""
    g = g.where("v is not null")
    if "HB" not in stats.parts:
        return g.select("cand", "attr", "v", *stats.parts)
    w = Window.partitionBy("cand", "attr").orderBy("v")
    ratio = g.withColumn("r", F.col("HB") / F.col("B"))
    g = ratio.withColumn("new", (~F.lag("r").over(w).eqNullSafe(F.col("r"))).cast("int")).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("cand", "attr", "block").agg(F.max("v").alias("v"), *(F.sum(p).alias(p) for p in stats.parts)).drop("block")


def intervals(g: DataFrame, stats: Statistics) -> DataFrame:
    """All (lo, hi] over neighbouring values merged where the class ratio is the same, as prefix differences; a square of the number of values, which is bounded."""
    total = Window.partitionBy("cand", "attr")
    run = total.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    p = _blocks(g, stats).select("cand", "attr", "v", F.max("v").over(total).alias("top"), F.count(F.lit(1)).over(total).alias("cuts"), *(F.sum(x).over(run).alias(x) for x in stats.parts))
    few = F.when(F.col("cuts") > MOST_PAIRED, F.raise_error(F.lit(f"more than {MOST_PAIRED} cut values of an attribute: take numeric_strategy bins, or best intervals of a convex measure"))).otherwise(True)
    p = p.where(few.cast("boolean"))
    low = p.where("v < top").select("cand", "attr", F.col("v").alias("lo"), *(F.col(x).alias("lo_" + x) for x in stats.parts))
    start = p.groupBy("cand", "attr").agg(F.lit(float("-inf")).alias("lo"), *(F.lit(0.0).alias("lo_" + x) for x in stats.parts))
    joined = p.join(low.unionByName(start), ["cand", "attr"]).where("lo < v")
    hi = F.when(F.col("v") == F.col("top"), F.lit(float("inf"))).otherwise(F.col("v"))
    return joined.select("cand", "attr", F.lit(BETWEEN).alias("op"), "lo", hi.alias("hi"), *((F.col(x) - F.col("lo_" + x)).alias(x) for x in stats.parts))


def _hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points on the convex hull, and its edges: a lower and an upper chain."""
    order = np.lexsort((points[:, 1], points[:, 0])).tolist()
    kept, edges = [], []
    for side in (1.0, -1.0):
        chain: list[int] = []
        for i in order:
            x, y = points[i]
            while len(chain) > 1:
                (x1, y1), (x2, y2) = points[chain[-2]], points[chain[-1]]
                if side * ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) >= 0:
                    break
                chain.pop()
            chain.append(i)
        kept += chain
        edges += [points[b] - points[a] for a, b in zip(chain, chain[1:])]
    return np.unique(kept), np.array(edges, float).reshape(-1, 2)


#: Running sums of which all pairs are looked at, without halving.
PAIRED_AT_ONCE = 32


def extreme_intervals(points: np.ndarray) -> list[tuple[int, int]]:
    """Pairs i < j of places among running sums that hold every corner of the convex hull of all differences points[j] - points[i].

    All pairs within short blocks, and differences across the middle of two, four and more blocks, which are those of
    two sets. A corner of these is extreme in a range of directions between normals of both sets' edges, and in one such
    direction each set has its own extreme point. A set's hull comes from the hulls of its halves. Pairs whose difference
    lies inside the hull of others are left out, and of equal differences the first pair stays.
    """
    n = len(points)
    if n < 2:
        return []
    size = PAIRED_AT_ONCE
    i, j = np.triu_indices(size, 1)
    starts = np.arange(0, n, size)[:, None]
    i, j = (starts + i).ravel(), (starts + j).ravel()
    i, j = i[j < n], j[j < n]
    outer = _not_inside(points[j] - points[i])
    found = [np.stack((i[outer], j[outer]))]
    hulls = []
    for a in range(0, n, size):
        kept, edges = _hull(points[a : a + size])
        hulls.append((kept + a, edges))
    while len(hulls) > 1:
        merged = []
        for (left, e), (right, f) in zip(hulls[::2], hulls[1::2]):
            edges = np.concatenate((e, f, [[1.0, 0.0], [0.0, 1.0]]))
            turn = np.arctan2(edges[:, 0], -edges[:, 1])
            turn = np.unique(np.concatenate((turn, turn + np.pi)) % (2 * np.pi))
            turn = np.concatenate((turn, (turn + np.append(turn[1:], turn[0] + 2 * np.pi)) / 2))
            d = np.stack((np.cos(turn), np.sin(turn)))
            found.append(np.stack((left[np.argmin(points[left] @ d, axis=0)], right[np.argmax(points[right] @ d, axis=0)])))
            both = np.concatenate((left, right))
            kept, edges = _hull(points[both])
            merged.append((both[kept], edges))
        hulls = merged + (hulls[-1:] if len(hulls) % 2 else [])
    i, j = np.concatenate(found, axis=1)
    outer = _not_inside(points[j] - points[i])
    i, j = np.divmod(np.unique(i[outer] * n + j[outer]), n)
    d = points[j] - points[i]
    first = np.sort(np.unique(d[:, 0] + 1j * d[:, 1], return_index=True)[1])
    return list(zip(i[first].tolist(), j[first].tolist()))


def _not_inside(points: np.ndarray) -> np.ndarray:
    """Which points are not strictly inside the polygon of those that are extreme in 64 directions."""
    # without the trend, which alone would make the points a line
    off = points[:, 1] - points[:, 0] * ((points[:, 0] @ points[:, 1]) / max(points[:, 0] @ points[:, 0], 1e-300))
    scale = np.abs(points).max(axis=0)
    if np.abs(off).max() <= 1e-6 * scale[1] or not scale[0]:
        return np.ones(len(points), bool)
    x = np.stack((points[:, 0] / scale[0], off / np.abs(off).max()), axis=1)
    turn = np.arange(64) * (2 * np.pi / 64)
    corner = x[np.unique([np.argmax(x @ d) for d in np.stack((np.cos(turn), np.sin(turn)), axis=1)])]
    if len(corner) < 3:
        return np.ones(len(x), bool)
    middle = corner.mean(axis=0)
    corner = corner[np.argsort(np.arctan2(*(corner - middle).T[::-1]))]
    inside = np.ones(len(x), bool)
    for a, b in zip(corner, np.roll(corner, -1, axis=0)):
        inside[inside] = (b[0] - a[0]) * (x[inside, 1] - a[1]) - (b[1] - a[1]) * (x[inside, 0] - a[0]) > 1e-9
    return ~inside


#: Measures that are convex in covered rows and positives: their best interval is a corner.
CONVEX = {"wracc", "normalised_wracc", "abs_wracc", "chi_squared", "information_gain", "mutual_information"}
#: Cut values of one attribute for all pairs; more are an error.
MOST_PAIRED = 20_000
#: For best intervals: cut values up to which an attribute is one group, most ranges of values of others, and hulls merged at once.
GROUP_CUTS, MOST_RANGES, FAN = 5_000, 4096, 64


def _corner_rows(cand, attr, cuts: np.ndarray, sums: dict[str, np.ndarray]) -> dict:
    """Intervals between pairs of running sums that hold the best one."""
    i, j = np.array(extreme_intervals(np.stack((sums["B"], sums["HB"]), axis=1)), np.int64).reshape(-1, 2).T
    return {"cand": cand, "attr": attr, "lo": cuts[i], "hi": cuts[j]} | {c: r[j] - r[i] for c, r in sums.items()}


def best_intervals(g: DataFrame, stats: Statistics) -> DataFrame:
    """Intervals (lo, hi] that hold the best one by any convex measure of B and HB, in about linear time.

    An attribute with many cut values is dealt in ranges of them. Of a range's
    running sums only those on their convex hull can end or begin a best interval
    that reaches beyond it; hulls of FAN neighbouring ranges are merged in one
    group, and their hull goes on to the next round. So no group holds more than
    a range's values or FAN hulls.
    """
    parts = list(stats.parts)
    g = tables.materialised(g.where("v is not null"))
    most = max((r["n"] for r in g.groupBy("cand", "attr").agg(F.count(F.lit(1)).alias("n")).groupBy("attr").agg(F.max("n").alias("n")).collect()), default=0)
    if most > GROUP_CUTS:
        return _best_of_ranges(g, stats, min(MOST_RANGES, -(-most // GROUP_CUTS)))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v = np.concatenate(([-np.inf], pdf["v"].to_numpy(float)[:-1], [np.inf]))
        run = {c: np.concatenate(([0.0], np.cumsum(pdf[c].to_numpy(float)))) for c in parts}
        return pd.DataFrame(_corner_rows(pdf["cand"].iloc[0], pdf["attr"].iloc[0], v, run))

    found = _blocks(g, stats).groupBy("cand", "attr").applyInPandas(corners, "cand int, attr string, lo double, hi double, " + ", ".join(f"{c} double" for c in parts))
    return found.select("cand", "attr", F.lit(BETWEEN).alias("op"), "lo", "hi", *parts)


def _best_of_ranges(g: DataFrame, stats: Statistics, ranges: int) -> DataFrame:
    parts = list(stats.parts)
    cuts = {r["attr"]: np.array(sorted(set(r["c"])), float) for r in g.groupBy("attr").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)] or [0.5], 2 * MOST_RANGES).alias("c")).collect()}

    def range_of(attr: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for a in attr.unique():
            own = (attr == a).to_numpy()
            out[own] = np.searchsorted(cuts[a], v.to_numpy()[own], "left")
        return pd.Series(out)

    g = g.withColumn("node", F.pandas_udf(range_of, "int")("attr", "v"))
    ratio = F.col("HB") / F.col("B")
    sums = g.groupBy("cand", "attr", "node").agg(*(F.sum(p).alias("all_" + p) for p in parts), F.min_by(ratio, "v").alias("first"), F.max_by(ratio, "v").alias("last"))
    order = Window.partitionBy("cand", "attr").orderBy("node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("cand", "attr", "node", *(F.coalesce(F.sum("all_" + p).over(before), F.lit(0.0)).alias("from_" + p) for p in parts), F.lag("node").over(order).isNull().alias("begins"),
                       F.lead("node").over(order).isNull().alias("ends"), F.coalesce(F.lead("first").over(order) == F.col("last"), F.lit(False)).alias("goes_on"))
    shape = "cand int, attr string, node int, kind string, lo double, hi double, " + ", ".join(f"{c} double" for c in parts)

    def out(cand, attr, node, v, run) -> pd.DataFrame:
        """Intervals found in a group, and its hull (one row a corner, its cut value as hi)."""
        found = pd.DataFrame(_corner_rows(cand, attr, v, run) | {"node": node, "kind": "interval"}) if len(v) > 1 else pd.DataFrame()
        on = _hull(np.stack((run["B"], run["HB"]), axis=1))[0]
        hull = pd.DataFrame({"cand": cand, "attr": attr, "node": node, "kind": "hull", "lo": np.nan, "hi": v[on]} | {c: r[on] for c, r in run.items()})
        return pd.concat([found, hull]).reindex(columns=["cand", "attr", "node", "kind", "lo", "hi", *parts])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        first = pdf.iloc[0]
        share = pdf["HB"].to_numpy(float) / pdf["B"].to_numpy(float)
        # neighbouring values of one class ratio are one block; only a block's end is a cut
        kept = np.append(share[1:] != share[:-1], not first["goes_on"])
        v = pdf["v"].to_numpy(float).copy()
        if first["ends"]:
            v[-1] = np.inf
        run = {c: (first["from_" + c] + np.cumsum(pdf[c].to_numpy(float)))[kept] for c in parts}
        v = v[kept]
        if first["begins"]:
            v, run = np.concatenate(([-np.inf], v)), {c: np.concatenate(([0.0], r)) for c, r in run.items()}
        if not len(v):
            return pd.DataFrame(columns=["cand", "attr", "node", "kind", "lo", "hi", *parts])
        return out(first["cand"], first["attr"], first["node"], v, run)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hi")
        return out(pdf["cand"].iloc[0], pdf["attr"].iloc[0], pdf["node"].iloc[0], pdf["hi"].to_numpy(float), {c: pdf[c].to_numpy(float) for c in parts})

    made = tables.materialised(g.join(sums, ["cand", "attr", "node"]).groupBy("cand", "attr", "node").applyInPandas(local, shape))
    found, left = [made.where("kind = 'interval'")], ranges
    while left > 1:
        left = -(-left // FAN)
        made = tables.materialised(made.where("kind = 'hull'").withColumn("node", F.expr(f"node div {FAN}").cast("int")).groupBy("cand", "attr", "node").applyInPandas(merged, shape))
        found.append(made.where("kind = 'interval'"))
    return reduce(DataFrame.union, found).select("cand", "attr", F.lit(BETWEEN).alias("op"), "lo", "hi", *parts)


def nominal_values(g: DataFrame, stats: Statistics) -> DataFrame:
    return g.where("s is not null").select("cand", "attr", F.lit(EQUALS).alias("op"), "s", *stats.parts)


def value_sets(g: DataFrame, stats: Statistics) -> tuple[DataFrame, DataFrame]:
    """Prefixes, from both ends, of the values in the order of positive rate (mean target for numbers).

    Returns them with their length as v and their end as lo (0 from the highest
    rate), and the values by end and place, from which ``with_sets`` makes the set.
    """
    g = g.where("s is not null")
    if not {"HB", "S1"} & set(stats.parts):
        raise ValueError("value sets need a nominal, numeric or ordinal target: values are ordered by positive rate or mean")
    rate = F.col("HB" if "HB" in stats.parts else "S1") / F.col(stats.count)
    g = g.withColumn("rate", rate)
    sums, ordered = [], []
    for end, order in enumerate((F.col("rate").desc(), F.col("rate").asc())):
        w = Window.partitionBy("cand", "attr").orderBy(order, "s").rowsBetween(Window.unboundedPreceding, 0)
        place = F.count(F.lit(1)).over(w).cast("double")
        sums.append(g.select("cand", "attr", F.lit(ELEMENT_OF).alias("op"), place.alias("v"), F.lit(float(end)).alias("lo"), *(F.sum(p).over(w).alias(p) for p in stats.parts)))
        ordered.append(g.select("cand", "attr", F.lit(float(end)).alias("end"), place.alias("place"), F.col("s").alias("value")))
    return sums[0].union(sums[1]), ordered[0].union(ordered[1])


def with_sets(rows: DataFrame, ordered: DataFrame | None) -> DataFrame:
    """Value sets (the best ones) get their values in place of length and end."""
    if ordered is None:
        return rows
    names = rows.columns
    sets = rows.where(F.col("op") == ELEMENT_OF).drop("set", "s")
    on = [sets[c] == ordered[c] for c in ("cand", "attr")] + [sets["lo"] == ordered["end"], ordered["place"] <= sets["v"]]
    own = [c for c in names if c not in ("set", "s")]
    made = sets.join(ordered, on).groupBy(*(sets[c] for c in own)).agg(F.array_sort(F.collect_list("value")).alias("set"))
    made = made.withColumns({"v": F.lit(None).cast("double"), "lo": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}).select(*names)
    return rows.where(F.col("op") != ELEMENT_OF).unionByName(made)


def quality_of(measure: measures.Measure) -> Column:
    """The measure over columns of statistics; a function of kernels runs on vectors of them."""
    plain = F.expr(f"cast({measure.expression or 'null'} as double)")
    if not measure.call:
        return plain
    call = getattr(kernels, measure.call)
    run = F.pandas_udf(lambda *columns: pd.Series(call(*(c.to_numpy(float) for c in columns))), "double")
    return run(*map(F.col, measure.columns)) if measure.columns else run(plain)


def quality_at(stats: Statistics, measure: str) -> Callable[[str, str], Column]:
    """A measure of covered rows and positives as a column of the SQL of these two."""
    expression, numbers = stats.measures[measure].expression, {k: f"{float(v)!r}D" for k, v in stats.whole.items()}

    def quality(b: str, h: str) -> Column:
        names = numbers | {"B": f"({b})", "HB": f"({h})"}
        return F.expr(f"cast({re.sub(r'[A-Za-z_][A-Za-z_0-9]*', lambda m: names.get(m[0], m[0]), expression)} as double)")

    return quality


def reach(stats: Statistics, measure: str) -> Column:
    """The most that any part of a subgroup (coverage, support) can score: for convex measures at a corner of what it may cover of positives and others; unbounded else."""
    if measure not in CONVEX or "HB" not in stats.parts:
        return F.lit(float("inf"))
    quality = quality_at(stats, measure)
    corner = lambda b, h: F.when(F.expr(f"{b} > 0"), quality(f"cast({b} as double)", f"cast({h} as double)")).otherwise(0.0)
    return F.greatest(corner("support", "support"), corner("coverage - support", "0"), corner("coverage", "support"), F.lit(0.0))


def scored(rows: DataFrame, stats: Statistics, measure: str) -> DataFrame:
    """Adds coverage, quality, secondary and tertiary."""
    if stats.whole_of is not None:
        rows = rows.join(F.broadcast(stats.whole_of), "cand")
    else:
        rows = rows.withColumns({k: F.lit(float(v)) for k, v in stats.whole.items()})
    e = lambda text: F.expr(f"cast({text} as double)")
    quality = quality_of(stats.measures[measure])
    return rows.where(f"{stats.count} > 0").select(
        "cand", "attr", "op", "v", "lo", "hi", "s", "set", F.col(stats.count).cast("long").alias("coverage"),
        quality.alias("quality"), e(stats.secondary).alias("secondary"), e(stats.tertiary).alias("tertiary"),
        *([F.col("HB").cast("long").alias("support")] if "HB" in stats.parts else [F.lit(None).cast("long").alias("support")]))


_SHAPE = {"v": "double", "lo": "double", "hi": "double", "s": "string", "set": "array<string>"}


def _shaped(df: DataFrame, stats: Statistics) -> DataFrame:
    return df.select("cand", "attr", "op", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _SHAPE.items()), *stats.parts)


def level(df: DataFrame, beam: list[Conditions], types: dict[str, str], stats: Statistics, settings: model.Settings, wide: dict[str, list[float]] | None = None, best: bool = False, codes: dict[str, cover_index.Codes] | None = None, last: float | None = None) -> DataFrame:
    """Scored refinements of every candidate in the beam; with ``best``, of intervals only those among which the best one is.

    With codes, rows meet the candidates by the index of conditions. Then, where
    only the best cut counts and the measure is convex, attributes with very many
    values are searched from coarse to fine; ``last`` is the quality to be passed
    where no beam follows.
    """
    if codes is None:
        return _level(values(df, beam, types, stats), types, stats, settings, wide, best)
    operators = model.SETTINGS[settings.numeric_operators]
    bounded = best and settings.numeric_strategy == "best" and settings.measure in CONVEX and "HB" in stats.parts and set(operators) <= {AT_MOST, AT_LEAST}
    ranged = {a: c for a, c in codes.items() if bounded and c.ranged and a in types}
    rest = {a: t for a, t in types.items() if a not in ranged}
    pieces = [_level(cover_index.values(df, beam, rest, codes, stats), rest, stats, settings, wide, best)] if rest else []
    if ranged:
        quality = quality_at(stats, settings.measure)
        n = stats.whole["N"]
        gate = lambda b, h: F.expr(f"{b} > greatest(1, {settings.min_coverage}) and {b} <= {n!r} * {settings.max_coverage_share!r} and {b} <= {settings.max_coverage or n!r} and {h} >= {settings.min_support}")
        cuts = cover_index.bounded_cuts(df, beam, types, ranged, stats, operators, quality, gate, float("-inf") if last is None else last)
        pieces.append(scored(_shaped(cuts, stats), stats, settings.measure))
    return reduce(DataFrame.union, pieces)


def level_with_sets(df: DataFrame, beam: list[Conditions], types: dict[str, str], stats: Statistics, settings: model.Settings, wide: dict[str, list[float]] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The same with value sets of nominal attributes, and what ``with_sets`` needs."""
    g = tables.materialised(values(df, beam, types, stats))
    nominal = [a for a, t in types.items() if t == NOMINAL]
    if not nominal:
        return _level(g, types, stats, settings, wide, True), None
    sets, ordered = value_sets(g.where(F.col("attr").isin(nominal)), stats)
    rows = scored(_shaped(sets, stats), stats, settings.measure)
    rest = {a: t for a, t in types.items() if t != NOMINAL}
    return (rows.union(_level(g.where(F.col("attr").isin(*rest)), rest, stats, settings, wide, True)) if rest else rows), ordered


def _level(g: DataFrame, types: dict[str, str], stats: Statistics, settings: model.Settings, wide: dict[str, list[float]] | None, best: bool) -> DataFrame:
    pieces = []
    if NUMERIC in types.values():
        operators = model.SETTINGS[settings.numeric_operators]
        if settings.numeric_strategy.startswith("consecutive"):
            pieces.append(consecutive(g, stats, settings.bins))
        elif settings.numeric_strategy == "intervals" or operators == (BETWEEN,):
            if best and settings.measure in CONVEX and "HB" in stats.parts and settings.numeric_strategy == "intervals":
                # the best interval is chosen before any gate
                numbers = {a: t for a, t in types.items() if t == NUMERIC}
                rest = {a: t for a, t in types.items() if t != NUMERIC}
                rows = best_per_operator(scored(_shaped(best_intervals(g.where("v is not null"), stats), stats), stats, settings.measure))
                return rows.union(_level(g.where(~F.col("attr").isin(*numbers)), rest, stats, settings, wide, best)) if rest else rows
            pieces.append(intervals(g, stats))
        else:
            pieces.append(half_intervals(g, stats, operators, settings.bins if "bins" in settings.numeric_strategy else 0, wide))
    if {NOMINAL, BINARY} & set(types.values()):
        pieces.append(nominal_values(g, stats))
    return scored(reduce(DataFrame.union, [_shaped(p, stats) for p in pieces]), stats, settings.measure)


def consecutive(g: DataFrame, stats: Statistics, bins: int) -> DataFrame:
    """Consecutive equal-height intervals (lo, hi]; the outer ones are unbounded."""
    g = g.where("v is not null")
    cuts = bin_boundaries(g, stats, bins, True)
    w = Window.partitionBy("cand", "attr").orderBy("v")
    edges = cuts.select("cand", "attr", F.col("v").alias("lo"), F.coalesce(F.lead("v").over(w), F.lit(float("inf"))).alias("hi"))
    first = cuts.groupBy("cand", "attr").agg(F.min("v").alias("hi")).select("cand", "attr", F.lit(float("-inf")).alias("lo"), "hi")
    return g.join(edges.union(first), ["cand", "attr"]).where("v > lo and v <= hi").groupBy("cand", "attr", F.lit(BETWEEN).alias("op"), "lo", "hi").agg(*(F.sum(p).alias(p) for p in stats.parts))


def best_per_operator(rows: DataFrame, numeric: bool = True) -> DataFrame:
    """The first maximum in ascending value order of each candidate, attribute and operator, as one aggregate; nominal values all stay, of value sets the best."""
    every = F.col("s").isNotNull() if numeric else F.col("op") != ELEMENT_OF
    order = F.struct(-F.col("quality"), "v", "lo", "hi", "set")
    best = rows.where(~every).groupBy("cand", "attr", "op").agg(F.min_by(F.struct(*rows.columns), order).alias("best")).select("best.*")
    return rows.where(every).unionByName(best)
