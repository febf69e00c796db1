"""Table operators: casts, missing values, census, domains, sorting, binning, cross tables, descriptives."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import model


def materialised(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, so that seeded or generated columns never change."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark) -> str:
    """The checkpoint folder. Where none is named, a local session (tests) takes a temporary one; a cluster has no folder that all can read."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sieveline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The table, written once to the shared folder, and a function that deletes it."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def remove() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(folder), remove


#: Rows of a few values that may be broadcast; they are counted first.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """Broadcast a table that is counted to be small; deal others anew, so that adaptive execution can split the rows they meet."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Values of which one task takes all, and about how many a range holds beyond that.
SMALL, IN_RANGE = 20_000, 100_000
#: Ranges that cut points are looked for; more rows make longer ranges.
MOST_RANGES = 10_000


def range_cuts(df: DataFrame, x: Column, rows: int, buckets: int | None = None) -> list[float]:
    """Cut points of about equal ranges; their number grows with the rows unless it is given."""
    buckets = buckets or min(max(256, rows // IN_RANGE), MOST_RANGES)
    return sorted(set(df.agg(F.percentile_approx(x, [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0] or []))


def range_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cut points are not above a number: by blocks of them, then within one."""
    if not cuts:
        return F.lit(0)
    bounds, side = F.lit(np.array(cuts, float)), math.isqrt(len(cuts)) + 1
    block = F.size(F.filter(F.lit(np.array(cuts[::side], float)), lambda c: c <= x))
    return F.when(block == 0, 0).otherwise((block - 1) * side + F.size(F.filter(F.slice(bounds, (block - 1) * side + 1, F.lit(side)), lambda c: c <= x)))


def running(df: DataFrame, order: str, parts: list[str], keys: tuple[str, ...] = (), ascending: bool = True) -> DataFrame:
    """Adds run_<part>, the sum over all rows of a group up to each one's value of ``order`` (numbers, distinct in a group).

    Beyond SMALL rows in ranges of the value: sums by range give offsets, so that no task gets a whole group.
    """
    x = F.col(order)
    turn = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    rows = df.count()
    if rows <= SMALL:
        own = Window.partitionBy(*keys).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"run_{p}": F.sum(p).over(own) for p in parts})
    parted = df.withColumn("__b", range_of(x, range_cuts(df, x, rows)))
    sums = parted.groupBy(*keys, "__b").agg(*(F.sum(p).alias(p) for p in parts))
    earlier = Window.partitionBy(*keys).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__b", *(F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias("__" + p) for p in parts))
    inside = Window.partitionBy(*keys, "__b").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.withColumns({f"run_{p}": F.sum(p).over(inside) for p in parts}).join(few(offsets), [*keys, "__b"])
    return out.withColumns({f"run_{p}": F.col(f"run_{p}") + F.col("__" + p) for p in parts}).drop("__b", *("__" + p for p in parts))


def counted(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, v, n): the known numbers of a column, counted."""
    x = F.col(f"`{column}`").cast("double")
    return materialised(df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n")))


def quantiles(counts: DataFrame, value: str, count: str, shares: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated quantiles of counted values by group, exact: a running count finds the values at the two places next to each share.

    Only sums and minima are kept for a group, whatever the number of its values.
    """
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("__total"))
    run = running(counts, value, [count], keys)
    run = run.join(few(totals), list(keys)) if keys else run.withColumn("__total", F.lit(totals.first()[0]))
    place = {k: (F.col("__total") - 1) * p for k, p in shares.items()}
    at = lambda where: F.min(F.when(F.col(f"run_{count}") > where, F.col(value)))
    found = run.groupBy(*keys).agg(F.first("__total").alias("__total"), *(f.alias(f"{side}_{k}") for k, p in place.items() for side, f in (("lo", at(F.floor(p))), ("hi", at(F.ceil(p))))))
    return found.select(*keys, *((F.col(f"lo_{k}") + (p - F.floor(p)) * (F.col(f"hi_{k}") - F.col(f"lo_{k}"))).alias(k) for k, p in place.items()))


def base_intervals(df: DataFrame, column: str, hit: Column) -> DataFrame:
    """(upper, n, positives) of the longest runs of neighbouring values with one share of positives: no cut inside them can be best.

    Values meet the one before by their places, and runs are numbered by a running count, so that no task gets all values.
    """
    x = F.col(f"`{column}`").cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("b"), F.count_if(hit).cast("double").alias("hb"))
    placed = materialised(running(counts.withColumn("one", F.lit(1)), "v", ["one"]).withColumnRenamed("run_one", "place"))
    before = placed.select((F.col("place") + 1).alias("place"), (F.col("hb") / F.col("b")).alias("share"))
    marked = placed.join(before, "place", "left").withColumn("new", (~F.col("share").eqNullSafe(F.col("hb") / F.col("b"))).cast("int"))
    return running(materialised(marked), "v", ["new"]).groupBy("run_new").agg(F.max("v").alias("upper"), F.sum("b").alias("n"), F.sum("hb").alias("positives")).drop("run_new")


def medians(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, median, mad): median of a column by group, and median distance from it."""
    return counted_medians(counted(df, column, keys), "v", "n", keys)


def counted_medians(counts: DataFrame, value: str, count: str, keys: tuple[str, ...]) -> DataFrame:
    middle = materialised(quantiles(counts, value, count, {"median": 0.5}, keys))
    far = counts.join(few(middle), list(keys)).groupBy(*keys, F.abs(F.col(value) - F.col("median")).alias("__far")).agg(F.sum(count).alias("__n"))
    return middle.join(quantiles(materialised(far), "__far", "__n", {"mad": 0.5}, keys), list(keys))


def mid_ranks(counts: DataFrame, value: str, count: str) -> DataFrame:
    """Adds rank, the mean place from 1 of the rows with each value, to counts by value."""
    return running(counts, value, [count]).withColumn("rank", F.col(f"run_{count}") - (F.col(count) - 1) / 2).drop(f"run_{count}")


def with_mid_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """The table with the mid-rank of each row's number among all rows; missing numbers have none."""
    x = F.col(f"`{column}`").cast("double")
    counts = df.where(x.isNotNull()).groupBy(x.alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("__c"))
    ranks = mid_ranks(counts, "__v", "__c").select("__v", F.col("rank").alias(name))
    return materialised(df.withColumn("__v", x).join(few(ranks), "__v", "left").drop("__v"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    return materialised(df.withColumn(name, F.monotonically_increasing_id()))


TRUE, FALSE = ("1", "true"), ("0", "false")


def to_type(c: Column, kind: str, source: str) -> Column:
    """Cast between attribute types; numbers are true when not 0, texts when a true literal."""
    if kind == model.NOMINAL:
        return c.cast("int").cast("string") if source == model.BINARY else c.cast("string")
    if kind == model.NUMERIC:
        return c.try_cast("double") if source == model.NOMINAL else c.cast("double")
    if source == model.NUMERIC:
        return c != 0
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def cast_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    source = model.attribute_types(df.select(name))[name]
    return df.withColumn(name, to_type(F.col(f"`{name}`"), kind, source)) if kind != source else df


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull() | (c == "?") if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN to null; null binaries to false."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = F.coalesce(c, F.lit(False))
    return df.withColumns(out) if out else df


def replace_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({k: F.when(missing(df, k), F.lit(v)).otherwise(F.col(f"`{k}`")) for k, v in values.items()})


def type_census(df: DataFrame, enabled: set[str] | None = None) -> dict[str, tuple[int, int]]:
    """Columns of each type: all and enabled."""
    types = model.attribute_types(df)
    return {t: (sum(x == t for x in types.values()), sum(x == t and (enabled is None or a in enabled) for a, x in types.items())) for t in (model.NOMINAL, model.NUMERIC, model.BINARY)}


def multi_sort(df: DataFrame, *columns: str) -> DataFrame:
    """Binary true first, numbers and texts ascending."""
    types = model.attribute_types(df)
    return df.orderBy(*(F.col(c).desc() if types.get(c) == model.BINARY else F.col(c).asc() for c in columns))


def quantile_cuts(df: DataFrame, name: str, bins: int) -> DataFrame:
    """Split points: the value at place n*b/B (from 0) of the sorted column for b = 1..B-1; counts by value first."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    run = running(counts, "v", ["n"]).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    return run.where(f"run_n > {total}L * b div {bins}").groupBy("b").agg(F.min("v").alias("cut"))


def discretised(df: DataFrame, name: str, bins: int) -> DataFrame:
    """The column's equal-height bin (1..B) beside the table's columns."""
    cuts = sorted({r[1] for r in quantile_cuts(df, name, bins).collect()})
    c = F.col(name)
    return df.withColumn(f"{name}_bin", reduce(lambda e, x: e + (c >= x).cast("int"), cuts, F.lit(1)))


def equal_width_bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin 0..B-1; the maximum falls in the last."""
    return F.least(F.floor((c - lo) / ((hi - lo) / bins if hi > lo else 1.0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, name: str, target: Column, bins: int) -> DataFrame:
    lo, hi = df.agg(F.min(name), F.max(name)).first()
    return df.where(F.col(name).isNotNull()).groupBy(equal_width_bin(F.col(name), lo, hi, bins).alias("bin"), target.alias("target")).agg(F.count(F.lit(1)).alias("n"))


DESCRIBED = ("n", "mean", "variance", "sd", "median", "iqr", "skewness", "kurtosis", "minimum", "maximum")


def described(df: DataFrame, column: str) -> DataFrame:
    """One row of the usual numbers of a column; median and quartiles come from its counts by value."""
    x = F.col(f"`{column}`").cast("double")
    q1, median, q3 = quantiles(counted(df, column), "v", "n", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    number = lambda v: F.lit(v).cast("double")
    aggs = {"n": F.count(x), "mean": F.avg(x), "variance": F.var_samp(x), "sd": F.stddev_samp(x), "median": number(median), "iqr": number(None if q1 is None else q3 - q1), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x), "minimum": F.min(x), "maximum": F.max(x)}
    return df.where(~F.isnan(x)).agg(*(aggs[k].alias(k) for k in DESCRIBED))


def bin_rules(n: float, sd: float, iqr: float, skew: float, width: float) -> dict[str, float]:
    """Numbers of bins (or, for the last, a kernel width) by the usual rules."""
    per = lambda h: math.ceil(width / h) if h > 0 else 1
    sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 1.0
    return {
        "square_root": math.ceil(math.sqrt(n)), "sturges": math.ceil(math.log2(n)) + 1, "rice": math.ceil(2 * n ** (1 / 3)), "doane": math.ceil(1 + math.log2(n) + math.log2(1 + abs(skew) / sigma)),
        "scott": per(3.5 * sd * n ** (-1 / 3)), "freedman_diaconis": per(2 * iqr * n ** (-1 / 3)), "silverman": 0.9 * min(sd, iqr / 1.34) * n**-0.2,
    }


def trapezoid(df: DataFrame, x: str, y: str) -> Column:
    """Integral of y over x from rows (x, y), as one column over an ordered window."""
    w = Window.orderBy(x)
    return (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2


def score_order(df: DataFrame, score: str, key: str, name: str = "place", buckets: int | None = None) -> DataFrame:
    """Place of every row from 1 by falling score (missing ones last), equals by key: in ranges of the score, with offsets, so that no task gets all rows."""
    x = F.col(score).cast("double")
    parted = df.withColumn("__b", F.when(x.isNull(), -1).otherwise(range_of(x, range_cuts(df, x, df.count(), buckets))))
    sizes = parted.groupBy("__b").count()
    offsets = sizes.select("__b", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(F.desc(score), key))
    return parted.withColumn("__i", inside).join(F.broadcast(offsets), "__b").withColumn(name, F.col("__i") + F.col("__before")).drop("__b", "__i", "__before")


def kendall_tau(a: list[float], b: list[float]) -> float:
    n = len(a)
    s = sum(math.copysign(1, a[i] - a[j]) * math.copysign(1, b[i] - b[j]) for i in range(n) for j in range(i) if a[i] != a[j] and b[i] != b[j])
    return s / (n * (n - 1) / 2)


def mean_of_top(results: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Mean quality of the first k of each group of results."""
    w = Window.partitionBy(*keys).orderBy(F.col("quality").desc(), "nr")
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy(*keys).agg(F.avg("quality").alias("mean_quality"))


def enrich(df: DataFrame, links: DataFrame, scores: DataFrame, key: str, concept: str, columns: list[str], least: float = 0.01) -> DataFrame:
    """Left joins key -> concept -> scores; scores above ``least`` stay, all else is 0."""
    out = df.join(links, key, "left").join(scores, concept, "left")
    return out.withColumns({c: F.when(F.col(c) > least, F.col(c)).otherwise(0.0) for c in columns})


def with_columns_of(df: DataFrame, group: dict[str, Column]) -> DataFrame:
    """Adds a group of columns."""
    return df.withColumns(group)


def without_columns_of(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))


def subset_by_mask(values: list, mask: int) -> list:
    """The values whose bit is set, lowest bit first."""
    return [v for i, v in enumerate(values) if mask >> i & 1]


def scape_loss(rows: DataFrame, positive: Column, score: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over positives of the negatives ranked above, ties a half, by group; counts by score first."""
    g = rows.where(score.isNotNull()).groupBy(*keys, score.cast("double").alias("score")).agg(F.sum(positive.cast("double")).alias("p"), F.sum((~positive).cast("double")).alias("q"))
    above = running(materialised(g), "score", ["q"], keys, ascending=False).withColumn("above", F.col("run_q") - F.col("q") / 2)
    return above.groupBy(*keys).agg((F.sum(F.col("p") * F.col("above")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("loss"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
