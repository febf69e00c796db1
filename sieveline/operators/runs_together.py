"""Many runs of one nominal target in one search: folds, target values, permuted targets.

The runs share table, attributes and settings; they differ in which rows take
part and in which of them are positive. A level is one job over the candidates of
all runs: a task evaluates the distinct conditions of its rows once (see
``cover_index``), and sums what each candidate covers with the labels of that
candidate's run. Rows are neither copied nor shuffled for a run, only sums are.
Results and beams are bounded run by run, so that each run finds what it would
find alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import measures
from sieveline.model import EQUALS, NOMINAL, NUMERIC, RESULT_SCHEMA, Condition, Conditions, Settings, Target
from sieveline.operators import cover_index, post, refine, tables
from sieveline.operators.search import MOST_CARRIED, SubgroupDiscovery, result_rows
from sieveline.operators.stats import Statistics, positive

#: The attribute of the condition by which a candidate belongs to a run; it is evaluated by no row.
RUN = "\x00run"
#: Candidates whose rows are looked at together.
TOGETHER = 64


@dataclass(frozen=True)
class Runs:
    """sizes: rows and positives of each run; key: what the labels need of a row; label(keys, positives): which rows take part (None: all) and which are positive, runs by rows."""

    sizes: list[tuple[int, int]]
    key: Column
    columns: tuple[str, ...]
    label: Callable[[pa.Array, np.ndarray], tuple[np.ndarray | None, np.ndarray]]


def suits(target: Target, settings: Settings) -> bool:
    """Whether runs of these settings can go together; others go one by one."""
    return target.type == "single_nominal" and settings.measure in measures.NOMINAL and settings.strategy in ("beam", "breadth") and not (settings.nominal_sets or settings.p_values or settings.beam_seed)


class SearchTogether(SubgroupDiscovery):
    def __init__(self, df: DataFrame, target: Target, settings: Settings, runs: Runs, types: dict[str, str] | None = None):
        if not suits(target, settings):
            raise ValueError("runs together need a nominal target, a measure of its counts, and a beam or breadth-first search")
        settings = replace(settings, width=0, strategy="beam") if settings.strategy == "breadth" else settings
        super().__init__(df, target, settings, types)
        self.runs, self.carried = runs, runs.columns
        self.types = {a: t for a, t in self.types.items() if a not in runs.columns}
        self.order = {RUN: -1} | self.order

    def run_all(self) -> list[list[dict]]:
        """The ranked results of each run."""
        self._explore()
        by_run: list[list[dict]] = [[] for _ in self.runs.sizes]
        for r in self.results.values():
            own, rest = self._split(r["conditions"])
            by_run[own].append({**r, "conditions": rest})
        return [self._finished(rows) for rows in by_run]

    def _split(self, conditions: Conditions) -> tuple[int, Conditions]:
        return int(next(c.value for c in conditions if c.attribute == RUN)), tuple(c for c in conditions if c.attribute != RUN)

    def _search(self) -> None:
        s = self.settings
        parts = {"B": F.lit(1.0), "HB": positive(self.target).cast("double")}
        self.stats = Statistics(parts, {}, "B", "HB / B", "HB", measures.NOMINAL)
        self.minimum = s.minimum if s.minimum is not None else self.stats.measures[s.measure].minimum
        beam = [((Condition(RUN, EQUALS, float(r)),), n, 0.0) for r, (n, _) in enumerate(self.runs.sizes) if n > 0]
        for depth in range(s.depth):
            if not beam:
                break
            beam = self._round(self.df, beam, [depth] * len(beam), self._next)

    def _groups(self, candidates: list[Conditions]) -> list[tuple[int, int]]:
        return [(r, self.runs.sizes[r][0]) for r in (self._split(c)[0] for c in candidates)]

    def _bounded(self, rows: DataFrame, bound: int) -> list:
        if bound > 0:
            place = F.row_number().over(Window.partitionBy("run").orderBy(*self._ranked()))
            rows = rows.withColumn("__place", place).where(F.col("__place") <= bound).drop("__place")
        return super()._bounded(rows, 0)

    def _level(self, df: DataFrame, beam: list[Conditions], last: bool) -> DataFrame:
        self.ordered = None
        split = [self._split(c) for c in beam]
        whole = [(i, *map(float, self.runs.sizes[r])) for i, (r, _) in enumerate(split)]
        stats = replace(self.stats, whole_of=df.sparkSession.createDataFrame(whole, "cand int, N double, H double"))
        g = self._sums(df, np.array([r for r, _ in split]), [c for _, c in split])
        best = "best" in self.settings.numeric_strategy or self.settings.numeric_strategy == "intervals"
        return refine._level(tables.materialised(g), self.types, stats, self.settings, None, best)

    def _sums(self, df: DataFrame, run_of: np.ndarray, beam: list[Conditions]) -> DataFrame:
        """(cand, attr, v, s, B, HB): a block of rows emits what its candidates cover, by value."""
        index, label, kinds = cover_index.ConditionIndex(beam), self.runs.label, self.types
        attributes = list(kinds)
        cast = {NUMERIC: "double", NOMINAL: "string"}

        def run(batches):
            for batch in batches:
                rows = batch.num_rows
                if not rows:
                    continue
                columns = {a: cover_index.Column(batch.column(f"a{i}"), kinds[a]) for i, a in enumerate(attributes)}
                takes_part, labels = label(batch.column("key"), batch.column("hit").to_numpy(zero_copy_only=False))
                bits = index.bits(columns, rows)
                for a in attributes:
                    number = kinds[a] == NUMERIC
                    key = columns[a].numbers if number else columns[a].codes if kinds[a] == NOMINAL else columns[a].flags.astype(np.int64)
                    names = None if number else list(columns[a].known) if kinds[a] == NOMINAL else ["0", "1"]
                    order = np.argsort(key, kind="stable")
                    order = order[~np.isnan(key[order])] if number else order[key[order] < len(names)]
                    if not len(order):
                        continue
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
                    k = key[order][starts]
                    for x in range(0, len(beam), TOGETHER):
                        own = run_of[x : x + TOGETHER]
                        made = index.covers(bits, x, x + TOGETHER, rows)
                        made = made & takes_part[own] if takes_part is not None else made
                        b = np.add.reduceat(made[:, order].astype(np.int64), starts, axis=1)
                        h = np.add.reduceat((made & labels[own])[:, order].astype(np.int64), starts, axis=1)
                        cand, at = np.nonzero(b)
                        n = len(cand)
                        v = pa.array(k[at].astype(float)) if number else pa.nulls(n, pa.float64())
                        s = pa.nulls(n, pa.string()) if number else pa.array(names, pa.string()).take(pa.array(k[at].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array((cand + x).astype(np.int32)), pa.array([a] * n, pa.string()), v, s, pa.array(b[cand, at].astype(float)), pa.array(h[cand, at].astype(float))], names=["cand", "attr", "v", "s", "B", "HB"])

        plain = df.select(*(F.col(f"`{a}`").cast(cast.get(t, "boolean")).alias(f"a{i}") for i, (a, t) in enumerate(kinds.items())), self.runs.key.alias("key"), positive(self.target).alias("hit"))
        return plain.mapInArrow(run, "cand int, attr string, v double, s string, B double, HB double").groupBy("cand", "attr", "v", "s").agg(F.sum("B").alias("B"), F.sum("HB").alias("HB"))


def of_folds(df: DataFrame, target: Target, fold: str, k: int) -> Runs:
    """Run i takes the rows outside fold i; its numbers are those of all rows less the fold's."""
    c = F.col(f"`{fold}`").cast("int")
    held = {r[0]: (r[1], r[2]) for r in df.groupBy(c.alias("f")).agg(F.count(F.lit(1)), F.count_if(positive(target))).collect()}
    n, h = (sum(x[j] for x in held.values()) for j in (0, 1))
    sizes = [(n - held.get(i, (0, 0))[0], h - held.get(i, (0, 0))[1]) for i in range(k)]

    def label(keys, hits):
        own = pc.fill_null(keys, -1).to_numpy(zero_copy_only=False)
        return own[None] != np.arange(k)[:, None], np.broadcast_to(hits, (k, len(hits)))

    return Runs(sizes, c, (fold,), label)


def of_values(df: DataFrame, column: str) -> tuple[list[str], Runs]:
    """Run i has the i-th value of the target, in order, as its positives."""
    c = F.col(f"`{column}`")
    found = sorted((r[0], r[1]) for r in df.where(c.isNotNull()).groupBy(c).count().limit(MOST_CARRIED).collect())
    values, n = [v for v, _ in found], df.count()

    def label(keys, hits):
        at = pc.fill_null(pc.index_in(keys, pa.array(values, pa.string())), -1).to_numpy(zero_copy_only=False)
        return None, at[None] == np.arange(len(values))[:, None]

    return values, Runs([(n, m) for _, m in found], c, (), label)


def permutation(places: np.ndarray, n: int, seed: int, kept: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A seeded bijection of the numbers 0..n-1: six Feistel rounds on the next even number of bits, taken again where they lead beyond n - 1. ``kept`` holds tables of the rounds, by seed, for the next rows of one n."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    if half <= TABLED:
        kept = {} if kept is None else kept
        if seed not in kept:
            kept[seed] = _round_tables(int(half), seed)
        return _by_tables(places, n, int(half), kept[seed])
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for turn in range(6):
            left, right = right, left ^ (_mixed(right, seed * 6 + turn + 1) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _mixed(x: np.ndarray, number: int) -> np.ndarray:
    z = x + np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Bits of half a row number up to which a round is looked up in a table of all its values.
TABLED = 14


def _round_tables(half: int, seed: int) -> np.ndarray:
    every = np.arange(1 << half, dtype=np.uint64)
    return np.stack([_mixed(every, seed * 6 + turn + 1) & np.uint64((1 << half) - 1) for turn in range(6)]).astype(np.uint16)


def _by_tables(places: np.ndarray, n: int, half: int, tables_of: np.ndarray) -> np.ndarray:
    out, todo = places.astype(np.int64), None
    while todo is None or len(todo):
        x = (out if todo is None else out[todo]).astype(np.uint32)
        left, right = (x >> np.uint32(half)).astype(np.uint16), (x & np.uint32((1 << half) - 1)).astype(np.uint16)
        for turn in range(6):
            left, right = right, left ^ tables_of[turn].take(right)
        made = (left.astype(np.int64) << half) | right
        if todo is None:
            out, todo = made, np.flatnonzero(made >= n)
        else:
            out[todo] = made
            todo = todo[made >= n]
    return out


def numbered_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The table, written once, with dense row numbers from 0 by sizes of its partitions (no sort), and its number of rows."""
    own = tables.materialised(df.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = own.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = own.withColumn("__part", part).join(tables.few(before), "__part")
    return rows.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__part", "__before"), own.count()


def of_permutations(df: DataFrame, target: Target, repeats: int, seed: int) -> tuple[DataFrame, Runs]:
    """Run i has as many positives as the target, at places that a permutation deals them; no row meets another for it."""
    name = "__place"
    rows, n = numbered_rows(df, name)
    h = rows.agg(F.count_if(positive(target))).first()[0]
    kept: dict[int, np.ndarray] = {}  # filled by each task

    def label(keys, hits):
        places = keys.to_numpy(zero_copy_only=False)
        return None, np.stack([permutation(places, n, seed + i, kept) < h for i in range(repeats)])

    return rows, Runs([(n, h)] * repeats, F.col(name), (name,), label)


def of_thresholds(rows: int, column: str, found: list[tuple[float, int]]) -> Runs:
    """Run i has the rows whose number is at least the i-th threshold as its positives; ``found`` gives their count."""
    cuts = np.array([t for t, _ in found], float)

    def label(keys, hits):
        return None, keys.to_numpy(zero_copy_only=False)[None] >= cuts[:, None]

    return Runs([(rows, h) for _, h in found], F.col(column), (column,), label)


#: Thresholds that are searched together; their results are gated and ranked threshold by threshold.
THRESHOLDS = 256


def threshold_searches(df: DataFrame, column: str, settings: Settings, together: int = THRESHOLDS) -> DataFrame:
    """A search of its own for the target ``column >= threshold`` at every distinct number but the least: threshold, the
    columns of a result list, whether a result is a corner of the ROC hull of its threshold, and the area under that hull.

    Rows without a number take no part. Thresholds come in groups of ``together``, each one search over the table, so
    that no round carries the candidates of all; the driver holds the list of results, as of any search. Thresholds without results have no rows; a column of fewer than two
    numbers has no threshold.
    """
    spark, value, mark = df.sparkSession, "__value", "__positive"
    x = F.col(f"`{column}`").cast("double")
    rows = tables.materialised(df.where(x.isNotNull() & ~F.isnan(x)).withColumns({value: x, mark: F.lit("1")}).drop(column))
    n, parts = rows.count(), []
    run = tables.running(tables.counted(rows, value), "v", ["n"], ascending=False)
    thresholds = tables.materialised(run.where(F.col("run_n") < n).select(F.col("v").alias("t"), F.col("run_n").cast("long").alias("h")))
    target, last = Target("single_nominal", (mark,), "1"), float("-inf")
    while found := [(r["t"], r["h"]) for r in thresholds.where(F.col("t") > last).orderBy("t").limit(together).collect()]:
        last = found[-1][0]
        for (t, h), own in zip(found, SearchTogether(rows, target, settings, of_thresholds(n, value, found)).run_all()):
            points, area = post.roc(own, float(n), float(h))
            parts += [(t, *r, corner, area) for r, corner in zip(result_rows(own), post.on_roc_hull(points))]
    return spark.createDataFrame(parts, f"threshold double, {RESULT_SCHEMA}, on_hull boolean, area double")
