"""Subgroup discovery: rounds of refinement; each is one job over all its candidates and attributes.

A round's gated rows are written once to the shared folder, and deleted when
results and the next candidates are taken from them. Rows that come to one
description by another order of conditions, or by conditions that imply each
other, are one before any bound applies. Only results and the next candidates
come to the driver.

Beams (plain, ROC, cover-based) go level by level and keep a bounded part of each.
The other orders keep all gated refinements in a frontier and differ in what
they take from it next: breadth first a whole level; best first the best ones,
and none whose every specialisation must stay below the results that are known;
depth first the children of the last branch, from a table of that branch's rows
alone. More than MOST_CARRIED waiting descriptions are an error that asks for a
tighter gate.

A time limit or ``cancel()`` interrupts the running round. What was found before
is returned: of beams the levels that ended, of the others the rounds.
"""

from __future__ import annotations

import heapq
import itertools
import math
import threading
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import measures
from sieveline.model import Condition, Conditions, Settings, Target
from sieveline.operators import cover_index, kernel_search, post, refine, tables
from sieveline.operators.propensity import with_propensity
from sieveline.operators.stats import RANK, positive, statistics

#: Descriptions that an unbounded beam or result list may bring to the driver.
MOST_CARRIED = 1_000_000
#: Candidates of a round of a frontier: of best first, and of breadth first under a time limit.
ROUND = 512
#: Strategies that keep every gated refinement.
FRONTIER = ("breadth", "best_first", "depth_first")
#: The part of a table's rows below which a branch gets a table of its own.
SHRINK = 0.5


def _condition(row, types: dict[str, str]) -> Condition:
    kind = types[row["attr"]]
    if row["op"] == model.BETWEEN:
        return Condition(row["attr"], row["op"], (row["lo"], row["hi"]))
    if row["op"] == model.ELEMENT_OF:
        return Condition(row["attr"], row["op"], frozenset(row["set"]))
    if kind == model.NUMERIC:
        return Condition(row["attr"], row["op"], row["v"])
    return Condition(row["attr"], row["op"], row["s"] == "1" if kind == model.BINARY else row["s"])


class SubgroupDiscovery:
    """A run over one table, one target and one group of settings; an optional selection is a row filter.

    Background knowledge (descriptions) is what propensity measures expect the target from.
    """

    def __init__(self, df: DataFrame, target: Target, settings: Settings, types: dict[str, str] | None = None, selection=None, knowledge: list[Conditions] = ()):
        self.df = df if selection is None else df.where(selection)
        self.knowledge = list(knowledge)
        self.target, self.settings = target, settings
        found = model.attribute_types(df, target.columns)
        self.types = types if types is not None else found
        self.order = {a: i for i, a in enumerate(df.columns)}
        self.kernel = target.type in kernel_search.TARGETS or settings.measure in kernel_search.MEASURES
        self.stats = self.group = None
        self.cancelled, self.carried = False, ()

    def cancel(self) -> None:
        """Stop the search; safe to call from another thread. ``run`` returns what was found so far."""
        self.cancelled = True
        if self.group:
            self.df.sparkSession.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.group)

    def run(self) -> list[dict]:
        """Ranked results: dictionaries with conditions (a tuple), depth, coverage, quality, secondary, tertiary."""
        self._explore()
        return self._finished(list(self.results.values()))

    def _explore(self) -> None:
        """The search as a group of jobs that a timer or ``cancel`` can interrupt."""
        s = self.settings
        described = {c.attribute for own in self.knowledge for c in own}
        self.df = self.df.select(*dict.fromkeys([*self.types, *self.target.columns, *sorted(described), *self.carried]))
        context = self.df.sparkSession.sparkContext
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        self.cancelled, self.expanded, self.results, self.group = False, 0, {}, f"search-{uuid.uuid4().hex}"
        context.setJobGroup(self.group, "subgroup search", True)
        timer = threading.Timer(60 * s.max_minutes, self.cancel) if s.max_minutes > 0 else None
        try:
            if timer:
                timer.daemon = True
                timer.start()
            self._search()
        except Exception:
            if not self.cancelled:
                raise
        finally:
            if timer:
                timer.cancel()
            self.group = None
            for k, v in before.items():
                context.setLocalProperty(k, v)

    def _finished(self, results: list[dict]) -> list[dict]:
        s = self.settings
        out = sorted(results, key=lambda r: (-s.rank(r["quality"]), -r["coverage"], [c.key(self.order) for c in r["conditions"]]))
        if s.min_improvement:
            out = post.without_weak_specialisations(out, s.min_improvement)
        out = out[: s.max_results] if s.max_results > 0 else out
        if s.p_values:
            from sieveline.operators import validation

            validation.assign_p_values(self.df, self.target, s, out)
        return out

    def _search(self) -> None:
        s = self.settings
        if s.measure in measures.PROPENSITY:
            self.df = with_propensity(self.df, self.target, self.knowledge)
        if self.target.type == "single_ordinal" and not self.kernel:
            self.df = tables.with_mid_rank(self.df, self.target.columns[0], RANK)
        self.stats = kernel_search.base(self.df, self.target) if self.kernel else statistics(self.df, self.target)
        self.wide = {} if self.kernel else refine.wide_bounds(self.df, self.types)
        self.codes = None
        if s.min_support and "HB" not in self.stats.parts:
            raise ValueError("min_support needs a nominal target: only its positives are counted")
        self.minimum = s.minimum if s.minimum is not None else self.stats.measures[s.measure].minimum
        self.total = int(self.stats.whole["N"])
        start: list[tuple[Conditions, int, float]] = [(c, self.total, 0.0) for c in (s.beam_seed or [()])]
        if s.beam_seed:
            counts = self.df.agg(*(F.count_if(model.conjunction(c)).alias(f"c{i}") for i, c in enumerate(s.beam_seed))).first()
            start = [(c, n, 0.0) for c, n in zip(s.beam_seed, counts)]
        if s.strategy == "depth_first":
            self._depth_first(start)
        elif s.strategy in FRONTIER:
            self._frontier(start)
        else:
            beam = start
            for depth in range(s.depth):
                if not beam:
                    break
                beam = self._round(self.df, beam, [depth] * len(beam), self._next)

    def _round(self, df: DataFrame, beam: list[tuple], depths: list[int], follow) -> list:
        """Refine candidates (conditions, coverage, quality) of these depths: takes up results, and returns ``follow(rows, candidates)`` of what may be refined further."""
        s = self.settings
        candidates = [c for c, _, _ in beam]
        last = min(depths) + 1 >= s.depth
        self.expanded += len(beam)
        rows = self._level(df, candidates, last)
        parents = self.df.sparkSession.createDataFrame([(i, n, d, *g) for i, ((_, n, _), d, g) in enumerate(zip(beam, depths, self._groups(candidates)))], "cand int, parent bigint, depth int, run int, total bigint")
        rows = rows.join(F.broadcast(parents), "cand").where(F.col("coverage") < F.col("parent"))
        if s.min_support:
            rows = rows.where(F.col("support") >= s.min_support)
        result_gate = (F.col("coverage") >= s.min_coverage) & (F.col("coverage") <= F.col("total") * s.max_coverage_share) & (F.col("quality") > self.minimum)
        if s.max_coverage:
            result_gate &= F.col("coverage") <= s.max_coverage
        beam_gate = (F.col("coverage") > s.min_coverage) & (F.col("coverage") > 1) & (F.col("depth") + 1 < s.depth)
        rows = rows.withColumns({"as_result": F.coalesce(result_gate, F.lit(False)), "in_beam": F.coalesce(beam_gate, F.lit(False))}).where("as_result or in_beam")
        rows, remove = tables.written(rows)
        best = "best" in s.numeric_strategy or s.numeric_strategy == "intervals"
        for_result, for_beam = rows.where("as_result"), rows.where("in_beam")
        if best or s.nominal_sets:
            for_result, for_beam = refine.best_per_operator(for_result, best), refine.best_per_operator(for_beam, best)
        if s.nominal_sets:
            for_result, for_beam = refine.with_sets(for_result, self.ordered), refine.with_sets(for_beam, self.ordered)
        for_result = self._described(for_result, candidates, depths, self.results if s.strategy not in FRONTIER else ())
        for row in self._bounded(for_result.orderBy(*self._ranked()), s.max_results):
            own, depth = self._own(row, candidates), depths[row["cand"]] + 1
            if own and (own not in self.results or depth < self.results[own]["depth"]):
                self.results[own] = {"conditions": own, "depth": depth, "coverage": row["coverage"], "quality": row["quality"], "secondary": row["secondary"], "tertiary": row["tertiary"], "p_value": None}
        found = [] if last else follow(self._described(for_beam, candidates, depths), candidates)
        remove()
        return found

    def _groups(self, candidates: list[Conditions]) -> list[tuple[int, int]]:
        """The run that each candidate belongs to, and its number of rows."""
        return [(0, self.total)] * len(candidates)

    def _waiting(self, rows: DataFrame, candidates: list[Conditions]) -> list[tuple]:
        """Every row as (conditions, coverage, quality, reach, number of its candidate), in rank."""
        rows = rows.withColumn("reach", refine.reach(self.stats, self.settings.measure) if not self.kernel else F.lit(float("inf")))
        return [(self._own(r, candidates), r["coverage"], r["quality"], r["reach"], r["cand"]) for r in self._bounded(rows.orderBy(*self._ranked()), 0)]

    def _threshold(self) -> float:
        """What a description must reach to matter: beyond the minimum, and as good as the worst of as many results as are asked for."""
        s = self.settings
        if s.max_results <= 0 or s.min_improvement or len(self.results) < s.max_results:
            return -math.inf
        least = heapq.nlargest(s.max_results, (r["quality"] for r in self.results.values()))[-1]
        return least if s.digits is None else least - 10.0**-s.digits

    def _frontier(self, start: list[tuple]) -> None:
        """Breadth and best first: a queue of all that may be refined, taken in rounds."""
        s = self.settings
        best = s.strategy == "best_first"
        number = itertools.count()
        key = lambda quality, depth: (-quality,) if best else (depth, -quality)
        queue = [(*key(math.inf, 0), next(number), c, n, q, math.inf, 0) for c, n, q in start]
        depth_of = {c: 0 for c, *_ in start}
        while queue:
            least, batch = self._threshold() if best else -math.inf, []
            width = ROUND if best or s.max_minutes > 0 else len(queue)
            while queue and len(batch) < width and (best or not batch or queue[0][0] == batch[0][-1]):
                *_, c, n, q, reach, depth = heapq.heappop(queue)
                if depth == depth_of[c] and (not best or (reach >= least and reach > self.minimum)):
                    batch.append((c, n, q, depth))
            if not batch:
                continue
            depths = [b[-1] for b in batch]
            for c, n, q, reach, parent in self._round(self.df, [b[:3] for b in batch], depths, self._waiting):
                depth = depths[parent] + 1
                if depth < depth_of.get(c, s.depth):
                    depth_of[c] = depth
                    heapq.heappush(queue, (*key(q, depth), next(number), c, n, q, reach, depth))
            if len(queue) > MOST_CARRIED:
                raise ValueError(f"more than {MOST_CARRIED} descriptions wait to be refined: raise min_coverage or the minimum quality")

    def _depth_first(self, start: list[tuple]) -> None:
        """A stack of branches: children of one candidate, refined on a table of that candidate's rows."""
        s = self.settings
        stack: list = [(self.df, self.total, start, 0)]
        depth_of = {c: 0 for c, *_ in start}
        while stack:
            top = stack.pop()
            if callable(top):  # a branch has ended: its table goes
                top()
                continue
            df, rows, group, depth = top
            if callable(df):  # a branch begins
                df, rows, remove = df()
                if remove:
                    stack.append(remove)
            group = [(c, n, q) for c, n, q in group if depth == depth_of[c]]
            if not group:
                continue
            children: dict[int, list] = {}
            for c, n, q, _, parent in self._round(df, group, [depth] * len(group), self._waiting):
                if depth + 1 < depth_of.get(c, s.depth):
                    depth_of[c] = depth + 1
                    children.setdefault(parent, []).append((c, n, q))
            for parent in sorted(children, reverse=True):  # the best branch ends on top
                stack.append((self._branch(df, rows, group[parent]), rows, children[parent], depth + 1))
            if len(depth_of) > MOST_CARRIED:
                raise ValueError(f"more than {MOST_CARRIED} descriptions: raise min_coverage or the minimum quality")

    def _branch(self, df: DataFrame, rows: int, candidate: tuple):
        """Makes (table, rows, function that deletes it) of a candidate's rows when its branch begins; a table that would hardly shrink is only filtered."""

        def make():
            conditions, n, _ = candidate
            own = df.where(model.conjunction(conditions)) if conditions else df
            if n > SHRINK * rows:
                return own, rows, None
            own, remove = tables.written(own)
            return own, n, remove

        return make

    def _own(self, row, candidates: list[Conditions]) -> Conditions:
        return model.canonical((*candidates[row["cand"]], _condition(row, self.types)), self.order)

    def _ranked(self) -> list:
        quality, digits = F.col("quality"), self.settings.digits
        return [(quality if digits is None else F.round(quality, digits)).desc(), F.col("coverage").desc(), *self._tie_order()]

    def _bounded(self, rows: DataFrame, bound: int) -> list:
        """The first rows, or all of them as long as they are not too many for the driver."""
        found = rows.limit(bound if bound > 0 else MOST_CARRIED + 1).collect()
        if bound <= 0 and len(found) > MOST_CARRIED:
            raise ValueError(f"more than {MOST_CARRIED} descriptions at one level: raise min_coverage or the minimum quality, or bound the results")
        return found

    def _described(self, rows: DataFrame, candidates: list[Conditions], depths: list[int], known: dict = ()) -> DataFrame:
        """Of the rows of one description the first in depth and rank; none of a description that is known already."""
        if candidates == [()]:
            return rows
        order, types = self.order, self.types
        names = ["cand", "attr", "op", "v", "lo", "hi", "s", "set"]

        def texts(cand, attr, op, v, lo, hi, s, values):
            out = []
            for row in zip(cand, attr, op, v, lo, hi, s, values):
                row = dict(zip(names, row))
                out.append(repr(model.canonical((*candidates[row["cand"]], _condition(row, types)), order)))
            return pd.Series(out)

        keyed = rows.withColumn("description", F.pandas_udf(texts, "string")(*names))
        if known:
            earlier = rows.sparkSession.createDataFrame([(repr(k),) for k in known], "description string")
            keyed = keyed.join(tables.few(earlier), "description", "left_anti")
        turn = F.struct("depth", -F.col("quality"), -F.col("coverage"), *self._tie_order())
        return keyed.groupBy("description").agg(F.min_by(F.struct(*rows.columns), turn).alias("x")).select("x.*")

    def _tie_order(self) -> list:
        """Columns in table order, operators in canonical order, then values."""
        place = F.create_map(*(F.lit(x) for a in self.types for x in (a, self.order.get(a, 1 << 30))))
        operator = F.create_map(*(F.lit(x) for o, i in model.OPERATOR_ORDER.items() for x in (o, i)))
        return [place[F.col("attr")], operator[F.col("op")], F.col("v"), F.col("lo"), F.col("hi"), F.col("s"), F.col("cand")]

    def _level(self, df: DataFrame, beam: list[Conditions], last: bool) -> DataFrame:
        """Scored refinements; of many candidates by the index of conditions."""
        self.ordered = None
        if self.kernel:
            return kernel_search.level(df, beam, self.types, self.stats, self.settings, self.target)
        if self.settings.nominal_sets:
            rows, self.ordered = refine.level_with_sets(df, beam, self.types, self.stats, self.settings, self.wide)
            return rows
        if len(beam) > refine.CHUNK and self.codes is None:
            self.codes = cover_index.number_values(self.df, self.types)
        codes = self.codes if len(beam) > refine.CHUNK else None
        return refine.level(df, beam, self.types, self.stats, self.settings, self.wide, True, codes, self.minimum if last else None)

    def _next(self, rows: DataFrame, candidates: list[Conditions]) -> list[tuple]:
        """The next beam."""
        s, ranked = self.settings, self._ranked()
        if s.strategy == "roc" and "H" in self.stats.whole:
            found = self._on_hull(rows)
        elif s.strategy == "cover":
            found = self._covering(rows.orderBy(*ranked), candidates)
        else:
            found = self._bounded(rows.orderBy(*ranked), s.width)
        out = [(self._own(r, candidates), r["coverage"], r["quality"]) for r in found]
        out = list({c: (c, n, q) for c, n, q in reversed(out)}.values())
        return sorted(out, key=lambda r: (-s.rank(r[2]), -r[1], [c.key(self.order) for c in r[0]]))

    def _on_hull(self, rows: DataFrame) -> list:
        """All rows on the upper hull of their ROC points: each task keeps its own hull, the hull of these is that of all."""
        n, h = self.stats.whole["N"], self.stats.whole["H"]
        points = lambda coverage, support: list(zip((coverage - support) / max(n - h, 1), support / max(h, 1)))
        spread = rows.withColumns({"coverage": F.col("coverage").cast("long"), "support": F.col("support").cast("long")})

        def hull(frames):
            frames = [f for f in frames if len(f)]
            if frames:
                kept = pd.concat(frames, ignore_index=True)
                own = points(kept["coverage"].to_numpy(float), kept["support"].to_numpy(float))
                corners = set(post.roc_hull(own))
                yield kept[np.array([p in corners for p in own], bool)]

        # a task gets only the best true positive rate of each false positive rate
        top = spread.groupBy((F.col("coverage") - F.col("support")).alias("false")).agg(F.max("support").alias("support")).select((F.col("false") + F.col("support")).alias("coverage"), "support")
        kept = top.mapInPandas(hull, "coverage long, support long").collect()
        if not kept:
            return []
        on = post.on_roc_hull(points(np.array([r[0] for r in kept], float), np.array([r[1] for r in kept], float)))
        vertices = self.df.sparkSession.createDataFrame([tuple(r) for r, k in zip(kept, on) if k], "coverage long, support long") if any(on) else None
        return spread.join(F.broadcast(vertices), ["coverage", "support"]).collect() if vertices is not None else []

    def _covering(self, rows: DataFrame, candidates: list[Conditions]) -> list:
        """The greedy cover-based choice from all rows. They are loaded in blocks by falling quality: a weight is at most 1, so what is not loaded cannot beat a choice whose weighted quality is above its own quality."""
        s = self.settings
        block, loaded = max(4 * s.width, 50), []
        while True:
            new = rows.offset(len(loaded)).limit(block + 1).collect()
            more = new[block]["quality"] if len(new) > block else None
            loaded += new[:block]
            own = [{"conditions": self._own(r, candidates), "quality": r["quality"]} for r in loaded]
            chosen, sure = post.cover_choice(self.df, own, s.width, s.alpha, -math.inf if more is None else max(more, 0.0))
            if more is None or sure:
                return [loaded[i] for i in chosen]
            block *= 4

    def table(self, spark: SparkSession | None = None, results: list[dict] | None = None) -> DataFrame:
        return as_table(spark or self.df.sparkSession, self.run() if results is None else results)


def result_rows(results: list[dict]) -> list[tuple]:
    """The eight columns of a result list, by row."""
    return [(i, r["depth"], int(r["coverage"]), float(r["quality"]), *((None if r[k] is None else float(r[k])) for k in ("secondary", "tertiary", "p_value")), model.text_of(r["conditions"])) for i, r in enumerate(results, 1)]


def as_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    return spark.createDataFrame(result_rows(results), model.RESULT_SCHEMA)


def discover(df: DataFrame, target: Target, settings: Settings, **kw) -> DataFrame:
    return SubgroupDiscovery(df, target, settings, **kw).table(df.sparkSession)


def per_target_value(df: DataFrame, column: str, settings: Settings) -> DataFrame:
    """A run for each value of the target against the rest, as one table: all in one search where the settings allow it."""
    from sieveline.operators import runs_together

    if runs_together.suits(Target("single_nominal", (column,)), settings) and dict(df.dtypes)[column] == "string":
        values, runs = runs_together.of_values(df, column)
        found = runs_together.SearchTogether(df, Target("single_nominal", (column,), ""), settings, runs).run_all() if values else []
    else:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        found = [SubgroupDiscovery(df, Target("single_nominal", (column,), v), settings).run() for v in values]
    parts = [as_table(df.sparkSession, own).withColumn("target_value", F.lit(v)) for v, own in zip(values, found)]
    return reduce(DataFrame.union, parts) if parts else as_table(df.sparkSession, []).withColumn("target_value", F.lit(None).cast("string"))


__all__ = ["SubgroupDiscovery", "as_table", "discover", "per_target_value", "positive"]
