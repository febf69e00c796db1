"""An index of conditions for wide beams: which of thousands of candidates cover a row, without an expression for each.

The distinct elementary conditions of a beam are evaluated once for a block of
rows, as bit vectors over its rows; a candidate is a list of conditions, and its
rows are the AND of their vectors. What a level needs of an attribute is then a
product of two matrices, candidates by rows and rows by values, whose cells are
sums of the statistics; a task keeps these sums for all its rows and emits them
once. Attributes have numbered values (codes), found once a run: their values
where they are few, else ranges of about equal height. A beam is dealt in groups
of candidates so that a task's sums stay within SUM_BYTES.

Attributes with very many values are searched from coarse to fine: sums by range
bound what a cut inside a range can reach, because a convex measure of covered
rows and positives has its maximum over a rectangle at a corner. Only ranges
that can hold a best cut are read again value by value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.model import AT_LEAST, AT_MOST, BETWEEN, BINARY, ELEMENT_OF, EQUALS, NOMINAL, NUMERIC, Condition, Conditions
from sieveline.operators import tables
from sieveline.operators.stats import Statistics

#: Values up to which an attribute is numbered by value; ranges of others; bytes of a task's sums; candidates whose rows are looked at together.
FEW_VALUES, RANGES, SUM_BYTES, TOGETHER = 256, 64, 64 << 20, 256


@dataclass(frozen=True)
class Codes:
    """How an attribute's values are numbered: by value (texts, or numbers in ascending order), or by range between cuts."""

    kind: str
    values: tuple
    ranged: bool = False

    def __len__(self) -> int:
        return len(self.values) + (1 if self.ranged else 0)

    def of(self, column: "Column") -> np.ndarray:
        """The code of each row, -1 where there is none."""
        if self.kind == NUMERIC:
            x = column.numbers
            ok = ~np.isnan(x)
            at = np.searchsorted(np.array(self.values, float), x, "right" if self.ranged else "left")
            return np.where(ok, at, -1)
        if self.kind == BINARY:
            return np.array([self.values.index("0"), self.values.index("1")])[column.flags.astype(int)]
        at = pc.index_in(column.texts, pa.array(self.values, pa.string()))
        return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Column:
    """One attribute of a block: numbers (NaN: missing), flags (null: false) or texts."""

    def __init__(self, data: pa.Array, kind: str):
        if kind == NUMERIC:
            self.numbers = pc.fill_null(data, math.nan).to_numpy(zero_copy_only=False)
            self.missing = pc.is_null(data).to_numpy(zero_copy_only=False)
        elif kind == BINARY:
            self.flags = pc.fill_null(data, False).to_numpy(zero_copy_only=False)
        else:
            self.texts = data
            encoded = data.dictionary_encode()
            self.codes = pc.fill_null(encoded.indices, len(encoded.dictionary)).to_numpy(zero_copy_only=False)
            self.known = {v: i for i, v in enumerate(encoded.dictionary.to_pylist())}

    def holds(self, c: Condition) -> np.ndarray:
        """Rows of an elementary condition, as Condition.expression has it (NaN above all numbers)."""
        if isinstance(c.value, bool):
            return self.flags == c.value
        if c.operator == ELEMENT_OF:
            own = [self.known[v] for v in c.value if v in self.known] + ([len(self.known)] if "?" in c.value else [])
            return np.isin(self.codes, own)
        if isinstance(c.value, str):
            return self.codes == self.known.get(c.value, -1)
        x = np.where(np.isnan(self.numbers), math.inf, self.numbers)
        if c.operator == AT_MOST:
            e = x <= c.value
        elif c.operator == AT_LEAST:
            e = x >= c.value
        elif c.operator == BETWEEN:
            lo, hi = c.value
            e = ((x > lo) if not math.isinf(lo) else True) & ((x <= hi) if not math.isinf(hi) else np.ones(len(x), bool))
        else:
            e = x == c.value
        return e & ~self.missing


class ConditionIndex:
    """A beam as numbers: its distinct conditions, and each candidate as numbers of conditions (the last one holds everywhere)."""

    def __init__(self, beam: list[Conditions]):
        self.conditions = list(dict.fromkeys(c for own in beam for c in own))
        number = {c: i for i, c in enumerate(self.conditions)}
        width = max((len(own) for own in beam), default=0) or 1
        self.candidates = np.full((len(beam), width), len(self.conditions), np.int64)
        for i, own in enumerate(beam):
            self.candidates[i, : len(own)] = [number[c] for c in own]
        self.attributes = sorted({c.attribute for c in self.conditions})

    def bits(self, columns: dict[str, Column], rows: int) -> np.ndarray:
        """A bit vector over the block's rows for each condition, and one of ones."""
        out = np.zeros((len(self.conditions) + 1, -(-rows // 8)), np.uint8)
        for i, c in enumerate(self.conditions):
            out[i] = np.packbits(columns[c.attribute].holds(c))
        out[-1] = np.packbits(np.ones(rows, bool))
        return out

    def covers(self, bits: np.ndarray, a: int, b: int, rows: int) -> np.ndarray:
        """Whether candidates a..b cover each row."""
        own = self.candidates[a:b]
        made = bits[own[:, 0]]
        for j in range(1, own.shape[1]):
            made &= bits[own[:, j]]
        return np.unpackbits(made, axis=1, count=rows).view(bool)


def number_values(df: DataFrame, types: dict[str, str], few: int = FEW_VALUES, ranges: int = RANGES) -> dict[str, Codes]:
    """How each attribute is numbered: at most ``few`` values, or ``ranges`` ranges of numbers. Nominal attributes with more values have no codes."""
    if not types:
        return {}
    cast = lambda a: F.col(f"`{a}`").cast("double" if types[a] == NUMERIC else "string")
    spread = df.agg(*(F.approx_count_distinct(cast(a)).alias(f"n{i}") for i, a in enumerate(types))).first()
    some = [a for i, a in enumerate(types) if types[a] != BINARY and spread[i] <= 1.2 * few]
    many = [a for a in types if types[a] == NUMERIC and a not in some]
    out = {a: Codes(BINARY, ("0", "1")) for a, t in types.items() if t == BINARY}
    for a in some:
        x = cast(a)
        fine = x.isNotNull() & ~F.isnan(x) if types[a] == NUMERIC else x.isNotNull()
        found = [r[0] for r in df.where(fine).select(x.alias("x")).distinct().limit(2 * few + 1).collect()]
        if len(found) <= 2 * few:
            out[a] = Codes(types[a], tuple(sorted(found)))
        elif types[a] == NUMERIC:
            many.append(a)
    if many:
        cuts = df.agg(*(F.percentile_approx(F.when(~F.isnan(cast(a)), cast(a)), [i / ranges for i in range(1, ranges)]).alias(f"c{i}") for i, a in enumerate(many))).first()
        # a range is closed below: its cut is its least value
        out |= {a: Codes(NUMERIC, tuple(sorted(set(cuts[i] or []))), True) for i, a in enumerate(many)}
    return out


def _select(df: DataFrame, types: dict[str, str], attributes: list[str], stats: Statistics) -> DataFrame:
    kinds = {NUMERIC: "double", NOMINAL: "string", BINARY: "boolean"}
    return df.select(*(F.col(f"`{a}`").cast(kinds[types[a]]).alias(f"a{i}") for i, a in enumerate(attributes)), *(v.cast("double").alias("p" + k) for k, v in stats.parts.items()))


def _groups(candidates: int, cells: int, parts: int) -> list[tuple[int, int]]:
    size = max(1, SUM_BYTES // (8 * max(1, cells) * parts))
    return [(a, min(a + size, candidates)) for a in range(0, candidates, size)]


def _used(beam: list[Conditions]) -> dict[str, str]:
    """Types of the attributes of a beam's conditions, by their values."""
    kind = lambda c: BINARY if isinstance(c.value, bool) else NOMINAL if isinstance(c.value, (str, frozenset)) else NUMERIC
    return {c.attribute: kind(c) for own in beam for c in own}


def coded_sums(df: DataFrame, beam: list[Conditions], types: dict[str, str], codes: dict[str, Codes], stats: Statistics) -> DataFrame:
    """(cand, attr, code, statistics...) of all candidates and the attributes with codes."""
    kinds = types | _used(beam)
    parts = list(stats.parts)
    names = list(codes)
    out = None
    for low, high in _groups(len(beam), sum(map(len, codes.values())), len(parts)):
        own = ConditionIndex(beam[low:high])
        attributes = list(dict.fromkeys([*names, *own.attributes]))

        def run(batches, own=own, attributes=attributes, low=low):
            sums = {a: np.zeros((len(own.candidates), len(codes[a]) * len(parts))) for a in names}
            for batch in batches:
                rows = batch.num_rows
                if not rows:
                    continue
                columns = {a: Column(batch.column(f"a{i}"), kinds[a]) for i, a in enumerate(attributes)}
                values = np.stack([batch.column("p" + p).to_numpy(zero_copy_only=False) for p in parts], axis=1)
                # small whole numbers are exact in single precision
                kind = np.float32 if (np.abs(values).max() * rows < 1 << 24 and (values == np.rint(values)).all()) else np.float64
                bits = own.bits(columns, rows)
                spread = {}
                for a in names:
                    code = codes[a].of(columns[a])
                    at = np.flatnonzero(code >= 0)
                    w = np.zeros((rows, len(codes[a]), len(parts)), kind)
                    w[at, code[at]] = values[at]
                    spread[a] = w.reshape(rows, -1)
                every = np.concatenate(list(spread.values()), axis=1)
                for x in range(0, len(own.candidates), TOGETHER):
                    made = own.covers(bits, x, x + TOGETHER, rows).astype(kind) @ every
                    at = 0
                    for a in names:
                        n = spread[a].shape[1]
                        sums[a][x : x + TOGETHER] += made[:, at : at + n]
                        at += n
            for a in names:
                cells = sums[a].reshape(len(own.candidates), len(codes[a]), len(parts))
                cand, code = np.nonzero((cells != 0).any(2))
                for i in range(0, len(cand), 100_000):
                    c, k = cand[i : i + 100_000], code[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c + low, pa.int32()), pa.array([a] * len(c), pa.string()), pa.array(k, pa.int32()), *(pa.array(cells[c, k, j]) for j in range(len(parts)))], names=["cand", "attr", "code", *parts])

        made = _select(df, kinds, attributes, stats).mapInArrow(run, "cand int, attr string, code int, " + ", ".join(f"`{p}` double" for p in parts))
        out = made if out is None else out.union(made)
    return out.groupBy("cand", "attr", "code").agg(*(F.sum(p).alias(p) for p in parts))


def single_sums(df: DataFrame, beam: list[Conditions], types: dict[str, str], attributes: list[str], stats: Statistics, wanted: tuple[dict[str, Codes], DataFrame] | None = None) -> DataFrame:
    """(cand, attr, v, s, statistics...) of attributes without codes, value by value.

    With ``wanted`` (codes, and rows (cand, attr, code)) only of these ranges. A
    block emits what its candidates cover, summed by value.
    """
    kinds = types | _used(beam)
    parts = list(stats.parts)
    own = ConditionIndex(beam)
    needed = list(dict.fromkeys([*attributes, *own.attributes]))
    masks = None
    if wanted is not None:
        codes, rows = wanted
        masks = {a: np.zeros((len(beam), len(codes[a])), bool) for a in attributes}
        for r in rows.collect():  # at most candidates times attributes times RANGES, packed below
            for k in r["codes"]:
                masks[r["attr"]][r["cand"], k] = True
        masks = {a: np.packbits(m, axis=1) for a, m in masks.items()}

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = {a: Column(batch.column(f"a{i}"), kinds[a]) for i, a in enumerate(needed)}
            values = np.stack([batch.column("p" + p).to_numpy(zero_copy_only=False) for p in parts], axis=1)
            bits = own.bits(columns, rows)
            for a in attributes:
                number = kinds[a] == NUMERIC
                key = columns[a].numbers if number else columns[a].codes
                order = np.argsort(key, kind="stable")
                order = order[~np.isnan(key[order])] if number else order[key[order] < len(columns[a].known)]
                sorted_key, sorted_values = key[order], values[order]
                code = codes[a].of(columns[a])[order] if masks is not None else None
                for x in range(0, len(beam), TOGETHER):
                    made = own.covers(bits, x, x + TOGETHER, rows)[:, order]
                    if masks is not None:
                        made &= np.unpackbits(masks[a][x : x + TOGETHER], axis=1).view(bool)[:, code]
                    cand, at = np.nonzero(made)
                    if not len(cand):
                        continue
                    k = sorted_key[at]
                    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (cand[1:] != cand[:-1]))))
                    summed = np.add.reduceat(sorted_values[at], first, axis=0)
                    n = len(first)
                    v = pa.array(k[first].astype(float)) if number else pa.nulls(n, pa.float64())
                    s = pa.nulls(n, pa.string()) if number else pa.array(list(columns[a].known), pa.string()).take(pa.array(k[first].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(cand[first] + x, pa.int32()), pa.array([a] * n, pa.string()), v, s, *(pa.array(summed[:, j]) for j in range(len(parts)))], names=["cand", "attr", "v", "s", *parts])

    made = _select(df, kinds, needed, stats).mapInArrow(run, "cand int, attr string, v double, s string, " + ", ".join(f"`{p}` double" for p in parts))
    return made.groupBy("cand", "attr", "v", "s").agg(*(F.sum(p).alias(p) for p in parts))


def values(df: DataFrame, beam: list[Conditions], types: dict[str, str], codes: dict[str, Codes], stats: Statistics) -> DataFrame:
    """(cand, attr, v, s, statistics...) like refine.values, for any number of candidates."""
    parts = list(stats.parts)
    by_value = {a: c for a, c in codes.items() if a in types and not c.ranged}
    rest = [a for a in types if a not in by_value]
    pieces = []
    if by_value:
        known = [(a, k, float(v) if c.kind == NUMERIC else None, None if c.kind == NUMERIC else v) for a, c in by_value.items() for k, v in enumerate(c.values)]
        known = df.sparkSession.createDataFrame(known, "attr string, code int, v double, s string")
        pieces.append(coded_sums(df, beam, types, by_value, stats).join(F.broadcast(known), ["attr", "code"]).select("cand", "attr", "v", "s", *parts))
    if rest:
        pieces.append(single_sums(df, beam, types, rest, stats))
    return reduce(DataFrame.union, pieces)


def bounded_cuts(df: DataFrame, beam: list[Conditions], types: dict[str, str], codes: dict[str, Codes], stats: Statistics, operators: tuple[str, ...], quality, gate, least: float) -> DataFrame:
    """(cand, attr, op, v, statistics...) of <= and >= cuts of attributes numbered by range: among them the best of each candidate, attribute and operator that passes the gate, unless its quality is below ``least``.

    ``quality`` makes a column of a convex measure from the SQL of B and HB, ``gate`` one of what may be chosen.
    """
    parts = list(stats.parts)
    coarse = coded_sums(df, beam, types, codes, stats).withColumn("all", F.sum("B").over(Window.partitionBy("cand", "attr")))
    coarse = tables.materialised(coarse)
    edges = []
    for op in operators:
        w = Window.partitionBy("cand", "attr").orderBy(F.col("code").asc() if op == AT_MOST else F.col("code").desc()).rowsBetween(Window.unboundedPreceding, 0)
        edges.append(coarse.select("cand", "attr", F.lit(op).alias("op"), "code", "all", *parts, *(F.sum(p).over(w).alias("to_" + p) for p in parts)))
    edges = reduce(DataFrame.union, edges).withColumns({"from_" + p: F.col("to_" + p) - F.col(p) for p in parts})
    corner = lambda b, h: F.when(F.expr(f"{b} > 0"), quality(b, h)).otherwise(0.0)  # noqa: E731  an empty cover has no quality
    # covered rows less positives and positives grow separately: four corners
    reach = F.greatest(*(corner(b, h) for b, h in (("to_B", "to_HB"), ("from_B + to_HB - from_HB", "to_HB"), ("to_B - to_HB + from_HB", "from_HB"), ("from_B", "from_HB"))))
    edges = edges.withColumns({"reach": reach, "known": F.when(gate("to_B", "to_HB") & (F.col("to_B") < F.col("all")), corner("to_B", "to_HB")).otherwise(float("-inf"))})
    edges = tables.materialised(edges.withColumn("best", F.max("known").over(Window.partitionBy("cand", "attr", "op"))))
    slack = 1e-12
    chosen = edges.where((F.col("reach") >= F.col("best") - slack) & (F.col("reach") >= least - slack))
    wanted = chosen.select("cand", "attr", "code").distinct().groupBy("cand", "attr").agg(F.collect_set("code").alias("codes"))
    fine = []
    for low in range(0, len(beam), 4096):
        part = wanted.where((F.col("cand") >= low) & (F.col("cand") < low + 4096)).withColumn("cand", F.col("cand") - low)
        sums = single_sums(df, beam[low : low + 4096], types, list(codes), stats, (codes, part))
        fine.append(sums.withColumn("cand", F.col("cand") + low))
    fine = tables.materialised(reduce(DataFrame.union, fine))
    number = F.pandas_udf(lambda attr, v: pd.Series(_codes_of(codes, attr, v)), "int")
    fine = fine.withColumn("code", number("attr", "v"))
    offsets = chosen.select("cand", "attr", "op", "code", *("from_" + p for p in parts))
    joined = fine.join(offsets, ["cand", "attr", "code"])
    out = []
    for op in operators:
        w = Window.partitionBy("cand", "attr", "code").orderBy(F.col("v").asc() if op == AT_MOST else F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out.append(joined.where(F.col("op") == op).select("cand", "attr", "op", "v", *((F.sum(p).over(w) + F.col("from_" + p)).alias(p) for p in parts)))
    return reduce(DataFrame.union, out)


def _codes_of(codes: dict[str, Codes], attr: pd.Series, v: pd.Series) -> np.ndarray:
    out = np.zeros(len(v), np.int32)
    for a, c in codes.items():
        own = (attr == a).to_numpy()
        out[own] = np.searchsorted(np.array(c.values, float), v.to_numpy()[own], "right")
    return out
