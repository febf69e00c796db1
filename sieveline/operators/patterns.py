"""Cover patterns of chosen subgroups: rows counted by which subgroups cover them, and sums over these patterns.

Patterns are counted once and written to the shared folder. What a choice needs of them are whole numbers by a key and a
place (a subgroup, mostly): every task adds up what its blocks of patterns give, then equal keys and places are added.
Nothing but such sums comes to the driver, so the number of patterns has no bound. Up to ``LOCAL`` patterns are added up
by the driver itself. Whole numbers make both the same, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import model
from sieveline.operators import tables

#: Cells (patterns x subgroups) that the driver may hold, and cells of a block in a task.
LOCAL, BLOCK = 4_000_000, 4_000_000
#: Entropies are sums of n log2 n in units of a millionth, so that their order does not matter.
_UNIT = 1e6

#: (cover, n) of a block to keys, places, numbers and totals of equal length.
Sums = Callable[[np.ndarray, np.ndarray], tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]


def pattern_counts(df: DataFrame, subgroups: list[tuple]) -> DataFrame:
    """(mask array<boolean>, n): rows by which subgroups cover them; at most one row for each distinct pattern."""
    return df.select(F.array(*(model.conjunction(c) for c in subgroups)).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def _flat(keys: np.ndarray | None, m: int, values: np.ndarray, totals: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a (keys, m) matrix of sums with the total of each key."""
    names = [b""] * len(values) if keys is None else [k.tobytes() for k in keys]
    return [k for k in names for _ in range(m)], np.tile(np.arange(m), len(values)), values.ravel(), np.repeat(totals, m)


class Patterns:
    """The cover patterns of some subgroups over a table. ``close`` deletes the written table."""

    def __init__(self, df: DataFrame, subgroups: list[tuple], local: int = LOCAL):
        self.m = len(subgroups)
        self.table, self.close = tables.written(pattern_counts(df, subgroups))
        self.own: tuple[np.ndarray, np.ndarray] | None = None
        if self.table.limit(local // max(1, self.m) + 1).count() <= local // max(1, self.m):
            rows = self.table.collect()
            self.own = np.array([[bool(x) for x in r["mask"]] for r in rows], bool).reshape(len(rows), self.m), np.array([r["n"] for r in rows], np.int64)

    def __enter__(self) -> Patterns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _added(self, f: Sums) -> DataFrame | pd.DataFrame:
        """(key, place, n, total), each key and place once: a pandas frame where the driver holds the patterns, else a DataFrame."""
        names = ["key", "place", "n", "total"]
        if self.own is not None:
            return pd.DataFrame(dict(zip(names, f(*self.own)))).groupby(names[:2], as_index=False).sum()
        m, step = self.m, max(1, BLOCK // max(1, self.m))

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    cover = pc.fill_null(part.column("mask").flatten(), False).to_numpy(zero_copy_only=False).reshape(-1, m)
                    key, place, n, total = f(cover, part.column("n").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=names)

        return self.table.mapInArrow(run, "key binary, place long, n long, total long").groupBy("key", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def _numbers(self, f: Sums, width: int) -> np.ndarray:
        """Sums by place, where there is one key."""
        out = np.zeros(width, np.int64)
        if self.own is not None:
            _, places, numbers, _ = f(*self.own)
            out[places] = numbers
            return out
        for r in self._added(f).collect():
            out[r.place] = r.n
        return out

    def rows(self) -> int:
        return int(self._numbers(lambda cover, n: ([b""], np.zeros(1, np.int64), np.array([n.sum()]), np.zeros(1, np.int64)), 1)[0])

    def by_times(self, chosen: list[int]) -> np.ndarray:
        """(subgroup, t): its rows that ``t`` of the chosen subgroups cover."""
        m, width = self.m, len(chosen) + 1

        def f(cover, n):
            times = cover[:, chosen].sum(1)
            sums = np.stack([n[times == t] @ cover[times == t] for t in range(width)], 1) if len(n) else np.zeros((m, width), np.int64)
            return _flat(None, m * width, sums.reshape(1, -1), np.zeros(1, np.int64))

        return self._numbers(f, m * width).reshape(m, width)

    def together(self, team: list[int]) -> np.ndarray:
        """(subgroup, member): rows in both."""
        m, k = self.m, len(team)
        return self._numbers(lambda cover, n: _flat(None, m * k, ((cover * n[:, None]).T @ cover[:, team]).reshape(1, -1), np.zeros(1, np.int64)), m * k).reshape(m, k)

    def times(self) -> np.ndarray:
        """Rows by how many subgroups cover them."""
        width = self.m + 1

        def f(cover, n):
            sums = np.zeros(width, np.int64)
            np.add.at(sums, cover.sum(1), n)
            return _flat(None, width, sums[None], np.zeros(1, np.int64))

        return self._numbers(f, width)

    def entropies(self, team: list[int]) -> np.ndarray:
        """Joint entropy, in bits, of the team together with each subgroup."""
        m = self.m

        def f(cover, n):
            packed = np.packbits(cover[:, team], axis=1) if team else np.zeros((len(n), 1), np.uint8)
            keys, where = np.unique(packed, axis=0, return_inverse=True)
            inside, totals = np.zeros((len(keys), m), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(inside, where.ravel(), cover * n[:, None])
            np.add.at(totals, where.ravel(), n)
            return _flat(keys, m, inside, totals)

        found = self._added(f)
        if isinstance(found, pd.DataFrame):
            units = lambda c: np.rint(c * np.log2(np.maximum(c, 1)) * _UNIT).astype(np.int64)
            found["u"] = units(found["n"]) + units(found["total"] - found["n"])
            sums = found.groupby("place").agg({"u": "sum", "total": "sum"}).reset_index().itertuples()
        else:
            units = lambda c: F.rint(c * F.log2(F.greatest(c, F.lit(1))) * _UNIT).cast("decimal(38,0)")
            sums = found.groupBy("place").agg(F.sum(units(F.col("n")) + units(F.col("total") - F.col("n"))).alias("u"), F.sum("total").alias("total")).collect()
        out = np.zeros(m)
        for r in sums:
            out[r.place] = math.log2(r.total) - float(r.u) / _UNIT / r.total
        return out

    def entropy(self) -> float:
        """Joint entropy of all subgroups."""
        if self.own is not None:
            n = self.own[1]
            return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())
        total, sums = self.table.agg(F.sum("n"), F.sum(F.col("n") * F.log2("n"))).first()
        return math.log2(total) - sums / total
