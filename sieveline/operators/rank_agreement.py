"""Kendall's tau of two columns of a table: agreeing less opposing pairs, by ranges of both.

Both columns are cut into ranges of about equal height; a value that is a cut is
a range of its own, so that very frequent values are ranges without inner order.
Pairs in different ranges of both columns are counted from the table of ranges by
ranges. Pairs within a range of the first column, and those within a range of
the second less what both share, are counted where they lie: sorted by the first
column, merged in blocks that are sorted by the second. No group holds more than
the rows of a range between two cuts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.tables import materialised

#: Rows of a range, most cuts of a column, and rows that are compared all with all before blocks are merged.
RANGE_ROWS, MOST_CUTS, BLOCK = 50_000, 256, 64


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Agreeing less opposing pairs; a pair with equal values in a column is neither."""
    order = np.lexsort((b, a))
    a, b = a[order], np.unique(b[order], return_inverse=True)[1]
    n, score = len(a), 0
    # pairs by place: within a block all with all, then between sorted neighbours, twice as long each time
    parts = []
    for i in range(0, n, BLOCK):
        x = b[i : i + BLOCK]
        score += int(np.triu(np.sign(x[None, :] - x[:, None]), 1).sum())
        parts.append(np.sort(x))
    while len(parts) > 1:
        merged = []
        for left, right in zip(parts[::2], parts[1::2]):
            score += int(np.searchsorted(left, right, "left").sum()) - int((len(left) - np.searchsorted(left, right, "right")).sum())
            merged.append(np.sort(np.concatenate((left, right)), kind="stable"))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    # equal values of the first column were taken in the order of the second
    pairs = lambda counts: int((counts.astype(object) * (counts.astype(object) - 1) // 2).sum()) if len(counts) else 0
    same = np.unique(a, return_counts=True)[1]
    both = np.unique(np.stack((np.unique(a, return_inverse=True)[1], b)), axis=1, return_counts=True)[1] if n else same
    return score - (pairs(same) - pairs(both))


def _ranges(rows: DataFrame, column: str, cuts: int) -> np.ndarray:
    found = rows.agg(F.percentile_approx(column, [i / cuts for i in range(1, cuts)] or [0.5], 10 * MOST_CUTS)).first()[0]
    return np.array(sorted(set(found or [])), float)


def kendall(df: DataFrame, first: str, second: str) -> tuple[float | None, int]:
    """(tau, number of rows): agreeing less opposing pairs over all pairs, of rows that have both numbers; None for fewer than two rows."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    rows = df.select(number(first).alias("a"), number(second).alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    n = rows.count()
    if n < 2:
        return None, n
    size = min(MOST_CUTS, max(2, -(-n // RANGE_ROWS)))
    ca, cb = _ranges(rows, "a", size), _ranges(rows, "b", size)
    place = lambda cuts: F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), "left") + np.searchsorted(cuts, x.to_numpy(), "right")), "int")
    rows = materialised(rows.withColumns({"ra": place(ca)("a"), "rb": place(cb)("b")}))
    grid = np.zeros((2 * len(ca) + 1, 2 * len(cb) + 1), object)
    for r in rows.groupBy("ra", "rb").count().collect():  # at most (2 MOST_CUTS + 1)^2 rows
        grid[r["ra"], r["rb"]] = r["count"]
    score = 0
    below = np.zeros(grid.shape[1], object)  # rows of smaller ranges of the first column, by range of the second
    for line in grid:
        less = np.concatenate(([0], np.cumsum(below)[:-1]))
        more = below.sum() - np.cumsum(below)
        score += int((line * (less - more)).sum())
        below = below + line

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": [str(agreement(pdf["a"].to_numpy(), pdf["b"].to_numpy()))]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sum(agreement(x["a"].to_numpy(), x["b"].to_numpy()) for _, x in pdf.groupby("ra"))
        return pd.DataFrame({"score": [str(agreement(pdf["a"].to_numpy(), pdf["b"].to_numpy()) - own)]})

    # odd ranges hold one value
    parts = rows.where("ra % 2 = 0").groupBy("ra").applyInPandas(within, "score string").union(rows.where("rb % 2 = 0").groupBy("rb").applyInPandas(between, "score string"))
    score += sum(int(r[0]) for r in parts.collect())  # at most two rows a range
    return score / (n * (n - 1) // 2), n
