"""Additive sufficient statistics of every target type, and what results are made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import measures
from sieveline.model import Target

#: Mid-ranks of an ordinal target; probabilities of a nominal one.
RANK, PROPENSITY = "__rank", "__propensity"


@dataclass
class Statistics:
    """parts: name -> value of a row, to be summed; whole: name -> number for all rows; texts: expressions of a result.

    whole_of: these numbers by candidate (cand), where candidates are of runs over different rows.
    """

    parts: dict[str, Column]
    whole: dict[str, float]
    count: str
    secondary: str
    tertiary: str
    measures: dict[str, measures.Measure]
    whole_of: DataFrame | None = None


def positive(target: Target) -> Column:
    c = F.col(f"`{target.columns[0]}`")
    return F.coalesce(c == F.lit(target.value) if target.value is not None else c, F.lit(False))


def ranks_of(text: Column, labels: list[str]) -> list[Column]:
    """Place of each label in a ranking such as a>b>c (0 first)."""
    return [F.size(F.split(F.substring_index(text, x, 1), ">")) - 1 for x in labels]


def statistics(df: DataFrame, target: Target) -> Statistics:
    """One pass over the data for the numbers of the whole table."""
    one = F.lit(1.0)
    kind = target.type
    cols = [F.col(f"`{c}`") for c in target.columns]
    if kind == "single_nominal":
        parts = {"B": one, "HB": positive(target).cast("double")}
        known = measures.NOMINAL
        if PROPENSITY in df.columns:
            parts, known = parts | {"ps": F.col(PROPENSITY)}, known | measures.PROPENSITY
        n, h = df.agg(F.count(F.lit(1)), F.sum(parts["HB"])).first()
        return Statistics(parts, {"N": float(n), "H": float(h or 0)}, "B", "HB / B", "HB", known)
    if kind == "single_numeric":
        y = cols[0].cast("double")
        n, mu, sigma = df.agg(F.count(y), F.avg(y), F.stddev_pop(y)).first()
        d = y - F.lit(mu or 0.0)
        parts = {"c0": y.isNotNull().cast("double"), "S1": F.coalesce(d, F.lit(0.0)), "S2": F.coalesce(d * d, F.lit(0.0))}
        whole = {"N": float(n), "mu": mu or 0.0, "sigma": sigma or 0.0, "S2_all": (sigma or 0.0) ** 2 * n}
        return Statistics(parts, whole, "c0", "S1 / c0 + mu", "sqrt(greatest((S2 - S1 * S1 / c0) / nullif(c0 - 1, 0), 0))", measures.NUMERIC)
    if kind == "single_ordinal":  # the table has RANK, see tables.with_mid_rank
        r = F.col(RANK)
        parts = {"B": r.isNotNull().cast("double"), "S1": F.coalesce(r, F.lit(0.0))}
        return Statistics(parts, {"N": float(df.where(r.isNotNull()).count())}, "B", "S1 / B", "S1", measures.ORDINAL)
    if kind in ("double_correlation", "double_regression"):
        first, second = (c.cast("double") for c in cols)
        x, y = (second, first) if kind == "double_correlation" else (first, second)
        ok = x.isNotNull() & y.isNotNull()
        values = {"c0": one, "Sx": x, "Sy": y, "Sxy": x * y, "Sxx": x * x, "Syy": y * y}
        parts = {k: F.when(ok, v).otherwise(0.0) for k, v in values.items()}
        row = df.agg(*(F.sum(v).alias(k) for k, v in parts.items())).first().asDict()
        whole = {"N": row["c0"]} | {k + "_b": v for k, v in row.items()}
        if kind == "double_correlation":
            r = measures.CORRELATION["correlation_r"].expression
            return Statistics(parts, whole, "c0", r, f"abs({measures._complement(r)} - {r})", measures.CORRELATION)
        return Statistics(parts, whole, "c0", measures._SLOPE, measures._ICEPT, measures.REGRESSION)
    if kind == "double_binary":
        a, t = (F.coalesce(c, F.lit(False)).cast("double") for c in cols)
        parts = {"c0": one, "nA": a, "nB": 1 - a, "tA": a * t, "tB": (1 - a) * t}
        row = df.agg(*(F.sum(v).alias(k) for k, v in parts.items())).first().asDict()
        return Statistics(parts, {"N": row["c0"]} | {k + "_b": v for k, v in row.items()}, "c0", "sign((tA / nullif(nA, 0) - tA_b / nullif(nA_b, 0)) / nullif(tA_b / nullif(nA_b, 0), 0))", "tA / nullif(nA, 0)", measures.DOUBLE_BINARY)
    if kind == "label_ranking":
        labels = [x.strip() for x in (df.select(F.first(cols[0], True)).first()[0] or "").split(">")]
        labels = sorted(labels)
        place = ranks_of(cols[0], labels)
        pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
        parts = {"B": one} | {f"P_{i}_{j}": F.signum((place[j] - place[i]).cast("double")) for i, j in pairs}
        row = df.agg(*(F.sum(v).alias(k) for k, v in parts.items())).first().asDict()
        whole = {"N": row["B"]} | {f"m_{i}_{j}": row[f"P_{i}_{j}"] / row["B"] for i, j in pairs}
        found = {k: measures.Measure(m.name, _mean_preferences(m.expression), m.minimum) for k, m in measures.ranking(len(labels)).items()}
        return Statistics(parts, whole, "B", "B", "N - B", found)
    raise ValueError(f"{kind} has no additive statistics; see functions.kernels")


def _mean_preferences(text: str) -> str:
    import re

    return re.sub(r"\bs_(\d+)_(\d+)\b", r"(P_\1_\2 / B)", text)
