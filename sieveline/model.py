"""Conditions, targets, search settings and results."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, NOMINAL, BINARY = "numeric", "nominal", "binary"
#: Operators in canonical order; BETWEEN is open below and closed above.
ELEMENT_OF, EQUALS, AT_MOST, AT_LEAST, BETWEEN = "in", "=", "<=", ">=", "between"
OPERATOR_ORDER = {ELEMENT_OF: 0, EQUALS: 1, AT_MOST: 2, AT_LEAST: 3, BETWEEN: 4}
#: Which operators suit which attribute type.
VALID = {NUMERIC: {EQUALS, AT_MOST, AT_LEAST, BETWEEN}, NOMINAL: {EQUALS, ELEMENT_OF}, BINARY: {EQUALS}}
#: Numeric operator settings.
SETTINGS = {"normal": (AT_MOST, AT_LEAST), "leq": (AT_MOST,), "geq": (AT_LEAST,), "all": (AT_MOST, AT_LEAST, EQUALS), "eq": (EQUALS,), "intervals": (BETWEEN,)}


def number_text(v: float) -> str:
    """A float as text: shortest 32-bit form, always with a fraction; beyond 1e7 or below 1e-3 with an exponent."""
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    x = np.float32(v)
    if x != 0 and not 1e-3 <= abs(x) < 1e7:
        digits, exponent = np.format_float_scientific(x, trim="0").split("e")
        return f"{digits}E{int(exponent)}"
    return np.format_float_positional(x, unique=True, trim="0")


@dataclass(frozen=True)
class Condition:
    attribute: str
    operator: str
    value: object

    def expression(self) -> Column:
        c, v = F.col(f"`{self.attribute}`"), self.value
        if self.operator == AT_MOST:
            e = c <= F.lit(v)
        elif self.operator == AT_LEAST:
            e = c >= F.lit(v)
        elif self.operator == BETWEEN:
            lo, hi = v
            e = reduce(lambda a, b: a & b, [*([c > F.lit(lo)] if not math.isinf(lo) else []), *([c <= F.lit(hi)] if not math.isinf(hi) else [])], c.isNotNull())
        elif self.operator == ELEMENT_OF:
            e = F.coalesce(c, F.lit("?")).isin(*sorted(v))
        elif isinstance(v, bool):
            e = F.coalesce(c, F.lit(False)) == F.lit(v)
        else:
            e = c == F.lit(v)
        return F.coalesce(e, F.lit(False))

    def __str__(self) -> str:
        v = self.value
        if self.operator == BETWEEN:
            lo, hi = v
            return f"{self.attribute} in ({'-inf' if math.isinf(lo) else number_text(lo)}, {'inf)' if math.isinf(hi) else number_text(hi) + ']'}"
        if self.operator == ELEMENT_OF:
            return f"{self.attribute} in {{{','.join(sorted(v))}}}"
        if isinstance(v, bool):
            return f"{self.attribute} = '{int(v)}'"
        if isinstance(v, str):
            return f"{self.attribute} = '{v}'"
        return f"{self.attribute} {self.operator} {number_text(v)}"

    def key(self, order: dict[str, int]) -> tuple:
        v = self.value
        rank = (v,) if isinstance(v, (str, bool)) else tuple(sorted(v)) if isinstance(v, frozenset) else v if isinstance(v, tuple) else (float(v),)
        return order.get(self.attribute, 1 << 30), OPERATOR_ORDER[self.operator], tuple(map(str, rank)) if isinstance(v, (str, frozenset)) else rank

    def implies(self, other: "Condition") -> bool:
        """Whether every row of this is a row of the other, by form."""
        if self.attribute != other.attribute:
            return False
        if self == other:
            return True
        lo, hi = self.bounds()
        olo, ohi = other.bounds()
        if lo is not None and olo is not None:
            if other.operator == EQUALS:
                return False
            low = lo > olo or (lo == olo and (other.operator != BETWEEN or self.operator == BETWEEN))
            if self.operator == EQUALS and other.operator == BETWEEN:
                low = lo > olo
            return low and hi <= ohi
        mine = {self.value} if isinstance(self.value, str) else self.value
        return other.operator == ELEMENT_OF and isinstance(mine, (set, frozenset)) and mine <= other.value

    def bounds(self) -> tuple:
        v = self.value
        if isinstance(v, (str, bool, frozenset)):
            return None, None
        return {AT_MOST: (-math.inf, v), AT_LEAST: (v, math.inf), EQUALS: (v, v)}.get(self.operator) or v


Conditions = tuple[Condition, ...]


def conjunction(conditions: Conditions) -> Column:
    """All conditions; an empty list holds everywhere."""
    return reduce(lambda a, b: a & b, (c.expression() for c in conditions), F.lit(True))


def text_of(conditions: Conditions) -> str:
    return " AND ".join(map(str, conditions))


def canonical(conditions: Conditions, order: dict[str, int]) -> Conditions:
    """Sorted by attribute, operator and value, without conditions that another one implies."""
    kept = [c for i, c in enumerate(conditions) if not any(d.implies(c) and (not c.implies(d) or j < i) for j, d in enumerate(conditions) if j != i)]
    return tuple(sorted(kept, key=lambda c: c.key(order)))


def specialises(a: Conditions, b: Conditions) -> bool:
    """Whether description a is strictly narrower than b, by form, at any depth."""
    return set(a) != set(b) and all(any(c.implies(d) for c in a) for d in b) and not all(any(d.implies(c) for d in b) for c in a)


@dataclass(frozen=True)
class Target:
    """type: a key of measures.BY_TARGET, multi_numeric, multi_label or label_ranking."""

    type: str
    columns: tuple[str, ...]
    value: str | bool | None = None


@dataclass
class Settings:
    measure: str = "wracc"
    minimum: float | None = None
    depth: int = 1
    min_coverage: int = 2
    max_coverage_share: float = 1.0
    #: Rows that a result may cover at most, whatever their share (0: no bound).
    max_coverage: int = 0
    min_support: int = 0
    max_results: int = 0
    strategy: str = "beam"
    width: int = 100
    numeric_strategy: str = "best"
    numeric_operators: str = "normal"
    bins: int = 8
    nominal_sets: bool = False
    max_minutes: float = 0
    min_improvement: float = 0.0
    beam_seed: list[Conditions] = field(default_factory=list)
    alpha: float = 0.9
    seed: int = 10
    #: "gaussian" or "empirical": p-values of results from this many randomised qualities of a kind ("swap", "subsets", "descriptions").
    p_values: str = ""
    randomised: str = "swap"
    repeats: int = 100
    #: Descriptions are ranked by qualities rounded to this many digits (None: exact ones): of those that agree the one that covers more comes first.
    digits: int | None = None

    def rank(self, quality: float) -> float:
        """The quality that counts for a rank, rounded as Spark rounds."""
        if self.digits is None or not math.isfinite(quality):
            return quality
        return float(Decimal(repr(float(quality))).quantize(Decimal(1).scaleb(-self.digits), ROUND_HALF_UP)) + 0.0


def attribute_types(df: DataFrame, leave_out: tuple[str, ...] = ()) -> dict[str, str]:
    """Type of each describing column; dates and times are nominal only after a cast to string, and are left out."""
    out = {}
    for f in df.schema.fields:
        if f.name in leave_out:
            continue
        if isinstance(f.dataType, T.BooleanType):
            out[f.name] = BINARY
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = NUMERIC
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = NOMINAL
    return out


RESULT_SCHEMA = "nr int, depth int, coverage bigint, quality double, secondary double, tertiary double, p_value double, conditions string"
