"""One query for each quality measure: all half-intervals of a table's numeric attributes, scored, with the same scan in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import kernels, measures
from sieveline.model import Settings, Target
from sieveline.operators import refine
from sieveline.operators.stats import statistics

ATTRIBUTES = ("l_quantity", "l_discount", "l_tax")
DIGITS = 5


def scan(df: DataFrame, target: Target, attributes: tuple[str, ...], measure: str, settings: Settings | None = None) -> DataFrame:
    """attr, op, v, coverage, quality, secondary, tertiary of every refinement of the whole table."""
    df = df.select(*dict.fromkeys([*attributes, *target.columns]))
    stats = statistics(df, target)
    settings = settings or Settings()
    settings.measure = measure
    settings.numeric_strategy = settings.numeric_strategy if "bins" in settings.numeric_strategy or settings.numeric_strategy in ("intervals", "consecutive_all") else "all"
    types = {a: k for a, k in model.attribute_types(df).items() if a in attributes}
    rows = refine.level(df, [()], types, stats, settings)
    r = lambda c: (F.round(c, DIGITS) + 0.0).alias(c)
    return rows.select("attr", "op", "v", "lo", "hi", "s", "set", "coverage", r("quality"), r("secondary"), r("tertiary"))


def _numeric(rows: DataFrame) -> DataFrame:
    return rows.select("attr", "op", "v", "coverage", "quality", "secondary", "tertiary")


def scan_sql(source: str, parts: dict[str, str], whole: str, count: str, expression: str, secondary: str, tertiary: str, attributes: tuple[str, ...]) -> str:
    """The same in SQL: source with the parts' columns, whole-table numbers from a select."""
    p = list(parts)
    cells = " union all ".join(f"select '{a}' as attr, {a}::double as v, {', '.join(f'({e})::double as {k}' for k, e in parts.items())} from src, w" for a in attributes)
    run = lambda d: ", ".join(f"sum({k}) over (partition by attr order by v {d} rows unbounded preceding) as {k}" for k in p)
    q = lambda e, n: f"round(({e})::double, {DIGITS}) + 0.0 as {n}"
    return f"""with src as ({source}), w as ({whole}), u as ({cells}),
g as (select attr, v, {', '.join(f'sum({k}) as {k}' for k in p)} from u where v is not null group by attr, v),
s as (select attr, '<=' as op, v, {run('')} from g union all select attr, '>=', v, {run('desc')} from g)
select attr, op, v, {count}::bigint as coverage, {q(expression, 'quality')}, {q(secondary, 'secondary')}, {q(tertiary, 'tertiary')} from s, w where {count} > 0"""


NOMINAL_TARGET = Target("single_nominal", ("l_returnflag",), "R")
NUMERIC_TARGET = Target("single_numeric", ("l_quantity",))
PAIR = ("l_quantity", "l_discount")


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _double_binary(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    documents = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "lang")
    return documents.join(labels, "doc_id").select(F.col("n_chars").cast("double").alias("n_chars"), "lang", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))


def ranked(df: DataFrame) -> DataFrame:
    """A ranking a>b>c of three scaled numbers, ties by letter."""
    cells = F.array(*(F.struct((-v).alias("k"), F.lit(n).alias("n")) for n, v in (("a", F.col("l_quantity") / 50), ("b", F.col("l_discount") * 10), ("c", F.col("l_tax") * 12.5))))
    return df.withColumn("ranking", F.array_join(F.transform(F.array_sort(cells), lambda x: x["n"]), ">"))


_SRC = "select *, (l_returnflag = 'R')::int as t from lineitem"
_N_PARTS = {"B": "1", "HB": "t"}
_N_WHOLE = "select count(*)::double as N, sum(t)::double as H from src"
_U_PARTS = {"c0": "1", "S1": "l_quantity - mu", "S2": "(l_quantity - mu) * (l_quantity - mu)"}
_U_WHOLE = "select count(l_quantity)::double as N, avg(l_quantity) as mu, stddev_pop(l_quantity) as sigma, var_pop(l_quantity) * count(l_quantity) as S2_all from src"
_SUMS = {"c0": "1", "Sx": "x", "Sy": "y", "Sxy": "x * y", "Sxx": "x * x", "Syy": "y * y"}
_SUM_WHOLE = "select count(*)::double as N, " + ", ".join(f"sum({e})::double as {k}_b" for k, e in _SUMS.items()) + " from src"
_BIN = {"c0": "1", "nA": "a", "nB": "1 - a", "tA": "a * t", "tB": "(1 - a) * t"}
_BIN_WHOLE = "select count(*)::double as N, " + ", ".join(f"sum({e})::double as {k}_b" for k, e in _BIN.items()) + " from src"
_RANK_SRC = "select l_tax, l_quantity, l_discount, (select string_agg(n, '>' order by k, n) from (values (-l_quantity / 50, 'a'), (-l_discount * 10, 'b'), (-l_tax * 12.5, 'c')) as z(k, n)) as ranking from lineitem"
_PLACE = {i: f"position('{x}' in ranking)" for i, x in enumerate("abc")}
_PAIRS = [(0, 1), (0, 2), (1, 2)]
_RANK = {"B": "1"} | {f"P_{i}_{j}": f"sign({_PLACE[j]} - {_PLACE[i]})" for i, j in _PAIRS}
_RANK_WHOLE = "select count(*)::double as N, " + ", ".join(f"avg({_RANK[f'P_{i}_{j}']})::double as m_{i}_{j}" for i, j in _PAIRS) + " from src"

def _bayes_sql() -> str:
    """The Bayesian score of every half-interval."""
    inner = scan_sql(_SRC, _N_PARTS, _N_WHOLE, "B", "0.0", "HB / B", "HB", ATTRIBUTES)
    sums = "select r.*, tertiary + 1 as c, coverage - tertiary + 1 as d, H - tertiary + 1 as a, N - H - coverage + tertiary + 1 as b, N, H from rows_ r, (select count(*)::double as N, count(*) filter (l_returnflag = 'R')::double as H from lineitem)"
    tail = lambda x: f"lgamma({x[2]} + k) + lgamma({x[3]} + {x[1]}) - lgamma({x[2]} + k + {x[3]} + {x[1]}) - ln({x[1]} + k) - lgamma(1.0 + k) - lgamma({x[1]}) + lgamma(1.0 + k + {x[1]}) - lgamma({x[2]}) - lgamma({x[3]}) + lgamma({x[2]} + {x[3]})"
    side = lambda n, x: f"{n}0 as (select attr, op, v, {tail(x)} as t from (select *, unnest(range({x[0]}::bigint))::double as k from z)), {n}1 as (select attr, op, v, max(t) as m from {n}0 group by all), {n} as (select attr, op, v, any_value(m) + ln(sum(exp(t - m))) as {n} from {n}0 join {n}1 using (attr, op, v) group by all)"
    beta = lambda p, q: f"(lgamma({p}) + lgamma({q}) - lgamma({p} + {q}))"
    whole = f"({beta('c', 'd')} + {beta('a', 'b')} + ln(2.0))"
    e, up, low = (f"ln({x})" for x in kernels.PRIORS)
    x, y = f"({e} + {beta('c + a - 1', 'd + b - 1')})", f"({low} + {whole} + lo)"
    score = f"{up} + {whole} + hi - (greatest({x}, {y}) + ln(1 + exp(-abs({x} - {y}))))"
    return f"with rows_ as ({inner}), z as ({sums}), {side('hi', 'cdab')}, {side('lo', 'abcd')} select attr, op, v, coverage, round({score}, {DIGITS}) + 0.0 as quality, secondary, tertiary from z join hi using (attr, op, v) join lo using (attr, op, v)"


def _erf_sql(x: str) -> str:
    """The error function of a number from 0, as a sum of positive terms."""
    return f"list_sum(list_transform(range(200), lambda n: exp((2 * n + 1) * ln(greatest({x}, 1e-300)) - lgamma(n + 1.5) - {x} * {x})))"


_IDS = {
    "QN": list(measures.NOMINAL), "QU": list(measures.NUMERIC), "QR": list(measures.REGRESSION), "QB": list(measures.DOUBLE_BINARY), "QK": list(measures.ranking(3)),
    "QC": ["correlation_r", "correlation_r_neg", "correlation_r_neg_sq", "correlation_r_sq", "correlation_distance", "correlation_p", "correlation_entropy", "adapted_wracc", "costs_wracc", "cwtpd", "tmcc", "mcc", "pdc", "mvpdc"],
}


def _entries() -> tuple[dict, dict]:
    queries, sql = {}, {}

    def add(key: str, measure: str, table, target: Target, attributes: tuple[str, ...], parts: dict, source: str, whole: str, count: str, known: dict, secondary: str, tertiary: str) -> None:
        queries[key] = lambda spark, d: _numeric(scan(table(spark, d), target, attributes, measure))
        e = known[measure].expression
        if known[measure].call == "greater_tail":
            e = f"coalesce(0.5 * (1 + {_erf_sql(f'(abs({e}) / sqrt(2.0))')}), 0.0)"
        sql[key] = _bayes_sql() if measure == "bayesian_score" else scan_sql(source, parts, whole, count, e, secondary, tertiary, attributes)

    for prefix, names in _IDS.items():
        for i, m in enumerate(names, 1):
            key = f"{prefix}-{i:02d}_{m}".replace("-", "")
            if prefix == "QN":
                add(key, m, _lineitem, NOMINAL_TARGET, ATTRIBUTES, _N_PARTS, _SRC, _N_WHOLE, "B", measures.NOMINAL, "HB / B", "HB")
            elif prefix == "QU":
                add(key, m, _lineitem, NUMERIC_TARGET, ("l_discount", "l_tax"), _U_PARTS, "select * from lineitem", _U_WHOLE, "c0", measures.NUMERIC, "S1 / c0 + mu", "sqrt(greatest((S2 - S1 * S1 / c0) / nullif(c0 - 1, 0), 0))")
            elif prefix == "QC":
                r = measures.CORRELATION["correlation_r"].expression
                add(key, m, _lineitem, Target("double_correlation", PAIR), ("l_tax",), _SUMS, "select l_tax, l_discount as x, l_quantity as y from lineitem", _SUM_WHOLE, "c0", measures.CORRELATION, r, f"abs({measures._complement(r)} - {r})")
            elif prefix == "QR":
                add(key, m, _lineitem, Target("double_regression", PAIR), ("l_tax",), _SUMS, "select l_tax, l_quantity as x, l_discount as y from lineitem", _SUM_WHOLE, "c0", measures.REGRESSION, measures._SLOPE, measures._ICEPT)
            elif prefix == "QB":
                add(key, m, _double_binary, Target("double_binary", ("quality", "toxic")), ("n_chars",), _BIN, "select n_chars, (quality = 1)::int as a, (toxic = 1)::int as t from documents join labels using (doc_id)", _BIN_WHOLE, "c0", measures.DOUBLE_BINARY,
                    "sign((tA / nullif(nA, 0) - tA_b / nullif(nA_b, 0)) / nullif(tA_b / nullif(nA_b, 0), 0))", "tA / nullif(nA, 0)")
            else:
                from sieveline.operators.stats import _mean_preferences

                known = {k: measures.Measure(k, _mean_preferences(v.expression), 0) for k, v in measures.ranking(3).items()}
                add(key, m, lambda spark, d: ranked(_lineitem(spark, d)), Target("label_ranking", ("ranking",)), ("l_quantity", "l_discount"), _RANK, _RANK_SRC, _RANK_WHOLE, "B", known, "B", "N - B")
    return queries, sql


QUERIES, ORACLE_SQL = _entries()
