"""Delimited text: delimiter detection, quotes, missing fields and type inference in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import model
from sieveline.operators import tables

#: The delimiters tried, in order.
DELIMITERS = ("\t", ",", ";")


def split_fields(line: str, delimiter: str) -> list[str]:
    """Fields of a line; quotes of either kind protect delimiters and are removed."""
    out, field, quote = [], "", ""
    for c in line:
        if quote:
            if c == quote:
                quote = ""
            else:
                field += c
        elif c in "\"'" and not field.strip():
            quote, field = c, ""
        elif c == delimiter:
            out.append(field.strip())
            field = ""
        else:
            field += c
    return [*out, field.strip()]


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that splits the first two lines into equally many fields, most of them."""
    counts = {d: [len(split_fields(x, d)) for x in lines] for d in DELIMITERS}
    good = [d for d in DELIMITERS if len(set(counts[d])) == 1 and counts[d][0] > 1]
    return max(good, key=lambda d: counts[d][0]) if good else ","


def typed(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Texts cast to the narrowest type that fits all their values: binary, numeric, nominal. Blanks are missing."""
    blank = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns}
    df = df.select(*(v.alias(c) for c, v in blank.items()))
    flags = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        flags += [F.bool_and(F.lower(x).isin(*tables.TRUE, *tables.FALSE)).alias(f"b{i}"), F.bool_and(F.when(x.isNotNull(), x.try_cast("double").isNotNull())).alias(f"n{i}")]
    row = df.agg(*flags).first()
    kinds = {c: model.BINARY if row[2 * i] else model.NUMERIC if row[2 * i + 1] else model.NOMINAL for i, c in enumerate(df.columns)}
    if declared:
        wrong = {c: (k, kinds.get(c)) for c, k in declared.items() if kinds.get(c) != k and not (k == model.NOMINAL)}
        if wrong:
            raise ValueError(f"columns do not hold their declared types: {wrong}")
        kinds |= declared
    return df.select(*(tables.to_type(F.col(f"`{c}`"), k, model.NOMINAL).alias(c) for c, k in kinds.items()))


def read_text(spark: SparkSession, path: str, declared: dict[str, str] | None = None) -> DataFrame:
    lines = spark.read.text(path)
    head = [r[0] for r in lines.where(F.trim("value") != "").limit(2).collect()]
    d = delimiter_of(head)
    names = split_fields(head[0], d)
    quoted = "'" in head[-1] and '"' not in head[-1]
    df = spark.read.csv(path, sep=d, header=True, quote="'" if quoted else '"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False, mode="PERMISSIVE").toDF(*names)
    other = '"' if quoted else "'"
    df = df.select(*(F.regexp_replace(F.col(f"`{c}`"), f"^{other}(.*){other}$", "$1").alias(c) for c in names))
    return typed(df, declared)


def write_text(df: DataFrame, path: str, members=None) -> None:
    """A table, or its member rows, as CSV with a header; binaries as 1 and 0."""
    df = df if members is None else df.where(members)
    binary = [a for a, t in model.attribute_types(df).items() if t == model.BINARY]
    df.withColumns({c: F.col(c).cast("int") for c in binary}).write.csv(path, header=True) if binary else df.write.csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    """A result list (bounded) as one tab-separated file."""
    results.coalesce(1).write.csv(path, sep="\t", header=True)
