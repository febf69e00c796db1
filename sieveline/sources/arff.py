"""ARFF: the header on the driver, the data as a distributed scan."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import model
from sieveline.operators import tables

_ATTRIBUTE = re.compile(r"""@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(\{.*\}|\S+.*)$""", re.IGNORECASE)


def parse_header(lines: list[str]) -> tuple[str, dict[str, str]]:
    """(relation, attribute -> type); classes of two binary literals are binary, dates nominal."""
    relation, types = "", {}
    for line in lines:
        line = line.strip()
        low = line.lower()
        if not line or line.startswith("%"):
            continue
        if low.startswith("@data"):
            break
        if low.startswith("@relation"):
            relation = line[9:].strip().strip("'\"")
        elif m := _ATTRIBUTE.match(line):
            name, kind = m[1].strip("'\""), m[2].strip()
            if kind.startswith("{"):
                classes = {x.strip().strip("'\"").lower() for x in kind.strip("{} ").split(",")}
                types[name] = model.BINARY if len(classes) == 2 and classes in ({"0", "1"}, {"true", "false"}) else model.NOMINAL
            else:
                types[name] = model.NUMERIC if kind.lower().split()[0] in ("numeric", "real", "integer") else model.NOMINAL
    return relation, types


def read_arff(spark: SparkSession, path: str, header_lines: int = 10_000) -> DataFrame:
    """Null for ``?``; quotes around values are removed. A folder is one ARFF text in files by name."""
    lines = spark.read.text(path)
    is_data, head = lambda x: x.strip().lower().startswith("@data"), []
    for name in sorted(lines.inputFiles()):  # of several files, the header is in the first by name
        head += [r[0] for r in spark.read.text(unquote(name)).limit(header_lines - len(head)).collect()]
        if len(head) >= header_lines or any(map(is_data, head)):
            break
    _, types = parse_header(head)
    at = next(i for i, x in enumerate(head) if is_data(x))
    skip = {x for x in head[: at + 1]}
    body = lines.where(~F.col("value").isin(*skip) & (F.trim("value") != "") & ~F.trim("value").startswith("%") & ~F.lower(F.trim("value")).startswith("@end"))
    schema = ", ".join(f"c{i} string" for i in range(len(types)))
    row = body.select(F.from_csv("value", schema, {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    cell = lambda i: F.nullif(F.nullif(F.trim(F.regexp_replace(f"r.c{i}", '^"(.*)"$', "$1")), F.lit("?")), F.lit(""))
    return row.select(*(tables.to_type(cell(i), k, model.NOMINAL).alias(a) for i, (a, k) in enumerate(types.items())))
