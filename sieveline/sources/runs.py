"""Runs as XML documents: read, create and append; JDBC; seeds and background knowledge; dispatch by extension."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import model
from sieveline.model import Condition, Conditions, Settings, Target


@dataclass
class Run:
    """One experiment: a target, settings, and a table's source with the types of its columns."""

    target: Target
    settings: Settings
    source: str
    columns: dict[str, str] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()


def to_xml(run: Run) -> ET.Element:
    e = ET.Element("experiment")
    t = ET.SubElement(e, "target_concept", type=run.target.type)
    for c in run.target.columns:
        ET.SubElement(t, "target").text = c
    if run.target.value is not None:
        ET.SubElement(t, "target_value", kind=type(run.target.value).__name__).text = str(run.target.value)
    p = ET.SubElement(e, "search_parameters")
    for k, v in asdict(run.settings).items():
        if k != "beam_seed" and v is not None:
            ET.SubElement(p, k).text = str(v)
    table = ET.SubElement(e, "table", source=run.source)
    for name, kind in run.columns.items():
        ET.SubElement(table, "column", name=name, type=kind, enabled=str(name not in run.disabled).lower())
    return e


def from_xml(e: ET.Element) -> Run:
    t, p, table = e.find("target_concept"), e.find("search_parameters"), e.find("table")
    value = t.find("target_value")
    kinds = {"bool": lambda x: x == "True", "str": str, "float": float, "int": int}
    target = Target(t.get("type"), tuple(x.text for x in t.findall("target")), None if value is None else kinds[value.get("kind", "str")](value.text))
    plain = {f.name: f for f in fields(Settings)}
    settings = Settings()
    for x in p:
        if x.tag in plain and x.tag != "beam_seed":
            old = getattr(settings, x.tag)
            setattr(settings, x.tag, x.text == "True" if isinstance(old, bool) else float(x.text) if isinstance(old, float) or old is None else int(x.text) if isinstance(old, int) else x.text or "")
    columns = {c.get("name"): c.get("type") for c in table.findall("column")}
    return Run(target, settings, table.get("source"), columns, tuple(c.get("name") for c in table.findall("column") if c.get("enabled") == "false"))


def write_runs(path: str, runs: list[Run], append: bool = False) -> None:
    root = ET.parse(path).getroot() if append and os.path.exists(path) else ET.Element("autorun", nr_experiments="0")
    root.extend(map(to_xml, runs))
    root.set("nr_experiments", str(len(root)))
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def read_runs(path: str) -> list[Run]:
    return [from_xml(e) for e in ET.parse(path).getroot().findall("experiment")]


def execute_runs(spark: SparkSession, path: str) -> list[DataFrame]:
    """Every run's result, in order; sources are relative to the file."""
    from sieveline.operators.search import discover

    out = []
    for run in read_runs(path):
        source = run.source if "://" in run.source or os.path.isabs(run.source) else os.path.join(os.path.dirname(path), run.source)
        df = open_table(spark, source)
        types = {a: k for a, k in (run.columns or model.attribute_types(df)).items() if a not in run.disabled and a not in run.target.columns}
        out.append(discover(df, run.target, run.settings, types=types))
    return out


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: delimited text, ARFF or Parquet."""
    from sieveline.sources.arff import read_arff
    from sieveline.sources.text import read_text

    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("txt", "text", "csv", "tsv"):
        return read_text(spark, path)
    if kind == "arff":
        return read_arff(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{kind} files")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options) -> DataFrame:
    """A database table or query; with a numeric key and bounds the scan is partitioned."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def create_table_as(name: str, query: str) -> str:
    return f"CREATE TABLE {name} AS {query}"


def _connection(spark: SparkSession, url: str):
    return spark._jvm.java.sql.DriverManager.getConnection(url)


def list_tables(spark: SparkSession, url: str) -> DataFrame:
    """name and type (TABLE or VIEW) of a database's tables and views."""
    connection = _connection(spark, url)
    try:
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        found, rows = connection.getMetaData().getTables(None, None, "%", kinds), []
        while found.next():
            rows.append((found.getString("TABLE_NAME"), found.getString("TABLE_TYPE")))
    finally:
        connection.close()
    return spark.createDataFrame(sorted(rows), "name string, type string")


def run_create_table_as(spark: SparkSession, name: str, query: str, url: str | None = None) -> None:
    """Creates a table from a query: in Spark's catalog, or in a database whose dialect has the statement."""
    if url is None:
        spark.sql(create_table_as(name, query))
        return
    connection = _connection(spark, url)
    try:
        connection.createStatement().execute(create_table_as(name, query))
    finally:
        connection.close()


def select_text(columns: list[str], table: str, where: list[str] = (), group: list[str] = (), order: list[str] = (), descending: bool = False) -> str:
    """A SELECT statement from its parts."""
    text = f"SELECT {', '.join(columns)} FROM {table}"
    text += f" WHERE {' AND '.join(where)}" if where else ""
    text += f" GROUP BY {', '.join(group)}" if group else ""
    return text + (f" ORDER BY {', '.join(order)}{' DESC' if descending else ''}" if order else "")


_CONDITION = re.compile(r"^(.+?) (in|<=|>=|=) (.+)$")


def parse_condition(text: str, types: dict[str, str]) -> Condition:
    """A condition in the form of result lists."""
    m = _CONDITION.match(text.strip())
    if not m:
        raise ValueError(f"not a condition: {text}")
    name, op, value = m.groups()
    kind = types.get(name, model.NOMINAL)
    if op == "in" and not value.startswith("{"):
        op = model.BETWEEN
    if op not in model.VALID[kind]:
        raise ValueError(f"{op} does not suit a {kind} attribute: {text}")
    if op == model.ELEMENT_OF:
        return Condition(name, op, frozenset(value.strip("{}").split(",")))
    if op == model.BETWEEN:
        lo, hi = value.strip("()[] ").split(",")
        return Condition(name, op, (float(lo), float(hi)))
    value = value.strip("'")
    return Condition(name, op, float(value) if kind == model.NUMERIC else value in ("1", "true") if kind == model.BINARY else value)


def parse_description(text: str, types: dict[str, str]) -> Conditions:
    return tuple(parse_condition(x, types) for x in text.split(" AND ") if x.strip())


def read_knowledge(spark: SparkSession, path: str, types: dict[str, str]) -> list[Conditions]:
    """Descriptions, one a line (global and local background knowledge)."""
    return [parse_description(r[0], types) for r in spark.read.text(path).collect() if r[0].strip()]


def read_beam_seed(spark: SparkSession, path: str, types: dict[str, str]) -> list[Conditions]:
    """Lines of ``A=x B=y``."""
    out = []
    for (line,) in spark.read.text(path).collect():
        own = []
        for part in line.split():
            name, _, value = part.partition("=")
            kind = types.get(name, model.NOMINAL)
            own.append(Condition(name, model.EQUALS, float(value) if kind == model.NUMERIC else value in ("1", "true") if kind == model.BINARY else value))
        if own:
            out.append(tuple(own))
    return out


def read_concept_list(spark: SparkSession, path: str) -> DataFrame:
    """(concept): the values of a concept list, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("concept")).where("concept <> ''")


def write_concept_list(df: DataFrame, path: str) -> None:
    """The first column's values, one a line."""
    df.select(F.col(df.columns[0]).cast("string")).write.text(path)
