"""Subgroup statistics over an unbounded table: the sums of a nominal target fold over micro-batches.

Works on a streaming table and on a bounded one alike: one aggregate by time
window holds the sums of all subgroups, so that state is a row a window; late
rows are taken until the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import model
from sieveline.functions import measures
from sieveline.model import Conditions, Target
from sieveline.operators.refine import quality_of
from sieveline.operators.stats import positive


def windowed_qualities(rows: DataFrame, time: str, width: str, watermark: str, subgroups: list[Conditions], target: Target, measure: str = "wracc") -> DataFrame:
    """(start, subgroup, N, H, B, HB, quality) of every description in every window of time."""
    hit = positive(target)
    sums = [F.struct(F.lit(i).alias("subgroup"), F.count_if(model.conjunction(c)).cast("double").alias("B"), F.count_if(model.conjunction(c) & hit).cast("double").alias("HB")) for i, c in enumerate(subgroups)]
    windows = rows.withWatermark(time, watermark).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("N"), F.count_if(hit).cast("double").alias("H"), F.array(*sums).alias("x"))
    flat = windows.select(F.col("w.start").alias("start"), "N", "H", F.explode("x").alias("x")).select("start", "x.subgroup", "N", "H", "x.B", "x.HB")
    return flat.withColumn("quality", F.when(F.col("B") > 0, quality_of(measures.NOMINAL[measure])))
