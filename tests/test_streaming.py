"""A stream gives what the same rows give as a table."""

from pyspark.sql import functions as F

from sieveline.model import Condition, Target
from sieveline.streaming.windows import windowed_qualities

SUBGROUPS = [(Condition("event_type", "=", "click"),), (Condition("value", "<=", 50.0),)]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", (F.col("user_id") % 3 == 0).alias("hit"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda rows: windowed_qualities(rows, "ts", "1 day", "30 days", SUBGROUPS, Target("single_nominal", ("hit",)))
    stream = run(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    # an updated window comes again with its larger sums
    last = spark.table("windows").groupBy("start", "subgroup").agg(F.max_by(F.struct("N", "H", "B", "HB", "quality"), "N").alias("x")).select("start", "subgroup", "x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, run(events).collect())) and last.count() > 2
