"""Queries that run as streams over the events table until all of it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenyard.plans.registry import register
from lumenyard.sources.tables import shared_folder, table
from lumenyard.streaming import limits


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stream over the table's file or folder; Spark's source takes a folder and a pattern."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parque[t]")


def _drained(rows: DataFrame) -> DataFrame:
    """What an append stream gives until its source is read, as a table in the shared folder."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = rows.schema
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


OVERALL = limits.Limits(overall=20)  # few enough for the sample's events to meet it


@register("st03_limited")
def st03(spark, sf):
    """Events as requests: at most five an hour of each user are let through. What is let through depends on
    what was before, so SQL has no form for it; tests hold it against a plain loop."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return limits.limited(rows, "user_id", "ts")


@register("st03_limited_stream")
def st03_stream(spark, sf):
    return _drained(limits.limited_stream(_stream(spark, sf, "events").select("user_id", "ts"), "user_id", "ts"))


@register("st03_limited_overall")
def st03_overall(spark, sf):
    """The same with a limit for all users together, so that one user's requests may cost another its place."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id")
    return limits.limited_overall(rows, "user_id", "ts", OVERALL)


@register("st03_limited_overall_stream")
def st03_overall_stream(spark, sf):
    rows = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts")
    return _drained(limits.limited_overall_stream(rows, "user_id", "ts", OVERALL))


EDGES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]


@register("st07_lifecycle_stream")
def st07(spark, sf):
    """Each user's events as a history: an event that may not follow leaves the state as it was."""
    rows = _stream(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    rows = rows.select("user_id", "event_type", (F.unix_micros(F.col("at.ts").cast("timestamp"))).alias("seq"))
    return _drained(limits.lifecycle_stream(rows, "user_id", "event_type", EDGES, start="signup"))


@register("st09_merge_stream", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1, 2")
def st09(spark, sf):
    """An index of users and event kinds, merged batch by batch."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("seen_at"), "value")
    last = {"epoch": 0}
    merge = limits.merge_into(f"{folder}/index", ["user_id", "event_type"])

    def run(batch: DataFrame, epoch: int) -> None:
        merge(batch, epoch)
        last["epoch"] = epoch

    rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/index/v{last['epoch']}").select("user_id", "event_type", "first_seen", "last_seen", "times_seen")


@register("st04_tumbling_stream", "SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def st04(spark, sf):
    """Hourly counts with a watermark (an addition of this engine): the state of past hours is dropped."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    counts = rows.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    table_dir = f"{folder}/counts"

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/e{epoch}")

    counts.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{table_dir}/e*")
    return found.groupBy("start").agg(F.max("n").alias("n"))
