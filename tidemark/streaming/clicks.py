"""The clickstream as a stream: sessions, hourly counts and daily roll-ups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import clicks

LATENESS = "2 days"


def read_views(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Page views from a folder of Parquet files, event time in ``ts``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_event_time(views: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Repeats of an event id are dropped while its time is within the lateness."""
    return views.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def hourly(views: DataFrame) -> DataFrame:
    """hour, humans, bots: counts of views per tumbling hour."""
    counted = views.where(clicks.is_view()).groupBy(F.window("ts", "1 hour")).agg(F.count_if(~F.col("bot")).alias("humans"), F.count_if("bot").alias("bots"))
    return counted.select(F.col("window.start").alias("hour"), "humans", "bots")


def live_sessions(views: DataFrame, gap_minutes: int = clicks.SESSION_GAP_MINUTES) -> DataFrame:
    """visitor, started, pages. A session window ends a microsecond after the gap, so that a gap of exactly the limit stays within."""
    gap = f"{gap_minutes * 60000000 + 1} microseconds"
    human = views.where(clicks.is_view() & ~F.col("bot"))
    return human.groupBy("visitor", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("pages")).select("visitor", F.col("session_window.start").alias("started"), "pages")


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to Parquet, for all that is there now."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_rollup(views: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store raw views by day, and roll every day that a batch touched up again from all its views: running a batch twice changes nothing."""
    raw = f"{path}/raw"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        dated = rows.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "day": F.to_date("ts"), "batch": F.lit(number)})
        # one folder per day and batch, overwritten as a whole if the batch runs again
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(raw)
        days = dated.agg(F.min("day"), F.max("day")).first()
        if days[0] is None:
            return
        touched = dated.select("day").distinct()
        stored = spark.read.parquet(raw).join(F.broadcast(touched), "day", "left_semi").drop("day", "batch")  # days of one batch: a few
        daily = clicks.rollup(stored, str(days[0]), str(days[1]))
        daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/daily")

    return views.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
