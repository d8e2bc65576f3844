"""The lifecycle of postings as a stream: rows of crawls as they arrive, merged crawl by crawl into the stored state.

A row says which run it belongs to (``run``, the run's time, which all boards of a run share), and how many rows its board lists in
that run (``listed``); a board that lists nothing sends one row without an id. Rows of a run may come in any number of micro-batches,
mixed with those of the next one. A board's crawl is merged once all of its rows are there, after all earlier ones of the board: the
result is what the batch merge gives, run after run, however the stream was cut.

A crawl that stays incomplete holds its board's later crawls back no longer than the lateness, counted between runs; then it is passed
over, and so is a crawl whose board has already merged a later one. Every micro-batch writes a folder of its own in each table and a
version of the state, and a marker last: a batch that runs again after a failure writes the same once more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from tidemark.operators.ingest import CONTENT, merge
from tidemark.session import stored

LATENESS = "2 days"


def read_rows(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 100) -> DataFrame:
    """Crawled rows (run, listed, source_id, external_id and CONTENT) from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


def _before(spark: SparkSession, path: str, number: int) -> int | None:
    """The last version of the state that a batch before this one has completed."""
    marks = _table(spark, f"{path}/versions", "version long").where(F.col("version") < number)
    return marks.agg(F.max("version")).first()[0]


def stored_state(spark: SparkSession, path: str, schema: StructType, number: int = 1 << 62) -> DataFrame:
    """The postings as the last completed micro-batch left them."""
    version = _before(spark, path, number)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/state/version={version}")


def ready_crawls(arrived: DataFrame, settled: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """source_id, run, verdict of crawls that are not settled yet: 'merge', 'passed' or 'wait'.

    ``arrived``: run, listed, source_id, external_id of all rows so far; ``settled``: source_id, run, verdict of earlier batches.
    """
    newest = arrived.agg(F.max("run").alias("newest"))  # one row
    crawls = arrived.groupBy("source_id", "run").agg(F.count_distinct("external_id").alias("got"), F.max("listed").alias("listed"))
    last = settled.where("verdict = 'merge'").groupBy("source_id").agg(F.max("run").alias("last"))
    open_ = crawls.join(settled.select("source_id", "run"), ["source_id", "run"], "left_anti").join(last, "source_id", "left").join(F.broadcast(newest))
    late = F.coalesce(F.col("run") < F.col("last"), F.lit(False))
    complete = F.col("got") >= F.col("listed")
    given_up = F.col("newest") - F.expr(f"interval {lateness}") > F.col("run")
    kinds = open_.withColumn("kind", F.when(late, "passed").when(complete, "merge").when(given_up, "passed").otherwise("wait"))
    waiting = kinds.where("kind = 'wait'").groupBy("source_id").agg(F.min("run").alias("first_waiting"))
    held = F.coalesce(F.col("run") > F.col("first_waiting"), F.lit(False))
    return kinds.join(waiting, "source_id", "left").select("source_id", "run", F.when((F.col("kind") == "merge") & held, "wait").otherwise(F.col("kind")).alias("verdict"))


def write_crawls(rows: DataFrame, sources: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS, allowed: tuple[str, ...] = ("NL",)) -> StreamingQuery:
    """Merge all that has arrived into the state below ``path`` (see stored_state). ``sources``: source_id and last_nl_count, which the guard against partial crawls reads."""
    row_schema = rows.schema
    kept = ["source_id", "external_id", *CONTENT]
    state_schema = StructType([*(row_schema[c] for c in kept[:2]), *(StructField(c, TimestampNTZType()) for c in ("first_seen", "last_seen", "closed_at")), *(row_schema[c] for c in CONTENT)])
    settled_schema = f"source_id {row_schema['source_id'].dataType.simpleString()}, run timestamp_ntz, verdict string"

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/arrived")
        arrived = spark.read.schema(StructType([*row_schema.fields])).parquet(f"{path}/arrived")
        settled = _table(spark, f"{path}/settled", settled_schema + ", batch long").where(F.col("batch") < number)
        crawls = stored(ready_crawls(arrived, settled, lateness).where("verdict <> 'wait'"))
        state = stored_state(spark, path, state_schema, number)
        for run in sorted(r["run"] for r in crawls.where("verdict = 'merge'").select("run").distinct().collect()):  # the runs that one batch completes: a few
            ready = crawls.where((F.col("verdict") == "merge") & (F.col("run") == F.lit(str(run)).cast("timestamp_ntz"))).select("source_id", "run")
            snapshot = arrived.join(ready, ["source_id", "run"]).where("external_id is not null").select(*kept).dropDuplicates(["source_id", "external_id"])
            state = stored(merge(state, snapshot, sources, str(run), allowed).select(*(f.name for f in state_schema)))
        state.write.mode("overwrite").parquet(f"{path}/state/version={number}")
        crawls.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/settled")
        spark.range(1).select(F.lit(number).cast("long").alias("version")).write.mode("append").parquet(f"{path}/versions")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
