"""Exact deduplication against a persistent digest index.

A text's digest is the SHA-256 of its UTF-8 bytes after ASCII white space is deleted. The index is a
table bucketed and sorted by digest, and the number of its buckets is stored beside it. A new batch is
reduced to one representative per digest; a sort-merge anti-join, without a shuffle of the index, drops
the digests that the index holds, and the rest is appended.

A batch that fails half-way can be offered again under its id: what the index holds of that very batch
does not count against it, and what it holds of batches that never came to their end counts against none.
A batch ends with a marker, written last.

Only digests travel: a hot digest is pre-aggregated before the shuffle, and the join that hands each
row its representative has one row per digest on its other side, so Spark can split it. A batch goes
into the index in two halves of the digests, so a batch of any size meets an index of its own kind.

Rows are told apart by the file and the position that they were read from; documents that do not come
straight from files are stored once, with a number for each row.

Edge cases: a null text counts as empty; empty texts are equal to each other; of rows that repeat a
doc_id and a text one stays; a null doc_id loses every tie; an empty table gives an empty result;
columns other than the two named ones are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import FREED_SHUFFLES, ROW, settings, shared_dir, told_apart, written

WHITE_SPACE = " \t\n\x0b\x0c\r"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, digest, n_code_points and what tells each row from others; to be stored once where rows have no place of origin."""
    row = F.col(row_col) if row_col else F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        digest_of(F.col(text_col)).alias("digest"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n_code_points"),
        row.alias("row"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original text, then the smallest doc_id, then the first row."""
    best = F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    found = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return found.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


class DigestIndex:
    """A table (digest, keep_id, keep_row, group_size, attempt), bucketed and sorted by digest, in a folder that outlives the session.

    ``buckets`` fixes the layout of a new index, 16 unless given; choose it so that a bucket of the full index fits a task.
    An index found at ``path`` keeps its own number, and another one given is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, table: str | None = None):
        self.spark, self.path, self.table = spark, path, table or f"digests_{uuid.uuid4().hex}"
        layout = f"{path}/_layout"  # readers of the table pass over names with an underscore
        try:
            self.buckets = spark.read.schema("buckets int").json(layout).first()["buckets"]
        except AnalysisException:
            self.buckets = buckets or 16
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(layout)
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index has {self.buckets} buckets, not {buckets}")
        if not spark.catalog.tableExists(self.table):
            columns = "digest binary, keep_id long, keep_row struct<file: string, at: long>, group_size long, attempt string"
            spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ended(self) -> DataFrame:
        """batch, attempt: of each batch that came to its end the last attempt that did."""
        try:
            marks = self.spark.read.schema("batch string, attempt string, at timestamp").json(f"{self.path}/_ended")
        except AnalysisException:  # none yet
            marks = self.spark.createDataFrame([], "batch string, attempt string, at timestamp")
        return marks.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))

    def known(self, batch: str = "") -> DataFrame:
        """The rows that count against a batch: those of other batches that came to their end, one for each digest."""
        return self.read().join(self.ended().where(F.col("batch") != batch).select("attempt"), "attempt", "left_semi")

    def new(self, found: DataFrame, batch: str = "") -> DataFrame:
        """The representatives whose digest the index lacks."""
        return found.join(self.known(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, found: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the representatives that the index lacks, one file per bucket and half of the digests; those that are the batch's.

        An id makes it safe to offer a batch again, after a failure here or at the caller's; batches without one are told apart by themselves.
        """
        attempt, added = uuid.uuid4().hex, []
        batch = batch or attempt
        for half in (0, 1):
            own = found.where(F.shiftright(F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int"), 7) == half)
            rows = written(self.new(own, batch), "digest-new")
            self._store(rows.withColumn("attempt", F.lit(attempt)), self.table, self.path)
            added.append(rows)
        mark = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
        mark.write.mode("append").json(f"{self.path}/_ended")
        return added[0].unionByName(added[1])

    def _store(self, rows: DataFrame, table: str, path: str) -> None:
        rows = rows.select("digest", "keep_id", "keep_row", "group_size", "attempt").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)

    def compacted(self, path: str) -> DigestIndex:
        """A copy at ``path``, one file a bucket, of what counts: for an index of many small batches, or of failed attempts."""
        copy = DigestIndex(self.spark, path, self.buckets)
        self._store(written(self.known(), "digest-compact"), copy.table, path)
        self.ended().withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/_ended")
        return copy


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)


def label_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Every row with the row that stays for its text, after the batch has been added to ``index``.

    ``group_size`` counts the rows of the batch that brought the digest.
    """
    batch = batch or uuid.uuid4().hex
    rows = written(digest_rows(docs, id_col, text_col), "digest-rows")
    with settings(docs.sparkSession, **FREED_SHUFFLES):
        own = index.append(representatives(rows), batch).select("digest", "keep_id", "keep_row", "group_size")
    older = index.known(batch).select("digest", "keep_id", F.lit(None).cast("struct<file: string, at: long>").alias("keep_row"), "group_size")
    # a union has no buckets, so both sides are dealt anew and Spark can split a hot digest
    return rows.join(own.unionByName(older), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_code_points",
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text neither the index nor a better row of the batch has."""
    numbered = told_apart(docs)
    rows = written(digest_rows(numbered, id_col, text_col, ROW), "digest-rows")
    stay = index.append(representatives(rows), batch).select(F.col("keep_row").alias(ROW))
    return numbered.join(stay, ROW, "left_semi").drop(ROW)
