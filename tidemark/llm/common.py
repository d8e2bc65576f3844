"""What several corpus operators share: the cluster's shared folder, written stages and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text handed to numpy at once, in bytes: bounds a worker's memory whatever an Arrow batch holds.
CHUNK_BYTES = 1 << 20

# Freed batches go back to the system at once, so that idle workers stay small beside busy ones.
pa.set_memory_pool(pa.system_memory_pool())

_K1, _K2, _K3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# ASCII that is neither letter nor digit also ends a word; bytes of other scripts belong to words.
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one, kept for the application, only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # a running session does not take that setting
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        folder = _OWN_DIRS[app]
    return folder.rstrip("/")


# Spark deletes a statement's shuffle files as soon as the statement has ended, not when the driver next collects garbage.
FREED_SHUFFLES = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: cuts lineage in a way that outlives executors."""
    return Stored(df.sparkSession).put(df, name)


class Stored:
    """Tables of one job in the shared folder, each of which can be deleted once its last reader has ended."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, **FREED_SHUFFLES):
            df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_split(self, df: DataFrame, name: str, column: str, values: list[str]) -> dict[str, DataFrame]:
        """``df`` stored with a folder for each value of a column: a table for each of ``values``, which can be dropped as NAME-VALUE."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, **FREED_SHUFFLES):
            df.write.partitionBy(column).parquet(path)
        context, rest, found = self.spark.sparkContext, df.drop(column).schema, {}
        for value in values:
            folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
            if folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder):
                self.paths.setdefault(f"{name}-{value}", []).append(f"{path}/{column}={value}")
                found[value] = self.spark.read.schema(rest).parquet(f"{path}/{column}={value}")
            else:
                found[value] = self.spark.createDataFrame([], rest)
        return found

    def drop(self, *names: str) -> None:
        """Delete the tables of these names."""
        context = self.spark.sparkContext
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


ROW = "_row_of_origin_"  # the library's own column


def _read_as_stored(df: DataFrame) -> bool:
    """Whether rows are those of one set of files, each once: nothing but choices of columns and rows lies between."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def told_apart(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` (all unless named) and ROW, the file and position that each row was read from.

    Documents that do not come straight from Parquet files, but out of joins, ``explode`` or the like, are numbered, and stored, so that
    every reader sees the same numbers.
    """
    columns = columns or ("*",)
    if "_metadata" not in docs.columns and _read_as_stored(docs):
        try:
            return docs.select(*columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(ROW))
        except AnalysisException:  # other formats have no positions, other plans no files
            pass
    return written(docs.select(*columns, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")).alias(ROW)), "told-apart")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's rows per Arrow batch, so that batches of long texts fit beside each other in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)) or rows)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit of 64-bit codes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Slices of a string column of about ``limit`` bytes: (first row, array without nulls). A longer text is a slice of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, column.slice(at, to - at)
        at = to


def words(column: pa.Array, punctuation: bool = False, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column of texts (large_string, no nulls), ASCII letters lower-cased.

    White space ends a word, with ``punctuation`` every ASCII character but letters and digits, and without ``digits`` those too.
    Returns the lower-cased bytes, each word's start and end in them, each word's 64-bit code and
    the first word of each text (one entry more than texts).
    """
    n = len(column)
    ends_of = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    low, high = int(ends_of[0]), int(ends_of[-1])
    data = np.zeros(high - low + 8, dtype=np.uint8)
    if high > low:
        data[: high - low] = _LOWER[np.frombuffer(column.buffers()[2], dtype=np.uint8, count=high - low, offset=low)]
    bounds = ends_of - low
    inside = np.zeros(high - low + 1, dtype=bool)
    outside = _PUNCT if punctuation else _SPACE
    inside[:-1] = ~(outside if digits else outside | _DIGIT)[data[: high - low]]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cut = bounds[:-1][bounds[:-1] < high - low]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    inner = bounds[1:][(bounds[1:] > 0)] - 1
    last[inner] |= inside[inner]
    ends = np.flatnonzero(last) + 1
    return data, starts, ends, codes(data, starts, ends), np.searchsorted(starts, bounds)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of byte ranges, eight bytes at a time; ``data`` has eight spare bytes at its end."""
    loads = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _K3 + _K1)
    active, at = np.arange(len(starts)), 0
    while len(active):
        left = size[active] - at
        part = loads[starts[active] + at] & _MASKS[np.minimum(left, 8)]
        h[active] = mix((h[active] ^ part) * _K1 + _K2)
        at += 8
        active = active[left > 8]
    return h


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which byte ranges of ``data`` equal those of ``other``, pair by pair; both have eight spare bytes at their end."""
    same = ends - starts == to - at
    here, there = (np.ndarray(shape=(len(d) - 7,), dtype="<u8", buffer=d, strides=(1,)) for d in (data, other))
    active, step = np.flatnonzero(same), 0
    while len(active):
        left = ends[active] - starts[active] - step
        equal = ((here[starts[active] + step] ^ there[at[active] + step]) & _MASKS[np.clip(left, 0, 8)]) == 0
        same[active[~equal]] = False
        step += 8
        active = active[equal & (left > 8)]
    return same


def shingles(code: np.ndarray, first_word: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle codes. A text of fewer words has its whole sequence as one; one without words has none."""
    n = len(code)
    whole = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    steps = np.arange(1, size + 1, dtype=np.uint64) * _K2
    for k in range(size if n >= size else 0):
        whole += mix(code[k : n - size + 1 + k] + steps[k])
    whole = mix(whole)
    out = []
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            rest = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                rest = mix(rest * _K1 + code[k])
            out.append(rest)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def filtered(docs: DataFrame, keep, names: tuple[str, ...]) -> DataFrame:
    """``keep(docs)`` with the columns of ``docs`` as they were: columns that ``keep`` would replace (``names``) wait under other names."""
    away = {c: f"_kept_{c}" for c in docs.columns if c in names}
    return keep(docs.withColumnsRenamed(away)).select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the statements inside, by name with dots as double underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
