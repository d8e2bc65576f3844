"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and 5-word shingles columns of a 0/1 matrix. Two documents link when
100 * overlap >= 80 * union, so a row of n shingles needs only its n - ceil(0.8 n) + 1 rarest columns
to meet every partner in one of them: rows are brought together by those columns alone, and pairs
whose sizes, positions or sketches bound the overlap below the limit are discarded. The blocks of rows
that are left are multiplied, so that their overlaps are accumulated over whole rows, exactly.

Columns are ordered by a table of counts over all documents (a fixed number of hashed buckets) and
then by code: any order that all rows share is exact, this one keeps frequent passages out.

Equal rows are one class with one representative. A column of g rows is not written out as g * g pairs.
A first product multiplies each column's rows with its first row; what that links needs no further
comparison. The columns that still hold several components are gathered into families by their smallest
row; a second product multiplies a family's rows block by block, but never two rows of its main
component, and gives out no more links than join the rows. So no link between components is lost, rows
between stages stay in proportion to the input, and a family whose rows link to its first one costs as
much as its rows. Columns of very many rows are split by a salt first.

Before a product, each row travels as a sketch: the parities of its shingles' counts in 4 to 8 buckets
a shingle. Buckets in which two sketches differ each stand for a shingle that only one row has, so
their number bounds the overlap from above. Only rows with a partner in their block that this bound
allows go on to the product with their whole shingle sets.

Edge cases: a null or empty text, or one without words, has no shingles and links with nothing; a
text of one to four words has its whole sequence as one shingle; rows of one doc_id with different
texts are versions of one document; rows without doc_id get no component; an empty table gives an
empty result; other columns are ignored. Shingles are told apart by 64-bit codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FREED_SHUFFLES, Stored, mix, settings, shingles, small_batches, text_chunks, words

SHINGLE_WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
BUCKET_BITS = 18
COLUMN_ROWS = 100_000  # rows of a column beyond which it is dealt in several parts
BLOCK_ROWS = 1_000  # rows of a block, about
BLOCK_SHINGLES = 2_000_000  # and their shingles, about


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, chunk in text_chunks(batch["text"]):
        _, _, _, code, first = words(chunk)
        yield at, shingles(code, first, SHINGLE_WORDS)


def _signature(codes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([codes.sum(), mix(codes).sum()], dtype=np.uint64).tobytes()


def sketch(codes: np.ndarray) -> bytes:
    """The parities of a set's counts in hashed buckets, a power of two of them, at least four for each element."""
    bits = max(64, 1 << int(4 * len(codes) - 1).bit_length())
    odd = np.bincount((codes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def needed(size_a, size_b):
    """The least overlap of a linked pair: overlap * (d + n) >= n * (a + b)."""
    return -(-NUMERATOR * (size_a + size_b) // (DENOMINATOR + NUMERATOR))


def rows_and_counts(docs: DataFrame, stored: Stored) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, signature and sketch of each document; and how many (document, shingle) pairs each bucket of columns holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        names = ["doc_id", "n", "signature", "sketch", "bucket", "count"]
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for at, sets in _sets(batch):
                if codes := [s for s in sets if len(s)]:
                    total += np.bincount((np.concatenate(codes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
                own, none = len(sets), pa.nulls(len(sets), pa.int64())
                signatures, sketches = (pa.array([f(s) if len(s) else None for s in sets], pa.binary()) for f in (_signature, sketch))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + own], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), signatures, sketches, none, none], names=names)
        full = np.flatnonzero(total)
        none, nothing = pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, nothing, nothing, pa.array(full), pa.array(total[full])], names=names)

    both = stored.put(docs.mapInArrow(run, "doc_id long, n long, signature binary, sketch binary, bucket long, count long"), "ngram-rows")
    with settings(docs.sparkSession, **FREED_SHUFFLES):
        table = both.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()  # at most 2 ** BUCKET_BITS rows
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    counts[table["bucket"].to_numpy().astype(np.int64)] = table["count"].to_numpy()
    return both.where("bucket is null").select("doc_id", "n", "signature", "sketch"), counts


def index_rows(docs: DataFrame, counts: np.ndarray, parted: bool) -> DataFrame:
    """The matrix entries by which rows meet: column, rep, n, position, and with ``parted`` in how many parts the column is dealt; one row set per class."""
    spark = docs.sparkSession
    excess = np.maximum(counts - np.median(counts), 0)
    order = spark.sparkContext.broadcast(np.minimum(np.log2(1 + counts) * 1024, 65535).astype(np.uint64))
    parts = spark.sparkContext.broadcast((1 + excess // COLUMN_ROWS).astype(np.int32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for at, sets in _sets(batch):
                out = []
                for doc_id, codes in zip(ids[at : at + len(sets)], sets):
                    n = len(codes)
                    if n and doc_id is not None:
                        keep = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
                        key = (rank[codes >> np.uint64(64 - BUCKET_BITS)] << np.uint64(48)) | (codes >> np.uint64(16))
                        first = np.argsort(key, kind="stable")[:keep]
                        out.append((doc_id, n, _signature(codes), codes[first].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary())],
                    names=["doc_id", "n", "signature", "prefix"],
                )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = parts.value
        for batch in batches:
            size = np.array([len(p) // 8 for p in batch["prefix"].to_pylist()], dtype=np.int64)
            column = np.frombuffer(b"".join(batch["prefix"].to_pylist()), dtype=np.uint64)
            position = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
            out = {
                "column": pa.array(column.view(np.int64)),
                "rep": pa.array(np.repeat(batch["rep"].to_numpy(), size)),
                "n": pa.array(np.repeat(batch["n"].to_numpy(), size), pa.int32()),
                "position": pa.array(position, pa.int32()),
            }
            if parted:
                out["parts"] = pa.array(split[(column >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    classes = docs.mapInArrow(prefixes, "doc_id long, n int, signature binary, prefix binary")
    classes = classes.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    return classes.select("rep", "n", "prefix").mapInArrow(entries, "column long, rep long, n int, position int" + ", parts int" * parted)


_MET = "column long, rep long, n int, position int, head long, near boolean"


def compare_with_head(entries: DataFrame, parted: bool) -> DataFrame:
    """Every entry but a column's first, with the column's first row and whether sizes and positions let the two link.

    ``parted``: columns come in parts, and the parts' first rows (head null) are given out too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # key, rep, n, position of the run that goes on
        for batch in batches:
            column, rep, n, position = (batch[c].to_numpy() for c in ("column", "rep", "n", "position"))
            if not len(column):
                continue
            part, parts = (batch[c].to_numpy() for c in ("part", "parts")) if parted else (np.zeros(len(column), dtype=np.int32), np.ones(len(column), dtype=np.int32))
            new = np.ones(len(column), dtype=bool)
            new[1:] = (column[1:] != column[:-1]) | (part[1:] != part[:-1])
            goes_on = head is not None and head[0] == (column[0], part[0])
            new[0] = not goes_on
            start = np.maximum.accumulate(np.where(new, np.arange(len(column)), -1))
            of = [np.where(start < 0, head[k] if goes_on else 0, values[start]) for k, values in enumerate((rep, n, position), 1)]
            last = start[-1]
            head = ((column[-1], part[-1]), *((x[-1] for x in of) if last < 0 else (rep[last], n[last], position[last])))
            bound = np.minimum(position, of[2]) + 1 + np.minimum(n - position, of[1] - of[2]) - 1
            limit = needed(n.astype(np.int64), of[1].astype(np.int64))
            near = (bound >= limit) & (np.minimum(n, of[1]) >= limit) & (rep != of[0])
            out = ~new | (parted & (parts > 1))
            heads = pa.array(of[0][out], pa.int64(), mask=new[out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[out], t) for x, t in ((column, pa.int64()), (rep, pa.int64()), (n, pa.int32()), (position, pa.int32()))] + [heads, pa.array(near[out])],
                names=["column", "rep", "n", "position", "head", "near"],
            )

    key = ["column"]
    if parted:
        entries = entries.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0).cast("int"))
        key = ["column", "part"]
    return entries.repartition(*key).sortWithinPartitions(*key, "rep").mapInArrow(run, _MET)


# A block pair is a group (family, i, j); its rows say in which of the two blocks they are and to which component they belong.
GROUP = ["family", "i", "j"]
_MEMBER = "family long, i int, j int, block int, rep long, component long"


def _blocks(rows: Column, shingles_of: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles_of / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), F.greatest(blocks, F.lit(1))).cast("int")


def head_groups(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups of the first product: a first row alone in block 0, and the rows that may link to it in blocks of their own."""
    pairs = met.where("near").select("rep", F.col("head").alias("family")).distinct()
    pairs = pairs.join(classes.select("rep", "n"), "rep")
    sizes = pairs.groupBy("family").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    rows = pairs.join(sizes, "family").select("family", F.lit(0).alias("i"), (_dealt(F.col("blocks")) + 1).alias("j"), "rep")
    heads = sizes.select("family", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), "blocks")).alias("j"), F.col("family").alias("rep"))
    both = rows.withColumn("block", F.col("j")).unionByName(heads.withColumn("block", F.lit(0)))
    return both.select(*GROUP, "block", "rep", F.col("rep").alias("component"))


def family_groups(met: DataFrame, labels: DataFrame, stored: Stored) -> DataFrame:
    """Groups of the second product: the rows of columns that still hold several components, by the columns' smallest row.

    Near copies share most columns, and with them the smallest row, so a family's rows come together
    once and not once a column; two rows of one column are always in its family. Rows of a family's
    main component are dealt into blocks that meet only the blocks of its other rows.
    """
    known = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    rows = met.select("column", "rep", "n").join(known, "rep", "left").select("column", "rep", "n", F.coalesce("label", "rep").alias("component"))
    rows = stored.put(rows, "ngram-open")
    several = rows.groupBy("column").agg(F.min("rep").alias("family"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    groups = stored.put(rows.join(several.select("column", "family"), "column").select("family", "rep", "n", "component").distinct(), "ngram-families")
    parts = groups.groupBy("family", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    total = parts.groupBy("family").agg(F.max(F.struct("rows", "component", "n")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    sizes = total.select("family", F.col("main.component").alias("main"), _blocks(F.col("main.rows"), F.col("main.n")).alias("closed"), _blocks(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("open"))
    rows = groups.join(sizes, "family").withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("block", F.when(F.col("is_main"), _dealt(F.col("closed"))).otherwise(F.col("closed") + _dealt(F.col("open"))))
    others = F.when(F.col("is_main"), F.sequence("closed", F.col("closed") + F.col("open") - 1)).otherwise(F.sequence(F.lit(0), F.col("closed") + F.col("open") - 1))
    rows = rows.select("family", "block", "rep", "component", F.explode(others).alias("other"))
    return rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy() for c in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and last != key[:, 0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = key[:, -1].tolist()
    if held:
        yield pa.Table.from_batches(held)


def _sides(table: pa.Table) -> tuple[slice, slice]:
    """The rows of the lower and of the higher block, which are one within a block's own group."""
    block = table["block"].to_numpy()
    if table["i"][0] == table["j"][0]:
        return slice(0, len(block)), slice(0, len(block))
    cut = int(np.searchsorted(block, table["j"][0].as_py()))
    return slice(0, cut), slice(cut, len(block))


def _folded(sketches: list[np.ndarray], rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches as rows of ``width`` words; a longer one folds, as its buckets modulo a smaller number are the halves' differences."""
    out = np.empty((len(rows), width), dtype=np.uint64)
    for k, r in enumerate(rows.tolist()):
        words_of = sketches[r]
        while len(words_of) > width:
            words_of = words_of[: len(words_of) // 2] ^ words_of[len(words_of) // 2 :]
        out[k] = words_of
    return out


def within_bounds(n: np.ndarray, component: np.ndarray, sketches: list[np.ndarray], left: slice, right: slice, cells: int = 1 << 20) -> np.ndarray:
    """Which rows have a partner of another component on the other side whose size and sketch let the two link."""
    width = np.array([len(s) for s in sketches])
    sides = np.arange(len(n))[left], np.arange(len(n))[right]
    found = np.zeros(len(n), dtype=bool)
    for level in np.unique(width).tolist():
        # linked rows' sizes differ by a quarter at most, so their sketches by one doubling
        own, next_ = (tuple(s[width[s] == w] for s in sides) for w in (level, 2 * level))
        for x, y in ((own[0], np.concatenate([own[1], next_[1]])), (next_[0], own[1])):
            if not len(x) or not len(y):
                continue
            a, b = _folded(sketches, x, level), _folded(sketches, y, level)
            step = max(1, cells // (len(y) * level))
            for at in range(0, len(x), step):
                these = x[at : at + step]
                total = n[these, None] + n[None, y]
                limit = needed(n[these, None], n[None, y])
                may = (component[these, None] != component[None, y]) & (np.minimum(n[these, None], n[None, y]) >= limit)
                if may.any():
                    apart = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                    may &= apart <= total - 2 * limit
                    found[these] |= may.any(axis=1)
                    found[y] |= may.any(axis=0)
    return found


def bounded(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of each group, with their sizes, that have a partner there which the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, GROUP):
            sketches = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table["sketch"]]
            hit = within_bounds(table["n"].to_numpy(), table["component"].to_numpy(), sketches, *_sides(table))
            if hit.any():
                yield from table.drop_columns("sketch").filter(pa.array(hit)).to_batches()

    rows = members.join(classes.select("rep", "n", "sketch"), "rep").select(*GROUP, "block", "rep", "component", "n", "sketch")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "block", "rep").mapInArrow(run, _MEMBER + ", n long")


# Spark's own Bloom filters, whatever the sizes: rows without a partner are dropped before they are shuffled.
# Spark builds none for a join whose smaller side it could broadcast, so that is ruled out as well.
BLOOM_FILTERS = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "10GB",
}


def row_sets(docs: DataFrame, members: DataFrame, stored: Stored) -> DataFrame:
    """rep, codes: the whole rows of the members' documents, stored.

    Spark may build its own Bloom filter of the ids, of a fixed largest size, so that few other texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "codes"])

    wanted = stored.put(members.select("rep").distinct(), "ngram-ids")
    wanted = wanted.where(F.col("rep") >= F.lit(-(1 << 63))).select(F.col("rep").alias("doc_id"))  # only a side with a condition is considered for a filter
    with settings(docs.sparkSession, **BLOOM_FILTERS):
        return stored.put(docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(run, "rep long, codes binary"), "ngram-sets")


def overlaps(sets: list[np.ndarray], other: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Overlap counts of every set with every other one: the product of two 0/1 matrices, by blocks of columns that both have."""
    sizes, sizes_other = [len(s) for s in sets], [len(s) for s in other]
    codes, codes_other = np.concatenate(sets), np.concatenate(other)
    column = np.intersect1d(codes, codes_other)
    row, row_other = np.repeat(np.arange(len(sets)), sizes), np.repeat(np.arange(len(other)), sizes_other)
    total = np.zeros((len(sets), len(other)), dtype=np.float32)

    def entries(values, rows):
        at = np.minimum(np.searchsorted(column, values), max(len(column) - 1, 0))
        hit = column[at] == values if len(column) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    (at, of), (at_other, of_other) = entries(codes, row), entries(codes_other, row_other)
    width = min(width, max(len(column), 1))
    for low in range(0, len(column), width):
        block, block_other = np.zeros((len(sets), width), dtype=np.float32), np.zeros((len(other), width), dtype=np.float32)
        for where, rows, into in ((at, of, block), (at_other, of_other, block_other)):
            a, b = np.searchsorted(where, (low, low + width))
            into[rows[a:b], where[a:b] - low] = 1
        total += block @ block_other.T
    return total


def products(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, overlap: links of different components' rows, in each group no more than join its rows."""

    def product(table: pa.Table) -> pa.RecordBatch:
        rep, n, component = (table[c].to_numpy() for c in ("rep", "n", "component"))
        codes = [np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in table["codes"]]
        left, right = _sides(table)
        out = []
        if codes[left] and codes[right]:
            found = overlaps(codes[left], codes[right])
            links = found >= needed(n[left, None], n[None, right])
            links &= component[left, None] != component[None, right]
            # what earlier links connect needs no link: rows of a component count as one from the start
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in zip(*np.nonzero(links)):
                p, q = root(int(component[left][x])), root(int(component[right][y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(rep[left][x]), int(rep[right][y]), int(found[x, y])))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["a", "b", "overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, GROUP):
            yield product(table)

    rows = members.join(sets.hint("merge"), "rep").select(*GROUP, "block", "rep", "component", "n", "codes")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "block", "rep").mapInArrow(run, "a long, b long, overlap long")


def links_within(members: DataFrame, docs: DataFrame, classes: DataFrame, stored: Stored, name: str) -> DataFrame:
    """The links of one round of groups, stored."""
    close = stored.put(bounded(members, classes), "ngram-close")
    sets = row_sets(docs, close, stored)
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="200"):  # whole rows, which may be long
        links = stored.put(products(close, sets), name)
    stored.drop("ngram-close", "ngram-ids", "ngram-sets")
    return links


def components(links: DataFrame, stored: Stored | None = None, name: str = "ngram-labels") -> DataFrame:
    """node, component: the smallest node that links (a, b) reach. Labels fall along links and along labels until none changes."""
    stored, n = stored or Stored(links.sparkSession), 0
    edges = stored.put(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "ngram-edges")
    labels = stored.put(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), f"{name}-{n}")
    while True:
        n += 1
        seen = edges.join(labels.withColumnsRenamed({"node": "other", "component": "label"}), "other").groupBy("node").agg(F.min("label").alias("label"))
        lower = labels.join(seen, "node").select("node", F.least("component", "label").alias("next"), F.col("component").alias("before"))
        target = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        after = stored.put(lower.join(target, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("component"), "before"), f"{name}-{n}")
        labels = after.select("node", "component")
        stored.drop(f"{name}-{n - 1}")
        if after.where("component <> before").isEmpty():
            stored.drop("ngram-edges")
            return labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: every document with the size of its set and the smallest doc_id that links reach from it."""
    small_batches(docs.sparkSession)
    stored = Stored(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, counts = rows_and_counts(docs, stored)
    one = rows.where("n > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = stored.put(one, "ngram-classes")
    parted = bool((counts - np.median(counts) >= COLUMN_ROWS).any())
    met = stored.put(compare_with_head(index_rows(docs, counts, parted), parted), "ngram-met")
    compared = met.where("head is not null")
    if parted:  # the parts' first rows meet each other, and stay open towards the other parts' rows
        compared = compared.unionByName(compare_with_head(met.where("head is null").select("column", "rep", "n", "position"), False))
    links = links_within(head_groups(compared, classes), docs, classes, stored, "ngram-links")
    labels = components(links, stored)
    members = family_groups(met, labels, stored)
    more = links_within(members, docs, classes, stored, "ngram-more")
    stored.drop("ngram-met", "ngram-open", "ngram-families")
    labels = components(links.unionByName(more), stored, "ngram-final").withColumnRenamed("node", "rep")
    of_class = classes.join(labels, "rep", "left").select("signature", F.coalesce("component", "rep").alias("component"))
    joined = rows.join(of_class, "signature", "left")
    found = joined.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    result = stored.put(found, "ngram-result")
    stored.drop(*(name for name in list(stored.paths) if name != "ngram-result"))
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: the one of the smallest doc_id. Rows without doc_id stay."""
    found = near_components(docs, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
