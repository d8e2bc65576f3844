"""Ranked lexical search over a bit-sliced impact index.

What a term adds to a document's score (its impact) is a whole number. An index block holds some ten
thousand documents; for each term of the block it keeps where the term occurs and one bitmap per bit of
the impacts. A query adds its terms' bitmaps with carries, bit by bit, for all documents of the block at
once; the k best are found by going down the sums' bitmaps from the most significant one, keeping those
surely in and those still tied. Nothing is approximate: sums are exact, and ties go to the smaller doc_id.

An index serves a stated set of queries: it holds the terms that they ask for. Texts are read once per
part of the queries (of about ``max_terms`` terms each, so what every task holds of them is bounded);
counts of documents, terms and terms' documents are taken over all texts. Documents are never shuffled:
blocks are cut as the rows come, and only each task's k best per query travel.

Edge cases: a null text has no terms; a document without terms counts for nothing; a query without known
terms gives no row; rows that repeat an item_id are one query, all of whose terms count; rows that repeat
a doc_id are documents of their own; a null doc_id loses every tie; empty tables give no rows; other
columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, codes, same_bytes, settings, small_batches, text_chunks, words

BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 1 << 22
MAX_TERMS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UNNAMED = np.iinfo(np.int64).max  # stands for a null doc_id, after all others
BLOCK = "doc_ids binary, terms binary, starts binary, positions binary, widths binary, slices binary"


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, times of every query."""
    term = F.explode(F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(1)))
    return queries.select(F.col(id_col).alias("item_id"), term.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Vocabulary:
    """Terms by number, found by code and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        column = pa.array(terms, pa.large_string())
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1) if n else np.zeros(1, dtype=np.int64)
        self.data = np.concatenate([np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8, count=int(bounds[-1])), np.zeros(8, dtype=np.uint8)])
        self.starts, self.ends = bounds[:-1], bounds[1:]
        code = codes(self.data, self.starts, self.ends)
        self.order = np.argsort(code)
        self.codes = code[self.order]
        if (self.codes[1:] == self.codes[:-1]).any():
            raise ValueError("two terms of the queries have one code")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and their numbers."""
        if not len(self.codes) or not len(code):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == code)
        number = self.order[at[hit]]
        same = same_bytes(data, starts[hit], ends[hit], self.data, self.starts[number], self.ends[number])
        return hit[same], number[same]


def occurrences(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, and the numbers and counts of the known terms of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))  # at most about max_terms terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = max(len(known.codes), 1)
        for batch in batches:
            for at, chunk in text_chunks(batch["text"]):
                data, starts, ends, code, first = words(chunk, punctuation=True)
                hit, number = known.find(data, starts, ends, code)
                text_of = np.searchsorted(first, hit, side="right") - 1
                pair, times = np.unique(text_of * size + number, return_counts=True)
                cuts = pa.array(np.searchsorted(pair, np.arange(len(chunk) + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (pair % size, times)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(chunk)), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


def impact(weight: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term of this weight adds, by its count and the document's length measure."""
    return weight * ((1_000_000_000 * count) // (1000 * count + 12 * length))


def sliced(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bitmaps, the least significant bit first, of whole numbers; packed to bytes."""
    bits = (values[None, :] >> np.arange(width, dtype=np.int64)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def make_block(doc_ids: np.ndarray, position: np.ndarray, term: np.ndarray, value: np.ndarray) -> list[bytes]:
    """One row of the index: the block's documents in order of doc_id, and for each of its terms the places and impact bitmaps."""
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    position = place[position]
    by_term = np.lexsort((position, term))
    position, term, value = position[by_term], term[by_term], value[by_term]
    distinct, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    top = np.maximum.reduceat(value, starts[:-1]) if len(distinct) else np.zeros(0, dtype=np.int64)
    widths = np.array([int(v).bit_length() for v in top.tolist()], dtype=np.int64)
    slices = b"".join(sliced(value[a:b], w).tobytes() for a, b, w in zip(starts[:-1].tolist(), starts[1:].tolist(), widths.tolist()))
    return [doc_ids[order].tobytes(), distinct.astype(np.int64).tobytes(), starts.astype(np.int64).tobytes(), position.astype(np.uint32).tobytes(), widths.tobytes(), slices]


def build_index(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The index blocks of the rows of ``occurrences``; each task cuts its rows into blocks of at most ``block_docs`` documents."""
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, docs, postings = shared.value, [], 0, 0

        def block() -> pa.RecordBatch:
            ids, n, sizes, term, count = (np.concatenate(p) for p in zip(*held))
            of = np.repeat(np.arange(len(ids)), sizes)
            length = 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)
            row = make_block(ids, of, term, impact(weights[term], count, length[of]))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], names=["doc_ids", "terms", "starts", "positions", "widths", "slices"])

        for batch in batches:
            at = 0
            sizes = np.diff(batch["terms"].offsets.to_numpy())
            ids = batch["doc_id"].fill_null(UNNAMED).to_numpy()
            n, term, count = batch["n"].to_numpy(), batch["terms"].flatten().to_numpy().astype(np.int64), batch["counts"].flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            while at < len(ids):
                to = min(len(ids), at + block_docs - docs, max(at + 1, int(np.searchsorted(ends, ends[at] + block_postings - postings, side="right")) - 1))
                held.append((ids[at:to], n[at:to], sizes[at:to], term[ends[at] : ends[to]], count[ends[at] : ends[to]]))
                docs, postings, at = docs + to - at, postings + int(ends[to] - ends[at]), to
                if docs >= block_docs or postings >= block_postings:
                    yield block()
                    held, docs, postings = [], 0, 0
        if held:
            yield block()

    return found.where("size(terms) > 0").mapInArrow(cut, BLOCK)


def add(total: np.ndarray, where: np.ndarray, bitmaps: np.ndarray, shift: int = 0) -> None:
    """Add numbers given as bitmaps (times 2^shift) to those of ``total`` at the words ``where``: a ripple of carries from bit to bit."""
    carry = np.zeros(len(where), dtype=np.uint64)
    for k in range(shift, len(total)):
        own = total[k, where]
        if k - shift < len(bitmaps):
            other = bitmaps[k - shift]
            either = own ^ other
            total[k, where] = either ^ carry
            carry = (own & other) | (carry & either)
        else:
            if not carry.any():
                return
            total[k, where] = own ^ carry
            carry &= own


def best(total: np.ndarray, n: int, k: int) -> np.ndarray:
    """The places of the ``k`` greatest of ``n`` sums, the first places among equals, by descending slices."""
    every = np.zeros(total.shape[1] * 64, dtype=np.uint8)
    every[:n] = 1
    tied = np.packbits(every, bitorder="little").view(np.uint64)
    surely = np.zeros_like(tied)
    for slice_ in total[::-1]:
        with_bit = surely | (tied & slice_)
        number = int(np.bitwise_count(with_bit).sum())
        if number > k:
            tied &= slice_
        else:
            surely = with_bit
            tied &= ~slice_
            if number == k:
                tied[:] = 0
                break
    places = [np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little")) for m in (surely, tied)]
    return np.concatenate([places[0], places[1][: k - len(places[0])]])


class Block:
    """One row of the index, ready to answer queries."""

    def __init__(self, row: dict[str, bytes]):
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        self.terms, self.starts, self.widths = (np.frombuffer(row[c], dtype=np.int64) for c in ("terms", "starts", "widths"))
        self.positions = np.frombuffer(row["positions"], dtype=np.uint32)
        self.slices = np.frombuffer(row["slices"], dtype=np.uint8)
        sizes = (np.diff(self.starts) + 7) // 8 * self.widths
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])

    def bitmaps(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of the block in which a term occurs, and the term's impact bitmaps over them."""
        a, b, width = int(self.starts[at]), int(self.starts[at + 1]), int(self.widths[at])
        own = np.unpackbits(self.slices[self.offsets[at] : self.offsets[at + 1]].reshape(width, -1), axis=1, count=b - a, bitorder="little")
        place = self.positions[a:b].astype(np.int64)
        where, number = np.unique(place >> 6, return_inverse=True)
        spread = np.zeros((width, len(where) * 64), dtype=np.uint8)
        spread[:, number * 64 + (place & 63)] = own
        return where, np.packbits(spread, axis=1, bitorder="little").view(np.uint64).reshape(width, len(where))

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores above 0 of the ``k`` best documents of the block."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), dtype=bool)
        at, times = at[known], times[known]
        most = sum(int(t) * ((1 << int(w)) - 1) for t, w in zip(times, self.widths[at]))
        if not most:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        total = np.zeros((most.bit_length(), -(-len(self.doc_ids) // 64)), dtype=np.uint64)
        for number, n in zip(at.tolist(), times.tolist()):
            where, bitmaps = self.bitmaps(number)
            for shift in range(n.bit_length()):
                if n >> shift & 1:
                    add(total, where, bitmaps, shift)
        places = best(total, len(self.doc_ids), k)
        bits = (total[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
        score = (bits.astype(np.int64) << np.arange(len(total), dtype=np.int64)[:, None]).sum(axis=0)
        return self.doc_ids[places[score > 0]], score[score > 0]


def _merged(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each item."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    nth = np.arange(len(item)) - np.searchsorted(item, item)
    return item[nth < k], doc[nth < k], score[nth < k]


def search_index(index: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """item (the query's place in ``asked``), doc_id, score: each task's ``k`` best rows of each query."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block({c: batch[c][at].as_buffer() for c in batch.schema.names})
                found = [block.search(terms, times, k) for terms, times in shared.value]
                item = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                if len(item):
                    rows = item, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    kept = _merged(*(np.concatenate(p) for p in zip(kept, rows)), k)
        item, doc, score = kept
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=doc == UNNAMED), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def weight_of(n_docs: int, with_term: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * with_term + 1))).astype(np.int64)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", max_terms: int = MAX_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each row of ``queries``."""
    spark = docs.sparkSession
    stored = Stored(spark)
    terms = stored.put(query_terms(queries, item_col, query_col), "impact-terms")
    parts = max(1, -(-terms.count() // max_terms))
    results = []
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times"))
        asked = own.collect()  # about max_terms terms
        names = sorted({t for r in asked for t in r["terms"]})
        number = {t: i for i, t in enumerate(names)}
        found = stored.put(occurrences(docs, names, id_col, text_col), "impact-occurrences")
        n_docs, n_terms = found.agg(F.count_if(F.expr("n > 0")), F.coalesce(F.sum("n"), F.lit(0))).first()
        with_term = np.zeros(len(names), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row a term
            with_term[r["term"]] = r["count"]
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2"):  # a block is some ten million bytes
            index = stored.put(build_index(found, weight_of(n_docs, with_term), n_docs, n_terms, block_docs), "impact-index")
            plan = []
            for r in asked:
                of = np.array([number[t] for t in r["terms"]], dtype=np.int64)
                plan.append((of, np.array(r["times"], dtype=np.int64)))
            near = stored.put(search_index(index, plan, k), "impact-found")
        stored.drop("impact-occurrences", "impact-index")
        items = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], f"item long, item_id {queries.schema[item_col].dataType.simpleString()}")
        results.append(near.join(items, "item"))
    stored.drop("impact-terms")
    every = results[0]
    for other in results[1:]:
        every = every.unionByName(other)
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", nth).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
