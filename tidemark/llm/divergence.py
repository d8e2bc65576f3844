"""How far each source's vocabulary is from that of other sources and of its language: a triangular divergence over smoothed term shares.

Texts are cut into terms by a byte table over whole buffers of UTF-8, terms are grouped by their xxhash and
then compared byte by byte, so a collision cannot merge two of them. Counts are summed per batch before
anything is shuffled. Of each language the terms of at least ``min_docs`` documents are kept; their counts
are dealt into blocks of terms, each block a CSR matrix (sources by terms) of one language. A block's share
of the divergence of two sources comes from ``np.add.reduceat`` over the matrix's rows; terms that a source
lacks have one share each, so a pair costs what its two rows hold and not the vocabulary. Blocks' shares are
added by Spark, and only each source's ten strongest terms of a block leave it.

All arithmetic is on whole numbers: a share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), a term's part
f = floor((p - q)^2 / (p + q)).

Edge cases: null text, language or source count as ''; a source without terms still meets the others, by
its terms' equal shares; a language without kept terms has pairs of value 0; the only source of a language
has no pair rows; equal values rank by the item's UTF-8 bytes; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, same_bytes, small_batches, text_chunks

SCALE_STEPS = (1000, 1000, 1000)  # 10^9, a thousand at a time so that remainders stay in 64 bits
CHUNK = 1 << 23  # bytes of text counted at once
BLOCK_ENTRIES = 1 << 18  # counts of a block, about
TOP_TERMS = 10
# Bytes of terms, and what they become: A-Z lower-cased, other letters and all bytes of other scripts as they are.
TABLE = np.zeros(256, dtype=np.uint8)
TABLE[97:123], TABLE[65:91], TABLE[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def cut_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes by ``TABLE`` (with eight spare ones), each term's start and end, and its text."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    low, high = int(bounds[0]), int(bounds[-1])
    data = np.zeros(high - low + 8, dtype=np.uint8)
    if high > low:
        data[:-8] = TABLE[np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=high - low, offset=low)]
    bounds = bounds - low
    inside = data[:-7] != 0
    begins, ends = inside[:-1].copy(), inside[:-1] & ~inside[1:]
    begins[1:] &= ~inside[:-2]
    first = bounds[:-1][bounds[:-1] < high - low]
    begins[first] = inside[first]
    last = bounds[1:][bounds[1:] > 0] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1, np.searchsorted(bounds, starts, side="right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's group of equal bytes, and one slice of each group."""
    view, hashed = memoryview(data), xxhash.xxh3_64_intdigest
    code = np.fromiter((hashed(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    _, sample, group = np.unique(code, return_index=True, return_inverse=True)
    like = sample[group]
    odd = np.flatnonzero(~same_bytes(data, starts, ends, data, starts[like], ends[like]))
    more: dict[bytes, int] = {}
    for k in odd.tolist():  # slices that share another's hash: told apart by their bytes
        key = bytes(view[starts[k] : ends[k]])
        if key not in more:
            more[key] = len(sample)
            sample = np.append(sample, k)
        group[k] = more[key]
    return group, sample


def count_batch(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """owner, term, occurrences and documents of a chunk of texts, each of which belongs to an owner."""
    data, starts, ends, text_of = cut_terms(texts)
    group, sample = grouped(data, starts, ends)
    size = max(len(sample), 1)
    in_text, times = np.unique(text_of * size + group, return_counts=True)
    pair, at = np.unique(owner[in_text // size] * size + in_text % size, return_inverse=True)
    term = pair % size
    a, b = starts[sample], ends[sample]
    length = (b - a)[term]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    taken = np.repeat(a[term] - offsets[:-1], length) + np.arange(offsets[-1])
    spelled = pa.LargeStringArray.from_buffers(len(term), pa.py_buffer(offsets), pa.py_buffer(data[taken].tobytes()))
    return pair // size, spelled, np.bincount(at, times, minlength=len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, count, docs over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch["text"], CHUNK):
                names = pa.StructArray.from_arrays([batch[c].slice(at, len(chunk)) for c in ("lang", "source")], ["lang", "source"])
                pairs = {}
                owner = np.array([pairs.setdefault((n["lang"], n["source"]), len(pairs)) for n in names.to_pylist()], dtype=np.int64)
                of, term, times, documents = count_batch(chunk, owner)
                known = list(pairs)
                lang, source = (pa.array([k[i] for k in known], pa.string()).take(pa.array(of)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(times), pa.array(documents)], names=["lang", "source", "term", "count", "docs"])

    named = [F.coalesce(c, F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    counted = docs.select(*named).mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), without leaving 64 bits."""
    rest, whole = count + 2, np.zeros_like(count)
    whole, rest = rest // total, rest % total
    for step in SCALE_STEPS:
        whole, rest = whole * step + rest * step // total, rest * step % total
    return 1 + whole


def part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix, 0 for empty ones."""
    sums = np.zeros(len(bounds) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums[full] = np.add.reduceat(values, bounds[:-1][full])
    return sums


def block_divergences(bounds: np.ndarray, column: np.ndarray, count: np.ndarray, totals: np.ndarray, n_terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a CSR block, its divergence over the block's terms from every row.

    ``totals`` holds N + 2 V of each row. With b a row's share of a term that it lacks, the terms of rows i
    and j split into those of j, those of i alone, and those of neither.
    """
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    p, base = share(count, totals[row]), share(np.zeros(len(sizes), dtype=np.int64), totals)
    dense, held = np.empty(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=bool)
    for i in range(len(sizes)):
        own = slice(bounds[i], bounds[i + 1])
        dense[:] = base[i]
        dense[column[own]], held[:] = p[own], False
        held[column[own]] = True
        both = held[column]
        of_other = _row_sums(part(p, dense[column]), bounds)
        met = _row_sums(np.where(both, part(base[row], dense[column]), 0), bounds)
        shared = _row_sums(both.astype(np.int64), bounds)
        alone = np.zeros(len(sizes), dtype=np.int64)
        for a in range(bounds[i], bounds[i + 1], 4096):
            alone += part(base[:, None], p[None, a : min(a + 4096, bounds[i + 1])]).sum(axis=1)
        neither = n_terms - sizes - sizes[i] + shared
        yield i, of_other + alone - met + neither * part(base, base[i])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: item is another source of the language, value the sum of f over all kept terms. Part ``term``:
    item is a term that the source has with a greater share than the language, the first ``top`` by value f.
    """
    spark = docs.sparkSession
    stored = Stored(spark)
    counts = term_counts(docs, text_col, lang_col, source_col)
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("in_docs", F.sum("docs").over(of_term)).where(F.col("in_docs") >= min_docs)
    kept = stored.put(kept.select("lang", "source", "term", "count"), "divergence-kept")
    empty = [F.coalesce(c, F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    sizes = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("count").alias("lang_n"), F.count(F.lit(1)).alias("entries"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    every = stored.put(docs.select(*empty).distinct(), "divergence-sources")
    named = every.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    fill = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n", "entries")}
    named = stored.put(named.select("lang", "source", *fill.values()), "divergence-named")
    # every block of a language meets all of the language's sources, also those without one of its terms
    blocks = F.ceil(F.col("entries") / BLOCK_ENTRIES).cast("int")
    deal = named.groupBy("lang").agg(F.max(blocks).alias("blocks")).where("blocks > 0")
    rows = kept.join(deal, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "count", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("lang_n"))
    heads = named.join(deal, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"), "n", "v", "lang_n")

    def compare(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table["n"])).sort_by("source")
        body = table.filter(pa.compute.is_null(table["n"]))
        sources = head["source"].to_pylist()
        n, (v,), (lang_n,) = head["n"].to_numpy(), set(head["v"].to_pylist()), set(head["lang_n"].to_pylist())
        terms = body["term"].combine_chunks().dictionary_encode() if body.num_rows else pa.array([], pa.string()).dictionary_encode()
        column, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary
        number = {s: k for k, s in enumerate(sources)}
        row = np.array([number[s] for s in body["source"].to_pylist()], dtype=np.int64)
        count = body["count"].to_numpy().astype(np.int64)
        order = np.lexsort((column, row))
        row, column, count = row[order], column[order], count[order]
        bounds = np.searchsorted(row, np.arange(len(sources) + 1))
        totals = n + 2 * v
        in_lang = share(np.bincount(column, count, minlength=len(names)).astype(np.int64), lang_n + 2 * v)
        out: list[tuple] = []
        for i, value in block_divergences(bounds, column, count, totals, len(names)):
            out += [(sources[i], "pair", sources[j], int(value[j])) for j in range(len(sources)) if j != i]
            own = slice(bounds[i], bounds[i + 1])
            p, q = share(count[own], totals[i]), in_lang[column[own]]
            f = part(p, q)
            more = np.flatnonzero(p > q)
            if len(more) > top:  # ties of the last place stay: the terms' order decides among them
                more = more[f[more] >= np.partition(f[more], len(more) - top)[len(more) - top]]
            spelled = names.take(pa.array(column[own][more])).to_pylist()
            best = sorted(zip((-f[more]).tolist(), (s.encode() for s in spelled)))[:top]
            out += [(sources[i], "term", s.decode(), -negative) for negative, s in best]
        lang = table["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string())} | {c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate((("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())))})

    schema = "lang string, source string, part string, item string, value long"
    found = stored.put(rows.unionByName(heads).groupBy("lang", "block").applyInArrow(compare, schema), "divergence-parts")
    stored.drop("divergence-kept", "divergence-sources")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = named.where("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    whole = pairs.unionByName(none).unionByName(found.where("part = 'term'")).withColumn("rank", nth)
    return whole.where(f"part = 'pair' or rank <= {int(top)}")
