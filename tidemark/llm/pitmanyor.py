"""Language-model scoring with a hierarchical Pitman-Yor model of words and the words before them.

Each context (the word before) is a restaurant whose dishes are the words that follow it; a dish's n
customers are its occurrences in training texts, seated at t tables. A table sends one customer to the
parent restaurant that all contexts share, whose own base is uniform over the known words and one more.
With discount d, concentration s, c customers and T tables in a restaurant, its prediction is

    (n - d t) / (s + c)  +  (s + d T) / (s + c) * parent's prediction.

Table counts are sampled by Gibbs, a dish at a time: given the rest, P(t) is proportional to S_d(n, t) a^t,
with S_d the generalised Stirling numbers and a = (s + d T) * parent's prediction. Up to EXACT customers
the numbers come from their recurrence, beyond that from a series or the saddle point of their generating
function, at 33 counts about the likeliest, so that a dish of a billion customers costs no more than one of
hundreds. Within a sweep dishes are independent given their
restaurant's table count and the parent's prediction after the sweep before, so a restaurant of any size
is spread over all tasks. Several chains run side by side, and what is used is the mean of their
predictions. Draws are functions of the dish, the sweep and the chain: a task that is run again draws the
same seats.

Discounts come from the numbers of dishes with one and two customers; a concentration is the grid value
under which the restaurants' table counts are likeliest, chosen anew after every sweep.

Scale: texts are cut once, in blocks of about BLOCK bytes. Contexts are dealt over the lines of one side of a
square by their codes, words over those of the other; a pair lies in the cell where its two lines cross, so
that the pairs of a frequent word are spread over a line's cells. Cells grow in number with the input. Between
blocks, cells and lines numbers travel in packed arrays: a block sends each cell its pairs once, a sweep sends
each cell the state of the contexts and words that it has, and each line the sums of what was drawn, and at the
end each block gets the predictions of its pairs, in SLICES passes, each for a part of the cells, so that the
disk holds a part of them at a time. The last seats are stored. Words are 64-bit codes. Nothing is collected but sums.

Edge cases: a null text is empty; an empty text is its end token; rows that repeat a doc_id are scored
each for itself; a null doc_id is learned from; without training texts every word is unknown and has
probability 1; an empty table gives an empty result; a column ``held_out`` must be there, others are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, mix, settings, small_batches, text_chunks, words

SLICES = 8
CHAINS = 4
SWEEPS = 3
EXACT = 256
PLACES = 16  # table counts tried on either side of about the likeliest, for dishes of more customers
GRID = np.exp2(np.arange(-6, 25, dtype=np.float64))
CHUNK = 1 << 20
BLOCK = 8 << 20  # bytes of text whose pairs are counted together
CELL_BYTES = 16 << 20  # bytes of text for each cell of pairs
STEP = 1 << 16  # dishes drawn at once
SHARES = 3  # a line is in 2^SHARES shares, by the first bits of the codes
DENSE = {"spark__sql__parquet__compression__codec": "zstd"}
FEW = DENSE | {"spark__sql__execution__arrow__maxRecordsPerBatch": "32"}  # packed rows in a batch
BEGIN, END = np.uint64(0x8E5B9C3D7A1F2E41), np.uint64(0x3C6EF372FE94F82B)
_STEP, _CHAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
STATE = "array<double>"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


# ---- numbers


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def stirling_table(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(n, t) for n and t up to ``most``: seatings of n customers at t tables, each table weighted by its size."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(most + 1)
    for n in range(most):
        stay = np.where(n - d * t > 0, np.log(np.maximum(n - d * t, 1e-300)), -np.inf) + table[n]
        opened = np.concatenate([[-np.inf], table[n, :-1]])
        table[n + 1] = np.logaddexp(stay, opened)
    return table


def log_stirling(n: np.ndarray, t: np.ndarray, d: float, terms: int = 24) -> np.ndarray:
    """log S_d(n, t) for large n (one a row) and some t of each (a row of them), but for a term of n alone.

    S_d(n, t) = n! / t! * [x^n] ((1 - (1 - x)^d) / d)^t. Where t is small beside n^d, by the binomial series of the power; else at the
    saddle point of the generating function.
    """
    n = np.asarray(n, dtype=np.float64)[:, None]
    t = np.asarray(t, dtype=np.float64)
    k = np.arange(1, terms + 1, dtype=np.float64)
    first = log_gamma(n - d)
    factor = (-1) ** (k + 1) * np.sin(np.pi * d * k) / np.pi * np.exp(log_gamma(1 + d * k) + log_gamma(n - d * k) - first)
    few = t < n**d
    total, ways = np.zeros(t.shape), np.where(few, 1.0, 0.0)
    for j in range(terms):
        ways *= (t - j) / (j + 1)  # t over j + 1, which is 0 for t of j or less
        total += factor[:, j, None] * ways
    out = np.where(few, np.log(np.maximum(total, 1e-300)) + first - log_gamma(n + 1), 0.0)
    row, place = np.nonzero(~few)
    out[row, place] = _saddle(n[row, 0], t[row, place], d)
    return out - log_gamma(t + 1) - t * np.log(d)


def _saddle(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    middle = _falling(lambda y, ly: t * -np.expm1(ly) * d * y ** (d - 1) > n * -np.expm1(d * ly), n.shape)
    y, x = np.exp(middle), -np.expm1(middle)
    g = -np.expm1(d * middle)
    bend = n * np.maximum(1 + x * ((1 - d) / y - d * y ** (d - 1) / g), 1e-12)
    return t * np.log(g) - n * np.log(x) - 0.5 * np.log(2 * np.pi * bend)


def _falling(above, shape: tuple) -> np.ndarray:
    """log y at which ``above(y, log y)`` turns false, by halving."""
    low, high = np.full(shape, -90.0), np.full(shape, -1e-9)
    for _ in range(25):
        middle = (low + high) / 2
        more = above(np.exp(middle), middle)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return (low + high) / 2


def likeliest(n: np.ndarray, mass: np.ndarray, d: float) -> np.ndarray:
    """About the mode of S_d(n, t) mass^t in t: where both n's saddle point and t are stationary, mass x (1 - x)^(d - 1) = n."""
    at = _falling(lambda y, ly: mass * -np.expm1(ly) * y ** (d - 1) > n, n.shape)
    return np.clip(np.round(mass * -np.expm1(d * at) / d), 1, n)


def uniform(code: np.ndarray, sweep: int, chain: int) -> np.ndarray:
    """A number in (0, 1) for each dish, fixed by its code, the sweep and the chain."""
    with np.errstate(over="ignore"):
        mixed = mix(code + _STEP * np.uint64(sweep + 1) + _CHAIN * np.uint64(chain + 1))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _picked(logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The column that a uniform number picks in each row of unnormalised log weights."""
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    total = np.cumsum(weight, axis=1)
    return np.minimum((total < (u * total[:, -1])[:, None]).sum(axis=1), logs.shape[1] - 1)


def draw_tables(n: np.ndarray, mass: np.ndarray, u: np.ndarray, d: float, table: np.ndarray) -> np.ndarray:
    """One Gibbs draw of each dish's table count: ``n`` customers, ``mass`` of opening a table, ``u`` uniform."""
    t = np.minimum(n, 1)
    log_mass = np.log(np.maximum(mass, 1e-300))
    low = 2
    while low <= EXACT:  # dishes of about the same size at once, so that matrices stay narrow
        high = min(2 * low - 1, EXACT) if low > 2 else 3
        rows = np.flatnonzero((n >= low) & (n <= high))
        counts = np.arange(1, high + 1)
        for a in range(0, len(rows), 1 << 13):
            some = rows[a : a + (1 << 13)]
            t[some] = 1 + _picked(table[n[some], 1 : high + 1] + counts * log_mass[some, None], u[some])
        low = high + 1
    rows = np.flatnonzero(n > EXACT)
    for a in range(0, len(rows), 1 << 10):
        some = rows[a : a + (1 << 10)]
        size, own = n[some].astype(np.float64), np.exp(log_mass[some])
        centre = likeliest(size, own, d)
        stride = np.maximum(1, np.ceil(6 * np.sqrt(centre) / PLACES))
        first = np.maximum(1, centre - PLACES * stride)
        counts = np.minimum(first[:, None] + stride[:, None] * np.arange(2 * PLACES + 1), size[:, None])
        t[some] = counts[np.arange(len(some)), _picked(log_stirling(size, counts, d) + counts * log_mass[some, None], u[some])].astype(np.int64)
    return t


# ---- tokens


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, its context and its code (the word or END), and the first token of each text (one entry more than texts)."""
    _, _, _, code, first = words(texts)
    token = np.insert(code, first[1:], END)
    bounds = first + np.arange(len(first))
    before = np.concatenate([[BEGIN], token[:-1]]).astype(np.uint64)
    before[bounds[:-1]] = BEGIN
    return before, token, bounds


def pair_code(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return before ^ ((token << np.uint64(17)) | (token >> np.uint64(47)))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.reshape(-1).astype(np.float64)))


# ---- packed rows
#
# Between stages numbers travel as rows (to, kind, frm, parts): the group they are for, what they are, where they come from, and arrays.


ROWS = "to long, kind int, frm long, parts array<binary>"


def packed(values: np.ndarray) -> bytes:
    """An array as bytes, whole numbers that are not negative in as few as the largest needs."""
    if values.dtype.kind in "iu" and values.dtype != np.uint64:
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return values.dtype.char.encode().ljust(8) + values.tobytes()


def unpacked(part) -> np.ndarray:
    data = part.as_buffer()
    return np.frombuffer(data, dtype=bytes(data[:1]).decode(), offset=8)


def _parts(row) -> list[np.ndarray]:
    return [unpacked(p) for p in row.values]


def _messages(rows: list[tuple[int, int, int, list[np.ndarray]]]) -> pa.RecordBatch:
    to, kind, frm, parts = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int64()), pa.array(kind, pa.int32()), pa.array(frm, pa.int64()), pa.array([[packed(p) for p in ps] for ps in parts], pa.list_(pa.binary()))],
        names=["to", "kind", "frm", "parts"],
    )


def _received(table: pa.Table) -> list[tuple[int, int, list[np.ndarray]]]:
    """(kind, frm, arrays) of a group's rows, in that order."""
    rows = zip(table["kind"].to_pylist(), table["frm"].to_pylist(), table["parts"])
    return [(kind, frm, _parts(parts)) for kind, frm, parts in sorted(rows, key=lambda r: r[:2])]


def _row(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    """One row; arrays are packed."""
    pack = lambda v: packed(v) if isinstance(v, np.ndarray) else [packed(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], np.ndarray) else v
    return pa.RecordBatch.from_arrays([pa.array([pack(values[f.name])], f.type) for f in schema], schema=schema)


def _spark_types(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.float64()): "array<double>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _fields(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def sent(df: DataFrame, to: str, kind: int, frm: str, *parts: str) -> DataFrame:
    """Rows of a table with packed columns as rows to a group."""
    return df.select(F.col(to).cast("long").alias("to"), F.lit(kind).alias("kind"), F.col(frm).cast("long").alias("frm"), F.array(*parts).alias("parts"))


# ---- blocks of texts, cells of pairs


def cells_of(before: np.ndarray, token: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The line of each context and that of each word; a pair's cell is where they cross."""
    with np.errstate(over="ignore"):
        return (mix(before + _STEP) % np.uint64(side)).astype(np.int64), (mix(token + _CHAIN) % np.uint64(side)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(ids, held out, texts without nulls) of about BLOCK bytes of text."""
    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for at, chunk in text_chunks(batch["text"], CHUNK):
            ids.append(batch["doc_id"].slice(at, len(chunk)))
            held.append(batch["held_out"].slice(at, len(chunk)))
            texts.append(chunk)
            size += chunk.nbytes
            if size >= BLOCK:
                yield pa.concat_arrays(ids), pa.concat_arrays(held), pa.concat_arrays(texts)
                ids, held, texts, size = [], [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(held), pa.concat_arrays(texts)


def _in_order(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by line, and each word's place in it."""
    order = np.argsort(lines, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return order, place


def block_rows(docs: DataFrame, side: int, slices: int) -> DataFrame:
    """Each block's distinct pairs with their counts in training texts and its tokens, by cell (what: pairs-PART, posts-PART), and its documents (what: docs)."""

    def cut(ids: pa.Array, held: pa.Array, texts: pa.Array):
        before, token, bounds = word_pairs(texts)
        lengths = np.diff(bounds)
        held = np.array(held.fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        vocab, which = np.unique(np.concatenate([token, [BEGIN]]).astype(np.uint64), return_inverse=True)
        w = which[:-1]
        u = np.concatenate([which[-1:], w[:-1]])
        u[bounds[:-1]] = which[-1]
        a, b = cells_of(vocab, vocab, side)
        (by_a, at_a), (by_b, at_b) = _in_order(a), _in_order(b)
        size = len(vocab)
        cell, key = a[u] * side + b[w], at_a[u] * size + at_b[w]
        order = np.argsort(cell * size**2 + key, kind="stable") if (side * size) ** 2 < 1 << 63 else np.lexsort((key, cell))
        of_token, key = cell.astype(np.uint16 if side < 256 else np.int64), key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        pair = np.empty(len(key), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        n = np.add.reduceat((~held[text_of])[order].astype(np.int64), first)
        cell = cell[order[first]]
        pu, pw = np.divmod(key[first], size)
        starts = np.searchsorted(cell, np.arange(side * side + 1))
        by_cell = np.argsort(of_token, kind="stable")
        ends = np.cumsum(np.concatenate([[0], np.bincount(of_token, minlength=side * side)]))
        place, doc = pair[by_cell], text_of[by_cell]
        code_a, code_b, line_b = vocab[by_a], vocab[by_b], np.searchsorted(b[by_b], np.arange(side + 1))
        numbers = np.array(ids.fill_null(0).to_numpy(), dtype=np.int64).view(np.uint64)
        yield "docs", -1, [numbers, np.asarray(ids.is_valid()).astype(np.uint8), held.astype(np.uint8), lengths]
        for c in np.flatnonzero(np.diff(starts)).tolist():
            at, to = starts[c], starts[c + 1]
            run = np.flatnonzero(np.concatenate([[True], pu[at + 1 : to] != pu[at : to - 1]]))
            low, high = line_b[c % side], line_b[c % side + 1]
            here = np.zeros(high - low, dtype=bool)
            here[pw[at:to] - low] = True
            yield f"pairs-{c % slices}", c, [code_a[pu[at:to][run]], np.diff(np.append(run, to - at)), code_b[low:high][here], (np.cumsum(here) - 1)[pw[at:to] - low], n[at:to]]
            yield f"posts-{c % slices}", c, [np.diff(doc[ends[c] : ends[c + 1]], prepend=0), place[ends[c] : ends[c + 1]] - at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, block in enumerate(_blocks(batches)):
            name = (TaskContext.get().partitionId() << 32) + nth
            rows = list(cut(*block))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[packed(p) for p in r[2]] for r in rows], pa.list_(pa.binary()))],
                names=["what", "block", "cell", "parts"],
            )

    return docs.mapInArrow(run, "what string, block long, cell long, parts array<binary>")


CELL = _fields(
    cell=pa.int64(), us=pa.binary(), ws=pa.binary(), runs=pa.binary(), iw=pa.binary(), n=pa.binary(), blocks=pa.binary(), sizes=pa.binary(), pair=pa.binary(),
    u_sums=pa.binary(), w_sums=pa.binary(), du=pa.binary(), dw=pa.binary(), dish_u=pa.binary(), dish_w=pa.binary(), dish_n=pa.binary(), total=pa.int64(), ones=pa.int64(), twos=pa.int64(),
)


def cells(pairs: DataFrame) -> DataFrame:
    """A row for each cell: its contexts (us) and words (ws), its pairs in their order, where each block's pairs lie among them,
    sums by context and by word, and the dishes of several customers with their contexts (du, in us) and words (dw, in ws)."""

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["block"].to_pylist(), table["parts"]), key=lambda r: r[0])
        every = [_parts(parts) for _, parts in rows]
        us, at_u = np.unique(np.concatenate([p[0] for p in every]), return_inverse=True)
        ws, at_w = np.unique(np.concatenate([p[2] for p in every]), return_inverse=True)
        sizes = np.array([len(p[3]) for p in every])
        u = np.repeat(at_u, np.concatenate([p[1] for p in every]))
        shift = np.cumsum([0] + [len(p[2]) for p in every[:-1]])
        w = at_w[np.concatenate([p[3].astype(np.int64) for p in every]) + np.repeat(shift, sizes)]
        key = u * len(ws) + w
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        pair = np.empty(len(key), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        n = np.add.reduceat(np.concatenate([p[4].astype(np.int64) for p in every])[order], first)
        iu, iw = np.divmod(key[first], len(ws))
        sums = lambda i, size: np.concatenate([np.bincount(i, v, size) for v in (n, n > 0, n == 1)]).astype(np.int64)
        many = np.flatnonzero(n > 1)
        (du, dish_u), (dw, dish_w) = (np.unique(i[many], return_inverse=True) for i in (iu, iw))
        found = dict(cell=table["cell"][0].as_py(), us=us, ws=ws, runs=np.bincount(iu, minlength=len(us)), iw=iw, n=n, blocks=np.array([b for b, _ in rows]), sizes=sizes, pair=pair)
        found |= dict(u_sums=sums(iu, len(us)), w_sums=sums(iw, len(ws)), du=du, dw=dw, dish_u=dish_u, dish_w=dish_w, dish_n=n[many], total=int(n.sum()), ones=int((n == 1).sum()), twos=int((n == 2).sum()))
        return pa.Table.from_batches([_row(CELL, found)])

    return pairs.select("block", "cell", "parts").groupBy("cell").applyInArrow(merged, _spark_types(CELL))


# ---- the sampler


LINE = _fields(
    line=pa.int64(), codes=pa.binary(), c=pa.binary(), singles=pa.binary(), tables=pa.binary(), drawn=pa.binary(), cells=pa.binary(), every=pa.list_(pa.binary()), dishes=pa.list_(pa.binary()),
    known=pa.int64(), ones=pa.int64(), twos=pa.int64(), sent_sum=pa.list_(pa.float64()), drawn_sum=pa.list_(pa.float64()), fit=pa.list_(pa.float64()),
)


def _rows_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch[name][k] for name in batch.schema.names}


def _matrix(part) -> np.ndarray:
    """Table counts, a row a chain."""
    return unpacked(part).reshape(CHAINS, -1)


def _told_of(rows: list, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """What a cell's lines say of its codes, in their order: a number each, and the state, a row a chain."""
    parts = [p for k, _, p in rows if k == kind]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1].reshape(CHAINS, -1) for p in parts], axis=1)


def in_shares(codes: np.ndarray) -> np.ndarray:
    """Where each share of a line begins in sorted codes (one entry more than shares)."""
    return np.searchsorted((codes >> np.uint64(64 - SHARES)).astype(np.int64), np.arange((1 << SHARES) + 1))


def seats(code: np.ndarray, n: np.ndarray, tables: np.ndarray, parent: np.ndarray, d: float, s: float, sweep: int, table: np.ndarray) -> np.ndarray:
    """Each dish's table counts, a row a chain, given its restaurant's ``tables`` and the ``parent``'s prediction."""
    found = np.empty((CHAINS, len(n)), dtype=np.int64)
    for chain in range(CHAINS):
        mass = (s + d * np.maximum(tables[chain].astype(np.float64) - 1, 0)) * parent[chain]
        found[chain] = draw_tables(n, mass, uniform(code, sweep, chain), d, table)
    return found


def fits(c: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """The log likelihood of restaurants' table counts (mean of chains) at each concentration of the grid."""
    mean = np.round(tables.mean(axis=0)).astype(np.int64)
    pair, times = np.unique((c.astype(np.int64) << 32) + mean if c.max(initial=0) < 1 << 31 else c + 1j * mean, return_counts=True)
    c, tables = (pair.real, pair.imag) if pair.dtype.kind == "c" else ((pair >> 32).astype(np.float64), (pair & 0xFFFFFFFF).astype(np.float64))
    return np.array([((((tables - 1) * np.log(d) + log_gamma(s / d + tables) - log_gamma(s / d + 1) - log_gamma(s + c) + log_gamma(s + 1))) * times).sum() for s in GRID])


def discount(one: int, two: int) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


class Model:
    """Pairs in cells where a line of contexts and a line of words cross, and the state of the lines.

    A sweep sends each cell the table counts of its contexts and the predictions of its words, draws, and sends each line the
    sums of what was drawn; so nothing is sent a pair at a time, and a frequent word's pairs lie in all cells of its line.
    """

    def __init__(self, stored: Stored, cells_: list[DataFrame], side: int):
        self.stored, self.cells, self.side, self.sweep, self.slices = stored, cells_, side, 0, len(cells_)
        self.every = reduce(DataFrame.unionByName, cells_)
        sizes = self.every.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("total", "ones", "twos"))).first()
        self.n_tokens, self.d = sizes[0], discount(sizes[1], sizes[2])
        self.table = stirling_table(self.d)
        lines = stored.put(self._lines(), "py-lines-new")
        sizes = lines.where(F.col("line") >= side << SHARES).agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("known", "ones", "twos"))).first()
        self.n_words, self.root_d = sizes[0], discount(sizes[1], sizes[2])
        self.root_table, self.root_s, self.root_tables = stirling_table(self.root_d), 1.0, np.full(CHAINS, float(self.n_words))
        settle = self._settled()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for line in _rows_of(batches):
                yield settle(line, _matrix(line["tables"]))

        self._take(lines.mapInArrow(run, _spark_types(LINE)), 0)
        stored.drop("py-lines-new")

    def _lines(self) -> DataFrame:
        """Every line's codes, sums over its cells, and the places of each cell's codes, and of its dishes' codes, among them."""
        side = self.side

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows_of(batches):
                cell = row["cell"].as_py()
                for line, *names in ((cell // side, "us", "u_sums", "du"), (side + cell % side, "ws", "w_sums", "dw")):
                    codes, sums, dishes = (unpacked(row[k]) for k in names)
                    ends, of_dishes = in_shares(codes), in_shares(codes[dishes])
                    for share in np.flatnonzero(np.diff(ends)).tolist():
                        here = slice(ends[share], ends[share + 1])
                        yield _messages([((line << SHARES) + share, 0, cell, [codes[here], sums.reshape(3, -1)[:, here].reshape(-1), dishes[of_dishes[share] : of_dishes[share + 1]] - ends[share]])])


        def merged(table: pa.Table) -> pa.Table:
            rows = _received(table)
            codes, at = np.unique(np.concatenate([p[0] for *_, p in rows]), return_inverse=True)
            sums = np.concatenate([p[1].reshape(3, -1) for *_, p in rows], axis=1)
            c, k, singles = (np.bincount(at, v, len(codes)).astype(np.int64) for v in sums)
            every = np.split(at, np.cumsum([len(p[0]) for *_, p in rows])[:-1])
            found = dict(line=table["to"][0].as_py(), codes=codes, c=c, singles=singles, tables=np.tile(k, CHAINS), drawn=np.zeros(0, dtype=np.int64), cells=np.array([f for _, f, _ in rows]), every=every)
            found |= dict(dishes=[e[p[2]] for e, (*_, p) in zip(every, rows)], known=int((c > 0).sum()), ones=int((k == 1).sum()), twos=int((k == 2).sum()), sent_sum=None, drawn_sum=None, fit=None)
            return pa.Table.from_batches([_row(LINE, found)])

        asked = self.every.select("cell", "us", "ws", "u_sums", "w_sums", "du", "dw").mapInArrow(run, ROWS)
        return asked.groupBy("to").applyInArrow(merged, _spark_types(LINE))

    def _settled(self):
        """A line after its table counts have changed: words' seats in the parent restaurant are drawn, contexts' table counts weighed."""
        side, d, root_d, s, table, sweep, mass_of = self.side, self.d, self.root_d, self.root_s, self.root_table, self.sweep, self.root_tables
        unknown = 1 / (self.n_words + 1)

        def settle(line: dict, tables: np.ndarray) -> pa.RecordBatch:
            found = {k: v.as_py() for k, v in line.items()} | {"tables": tables.reshape(-1)}
            if found["line"] < side << SHARES:
                c = unpacked(line["c"])
                found["fit"] = fits(c[c > 0].astype(np.int64), tables[:, c > 0], d).tolist()
            else:
                code, drawn = unpacked(line["codes"]), np.empty(tables.shape, dtype=np.int64)
                for chain in range(CHAINS):
                    mass = np.full(len(code), (s + root_d * max(mass_of[chain] - 1, 0)) * unknown)
                    drawn[chain] = draw_tables(tables[chain].astype(np.int64), mass, uniform(~code, sweep, chain), root_d, table)
                found |= {"drawn": drawn.reshape(-1), "sent_sum": tables.sum(axis=1).astype(float).tolist(), "drawn_sum": drawn.sum(axis=1).astype(float).tolist()}
            return _row(LINE, found)

        return settle

    def _take(self, lines: DataFrame, nth: int) -> None:
        """Store the lines of a sweep and set what follows from their sums."""
        self.lines = self.stored.put(lines, f"py-lines-{nth}")
        total = lambda name, size: F.array(*(F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0.0)) for k in range(size))).alias(name)
        sums = self.lines.agg(total("sent_sum", CHAINS), total("drawn_sum", CHAINS), total("fit", len(GRID))).first()
        customers, tables, fit = (np.array(sums[k]) for k in ("sent_sum", "drawn_sum", "fit"))
        self.s = float(GRID[np.argmax(fit)]) if self.n_words else 1.0
        d, unknown = self.root_d, 1 / (self.n_words + 1)
        fit = (tables.mean() - 1) * np.log(d) + log_gamma(GRID / d + tables.mean()) - log_gamma(GRID / d + 1) - log_gamma(GRID + customers.mean()) + log_gamma(GRID + 1)
        self.root_tables, self.root_s = tables, float(GRID[np.argmax(fit)]) if tables.mean() >= 1 else 1.0
        self.customers = customers
        self.unknown = [float((self.root_s + d * t) / (self.root_s + c) * unknown) for t, c in zip(tables, customers)]

    def _share(self):
        """The parent's prediction of a line's words, a row a chain."""
        d, s, customers, unknown = self.root_d, self.root_s, self.customers[:, None], np.array(self.unknown)[:, None]
        return lambda line: (_matrix(line["tables"]) - d * _matrix(line["drawn"])) / (s + customers) + unknown

    def _told(self, dishes: bool, part: int | None = None) -> DataFrame:
        """What the cells (of a part) get from their lines (kinds 1: contexts, 2: words): of dishes' codes their places in the line, else customers; and the state."""
        side, share, slices = self.side, self._share(), self.slices

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for line in _rows_of(batches):
                nth, c = line["line"].as_py(), unpacked(line["c"])
                words = nth >= side << SHARES
                state = share(line) if words else _matrix(line["tables"])
                for cell, places in zip(unpacked(line["cells"]).tolist(), line["dishes" if dishes else "every"].values):
                    if part is None or cell % slices == part:
                        at = unpacked(places)
                        if len(at):
                            yield _messages([(cell, 1 + words, nth, [at if dishes else c[at], state[:, at].reshape(-1)])])

        columns = ["line", "c", "tables", "drawn", "cells", "dishes" if dishes else "every"]
        return self.lines.select(*columns).mapInArrow(run, ROWS)

    def draw(self) -> None:
        """A sweep over all dishes of two or more customers (a single customer has one table), then over the parent's."""
        d, s, table, sweep = self.d, self.s, self.table, self.sweep
        dishes = sent(self.every.where(F.length("du") > 8), "cell", 0, "cell", "us", "ws", "du", "dw", "dish_u", "dish_w", "dish_n")

        def seated(group: pa.Table) -> pa.Table:
            rows = _received(group)
            _, cell, (us, ws, du, dw, u, w, n) = rows[0]
            (_, tables), (_, share) = _told_of(rows, 1), _told_of(rows, 2)
            code, n = pair_code(us[du][u], ws[dw][w]), n.astype(np.int64)
            t = np.empty((CHAINS, len(n)), dtype=np.int64)
            for at in range(0, len(n), STEP):
                here = slice(at, at + STEP)
                t[:, here] = seats(code[here], n[here], tables[:, u[here]], share[:, w[here]], d, s, sweep, table)
            back = [(cell, 0, cell, [t.reshape(-1)])]
            for kind, i in ((1, u), (2, w)):
                told = [(line, p[0]) for k, line, p in rows if k == kind]
                ends = np.cumsum([len(places) for _, places in told])
                drawn = np.stack([np.bincount(i, x, ends[-1]) for x in t]).astype(np.int64)
                back += [(line, kind, cell, [places, drawn[:, e - len(places) : e].reshape(-1)]) for (line, places), e in zip(told, ends.tolist())]
            return pa.Table.from_batches([_messages(back)])

        groups = dishes.unionByName(self._told(True)).groupBy("to")
        self.stored.drop("py-seats")
        self.seated = self.stored.put(groups.applyInArrow(seated, ROWS), "py-seats")
        settle = self._settled()
        names = LINE.names

        def summed(group: pa.Table) -> pa.Table:
            """A line and the sums that its cells send; the columns of the line are null in their rows."""
            own = [k for k, line in enumerate(group["line"].to_pylist()) if line is not None][0]
            line = {name: group[name][own] for name in names}
            tables = np.tile(unpacked(line["singles"]).astype(np.int64), (CHAINS, 1))
            for parts in group["parts"]:
                if parts.is_valid:
                    at, drawn = _parts(parts)
                    tables[:, at] += drawn.reshape(CHAINS, -1).astype(np.int64)
            return pa.Table.from_batches([settle(line, tables)])

        back = self.seated.where("kind > 0").select("to", "parts")
        every = self.lines.withColumn("to", F.col("line")).unionByName(back, allowMissingColumns=True)
        self._take(every.groupBy("to").applyInArrow(summed, _spark_types(LINE)), self.sweep + 1)
        self.stored.drop(f"py-lines-{self.sweep}")
        self.sweep += 1

    # what a cell's pairs are worth

    def _valued(self, part: int, schema: str, result) -> DataFrame:
        """``result(cell, arrays, log10 of the chains' mean prediction of each pair, training count of its word)`` of each cell of a part."""
        d, s = self.d, self.s
        own = sent(self.cells[part], "cell", 0, "cell", "us", "ws", "runs", "iw", "n", "blocks", "sizes", "pair")
        drawn = self.seated.where((F.col("kind") == 0) & (F.col("to") % self.slices == part)).withColumn("kind", F.lit(3))

        def valued(group: pa.Table) -> pa.Table:
            rows = _received(group)
            _, cell, own = rows[0]
            (c, tables), (count, share) = _told_of(rows, 1), _told_of(rows, 2)
            _, _, runs, iw, n, *_ = own
            n = n.astype(np.int64)
            iu = np.repeat(np.arange(len(runs)), runs)
            many, one = np.flatnonzero(n > 1), np.minimum(n, 1)
            c = c[iu].astype(np.float64)
            total = np.zeros(len(n))
            for chain in range(CHAINS):
                t = one.copy()
                if len(many):
                    t[many] = rows[-1][2][0].reshape(CHAINS, -1)[chain]
                total += (n - d * t) / (s + c) + ((s + d * tables[chain])[iu]) / (s + c) * share[chain][iw]
            return result(cell, own, np.log10(total / CHAINS), count[iw].astype(np.int64))

        return own.unionByName(drawn).unionByName(self._told(False, part)).groupBy("to").applyInArrow(valued, schema)

    def answers(self, part: int) -> DataFrame:
        """To each block, for its pairs in each cell of the part: score, and training count of the word."""

        def result(cell: int, own: list[np.ndarray], score: np.ndarray, count: np.ndarray) -> pa.Table:
            *_, blocks, sizes, pair = own
            ends = np.cumsum(sizes, dtype=np.int64)
            return pa.Table.from_batches([_messages([(b, 1, cell, [score[pair[e - size : e]], count[pair[e - size : e]]]) for b, e, size in zip(blocks.tolist(), ends.tolist(), sizes.tolist())])])

        return self._valued(part, ROWS, result)

    def predictions(self, part: int) -> DataFrame:
        """code, score, base, known of each pair of a part: log10 of the chains' mean prediction, and of the word's smoothed share."""
        total = self.n_tokens + self.n_words + 1

        def result(cell: int, own: list[np.ndarray], score: np.ndarray, count: np.ndarray) -> pa.Table:
            us, ws, runs, iw, *_ = own
            return pa.table([_long(pair_code(np.repeat(us, runs), ws[iw])), score, np.log10((count + 1) / total), (count > 0).astype(np.int64)], names=["code", "score", "base", "known"])

        return self._valued(part, "code long, score double, base double, known long", result)

    # the state, row by row

    @property
    def pairs(self) -> list[DataFrame]:
        """u, w, n of the pairs of each part; n is 0 for pairs of held-out texts only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell in _rows_of(batches):
                us, ws, runs, iw, n = (unpacked(cell[k]) for k in ("us", "ws", "runs", "iw", "n"))
                yield pa.RecordBatch.from_arrays([_long(np.repeat(us, runs)), _long(ws[iw]), pa.array(n.astype(np.int64))], names=["u", "w", "n"])

        return [c.select("us", "ws", "runs", "iw", "n").mapInArrow(run, "u long, w long, n long") for c in self.cells]

    def _listed(self, words: bool, names: list[str]) -> DataFrame:
        share = self._share()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for line in _rows_of(batches):
                c, state = unpacked(line["c"]), share(line) if words else _matrix(line["tables"])
                yield pa.RecordBatch.from_arrays([_long(unpacked(line["codes"])[c > 0]), pa.array(c[c > 0].astype(np.int64)), _lists(state.T[c > 0])], names=names)

        return self.lines.where((F.col("line") >= self.side << SHARES) == F.lit(words)).mapInArrow(run, f"{names[0]} long, {names[1]} long, {names[2]} {STATE}")

    @property
    def contexts(self) -> DataFrame:
        """u, c, tables of the contexts of training texts."""
        return self._listed(False, ["u", "c", "tables"])

    @property
    def words(self) -> DataFrame:
        """w, count, share of the words of training texts."""
        return self._listed(True, ["w", "count", "share"])


def fit(docs: DataFrame, stored: Stored, slices: int = SLICES, sweeps: int = SWEEPS) -> Model:
    """The model of the rows (doc_id, text, held_out) that are not held out; its pairs cover the others' too."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    side = math.ceil(math.sqrt(max(size / CELL_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)))
    slices = min(slices, side * side)
    with settings(spark, **DENSE):
        blocks = stored.put_split(block_rows(docs, side, slices), "py-blocks", "what", ["docs", *(f"{k}-{p}" for k in ("pairs", "posts") for p in range(slices))])
    merged = []
    with settings(spark, **FEW):
        for part in range(slices):
            merged.append(stored.put(cells(blocks[f"pairs-{part}"]), f"py-cells-{part}"))
            stored.drop(f"py-blocks-pairs-{part}")
        model = Model(stored, merged, side)
        model.blocks = blocks
        for _ in range(sweeps):
            model.draw()
    return model


def text_sums(posts: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """Of each block's texts, the sums over their tokens in the cells of a part: score, base and known words."""

    def summed(group: pa.Table) -> pa.Table:
        rows = _received(group)
        told = {cell: parts for kind, cell, parts in rows if kind == 1}
        doc, score, count = [], [], []
        for kind, cell, parts in rows:
            if kind == 0:
                step, at = parts
                doc.append(np.cumsum(step, dtype=np.int64))
                score.append(told[cell][0][at])
                count.append(told[cell][1][at])
        doc, count = np.concatenate(doc), np.concatenate([c.astype(np.int64) for c in count])
        sums = [np.bincount(doc, x) for x in (np.concatenate(score), np.log10((count + 1) / total), (count > 0).astype(np.float64))]
        return pa.Table.from_batches([_messages([(group["to"][0].as_py(), 1, 0, sums)])])

    return sent_parts(posts, 0).unionByName(answers).groupBy("to").applyInArrow(summed, ROWS)


def sent_parts(blocks: DataFrame, kind: int) -> DataFrame:
    return blocks.select(F.col("block").alias("to"), F.lit(kind).alias("kind"), F.col("cell").alias("frm"), "parts")


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int = SLICES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    small_batches(docs.sparkSession)
    stored = Stored(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    model = fit(docs, stored, slices, sweeps)
    n_tokens, total = model.n_tokens, model.n_tokens + model.n_words + 1
    sums = []
    for part in range(model.slices):  # a text's sums are added in the order of the parts, so that equal texts have equal ones
        with settings(docs.sparkSession, **FEW):
            found = stored.put(text_sums(model.blocks[f"posts-{part}"], model.answers(part), total), "py-sums")
        sums.append(found.withColumn("frm", F.lit(part).cast("long")))
        stored.drop(f"py-blocks-posts-{part}", f"py-cells-{part}")

    def listed(group: pa.Table) -> pa.Table:
        (_, _, (ids, valid, held, lengths)), *parts = _received(group)
        whole = np.zeros((3, len(ids)))
        for *_, found in parts:
            for k, x in enumerate(found):
                whole[k, : len(x)] += x
        columns = [pa.array(ids.view(np.int64), mask=valid == 0), pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64)), pa.array(np.round(whole[2]).astype(np.int64)), pa.array(np.full(len(ids), n_tokens)), pa.array(whole[1]), pa.array(whole[0])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = reduce(DataFrame.unionByName, sums, sent_parts(model.blocks["docs"], 0))
    result = stored.put(rows.groupBy("to").applyInArrow(listed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "py-result")
    stored.drop(*(name for name in list(stored.paths) if name != "py-result"))
    return result


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and that of the words' smoothed shares."""
    per_token = lambda column: F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
