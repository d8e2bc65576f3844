"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest permitted length are cut into pieces of that length and a rest, so no
unit is lost. Items go, longest first, to the open bin with the least room that still takes them; if
none does, a bin is opened. Its length is the one of least cost per unit, by what the items that still
wait would fill of it. At the end each bin shrinks to the smallest permitted length that holds its
contents. As best fit may deal differently than expected, a shard is also packed with bins of no less
than each permitted length, and the cheapest result is kept.

Pieces are dealt into shards by a hash of their row and number, about ``shard_items`` to each, and each
shard is packed on its own: the number of shards follows the number of pieces, a task never holds more
than a shard's numbers, and only lengths travel, never texts.

Edge cases: a null or empty text has length 0 and is a piece of its own that takes no room; rows that
repeat are packed each on its own; a null doc_id is packed like any other; equal lengths go in order
of doc_id and piece; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, told_apart

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
SHARD_ITEMS = 50_000
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, capacity long"


def sequence_cost(capacity: int, quadratic: float = 1 / 65536) -> float:
    """Relative cost of a sequence: a linear part and attention's quadratic part."""
    return capacity * (1 + quadratic * capacity)


class Packer:
    """Best fit over the bins of one shard, in one choice of opened lengths.

    ``least`` is the smallest length that is ever opened; without it each opening takes the length of
    least cost per unit that it is expected to hold. Open bins are kept by the room left in them.
    """

    def __init__(self, capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost, least: int | None = None):
        self.capacities, self.cost, self.least = sorted(capacities), cost, least
        self.rooms: list[int] = []  # distinct rooms of open bins, sorted
        self.bins: dict[int, list[int]] = {}  # room -> bins, the oldest first out
        self.used: list[int] = []

    def _put(self, number: int, room: int) -> None:
        if room <= 0:
            return
        if room not in self.bins:
            self.rooms.insert(bisect_left(self.rooms, room), room)
            self.bins[room] = []
        heapq.heappush(self.bins[room], number)

    def smallest(self, used: int) -> int:
        return self.capacities[bisect_left(self.capacities, used)]

    def expected(self, falling: list[int], k: int, capacity: int) -> int:
        """What a bin of ``capacity`` opened for item ``k`` would hold, if the largest waiting item that fits came next each time.

        ``falling`` are the shard's lengths, largest first, as negative numbers.
        """
        room, k = capacity + falling[k], k + 1
        while room > 0:
            k = bisect_left(falling, -room, k)
            if k == len(falling) or not falling[k]:
                break
            room += falling[k]
            k += 1
        return capacity - room

    def opening(self, falling: list[int], k: int) -> int:
        """The permitted length to open for item ``k``."""
        fitting = self.capacities[bisect_left(self.capacities, -falling[k]) :]
        if self.least:
            return next((c for c in fitting if c >= self.least), fitting[-1])
        price = {}
        for c in fitting:
            holds = self.expected(falling, k, c)
            price[c] = self.cost(self.smallest(holds)) / max(holds, 1)
        return min(fitting, key=lambda c: (price[c], c))

    def pack(self, falling: list[int]) -> tuple[list[int], list[int]]:
        """Each item's bin and its offset there."""
        numbers, offsets = [], []
        for k, negative in enumerate(falling):
            length = -negative
            at = bisect_left(self.rooms, max(length, 1))
            if not length and self.used:
                number, room = len(self.used) - 1, 0
            elif at < len(self.rooms):
                room = self.rooms[at]
                number = heapq.heappop(self.bins[room])
                if not self.bins[room]:
                    del self.bins[room]
                    self.rooms.pop(at)
            else:
                number = len(self.used)
                self.used.append(0)
                room = self.opening(falling, k)
            numbers.append(number)
            offsets.append(self.used[number])
            if length:
                self.used[number] += length
                self._put(number, room - length)
        return numbers, offsets

    def downsized(self) -> list[int]:
        """Each bin's final length: the smallest permitted one that holds its contents."""
        return [self.smallest(u) for u in self.used]


def packed(falling: list[int], capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bins, offsets and the bins' final lengths, from the choice of opened lengths whose final bins cost least.

    The choices are: each bin by expected cost, and no bin under one of the permitted lengths.
    """
    best = None
    for least in (None, *sorted(capacities)):
        packer = Packer(capacities, cost, least)
        numbers, offsets = packer.pack(falling)
        final = packer.downsized()
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, numbers, offsets, final
    return best[1:]


def text_length(text: Column) -> Column:
    """Default length: UTF-8 bytes, the tokens of a byte-level vocabulary without merges."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def pieces(docs: DataFrame, length: Column, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length: each text cut at multiples of the largest capacity."""
    rows = told_apart(docs, F.col(id_col).cast("long").alias("doc_id"), length.alias("total"))
    cut = F.sequence(F.lit(0), (_n_pieces(F.col("total"), capacity) - 1).cast("int"))
    rows = rows.select("doc_id", "total", ROW, F.explode(cut).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).alias("length"), F.pmod(F.xxhash64(ROW, "piece"), F.lit(1 << 30)).alias("spread"))


def _n_pieces(total: Column, capacity: int) -> Column:
    return F.greatest(F.ceil(total / capacity), F.lit(1))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row per piece: where it starts in its text, its bin, its offset there and the bin's final capacity."""
    capacities = tuple(sorted(capacities))
    length = text_length(F.col(text_col)) if length is None else length
    items = pieces(docs, length, capacities[-1], id_col)
    n_pieces = docs.select(length.alias("total")).agg(F.sum(_n_pieces(F.col("total"), capacities[-1]))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_items))

    def pack_shard(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable")
        numbers, offsets, final = packed((-shard["length"]).tolist(), capacities, cost)
        numbers = np.array(numbers, dtype=np.int64)
        return pd.DataFrame(
            {
                "doc_id": shard["doc_id"].astype("Int64"),
                "piece": shard["piece"],
                "start": shard["start"],
                "length": shard["length"],
                "bin_id": (int(key[0]) << 32) + numbers,
                "bin_offset": offsets,
                "capacity": np.array(final, dtype=np.int64)[numbers],
            }
        )

    dealt = items.withColumn("shard", F.pmod("spread", F.lit(shards)).cast("long")).drop("spread")
    return dealt.groupBy("shard").applyInPandas(pack_shard, SCHEMA)
