"""Best-fit packing of token sequences by matching large items first.

Only lengths matter to a packing, and there are at most as many lengths as a
sequence has places. So the plan is made from the counts by length: one large
item (over a third of the capacity) is matched with the largest that fits
beside it, and smaller ones go into the tightest gap that takes them. The plan
is a list of runs, `items r0..r1 of this length go to sequences from s0 on,
per sequence so many, from this place on`. Each step of it uses up a length or
a kind of gap, so its size depends on the capacity alone and not on the number
of documents. Items find their run by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .codec import json_encoding, packed
from .common import Scratch, parallelism, text_of

CAPACITY = 2048
#: Parts of a length, among which its ranks are dealt: so many to a partition, and of at most so many items each, so that no length is a single task.
PARTS, PART_ROWS = 16, 100_000
PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
RESULT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut_pieces(frames: Iterator[pd.DataFrame], path: str, pattern: str, capacity: int, end_id: int) -> Iterator[pd.DataFrame]:
    """The pieces of each document; of one longer than the capacity, the first takes what is over."""
    ids_of, end = json_encoding(path, pattern), packed([end_id])
    for frame in frames:
        out = []
        for doc_id, row, text in zip(frame["doc_id"], frame["row"], frame["text"], strict=True):
            ids = packed(ids_of(text)) + end
            n = len(ids) // 4
            begin, stop, piece = 0, n % capacity or capacity, 0
            while begin < n:
                out.append((doc_id, row, piece, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])))
                begin, stop, piece = stop, stop + capacity, piece + 1
        yield pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


class Plan:
    """Runs (length, first rank, first sequence, items per sequence, offset of the first) from counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {length: n for length, n in counts.items() if n}
        self.used = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
        self.sizes: list[int] = []  # the gaps there are, ascending
        self.capacity = capacity
        self._match_large()
        self._fit_small()

    def _take(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], first, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _gap(self, size: int, first: int, n: int) -> None:
        if size and n:
            if not self.gaps[size]:
                insort(self.sizes, size)
            self.gaps[size].append((first, n))

    def _match_large(self) -> None:
        """Largest first, each with the largest partner that fits: at most two to a sequence."""
        large = sorted(length for length in self.left if 3 * length > self.capacity)
        while large:
            length = large[-1]
            place = bisect_left(large, self.capacity - length + 1) - 1
            if place < 0:
                n = self.left[length]
                first = self._open(n)
                self._take(length, n, first, 1, 0)
                self._gap(self.capacity - length, first, n)
            elif (partner := large[place]) == length:
                pairs, single = divmod(self.left[length], 2)
                first = self._open(pairs + single)
                self._take(length, 2 * pairs + single, first, 2, 0)
                self._gap(self.capacity - 2 * length, first, pairs)
                self._gap(self.capacity - length, first + pairs, single)
            else:
                n = min(self.left[length], self.left[partner])
                first = self._open(n)
                self._take(length, n, first, 1, 0)
                self._take(partner, n, first, 1, length)
                self._gap(self.capacity - length - partner, first, n)
            large = [x for x in large if self.left[x]]

    def _fit_small(self) -> None:
        """Largest first, each into the tightest gap; a gap takes as many of a length as it holds."""
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                place = bisect_left(self.sizes, length)
                if place == len(self.sizes):
                    size, (first, there) = self.capacity, (self._open(x := -(-n // (self.capacity // length))), x)
                else:
                    size = self.sizes[place]
                    first, there = self.gaps[size].pop()
                    if not self.gaps[size]:
                        self.sizes.pop(place)
                each = size // length
                full = min(there, n // each)
                if full:
                    self._take(length, full * each, first, each, self.capacity - size)
                    self._gap(size - each * length, first, full)
                if full < there and (rest := self.left[length]) and rest < each:
                    self._take(length, rest, first + full, rest, self.capacity - size)
                    self._gap(size - rest * length, first + full, 1)
                    full += 1
                self._gap(size, first + full, there - full)


def placed(frames: Iterator[pd.DataFrame], runs) -> Iterator[pd.DataFrame]:
    """Add sequence_id and offset from an item's length and its rank among that length."""
    table = runs.value
    bounds = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
    for frame in frames:
        length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
        at = np.empty(len(frame), dtype=np.int64)
        for one in np.unique(length):
            low, high = bounds[one], bounds[one + 1]
            which = length == one
            at[which] = low + np.searchsorted(table[low:high, 1], rank[which], side="right") - 1
        run = table[at]
        behind, within = np.divmod(rank - run[:, 1], run[:, 3])
        yield frame.drop(columns=["rank"]).assign(sequence_id=run[:, 2] + behind, offset=run[:, 4] + within * length)


def ranked(pieces: DataFrame, counts: dict[int, int], part_rows: int = PART_ROWS) -> DataFrame:
    """Number the pieces of each length from 0; a length is dealt out in as many parts as its count asks for."""
    spark = pieces.sparkSession
    rows = min(part_rows, max(1, -(-sum(counts.values()) // (PARTS * parallelism(spark)))))
    salts = spark.createDataFrame([(length, -(-n // rows)) for length, n in counts.items()], "length bigint, salts int")  # a row for each length
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.col("salts")).cast("int")).drop("salts")
    sizes = salted.groupBy("length", "salt").count()  # PARTS for each partition and one for each length
    before = sizes.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = salted.withColumn("within", F.row_number().over(W.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
    return within.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "before", "within")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, scratch: Scratch, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its text's ids by the tokenizer's JSON file, which give a special token's name inside
    a text that token's id, and then end_id; one longer than the capacity is
    cut into pieces of it, of which the first may be shorter. A null or empty
    text is end_id alone. Repeated rows are packed as often as they stand there;
    rows without a doc_id are packed too. An empty table gives no rows. Other
    columns are ignored. Sequences are numbered from 0 and have no holes inside.

    Only counts by length go to the driver (at most `capacity` rows) and only
    the plan (a few thousand runs, whatever the input) is broadcast.
    """
    spark = docs.sparkSession
    rows = text_of(docs).withColumn("row", F.monotonically_increasing_id())
    pieces = scratch.keep(rows.mapInPandas(partial(cut_pieces, path=tokenizer_path, pattern=pattern, capacity=capacity, end_id=end_id), PIECES), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(sorted(Plan(counts, capacity).runs), dtype=np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(runs)
    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked(pieces, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(partial(placed, runs=table), columns)
