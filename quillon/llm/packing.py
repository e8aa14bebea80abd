"""Best-fit packing of documents into sequences by exact-complement hashing.

Tasks encode the texts and cut them into pieces; only the pieces' lengths are counted, so the packing is decided on at
most `capacity` counts, whatever the size of the input. Lengths go from long to short. The gap a length leaves is looked
up in an index of the sums of one, of two and of three lengths; a combination that fills it exactly is
consumed as many times as its counts allow. What no combination fills is packed best fit, longest first. Every step
uses up a length, so the plan has a few rows a length at most and is broadcast. Pieces get their place by their rank
among the pieces of their length; ranks are counted in two levels, so no length is sorted in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import small_batches, stored, tidied
from quillon.llm.tokens import encoder

#: Pieces of one length that one task ranks.
SLICE_ROWS = 100_000


class SumIndex:
    """Sums of one, two and three available lengths, by sum.

    Pairs are indexed once: for each sum the larger parts, from long to short. Counts only fall, so what has run out is
    passed over for good. A triple is a length and a pair with the rest of the sum.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, capacity = counts, len(counts) - 1
        lengths = np.nonzero(counts)[0].astype(np.int32)
        n = np.searchsorted(lengths, np.minimum(lengths, capacity - lengths), "right")  # how many lengths fit beside one as the smaller part
        larger = np.repeat(lengths, n)
        sums = larger + lengths[np.arange(len(larger)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((-larger, sums))
        self.larger, ends = larger[order], np.searchsorted(sums[order], np.arange(capacity + 2)).tolist()
        self.at, self.end = ends[:-1], ends[1:]
        self.held: set[int] = set()  # lengths counted as gone for a moment only

    def single(self, total: int) -> list[int] | None:
        return [total] if self.counts[total] > 0 else None

    def pair(self, total: int) -> list[int] | None:
        for at in range(self.at[total], self.end[total]):
            a = int(self.larger[at])
            b = total - a
            if self.counts[a] > 0 and self.counts[b] > (a == b):
                return [a, b]
            if at == self.at[total] and not self.held & {a, b}:
                self.at[total] += 1
        return None

    def triple(self, total: int) -> list[int] | None:
        for a in np.nonzero(self.counts[1:total])[0][::-1] + 1:
            if 3 * a < total:
                return None  # the largest of three is a third at least
            rest = self.without(int(a), self.pair, total - int(a))
            if rest:
                return [int(a), *rest]
        return None

    def without(self, length: int, find, total: int) -> list[int] | None:
        """What find gives for a sum while one piece of a length is in use."""
        new = length not in self.held
        self.counts[length] -= 1
        self.held.add(length)
        found = find(total)
        self.counts[length] += 1
        if new:
            self.held.discard(length)
        return found

    def fill(self, gap: int) -> list[int] | None:
        """Lengths that fill the gap exactly; the fewest, and of these the largest first."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan_packing(lengths: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences) so that every counted piece is used once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    plan: list[tuple[list[int], int]] = []

    def use(pattern: list[int]) -> None:
        times = min(int(counts[x]) // k for x, k in Counter(pattern).items())
        for x in pattern:
            counts[x] -= times
        plan.append((pattern, times))

    index = SumIndex(counts)
    for length in range(capacity, 0, -1):
        while counts[length]:
            rest = index.without(length, index.fill, capacity - length) if length < capacity else []
            if rest is None:
                break
            use([length, *rest])
    while counts.any():
        left, pattern, gap = counts.copy(), [], capacity
        while gap:
            fits = np.nonzero(left[1 : gap + 1])[0]
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            pattern.append(best)
            left[best] -= 1
            gap -= best
        use(pattern)
    return plan


@tidied
def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int, special_as_text: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in small_batches(batches, limit=4 << 20):
        rows = []
        for d, x in zip(batch.column(0).to_pylist(), encoder(vocabulary, "space", special_as_text).arrays(batch.column(1))):
            x = np.append(x, np.uint32(end_id))
            for start in range(0, len(x), capacity):
                part = x[start : start + capacity]
                rows.append((d, start // capacity, start, len(part), zlib.crc32(part)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names)


def _placed(batches: Iterator[pa.RecordBatch], keys: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        key = (batch.column("length").to_numpy(zero_copy_only=False) << 44) | rank
        at = np.searchsorted(keys, key, side="right") - 1
        sequence = first[at] + (key - keys[at])
        keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.record_batch([*keep, pa.array(sequence), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A special token's string in a text gives that token, as the library has it; with special_as_text it is ordinary text.

    A document is its token ids and end_id (null or empty text: end_id alone); one of more than `capacity` ids is cut
    into pieces of that length, the last of which may be shorter. Sequences hold at most `capacity` ids without gaps.
    Null ids and repeated rows are documents of their own. Equal rows may swap places; all else is the same at any
    partitioning. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInArrow(partial(_pieces, vocabulary=vocabulary, end_id=end_id, capacity=capacity, special_as_text=special_as_text), "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = stored(cut, "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slices = -(-max(lengths.values(), default=1) // SLICE_ROWS)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    totals = stored(cut.groupBy("length", "slice").agg(F.count("*").alias("n")), "piece-counts")
    keys, first, offsets, used, sequence = [], [], [], Counter(), 0
    for pattern, times in plan_packing(lengths, capacity):
        place = 0
        for length in pattern:
            keys.append(length << 44 | used[length])
            first.append(sequence)
            offsets.append(place)
            used[length] += times
            place += length
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64))
    tables = {"keys": np.array(keys, dtype=np.int64)[order], "first": np.array(first, dtype=np.int64)[order], "offsets": np.array(offsets, dtype=np.int64)[order]}
    below = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "slice", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own)).join(bases, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_placed, **tables), out)
