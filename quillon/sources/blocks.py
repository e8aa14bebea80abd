"""Records that go over line ends, cut in many tasks: quoted CSV lines and the elements of JSON arrays.

Spark reads a file in blocks. Whether a block begins inside quotes, and how deep inside brackets, depends on all blocks
before it, but what a block does to that is one row, found without knowing where it begins. The rows of all blocks are
put one after the other, and then each block is cut with its beginning known. The records that go over the end of a
block, one a block at most, are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.shared import kept

#: By kind: at what the pieces of a file are cut that a task gets as rows.
SEPARATOR = {"csv": "\n", "json": "}"}
_ESCAPED = re.compile(rb"\\.", re.S)
_QUOTE, _COMMA, _LINE = 34, 44, 10
_STEP = np.zeros(256, np.int64)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1  # [ { and ] }
_FOUND = "f string, b long, i long, text string, from_before boolean, goes_on boolean"


def _plain(kind: str, text: bytes) -> np.ndarray:
    """The bytes of whole pieces; characters that a backslash escapes in JSON stand as blanks."""
    return np.frombuffer(_ESCAPED.sub(lambda m: b" " * len(m[0]), text) if kind == "json" else text, np.uint8)


class Block:
    """The state along a block: in quotes or not, and the depth in brackets."""

    def __init__(self, kind: str, quoted: bool = False, depth: int = 0):
        self.kind, self.quoted, self.depth = kind, quoted, depth
        self.other = 0  # the depth's change if the block began in the other of the two states
        self.n, self.open, self.before = 0, [], None

    def skim(self, text: bytes) -> None:
        x = _plain(self.kind, text)
        quoted = (np.cumsum(x == _QUOTE) + self.quoted) % 2 == 1
        if self.kind == "json":
            step = _STEP[x]
            self.depth += int(step[~quoted].sum())
            self.other += int(step[quoted].sum())
        self.quoted = bool(quoted[-1])

    def cut(self, text: bytes) -> Iterator[tuple[int, str, bool, bool]]:
        """(number, text, whether it began before the block, False) of the records that end in these pieces."""
        x = _plain(self.kind, text)
        quoted = (np.cumsum(x == _QUOTE) + self.quoted) % 2 == 1
        if self.kind == "csv":
            ends = np.flatnonzero((x == _LINE) & ~quoted)
            inside = np.ones(len(ends), bool)
        else:
            step = np.where(quoted, 0, _STEP[x])
            depth = self.depth + np.cumsum(step)
            ends = np.flatnonzero(((x == _COMMA) & ~quoted & (depth == 1)) | ((step > 0) & (depth == 1)) | ((step < 0) & (depth == 0)))
            inside = step[ends] <= 0  # what is before the array's bracket is no element
            self.depth = int(depth[-1])
        self.quoted = bool(quoted[-1])
        at = 0
        for end, element in zip(ends.tolist(), inside.tolist()):
            self.open.append(text[at:end])
            yield from self._record(element, False)
            at = end + 1
        self.open.append(text[at:])

    def _record(self, element: bool, goes_on: bool) -> Iterator[tuple[int, str, bool, bool]]:
        text = b"".join(self.open).decode("utf-8", "replace")
        self.open.clear()
        before, self.before = self.before, False
        if element and (before or goes_on or self.kind == "csv" or text.strip()):
            yield self.n, text, bool(before), goes_on
            self.n += not before

    def end(self) -> Iterator[tuple[int, str, bool, bool]]:
        if any(self.open) and (self.quoted if self.kind == "csv" else self.depth > 0):
            yield from self._record(True, True)


def _runs(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of the rows of a batch that are of one block, with what they were cut at."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        code = file.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            rows = batch.column(0).slice(a, b - a).to_pylist()
            if separator == "\n":
                rows = [r.removesuffix("\r") for r in rows]
            yield file.dictionary[code[a]].as_py(), int(block[a]), (separator.join(rows) + separator).encode()


def _skimmed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """f, b, quoted, depth, other: what a block does to the state. A block's rows come one after the other, in one task."""
    seen: dict[tuple[str, int], Block] = {}
    for file, block, text in _runs(batches, SEPARATOR[kind]):
        seen.setdefault((file, block), Block(kind)).skim(text)
    rows = [(f, b, x.quoted, x.depth, x.other) for (f, b), x in seen.items()]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["f", "b", "quoted", "depth", "other"])


def _cut(batches: Iterator[pa.RecordBatch], kind: str, begins: dict[tuple[str, int], tuple[bool, int]]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def out(found) -> Iterator[pa.RecordBatch]:
        rows = [(*now, *r) for r in found]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in _FOUND.split(", ")])

    for file, block, text in _runs(batches, SEPARATOR[kind]):
        if (file, block) != now:
            if state is not None:
                yield from out(state.end())
            now = (file, block)
            state = Block(kind, *begins[now])
            state.before = state.quoted if kind == "csv" else state.depth > 0
        yield from out(state.cut(text))
    if state is not None:
        yield from out(state.end())


def read_records(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, list[tuple[str, bool, int]]]:
    """(f, row_idx, text: the records of each file in order; the files with their state at the end: in quotes or not, depth).

    kind "csv": records end at a line feed outside quotes (carriage returns before line feeds go); quotes stand around
    whole cells, or doubled inside. kind "json": the elements of one top-level array a file. The records are kept in the
    shared folder.
    """
    pieces = spark.read.option("lineSep", SEPARATOR[kind]).text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    blocks = pieces.mapInArrow(partial(_skimmed, kind=kind), "f string, b long, quoted boolean, depth long, other long").collect()  # a row a block
    begins, ends, quoted, depth, last = {}, [], False, 0, None
    for r in sorted(blocks, key=lambda r: (r["f"], r["b"])):
        if r["f"] != last:
            ends += [(last, quoted, depth)] if last is not None else []
            quoted, depth, last = False, 0, r["f"]
        begins[r["f"], r["b"]] = (quoted, depth)
        depth += r["other"] if quoted else r["depth"]
        quoted ^= r["quoted"]
    ends += [(last, quoted, depth)] if last is not None else []
    found = kept(pieces.mapInArrow(partial(_cut, kind=kind, begins=begins), _FOUND), "records")
    whole = found.where("NOT from_before AND NOT goes_on")
    # pieces of one record follow each other; a row or two a block
    order = Window.partitionBy("f").orderBy("b", "i", F.col("from_before").cast("int").desc())
    parts = found.where("from_before OR goes_on").withColumn("record", F.sum((~F.col("from_before")).cast("int")).over(order))
    joined = parts.groupBy("f", "record").agg(F.min_by(F.struct("b", "i"), F.struct("b", "i", ~F.col("from_before"))).alias("start"), F.array_sort(F.collect_list(F.struct("b", (~F.col("from_before")).alias("later"), "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    records = whole.select("f", "b", "i", "text").unionByName(joined.select("f", "start.*", text.alias("text")))
    counts = found.where("NOT from_before").groupBy("f", "b").agg(F.count("*").alias("n"))
    below = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    bases = counts.select("f", "b", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    return records.join(F.broadcast(bases), ["f", "b"]).select("f", (F.col("base") + F.col("i")).alias("row_idx"), "text"), ends
