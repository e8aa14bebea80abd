"""Exact deduplication with Patricia-trie owners.

Rows are dealt out by the length and a content hash of their normalised bytes. Every task inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the owner (the row that stays) and the group's size,
so two texts are equal only if all their bytes are. A first trie runs before the shuffle and merges the copies inside
a task, so a text that a third of all rows carry crosses the network once a task. A trie beyond its memory budget
spills its largest subtree to the scratch folders that Spark gives its workers and works through it later.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import ASCII_SPACE, hot_and_cold, numbered, small_batches, stored, tidied

SPACE_BYTES = ASCII_SPACE.encode()
#: Bytes of strings that one task's trie holds before it spills.
RESIDENT_BYTES = 96 << 20
_NODE_BYTES = 400


class Node:
    __slots__ = ("children", "edge", "owner")

    def __init__(self, edge: bytes, owner: tuple | None = None):
        self.edge, self.children, self.owner = edge, {}, owner


def better(a: tuple, b: tuple) -> tuple:
    """Owners are (-code points, id is null, id, copies, digest): the smaller first three stay, copies add up."""
    return (*min(a, b, key=lambda x: x[:3])[:3], a[3] + b[3], a[4])


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a agree with b from position at."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if b.startswith(a[:mid], at) else (low, mid - 1)
    return low


class PatriciaTrie:
    """Byte strings to owners. With a folder it spills subtrees of its root; without one, full() asks to be drained."""

    def __init__(self, budget: int, folder: str | None = None, prefix: bytes = b""):
        self.root, self.budget, self.folder, self.prefix, self.skip = Node(b""), budget, folder, prefix, len(prefix)
        self.held: dict[int, int] = {}
        self.total = 0
        self.spilled: dict[int, str] = {}

    def full(self) -> bool:
        return self.total > self.budget

    def add(self, key: bytes, owner: tuple) -> None:
        first = key[self.skip] if self.skip < len(key) else -1
        self._insert(key, owner, first)
        if self.folder and self.held and self.full():
            self._spill(max(self.held, key=self.held.get))

    def _insert(self, key: bytes, owner: tuple, first: int) -> None:
        node, at = self.root, self.skip
        if first in self.spilled:
            with open(self.spilled[first], "ab") as f:
                pickle.dump((key, owner), f)
            return
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self._grown(first, len(key) - at)
                return
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            n = shared_prefix(child.edge, key, at)
            upper = Node(child.edge[:n])
            child.edge = child.edge[n:]
            upper.children[child.edge[0]] = child
            node.children[key[at]] = upper
            self._grown(first, 0)
            node, at = upper, at + n
        node.owner = owner if node.owner is None else better(node.owner, owner)

    def _grown(self, first: int, n: int) -> None:
        self.held[first] = self.held.get(first, 0) + n + _NODE_BYTES
        self.total += n + _NODE_BYTES

    def _spill(self, first: int) -> None:
        handle, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            for key, owner in self._walk(self.root.children.pop(first), self.prefix):
                pickle.dump((key, owner), f)
        self.spilled[first] = path
        self.total -= self.held.pop(first)

    def _walk(self, node: Node, above: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            key = above + node.edge
            if node.owner is not None:
                yield key, node.owner
            stack += [(c, key) for c in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Every string with its owner; a spilled subtree becomes a trie of its own below its common prefix."""
        yield from self._walk(self.root, self.prefix)
        self.root = Node(b"")
        for path in self.spilled.values():
            skip, head = None, b""
            for key, _ in self._read(path):
                skip = len(key) if skip is None else shared_prefix(head[:skip], key, 0)
                head = head or key
            below = PatriciaTrie(self.budget, self.folder, head[:skip])
            for key, owner in self._read(path):
                below.add(key, owner)
            os.unlink(path)
            yield from below.items()

    @staticmethod
    def _read(path: str) -> Iterator[tuple[bytes, tuple]]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return


def scratch() -> str | None:
    """One of the folders that Spark gives its workers for what they spill; a task's files there are its own and go with it."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return folders[os.getpid() % len(folders)] if folders else None


@tidied
def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: one row a distinct text of the task."""
    trie = PatriciaTrie(RESIDENT_BYTES // 2)
    for batch in small_batches(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = text.encode().translate(None, SPACE_BYTES)
            trie.add(key, (-len(text), doc_id is None, doc_id or 0, 1, xxhash.xxh64_intdigest(key) & (1 << 63) - 1))
        if trie.full():
            yield from _rows(trie)
            trie = PatriciaTrie(RESIDENT_BYTES // 2)
    yield from _rows(trie)


def _rows(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
    names = ["length", "hash", "content", "n_chars", "doc_id", "copies"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rows, size = [], 0
    for key, (less, null, doc_id, copies, digest) in trie.items():
        rows.append((len(key), digest, key, -less, None if null else doc_id, copies))
        size += len(key)
        if size > 4 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


@tidied
def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After the shuffle: the owner of every text that more than one row has."""
    with tempfile.TemporaryDirectory(dir=scratch()) as folder:
        trie = PatriciaTrie(RESIDENT_BYTES, folder)
        for batch in batches:
            for key, n_chars, doc_id, copies in zip(*(batch.column(k).to_pylist() for k in ("content", "n_chars", "doc_id", "copies"))):
                trie.add(key, (-n_chars, doc_id is None, doc_id or 0, copies, hashlib.sha256(key).hexdigest()))
        found = ((digest, None if null else doc_id, copies) for _, (_, null, doc_id, copies, digest) in trie.items() if copies > 1)
        while rows := list(islice(found, 10_000)):
            a, b, c = zip(*rows)
            yield pa.record_batch([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["text_sha256", "keep_id", "group_size"])


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_sha256, keep_id, group_size of each normalised text that at least two rows have."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    merged = rows.mapInArrow(_combined, "length long, hash long, content binary, n_chars long, doc_id long, copies long")
    dealt = merged.repartition("length", "hash")
    return dealt.mapInArrow(_owners, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept and text_sha256 (columns of those names are replaced).

    Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted; a null text counts as
    empty and all empty texts are equal. The row with the most code points in its original text stays, then the one
    with the smallest id, a null id last. Rows repeated with the same id and length share one decision. An empty table
    gives an empty result.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    bare, (key, text), columns = numbered(docs.drop(*made), id_col, text_col)
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", ""), 256)
    owners = stored(exact_owners(bare, key, text), "exact-owners")
    hot, cold = hot_and_cold(owners, "group_size", bare.count())
    members = bare.withColumn("text_sha256", digest).join(hot, "text_sha256", "left")
    # rows that have their owner by now are dealt out evenly and meet nothing
    meets = F.when(F.col("group_size").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.xxhash64(key).cast("string")))
    joined = members.withColumn("meets", meets).join(cold.toDF("meets", "cold_id", "cold_size"), "meets", "left")
    size = F.coalesce("group_size", "cold_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).when(F.col("cold_size").isNotNull(), F.col("cold_id")).otherwise(F.col(key).cast("long"))
    return joined.select(*columns, keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col(key)).alias("kept"), "text_sha256")
