"""Groups of texts whose word shingles have a Jaccard similarity of 0.8 or more, found with SimHash and Golay-code keys.

A text has a 128-bit SimHash of its distinct shingles. At a similarity s a bit differs with probability acos(2 s / (1 + s)) / pi,
about 0.15 at 0.8, so a fingerprint as a whole differs in some twenty bits, and links are found by many tables of fuzzy keys. A table draws a
segment of 23 bits and some other bits; its keys are the exact other bits together with the indices of the Golay
codewords at 4 or fewer bits from the segment, so two fingerprints share a key if the errors of the other bits are none and those of the segment fit.
The number of exact bits grows with the logarithm of the number of texts, so lists stay short, and the number of
tables follows from the share of pairs at the threshold that must meet. Candidates within a distance that all but a few
pairs at the threshold keep are verified on the shingles themselves.

Equal shingle sets fold into one node first. In a list of up to LIST_ROWS nodes all candidates come out. In a longer
one every node puts out a few; when these are verified and linked, the list's nodes that are still in different groups
are compared with one another. A key that a sample shows to be crowded is dealt out in blocks, of which every two meet
in a bucket of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, hot_and_cold, shuffles_freed, small_batches, smallest_reachable, stored, tidied
from quillon.llm.simhash import golay_keys

SIMILARITY = 0.8
#: Share of the pairs just at the threshold that meet in some table, and that lie within the distance looked at.
MEET, WITHIN = 0.97, 0.998
LIST_ROWS, FEW = 64, 4
#: Keys of a bucket, keys that a task packs at a time, nodes of a block of a crowded key.
BUCKET_ROWS, PACKED_ROWS, BLOCK_ROWS = 400_000, 400_000, 8_192
#: Nodes, chosen by hash, in which crowded keys are looked for, and how often a key has to come up there.
SAMPLE_ROWS, CROWDED = 20_000, 20
#: Lists that are dealt out in blocks at most (32 MB of keys and counts): blocks grow with the entries, if need be.
MOST_CROWDED = 2_000_000
#: Most nodes in pairs whose shingles are sent for by a broadcast of ids.
BROADCAST_IDS = 4_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; one of all words if there are fewer, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[i : n + i] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, n))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def sketch(hashes: np.ndarray) -> tuple[int, int, int, int]:
    """Two 64-bit hashes of the set and the halves of its fingerprint; all zero for no shingle."""
    if not len(hashes):
        return 0, 0, 0, 0
    halves = []
    for salt in (1, 2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):  # bounds the bit matrix of a very long text
            part = _mixed(hashes[at : at + (1 << 16)], salt)
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        halves.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True))
    sums = [int(_mixed(hashes, salt).sum(dtype=np.uint64).view(np.int64)) for salt in (3, 4)]
    return *sums, *halves


@tidied
def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = np.array([sketch(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.int64).reshape(-1, 4)
        yield pa.record_batch([batch.column(0), *[pa.array(c) for c in found.T.copy()]], ["doc_id", "s0", "s1", "f0", "f1"])


@cache
def shared_codeword(p: float) -> float:
    """Probability that two 23-bit segments, whose bits differ with probability p, share a codeword: from 100,000 fixed pairs."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 100_000)
    y = x ^ ((rng.random((len(x), 23)) < p) @ (1 << np.arange(23)))
    a, b = golay_keys(x), golay_keys(y)
    return float(((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2)).mean())


class Tables:
    """The positions of the bits that each table looks at."""

    def __init__(self, nodes: int, similarity: float):
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.exact = int(np.clip(math.ceil(math.log2(max(nodes, 2))) - 9, 3, 40))
        one = shared_codeword(p) * (1 - p) ** self.exact
        self.number = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - one)))
        rng = np.random.default_rng(3)
        self.positions = [rng.permutation(128)[: 23 + self.exact] for _ in range(self.number)]
        spread = np.cumsum([math.comb(128, d) * p**d * (1 - p) ** (128 - d) for d in range(129)])
        self.distance = int(np.searchsorted(spread, WITHIN)) + 4  # texts of few shingles scatter more

    def keys(self, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of every key of some fingerprints."""
        bits = np.concatenate([np.unpackbits(f.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for f in (f0, f1)], axis=1).astype(np.int64)
        keys, rows = [], []
        for t, at in enumerate(self.positions):
            near = golay_keys(bits[:, at[:23]] @ (1 << np.arange(23)))
            exact = bits[:, at[23:]] @ (1 << np.arange(self.exact))
            row, col = np.nonzero(near >= 0)
            keys.append(_mixed((exact[row].astype(np.uint64) << np.uint64(12)) | near[row, col].astype(np.uint64), 100 + t))
            rows.append(row)
        return np.concatenate(keys), np.concatenate(rows)


_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("f0", "<u8"), ("f1", "<u8"), ("block", "<i4")])


@tidied
def _packed(batches: Iterator[pa.RecordBatch], tables: Tables, crowded: np.ndarray, blocks: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, packed: the keys of nodes (node, f0, f1) by the bucket in which they meet."""
    rows_at_once = max(1, PACKED_ROWS // (6 * tables.number))
    for batch in batches:
        for at in range(0, batch.num_rows, rows_at_once):
            node, f0, f1 = (batch.column(c).slice(at, rows_at_once).to_numpy() for c in ("node", "f0", "f1"))
            key, row = tables.keys(f0, f1)
            e = np.zeros(len(key), _ENTRY)
            e["key"], e["node"], e["f0"], e["f1"], e["block"] = key, node[row], f0[row].view(np.uint64), f1[row].view(np.uint64), -1
            if len(crowded):
                place = np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)
                hot = crowded[place] == key
                n = blocks[place[hot]]
                copy = np.repeat(np.nonzero(hot)[0], n)
                size = np.repeat(n, n)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                out = e[copy]
                own = (_mixed(out["node"].view(np.uint64), 9) % size.astype(np.uint64)).astype(np.int64)
                out["key"] = _mixed(out["key"] ^ _mixed((np.minimum(own, other) * size + np.maximum(own, other)).astype(np.uint64), 11), 13)
                out["block"] = np.where(own == other, -1, own)
                e = np.concatenate([e[~hot], out])
            bucket = (_mixed(e["key"], 7) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cut = np.nonzero(np.diff(bucket, prepend=-1))[0]
            parts = [e[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(e)])]
            yield pa.record_batch([pa.array(bucket[cut]), pa.array(parts, pa.binary())], ["bucket", "packed"])


_FOUND = "kind byte, a long, b long, key long, f0 long, f1 long, block int"


def _lists(table: pa.Table, distance: int) -> pa.Table:
    """The lists of one bucket. Kind 0: nodes a < b within the distance. Kind 1: an entry of a list in which nodes have more."""
    e = np.concatenate([np.frombuffer(x, _ENTRY) for x in table["packed"].to_pylist()])
    e = e[np.lexsort((e["node"], e["key"]))]
    begin = np.nonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))[0]
    length = np.diff(begin, append=len(e))
    more = np.zeros(len(e), bool)
    found = [_near(e, np.nonzero(np.repeat((length > 1) & (length <= LIST_ROWS), length))[0], more, None, distance)]
    for at, n in zip(begin[length > LIST_ROWS], length[length > LIST_ROWS]):
        found.append(_near(e, np.arange(at, at + n), more, FEW, distance))
    a, b = (np.concatenate(side) for side in zip(*found))
    pairs = np.unique(np.stack([e["node"][a], e["node"][b]]), axis=1)
    of = np.repeat(np.arange(len(begin)), length)
    own = e[np.isin(of, np.unique(of[more]))]
    zero = np.zeros(pairs.shape[1], np.int64)
    columns = [
        np.concatenate([zero, np.ones(len(own), np.int64)]).astype(np.int8), np.concatenate([pairs[0], own["node"]]), np.concatenate([pairs[1], own["node"]]), np.concatenate([zero, own["key"].astype(np.uint64).view(np.int64)]),
        np.concatenate([zero, own["f0"].astype(np.uint64).view(np.int64)]), np.concatenate([zero, own["f1"].astype(np.uint64).view(np.int64)]), np.concatenate([zero, own["block"]]).astype(np.int32),
    ]
    return pa.table([pa.array(c) for c in columns], [x.split(" ")[0] for x in _FOUND.split(", ")])


def _near(e: np.ndarray, rows: np.ndarray, more: np.ndarray, few: int | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (in order of key and node) in one list each within the distance; a row with `few` before it says that it has more."""
    q, found, given = e[rows], [(np.zeros(0, np.int64),) * 2], np.zeros(len(rows), np.int64)
    alive, lag = np.arange(len(rows)), 0
    while len(alive):
        lag += 1
        alive = alive[alive + lag < len(q)]
        alive = alive[q["key"][alive] == q["key"][alive + lag]]
        if few and lag % 64 == 0 and more[rows].sum() >= len(rows) - few - 1:
            break
        i, j = alive, alive + lag
        asks = (q["block"][i] != q["block"][j]) | (q["block"][i] < 0)
        if few:
            asks &= ~more[rows[j]]
        i, j = i[asks], j[asks]
        good = np.bitwise_count(q["f0"][i] ^ q["f0"][j]).astype(np.int64) + np.bitwise_count(q["f1"][i] ^ q["f1"][j]) <= distance
        i, j = i[good], j[good]
        if few:
            full = given[j] >= few
            more[rows[j[full]]] = True
            i, j = i[~full], j[~full]
            given[j] += 1
        found.append((rows[i], rows[j]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _across(table: pa.Table, distance: int) -> pa.Table:
    """Pairs a < b of one list's nodes in different groups within the distance; a group is compared with those after it in size."""
    node, group, block = (table[c].to_numpy() for c in ("a", "grp", "block"))
    f0, f1 = (table[c].to_numpy().view(np.uint64) for c in ("f0", "f1"))
    names, code, size = np.unique(group, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(size, kind="stable")] = np.arange(len(names))
    order = np.argsort(rank[code], kind="stable")
    rank = rank[code][order]
    ends = np.searchsorted(rank, rank, "right")
    found = []
    for at, i in enumerate(order):  # few nodes are outside the largest group
        if ends[at] == len(order):
            break
        j = order[ends[at] :]
        near = np.bitwise_count(f0[i] ^ f0[j]).astype(np.int64) + np.bitwise_count(f1[i] ^ f1[j]) <= distance
        near &= (block[i] != block[j]) | (block[i] < 0)
        found.append(np.stack([np.full(int(near.sum()), node[i]), node[j[near]]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table([pa.array(pairs.min(0) if pairs.size else pairs[0]), pa.array(pairs.max(0) if pairs.size else pairs[1])], ["a", "b"])


@tidied
def _sets(batches: Iterator[pa.RecordBatch], shingle: int, ids: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """id, shingles of the texts with one of the sorted ids, or all."""
    for batch in small_batches(batches):
        if ids is not None:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            batch = batch.filter(pa.array(ids[at] == own)) if len(ids) else batch.slice(0, 0)
        shingles = pa.array([shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), shingles], ["id", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough."""
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-wanted")
    if wanted.count() <= BROADCAST_IDS:  # only the texts that are asked for are cut
        ids = np.sort(wanted.toArrow()["id"].to_numpy())
        sets = rows.mapInArrow(partial(_sets, shingle=shingle, ids=ids), "id long, shingles array<long>")
    else:
        sets = rows.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(partial(_sets, shingle=shingle, ids=None), "id long, shingles array<long>")
    sets = stored(sets.dropDuplicates(["id"]), "near-sets")
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = stored(met.mapInArrow(partial(_verified, similarity=similarity), "a long, b long"), "near-links")
    discard(wanted)
    discard(sets)
    return out


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: a row a row of docs with an id; component_id is the smallest id that a chain of links reaches.

    Texts (A-Z in lower case, words of [^\\x20\\x09-\\x0D]+) link if the Jaccard similarity of their sets of word
    shingles is at least `similarity`; equal sets always do, so all texts without words are one group. Rows with a null
    id are left out. Rows with one id are one document: it links as any of its texts does. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    with shuffles_freed(spark):
        prints = stored(rows.mapInArrow(partial(_sketches, shingle=shingle), "doc_id long, s0 long, s1 long, f0 long, f1 long"), "near-prints")
        nodes = stored(prints.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.count("*").alias("copies")), "near-nodes")
        n = nodes.count()
        tables = Tables(n, similarity)
        crowded, blocks = _crowded(nodes, n, tables)
        buckets = max(1, -(-6 * tables.number * n // BUCKET_ROWS))
        work = partial(_packed, tables=tables, crowded=crowded, blocks=blocks, buckets=buckets)
        found = stored(nodes.select("node", "f0", "f1").mapInArrow(work, "bucket long, packed binary").groupBy("bucket").applyInArrow(lambda t: _lists(t, tables.distance), _FOUND), "near-found")
        pairs = stored(found.where("kind = 0").select("a", "b").distinct(), "near-pairs")
        links = _links(pairs, rows, shingle, similarity)
        groups = smallest_reachable(links, "a", "b")
        open_ = found.where("kind = 1").select("key", "a", "f0", "f1", "block")
        if not open_.isEmpty():
            named = stored(open_.join(groups.withColumnRenamed("node", "a"), "a", "left").select("key", "a", "f0", "f1", "block", F.coalesce("component", "a").alias("grp")), "near-open")
            several = named.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key")
            left = named.join(several, "key", "left_semi").groupBy("key").applyInArrow(lambda t: _across(t, tables.distance), "a long, b long")
            left = stored(left.distinct().join(pairs, ["a", "b"], "left_anti"), "near-left")
            links = links.union(_links(left, rows, shingle, similarity))
            groups = smallest_reachable(links, "a", "b")
        # equal sets share a node; an id that several nodes have links them
        hot, cold = hot_and_cold(nodes.select("s0", "s1", "node", "copies"), "copies", prints.count())
        both = ["s0", "s1"]
        named = prints.join(hot, both).unionByName(prints.join(F.broadcast(hot.select(*both)), both, "left_anti").join(cold, both)).select("doc_id", "node")
        twice = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id")
        more = named.join(twice, "doc_id", "left_semi").distinct()
        if not more.isEmpty():
            groups = smallest_reachable(links.select("a", "b").union(more.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))), "a", "b")
    out = named.join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return out


def _keys_of(batches: Iterator[pa.RecordBatch], tables: Tables) -> Iterator[pa.RecordBatch]:
    """key, n: the keys of a batch of fingerprints (f0, f1)."""
    for batch in batches:
        for k in range(0, batch.num_rows, SAMPLE_ROWS):
            f0, f1 = (batch.column(c).slice(k, SAMPLE_ROWS).to_numpy() for c in ("f0", "f1"))
            key, n = np.unique(tables.keys(f0, f1)[0].view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n, pa.int64())], ["key", "n"])


def _crowded(nodes: DataFrame, n: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a share of the nodes, counted in the tasks, shows to have lists longer than a block, in order, and into how many blocks each is dealt."""
    if n <= BLOCK_ROWS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    block = max(BLOCK_ROWS, 6 * tables.number * n // MOST_CROWDED)
    share = min(1.0, max(SAMPLE_ROWS / n, CROWDED / block))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("f0", "f1")
    counts = sample.mapInArrow(partial(_keys_of, tables=tables), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= F.greatest(F.lit(CROWDED), F.ceil(F.lit(block * share)))).toArrow()  # MOST_CROWDED rows or about that
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.ceil(found["n"].to_numpy()[order] / share / block).astype(np.int64)
