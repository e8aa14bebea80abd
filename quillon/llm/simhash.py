"""SimHash near-duplicate groups found with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. A segment, padded to 23 bits, has as keys the
indices of all words of the perfect binary Golay code at 4 or fewer bits from it: one to six keys, and two segments that
differ in at most 2 bits share at least one (a test goes through every case). Fingerprints that differ in at most 2
bits agree on at least one whole segment, and the errors left fit the next one: a key is a segment's bits together with
a codeword index of the segment after it, about 16 keys a fingerprint and 34 bits a key. Equal keys are joined and the
distance is then verified.

Copies fold into one row a fingerprint first. A key shared by more fingerprints than BUCKET_LIMIT isn't gathered: its
members are linked exactly through their one-bit neighbours instead. Two fingerprints share a one-bit neighbour (or
each other) just when they differ in at most 2 bits, so the members of each neighbour link to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, hot_and_cold, small_batches, smallest_reachable, stored, tidied

#: Fixed value: generator polynomial of the binary Golay code.
GOLAY_POLYNOMIAL = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 2
#: Largest number of fingerprints of one key that are compared in one place.
BUCKET_LIMIT = 64


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits by message (4096), and error patterns of weight 4 or less by syndrome (2048 x 6, padded with -1)."""
    messages = np.arange(4096, dtype=np.int64) << 11
    rest = messages.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
    check = rest
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            s = check[e >> 11] ^ (e & 2047)
            patterns[s, filled[s]] = e
            filled[s] += 1
    return check, patterns


def golay_keys(segment: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices at 4 or fewer bits from each 23-bit value; -1 where there are fewer than six."""
    check, patterns = golay_tables()
    e = patterns[check[segment >> 11] ^ (segment & 2047)]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(words) - shingle + 1, 1 << 16):  # bounds the bit matrix of a very long text
        part = words[at : at + (1 << 16) + shingle - 1]
        n = len(part) - shingle + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[i : n + i] for i in range(shingle)))), repeat(42)), ">u8", n)
        ones += np.unpackbits(h.view(np.uint8)).reshape(n, 64).sum(0, dtype=np.int64)
    bits = ones * 2 > len(words) - shingle + 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


@tidied
def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        prints = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [(fp >> at) & ((1 << n) - 1) for at, n in SEGMENTS]
        keys, owners = [], []
        for i, exact in enumerate(parts):
            near = golay_keys(parts[(i + 1) % 3])
            row, col = np.nonzero(near >= 0)
            keys.append((exact[row] << 14) | (near[row, col] << 2) | i)
            owners.append(fp[row])
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "fp"])


def linked_runs(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal keys (rows come sorted by key)."""
    n = len(key)
    low, high = [], []
    alive = np.arange(n)
    for lag in range(1, n):
        alive = alive[alive < n - lag]
        alive = alive[key[alive] == key[alive + lag]]
        if not len(alive):
            break
        near = alive[np.bitwise_count((fp[alive] ^ fp[alive + lag]).view(np.uint64)) <= most]
        low.append(near)
        high.append(near + lag)
    if not low:
        return fp[:0], fp[:0]
    a, b = np.concatenate(low), np.concatenate(high)
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    own = np.nonzero(label != np.arange(n))[0]
    return fp[own], fp[label[own]]


def _verified(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; a run may go on in the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        a, b = linked_runs(key[:cut], fp[:cut], most)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
        key, fp = key[cut:], fp[cut:]
    a, b = linked_runs(key, fp, most)
    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64).view(np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, 65))], ["near", "fp"])


def fingerprint_links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """a, b: links that connect just the fingerprints (column fp, distinct) which a chain of links connects."""
    keys = stored(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"), "simhash-keys")
    hot = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit).select("key"), "simhash-hot")
    cold = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    found = cold.mapInArrow(partial(_verified, most=MAX_DISTANCE), "a long, b long")
    crowded = keys.join(hot, "key", "left_semi").select("fp").distinct()
    around = crowded.mapInArrow(_neighbours, "near long, fp long")
    hubs = around.groupBy("near").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("near", "hub")
    linked = around.join(hubs, "near").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    links = stored(found.union(linked), "simhash-links")
    discard(keys)
    discard(hot)
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id (long), fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and cut into words of [^\\x20\\x09-\\x0D]+ and shingles, repeats included; a text with
    fewer words than a shingle has one shingle of them all, one without words (null or empty) the fingerprint zero,
    which links like any other. A bit is 1 if set in over half the shingles' XXH64 (seed 42). Documents link at 2 or
    fewer differing bits; component_id is the smallest id reachable. A null id is never a component's name unless no
    member has another. Repeated rows stay. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = stored(rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long"), "simhash-fp")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    links = fingerprint_links(distinct)
    grown = smallest_reachable(links, "a", "b")
    discard(links)
    named = distinct.join(grown, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    multi = named.where("root != fp").select("root").distinct()  # only these need another name than their own first
    least = named.join(multi, "root", "left_semi").groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "root", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "simhash-named")
    discard(distinct)
    hot, cold = hot_and_cold(named, "n", prints.count())  # all texts without words, for one, share a fingerprint
    known = prints.join(hot, "fp").unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))
    return known.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
