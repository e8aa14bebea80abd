"""Line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z in lower case). Equal sets fold into the first line that has them. The words of a
set are ordered from rare to frequent by counts over all lines (counted in a table of fixed size: the order only has to
be the same for all sets, it needn't be exact). Two sets with a Jaccard similarity of t share a word among their first
n - ceil(t n) + 1; postings of these prefixes meet by word and pass filters on length, on position and on a 128-bit
picture of the set (one bit a word, by parity: sets differ in at least as many words as pictures in bits). What is
left is verified on the words themselves, and every line that an earlier line matches goes.

Tasks pack postings by bucket, and the number of buckets comes from the counted postings, so a bucket holds a bounded
number. The list of a frequent word is dealt out in blocks, of which every two meet in a bucket of their own. A list of
up to LIST_ROWS lines puts out all its candidates. In a longer one each line puts out a few and says that there are
more; such lists come along, and lines that those few don't settle are looked up in them with every candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, fresh, hot_and_cold, numbered, short_batches, shuffles_freed, small_batches, stored, tidied

THRESHOLD = 0.8
#: Entries of the table of word counts (a word is counted at its hash).
COUNT_TABLE = 1 << 17
LIST_ROWS = 64
#: Candidates that a line puts out from a longer list.
FEW = 4
#: Postings of a bucket, postings that a task packs at a time, and lines of a block of a long list.
BUCKET_ROWS, PACKED_ROWS, BLOCK_ROWS = 150_000, 150_000, 16_384
#: Sets that a task remembers (about 350 bytes each), to put out the postings of a set once.
SEEN_SETS = 100_000
#: Long lists are looked for in a share of the documents chosen by hash, so large that a list of a block's length comes up CROWDED times there (of few documents, in as many as SAMPLE_DOCUMENTS).
SAMPLE_DOCUMENTS, CROWDED = 10_000, 20
#: Lists that are dealt out in blocks at most (32 MB of names and counts): blocks grow with the postings, if need be.
MOST_CROWDED = 2_000_000


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Bits of a word's name: the hash, and above it the rank of its count.
_HASH_BITS, _RANK_BITS = 41, 4
_NAME_BITS = _HASH_BITS + _RANK_BITS


class Lines:
    """The word sets of many texts' lines as flat arrays, each set's words in ascending order of their names.

    A word's name is the rank of its count and 41 bits of its hash, so names sort from rare to frequent. Two words of
    one line would have to share all these bits to be taken for one.
    """

    def __init__(self, ids: pa.Array, texts: pa.Array, ranks: np.ndarray | None = None):
        rows = pc.split_pattern(pc.ascii_lower(fresh(texts)), "\n")
        ends = rows.offsets.to_numpy()
        split = pc.ascii_split_whitespace(rows.values)
        coded = split.values.dictionary_encode()
        words, code = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        lines = len(rows.values)
        of_line = np.repeat(np.arange(lines), np.diff(split.offsets.to_numpy()))
        if b"" in words:  # at the ends of a line
            some = code != words.index(b"")
            code, of_line = code[some], of_line[some]
        filled = np.bincount(of_line, minlength=lines) > 0
        self.doc = np.repeat(ids.to_numpy(zero_copy_only=False), np.diff(ends))[filled]
        self.line = (np.arange(lines) - np.repeat(ends[:-1], np.diff(ends)))[filled].astype(np.int64)
        name = h >> np.uint64(64 - _HASH_BITS)
        entry = (name & np.uint64(COUNT_TABLE - 1)).astype(np.int64)
        self.counts = np.bincount(entry, np.bincount(code, minlength=len(words)), COUNT_TABLE).astype(np.int64)
        if ranks is not None:
            name |= ranks[entry].astype(np.uint64) << np.uint64(_HASH_BITS)
        owner, name = (np.cumsum(filled) - 1)[of_line].astype(np.uint64), name[code]
        if len(self.doc) < 1 << (64 - _NAME_BITS):
            both = np.sort((owner << np.uint64(_NAME_BITS)) | name)  # one sort of numbers
            owner, name = (both >> np.uint64(_NAME_BITS)).astype(np.int64), both & np.uint64((1 << _NAME_BITS) - 1)
        else:
            order = np.lexsort((name, owner))
            owner, name = owner[order].astype(np.int64), name[order]
        novel = np.ones(len(name), bool)
        novel[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        self.words, self.owner = name[novel], owner[novel]
        self.n = np.bincount(self.owner, minlength=len(self.doc)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)
        if len(self.doc):
            bare = self.words & np.uint64((1 << _HASH_BITS) - 1)  # the same with and without ranks
            self.k1, self.k2 = (np.add.reduceat(_mixed(bare, salt), self.start).view(np.int64) for salt in (1, 2))


def count_ranks(counts: np.ndarray) -> np.ndarray:
    """A small rank for each entry of the count table, in half powers of two above the least count."""
    seen = np.maximum(counts, 1)
    return np.clip(2 * np.log2(seen / seen.min()), 0, (1 << _RANK_BITS) - 1).astype(np.uint8)


def prefix_lengths(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a set that go into lists: none if it is so small that only an equal set can match it."""
    least = np.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else np.inf
    return np.where(n >= least, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)


_PASS = "kind byte, a long, b long, k1 long, k2 long"


@tidied
def _scan(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Kind 0: line b of document a and the 128-bit hash of its set. Kind 1: entry a of the count table has b. Kind 2: b postings."""
    counts, postings = np.zeros(COUNT_TABLE, np.int64), 0

    def rows(kind: int, a: np.ndarray, b: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), *[pa.array(x, pa.int64()) for x in (a, b, k1, k2)]], ["kind", "a", "b", "k1", "k2"])

    for batch in small_batches(batches, limit=1 << 20):
        x = Lines(batch.column(0), batch.column(1))
        if len(x.doc):
            counts += x.counts
            postings += int(prefix_lengths(x.n, threshold).sum())
            yield rows(0, x.doc, x.line, x.k1, x.k2)
    at = np.nonzero(counts)[0]
    zero = np.zeros(len(at), np.int64)
    yield rows(1, at, counts[at], zero, zero)
    yield rows(2, zero[:0], zero[:0], zero[:0], zero[:0]) if not postings else rows(2, *(np.array([v]) for v in (0, postings, 0, 0)))


#: A posting. list is the word, or the word and a pair of blocks; block is -1 where all of a list meets.
_POSTING = np.dtype([("list", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("doc", "<i8"), ("line", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("block", "<i4"), ("p0", "<u8"), ("p1", "<u8")])


@tidied
def _postings(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, crowded: np.ndarray, blocks: np.ndarray, buckets: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """bucket, packed: the prefix of every set, where a task first meets it and again at each earlier place, so that its first is among them."""
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    held: list[np.ndarray] = []

    def packed() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        held.clear()
        bucket = (_mixed(rows["list"], 7) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = np.nonzero(np.diff(bucket, prepend=-1))[0]
        parts = [rows[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(rows)])]
        yield pa.record_batch([pa.array(bucket[cut]), pa.array(parts, pa.binary())], ["bucket", "packed"])

    for batch in small_batches(batches, limit=1 << 20):
        x = Lines(batch.column(0), batch.column(1), ranks)
        if not len(x.doc):
            continue
        prefix = prefix_lengths(x.n, threshold)
        for at, (key, place) in enumerate(zip(zip(x.k1.tolist(), x.k2.tolist()), zip(x.doc.tolist(), x.line.tolist()))):
            if prefix[at] and (key not in seen or place < seen[key]):
                seen[key] = place
            else:
                prefix[at] = 0
        if len(seen) > SEEN_SETS:
            seen.clear()
        pos = np.arange(len(x.words)) - x.start[x.owner]
        take = np.nonzero(pos < prefix[x.owner])[0]
        place = _mixed(x.words, 3) >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        own = x.owner[take]
        rows = np.zeros(len(take), _POSTING)
        rows["list"], rows["pos"], rows["block"] = x.words[take], pos[take], -1
        for name, values in (("k1", x.k1), ("k2", x.k2), ("doc", x.doc), ("line", x.line), ("n", x.n)):
            rows[name] = values[own]
        for half in (0, 1):
            rows[f"p{half}"] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == half, bit, np.uint64(0)), x.start)[own]
        if len(crowded):
            at = np.minimum(np.searchsorted(crowded, rows["list"]), len(crowded) - 1)
            rows = _in_blocks(rows, np.where(crowded[at] == rows["list"], blocks[at], 1))
        held.append(rows)
        if sum(map(len, held)) > PACKED_ROWS:
            yield from packed()
    if held:
        yield from packed()


def _words_in_lists(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """word, n: the words of the prefixes of a sample's sets, each set of a batch once."""
    for batch in small_batches(batches, limit=1 << 20):
        x = Lines(batch.column(0), batch.column(1), ranks)
        if len(x.doc):
            once = np.zeros(len(x.doc), bool)
            once[np.unique(x.k1, return_index=True)[1]] = True
            pos = np.arange(len(x.words)) - x.start[x.owner]
            word, n = np.unique(x.words[(pos < prefix_lengths(x.n, threshold)[x.owner]) & once[x.owner]].view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(word), pa.array(n, pa.int64())], ["word", "n"])


def _crowded(rows: DataFrame, ranks: np.ndarray, threshold: float, postings: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that a share of the documents shows to have lists longer than a block, in order, and into how many blocks each is dealt. It decides on the dealing only."""
    block = max(BLOCK_ROWS, postings // MOST_CROWDED)
    share = min(1.0, max(SAMPLE_DOCUMENTS / max(rows.count(), 1), CROWDED / block))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = sample.mapInArrow(partial(_words_in_lists, ranks=ranks, threshold=threshold), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= F.greatest(F.lit(CROWDED), F.ceil(F.lit(block * share)))).toArrow()  # MOST_CROWDED rows or about that
    words, estimate = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy() / share
    order = np.argsort(words)
    return words[order], np.ceil(estimate[order] / block).astype(np.int64)


def _in_blocks(rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The postings of lists of several blocks once for every pair of blocks that theirs is in."""
    several = blocks > 1
    if not several.any():
        return rows
    own, n = rows[several], blocks[several]
    copy = np.repeat(np.arange(len(own)), n)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
    out = own[copy]
    block = (_mixed(out["k1"].view(np.uint64), 9) % n[copy].astype(np.uint64)).astype(np.int64)
    pair = np.minimum(block, other) * n[copy] + np.maximum(block, other)
    out["list"] = _mixed(out["list"] ^ _mixed(pair.astype(np.uint64), 11), 13)
    out["block"] = np.where(block == other, -1, block)
    return np.concatenate([rows[~several], out])


_FOUND = "kind byte, doc_id long, line long, x_doc long, x_line long, apart int, list long, n int, pos int, block int, p0 long, p1 long"


def _candidates(table: pa.Table, threshold: float) -> pa.Table:
    """The lists of one bucket. Kind 0: a line with an earlier one that may match it. Kind 1: a line with more of these. Kind 2: a posting of a list that has such a line."""
    p = np.concatenate([np.frombuffer(x, _POSTING) for x in table["packed"].to_pylist()])
    place = np.empty(len(p), np.int64)  # the order of lines
    place[np.lexsort((np.ascontiguousarray(p["line"]), np.ascontiguousarray(p["doc"])))] = np.arange(len(p))
    sets = _mixed(p["k1"].view(np.uint64), 15) ^ np.ascontiguousarray(p["k2"]).view(np.uint64)
    order = np.lexsort((place, sets, np.ascontiguousarray(p["list"])))
    p, place, sets = p[order], place[order], sets[order]
    new_list = np.concatenate([[True], p["list"][1:] != p["list"][:-1]])
    first = new_list | np.concatenate([[True], (p["k1"][1:] != p["k1"][:-1]) | (p["k2"][1:] != p["k2"][:-1])])
    number = np.cumsum(new_list)[first]
    p, place = p[first], place[first]  # of one set that several tasks bring, the earliest place
    order = np.argsort((number << 32) | p["n"], kind="stable")
    p, place = p[order], place[order]
    begin = np.nonzero(np.concatenate([[True], p["list"][1:] != p["list"][:-1]]))[0]
    length = np.diff(begin, append=len(p))
    more = np.zeros(len(p), bool)
    short = np.repeat(length <= LIST_ROWS, length)
    found = [_pairs(p, place, np.nonzero(short)[0], more, None, threshold), _pairs(p, place, np.nonzero(~short)[0], more, FEW, threshold)]
    y, x, apart = (np.concatenate(side) for side in zip(*found))
    open_lists = np.isin(np.repeat(np.arange(len(begin)), length), np.unique(np.repeat(np.arange(len(begin)), length)[more]))
    kept = [np.zeros(len(y), np.int8), np.ones(int(more.sum()), np.int8), np.full(int(open_lists.sum()), 2, np.int8)]
    line = np.concatenate([y, np.nonzero(more)[0], np.nonzero(open_lists)[0]])
    pad = len(line) - len(y)
    own = p[line]
    columns = [
        np.concatenate(kept), own["doc"], own["line"], np.concatenate([p["doc"][x], np.zeros(pad, np.int64)]), np.concatenate([p["line"][x], np.zeros(pad, np.int64)]), np.concatenate([apart, np.zeros(pad, np.int64)]).astype(np.int32),
        own["list"].astype(np.uint64).view(np.int64), own["n"], own["pos"], own["block"], own["p0"].astype(np.uint64).view(np.int64), own["p1"].astype(np.uint64).view(np.int64),
    ]
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], [f.split(" ")[0] for f in _FOUND.split(", ")])


def _pairs(p: np.ndarray, place: np.ndarray, rows: np.ndarray, more: np.ndarray, few: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later line, earlier line, words apart) of the pairs in one list each that pass the filters on length, picture and position; a line with `few` says that it has more.

    No filter drops a pair that is similar enough. The lines of a list are in order of size, so those too large for a
    line come after all that aren't. When few lines of long lists are left to ask, each is held against its list at once.
    """
    found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    if not len(rows):
        return found[0]
    place, given = place[rows], np.zeros(len(rows), np.int64)
    lists, n, pos, block, p0, p1 = (p[c][rows] for c in ("list", "n", "pos", "block", "p0", "p1"))
    n, rest = n.astype(np.int64), (n - pos).astype(np.int64)
    key = np.cumsum(np.concatenate([[0], lists[1:] != lists[:-1]])) << 32
    low, high = np.searchsorted(key | n, key | np.ceil(threshold * n - 1e-6).astype(np.int64)), np.searchsorted(key | n, key | np.floor((n + 1e-6) / threshold).astype(np.int64), "right")
    reach = high - np.arange(len(n)) - 1

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (y, x, apart) that pass, the later line first."""
        both = n[i] + n[j]
        need = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
        apart = np.bitwise_count(p0[i] ^ p0[j]).astype(np.int64) + np.bitwise_count(p1[i] ^ p1[j])
        good = np.nonzero(apart <= both - 2 * need)[0]
        i, j, apart = i[good], j[good], apart[good]
        good = (np.minimum(rest[i], rest[j]) >= need[good]) & ((block[i] != block[j]) | (block[i] < 0))
        i, j, apart = i[good], j[good], apart[good]
        later = place[i] > place[j]
        return np.where(later, i, j), np.where(later, j, i), apart

    alive, lag = np.arange(len(n)), 0
    while len(alive):
        lag += 1
        alive = alive[reach[alive] >= lag]
        if few and lag % LIST_ROWS == 0:
            left = np.nonzero(~more[rows] & (np.maximum(reach, np.arange(len(n)) - low) >= lag))[0]
            if 2 * int((high - low)[left].sum()) < int((reach[alive] - lag + 1).sum()):
                break
        y, x, apart = passing(alive, alive + lag)
        if few:
            asks = ~more[rows[y]]
            y, x, apart = y[asks], x[asks], apart[asks]
            full = given[y] >= few
            more[rows[y[full]]] = True
            y, x, apart = y[~full], x[~full], apart[~full]
            np.add.at(given, y, 1)
        found.append((rows[y], rows[x], apart))
    for own in left.tolist() if len(alive) else ():
        x = np.arange(low[own], high[own])
        x = x[(np.abs(x - own) >= lag) & (place[x] < place[own])]
        _, x, apart = passing(np.full(len(x), own), x)
        room = max(few - int(given[own]), 0)
        more[rows[own]] = len(x) > room
        x, apart = x[:room], apart[:room]
        found.append((np.full(len(x), rows[own]), rows[x], apart))
    return tuple(np.concatenate(side) for side in zip(*found))


#: Largest number of lines whose places are broadcast (8 or 16 bytes each); more are joined.
BROADCAST_LINES = 4_000_000


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(doc.view(np.uint64), 5) + line.view(np.uint64), 6).view(np.int64)


def _words(row: str) -> str:
    return b" ".join(sorted(set(row.encode().lower().split()))).decode()


def _broadcast_lines(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    """The lines whose place is one of the broadcast places, and the few that share a place's hash."""
    known = places.value
    for batch in batches:
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = (text or "").split("\n")
            own = _place(np.full(len(rows), i, np.int64), np.arange(len(rows)))
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out += [(i, int(k), _words(rows[k])) for k in np.nonzero(known[at] == own)[0]]
        d, k, w = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(w, pa.string())], ["d", "l", "words"])


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text, wanted in zip(*(c.to_pylist() for c in batch.columns[:3])):
            rows = (text or "").split("\n")
            out += [(i, k, _words(rows[k])) for k in set(wanted) if k < len(rows)]
        d, k, w = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(w, pa.string())], ["d", "l", "words"])


def _sets(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """d, l, words of every line in pairs."""
    spark, made = rows.sparkSession, "d long, l long, words string"
    lines = stored(pairs.select("doc_id", "line").union(pairs.select("x_doc", "x_line")).distinct(), "line-wanted")
    if lines.count() > BROADCAST_LINES:
        wanted = lines.groupBy("doc_id").agg(F.collect_set("line").alias("wanted"))
        found = stored(rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_joined_lines, made), "line-sets")
    else:
        t = lines.toArrow()
        places = np.sort(_place(t["doc_id"].to_numpy(), t["line"].to_numpy())) if len(t) else np.zeros(1, np.int64)
        found = stored(rows.mapInArrow(partial(_broadcast_lines, places=spark.sparkContext.broadcast(places)), made), "line-sets")
    discard(lines)
    return found


def _jaccard(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("yw").to_pylist(), batch.column("xw").to_pylist()):
            a, b = set(a.split(" ")), set(b.split(" "))
            both = len(a & b)
            keep.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
        yield batch.select(["doc_id", "line"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (doc_id, line) of pairs whose words are similar enough to those of (x_doc, x_line)."""
    y = sets.select(F.col("d").alias("doc_id"), F.col("l").alias("line"), F.col("words").alias("yw"))
    x = sets.select(F.col("d").alias("x_doc"), F.col("l").alias("x_line"), F.col("words").alias("xw"))
    met = pairs.select("doc_id", "line", "x_doc", "x_line").join(y, ["doc_id", "line"]).join(x, ["x_doc", "x_line"])
    return met.mapInArrow(partial(_jaccard, threshold=threshold), "doc_id long, line long").distinct()


def _similar(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The lines of pairs that at least one of their candidates matches: the likeliest is tried first, then all others."""
    sets = _sets(pairs, rows)
    likely = pairs.groupBy("doc_id", "line").agg(F.min_by(F.struct("x_doc", "x_line"), F.struct("apart", "x_doc", "x_line")).alias("x")).select("doc_id", "line", "x.*")
    first = stored(_verified(likely, sets, threshold), "line-first")
    others = pairs.join(first, ["doc_id", "line"], "left_anti").join(likely, ["doc_id", "line", "x_doc", "x_line"], "left_anti").select("doc_id", "line", "x_doc", "x_line").distinct()
    out = stored(first.union(_verified(others, sets, threshold)), "line-near")
    discard(sets)
    discard(first)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0): every line whose words are, with a Jaccard of `threshold` or more, those of an earlier one.

    Earlier is by id (null first), then line. A line without words neither goes nor matches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    with shuffles_freed(spark), short_batches(spark):
        scan = stored(rows.mapInArrow(partial(_scan, threshold=threshold), _PASS), "line-scan")
        lines = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("line"), "k1", "k2")
        owners = stored(lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-owners")
        hot, cold = hot_and_cold(owners, "n", lines.count())
        both = ["k1", "k2"]
        met = lines.join(hot, both).unionByName(lines.join(F.broadcast(hot.select(*both)), both, "left_anti").join(cold, both))
        again = met.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line"))).select("doc_id", "line")
        table = scan.where("kind > 0").groupBy("kind", "a").agg(F.sum("b").alias("b")).toArrow()  # COUNT_TABLE rows and one at most
        kind, a, b = (table[c].to_numpy() for c in ("kind", "a", "b"))
        counts = np.zeros(COUNT_TABLE, np.int64)
        counts[a[kind == 1]] = b[kind == 1]
        buckets = max(1, -(-int(b[kind == 2].sum()) // BUCKET_ROWS))
        ranks = count_ranks(counts)
        crowded, blocks = _crowded(rows, ranks, threshold, int(b[kind == 2].sum()))
        work = partial(_postings, ranks=ranks, crowded=crowded, blocks=blocks, buckets=buckets, threshold=threshold)
        packed = rows.mapInArrow(work, "bucket long, packed binary")
        found = stored(packed.groupBy("bucket").applyInArrow(lambda t: _candidates(t, threshold), _FOUND), "line-pairs")
        settled = _similar(found.where("kind = 0"), rows, threshold)
        out = again.union(settled)
        rest = stored(found.where("kind = 1").select("doc_id", "line").distinct().join(settled, ["doc_id", "line"], "left_anti"), "line-rest")
        if not rest.isEmpty():
            out = out.union(_searched_again(rest, found.where("kind = 2"), rows, threshold))
        done = stored(out.distinct(), "lines-gone")
    for table in (scan, owners, found, settled, rest):  # the result stands by itself
        discard(table)
    return done


def _searched_again(rest: DataFrame, lists: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Lines that long lists left open, against every posting of these lists."""
    fields = ("doc_id", "line", "n", "pos", "block", "p0", "p1")
    every = lists.select("list", *fields)
    p = every.join(rest, ["doc_id", "line"], "left_semi").select("list", *[F.col(c).alias(f"y_{c}") for c in fields])
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("y_n")) - 1e-9)
    earlier = (F.col("doc_id") < F.col("y_doc_id")) | ((F.col("doc_id") == F.col("y_doc_id")) & (F.col("line") < F.col("y_line")))
    met = (
        every.join(p, "list").where(earlier & ((F.col("block") != F.col("y_block")) | (F.col("block") < 0)))
        .where(F.least("n", "y_n") >= threshold * F.greatest("n", "y_n") - 1e-9)
        .where(F.least(F.col("n") - F.col("pos"), F.col("y_n") - F.col("y_pos")) >= need)
        .withColumn("apart", F.bit_count(F.col("p0").bitwiseXOR(F.col("y_p0"))) + F.bit_count(F.col("p1").bitwiseXOR(F.col("y_p1"))))
        .where(F.col("n") + F.col("y_n") - F.col("apart") >= 2 * need)
    )
    pairs = stored(met.select(F.col("y_doc_id").alias("doc_id"), F.col("y_line").alias("line"), F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line"), "apart").distinct(), "line-again")
    out = _similar(pairs, rows, threshold)
    discard(pairs)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the text of the lines that stay, plus n_lines and n_removed (columns of those names are replaced).

    Lines are cut at line feeds; the lines that stay are joined by line feeds in their order, untouched. A null text
    stays null and has no lines. Rows with a null id are left as they are. Rows repeated with one id share line
    numbers: a line goes from all of them if it goes from one, and a second copy of the same row loses nothing of its
    own. An empty table gives an empty result.
    """
    bare, (id_col, text_col), _ = numbered(docs.drop("n_lines", "n_removed"), id_col, text_col)
    gone = removed_lines(bare, id_col, text_col, threshold)
    split = F.split(F.col(text_col), "\n")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long")
    key = F.col(id_col).cast("long")
    if gone.count() <= BROADCAST_LINES:  # the texts stay where they are
        t = gone.toArrow()
        order = np.lexsort((t["line"].to_numpy(), t["doc_id"].to_numpy()))
        known = docs.sparkSession.sparkContext.broadcast((t["doc_id"].to_numpy()[order], t["line"].to_numpy()[order]))

        @F.arrow_udf("array<long>")
        def gone_from(ids: pa.Array) -> pa.Array:
            doc, line = known.value
            own, has = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
            return pa.array([line[a:b] if a < b and ok else None for a, b, ok in zip(low, high, has)], pa.list_(pa.int64()))

        joined = bare.withColumn("gone", gone_from(key))
    else:
        lists = gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
        joined = bare.join(lists, key == F.col("doc_id"), "left")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i.cast("long"))), "\n")
    others = [F.when(F.col("gone").isNull(), F.col(n)).otherwise(kept).alias(c) if n == text_col else F.col(n).alias(c) for n, c in zip(bare.columns, docs.drop("n_lines", "n_removed").columns)]
    return joined.select(*others, n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
