"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted documents are split into two folds by the hash of their ids; a document is scored by the model of the other
fold, so no document is judged by its own words. Every word type of the trusted text has counts of its own; all other
words are one unknown class. Words are known by 63 bits of a hash and bigrams by 63 bits of their words' hashes, so no
vocabulary is sent around. The log probability of a bigram is that of its context's back-off weight and its word's
continuation probability, plus a gain if it was seen; so a document's score is a sum of values looked up by word and by
bigram. Both are dealt to shards by their hashes, which spreads the bigrams of a hot context too, and the number of
shards comes from the counted words. Sums come back by document. A document is rejected if its perplexity is above a
quantile of the trusted documents' perplexities in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import discard, numbered, shuffles_freed, small_batches, stored, tidied

#: Least number of shards, and the trusted words of a fold for each of them.
SHARDS, SHARD_WORDS = 16, 4_000_000
#: Words of documents whose questions to one shard meet in one place.
SLICE_WORDS = 8_000_000
#: Parts of each fold's documents that are scored one after another, so that only one part's questions take up disk.
PARTS = 2
#: Words that a task holds before it deals out their counts or questions.
HELD_WORDS = 500_000
QUANTILE = 0.99
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Largest number of trusted ids that is broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 4_000_000
#: Bins of log perplexity that quantiles are read from.
BINS = 1_000


def fold_of(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), 5) & 1


def part_of(doc_id: int | None) -> int:
    return (xxhash.xxh64_intdigest(str(doc_id).encode(), 5) >> 1) % PARTS


def words_of(text: str | None) -> list[str]:
    """Words with the punctuation on them; case is kept, since shouting is a sign too."""
    return (text or "").split()


def _among(batches: Iterator[pa.RecordBatch], ids) -> Iterator[pa.RecordBatch]:
    """The rows whose id is one of the broadcast sorted ids."""
    known = ids.value
    for batch in batches:
        own = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        yield batch.filter(pa.array(known[at] == own)) if len(known) else batch.slice(0, 0)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of bigrams that occur one to four times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])


#: Stands for a text's start and end; no word has a space.
EDGE_HASH = np.int64(xxhash.xxh3_64_intdigest(b" ") >> 1)


def hashed_words(text: str | None) -> np.ndarray:
    """63 bits for each word."""
    words = words_of(text)
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, map(partial(str.encode, errors="surrogatepass"), words)), np.uint64, len(words)) >> np.uint64(1)).view(np.int64)


def hashed_bigrams(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    c, w = context.view(np.uint64), word.view(np.uint64)
    x = (c ^ (c >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).view(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the leading bits, so that sorted keys are sorted by shard."""
    return (keys >> 31) * shards >> 32


def _edged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of the bigrams of texts one after another, edges included."""
    edge = np.array([EDGE_HASH])
    context = np.concatenate([x for r in rows for x in (edge, r)])
    word = np.concatenate([x for r in rows for x in (r, edge)])
    return context, word


def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width, byte by byte of all, compressed; the first byte is the width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - 1))
    return bytes([width]) + zstandard.compress(x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _large(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<i{b[0]}").ravel().astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    """Ascending integers."""
    return _small(np.diff(x, prepend=0))


def _climbed(b: bytes) -> np.ndarray:
    return np.cumsum(_large(b))


def _row(names: list[str], *values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names)


def _joined(table: pa.Table, column: str, decode) -> np.ndarray:
    parts = [decode(x) for x in table[column].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@tidied
def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the word types of some texts, with their counts by fold."""
    held: tuple[list, list] = ([], [])

    def rows() -> Iterator[pa.RecordBatch]:
        for fold, parts in enumerate(held):
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array(h), *[pa.array(n if k == fold else np.zeros(len(n), np.int64)) for k in (0, 1)]], ["h", "n0", "n1"])
            parts.clear()

    for batch in small_batches(batches):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[fold_of(i)].append(hashed_words(text))
        if sum(len(x) for parts in held for x in parts) > HELD_WORDS:
            yield from rows()
    yield from rows()


def _texts(batches: Iterator[pa.RecordBatch], fold: int, part: int | None = None) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and hashed words of one fold's texts (or a part of them), about HELD_WORDS at a time."""
    ids, rows, held = [], [], 0
    for batch in small_batches(batches):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if fold_of(i) == fold and part in (None, part_of(i)):
                ids.append(NO_ID if i is None else i)
                rows.append(hashed_words(text.as_py()))
                held += len(rows[-1]) + 1
                if held > HELD_WORDS:
                    yield ids, rows
                    ids, rows, held = [], [], 0
    if rows:
        yield ids, rows


_COUNTED = "shard long, c binary, w binary, n binary"


def _counted(keys: np.ndarray, c: np.ndarray, w: np.ndarray, n: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams, one row a shard, sorted by context and word."""
    ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        a, b = ends[s], ends[s + 1]
        if a < b:
            order = np.lexsort((w[a:b], c[a:b])) + a
            yield _row(["shard", "c", "w", "n"], s, _steps(c[order]), _small(w[order]), _small(n[order]))


@tidied
def _bigram_counts(batches: Iterator[pa.RecordBatch], fold: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Training counts of one task, combined before they are dealt out."""
    for _, rows in _texts(batches, fold):
        c, w = _edged(rows)
        keys, first, n = np.unique(hashed_bigrams(c, w), return_index=True, return_counts=True)
        yield from _counted(keys, c[first], w[first], n, shards)


def _summed(table: pa.Table, shards: int) -> pa.Table:
    """The counts of one shard."""
    c, w, n = _joined(table, "c", _climbed), _joined(table, "w", _large), _joined(table, "n", _large)
    keys, first, place = np.unique(hashed_bigrams(c, w), return_index=True, return_inverse=True)
    return pa.Table.from_batches(list(_counted(keys, c[first], w[first], np.bincount(place, n).astype(np.int64), shards)))


_SUMS = ("total", "once", "twice", "more", "follow")
_TYPED = "kind long, shard long, owner long, h binary, " + ", ".join(f"{x} binary" for x in _SUMS)
#: Kinds of rows: counts that a bigram shard sends of its types, the sums that it gets back, and a type shard's own.
SENT, BACK, OWN = 0, 1, 2


def _typed(kind: int, shard: int, owner: int, h: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
    return _row(["kind", "shard", "owner", "h", *_SUMS], kind, shard, owner, _steps(h), *map(_small, sums))


def _type_counts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each bigram shard and type: its count as a context, how many of its bigrams occur once, twice or more, how many contexts it follows."""
    for batch in batches:
        for s, c, w, n in zip(*(batch.column(x).to_pylist() for x in ("shard", "c", "w", "n"))):
            c, w, n = _climbed(c), _large(w), _large(n)
            h, place = np.unique(np.concatenate([c, w]), return_inverse=True)
            at, to = place[: len(c)], place[len(c) :]
            sums = [np.bincount(at, x, len(h)).astype(np.int64) for x in (n, n == 1, n == 2, n > 2)] + [np.bincount(to, minlength=len(h))]
            ends = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
            for t in range(shards):
                a, b = ends[t], ends[t + 1]
                if a < b:
                    yield _typed(SENT, t, s, h[a:b], [x[a:b] for x in sums])


def _without_counts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """All types of both folds: one that only the other fold has isn't unknown."""
    for batch in batches:
        h = np.sort(batch.column(0).to_numpy())
        ends = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
        for t in range(shards):
            part = h[ends[t] : ends[t + 1]]
            if len(part):
                yield _typed(SENT, t, -1, part, [np.zeros(len(part), np.int64)] * len(_SUMS))


def _type_sums(table: pa.Table) -> pa.Table:
    """The sums of one shard's types, for itself and for each bigram shard that asked."""
    owners, asked = table["owner"].to_pylist(), [_climbed(x) for x in table["h"].to_pylist()]
    h, place = np.unique(np.concatenate(asked), return_inverse=True)
    sums = [np.bincount(place, _joined(table, x, _large), len(h)).astype(np.int64) for x in _SUMS]
    own = table["shard"][0].as_py()
    out = [_typed(OWN, own, own, h, sums)]
    for owner, part in zip(owners, asked):
        if owner < 0:
            continue
        at = np.searchsorted(h, part)
        out.append(_typed(BACK, owner, own, part, [x[at] for x in sums]))
    return pa.Table.from_batches(out)


def _occurrences(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """How many of a column's counts are 1, 2, 3, 4, and over 4 (5), and their sum (0)."""
    for batch in batches:
        for x in batch.column(column).to_pylist():
            n = _large(x)
            yield pa.record_batch([pa.array(range(6)), pa.array([int(n.sum()), *((n == i).sum() for i in range(1, 5)), (n > 4).sum()], pa.int64())], ["of", "n"])


def _occurring(df: DataFrame, column: str) -> np.ndarray:
    found = np.zeros(6, np.int64)
    for r in df.select(column).mapInArrow(partial(_occurrences, column=column), "of long, n long").groupBy("of").agg(F.sum("n").alias("n")).collect():
        found[r["of"]] = r["n"]
    return found


class Levels:
    """What every shard of one fold needs to turn sums into probabilities."""

    def __init__(self, bigrams_: np.ndarray, follow: np.ndarray, types: int):
        self.d, self.lower_d = discounts(bigrams_[1:5]), discounts(follow[1:5])
        self.total = max(float(follow[0]), 1.0)
        cut = follow[1] * self.lower_d[0] + follow[2] * self.lower_d[1] + follow[3:].sum() * self.lower_d[2]
        self.even = (cut / self.total if follow[0] else 1.0) / (types + 3)  # the edge, and the unknown class for two
        self.unknown = float(np.log(2 * self.even))

    def of(self, total: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-off weights and continuation probabilities of types."""
        weight = np.where(total > 0, (once * self.d[0] + twice * self.d[1] + more * self.d[2]) / np.maximum(total, 1), 1.0)
        cut = np.select([follow == 1, follow == 2, follow > 2], self.lower_d, 0.0)
        return weight, np.maximum(follow - cut, 0) / self.total + self.even


_TABLE = "shard long, keys binary, gain binary"


def _table(counted: pa.Table, typed: pa.Table, levels: Levels) -> pa.Table:
    """Gains of one shard's words over the unknown class, and of its bigrams over their words."""
    own, back = (typed.filter(pa.array(typed["kind"].to_numpy() == k)) for k in (OWN, BACK))
    keys, gains, shard = [], [], (typed if len(typed) else counted)["shard"][0].as_py()
    if len(own):
        keys.append(_joined(own, "h", _climbed))
        weight, lower = levels.of(*(_joined(own, x, _large) for x in _SUMS))
        gains.append(np.log(weight) + np.log(lower) - levels.unknown)
    if len(counted):
        c, w, n = _joined(counted, "c", _climbed), _joined(counted, "w", _large), _joined(counted, "n", _large)
        h, sums = _joined(back, "h", _climbed), [_joined(back, x, _large) for x in _SUMS]
        order = np.argsort(h)
        h, sums = h[order], [x[order] for x in sums]
        weight, lower = levels.of(*sums)
        at, to = np.searchsorted(h, c), np.searchsorted(h, w)
        rest = np.maximum(n - np.select([n == 1, n == 2, n > 2], levels.d, 0.0), 0) / sums[0][at]
        keys.append(hashed_bigrams(c, w))
        gains.append(np.log1p(rest / (weight[at] * lower[to])))
    keys, gains = np.concatenate(keys), np.concatenate(gains)
    order = np.argsort(keys)
    return pa.Table.from_batches([_row(["shard", "keys", "gain"], shard, _steps(keys[order]), gains[order].tobytes())])


_ASK = "shard long, slice long, ids binary, keys binary, docs binary, n binary"


@tidied
def _asked(batches: Iterator[pa.RecordBatch], fold: int, part: int, shards: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The words and bigrams of many documents at a time, packed by the shard that answers them."""
    for ids, rows in _texts(batches, fold, part):
        c, w = _edged(rows)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) + 1 for x in rows])
        keys, doc = np.concatenate([hashed_bigrams(c, w), w]), np.concatenate([doc, doc])
        del c, w
        order = np.argsort(keys, kind="stable")  # bigrams and words are apart, so documents ascend in a key
        keys, doc = keys[order], doc[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        at = np.nonzero(first)[0]
        n = np.diff(at, append=len(keys))
        keys, doc = keys[at], doc[at]
        ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        known = np.array(ids, np.int64)
        piece = int(xxhash.xxh3_64_intdigest(known.tobytes()) % slices)
        for s in range(shards):
            a, b = ends[s], ends[s + 1]
            if a < b:
                here, local = np.unique(doc[a:b], return_inverse=True)
                yield _row(["shard", "slice", "ids", "keys", "docs", "n"], s, piece, known[here].tobytes(), _steps(keys[a:b]), _small(local), _small(n[a:b]))


def _scored(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The questions of one slice to one shard against the shard's table: sums of gains by id, and the number of questions."""
    if not len(asked):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["id", "gain", "n"])
    keys = _climbed(model["keys"][0].as_py()) if len(model) else np.zeros(1, np.int64) - 1
    gain = np.append(np.frombuffer(model["gain"][0].as_py()) if len(model) else np.zeros(1), 0.0)
    ids, sums, counts = [], [], []
    for i, k, d, c in zip(*(asked[x] for x in ("ids", "keys", "docs", "n"))):
        k, d, c = _climbed(k.as_py()), _large(d.as_py()), _large(c.as_py())
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        ids.append(np.frombuffer(i.as_py(), np.int64))
        sums.append(np.bincount(d, np.where(keys[at] == k, gain[at], 0.0) * c))
        counts.append(np.bincount(d, c).astype(np.int64))
    return pa.table([pa.array(np.concatenate(x)) for x in (ids, sums, counts)], ["id", "gain", "n"])


def _by_fold(rows: DataFrame, chosen: DataFrame, types: DataFrame, fold: int, n_types: int, shards: int, slices: int) -> DataFrame:
    """id, perplexity of the other fold's documents under the model of one fold."""
    counts = chosen.mapInArrow(partial(_bigram_counts, fold=fold, shards=shards), _COUNTED)
    counted = stored(counts.groupBy("shard").applyInArrow(lambda t: _summed(t, shards), _COUNTED), "lm-bigrams")
    sent = counted.mapInArrow(partial(_type_counts, shards=shards), _TYPED).union(types.select("h").mapInArrow(partial(_without_counts, shards=shards), _TYPED))
    typed = stored(sent.groupBy("shard").applyInArrow(_type_sums, _TYPED), "lm-types")
    levels = Levels(_occurring(counted, "n"), _occurring(typed.where(F.col("kind") == OWN), "follow"), n_types)
    table = stored(counted.groupBy("shard").cogroup(typed.groupBy("shard")).applyInArrow(partial(_table, levels=levels), _TABLE), "lm-table")
    discard(counted)
    discard(typed)
    sliced = table.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    parts = []
    for part in range(PARTS):
        asked = rows.mapInArrow(partial(_asked, fold=1 - fold, part=part, shards=shards, slices=slices), _ASK)
        met = asked.groupBy("shard", "slice").cogroup(sliced.groupBy("shard", "slice")).applyInArrow(_scored, "id long, gain double, n long")
        sums = met.groupBy("id").agg(F.sum("gain").alias("gain"), (F.sum("n") / 2).alias("n"))  # a word and a bigram for each place
        parts.append(stored(sums.select("id", F.exp(-F.col("gain") / F.col("n") - levels.unknown).alias("perplexity")), "lm-part"))
    discard(table)
    return reduce(DataFrame.union, parts)


def perplexities(docs: DataFrame, trusted: DataFrame, trusted_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, perplexity: one row an id of docs (NO_ID stands for null); rows of one id are scored together.

    trusted has one id a row (nulls and repeats are ignored). An empty or null text is scored on its edges alone. The
    perplexity is null where the other fold has no trusted word at all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = stored(trusted.select(F.col(trusted_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "lm-trusted")
    if known.count() <= BROADCAST_IDS:  # the texts stay where they are
        sorted_ids = spark.sparkContext.broadcast(np.sort(known.toArrow()["doc_id"].to_numpy()))
        chosen = rows.mapInArrow(partial(_among, ids=sorted_ids), rows.schema)
    else:
        chosen = rows.join(known, "doc_id", "left_semi").select("doc_id", "text")
    types = chosen.mapInArrow(_types, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    with shuffles_freed(spark):
        types = stored(types, "lm-words")
    total = types.agg(F.count("*").alias("types"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    words = [total["n0"] or 0, total["n1"] or 0]
    ids = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).distinct().withColumn("perplexity", F.lit(None).cast("double"))
    if max(words) == 0:
        return ids
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-max(words) // SHARD_WORDS))
    slices = max(1, -(-size // (6 * SLICE_WORDS * shards * 2 * PARTS)))
    with shuffles_freed(spark):
        parts = [_by_fold(rows, chosen, types, fold, total["types"], shards, slices) for fold in (0, 1) if words[fold]]
    discard(types)
    found = reduce(DataFrame.union, parts)
    return found if len(parts) == 2 else found.union(ids.join(found.select("id"), "id", "left_anti"))


def language_thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """_lang, threshold from rows (_lang, perplexity) of trusted documents: the upper edge of the bin in which the quantile falls."""
    binned = scored.where("perplexity IS NOT NULL").groupBy("_lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("_lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = binned.withColumn("below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("_lang")))
    return summed.where(F.col("below") >= F.col("all") * quantile).groupBy("_lang").agg(F.exp((F.min("bin") + 1) / BINS).alias("threshold"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """docs plus perplexity, threshold and kept (columns of those names are replaced).

    Documents whose id has a label of quality 1 (in every label of it) are trusted. A language (null is one) takes its
    threshold from its trusted documents; one without any takes the largest of the others. Where the other fold has no
    trusted word a document can't be judged: its perplexity is null and it is kept. A document without words is
    kept or rejected like any other. Rows of one id are scored together. Empty tables give an empty result.
    """
    made, label_col = ("perplexity", "threshold", "kept"), id_col
    bare, (id_col, text_col, lang_col), columns = numbered(docs.drop(*made), id_col, text_col, lang_col)
    labelled, (label_id, quality_col), _ = numbered(labels, label_col, quality_col)
    trusted = labelled.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.min(quality_col).alias("q"), F.max(F.col(quality_col).isNull()).alias("unknown")).where("q = 1 AND NOT unknown").select("id")
    scores = stored(perplexities(bare, trusted, "id", id_col, text_col), "lm-scores")
    key, lang = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(lang_col).cast("string")
    good = bare.select(key.alias("id"), lang.alias("_lang")).join(trusted, "id", "left_semi").distinct().join(scores, "id")
    limits = stored(language_thresholds(good, quantile), "lm-thresholds")
    most = limits.agg(F.max("threshold").alias("most"))
    out = bare.withColumn("id", key).withColumn("lang", lang)
    out = out.join(scores, "id", "left").join(limits, out["lang"].eqNullSafe(limits["_lang"]), "left").join(F.broadcast(most))  # a row a language, and one row
    limit = F.coalesce("threshold", "most")
    return out.select(*columns, "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))
