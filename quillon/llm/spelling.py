"""Spelling variants: words that are one edit apart, by dense tiles of padded code-point matrices.

Words are counted first: tasks cut the bytes of whole batches of texts into runs of letters with numpy, so a word costs
no Python object until it is distinct. Two words differ by one edit when their common prefix and common suffix together
reach the longer length less one. Of such a pair with longer length M, either the first h = ceil((M - 1) / 2) code
points agree or the last M - h do, so words meet in the groups of such halves. A group is dealt out in blocks of a fixed
number of words and each pair of blocks is a tile of its own, so a half that very many words share is compared in many
tasks. A tile's words stand in two matrices, one padded on the right and one on the left, from which prefixes and
suffixes of many pairs are counted at once. Tiles put out a row a word (how many are near, and the best), no pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, hot_and_cold, small_batches, stored, tidied

#: Of (document, word) pairs, those whose checksum this number divides lose a letter.
EVERY = 97
#: The fewest code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a block; and the words and pairs that a task compares at once, and the cells of a matrix of pairs.
BLOCK_WORDS = 1_024
CHUNK_WORDS = 16_384
MOST_PAIRS = 1 << 18
MOST_CELLS = 1 << 21
#: Bytes of text that a task cuts at once.
BATCH_BYTES = 6 << 20
#: Checksums of so many bytes after a document's id are continued for all words at once; longer words one by one.
LONG = 48

_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # what a byte adds to a checksum, by its linearity
_UPPER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([97 <= b <= 122 for b in range(256)])


def _continued(crcs: np.ndarray) -> np.ndarray:
    """[k, i]: what the checksum crcs[i] becomes by k more bytes, but for these bytes' own checksum."""
    out = np.empty((LONG + 1, len(crcs)), np.uint32)
    out[0] = crcs
    for k in range(LONG):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ _TABLE[out[k] & np.uint32(255)]
    return out


def word_runs(text: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters mask, starts, ends) of the maximal runs of a-z and U+00C0 to U+00FF in UTF-8 bytes; none goes over a break.

    In UTF-8 those 64 characters are the ones whose first byte is C3.
    """
    n = len(text)
    mask = _LETTER[text]
    lead = np.flatnonzero(text == 0xC3)
    mask[lead] = True
    mask[np.minimum(lead + 1, n - 1)] = True
    before = np.zeros(n + 1, bool)
    before[1:] = mask
    after = np.zeros(n + 1, bool)
    after[:-1] = mask
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return mask, starts, ends


def count_words(ids: list[str], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of LEAST_LENGTH code points or more, their counts) of some documents, letters deleted where the checksum says so. Words may repeat."""
    texts = pa.concat_arrays([pa.array([], pa.large_binary()), texts.cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    text = _UPPER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    mask, starts, ends = word_runs(text, offsets)
    sizes = ends - starts
    letters = text[mask]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(letters)])
    coded = runs.dictionary_encode()
    code = coded.indices.to_numpy()
    words = coded.dictionary.to_pylist()
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    doc = np.repeat(np.arange(len(ids)), np.diff(np.searchsorted(starts, offsets)))
    prefixes = [f"{i}:".encode() for i in ids]
    grown = _continued(np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes)))
    sums = grown[np.minimum(sizes, LONG), doc] ^ own[code]
    for i in np.flatnonzero(sizes > LONG).tolist():
        sums[i] = zlib.crc32(words[code[i]], zlib.crc32(prefixes[doc[i]]))
    cut = sums % np.uint32(EVERY) == 0
    counts = np.bincount(code[~cut], minlength=len(words))
    changed: Counter[str] = Counter()
    for k, h in zip(code[cut].tolist(), sums[cut].tolist()):
        word = words[k].decode()
        at = h % len(word)
        if len(word) > LEAST_LENGTH:
            changed[word[:at] + word[at + 1 :]] += 1
    whole = coded.dictionary.cast(pa.large_string())
    long = (pc.utf8_length(whole).to_numpy() >= LEAST_LENGTH) & (counts > 0)
    return pa.concat_arrays([whole.filter(pa.array(long)), pa.array(list(changed), pa.large_string())]), np.concatenate([counts[long], np.fromiter(changed.values(), np.int64, len(changed))])


@tidied
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, limit=BATCH_BYTES):
        words, counts = count_words(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), ""))
        yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. Counts are added up in the tasks before one shuffle by word."""
    held = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`").cast("string"))
    return held.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _half(longest: str) -> str:
    """ceil((M - 1) / 2), as SQL."""
    return f"cast({longest} div 2 as int)"


def tiles(words: DataFrame) -> DataFrame:
    """tile, longest, kind, across, block, word, n: each word in every tile where it may meet a near one.

    A word of L code points is in four groups: by its first and by its last half, for pairs with longest length L and
    L + 1. Groups of up to BLOCK_WORDS words are one tile; in larger ones each pair of blocks is one (across says that it is of two).
    """
    length = F.length("word")
    ways = F.array(*[F.struct((length + more).alias("longest"), F.lit(kind).alias("kind")) for more in (0, 1) for kind in ("first", "last")])
    each = words.select("word", "n", F.inline(ways))
    half = F.expr(f"CASE WHEN kind = 'first' THEN left(word, {_half('longest')}) ELSE right(word, longest - {_half('longest')}) END")
    each = stored(each.withColumn("half", half), "spelling-halves")
    group = ["longest", "kind", "half"]
    large = stored(each.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_WORDS), "spelling-large")
    hot, cold = hot_and_cold(large, "size", each.count())
    sized = each.join(cold.withColumnRenamed("size", "cold_size"), group, "left").join(hot.withColumnRenamed("size", "hot_size"), group, "left")
    blocks = F.ceil(F.coalesce("cold_size", "hot_size", F.lit(1)) / BLOCK_WORDS).cast("int")
    dealt = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.concat_ws(" ", "longest", "kind", F.least("block", "other"), F.greatest("block", "other"), "half")
    return met.select(tile.alias("tile"), "longest", "kind", (F.col("block") != F.col("other")).alias("across"), "block", "word", "n")


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points one after the other, where each word begins and the last ends)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def near_pairs(words: list[str], longest: np.ndarray, first: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the pairs (indices into words) of one group each are exactly one edit apart.

    A pair that meets in the group of its last halves doesn't count if its first halves agree as well: it meets there.
    """
    flat, at = code_points(words)
    sizes = np.diff(at)
    found = np.zeros(len(pairs[0]), bool)
    for width in np.unique(longest[pairs[0]]).tolist():
        chosen = np.flatnonzero((longest[pairs[0]] == width) & (np.maximum(sizes[pairs[0]], sizes[pairs[1]]) == width))
        rows = np.flatnonzero(longest == width)
        place = np.zeros(len(words), np.int64)
        step = max(1, MOST_CELLS // (width + 1))
        for k in range(0, len(chosen), step):
            part = chosen[k : k + step]
            used = rows if len(rows) <= step else np.unique(np.concatenate([pairs[0][part], pairs[1][part]]))
            place[used] = np.arange(len(used))
            left = np.zeros((len(used), width + 1), np.uint32)  # a column more, where no pair agrees
            right = np.zeros((len(used), width + 1), np.uint32)
            size = sizes[used]
            row = np.repeat(np.arange(len(used)), size)
            column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            points = flat[column + np.repeat(at[used], size)]
            left[row, column] = points
            right[row, np.repeat(size, size) - 1 - column] = points
            a, b = place[pairs[0][part]], place[pairs[1][part]]
            prefix, suffix = _agreeing(left, a, b), _agreeing(right, a, b)
            near = np.minimum(prefix + suffix, width) == width - 1
            near |= (prefix + suffix >= width) & (size[a] != size[b])
            found[part] = near & (first[pairs[0][part]] | (prefix < width // 2))
    return found


def _agreeing(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points at the beginning of the rows a and b agree; the padding of a shorter word agrees with nothing of a longer one."""
    same = matrix[a] == matrix[b]
    same[:, -1] = False
    return same.argmin(axis=1)


def _pairs_of(begins: np.ndarray, ends: np.ndarray, across: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the tiles at [begin, end), rows by block: all pairs in a tile of one block, pairs across in one of two."""
    tile = np.repeat(np.arange(len(begins)), ends - begins)
    row = np.arange(len(tile))
    in_first = blocks == blocks[begins][tile]
    second = begins + np.bincount(tile, weights=in_first, minlength=len(begins)).astype(np.int64)  # where the rows of the second block begin
    start = np.where(across, second[tile], row + 1)
    many = np.where(across & ~in_first, 0, ends[tile] - start)
    done = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < len(row):
        to = max(k + 1, int(np.searchsorted(done, done[k] + MOST_PAIRS, side="right")) - 1)
        n = many[k:to]
        a = np.repeat(row[k:to], n)
        if len(a):
            yield a, np.repeat(start[k:to], n) + np.arange(len(a)) - np.repeat(done[k:to] - done[k], n)
        k = to


def compare_tiles(table: pa.Table) -> pa.RecordBatch | None:
    """word, n_near, best_n, best of whole tiles, sorted by tile and block; one row a word and tile at most."""
    tile = pc.index_in(table["tile"], pc.unique(table["tile"])).to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    ends = np.append(begins[1:], len(tile))
    words = table["word"].to_pylist()
    longest, blocks = table["longest"].to_numpy().astype(np.int64), table["block"].to_numpy()
    first = pc.equal(table["kind"], "first").to_numpy()
    n = table["n"].to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))  # strings compare by code points
    by_rank = np.argsort(rank)
    near_count, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    best_n = np.zeros(len(words), np.int64)
    for a, b in _pairs_of(begins, ends, table["across"].to_numpy(), blocks):
        hit = near_pairs(words, longest, first, (a, b))
        for x, y in ((a[hit], b[hit]), (b[hit], a[hit])):
            near_count += np.bincount(x, minlength=len(words))
            order = np.lexsort((-rank[y], n[y], x))  # the last of each x is the best
            x, y = x[order], y[order]
            last = np.flatnonzero(np.append(x[1:] != x[:-1], True)) if len(x) else np.zeros(0, np.int64)
            x, y = x[last], y[last]
            better = (n[y] > best_n[x]) | ((n[y] == best_n[x]) & (rank[y] < best[x]))
            best_n[x[better]], best[x[better]] = n[y[better]], rank[y[better]]
    hits = np.flatnonzero(near_count)
    if not len(hits):
        return None
    held = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays(
        [held.take(pa.array(hits)), pa.array(near_count[hits]), pa.array(best_n[hits]), held.take(pa.array(by_rank[best[hits]]))], ["word", "n_near", "best_n", "best"]
    )


@tidied
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; whole tiles of about CHUNK_WORDS words are compared at once. A tile has two blocks of words at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_WORDS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = pc.index(table["tile"], table["tile"][-1]).as_py()
        if last:
            out = compare_tiles(table.slice(0, last))
            if out is not None:
                yield out
        held = table.slice(last).to_batches()
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    out = compare_tiles(table) if table is not None and table.num_rows else None
    if out is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: for each of the words (distinct, with n) that has any, how many are one edit away, and the one with the largest n (ties: the smallest)."""
    dealt = tiles(words)
    out = dealt.repartition("tile").sortWithinPartitions("tile", "block").mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first"))
    return found.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the pointers word -> form end. Counts at least double along them, so there is no cycle and few rounds of doubling."""
    jump = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        x, y = jump.select("word", "root"), jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = stored(x.join(y, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(jump)
        jump = farther
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where EVERY divides the checksum of
    "<id>:<run>" the run loses its code point number checksum % length. Words have LEAST_LENGTH code points and LEAST_COUNT
    occurrences at least. A word's form is its near word of largest n (ties: the smallest by code points), if that is twice
    its own n or more; else form and form_n are null. root is where the forms lead, the word itself without one.

    A null text has no words, a null id counts as an empty one, repeated rows count as often as they come, other columns
    aren't read, and an empty table gives an empty one.
    """
    words = stored(word_counts(docs, id_col, text_col), "spelling-words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    judged = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    led = judged.join(roots(judged.where("form IS NOT NULL")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
