"""Mixing sources to target weights, with DataFrame operations only.

Every source is one stream of words: its documents one after the other in a pseudorandom order, packed into blocks of a
fixed number of words. Each source is given as many output slots as its target needs. The slots of all sources are
laid out as one list; a pseudorandom permutation deals the list to output shards, so the number of slots that a shard
has from each source is a multinomial draw that is conditioned on the sources' totals. A slot is mapped through the
permutation of its source to a block index; a source that gives more words than it has starts a new round with another
permutation. Blocks join slots by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import WORD, numbered, stored

#: Documents of a source are ordered by bucket, then id: the running word count is kept in two levels. Least number of
#: buckets, and the rows for each of them.
BUCKETS, BUCKET_ROWS = 1024, 100_000
ROUNDS = 12


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of [0, n), chosen by key: the swap-or-not shuffle (Hoang, Morris and Rogaway 2012)."""

    def step(acc: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - acc, n)
        swap = F.pmod(F.xxhash64(key, i, F.greatest(acc, other), F.lit("swap")), F.lit(2)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources by code point, null last, take the weights in turn and share `share` times all words. No target is above
    `most` times its source; what a source can't take is shared by weight among the others until none is above. With
    sources in ascending order of limit / weight this has a closed form: the first k are at their limits, and
    the rest share what is left. One row a source, so the windows see a small dimension table.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", turn).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_taken", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("_level", F.greatest(F.lit(0.0), F.col("_all") - F.col("_taken")) / F.col("_rest"))
        .withColumn("_full", F.col("_limit") <= F.col("_level") * F.col("weight"))
    )
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy())
    return rows.select(
        "source", "source_size", "weight",
        F.when(F.col("_full") | level.isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), level * F.col("weight"))).alias("target"),
    )


def mix_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", block_words: int = 2048, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, with_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots).

    Texts are read once to count their words; the sizes are kept in the shared folder, and all else is worked out from
    them. Only with with_text are texts read again, to go into documents. A row a source meets in one task, so sources
    may be domains (a million of them are some hundred megabytes), but not documents.

    documents: docs plus _size (words), _source_size, _target, _bucket, _row (place in the bucket) and _start (words of
    the source before it). pieces: _source, _bucket, _row, round, _from, _to: the words of a document, counted from its
    first, that one slot delivers. slots: shard, slot, source, round, index, block_from and words.
    """
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text)).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))  # rows without an id are no one bucket
    given = docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int")).withColumn("_source", F.col(source_col))
    rows = stored(given.drop(text_col), "mix-sizes")
    # only (source, bucket) totals are shared between tasks
    totals = stored(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words")), "mix-totals")
    sizes = totals.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    plan = source_targets(sizes, weights, share, most)
    plan = (
        plan.withColumn("_goal", F.round("target").cast("long"))
        .withColumn("_goal", F.least("_goal", F.floor(F.col("source_size") * F.lit(float(most)))))
        .withColumn("_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("_turns", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_slots", F.col("_turns") * F.col("_blocks") + F.ceil((F.col("_goal") - F.col("_turns") * F.col("source_size")) / block_words).cast("long"))
    )
    in_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_base", F.coalesce(F.sum("_words").over(in_source), F.lit(0)))
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy(F.col(id_col), F.col("_size"))
    small = plan.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    base = offsets.select(F.col("_source").alias("_s2"), F.col("_bucket").alias("_b2"), "_base")

    def laid_out(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_row", F.row_number().over(in_bucket)).withColumn("_in", F.coalesce(F.sum("_size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return (
            placed.join(base, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_bucket") == F.col("_b2")))
            .join(small, F.col("_source").eqNullSafe(F.col("_s")))
            .withColumn("_start", F.col("_base") + F.col("_in"))
            .drop("_s", "_s2", "_b2", "_in", "_base", "_words")
        )

    documents = laid_out(rows)
    slots = _slots(plan, block_words, seed)
    last = F.col("_start") + F.col("_size") - 1
    cut = (
        documents.where("_size > 0").select("_source", "_bucket", "_row", "_start", "_size")
        .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block_words), F.floor(last / block_words))))
    )
    s = slots.select(F.col("source").alias("_s"), F.col("index").alias("_i"), "round", "block_from", "words")
    begin = F.greatest(F.col("block_from"), F.col("_start")) - F.col("_start")
    end = F.least(F.col("block_from") + F.col("words"), F.col("_start") + F.col("_size")) - F.col("_start")
    pieces = (
        cut.join(s, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_i")))
        .select("_source", "_bucket", "_row", "round", begin.alias("_from"), end.alias("_to")).where("_to > _from")
    )
    return laid_out(given) if with_text else documents, pieces, slots


#: Slots that one row of the first expansion stands for.
_CHUNK = 4096


def _slots(plan: DataFrame, block_words: int, seed: int, shard_slots: int = 1024) -> DataFrame:
    """One row a slot of the mix: its shard, its source, its round and its block.

    The short last block of a source is last in every round, so that the words before a slot have a closed form and
    the last slot can be cut to meet the target exactly.
    """
    names = ["source", "source_size", "_goal", "_blocks", "_slots"]
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = plan.select(*names).withColumn("_first", F.coalesce(F.sum("_slots").over(order), F.lit(0))).withColumn("_total", F.sum("_slots").over(Window.partitionBy())).where("_slots > 0")
    chunks = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / _CHUNK)))).repartition("source", "_chunk")
    one = chunks.withColumn("_t", F.explode(F.sequence(F.col("_chunk") * _CHUNK, F.least(F.col("_slots"), (F.col("_chunk") + 1) * _CHUNK) - 1)))
    full = F.floor(F.col("source_size") / block_words)
    one = (
        one.withColumn("_p", permuted(F.col("_first") + F.col("_t"), F.col("_total"), F.lit(seed)))
        .withColumn("round", F.floor(F.col("_t") / F.col("_blocks")))
        .withColumn("_j", F.col("_t") % F.col("_blocks"))
        .withColumn("index", F.when(F.col("_j") >= full, F.col("_j")).otherwise(permuted(F.col("_j"), F.greatest(full, F.lit(1)), F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("round")))))
        .withColumn("block_from", F.col("index") * block_words)
        .withColumn("words", F.least(F.lit(block_words), F.col("source_size") - F.col("block_from"), F.col("_goal") - F.col("round") * F.col("source_size") - F.col("_j") * block_words))
    )
    return one.select(F.floor(F.col("_p") / shard_slots).alias("shard"), (F.col("_p") % shard_slots).alias("slot"), "source", "round", "index", "block_from", "words")


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """documents plus _taken, the words that the mix takes from each."""
    sums = pieces.groupBy("_source", "_bucket", "_row").agg(F.sum(F.col("_to") - F.col("_from")).alias("_n"))
    sums = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.col("_row").alias("_r"), "_n")
    on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_row") == F.col("_r"))
    return documents.join(sums, on, "left").withColumn("_taken", F.coalesce("_n", F.lit(0)).cast("long")).drop("_s", "_b", "_r", "_n")


def mix_sources(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", with_text: bool = True, **options) -> DataFrame:
    """One row per row of docs: its columns (without with_text all but the text) plus size, source_size, target and taken (columns of those names are replaced).

    size counts the words of [^\\x20\\x09-\\x0D]+ (null or empty text: 0, which is never taken). A null source is a
    source of its own, the last. taken counts repeats and is at most 2 times size; the taken words of a source come to
    its target, rounded. Rows without an id are placed by their text. Repeated rows are rows of their own. The same rows give
    the same mix at any partitioning. An empty table gives an empty result.
    """
    made = ["size", "source_size", "target", "taken"]
    bare, own, columns = numbered(docs.drop(*made), text_col, source_col, id_col)
    documents, pieces, _ = mix_plan(bare, *own, with_text=with_text, **options)
    out = taken_words(documents, pieces)
    if not with_text:
        columns = [c for c, n in zip(columns, bare.columns) if n != own[0]]
    return out.select(*columns, *[F.col(f"_{c}").alias(c) for c in made])


def shard_counts(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """shard, source, slots: how many blocks each output shard draws from each source."""
    bare, own, _ = numbered(docs, text_col, source_col, id_col)
    return mix_plan(bare, *own, with_text=False, **options)[2].groupBy("shard", "source").agg(F.count("*").alias("slots"))


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: for each round, the words that the mix takes from a document, with the document's columns.

    A document taken whole keeps its text as it is; of one cut by a block's end or the target, the words taken are
    kept with the white space after each. A round that takes nothing gives no row.
    """
    bare, (text, source, key), columns = numbered(docs, text_col, source_col, id_col)
    documents, pieces, _ = mix_plan(bare, text, source, key, **options)
    parts = pieces.groupBy("_source", "_bucket", "_row", "round").agg(
        F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_parts"), F.sum(F.col("_to") - F.col("_from")).alias("_n")
    )
    parts = parts.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.col("_row").alias("_r"), "round", "_parts", "_n")
    on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_row") == F.col("_r"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(F.col("_words"), (p["_from"] + 1).cast("int"), (p["_to"] - p["_from"]).cast("int")))), "")
    taken = documents.join(parts, on).withColumn("_words", F.when(F.col("_n") < F.col("_size"), words))
    return taken.withColumn(text, F.when(F.col("_n") == F.col("_size"), F.col(text)).otherwise(some)).select(*columns)
