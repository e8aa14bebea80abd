"""Token-id files: one zstandard frame a document, a shared dictionary, and an offset index for access to one document.

A file set is a folder of two Parquet tables. `dictionary` has one row: hash (SHA-256 of the bytes) and content.
`shards` has one row a shard: dict_hash, width (bytes an id), doc_ids, n_tokens and offsets (one entry a document; a
document's frame is blob[offsets[i] : offsets[i + 1]]), blob, tokens (their sum), and part and seq, by which shards
sort in ascending id order. Shards are bounded in bytes and documents, so a reader fetches one shard for one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import hashed_sample, small_batches, stored, tidied
from quillon.llm.tokens import encoder

#: Documents, chosen by the hash of their ids, whose id arrays train the dictionary: a fixed bound.
SAMPLE_DOCUMENTS = 400
DICTIONARY_BYTES = 48 << 10
SHARD_BYTES = 8 << 20
SHARD_DOCUMENTS = 50_000
LEVEL = 3


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; with too little to train on, the samples themselves serve as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _codec(content: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}


@tidied
def _frames(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, width: int, content: bytes, special_as_text: bool) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL, write_dict_id=True, **_codec(content)).compress
    for batch in small_batches(batches, limit=4 << 20):
        ids = [np.append(x, np.uint32(end_id)) for x in encoder(vocabulary, "before", special_as_text).arrays(batch.column(1))]
        frames = pa.array([pack(serialized(x, width)) for x in ids], pa.binary())
        yield pa.record_batch([batch.column(0), pa.array(list(map(len, ids)), pa.int64()), frames], ["doc_id", "n_tokens", "frame"])


_SHARD = "part int, seq int, dict_hash string, width int, doc_ids array<long>, n_tokens array<long>, offsets array<long>, blob binary, tokens long"


def _shards(batches: Iterator[pa.RecordBatch], dict_hash: str, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted frames of one partition to shards."""
    part, seq = TaskContext.get().partitionId(), 0
    ids, counts, frames, size = [], [], [], 0

    def shard() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype=np.int64)])
        row = {"part": part, "seq": seq, "dict_hash": dict_hash, "width": width, "doc_ids": ids, "n_tokens": counts, "offsets": offsets.tolist(), "blob": b"".join(frames), "tokens": sum(counts)}
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    for batch in batches:
        for i, n, f in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if frames and (size + len(f) > SHARD_BYTES or len(frames) == SHARD_DOCUMENTS):
                yield shard()
                seq, ids, counts, frames, size = seq + 1, [], [], [], 0
            ids.append(i)
            counts.append(n)
            frames.append(f)
            size += len(f)
    if frames:
        yield shard()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Encode every whole text, append end_id, and write the file set under path in ascending id order (null first).

    Ids take two bytes each if all of the vocabulary's fit, else four. A special token's string in a text gives that
    token, as the library has it; with special_as_text it is ordinary text. A null or empty text is the end id alone. Repeated ids stay, ordered by length and content. An empty table gives a
    dictionary without content and no shard.
    """
    spark = docs.sparkSession
    own = encoder(vocabulary, "before", special_as_text)
    width = 2 if max(own.size, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = hashed_sample(rows.where("length(text) > 0"), ["doc_id", "text"], SAMPLE_DOCUMENTS, rows.count()).select("h", "text").collect()
    texts = [r["text"] for r in sorted(sample)[:SAMPLE_DOCUMENTS]]
    content = train_dictionary([serialized(x, width) for x in own.arrays(pa.array(texts, pa.string()))])
    dict_hash = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = stored(rows.mapInArrow(partial(_frames, vocabulary=vocabulary, end_id=end_id, width=width, content=content, special_as_text=special_as_text), "doc_id long, n_tokens long, frame binary"), "token-frames")
    key = [F.col("doc_id").asc_nulls_first(), "n_tokens", F.xxhash64("frame")]
    ordered = frames.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(partial(_shards, dict_hash=dict_hash, width=width), _SHARD).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["hash"]:
        raise ValueError("the dictionary's content doesn't have the hash beside it")
    return row["hash"], content


def _opened(batches: Iterator[pa.RecordBatch], dict_hash: str, content: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor(**_codec(content)).decompress
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_hash"] != dict_hash:
                raise ValueError("a shard was written with another dictionary")
            blob, at = memoryview(row["blob"]), row["offsets"]
            counts, sums, ids = [], [], []
            for i in range(len(row["doc_ids"])):
                x = np.frombuffer(unpack(blob[at[i] : at[i + 1]]), f"<u{row['width']}").astype("<u4")
                counts.append(len(x))
                sums.append(zlib.crc32(x.tobytes()))
                if with_ids:
                    ids.append(x)
            n = len(counts)
            columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum([0, *counts[:-1]]), pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = ["part", "seq", "doc_id", "in_shard", "n_tokens", "ids_crc32"]
            yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names + ["ids"] * with_ids)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, from the files alone."""
    dict_hash, content = _dictionary(spark, path)
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    made = "part int, seq int, doc_id long, in_shard long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    opened = shards.mapInArrow(partial(_opened, dict_hash=dict_hash, content=content, with_ids=with_ids), made)
    # one row a partition, then one row a shard inside it: no sort sees more than its own level
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("t"))
    parts = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("_s")).join(parts, "part")
    start = F.col("_p") + F.col("_s") + F.col("in_shard")
    return opened.join(places, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each row written with this id: reads its shard's index, then its frame alone."""
    dict_hash, content = _dictionary(spark, path)
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards").where(F.array_contains("doc_ids", doc_id))
    at = F.posexplode("doc_ids").alias("i", "doc")
    one = shards.select(at, "part", "seq", "width", "dict_hash", "offsets", "blob").where(F.col("doc") == doc_id).orderBy("part", "seq", "i")
    frame = F.substring("blob", F.element_at("offsets", F.col("i") + 1).cast("int") + 1, (F.element_at("offsets", F.col("i") + 2) - F.element_at("offsets", F.col("i") + 1)).cast("int"))
    unpack = zstandard.ZstdDecompressor(**_codec(content)).decompress
    return [np.frombuffer(unpack(bytes(r["frame"])), f"<u{r['width']}").tolist() for r in one.select(frame.alias("frame"), "width").collect()]
