"""Shared-folder tables and connected components for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space between words: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests, one machine) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: any executor can recompute from it. The files go when the driver ends, if not before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, or one row: Arrow's batches are bounded in rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, done + limit, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def fresh(column: pa.Array) -> pa.Array:
    """A text column as large strings in buffers of its own: Arrow's ascii_lower is wrong on a slice that a cast went over."""
    return pa.concat_arrays([pa.array([], pa.large_string()), pc.fill_null(column.cast(pa.large_string()), "")])


def tidied(work):
    """A function of batches that, at the end of a task, gives memory it no longer uses back to the machine: workers stay for later stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *values, **options) -> Iterator[pa.RecordBatch]:
        yield from work(batches, *values, **options)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def numbered(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str], list[Column]]:
    """(docs with its columns named "column 0" and so on, the new names of the columns named, the columns under their old names).

    An operator that works on it can use any names of its own.
    """
    names = [f"column {i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    own = [names[docs.columns.index(c) if c in docs.columns else lower.index(c.lower())] for c in named]
    return docs.toDF(*names), own, [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


#: A group with more than this share of all rows is joined by broadcast: there can't be more than 10,000 of these.
HOT_SHARE = 10_000


def hot_and_cold(groups: DataFrame, size: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(groups so large that one task of a join would get far more rows than others, marked for broadcast; all others)."""
    least = rows // HOT_SHARE
    return F.broadcast(groups.where(F.col(size) > least)), groups.where(F.col(size) <= least)


def hashed_sample(rows: DataFrame, key: list[str], size: int, total: int) -> DataFrame:
    """Distinct rows by the hash of their key, about 1.3 times `size` of them (all of a small table): column h is the hash.

    Rows are picked by a share of the hash's range, so no task sends more than its share to the driver.
    """
    picked = rows.withColumn("h", F.pmod(F.xxhash64(*key), F.lit(1 << 40)))
    share = int(min(1.0, (1.3 * size + 50) / max(total, 1)) * (1 << 40))
    return picked.where(F.col("h") < share).dropDuplicates(["h"])


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _set_to(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession):
    """Inside, Spark deletes the shuffle files of each job at its end, instead of when the driver collects its garbage."""
    return _set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def short_batches(spark: SparkSession):
    """Inside, Spark sends Python tasks batches of at most 8 MB (or one row), held on both sides outside the JVM's heap."""
    return _set_to(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def smallest_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Rounds of two steps, each a hash aggregate and a join (no group is gathered): every node takes the smallest label
    among its own and its neighbours', then the label of its label (pointer jumping). The edges are contracted to
    labels after each round, so that edges inside a finished component vanish and the rounds are logarithmic in the
    diameter. Each round is written to the shared folder; the round before is then deleted.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = stored(e.union(e.select("v", "u")).distinct(), "cc-edges")
    labels: list[DataFrame] = []
    while True:
        # least neighbour (or itself) of each node that still has an edge
        near = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "cc-near")
        if near.isEmpty():
            discard(near)
            discard(both)
            break
        jump = near
        while True:  # follow pointers to their root; they only go down, so there are no cycles
            nxt = stored(
                jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.u"), "left")
                .select("x.u", F.coalesce("y.to", "x.to").alias("to"), (F.coalesce("y.to", "x.to") != F.col("x.to")).alias("moved")),
                "cc-jump",
            )
            moved = not nxt.where("moved").isEmpty()
            discard(jump)
            jump = nxt
            if not moved:
                break
        labels.append(jump)
        root = jump.select("u", "to")
        less = (
            both.join(root, "u").select("v", F.col("to").alias("u2"))
            .join(root.withColumnRenamed("u", "v"), "v")
            .select(F.col("u2").alias("u"), F.col("to").alias("v")).where("u != v").distinct()
        )
        less = stored(less, "cc-edges")
        discard(both)
        both = less
    spark = edges.sparkSession
    if not labels:
        return spark.createDataFrame([], f"node {e.schema['u'].dataType.simpleString()}, component {e.schema['u'].dataType.simpleString()}")
    out = labels[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for later in labels[1:]:  # a root of one round may be joined to another in the next
        out = out.join(later.select(F.col("u").alias("component"), F.col("to").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return stored(out, "cc")
