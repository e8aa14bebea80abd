"""Results and candidates that arrive bit by bit.

What a stream keeps outside its state is written under a batch's number, so a batch that Spark runs again after a
failure writes the same files in the same place; readers put the batches together and need not know how many there are.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.metrics import NO_OUTPUT
from quillon.operators.pareto import pareto_front

#: Batches after which a store is written anew as one.
COMPACT = 50
#: Parts that the examples of a stream of results are dealt into by hash: what Python keeps and works on at a time.
BUCKETS = 4096
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cell_changes(results: DataFrame, examples: DataFrame, keys: tuple[str, ...] = ("version",), keep: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """keys, true_route, pred_route, n (1 or -1): how results (with arrived, a timestamp) change the confusion cells as they come.

    Of several results of an example the last by arrived counts, of equal ones the first to come: one that comes again
    changes nothing, and a correction takes back the cell that the result before it added; one with an error only takes
    back. Examples are a static table. With keep (as "7 days") the state of an example goes that long after the
    watermark has passed its result, and what comes later still is dropped.

    Python sees a bucket of examples at a time, by hash, since a call costs far more than a row. Their number, like that
    of the partitions of state, stays what it was when a stream began; a batch calls for as many buckets as it touches.
    """
    known = examples.select(F.col("id").alias("example_id"), F.col("route").alias("true_route"))
    cell = results.select(*keys, "example_id", "arrived", F.col("error").isNull().alias("good"), F.coalesce("output.route", F.lit(NO_OUTPUT)).alias("pred_route"))
    kinds = cell.select(*keys).schema
    cell = cell.withWatermark("arrived", keep) if keep else cell
    cell = cell.join(known, "example_id")
    named = F.to_json(F.struct(*keys), _JSON) if keys else F.lit("{}")
    cell = cell.select(F.pmod(F.xxhash64(*keys, "example_id"), F.lit(buckets)).alias("bucket"), named.alias("named"), "example_id", "arrived", "true_route", "pred_route", "good")
    wait = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else 0

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        passed = state.getCurrentWatermarkMs() if wait else 0
        came = {}
        for rows in () if state.hasTimedOut else frames:
            moments = rows["arrived"].to_numpy("datetime64[us]").astype("int64").tolist()
            columns = [map(sys.intern, rows[c].astype(str).tolist()) for c in ("true_route", "pred_route")]
            for name, example, *now in zip(map(sys.intern, rows["named"].tolist()), rows["example_id"].tolist(), moments, *columns, rows["good"].tolist()):
                before = came.get((name, example))
                if before is None or now[0] > before[0]:
                    came[name, example] = now
        made = []
        for place, now in came.items():
            before = held.get(place)
            if before is not None and now[0] <= before[0]:
                continue
            held[place] = (*now, max(now[0] // 1000, passed) + wait if wait else 0)
            changes = [(before, -1)] if before is not None and before[3] else []
            changes += [(now, 1)] if now[3] else []
            if len(changes) < 2 or tuple(before[1:3]) != tuple(now[1:3]):
                made += [(place[0], c[1], c[2], n) for c, n in changes]
        if wait:
            held = {place: x for place, x in held.items() if x[4] >= passed or place in came}
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        elif state.exists:
            state.remove()
        if held and wait:
            state.setTimeoutTimestamp(max(min(x[4] for x in held.values()), passed + 1))
        if made:
            yield pd.DataFrame(made, columns=["named", "true_route", "pred_route", "n"])

    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout
    changes = cell.groupBy("bucket").applyInPandasWithState(run, "named string, true_route string, pred_route string, n long", "held binary", "update", timeout)
    return changes.select(*[F.from_json("named", kinds, _JSON)[k].alias(k) for k in keys], "true_route", "pred_route", "n")


def cell_sink(path: str, compact: int = COMPACT):
    """A function for foreachBatch: the sums of a batch's changes go to path under the batch's number; every `compact` batches all are added up in one."""

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark, cells = batch.sparkSession, [c for c in batch.columns if c != "n"]
        sums = batch.groupBy(*cells).agg(F.sum("n").alias("n")).where("n <> 0")
        earlier = [e for e in _batches(spark, path) if e < epoch]
        whole = epoch % compact == compact - 1
        if whole and earlier:
            sums = _added_up(spark, path, sums.schema, earlier).unionByName(sums).groupBy(*cells).agg(F.sum("n").alias("n")).where("n <> 0")
        sums.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if whole:  # the batches added up in the last round but one: a reader may still be at those of the last
            for e in earlier:
                if e < epoch - compact:
                    _delete(spark, f"{path}/batch={e}")

    return on_batch


def _added_up(spark: SparkSession, path: str, schema, batches: list[int]) -> DataFrame:
    fields = spark.createDataFrame([], schema).withColumn("whole", F.lit(True)).withColumn("batch", F.lit(0)).schema
    rows = spark.read.schema(fields).option("basePath", path).parquet(*[f"{path}/batch={e}" for e in batches])
    cells = [f.name for f in schema if f.name != "n"]
    # of batches that stand for all before them the last counts: they are known by the number of one in every `compact`
    start = rows.where("whole").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("_start"))
    return rows.join(F.broadcast(start)).where("batch >= _start").groupBy(*cells).agg(F.sum("n").alias("n")).where("n <> 0").select(*[f.name for f in schema])  # one row


def read_cells(spark: SparkSession, path: str, schema) -> DataFrame:
    """The confusion cells as of the last batch that is there. schema is that of cell_changes."""
    batches = _batches(spark, path)
    return _added_up(spark, path, schema, batches) if batches else spark.createDataFrame([], schema)


def start_cells(changes: DataFrame, path: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Runs a stream of cell_changes into path over all that is there now; read_cells reads it at any time."""
    return changes.writeStream.outputMode("update").foreachBatch(cell_sink(path, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def front_sink(path: str, schema, keys: tuple[str, ...] = ("run_id",), compact: int = COMPACT):
    """A function for foreachBatch: keeps the front of each run under path as candidates arrive.

    A batch reads and writes the fronts of the runs it touches: fronts/batch=N has these, and manifest/batch=N says which
    runs they are. The front of a run is the one under the last number that the manifest gives it. Every `compact` batches
    all runs are written anew, and what nothing refers to any more goes. A batch that runs again sees only those before it.
    """
    names = [f.name for f in schema]

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(*keys).distinct()
        old = _fronts(spark, path, schema, keys, epoch)
        if epoch % compact == compact - 1:
            touched = touched.union(old.select(*keys)).distinct()
            front = pareto_front(old.unionByName(batch.select(*names)), keys)
        else:
            front = pareto_front(_fronts(spark, path, schema, keys, epoch, touched).unionByName(batch.select(*names)), keys)
        front.select(*names).write.mode("overwrite").parquet(f"{path}/fronts/batch={epoch}")
        touched.write.mode("overwrite").parquet(f"{path}/manifest/batch={epoch}")  # from here on the batch counts
        if epoch % compact == compact - 1:
            for e in _batches(spark, f"{path}/manifest"):
                if e < epoch - compact:
                    _delete(spark, f"{path}/manifest/batch={e}")
                    _delete(spark, f"{path}/fronts/batch={e}")

    return on_batch


def _fronts(spark: SparkSession, path: str, schema, keys: tuple[str, ...], before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
    """The fronts of all runs, or those touched, as of the batches before a number."""
    names = [f.name for f in schema]
    batches = [e for e in _batches(spark, f"{path}/manifest") if before is None or e < before]
    if not batches:
        return spark.createDataFrame([], schema)
    read = lambda kind: spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={e}" for e in batches])
    manifest = read("manifest")
    if touched is not None:
        manifest = manifest.join(touched, list(keys), "left_semi")
    latest = manifest.groupBy(*keys).agg(F.max("batch").alias("batch"))
    used = [r[0] for r in latest.select("batch").distinct().collect()]  # numbers of batches, two rounds of compaction at most
    if not used:
        return spark.createDataFrame([], schema)
    return read("fronts").where(F.col("batch").isin(used)).join(latest, [*keys, "batch"], "left_semi").select(*names)


def front_stream(candidates: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("run_id",), compact: int = COMPACT) -> StreamingQuery:
    """Keeps the front of each run under path as candidates arrive; returns the query."""
    return candidates.writeStream.foreachBatch(front_sink(path, candidates.schema, keys, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_front(spark: SparkSession, path: str, schema, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The fronts of all runs as of the last batch that is there."""
    return _fronts(spark, path, schema, keys)
