"""Scoring the examples that are left with a caller's vectorised function, in batches that survive a stop."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.identity import remaining_examples

USAGE = ("input_tokens", "cached_tokens", "output_tokens")
_USAGE = f"struct<{', '.join(f'{u}: long' for u in USAGE)}>"
RESULT = f"example_id string, model string, output struct<route: string>, error string, latency_ms double, retries int, token_usage {_USAGE}, cost double"
Predict = Callable[[pd.DataFrame], list]


def _called(predict: Predict, frame: pd.DataFrame) -> tuple[dict, dict]:
    """(what predict gives for each row, or an exception; the milliseconds of its call).

    Where the call raises, it is made again on each half of the rows, so that in the end only the rows at fault have the
    exception: a row at fault among n costs about 2 log n more calls.
    """
    began = time.monotonic()
    try:
        out = list(predict(frame))
        if len(out) != len(frame):
            raise ValueError(f"{len(out)} results of {len(frame)} rows")
        spent = (time.monotonic() - began) * 1000
        return dict(zip(frame.index, out)), dict.fromkeys(frame.index, spent)
    except Exception as error:  # noqa: BLE001 - whatever a caller's function raises becomes an error row
        if len(frame) == 1:
            return {frame.index[0]: error}, {frame.index[0]: (time.monotonic() - began) * 1000}
    half = len(frame) // 2
    first, second = _called(predict, frame.iloc[:half]), _called(predict, frame.iloc[half:])
    return first[0] | second[0], first[1] | second[1]


def _whole(x) -> int | None:
    return None if x is None else int(x)


def score_examples(examples: DataFrame, predict: Predict, attempts: int = 3, backoff: float = 0.0, model: str = "model") -> DataFrame:
    """One result an example (id, input, route): predict gets a frame and gives a route, a dict, or an exception for each row.

    A dict has "route", and "cost" and the USAGE counts if known. Rows that fail, by an exception of their own or one that
    a call with them raises, are given to predict again after backoff ** tries seconds (none if backoff is 0), `attempts`
    times in all; what then still fails has an error ("ValueError: why") and no output, and so has an output without a
    route. latency_ms is that of the call which settled the row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done, left, tries = {}, frame, 0
            while len(left) and tries < attempts:
                if tries and backoff:
                    time.sleep(backoff**tries)
                out, spent = _called(predict, left)
                for i, x in out.items():
                    done[i] = (x, tries, spent[i])
                left = left.loc[[i for i, x in out.items() if isinstance(x, Exception)]]
                tries += 1
            rows = []
            for i, key in zip(frame.index, frame["id"]):
                x, n, spent = done[i]
                more = x if isinstance(x, dict) else {}
                route = more.get("route") if isinstance(x, dict) else x
                error = f"{type(x).__name__}: {x}" if isinstance(x, Exception) else "no route" if route is None else None
                usage = {u: _whole(more.get(u)) for u in USAGE} if any(u in more for u in USAGE) else None
                rows.append((key, model, None if error else {"route": str(route)}, error, spent, n, usage, more.get("cost")))
            yield pd.DataFrame(rows, columns=["example_id", "model", "output", "error", "latency_ms", "retries", "token_usage", "cost"])

    return examples.select("id", "input", "route").mapInPandas(run, RESULT)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> list[str]:
    """The batches under path that were written to their end: a writer that is stopped leaves no _SUCCESS."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return []
    found = [str(s.getPath().toString()) for s in files.listStatus(at) if s.isDirectory()]
    return sorted(p for p in found if p.rsplit("/", 1)[1].startswith("batch-") and files.exists(_file_system(spark, f"{p}/_SUCCESS")[0]))


def scored_so_far(spark: SparkSession, path: str) -> DataFrame:
    """One result an example from the finished batches: a success before an error, a later batch before an earlier one."""
    batches = _finished(spark, path)
    schema = spark.createDataFrame([], RESULT).schema
    if not batches:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*batches)
    place = F.struct(F.col("error").isNull(), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    columns = [f.name for f in schema]
    rows = rows.select(F.struct(*columns).alias("r"), place.alias("place"))
    return rows.groupBy(F.col("r.example_id").alias("key")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def score_into(examples: DataFrame, predict: Predict, path: str, fingerprint: dict[str, str], batches: int = 8, tasks: int | None = None, **options) -> DataFrame:
    """Scores what is left of the examples into path, batch by batch, and gives one result for each of them.

    fingerprint (prompt_version, backend, data_source) is kept beside the batches: a run that goes on where another
    was stopped scores the examples without a success in a finished batch; one with another fingerprint starts over.
    Each batch (a share of the ids by hash, one Spark job) is there as a whole or not at all, so a stop at any time costs
    one batch, and the results are those of a run without one. A batch is dealt out by id over `tasks` tasks, as many as
    there are cores unless given: rows are narrow and calls slow, so what Spark takes for the size of one task may be hours
    of work. options go to score_examples.
    """
    spark = examples.sparkSession
    head, files = _file_system(spark, f"{path}/_run.json")
    kinds = "prompt_version string, backend string, data_source string"
    current = spark.createDataFrame([tuple(fingerprint[k] for k in ("prompt_version", "backend", "data_source"))], kinds)
    earlier = spark.createDataFrame([], kinds)
    if files.exists(head):
        stream = files.open(head)
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        known = json.loads(text)
        earlier = spark.createDataFrame([tuple(known.get(k) for k in ("prompt_version", "backend", "data_source"))], kinds)
        if known != fingerprint:
            files.delete(head.getParent(), True)
    if not files.exists(head):
        files.mkdirs(head.getParent())
        out = files.create(head)
        out.write(bytearray(json.dumps(fingerprint).encode()))
        out.close()
    left = remaining_examples(examples, scored_so_far(spark, path), earlier, current)
    number = len(_finished(spark, path))
    dealt = left.withColumn("_batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
    for k in range(batches):
        part = dealt.where(F.col("_batch") == k).drop("_batch")
        # by a hash: by the id alone Spark may take the partitions of the join before, and those it puts together by size
        part = part.repartition(tasks or spark.sparkContext.defaultParallelism, F.xxhash64("id"))
        score_examples(part, predict, **options).write.parquet(f"{path}/batch-{number + k:06d}-{uuid.uuid4().hex}")
    ids = examples.select(F.col("id").alias("example_id")).distinct()
    return scored_so_far(spark, path).join(ids, "example_id", "left_semi")


def echo(frame: pd.DataFrame) -> list:
    """A predictor for tests: the true route."""
    return frame["route"].tolist()
