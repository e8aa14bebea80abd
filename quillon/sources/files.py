"""Readers and writers of raw rows, results, reports and prompts.

Raw JSON is kept as VARIANT, parsed once; checks and mappings read paths from it. Rows carry row_idx, their place in
the source, because "first" always means file order.
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.json_paths import field_paths
from quillon.sources.blocks import read_records

RESULT = (
    "example_id STRING, model STRING, output STRUCT<route: STRING>, error STRING, latency_ms DOUBLE, retries INT, token_usage STRUCT<input_tokens: BIGINT, cached_tokens: BIGINT,"
    " cache_write_5m_tokens: BIGINT, cache_write_1h_tokens: BIGINT, output_tokens: BIGINT>, cost DOUBLE, __meta__ STRING, prompt_version STRING, backend STRING, data_source STRING"
)


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """df plus its rows' places from 0, in the order of partitions: a count a partition, then offsets; no rows move.

    df is read twice and has to come in the same partitions both times, as files, stored tables and repartitions by a
    fixed number do. For files, numbered_lines gives places in the order of paths.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)  # how Spark makes these numbers: the partition, then the place in it
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line (from 0): the lines of text files, by path, then place in the file.

    A block of a file is read by one task, so a line's place is its place in the block after the lines of all blocks
    before; a row a block is counted.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    blocks = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    below = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    bases = blocks.select("_f", "_b", (F.coalesce(F.sum("_n").over(below), F.lit(0)) - F.col("_first")).alias("_base"))
    return lines.join(F.broadcast(bases), ["_f", "_b"]).select("value", (F.col("_m") + F.col("_base")).alias("line"))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header row, all strings; rows that are blank throughout go, short rows end in nulls, cells beyond the header go.

    An empty cell is null here. Cells in quotes may hold line feeds and doubled quotes, and a file is read in many tasks
    all the same. Each file has a header, of which that of the first file by path gives the names: an empty name becomes
    _c and its place, and of equal names the last column counts.
    """
    records, ends = read_records(spark, path, "csv")
    if not ends:
        return spark.createDataFrame([], "_c0 string").limit(0)
    first = records.where((F.col("f") == min(f for f, *_ in ends)) & (F.col("row_idx") == 0)).select("text").first()
    names = [n or f"_c{i}" for i, n in enumerate(next(csv.reader(io.StringIO(first["text"].lstrip("\ufeff"), newline="")), []))] if first else []
    if not names:
        return spark.createDataFrame([], "_c0 string").limit(0)
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"', "mode": "PERMISSIVE", "maxColumns": "100000"})
    rows = records.where("row_idx > 0 AND trim(text) <> ''").select(cells.alias("r"))
    last = {n: i for i, n in enumerate(names)}
    rows = rows.select(*[F.col(f"r.c{i}").alias(n) for n, i in last.items()])
    some = F.lit(False)
    for c in rows.columns:
        some = some | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    return rows.where(some)


def read_jsonl(spark: SparkSession, path: str, mode: str = "permissive") -> tuple[DataFrame, DataFrame]:
    """(rows: row_idx, v VARIANT; bad: line numbers from 1). Blank lines don't count.

    mode "strict" raises at the first bad line, naming its number; "permissive" gives the numbers of bad lines;
    "results" also leaves out rows with a __meta__ key. Lines that JSON proper doesn't allow are bad.
    """
    lines = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("v", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))
    bad = lines.where(~is_object).select((F.col("line") + 1).alias("line"))
    if mode == "strict":
        first = bad.agg(F.min("line")).first()[0]
        if first is not None:
            raise ValueError(f"line {first} is not a JSON object")
    good = lines.where(is_object)
    if mode == "results":
        good = good.where(F.try_variant_get("v", "$.__meta__", "string").isNull())
    return good.select(F.col("line").alias("row_idx"), "v"), bad


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, v: the elements of a top-level array, in many tasks whatever the file's length; of several files each has places of its own.

    A file that isn't one array, or has an element that isn't JSON, is an error.
    """
    records, ends = read_records(spark, path, "json")
    rows = records.select("row_idx", F.try_parse_json("text").alias("v"))
    # pieces are cut at closing braces, and one is put behind the last as well: a whole array ends at a depth of -1
    sound = all(not quoted and depth == -1 for _, quoted, depth in ends)
    arrays = spark.read.option("lineSep", "}").text(path).where("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    begins = arrays.groupBy("f").agg(F.min_by(F.ltrim("value"), "m").alias("v")).where("NOT startswith(regexp_replace(v, '^\\\\s+', ''), '[')")
    if not sound or not begins.isEmpty() or not rows.where("v IS NULL").isEmpty():
        raise ValueError("the file is not a JSON array")
    return rows


def source_reader(path: str) -> str:
    """csv, json or jsonl, by extension."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".csv", ".json", ".jsonl", ".ndjson"):
        raise ValueError(f"no reader for {kind or 'a file without extension'}")
    return {"csv": "csv", "json": "json"}.get(kind[1:], "jsonl")


def nested_paths(rows: DataFrame, v: str = "v") -> DataFrame:
    """path: the distinct dot paths of nested objects at any depth, the ones on the way included, over the whole table.

    They are read off each row's schema in one pass.
    """
    return rows.select(F.explode(field_paths(F.col(v), arrays=False)).alias("path")).distinct()


def profile_rows(rows: DataFrame, bad: DataFrame | None = None, v: str = "v", samples: int = 5) -> DataFrame:
    """One row: n_rows, first_columns (keys of the first row), all_columns (keys of any row), sample_rows (the first ones as JSON), n_skipped and skipped_lines (the first twenty of `bad`, which has line)."""
    keys = F.array_sort(F.map_keys(F.variant_get(v, "$", "map<string, variant>")))
    sums = rows.agg(F.count("*").alias("n_rows"), F.min_by(keys, "row_idx").alias("first_columns"), F.collect_set(keys).alias("_k"))
    head = rows.orderBy("row_idx").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.to_json(v).alias("j")))), lambda x: x["j"]).alias("sample_rows"))
    out = sums.select("n_rows", "first_columns", F.array_sort(F.array_distinct(F.flatten("_k"))).alias("all_columns")).join(F.broadcast(head))  # one row
    if bad is None:
        return out.withColumn("n_skipped", F.lit(0).cast("long")).withColumn("skipped_lines", F.array().cast("array<bigint>"))
    first = bad.orderBy("line").limit(20).agg(F.array_sort(F.collect_list("line")).alias("skipped_lines"))
    return out.join(F.broadcast(bad.agg(F.count("*").alias("n_skipped")))).join(F.broadcast(first))  # one row each


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results from JSON lines, version from the folder above the file; headers and malformed lines are left out."""
    text = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("version"))
    return text.select("version", F.from_json("value", RESULT).alias("r")).select("version", "r.*").where("__meta__ IS NULL AND example_id IS NOT NULL").drop("__meta__", "prompt_version", "backend", "data_source")


def read_reports_long(spark: SparkSession, path: str) -> DataFrame:
    """version, key, value from one report file a version; a report counts if it has metrics and something succeeded."""
    kind = "metrics MAP<STRING, DOUBLE>, summary STRUCT<succeeded: INT>"
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("version"), F.from_json("value", kind).alias("r"))
    return text.where("r.summary.succeeded > 0 AND size(r.metrics) > 0").select("version", F.explode("r.metrics").alias("key", "value"))


def write_reports(documents: DataFrame, errors: DataFrame, path: str) -> None:
    """Report documents (version, report) as one JSON file a version, each written by an executor, under reports; errors (version and more) as JSON lines under errors."""
    lines = documents.select("version", F.to_json("report", {"ignoreNullFields": "false"}).alias("value"))
    lines.repartition("version").write.mode("overwrite").partitionBy("version").text(f"{path}/reports")
    errors.write.mode("overwrite").partitionBy("version").json(f"{path}/errors")


#: Fields of a report document; those of its summary may be fewer.
REPORT = (
    "metrics MAP<STRING, DOUBLE>, summary STRUCT<total: BIGINT, succeeded: BIGINT, failed: BIGINT, total_cost: DOUBLE, duration_seconds: DOUBLE>, n_errors BIGINT,"
    " errors ARRAY<STRUCT<example_id: STRING, error: STRING, retries: INT>>,"
    " diff STRUCT<metric_diffs: ARRAY<STRUCT<key: STRING, old: DOUBLE, new: DOUBLE, change: STRING>>, overhead_diff: STRUCT<old_total_cost: DOUBLE, old_duration_seconds: DOUBLE, new_total_cost: DOUBLE, new_duration_seconds: DOUBLE>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """version and the fields of REPORT: the documents that write_reports wrote, one row a version."""
    text = spark.read.text(f"{path}/reports/version=*/*.txt", wholetext=True)
    version = F.regexp_extract(F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)), "^version=(.*)$", 1)
    return text.select(version.alias("version"), F.from_json("value", REPORT).alias("r")).select("version", "r.*")


def reports_by_round(reports: DataFrame, rounds: DataFrame) -> DataFrame:
    """round, version, key, value: long reports by the rounds whose candidates_evaluated (an array) name the version; null keys where there is no report."""
    named = rounds.select("round", F.explode("candidates_evaluated").alias("version"))
    return named.join(reports, "version", "left").select("round", "version", "key", "value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: What tells one evaluation run from another.
FINGERPRINT = ("prompt_version", "backend", "data_source")


def write_results(df: DataFrame, path: str, fingerprint: dict[str, str] | None = None) -> None:
    """Results as JSON lines, with a header line of the run's fingerprint if one is given."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    if fingerprint is not None:
        head = df.sparkSession.range(1).select(F.to_json(F.struct(F.lit("run_fingerprint").alias("__meta__"), *[F.lit(fingerprint[k]).alias(k) for k in FINGERPRINT])).alias("value"))
        lines = head.unionByName(lines)
    lines.write.mode("overwrite").text(path)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """version, prompt_version, backend, data_source from the header lines of results, version from the folder above the file."""
    text = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("version"))
    return text.select("version", F.from_json("value", RESULT).alias("r")).where("r.__meta__ IS NOT NULL").select("version", *[f"r.{k}" for k in FINGERPRINT])


def prompt_corpus(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".md", ".txt", ".yaml")) -> DataFrame:
    """version, text, modified, is_latest: of several files of one version the first extension wins.

    A version is a file's name less its extension; a folder file=NAME, as Spark writes it, stands for a file of that name.
    """
    where = F.col("_metadata.file_path")
    written = F.regexp_extract(where, "/file=([^/]+)/[^/]+$", 1)
    name = F.when(written != "", F.url_decode(written)).otherwise(F.element_at(F.split(where, "/"), -1))
    rows = spark.read.text(path, wholetext=True).select("value", name.alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.regexp_extract("name", r"(\.\w+)$", 1))
    rows = rows.withColumn("_e", rank).where("_e > 0").withColumn("version", F.regexp_replace("name", r"\.\w+$", ""))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("version").orderBy("_e"))).where("_r = 1")
    newest = best.agg(F.max(F.struct("modified", "version")).alias("m")).select("m.version").withColumnRenamed("version", "_v")
    return best.join(F.broadcast(newest), F.col("version") == F.col("_v"), "left").select("version", F.col("value").alias("text"), "modified", F.col("_v").isNotNull().alias("is_latest"))  # one row
