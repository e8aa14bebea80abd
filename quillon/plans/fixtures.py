"""Routing tables derived from the given tables with integer arithmetic, as DataFrames and as the same SQL.

Qualities are whole thousandths and costs whole millionths, so sums are exact and a quotient is the same everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTES = ("simple", "moderate", "complex")
_QUALITIES = "400 + (doc_id * 7919) % 500 AS qs, 500 + (doc_id * 104729) % 450 AS qm, 600 + (doc_id * 1299709) % 400 AS qc"
_COSTS = "200 + least(n_chars, 5000) AS cs, 1000 + 3 * least(n_chars, 5000) AS cm, 5000 + 8 * least(n_chars, 5000) AS cc"
_ROUTE = "CASE WHEN qs * 100 - cs >= qm * 100 - cm AND qs * 100 - cs >= qc * 100 - cc THEN 'simple' WHEN qm * 100 - cm >= qc * 100 - cc THEN 'moderate' ELSE 'complex' END AS route"
_FLAGS = "(doc_id * 13 + v * 7) % 97 = 0 AS err, (doc_id * 11 + v * 5) % 101 = 0 AS lost, (doc_id * 17 + v * 3) % 89 = 0 AS mute, (doc_id * 31 + v * 17) % 10 < 3 + v AS hit"
_PRED = (
    "CASE WHEN err OR mute THEN NULL WHEN lost THEN 'unknown_model' WHEN hit THEN route"
    " WHEN (doc_id + v) % 3 = 0 THEN 'simple' WHEN (doc_id + v) % 3 = 1 THEN 'moderate' ELSE 'complex' END AS pred"
)
_SPENT = "10 + (doc_id * 7 + v * v * 3) % 53 AS spent"

#: Common table expressions that the SQL of all routing queries starts with.
BASE_SQL = f"""
WITH ex AS (
  SELECT *, {_ROUTE} FROM (SELECT doc_id, concat('d', doc_id) AS id, text AS input, lang, n_chars, {_QUALITIES}, {_COSTS} FROM documents)),
res AS (
  SELECT *, {_PRED}, {_SPENT} FROM (SELECT ex.*, v, concat('v', v) AS version, {_FLAGS} FROM ex, (VALUES (1), (2), (3), (4), (5), (6)) AS t(v))),
pairs AS (SELECT * FROM res WHERE NOT err),
cells AS (SELECT version, route AS true_route, coalesce(pred, '') AS pred_route, count(*) AS n FROM pairs GROUP BY ALL),
long_routes AS (
  SELECT doc_id, id, route AS oracle, unnest(['simple', 'moderate', 'complex']) AS route, unnest([qs, qm, qc]) AS q, unnest([cs, cm, cc]) AS c FROM ex),
cand AS (
  SELECT p_partkey % 10 AS run_id, concat('p', p_partkey) AS version, 1 + p_partkey % 8 AS round,
    (p_partkey * 7919) % 1000 AS q, 1 + (p_partkey * 104729 + p_size * 31) % 997 AS c FROM part)
"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, input, route, routes (map of cost and quality_score), and the whole numbers they come from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.selectExpr("doc_id", "concat('d', doc_id) AS id", "text AS input", "lang", "n_chars", *_split(_QUALITIES), *_split(_COSTS)).selectExpr("*", _ROUTE)
    entry = lambda q, c: F.struct((F.col(c) / 1e6).alias("cost"), (F.col(q) / 1e3).alias("quality_score"))
    return base.withColumn("routes", F.create_map(F.lit("simple"), entry("qs", "cs"), F.lit("moderate"), entry("qm", "cm"), F.lit("complex"), entry("qc", "cc")))


def _split(expressions: str) -> list[str]:
    """Cut a select list at the commas after aliases."""
    return re.split(r"(?<= AS \w\w), ", expressions)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, version, v, example_id, model, output (struct of route, or null), error, retries, cost."""
    base = examples(spark, sf_dir).select("doc_id", "id", "route").withColumn("v", F.explode(F.array(*[F.lit(v) for v in range(1, 7)])))
    made = base.selectExpr("*", *_FLAGS.split(", ")).selectExpr("*", _PRED, _SPENT)
    return made.select(
        F.lit("r0").alias("run_id"), F.concat(F.lit("v"), "v").alias("version"), "v", F.col("id").alias("example_id"), "doc_id", F.lit("m").alias("model"),
        F.when(F.col("pred").isNotNull(), F.struct(F.col("pred").alias("route"))).alias("output"), F.when(F.col("err"), F.lit("timeout")).alias("error"),
        F.when(F.col("err"), 3).otherwise(0).alias("retries"), (F.col("spent") / 1e6).alias("cost"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, version, round, quality, cost: whole numbers over the part table, for skylines."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey % 10 AS run_id", "concat('p', p_partkey) AS version", "1 + p_partkey % 8 AS round", "(p_partkey * 7919) % 1000 AS quality", "1 + (p_partkey * 104729 + p_size * 31) % 997 AS cost")
