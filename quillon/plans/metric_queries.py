"""Queries of the metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import compare as c
from quillon.operators import metrics as m
from quillon.plans.fixtures import BASE_SQL, examples, results

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pair_results(results(spark, sf_dir), examples(spark, sf_dir), ("version",))


V = ("version",)


@query(BASE_SQL + "SELECT version, count(*) AS n, count(*) FILTER (pred = route) AS n_correct, count(*) FILTER (pred = route) / count(*) AS accuracy FROM pairs GROUP BY version")
def accuracy_by_version(spark, sf_dir):
    return m.accuracy(pairs(spark, sf_dir), V)


@query(BASE_SQL + """, k AS (SELECT version, true_route AS c FROM cells UNION SELECT version, pred_route FROM cells)
SELECT a.version, a.c AS true_route, b.c AS pred_route, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k a JOIN k b USING (version)
LEFT JOIN cells ON cells.version = a.version AND true_route = a.c AND pred_route = b.c""")
def confusion_dense(spark, sf_dir):
    return m.confusion_dense(m.confusion_cells(pairs(spark, sf_dir), V), V)


PRF_SQL = BASE_SQL + """, k AS (SELECT version, true_route AS c FROM cells UNION SELECT version, pred_route FROM cells),
t AS (SELECT k.version, k.c AS class, CAST(coalesce((SELECT sum(n) FROM cells x WHERE x.version = k.version AND x.true_route = k.c), 0) AS BIGINT) AS support,
  CAST(coalesce((SELECT sum(n) FROM cells x WHERE x.version = k.version AND x.pred_route = k.c), 0) AS BIGINT) AS predicted,
  CAST(coalesce((SELECT sum(n) FROM cells x WHERE x.version = k.version AND x.pred_route = k.c AND x.true_route = k.c), 0) AS BIGINT) AS hits FROM k),
u AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM t),
prf AS (SELECT version, class, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM u)
"""


@query(PRF_SQL + "SELECT * FROM prf")
def prf1_by_version(spark, sf_dir):
    return m.precision_recall_f1(m.confusion_cells(pairs(spark, sf_dir), V), V)


@query(PRF_SQL + "SELECT version, round(avg(f1), 9) AS macro_f1 FROM prf GROUP BY version")
def macro_f1(spark, sf_dir):
    per_class = m.precision_recall_f1(m.confusion_cells(pairs(spark, sf_dir), V), V)
    return m.macro_f1(per_class, V).withColumn("macro_f1", F.round("macro_f1", 9))


def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, key, value: precision/, recall/ and f1/ of every class, f1/macro and the confusion cells."""
    cells = m.confusion_cells(pairs(spark, sf_dir), V)
    per_class = m.precision_recall_f1(cells, V)
    each = per_class.select("version", F.inline(F.array(*[F.struct(F.concat(F.lit(f"{n}/"), "class").alias("key"), F.col(n).alias("value")) for n in ("precision", "recall", "f1")])))
    macro = m.macro_f1(per_class, V).select("version", F.lit("f1/macro").alias("key"), F.col("macro_f1").alias("value"))
    confusion = m.confusion_dense(cells, V).select("version", F.concat_ws("/", F.lit("confusion"), "true_route", "pred_route").alias("key"), F.col("n").cast("double").alias("value"))
    return each.unionByName(macro).unionByName(confusion)


@query(PRF_SQL + "SELECT version, support, class AS route, precision, recall, f1 FROM prf")
def per_class_performance(spark, sf_dir):
    return c.per_class_performance(route_metrics(spark, sf_dir), V)


@query(PRF_SQL + "SELECT version, class AS route, precision, recall, f1 FROM prf UNION ALL SELECT version, 'macro', NULL, NULL, round(avg(f1), 9) FROM prf GROUP BY version")
def reshaped_route_metrics(spark, sf_dir):
    out = c.reshape_route_metrics(route_metrics(spark, sf_dir), V)
    return out.withColumn("f1", F.when(F.col("route") == "macro", F.round("f1", 9)).otherwise(F.col("f1")))


@query(PRF_SQL + "SELECT version, unnest([concat('precision/', class), concat('recall/', class), concat('f1/', class)]) AS key, unnest([precision, recall, f1]) AS value FROM prf UNION ALL SELECT version, 'f1/macro', round(avg(f1), 9) FROM prf GROUP BY version")
def stripped_metrics(spark, sf_dir):
    out = c.strip_confusion(route_metrics(spark, sf_dir))
    return out.withColumn("value", F.when(F.col("key") == "f1/macro", F.round("value", 9)).otherwise(F.col("value")))


@query(BASE_SQL + "SELECT version, count(*) AS total, count(*) FILTER (err) AS errors, round(count(*) FILTER (err) / count(*), 4) AS error_rate FROM res GROUP BY version")
def error_totals(spark, sf_dir):
    return m.error_totals(results(spark, sf_dir), V)


@query(BASE_SQL + """SELECT version, arg_min(route, (-sq / n, route)) AS baseline FROM (
  SELECT version, l.route, sum(q) AS sq, count(*) AS n FROM pairs p JOIN long_routes l USING (doc_id) GROUP BY ALL) GROUP BY version""")
def baseline_class(spark, sf_dir):
    return m.baseline_class(pairs(spark, sf_dir), V)


CQ_SQL = BASE_SQL + """, b AS (SELECT version, arg_min(route, (-sq / n, route)) AS baseline FROM (
  SELECT version, l.route, sum(q) AS sq, count(*) AS n FROM pairs p JOIN long_routes l USING (doc_id) GROUP BY ALL) GROUP BY version),
s AS (SELECT version, CAST(sum(CASE baseline WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END) AS BIGINT) AS bc,
  CAST(sum(1000 * CASE baseline WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS BIGINT) AS bq,
  CAST(sum(CASE pred WHEN 'simple' THEN cs WHEN 'moderate' THEN cm WHEN 'complex' THEN cc ELSE 0 END) AS BIGINT) AS pc,
  CAST(sum(1000 * CASE pred WHEN 'simple' THEN qs WHEN 'moderate' THEN qm WHEN 'complex' THEN qc ELSE 0 END) AS BIGINT) AS pq,
  CAST(sum(CASE route WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END) AS BIGINT) AS oc,
  CAST(sum(1000 * CASE route WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS BIGINT) AS oq, CAST(sum(spent) AS BIGINT) AS ov
  FROM pairs JOIN b USING (version) WHERE pred IS NULL OR pred <> 'unknown_model' GROUP BY version),
cq AS (SELECT version, bc / 1e6 AS baseline_cost, bq / 1e6 AS baseline_quality, pc / 1e6 AS predicted_cost, pq / 1e6 AS predicted_quality, oc / 1e6 AS oracle_cost, oq / 1e6 AS oracle_quality,
  ov / 1e6 AS routing_overhead, (pc - bc) / bc AS cost_change, (pc + ov - bc) / bc AS cost_change_with_overhead, (pq - bq) / bq AS quality_change, (oc - bc) / bc AS oracle_cost_change,
  (oq - bq) / bq AS oracle_quality_change, CASE WHEN oq <> bq THEN (1 + (pq - bq) / bq) / (1 + (oq - bq) / bq) ELSE 1.0 END AS oracle_quality_captured FROM s)
"""


@query(CQ_SQL + "SELECT * FROM cq")
def cost_quality_change(spark, sf_dir):
    return m.cost_quality_change(pairs(spark, sf_dir), V)


@query(BASE_SQL + "SELECT version, count(*) AS n_skipped, 'unknown_model' AS labels FROM pairs WHERE pred = 'unknown_model' GROUP BY version")
def hallucination_report(spark, sf_dir):
    return m.hallucination_report(pairs(spark, sf_dir), V).withColumn("labels", F.array_join("labels", ","))


@query(BASE_SQL + "SELECT version, count(*) AS total, count(*) FILTER (NOT err) AS succeeded, count(*) FILTER (err) AS failed, CAST(sum(spent) AS BIGINT) / 1e6 AS total_cost FROM res GROUP BY version")
def run_summary(spark, sf_dir):
    return m.run_summary(results(spark, sf_dir), V)


@query(BASE_SQL + """SELECT version, count(*) AS total, CAST(min(doc_id * 7 % 1000) AS BIGINT) AS first_second, CAST(max(doc_id * 7 % 1000 + doc_id % 13) AS BIGINT) AS last_second,
  CAST(max(doc_id * 7 % 1000 + doc_id % 13) - min(doc_id * 7 % 1000) AS DOUBLE) AS duration_seconds FROM res GROUP BY version""")
def run_times(spark, sf_dir):
    at = lambda x: F.timestamp_seconds(F.lit(1_700_000_000) + x)
    start = F.col("doc_id") * 7 % 1000
    timed = results(spark, sf_dir).withColumn("started_at", at(start)).withColumn("finished_at", at(start + F.col("doc_id") % 13))
    out = m.run_summary(timed, V)
    seconds = lambda c: F.unix_seconds(c) - 1_700_000_000
    return out.select("version", "total", seconds("start_time").alias("first_second"), seconds("end_time").alias("last_second"), "duration_seconds")


@query(BASE_SQL + """SELECT version, CASE WHEN doc_id % 41 = 0 THEN 'unknown' ELSE route END AS expected,
  CASE WHEN err THEN '(error)' WHEN pred IS NULL THEN '(no output)' ELSE pred END AS predicted, count(*) AS n FROM res GROUP BY ALL""")
def error_analysis(spark, sf_dir):
    return m.error_analysis(results(spark, sf_dir), examples(spark, sf_dir).where("doc_id % 41 <> 0"), V)


@query(BASE_SQL + """, t AS (SELECT route, CAST(sum(c) AS BIGINT) AS c, CAST(sum(1000 * q) AS BIGINT) AS q, count(*) AS n FROM long_routes GROUP BY route), n AS (SELECT count(*) AS n FROM ex),
f AS (SELECT 'always_cheapest' AS strategy, arg_min(route, (c / n, route)) AS route, arg_min(c, (c / n, route)) AS c, arg_min(q, (c / n, route)) AS q FROM t
  UNION ALL SELECT 'always_capable', arg_min(route, (-q / n, route)), arg_min(c, (-q / n, route)), arg_min(q, (-q / n, route)) FROM t),
o AS (SELECT version, 'optimized' AS strategy, CAST(NULL AS VARCHAR) AS route, CAST(sum(CASE pred WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END) AS BIGINT) AS c,
  CAST(sum(1000 * CASE pred WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS BIGINT) AS q FROM pairs WHERE pred IN ('simple', 'moderate', 'complex') GROUP BY version)
SELECT version, strategy, route, c / n / 1e6 AS cost, q / n / 1e6 AS quality FROM (SELECT version, f.* FROM f, (SELECT DISTINCT version FROM res) UNION ALL SELECT * FROM o), n""")
def baseline_strategies(spark, sf_dir):
    return m.baseline_strategies(examples(spark, sf_dir), results(spark, sf_dir), V)


@query(BASE_SQL + """, o AS (SELECT l.route, l.q, l.c, l.doc_id FROM long_routes l WHERE l.route = l.oracle),
j AS (SELECT o.*, bool_or(l.c <= o.c AND l.q >= o.q AND (l.c < o.c OR l.q > o.q)) AS dominated, bool_or(l.c < o.c AND l.q >= o.q) AS cheaper FROM o JOIN long_routes l USING (doc_id) GROUP BY ALL)
SELECT route, count(*) AS n, CAST(sum(c) AS BIGINT) / count(*) / 1e6 AS mean_cost, CAST(sum(1000 * q) AS BIGINT) / count(*) / 1e6 AS mean_quality,
  count(*) FILTER (NOT dominated) AS n_pareto, count(*) FILTER (cheaper) AS n_cheaper_as_good FROM j GROUP BY route""")
def oracle_distribution(spark, sf_dir):
    return m.oracle_distribution(examples(spark, sf_dir))


@query("""SELECT l_orderkey AS orderkey, count(*) AS n, count(*) FILTER (l_partkey % 3 = 2) AS n_unpriced,
  CAST(coalesce(sum(CASE l_partkey % 3 WHEN 0 THEN 3 * CAST(floor(l_quantity) AS BIGINT) * 100 + 15 * l_suppkey WHEN 1 THEN 1 * CAST(floor(l_quantity) AS BIGINT) * 100 + 5 * l_suppkey END), 0) AS BIGINT) AS micros
  FROM lineitem GROUP BY l_orderkey""")
def priced_results(spark, sf_dir):
    usage = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS orderkey", "'p' AS provider", "concat('m', l_partkey % 3) AS model", "CAST(floor(l_quantity) AS BIGINT) * 100 AS input_tokens", "0L AS cached_tokens",
        "0L AS cache_write_5m_tokens", "0L AS cache_write_1h_tokens", "CAST(l_suppkey AS BIGINT) AS output_tokens")
    pricing = spark.createDataFrame([("p", "m0", 3.0, 0.3, 3.75, 6.0, 15.0), ("p", "m1", 1.0, 0.1, 1.25, 2.0, 5.0)], "provider string, model string, input double, cached double, cache_write_5m double, cache_write_1h double, output double")
    priced = m.price_results(usage, pricing)
    return priced.groupBy("orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("priced_cost").isNull()).alias("n_unpriced"), F.sum(m.micro(F.col("priced_cost"))).alias("micros"))


@query(PRF_SQL + "SELECT version, concat('balanced/', class) AS key, round(recall, 9) AS value FROM prf WHERE support > 0")
def custom_metric(spark, sf_dir):
    def recalls(cells):
        hit = cells[cells["true"] == cells["pred"]].set_index("true")["n"]
        return {f"balanced/{c}": hit.get(c, 0) / n for c, n in cells.groupby("true")["n"].sum().items()}

    registry = m.MetricRegistry()
    registry.register("balanced", lambda p: m.per_group_metric(p, recalls, V))
    return registry.compute(pairs(spark, sf_dir), [("balanced", {})], V).withColumn("value", F.round("value", 9))


class _Overpaid(m.PairMetric):
    """By how many millionths the routes taken cost more than the true ones, and the share of pairs in which by more than `least`."""

    columns = ("route", "pred", "routes")

    def __init__(self, least: int):
        self.least = least

    def start(self):
        return 0, 0, 0

    def add(self, state, frame):
        more = [round((dict(e)[p]["cost"] - dict(e)[r]["cost"]) * 1e6) if p in dict(e) else 0 for r, p, e in zip(frame["route"], frame["pred"], frame["routes"])]
        return self.merge(state, (sum(max(0, x) for x in more), sum(x > self.least for x in more), len(more)))

    def merge(self, a, b):
        return tuple(x + y for x, y in zip(a, b))

    def finish(self, state):
        return {"overpaid": state[0], "share_overpaid": round(state[1] / state[2], 9)}


@query(BASE_SQL + """, o AS (SELECT version, CASE pred WHEN 'simple' THEN cs WHEN 'moderate' THEN cm WHEN 'complex' THEN cc END - CASE route WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END AS more FROM pairs)
SELECT version, 'overpaid' AS key, CAST(sum(greatest(0, coalesce(more, 0))) AS DOUBLE) AS value FROM o GROUP BY version UNION ALL SELECT version, 'share_overpaid', round(count(*) FILTER (more > 4000) / count(*), 9) FROM o GROUP BY version""")
def pair_metric(spark, sf_dir):
    """A user's metric that needs the costs of every pair, with a parameter."""
    registry = m.MetricRegistry()
    registry.register("overpaid", lambda p, least: m.pair_metric(p, _Overpaid(least), V))
    return registry.compute(pairs(spark, sf_dir), [("overpaid", {"least": 4000})], V)
