"""Queries with resampling, a predictor or a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import bootstrap as b
from quillon.operators import inference
from quillon.operators import metrics as m
from quillon.plans.fixtures import BASE_SQL, candidates, examples, results
from quillon.plans.metric_queries import V, pairs
from quillon.sources.shared import shared_path
from quillon.streaming import results as stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(None)
def bootstrap_ci(spark, sf_dir):
    """With as many replicates as the number of pairs asks for; bootstrap_ci_checked holds the same function against SQL."""
    return b.bootstrap_ci(pairs(spark, sf_dir))


def _mix_steps(name: str, x: str, source: str, columns: str) -> str:
    """CTEs that put the finaliser's steps one after the other, so that no expression is written out twice."""
    return (
        f"{name}1 AS (SELECT {columns}, {x} AS x FROM {source}), {name}2 AS (SELECT {columns}, xor(x, x >> 16) * {b.MIX[0]}::UBIGINT % 4294967296 AS x FROM {name}1), "
        f"{name}3 AS (SELECT {columns}, xor(x, x >> 13) * {b.MIX[1]}::UBIGINT % 4294967296 AS x FROM {name}2), {name}4 AS MATERIALIZED (SELECT {columns}, xor(x, x >> 16) AS x FROM {name}3)"
    )


_FIGURES = "baseline_cost baseline_quality predicted_cost predicted_quality oracle_cost oracle_quality routing_overhead cost_change cost_change_with_overhead quality_change oracle_cost_change oracle_quality_change oracle_quality_captured".split()
BOOTSTRAP_SQL = BASE_SQL + ", " + _mix_steps("r", f"(b * {b.GOLDEN}::UBIGINT + 7) % 4294967296", "(SELECT b::UBIGINT AS b FROM generate_series(0, 29) AS t(b))", "b") + ", hp AS (SELECT *, ('0x' || substr(md5(id), 1, 8))::UBIGINT AS h FROM pairs), " + _mix_steps(
    "w", "(h + r4.x) % 4294967296", "hp, r4", "version, b, route, pred, qs, qm, qc, cs, cm, cc, spent") + ", wk AS MATERIALIZED (SELECT *, " + " + ".join(f"CASE WHEN x >> 16 >= {c} THEN 1 ELSE 0 END" for c in b.CUTS if c < 65_536) + """ AS k FROM w4),
wc AS MATERIALIZED (SELECT version, b, route AS t, coalesce(pred, '') AS p, CAST(sum(k) AS BIGINT) AS n FROM wk GROUP BY ALL HAVING sum(k) > 0),
cl AS MATERIALIZED (SELECT version, b, t AS c FROM wc UNION SELECT version, b, p FROM wc), ts AS (SELECT version, b, t AS c, sum(n) AS s FROM wc GROUP BY ALL), ps AS (SELECT version, b, p AS c, sum(n) AS s FROM wc GROUP BY ALL), hs AS (SELECT version, b, t AS c, n AS s FROM wc WHERE t = p),
pr AS (SELECT version, b, c, CASE WHEN ps.s > 0 THEN coalesce(hs.s, 0) / ps.s ELSE 0.0 END AS precision, CASE WHEN ts.s > 0 THEN coalesce(hs.s, 0) / ts.s ELSE 0.0 END AS recall FROM cl LEFT JOIN ts USING (version, b, c) LEFT JOIN ps USING (version, b, c) LEFT JOIN hs USING (version, b, c)),
pf AS MATERIALIZED (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr),
bl AS (SELECT version, b, sum(k * qs) AS a, sum(k * qm) AS m, sum(k * qc) AS z FROM wk GROUP BY ALL HAVING sum(k) > 0), bs AS (SELECT version, b, CASE WHEN z >= m AND z >= a THEN 'complex' WHEN m >= a THEN 'moderate' ELSE 'simple' END AS baseline FROM bl),
s AS (SELECT version, b, CAST(sum(k * CASE baseline WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END) AS BIGINT) AS bc, CAST(sum(k * 1000 * CASE baseline WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS BIGINT) AS bq,
  CAST(sum(k * CASE pred WHEN 'simple' THEN cs WHEN 'moderate' THEN cm WHEN 'complex' THEN cc ELSE 0 END) AS BIGINT) AS pc, CAST(sum(k * 1000 * CASE pred WHEN 'simple' THEN qs WHEN 'moderate' THEN qm WHEN 'complex' THEN qc ELSE 0 END) AS BIGINT) AS pq,
  CAST(sum(k * CASE route WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END) AS BIGINT) AS oc, CAST(sum(k * 1000 * CASE route WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS BIGINT) AS oq, CAST(sum(k * spent) AS BIGINT) AS ov
  FROM wk JOIN bs USING (version, b) WHERE pred IS NULL OR pred <> 'unknown_model' GROUP BY ALL),
cq AS MATERIALIZED (SELECT version, b, bc / 1e6 AS baseline_cost, bq / 1e6 AS baseline_quality, pc / 1e6 AS predicted_cost, pq / 1e6 AS predicted_quality, oc / 1e6 AS oracle_cost, oq / 1e6 AS oracle_quality, ov / 1e6 AS routing_overhead, (pc - bc) / bc AS cost_change,
  (pc + ov - bc) / bc AS cost_change_with_overhead, (pq - bq) / bq AS quality_change, (oc - bc) / bc AS oracle_cost_change, (oq - bq) / bq AS oracle_quality_change, CASE WHEN oq <> bq THEN (1 + (pq - bq) / bq) / (1 + (oq - bq) / bq) ELSE 1.0 END AS oracle_quality_captured FROM s),
v AS (SELECT version, 'accuracy' AS key, sum(n) FILTER (t = p) / sum(n) AS value FROM wc GROUP BY version, b UNION ALL SELECT version, 'f1/macro', avg(f1) FROM pf GROUP BY version, b
  UNION ALL SELECT version, unnest([concat('precision/', c), concat('recall/', c), concat('f1/', c)]), unnest([precision, recall, f1]) FROM pf
  UNION ALL SELECT x.version, concat('confusion/', x.c, '/', y.c), coalesce(n, 0) FROM cl x JOIN cl y USING (version, b) LEFT JOIN wc ON wc.version = x.version AND wc.b = x.b AND t = x.c AND p = y.c
  UNION ALL """ + " UNION ALL ".join(f"SELECT version, '{k}', {k} FROM cq" for k in _FIGURES) + """),
li AS (SELECT version, key, list_sort(list(round(value, 9))) AS v FROM v GROUP BY ALL HAVING count(*) >= 2)
SELECT version, key, v[CAST(floor(0.05::DOUBLE * len(v)) AS BIGINT) + 1] AS lower, v[least(CAST(floor(0.95::DOUBLE * len(v)) AS BIGINT), len(v) - 1) + 1] AS upper, len(v) AS n_replicates FROM li"""


@query(BOOTSTRAP_SQL)
def bootstrap_ci_checked(spark, sf_dir):
    out = b.bootstrap_ci(pairs(spark, sf_dir), n_replicates=30, seed=7, level=0.9)
    return out.withColumns({"lower": F.round("lower", 9), "upper": F.round("upper", 9), "n_replicates": F.col("n_replicates").cast("long")})


_CUTS = [int(c * 1_000_000) for c in b.poisson_cuts(8)]


@query(BASE_SQL + ", w AS (SELECT version, b AS replicate, pred, route, (('0x' || substr(md5(concat(id, '-', b)), 1, 8))::BIGINT) % 1000000 AS u FROM pairs, generate_series(0, 49) AS t(b)), x AS (SELECT *, "
       + " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in _CUTS) + " AS k FROM w) SELECT version, replicate, CAST(sum(k) AS BIGINT) AS n, CAST(sum(CASE WHEN pred = route THEN k ELSE 0 END) AS BIGINT) AS hits FROM x GROUP BY ALL")
def bootstrap_ci_fixed_weights(spark, sf_dir):
    return b.fixed_weight_sums(pairs(spark, sf_dir), 50).withColumn("replicate", F.col("replicate").cast("long"))


@query(BASE_SQL + "SELECT route AS true_route, route AS pred_route, count(*) AS n FROM ex GROUP BY route")
def echo_inference(spark, sf_dir):
    ex = examples(spark, sf_dir)
    scored = inference.score_examples(ex, inference.echo).withColumn("version", F.lit("echo"))
    return m.confusion_cells(m.pair_results(scored, ex, V), V).drop("version")


@query(BASE_SQL + "SELECT id AS example_id, CASE WHEN doc_id % 7 <> 0 THEN route END AS pred, CASE WHEN doc_id % 7 = 0 THEN 'KeyError: 7' END AS error, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS retries, CASE WHEN doc_id % 7 <> 0 THEN length(route) END AS output_tokens FROM ex")
def scored_examples(spark, sf_dir):
    """A predictor that raises where a row of some ids is among its rows; the run is made in two goes of four batches."""

    def predict(frame):
        if (frame["input"] == "0").any():
            raise KeyError(7)
        return [{"route": r, "output_tokens": len(r)} for r in frame["route"]]

    path, run = shared_path(spark, "scores"), {"prompt_version": "v1", "backend": "echo", "data_source": "documents"}
    ex = examples(spark, sf_dir).select("doc_id", "id", (F.col("doc_id") % 7).cast("string").alias("input"), "route")
    inference.score_into(ex.where("doc_id % 2 = 0"), predict, path, run, batches=4)
    out = inference.score_into(ex, predict, path, run, batches=4)
    return out.select("example_id", F.col("output.route").alias("pred"), "error", F.col("retries").cast("long").alias("retries"), F.col("token_usage.output_tokens").alias("output_tokens"))


def _streamed(spark, r, ex, files, compact):
    """The cells after a stream of results that come in so many batches (column part) has gone through."""
    at, tasks = shared_path(spark, "stream"), spark.sparkContext.defaultParallelism
    for k in range(files):  # as many files a batch as there are cores, in order
        r.where(F.col("part") == k).drop("part").repartition(tasks).write.mode("append").parquet(f"{at}/in/part={k}")
    schema = r.drop("part").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", tasks).option("latestFirst", False).parquet(f"{at}/in/part=*")
    changes = stream.cell_changes(arriving, ex)
    stream.start_cells(changes, f"{at}/cells", f"{at}/state", compact).awaitTermination()
    return stream.read_cells(spark, f"{at}/cells", changes.schema)


@query(BASE_SQL + "SELECT version, true_route, pred_route, n FROM cells")
def stream_confusion(spark, sf_dir):
    r = results(spark, sf_dir).withColumns({"arrived": F.timestamp_seconds(F.col("doc_id") + 1_000_000), "part": (F.col("doc_id") % 3).cast("int")})
    r = r.select("version", "example_id", "output", "error", "arrived", "part")
    return _streamed(spark, r.union(r.where("version = 'v1'").withColumn("part", F.lit(2))), examples(spark, sf_dir), 3, 50)  # some arrive twice


@query(BASE_SQL + """, c AS (SELECT 'all' AS version, doc_id, v, route AS true_route, coalesce(pred, '') AS pred_route, err FROM res WHERE v IN (1, 2, 4)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 5 = 0 THEN -v ELSE v END DESC) AS k FROM c)
SELECT version, true_route, pred_route, count(*) AS n FROM l WHERE k = 1 AND NOT err GROUP BY ALL""")
def stream_corrections(spark, sf_dir):
    """Three results an example, one a batch; each takes the place of the one before, but for every fifth, where later ones are older."""
    r = results(spark, sf_dir).where("v IN (1, 2, 4)").withColumns({"version": F.lit("all"), "arrived": F.expr("timestamp_seconds(1000000 + IF(doc_id % 5 = 0, -v, v))"), "part": F.expr("CAST(v div 2 AS INT)")})
    return _streamed(spark, r.select("version", "example_id", "output", "error", "arrived", "part"), examples(spark, sf_dir), 3, 2)


@query(BASE_SQL + "SELECT run_id, version, round, q AS quality, c AS cost FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c))")
def stream_front(spark, sf_dir):
    at = shared_path(spark, "stream")
    c = candidates(spark, sf_dir)
    c.repartition(3).write.parquet(f"{at}/in")
    arriving = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream.front_stream(arriving, f"{at}/front", f"{at}/state", compact=2).awaitTermination()
    return stream.latest_front(spark, f"{at}/front", c.schema)
