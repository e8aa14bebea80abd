"""Queries of the Pareto analytics over candidates made from the part table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import pareto as p
from quillon.plans.fixtures import BASE_SQL, candidates

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FRONT_SQL = BASE_SQL + """, front AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c))),
ref AS (SELECT run_id, CASE WHEN min(q) > 0 THEN min(q) * CAST(0.9 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END AS rq, CASE WHEN max(c) > 0 THEN max(c) * CAST(1.1 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS rc FROM cand GROUP BY run_id)
"""


@query(FRONT_SQL + "SELECT run_id, version, round, q AS quality, c AS cost FROM front")
def pareto_front(spark, sf_dir):
    return p.pareto_front(candidates(spark, sf_dir)).select("run_id", "version", "round", "quality", "cost")


@query(FRONT_SQL + "SELECT run_id, version, round, q AS quality, c AS cost FROM front")
def pareto_front_two_level(spark, sf_dir):
    return p.pareto_front(candidates(spark, sf_dir), locally=True).select("run_id", "version", "round", "quality", "cost")


@query(FRONT_SQL + """, d AS (SELECT *, count(*) OVER g AS n, lag(q) OVER wq AS ql, lead(q) OVER wq AS qh, lag(c) OVER wc AS cl, lead(c) OVER wc AS ch, max(q) OVER g - min(q) OVER g AS qs, max(c) OVER g - min(c) OVER g AS cs
  FROM front WINDOW g AS (PARTITION BY run_id), wq AS (PARTITION BY run_id ORDER BY q, version), wc AS (PARTITION BY run_id ORDER BY c, version))
SELECT run_id, version, CASE WHEN n <= 2 OR ql IS NULL OR qh IS NULL OR cl IS NULL OR ch IS NULL THEN -1.0 ELSE round(CASE WHEN qs = 0 THEN 0.0 ELSE (qh - ql) / qs END + CASE WHEN cs = 0 THEN 0.0 ELSE (ch - cl) / cs END, 9) END AS distance FROM d""")
def crowding_distance(spark, sf_dir):
    out = p.crowding_distance(p.pareto_front(candidates(spark, sf_dir)))
    return out.select("run_id", "version", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.round("distance", 9)).alias("distance"))


@query(FRONT_SQL + "SELECT run_id, rq AS ref_quality, rc AS ref_cost FROM ref")
def reference_point(spark, sf_dir):
    return p.reference_point(candidates(spark, sf_dir))


@query(FRONT_SQL + """, s AS (SELECT run_id, q - coalesce(lag(q) OVER w, rq) AS dq, rc - c AS dc FROM front JOIN ref USING (run_id) WINDOW w AS (PARTITION BY run_id ORDER BY q, c DESC, version))
SELECT run_id, round(sum(CASE WHEN dq > 0 AND dc > 0 THEN dq * dc ELSE 0 END), 4) AS hypervolume FROM s GROUP BY run_id""")
def hypervolume(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.hypervolume(p.pareto_front(points), p.reference_point(points)).withColumn("hypervolume", F.round("hypervolume", 4))


@query(FRONT_SQL + """, e AS (SELECT run_id, count(*) AS n, min(q) AS ql, max(q) AS qh, arg_min(c, (q, version)) AS cl, arg_min(c, (-q, version)) AS ch FROM front GROUP BY run_id),
x AS (SELECT f.*, CASE WHEN n <= 2 THEN CAST(q AS DOUBLE) ELSE abs((q - ql) / CASE WHEN qh <> ql THEN qh - ql ELSE 1.0 END + (c - ch) / CASE WHEN ch <> cl THEN cl - ch ELSE 1.0 END - 1) END AS far FROM front f JOIN e USING (run_id))
SELECT run_id, arg_min(version, (-far, version)) AS version, arg_min(q, (-far, version)) AS quality, arg_min(c, (-far, version)) AS cost FROM x GROUP BY run_id""")
def knee_point(spark, sf_dir):
    return p.knee_point(p.pareto_front(candidates(spark, sf_dir))).select("run_id", "version", "quality", "cost")


@query(FRONT_SQL + "SELECT run_id, version, row_number() OVER (PARTITION BY run_id ORDER BY q DESC, c, version) AS place FROM front")
def rank_front(spark, sf_dir):
    return p.rank_front(p.pareto_front(candidates(spark, sf_dir))).select("run_id", "version", F.col("place").cast("long").alias("place"))


@query(FRONT_SQL + """, g AS (SELECT a.run_id, a.version, f.version AS dominated_by, f.q - a.q AS quality_gap, a.c - f.c AS cost_gap FROM cand a JOIN front f ON f.run_id = a.run_id AND f.q >= a.q AND f.c <= a.c AND (f.q > a.q OR f.c < a.c))
SELECT run_id, version, arg_min(dominated_by, k) AS dominated_by, arg_min(quality_gap, k) AS quality_gap, arg_min(cost_gap, k) AS cost_gap FROM (SELECT *, (quality_gap + cost_gap, dominated_by) AS k FROM g) GROUP BY ALL""")
def near_misses(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.near_misses(points, p.pareto_front(points))


ROUND_FRONT_SQL = BASE_SQL + """, r AS (SELECT DISTINCT run_id, round AS r FROM cand), s AS (SELECT r.run_id, r.r, version, round, {q} AS q, {c} AS c FROM r JOIN cand ON cand.run_id = r.run_id AND cand.round <= r.r)
SELECT run_id, r AS round, version, q AS quality, c AS cost, round = r AS is_new FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.run_id = a.run_id AND b.r = a.r AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c))"""


@query(ROUND_FRONT_SQL.format(q="q", c="c"))
def fronts_by_round(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.fronts_by_round(points, points)


@query(ROUND_FRONT_SQL.format(q="2000 + q // 3", c="500 + 2 * c"))
def fronts_by_round_absolute(spark, sf_dir):
    points = candidates(spark, sf_dir).selectExpr("*", "2000 + quality div 3 AS quality_abs", "500 + 2 * cost AS cost_abs")
    return p.fronts_by_round(points, points, axes=("quality_abs", "cost_abs"))


@query(BASE_SQL + """, r AS (SELECT DISTINCT run_id, round AS r FROM cand)
SELECT r.run_id, r AS round, arg_min(version, (-q, c, round, version)) AS version, arg_min(q, (-q, c, round, version)) AS quality, arg_min(c, (-q, c, round, version)) AS cost FROM r JOIN cand ON cand.run_id = r.run_id AND cand.round <= r GROUP BY ALL""")
def journey(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.journey(points, points)


@query(BASE_SQL + """, a AS (SELECT run_id, max(q) AS a FROM cand WHERE round <= 4 AND run_id <> 3 GROUP BY run_id), b AS (SELECT run_id, max(q) AS b FROM cand WHERE round > 4 GROUP BY run_id)
SELECT run_id, CASE WHEN a IS NULL THEN b ELSE greatest(0, b - a) END AS improvement FROM b LEFT JOIN a USING (run_id)""")
def front_improvement(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.front_improvement(points.where("round <= 4 AND run_id <> 3"), points.where("round > 4"))


#: A step takes the most crowded point of every front that is still too large (pr: run_id, version, q, c, step k); a run's last step is its result.
_PRUNING = """
  UNION ALL
  SELECT run_id, version, q, c, k + 1 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY safe, d, version) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY q DESC, version) = 1 OR row_number() OVER (PARTITION BY run_id ORDER BY c, version) = 1 AS safe, count(*) OVER r AS n,
      coalesce((lead(q) OVER wq - lag(q) OVER wq) / (max(q) OVER r - min(q) OVER r), 'inf'::DOUBLE) + coalesce((lead(c) OVER wc - lag(c) OVER wc) / (max(c) OVER r - min(c) OVER r), 'inf'::DOUBLE) AS d
    FROM pr WINDOW r AS (PARTITION BY run_id), wq AS (PARTITION BY run_id ORDER BY q, version), wc AS (PARTITION BY run_id ORDER BY c, version)) WHERE n > {size}) WHERE place > 1), done AS (SELECT run_id, max(k) AS k FROM pr GROUP BY run_id)
"""


@query("WITH RECURSIVE" + FRONT_SQL.strip().removeprefix("WITH") + ", pr AS (SELECT run_id, version, q, c, 0 AS k FROM front" + _PRUNING.format(size=5) + "SELECT run_id, version, round, q AS quality, c AS cost FROM pr JOIN done USING (run_id, k) JOIN (SELECT version, round FROM cand) USING (version)")
def pruned_front(spark, sf_dir):
    return p.prune_to_size(p.pareto_front(candidates(spark, sf_dir)), 5)


@query(FRONT_SQL + """, s AS (SELECT a.run_id, a.version, NOT EXISTS (SELECT 1 FROM cand b WHERE b.run_id = a.run_id AND (b.round, b.version) < (a.round, a.version) AND b.q >= a.q AND b.c <= a.c) AS accepted,
  NOT EXISTS (SELECT 1 FROM cand b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c OR (b.round, b.version) < (a.round, a.version))) AS on_front FROM cand a)
SELECT * FROM s""")
def incremental_front(spark, sf_dir):
    return p.incremental_front(candidates(spark, sf_dir).select("run_id", "version", "round", "quality", "cost"), order="round").select("run_id", "version", "accepted", "on_front")


@query(BASE_SQL + """, s AS (SELECT run_id, version, (CAST(substr(version, 2) AS BIGINT) * 7919) % 100003 AS seq, q, c FROM cand)
SELECT run_id, version, NOT EXISTS (SELECT 1 FROM s b WHERE b.run_id = a.run_id AND b.seq < a.seq AND b.q >= a.q AND b.c <= a.c) AS accepted,
  NOT EXISTS (SELECT 1 FROM s b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c OR b.seq < a.seq)) AS on_front FROM s a""")
def incremental_front_by_one(spark, sf_dir):
    """Single inserts: every point has a place of its own in the order."""
    points = candidates(spark, sf_dir).selectExpr("run_id", "version", "(CAST(substr(version, 2) AS BIGINT) * 7919) % 100003 AS seq", "quality", "cost")
    return p.incremental_front(points).select("run_id", "version", "accepted", "on_front")


@query("WITH RECURSIVE" + BASE_SQL.strip().removeprefix("WITH") + """, e AS (SELECT run_id, version, q, c, round > 4 AS is_new FROM cand WHERE round > 4 OR run_id <> 3),
f AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c))), pr AS (SELECT run_id, version, q, c, 0 AS k FROM f"""
    + _PRUNING.format(size=7) + "SELECT run_id, version, q AS quality, c AS cost, is_new FROM pr JOIN done USING (run_id, k) JOIN (SELECT version, is_new FROM e) USING (version)")
def elite_set(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return p.elite_set(points.where("round <= 4 AND run_id <> 3"), points.where("round > 4"))


@query(None)
def advance_rounds(spark, sf_dir):
    points = candidates(spark, sf_dir).select("run_id", "version", "round", "quality", "cost", F.expr("quality >= 900 AND cost <= 300").alias("meets"), F.expr("IF(cost % 11 = 0 OR round = 6 AND run_id = 2, 'failed', 'complete')").alias("eval_status"))
    return p.advance_rounds(points, met="meets", budget=500, limit=2)
