"""Queries of the comparisons and the review analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import compare as c
from quillon.operators import metrics as m
from quillon.operators import review as r
from quillon.operators.pareto import absolute_marks as marks_of
from quillon.operators.pareto import candidate_points as points_of
from quillon.operators.pareto import pareto_front
from quillon.plans.fixtures import BASE_SQL, candidates, examples, results
from quillon.plans.metric_queries import CQ_SQL, PRF_SQL, V, pairs
from quillon.sources import files
from quillon.sources.shared import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _metrics(spark, sf_dir):
    """version, key, value: accuracy, recalls, and the cost and quality figures."""
    p = pairs(spark, sf_dir)
    acc = m.accuracy(p, V).select("version", F.lit("accuracy").alias("key"), F.col("accuracy").alias("value"))
    recall = m.precision_recall_f1(m.confusion_cells(p, V), V).select("version", F.concat(F.lit("recall/"), "class").alias("key"), F.col("recall").alias("value"))
    return acc.unionByName(recall).unionByName(m.long_metrics(m.cost_quality_change(p, V), V))


_CQ = [x for x in "baseline_cost baseline_quality predicted_cost predicted_quality oracle_cost oracle_quality routing_overhead cost_change cost_change_with_overhead quality_change oracle_cost_change oracle_quality_change oracle_quality_captured".split()]
LONG_SQL = CQ_SQL + PRF_SQL[len(BASE_SQL) :] + """, lm AS MATERIALIZED (SELECT version, CAST(substr(version, 2) AS INT) AS v, 'accuracy' AS key, count(*) FILTER (pred = route) / count(*) AS value FROM pairs GROUP BY version
  UNION ALL SELECT version, CAST(substr(version, 2) AS INT), concat('recall/', class), recall FROM prf UNION ALL """ + " UNION ALL ".join(f"SELECT version, CAST(substr(version, 2) AS INT), '{k}', {k} FROM cq" for k in _CQ) + ")\n"


@query(LONG_SQL + """, a AS (SELECT * FROM lm WHERE version = 'v1' AND key <> 'accuracy'), b2 AS (SELECT * FROM lm WHERE version = 'v2' AND key <> 'recall/')
SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b2 b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def metric_diffs(spark, sf_dir):
    both = _metrics(spark, sf_dir)
    old, new = both.where("version = 'v1' AND key <> 'accuracy'"), both.where("version = 'v2' AND key <> 'recall/'")
    return c.metric_diffs(old.drop("version"), new.drop("version"), ())


@query(BASE_SQL + """, s AS (SELECT v, CAST(sum(spent) AS BIGINT) / 1e6 AS total_cost, count(*) FILTER (err) AS failed FROM res GROUP BY v)
SELECT a.v, a.total_cost AS old_total_cost, a.failed AS old_failed, b.total_cost AS new_total_cost, b.failed AS new_failed FROM s a JOIN s b ON b.v = a.v + 1 WHERE a.total_cost <> b.total_cost OR a.failed <> b.failed""")
def overhead_diff(spark, sf_dir):
    s = m.run_summary(results(spark, sf_dir), ("v",))
    return c.overhead_diff(s, s.withColumn("v", F.col("v") - 1), ("v",), ("total_cost", "failed"))


@query(BASE_SQL + "SELECT version, id AS example_id, 'timeout' AS error, 3 AS retries FROM res WHERE err")
def score_report_errors(spark, sf_dir):
    return results(spark, sf_dir).where("error IS NOT NULL").select("version", "example_id", "error", "retries")


@query(LONG_SQL + """, sm AS MATERIALIZED (SELECT version, v, CAST(sum(spent) AS BIGINT) / 1e6 AS total_cost FROM res GROUP BY ALL)
SELECT version, 'metrics' AS part, key, CAST(NULL AS DOUBLE) AS old, value AS new FROM lm UNION ALL SELECT version, 'summary', 'total_cost', NULL, total_cost FROM sm UNION ALL SELECT version, 'errors', id, NULL, 3 FROM res WHERE err
UNION ALL SELECT coalesce(n.version, concat('v', o.v + 1)), 'metric_diffs', coalesce(n.key, o.key), o.value, n.value FROM lm n FULL JOIN lm o ON o.key = n.key AND n.v = o.v + 1 WHERE n.value IS DISTINCT FROM o.value
UNION ALL SELECT n.version, 'overhead_diff', 'total_cost', o.total_cost, n.total_cost FROM sm n JOIN sm o ON n.v = o.v + 1 WHERE n.total_cost <> o.total_cost""")
def score_report(spark, sf_dir):
    both, summary = _metrics(spark, sf_dir), m.run_summary(results(spark, sf_dir), V)
    later = lambda df: df.withColumn("version", F.concat(F.lit("v"), F.substring("version", 2, 9).cast("int") + 1))
    parts = c.score_report(both, summary, results(spark, sf_dir), (later(both), later(summary)), V)
    none = F.lit(None).cast("double")
    row = lambda part, key, old, new: parts[part].select("version", F.lit(part).alias("part"), key.alias("key"), old.cast("double").alias("old"), new.cast("double").alias("new"))
    rows = row("metrics", F.col("key"), none, F.col("value")).unionByName(row("summary", F.lit("total_cost"), none, F.col("total_cost"))).unionByName(row("errors", F.col("example_id"), none, F.col("retries")))
    return rows.unionByName(row("metric_diffs", F.col("key"), F.col("old"), F.col("new"))).unionByName(row("overhead_diff", F.lit("total_cost"), F.col("old_total_cost"), F.col("new_total_cost")))


@query(LONG_SQL + """, sm AS MATERIALIZED (SELECT version, v, CAST(sum(spent) AS BIGINT) / 1e6 AS total_cost, count(*) FILTER (err) AS failed, count(*) AS total FROM res GROUP BY ALL)
SELECT version, 'metrics' AS part, key, CAST(NULL AS DOUBLE) AS old, value AS new FROM lm WHERE v > 1 UNION ALL SELECT version, 'summary', unnest(['total', 'failed', 'total_cost']), NULL, unnest([total, failed, total_cost]) FROM sm WHERE v > 1
UNION ALL SELECT version, CASE WHEN v = 2 THEN 'errors beside' ELSE 'errors inside' END, id, NULL, 3 FROM res WHERE err AND v > 1
UNION ALL SELECT version, 'metric_diffs', key, old, value FROM (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS k FROM lm WINDOW w AS (PARTITION BY key ORDER BY v)) WHERE k > 1 AND value IS DISTINCT FROM old
UNION ALL SELECT n.version, 'overhead_diff', 'total_cost', o.total_cost, n.total_cost FROM sm n JOIN sm o ON n.v = o.v + 1 WHERE n.total_cost <> o.total_cost""")
def report_round_trip(spark, sf_dir):
    """Reports of versions two to six against the version before each, written as documents and read back; one version's errors lie beside its document."""
    both, r = _metrics(spark, sf_dir), results(spark, sf_dir)
    summary = m.run_summary(r, V)
    later = lambda df: df.withColumn("version", F.concat(F.lit("v"), F.substring("version", 2, 9).cast("int") + 1)).where("version <> 'v7'")
    first = lambda df: df.where("version <> 'v1'")
    parts = c.score_report(first(both), first(summary), first(r), (later(both), later(summary)), V)
    docs, beside = c.report_documents(parts, V, inside=0)
    inside, _ = c.report_documents(parts, V)
    path = shared_path(spark, "report")
    files.write_reports(inside.where("version <> 'v2'").unionByName(docs.where("version = 'v2'")), beside.where("version = 'v2'"), path)
    back = files.read_reports(spark, path)
    none = F.lit(None).cast("double")
    rows = back.select("version", F.lit("metrics").alias("part"), F.explode("metrics").alias("key", "new")).select("version", "part", "key", none.alias("old"), "new")
    part = lambda name, entries: back.select("version", F.lit(name).alias("part"), F.inline(entries))
    figure = lambda name, old, new: F.struct(F.lit(name).alias("key"), old.cast("double").alias("old"), new.cast("double").alias("new"))
    rows = rows.unionByName(part("summary", F.array(*[figure(k, none, F.col(f"summary.{k}")) for k in ("total", "failed", "total_cost")])))
    error = lambda e: F.struct(e["example_id"].alias("key"), none.alias("old"), e["retries"].cast("double").alias("new"))
    rows = rows.unionByName(part("errors inside", F.transform("errors", error)))
    lines = spark.read.schema("version string, example_id string, error string, retries int").json(f"{path}/errors")
    rows = rows.unionByName(lines.select("version", F.lit("errors beside").alias("part"), F.col("example_id").alias("key"), none.alias("old"), F.col("retries").cast("double").alias("new")))
    rows = rows.unionByName(part("metric_diffs", F.transform("diff.metric_diffs", lambda d: F.struct(d["key"].alias("key"), d["old"].alias("old"), d["new"].alias("new")))))
    over = back.where("diff.overhead_diff.old_total_cost <> diff.overhead_diff.new_total_cost")
    return rows.unionByName(over.select("version", F.lit("overhead_diff").alias("part"), F.lit("total_cost").alias("key"), F.col("diff.overhead_diff.old_total_cost").alias("old"), F.col("diff.overhead_diff.new_total_cost").alias("new")))


@query(LONG_SQL + "SELECT v, key, value, lag(value) OVER (PARTITION BY key ORDER BY v) AS previous FROM lm")
def metrics_with_previous(spark, sf_dir):
    rows = _metrics(spark, sf_dir).select(F.substring("version", 2, 9).cast("int").alias("v"), "key", "value")
    return c.with_previous(rows, (), "v")


@query(LONG_SQL + """, vs AS (SELECT DISTINCT version, v FROM lm), j AS (SELECT s.version, CASE WHEN s.v % 3 = 1 THEN NULL WHEN s.v % 3 = 2 THEN 'v9' ELSE concat('v', s.v - 1) END AS parent FROM vs s),
d AS (SELECT j.version, a.key, a.value - p.value AS d FROM j JOIN lm a ON a.version = j.version JOIN lm p ON p.version = j.parent AND p.key = a.key)
SELECT version, parent, (SELECT d FROM d WHERE d.version = j.version AND key = 'accuracy') AS quality_delta, (SELECT d FROM d WHERE d.version = j.version AND key = 'cost_change_with_overhead') AS cost_delta,
  (SELECT count(*) FROM d WHERE d.version = j.version AND starts_with(key, 'recall/')) AS n_recalls, (SELECT d FROM d WHERE d.version = j.version AND key = 'recall/complex') AS recall_complex FROM j""")
def candidate_comparisons(spark, sf_dir):
    parents = spark.range(1, 9).selectExpr("concat('v', id) AS version", "CASE WHEN id % 3 = 1 THEN NULL WHEN id % 3 = 2 THEN 'v9' ELSE concat('v', id - 1) END AS parent_version")
    out = c.candidate_comparisons(_metrics(spark, sf_dir), parents, ())
    return out.select("version", "parent", "quality_delta", "cost_delta", F.size("recall_deltas").cast("long").alias("n_recalls"), F.try_element_at("recall_deltas", F.lit("complex")).alias("recall_complex"))


@query(LONG_SQL + """, bk AS (SELECT key, v, version, value, lag(value) OVER w AS one, lag(value, 2) OVER w AS two, row_number() OVER w AS k FROM lm WINDOW w AS (PARTITION BY key ORDER BY v)),
d AS (SELECT version, 'parent' AS against, key, value - one AS delta FROM bk WHERE k > 1 AND v NOT IN (1, 4) UNION ALL SELECT version, 'secondary', key, value - two FROM bk WHERE k > 2 AND v NOT IN (1, 4) AND v % 2 = 1)
SELECT * FROM d WHERE key IN ('accuracy', 'cost_change', 'cost_change_with_overhead', 'oracle_quality_captured', 'oracle_quality_change', 'quality_change', 'baseline_cost') OR abs(delta) > 0.01""")
def batch_metric_deltas(spark, sf_dir):
    variants = spark.range(2, 9).selectExpr("concat('v', id) AS version", "concat('v', id - 1) AS parent_version", "IF(id % 2 = 0, NULL, concat('v', id - 2)) AS secondary_parent_version")
    cands = spark.range(1, 7).selectExpr("concat('v', id) AS version", "IF(id = 4, 'failed', 'scored') AS eval_status")
    return c.batch_metric_deltas(variants, cands, _metrics(spark, sf_dir), ("baseline_cost",), ())


@query(LONG_SQL + """SELECT version, concat('v', v - 1) AS parent, key, value - before AS delta FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM lm WINDOW w AS (PARTITION BY key ORDER BY v)) WHERE k > 1""")
def candidate_deltas(spark, sf_dir):
    parents = spark.range(2, 7).selectExpr("concat('v', id) AS version", "concat('v', id - 1) AS parent_version")
    return c.candidate_deltas(_metrics(spark, sf_dir), parents, ())


@query(LONG_SQL + """, d AS (SELECT version, key, value - lag(value) OVER w AS delta, row_number() OVER w AS k FROM lm WINDOW w AS (PARTITION BY key ORDER BY v))
SELECT version, key, delta FROM d WHERE k > 1 AND ( key IN ('accuracy', 'cost_change', 'cost_change_with_overhead', 'oracle_quality_captured', 'oracle_quality_change', 'quality_change') OR abs(delta) > 0.01)""")
def filtered_deltas(spark, sf_dir):
    return c.filter_metric_deltas(candidate_deltas(spark, sf_dir)).drop("parent")


@query(BASE_SQL + """, p AS (SELECT version, doc_id % 5 = 0 AS h, count(*) FILTER (pred = route) / count(*) AS value FROM pairs GROUP BY ALL)
SELECT a.version, 'accuracy' AS key, round(a.value, 4) AS dev, round(b.value, 4) AS holdout, round(b.value - a.value, 4) AS delta FROM p a JOIN p b USING (version) WHERE NOT a.h AND b.h""")
def dev_vs_holdout(spark, sf_dir):
    p = pairs(spark, sf_dir)
    held = F.substring("id", 2, 20).cast("long") % 5 == 0
    both = [m.long_metrics(m.accuracy(x, V).select("version", "accuracy"), V) for x in (p.where(~held), p.where(held))]
    return c.dev_vs_holdout(*both, V)


@query(LONG_SQL + "SELECT version, max(value) FILTER (key = 'oracle_quality_captured') AS quality, max(value) FILTER (key = 'cost_change_with_overhead') AS cost FROM lm GROUP BY version")
def quality_score_of(spark, sf_dir):
    return c.quality_score_of(_metrics(spark, sf_dir), None, V)


_TARGETS = [("accuracy", ">=", 0.8), ("cost_change", "<=", 0.0), ("recall/simple", ">", 0.75), ("nothing", ">=", 2.0), ("baseline_cost", ">=", 0.0), ("cost_change_with_overhead", "<=", -0.3), ("quality_change", ">=", -0.01)]


def _targets(spark):
    return spark.createDataFrame(_TARGETS, "metric string, operator string, threshold double")


TARGET_SQL = LONG_SQL + """, tg AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', '{o}', {t}::DOUBLE)" for m, o, t in _TARGETS) + """) AS t(metric, operator, threshold)),
tj AS (SELECT g.version, tg.*, lm.value FROM (SELECT DISTINCT version FROM lm) g CROSS JOIN tg LEFT JOIN lm ON lm.version = g.version AND lm.key = tg.metric),
tm AS (SELECT *, coalesce(CASE operator WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value > threshold END, false) AS met, CASE WHEN value IS NULL OR threshold = 0 THEN NULL ELSE abs(value / threshold) END AS x FROM tj),
tp AS (SELECT version, metric, operator, threshold, value, met, CASE WHEN met AND x IS NOT NULL THEN greatest(x, 1.0) ELSE x END AS ratio FROM tm),
ok AS (SELECT *, CASE metric WHEN 'cost_change' THEN 'oracle_cost_change' WHEN 'cost_change_with_overhead' THEN 'oracle_cost_change' WHEN 'quality_change' THEN 'oracle_quality_change' END AS okey FROM tp)
"""


@query(TARGET_SQL + """SELECT ok.version, metric, ok.value, met, ratio, o.value AS ceiling, CAST(NULL AS DOUBLE) AS full_ceiling, CAST(NULL AS DOUBLE) AS capture_ratio, CAST(NULL AS DOUBLE) AS translated,
  CASE WHEN o.value IS NULL OR threshold = 0 THEN false WHEN operator = '<=' THEN threshold < o.value ELSE threshold > o.value END AS above_oracle FROM ok LEFT JOIN lm o ON o.version = ok.version AND o.key = okey""")
def target_progress(spark, sf_dir):
    return c.target_progress(_metrics(spark, sf_dir), _targets(spark), V)


@query(TARGET_SQL + """, x AS (SELECT ok.*, o.value AS ceiling, f.value AS full_ceiling, threshold / f.value AS capture_ratio, threshold / f.value * o.value AS translated
  FROM ok LEFT JOIN lm o ON o.version = 'v2' AND o.key = okey LEFT JOIN lm f ON f.version = 'v6' AND f.key = okey),
y AS (SELECT *, coalesce(translated, threshold) AS goal FROM x),
z AS (SELECT *, coalesce(CASE operator WHEN '>=' THEN value >= goal WHEN '<=' THEN value <= goal ELSE value > goal END, false) AS now_met FROM y)
SELECT version, metric, value, now_met AS met, CASE WHEN goal = 0 THEN NULL WHEN now_met THEN greatest(abs(value / goal), 1.0) ELSE abs(value / goal) END AS ratio, ceiling, full_ceiling, capture_ratio, translated,
  coalesce(abs(capture_ratio) > 1, false) AS above_oracle FROM z""")
def target_progress_translated(spark, sf_dir):
    both = _metrics(spark, sf_dir)
    return c.target_progress(both, _targets(spark), V, both.where("version = 'v2'"), both.where("version = 'v6'"))


@query(TARGET_SQL + """, q AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE coalesce(least(ratio, 1.0), CASE WHEN met THEN 1.0 ELSE 0.0 END) END AS p FROM tp)
SELECT version, count(*) FILTER (met) AS n_met, round(coalesce(sum(p), 0.0), 9) AS progress, coalesce(min(p), 0.0) AS least, bool_and(met) AS all_met FROM q GROUP BY version""")
def targets_met(spark, sf_dir):
    return c.targets_met(_metrics(spark, sf_dir), _targets(spark), V).withColumn("progress", F.round("progress", 9))


@query(TARGET_SQL + """, sl AS (SELECT version, metric, CASE WHEN value IS NULL THEN -CASE WHEN threshold = 0 THEN 1.0 ELSE abs(threshold) END WHEN operator IN ('>=', '>') THEN value - threshold ELSE threshold - value END AS surplus FROM tp),
w AS (SELECT version, sum(greatest(-surplus, 0.0)) AS total FROM sl GROUP BY version)
SELECT version, metric, surplus, greatest(surplus, 0.0) AS budget, round(CASE WHEN total > 0 THEN greatest(-surplus, 0.0) / total ELSE 0.0 END, 9) AS weight FROM sl JOIN w USING (version)""")
def target_slack(spark, sf_dir):
    return c.target_slack(_metrics(spark, sf_dir), _targets(spark), V).withColumn("weight", F.round("weight", 9))


@query(CQ_SQL + "SELECT version, cost_change / oracle_cost_change AS cost_ratio, (1 + quality_change) / (1 + oracle_quality_change) AS quality_ratio FROM cq")
def oracle_captured(spark, sf_dir):
    return c.oracle_captured(m.cost_quality_change(pairs(spark, sf_dir), V), V)


MIS_SQL = BASE_SQL + """, mis AS (SELECT DISTINCT doc_id, route AS true_route, pred AS pred_route,
  CASE pred WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END - CASE route WHEN 'simple' THEN cs WHEN 'moderate' THEN cm ELSE cc END AS dc,
  1000 * (CASE pred WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END - CASE route WHEN 'simple' THEN qs WHEN 'moderate' THEN qm ELSE qc END) AS dq
  FROM pairs WHERE pred <> route AND pred <> 'unknown_model')
"""


@query(MIS_SQL + """, k AS (SELECT true_route, pred_route, count(*) AS n, CAST(sum(dc) AS BIGINT) AS c, CAST(sum(dq) AS BIGINT) AS q FROM mis GROUP BY ALL), s AS (SELECT route AS true_route, count(*) AS support FROM ex GROUP BY route)
SELECT true_route, pred_route, n, support, n / support AS misroute_rate, c / 1e6 AS cost_impact, q / 1e6 AS quality_impact, c / n / 1e6 AS mean_cost, q / n / 1e6 AS mean_quality FROM k JOIN s USING (true_route)""")
def confusion_impact(spark, sf_dir):
    return r.confusion_impact(pairs(spark, sf_dir), examples(spark, sf_dir), ())


@query(MIS_SQL + """, w AS (SELECT doc_id FROM pairs WHERE pred IS NULL OR pred <> route GROUP BY doc_id HAVING count(DISTINCT version) = 6),
k AS (SELECT true_route, pred_route, count(*) AS n, count(w.doc_id) AS persistent FROM mis LEFT JOIN w USING (doc_id) GROUP BY ALL)
SELECT *, n - persistent AS volatile, persistent / n AS rate, CASE WHEN persistent / n > 0.8 THEN 'structural' WHEN persistent / n < 0.3 THEN 'prompt-sensitive' ELSE 'mixed' END AS label FROM k""")
def persistence(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("run_id", F.lit("r0"))
    return r.persistence(p).drop("run_id")


@query(MIS_SQL + "SELECT true_route, pred_route, string_agg(concat('d', doc_id), ',' ORDER BY concat('d', doc_id)) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY true_route, pred_route ORDER BY concat('d', doc_id)) AS k FROM mis) WHERE k <= 3 GROUP BY ALL")
def confusion_samples(spark, sf_dir):
    return r.sample_ids(r.misroutes(pairs(spark, sf_dir), ()), ("true_route", "pred_route")).withColumn("ids", F.array_join("ids", ","))


@query("""WITH t AS (SELECT DISTINCT o_orderpriority AS version, o_custkey AS id FROM orders), v AS (SELECT count(DISTINCT version) AS n FROM t), i AS (SELECT id, count(*) AS k FROM t GROUP BY id)
SELECT count(*) FILTER (k = n) / count(*) AS overlap FROM i, v""")
def example_overlap(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    prompts = orders.select(F.col("o_orderpriority").alias("version"), F.concat(F.lit("Text. ### Example "), "o_custkey", F.lit(" and so on")).alias("text"))
    return r.example_overlap(r.example_ids(prompts))


def _scores(spark, sf_dir):
    """run_id, round, version, score, from the part table; some rounds have no score."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey % 20 AS run_id", "1 + (p_partkey div 20) % 12 AS round", "p_partkey AS version", "CASE WHEN (p_partkey div 20) % 12 = 5 THEN NULL ELSE (p_partkey * 7919) % 1000 END AS score", "p_size AS support", "concat('c', p_partkey % 3) AS route")


SCORE_SQL = "WITH sc AS (SELECT p_partkey % 20 AS run_id, 1 + (p_partkey // 20) % 12 AS round, p_partkey AS version, CASE WHEN (p_partkey // 20) % 12 = 5 THEN NULL ELSE (p_partkey * 7919) % 1000 END AS score, p_size AS support, concat('c', p_partkey % 3) AS route FROM part)\n"


@query(SCORE_SQL + """, b AS (SELECT run_id, round, route, max(score) AS recall, arg_max(support, (score, support)) AS support FROM sc WHERE score IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, route ORDER BY round DESC) AS k FROM b)
SELECT run_id, route, max(recall) FILTER (k = 1) AS current, coalesce(max(recall) FILTER (k = 2), max(recall) FILTER (k = 1)) AS previous, string_agg(CAST(recall AS VARCHAR), ',' ORDER BY round) FILTER (k <= 5) AS trend,
  max(support) FILTER (k = 1) AS support, max(recall) FILTER (k = 1) < coalesce(max(recall) FILTER (k = 2), max(recall) FILTER (k = 1)) AS regressed FROM k GROUP BY ALL""")
def recall_trend(spark, sf_dir):
    rows = _scores(spark, sf_dir).where("score IS NOT NULL").withColumnRenamed("score", "recall")
    return r.recall_trend(rows).withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


@query(SCORE_SQL + "SELECT run_id, round, max(score) AS score FROM sc WHERE score IS NOT NULL GROUP BY ALL")
def score_trajectory(spark, sf_dir):
    return r.score_trajectory(_scores(spark, sf_dir))


@query(SCORE_SQL + """, t AS (SELECT run_id, round, max(score) AS score FROM sc WHERE score IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round DESC) AS k, max(score) OVER (PARTITION BY run_id) AS best FROM t),
d AS (SELECT *, score - lag(score) OVER (PARTITION BY run_id ORDER BY round) AS d FROM k WHERE k <= 7)
SELECT run_id, count(*) AS n_points, round(avg(d), 9) AS trend, round(CASE WHEN count(d) < 2 THEN 0.0 ELSE stddev_pop(d) END, 6) AS spread, greatest(0.005::DOUBLE, max(best) * 0.01::DOUBLE) AS threshold,
  count(*) >= 2 AND avg(d) < greatest(0.005::DOUBLE, max(best) * 0.01::DOUBLE) AS stagnating,
  (SELECT string_agg(CAST(score AS VARCHAR), ',' ORDER BY round) FROM k WHERE k.run_id = d.run_id AND k.k <= 8) AS scores FROM d GROUP BY run_id""")
def diminishing_returns(spark, sf_dir):
    out = r.diminishing_returns(r.score_trajectory(_scores(spark, sf_dir)))
    return out.withColumn("trend", F.round("trend", 9)).withColumn("spread", F.round("spread", 6)).withColumn("scores", F.array_join(F.col("scores").cast("array<string>"), ","))


ATTEMPT_SQL = """WITH a AS (SELECT o_custkey % 10 AS run_id, concat('c', o_custkey % 97) AS cell, o_orderkey AS seq, o_orderkey % 9 AS round, CASE o_orderkey % 7 WHEN 0 THEN 'improved' WHEN 1 THEN 'no_effect' ELSE 'regressed' END AS outcome FROM orders),
cell AS (SELECT DISTINCT c_custkey % 10 AS run_id, concat('c', c_custkey % 97) AS cell, 100.0::DOUBLE + c_custkey % 97 AS impact FROM customer)
"""


@query(ATTEMPT_SQL + """, w AS (SELECT *, max(CASE WHEN outcome = 'improved' THEN seq END) OVER (PARTITION BY run_id, cell) AS won FROM a),
s AS (SELECT run_id, cell, count(*) AS attempts, count(*) FILTER (outcome <> 'improved' AND (won IS NULL OR seq > won)) AS failures, max(round) AS last_round,
  CASE WHEN bool_or(outcome = 'improved') THEN 'improved' WHEN bool_or(outcome = 'no_effect') THEN 'no_effect' ELSE 'regressed' END AS best_outcome FROM w GROUP BY ALL)
SELECT c.*, coalesce(attempts, 0) AS attempts, coalesce(failures, 0) AS failures, last_round, best_outcome, impact * pow(0.5, coalesce(failures, 0)) AS effective FROM cell c LEFT JOIN s USING (run_id, cell)""")
def attempt_decay(spark, sf_dir):
    attempts = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 10 AS run_id", "concat('c', o_custkey % 97) AS cell", "o_orderkey AS seq", "o_orderkey % 9 AS round", "CASE o_orderkey % 7 WHEN 0 THEN 'improved' WHEN 1 THEN 'no_effect' ELSE 'regressed' END AS outcome")
    cells = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey % 10 AS run_id", "concat('c', c_custkey % 97) AS cell", "100.0D + c_custkey % 97 AS impact").distinct()
    return r.attempt_decay(cells, attempts)


@query("""WITH c AS (SELECT c_custkey AS cell, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 31) % 21 - 10 END AS cost_delta, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 17) % 21 - 10 END AS quality_delta, c_custkey % 13 AS cost_impact, c_custkey % 7 AS quality_impact FROM customer)
SELECT cell, CASE WHEN cost_delta IS NOT NULL AND abs(cost_impact) > abs(quality_impact) THEN CASE WHEN -cost_delta > 5 THEN 'improved' WHEN -cost_delta < -5 THEN 'regressed' ELSE 'no_effect' END
  WHEN quality_delta > 5 THEN 'improved' WHEN quality_delta < -5 THEN 'regressed' ELSE 'no_effect' END AS outcome FROM c""")
def cell_outcome(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS cell", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 31) % 21 - 10 END AS cost_delta", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 17) % 21 - 10 END AS quality_delta", "c_custkey % 13 AS cost_impact", "c_custkey % 7 AS quality_impact")
    return r.cell_outcomes(cells, 5).select("cell", "outcome")


VARIANT_SQL = "WITH vr AS (SELECT o_custkey % 10 AS run_id, o_orderkey % 9 AS round, o_custkey % 50 AS d1, 50 + o_custkey % 30 AS d2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 - 3 END AS delta FROM orders), x AS (SELECT run_id, round, d1 AS directive, delta FROM vr UNION ALL SELECT run_id, round, d2, delta FROM vr)\n"


def _variants(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_custkey % 10 AS run_id", "o_orderkey AS version", "o_orderkey % 9 AS round", "array(o_custkey % 50, 50 + o_custkey % 30) AS directive_ids", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 - 3 END AS delta",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE 'scored' END AS eval_status")


@query(VARIANT_SQL + """, s AS (SELECT run_id, directive, count(delta) AS attempted, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS regressed, count(*) FILTER (delta = 0) AS no_effect, max(round) AS last_round FROM x GROUP BY ALL)
SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY last_round DESC, directive) AS k FROM s) WHERE k <= 15""")
def directive_counts(spark, sf_dir):
    return r.directive_counts(_variants(spark, sf_dir))


@query("""WITH o AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), x AS (SELECT o_custkey % 10 AS run_id, o_orderkey % 9 AS round, o_orderkey AS version, unnest([0, 1]) AS place, unnest([o_custkey % 50, 50 + o_custkey % 30]) AS directive,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 - 3 END AS delta, o_orderkey % 4 AS s FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round DESC, version DESC, place DESC) AS k FROM x)
SELECT run_id, version, directive, s NOT IN (0, 1) AS was_attempted, CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'regressed' ELSE 'no_effect' END AS outcome FROM k WHERE k <= 15""")
def directive_outcomes(spark, sf_dir):
    return r.directive_outcomes(_variants(spark, sf_dir).distinct())


@query(ATTEMPT_SQL + """, n AS (SELECT c_custkey % 10 AS run_id, concat('c', c_custkey % 211) AS cell, c_custkey AS variant, CASE c_custkey % 3 WHEN 0 THEN 'improved' ELSE 'no_effect' END AS outcome FROM customer WHERE c_custkey % 6 <> 1),
l AS (SELECT run_id, cell, max(seq) AS last FROM a GROUP BY ALL)
SELECT run_id, cell, seq, CAST(round AS INT) AS round, outcome FROM a UNION ALL SELECT n.run_id, n.cell, coalesce(last, 0) + row_number() OVER (PARTITION BY n.run_id, n.cell ORDER BY variant), 10, outcome FROM n LEFT JOIN l USING (run_id, cell)""")
def appended_attempts(spark, sf_dir):
    attempts = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 10 AS run_id", "concat('c', o_custkey % 97) AS cell", "o_orderkey AS seq", "o_orderkey % 9 AS round", "CASE o_orderkey % 7 WHEN 0 THEN 'improved' WHEN 1 THEN 'no_effect' ELSE 'regressed' END AS outcome")
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey % 10 AS run_id", "IF(c_custkey % 6 = 1, NULL, concat('c', c_custkey % 211)) AS cell", "c_custkey AS variant", "CASE c_custkey % 3 WHEN 0 THEN 'improved' ELSE 'no_effect' END AS outcome")
    return r.append_attempts(attempts, new, 10)


@query(BASE_SQL + """, cs AS (SELECT *, CASE WHEN c % 7 = 0 THEN 'failed' WHEN c % 7 = 1 THEN 'running' ELSE 'scored' END AS st FROM cand),
b AS (SELECT a.run_id, a.version, a.q AS quality, CASE WHEN a.st = 'scored' THEN a.q - p.q END AS delta, NOT EXISTS (SELECT 1 FROM cand e WHERE e.run_id = a.run_id AND e.round < a.round AND e.q >= a.q) AS is_new_best, CASE WHEN a.st <> 'running' THEN a.st END AS eval_status
  FROM cs a LEFT JOIN cand p ON p.run_id = a.run_id AND p.version = concat('p', CAST(substr(a.version, 2) AS BIGINT) - 10))
SELECT run_id, version, quality, CAST(delta AS DOUBLE) AS delta, is_new_best, eval_status FROM b UNION ALL SELECT DISTINCT run_id, concat('unscored ', run_id), NULL, NULL, false, NULL FROM cand""")
def batch_outcomes(spark, sf_dir):
    cand = candidates(spark, sf_dir).selectExpr("*", "CASE WHEN cost % 7 = 0 THEN 'failed' WHEN cost % 7 = 1 THEN 'running' ELSE 'scored' END AS eval_status")
    variants = cand.selectExpr("run_id", "version", "concat('p', CAST(substr(version, 2) AS BIGINT) - 10) AS parent_version")
    variants = variants.unionByName(cand.select("run_id", F.concat(F.lit("unscored "), "run_id").alias("version"), F.lit(None).cast("string").alias("parent_version")).distinct())
    return c.batch_outcomes(variants, cand).withColumn("delta", F.col("delta").cast("double"))


@query(BASE_SQL + "SELECT run_id, version, q > 500 AS is_new_best FROM cand")
def batch_outcomes_above(spark, sf_dir):
    """Outcomes against a best quality that is known from before."""
    cand = candidates(spark, sf_dir)
    variants = cand.select("run_id", "version", F.lit(None).cast("string").alias("parent_version"))
    return c.batch_outcomes(variants, cand, best_ever=500).select("run_id", "version", "is_new_best")


@query(BASE_SQL + """, d AS (SELECT a.run_id, a.version, a.q - p.q AS quality_delta FROM cand a JOIN cand p ON p.run_id = a.run_id AND p.version = concat('p', CAST(substr(a.version, 2) AS BIGINT) - 10))
SELECT run_id, arg_min(version, (-quality_delta, version)) AS version, max(quality_delta) AS quality_delta FROM d GROUP BY run_id""")
def best_candidate(spark, sf_dir):
    cand = candidates(spark, sf_dir)
    variants = cand.selectExpr("run_id", "version", "concat('p', CAST(substr(version, 2) AS BIGINT) - 10) AS parent_version")
    return r.best_candidate(c.batch_outcomes(variants, cand).withColumnRenamed("delta", "quality_delta"))


@query(BASE_SQL + "SELECT route, count(*) FILTER (doc_id % 5 = 0) AS dev, count(*) FILTER (doc_id % 5 <> 0) AS holdout, count(*) AS total FROM ex GROUP BY ROLLUP (route)")
def dataset_overview(spark, sf_dir):
    return r.dataset_overview(examples(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("holdout")))


@query("""WITH d AS (SELECT l_suppkey AS run_id, l_linenumber AS round, count(*) AS evaluated, CAST(sum(l_partkey) AS BIGINT) AS cost, max(l_partkey) AS hypervolume, max(l_orderkey % 8) AS stagnation FROM lineitem GROUP BY ALL)
SELECT run_id, round, evaluated, cost, hypervolume, stagnation, CAST(hypervolume - lag(hypervolume) OVER w AS DOUBLE) AS hypervolume_change, CAST(sum(evaluated) OVER w AS BIGINT) AS total_evaluated, CAST(sum(cost) OVER w AS BIGINT) AS total_cost,
  CAST(sum(evaluated) OVER w AS BIGINT) / 60 AS budget_used, CASE WHEN stagnation >= 5 THEN 'stagnation' WHEN round >= 7 THEN 'max_rounds' ELSE 'other' END AS stop_reason FROM d WINDOW w AS (PARTITION BY run_id ORDER BY round)""")
def round_progress(spark, sf_dir):
    rounds = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("round")).agg(
        F.count("*").alias("evaluated"), F.sum("l_partkey").alias("cost"), F.max("l_partkey").alias("hypervolume"), F.max(F.expr("l_orderkey % 8")).alias("stagnation"))
    return r.round_progress(rounds, max_rounds=7).withColumn("hypervolume_change", F.col("hypervolume_change").cast("double"))


@query(MIS_SQL + "SELECT true_route, pred_route, count(*) AS n, CAST(sum(dc) AS BIGINT) / 1e6 AS cost_impact FROM mis WHERE true_route = 'simple' AND pred_route = 'complex' GROUP BY ALL")
def confusion_cell(spark, sf_dir):
    return r.confusion_cell(confusion_impact(spark, sf_dir), "simple", "complex").select("true_route", "pred_route", "n", "cost_impact")


@query(SCORE_SQL + """, b AS (SELECT run_id, round, route, max(score) AS recall, arg_max(support, (score, support)) AS support FROM sc WHERE score IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, route ORDER BY round DESC) AS k FROM b),
t AS (SELECT run_id, route, max(support) FILTER (k = 1) AS support, max(recall) FILTER (k = 1) < coalesce(max(recall) FILTER (k = 2), max(recall) FILTER (k = 1)) AS regressed FROM k GROUP BY ALL)
SELECT run_id, route, support, regressed FROM t WHERE regressed OR support >= (SELECT median(support) FROM t u WHERE u.run_id = t.run_id)""")
def regression_or_high_support(spark, sf_dir):
    rows = _scores(spark, sf_dir).where("score IS NOT NULL").withColumnRenamed("score", "recall")
    return r.regression_or_high_support(r.recall_trend(rows)).select("run_id", "route", "support", "regressed")


@query(SCORE_SQL + """, b AS (SELECT run_id, round, route, max(score) AS recall, arg_max(support, (score, support)) AS support FROM sc WHERE score IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, route ORDER BY round DESC) AS k FROM b),
t AS (SELECT run_id, route, max(support) FILTER (k = 1) AS support, max(recall) FILTER (k = 1) < coalesce(max(recall) FILTER (k = 2), max(recall) FILTER (k = 1)) AS regressed FROM k GROUP BY ALL)
SELECT run_id, route, support, row_number() OVER (PARTITION BY run_id ORDER BY support, route) AS place FROM t WHERE regressed""")
def regressions(spark, sf_dir):
    rows = _scores(spark, sf_dir).where("score IS NOT NULL").withColumnRenamed("score", "recall")
    return r.regressions(r.recall_trend(rows)).select("run_id", "route", "support", F.col("place").cast("long").alias("place"))


@query(TARGET_SQL + """, q AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE coalesce(least(ratio, 1.0), CASE WHEN met THEN 1.0 ELSE 0.0 END) END AS p FROM tp),
ts AS (SELECT version, count(*) FILTER (met) AS n_met, sum(p) AS progress, min(p) AS least FROM q GROUP BY version)
SELECT arg_min(version, (-n_met, -round(progress, 9), -least, version)) AS best FROM ts""")
def best_version(spark, sf_dir):
    met = c.targets_met(_metrics(spark, sf_dir), _targets(spark), V).withColumn("progress", F.round("progress", 9))
    return c.best_version(met, ())


@query(BASE_SQL + """, front AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.run_id = a.run_id AND b.q >= a.q AND b.c <= a.c AND (b.q > a.q OR b.c < a.c)))
SELECT a.run_id, a.version, coalesce(f.q, 0) AS quality, coalesce(f.c, 0) AS cost, f.q IS NOT NULL AS on_front FROM cand a LEFT JOIN front f USING (run_id, version) WHERE a.round % 2 = 0""")
def evaluated_versions(spark, sf_dir):
    points = candidates(spark, sf_dir)
    return c.evaluated_versions(points.where("round % 2 = 0"), pareto_front(points))


@query(CQ_SQL + """, mk AS (SELECT arg_min(baseline_quality, version) AS bq, arg_min(baseline_cost, version) AS bc, arg_min(oracle_quality_change, version) AS oq, arg_min(oracle_cost_change, version) AS oc FROM cq)
SELECT 'target' AS mark, 0.8::DOUBLE AS quality_delta, 0.0::DOUBLE AS cost_delta, round(bq * 1.8::DOUBLE, 6) AS quality_abs, round(bc, 6) AS cost_abs FROM mk
UNION ALL SELECT 'oracle', round(oq, 6), round(oc, 6), round(bq * (1 + oq), 6), round(bc * (1 + oc), 6) FROM mk""")
def absolute_marks(spark, sf_dir):
    return marks_of(m.cost_quality_change(pairs(spark, sf_dir), V), _targets(spark), ())


@query(CQ_SQL + "SELECT version, round(quality_change, 4) AS quality_delta, round(cost_change_with_overhead, 4) AS cost_delta, round(predicted_quality, 4) AS quality_abs, round(predicted_cost + routing_overhead, 4) AS cost_abs FROM cq")
def candidate_points(spark, sf_dir):
    wide = m.cost_quality_change(pairs(spark, sf_dir), V)
    stored = wide.select("version", F.lit(0.0).alias("quality"), F.lit(0.0).alias("cost"))
    return points_of(stored, wide, ())
