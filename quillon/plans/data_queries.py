"""Queries of ingest, mapping, data-quality checks, splits and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import identity as d
from quillon.operators import mapping as p
from quillon.operators import quality_checks as q
from quillon.plans.fixtures import BASE_SQL, candidates, examples, results
from quillon.sources import files
from quillon.sources.shared import kept, shared_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ID = "CASE doc_id % 23 WHEN 1 THEN '' WHEN 2 THEN concat('\"id\": ', doc_id, ', ') WHEN 13 THEN '\"id\": \"dup\", ' ELSE concat('\"id\": \"d', doc_id, '\", ') END"
_INPUT = "CASE doc_id % 23 WHEN 3 THEN '\"input\": null, ' WHEN 4 THEN '\"input\": 7, ' ELSE '\"input\": \"text\", ' END"
_ENTRY = "concat('{\"cost\": ', CASE doc_id % 23 WHEN 9 THEN '\"0.2\"' ELSE '0.5' END, ', \"quality_score\": ', CASE doc_id % 23 WHEN 10 THEN 'null' ELSE '1' END, CASE doc_id % 23 WHEN 11 THEN ', \"note\": \"x\"' ELSE '' END, '}')"
_ROUTES = f"CASE doc_id % 23 WHEN 8 THEN '{{}}' WHEN 12 THEN concat('{{\"simple\": ', {_ENTRY}, ', \"extra\": ', {_ENTRY}, '}}') ELSE concat('{{\"simple\": ', {_ENTRY}, ', \"complex\": ', {_ENTRY}, '}}') END"
_EXPECTED = f"CASE doc_id % 23 WHEN 5 THEN '\"simple\"' WHEN 6 THEN concat('{{\"routes\": ', {_ROUTES}, '}}') ELSE concat('{{\"route\": \"', CASE doc_id % 23 WHEN 7 THEN 'other' ELSE 'simple' END, '\", \"routes\": ', {_ROUTES}, '}}') END"


def raw_rows(spark, sf_dir):
    """row_idx, v: documents as raw rows; one in twenty-three has each kind of fault."""
    text = f"concat('{{', {_ID}, {_INPUT}, '\"expected\": ', {_EXPECTED}, '}}')"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS row_idx", f"try_parse_json({text}) AS v")


def _violations(spark, sf_dir):
    rows = raw_rows(spark, sf_dir)
    return q.violations(rows, checked=kept(q.row_checks(rows), "checked"))


VIOLATION_SQL = """WITH r AS (SELECT doc_id, doc_id % 23 AS m, CASE WHEN doc_id % 23 IN (1, 2) THEN NULL WHEN doc_id % 23 = 13 THEN 'dup' ELSE concat('d', doc_id) END AS id FROM documents),
f AS (SELECT 'required_keys' AS "check", doc_id, id FROM r WHERE m IN (1, 3, 5, 6) UNION ALL SELECT 'types', doc_id, id FROM r WHERE m IN (2, 4, 5, 9) UNION ALL SELECT 'route_in_routes', doc_id, id FROM r WHERE m = 7
  UNION ALL SELECT 'non_empty_routes', doc_id, id FROM r WHERE m = 8 UNION ALL SELECT 'consistent_model_set', doc_id, id FROM r WHERE m = 12 UNION ALL SELECT 'null_fields', doc_id, id FROM r WHERE m = 10
  UNION ALL SELECT 'canonical_route_fields', doc_id, id FROM r WHERE m = 11 UNION ALL SELECT 'unique_ids', doc_id, id FROM r WHERE m = 13 AND doc_id > (SELECT min(doc_id) FROM r WHERE m = 13))
"""


@query(VIOLATION_SQL + """SELECT "check", doc_id AS row_idx, id FROM f""")
def schema_violations(spark, sf_dir):
    return _violations(spark, sf_dir)


@query(VIOLATION_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY doc_id) AS k FROM f), c AS (SELECT * FROM (VALUES ('required_keys', 'critical'), ('types', 'critical'), ('route_in_routes', 'critical'), ('non_empty_routes', 'warning'),
  ('consistent_model_set', 'critical'), ('unique_ids', 'critical'), ('null_fields', 'warning'), ('canonical_route_fields', 'critical')) AS t(name, severity))
SELECT name AS "check", severity, CASE WHEN count(doc_id) > 0 THEN 'fail' ELSE 'pass' END AS status, count(doc_id) AS n_violations, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 5), '') AS samples
FROM c LEFT JOIN k ON k."check" = name GROUP BY ALL""")
def schema_findings(spark, sf_dir):
    out = q.findings(_violations(spark, sf_dir))
    return out.withColumn("samples", F.array_join(F.col("sample_row_indices").cast("array<string>"), ",")).drop("sample_row_indices")


@query(VIOLATION_SQL + """, c AS (SELECT * FROM (VALUES ('required_keys', 'fail'), ('types', 'fail'), ('route_in_routes', 'fail'), ('non_empty_routes', 'warning'), ('consistent_model_set', 'fail'), ('unique_ids', 'fail'), ('null_fields', 'warning'), ('canonical_route_fields', 'fail')) AS t(name, bad)),
cn AS (SELECT name, bad, count(doc_id) AS n FROM c LEFT JOIN f ON f."check" = name GROUP BY ALL), e AS (SELECT lang AS route, text FROM documents), g AS (SELECT route, count(*) AS n, count(*) / (SELECT count(*) FROM e) AS s FROM e GROUP BY route),
l AS (SELECT min(length(text)) AS a, max(length(text)) AS b, CAST(sum(length(text)) AS BIGINT) / count(*) AS c, quantile_cont(length(text), 0.95) AS d, count(*) AS n FROM e WHERE text IS NOT NULL)
SELECT 'check' AS section, name, CASE WHEN n > 0 THEN bad ELSE 'pass' END AS status, CAST(n AS DOUBLE) AS value FROM cn UNION ALL SELECT 'distribution', route, CASE WHEN s < 0.2 THEN 'warning' ELSE 'pass' END, s FROM g
UNION ALL SELECT 'volume', route, CASE WHEN n >= 60 THEN 'pass' ELSE 'warning' END, n FROM g UNION ALL SELECT 'volume', 'xx', 'warning', 0
UNION ALL SELECT 'length', unnest(['shortest', 'longest', 'mean', 'p95', 'n']), NULL, round(unnest([a, b, c, d, n]), 6) FROM l UNION ALL SELECT 'gate', 'critical', CASE WHEN (SELECT sum(n) FROM cn WHERE bad = 'fail') > 0 THEN 'fail' ELSE 'pass' END, NULL""")
def quality_report(spark, sf_dir):
    ex = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("route"), F.col("text").alias("input"))
    out = q.quality_report(_violations(spark, sf_dir), ex, ["en", "es", "de", "fr", "xx"], 0.2, 60)
    return out.withColumn("value", F.when(F.col("section") == "length", F.round("value", 6)).otherwise(F.col("value")))


@query("SELECT count(*) FILTER (doc_id % 23 IN (1, 2, 3, 4, 5, 6, 7, 9, 11, 12)) = 0 AS passed FROM documents")
def quality_gate(spark, sf_dir):
    return q.passes(_violations(spark, sf_dir))


_NAMES_SQL = """, n AS (SELECT unnest(CASE WHEN doc_id % 23 IN (8, 5, 6) THEN [] WHEN doc_id % 23 = 12 THEN ['simple', 'extra'] ELSE ['simple', 'complex'] END) AS r FROM documents)"""


@query("WITH x AS (SELECT 1)" + _NAMES_SQL + """, g AS (SELECT unnest(['simple', 'complex', 'fast']) AS g)
SELECT DISTINCT coalesce(r, g) AS route, CASE WHEN g IS NULL THEN 'only in rows' ELSE 'only in names' END AS place FROM n FULL JOIN g ON r = g WHERE r IS NULL OR g IS NULL""")
def route_key_union(spark, sf_dir):
    return q.route_key_union(raw_rows(spark, sf_dir), ["simple", "complex", "fast"])


@query(BASE_SQL + "SELECT route, count(*) AS n, count(*) / (SELECT count(*) FROM ex) AS share, count(*) / (SELECT count(*) FROM ex) < 0.3 AS imbalanced FROM ex GROUP BY route")
def label_distribution(spark, sf_dir):
    return q.label_distribution(examples(spark, sf_dir), 0.3)


@query(BASE_SQL + """, n AS (SELECT r AS route, (SELECT count(*) FROM ex WHERE route = r AND lang <> 'en') AS n FROM (VALUES ('simple'), ('moderate'), ('complex'), ('none')) AS t(r))
SELECT route, n, n >= 50 AS adequate, n = 0 AS absent, (SELECT bool_and(n >= 50) FROM n) AS all_adequate FROM n""")
def volume_adequacy(spark, sf_dir):
    return q.volume_adequacy(examples(spark, sf_dir).where("lang <> 'en'"), ["simple", "moderate", "complex", "none"], 50)


@query("SELECT min(length(text)) AS shortest, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) / count(*) AS mean, round(quantile_cont(length(text), 0.95), 6) AS p95, count(*) AS n FROM documents WHERE text IS NOT NULL")
def query_length_stats(spark, sf_dir):
    return q.query_length_stats(examples(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")}).withColumn("p95", F.round("p95", 6))


@query("""WITH m AS (SELECT DISTINCT doc_id % 23 AS m FROM documents), e AS (SELECT m, unnest(CASE WHEN m IN (5, 8) THEN [] WHEN m = 12 THEN ['simple', 'extra'] ELSE ['simple', 'complex'] END) AS r FROM m)
SELECT 'expected' AS path FROM m UNION SELECT 'id' FROM m WHERE m <> 1 UNION SELECT 'input' FROM m UNION SELECT 'expected.route' FROM m WHERE m NOT IN (5, 6) UNION SELECT 'expected.routes' FROM m WHERE m <> 5
UNION SELECT concat('expected.routes.', r) FROM e UNION SELECT concat('expected.routes.', r, unnest(CASE WHEN m = 11 THEN ['.cost', '.quality_score', '.note'] ELSE ['.cost', '.quality_score'] END)) FROM e""")
def nested_paths(spark, sf_dir):
    return files.nested_paths(raw_rows(spark, sf_dir))


LINES_SQL = r"""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line, CASE doc_id % 17 WHEN 3 THEN '' WHEN 4 THEN '{"a": ' WHEN 5 THEN '[1]' WHEN 6 THEN '{"__meta__": "x"}' ELSE concat('{"a": ', doc_id, ', "b": {"c,d": "', lang, '"}}') END AS value FROM documents),
k AS (SELECT *, doc_id % 17 IN (4, 5) AS bad, doc_id % 17 = 6 AS meta FROM l WHERE value <> '')
"""


def _lines(spark, sf_dir):
    """A folder of JSON lines by doc_id, some blank, some broken; and its path."""
    value = "CASE doc_id % 17 WHEN 3 THEN '' WHEN 4 THEN '{\"a\": ' WHEN 5 THEN '[1]' WHEN 6 THEN '{\"__meta__\": \"x\"}' ELSE concat('{\"a\": ', doc_id, ', \"b\": {\"c,d\": \"', lang, '\"}}') END AS value"
    path = shared_path(spark, "lines")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", value).orderBy("doc_id").select("value").write.text(path)
    return path


@query(LINES_SQL + """SELECT line AS row_idx, CASE WHEN meta THEN NULL ELSE doc_id END AS a FROM k WHERE NOT bad""")
def jsonl_rows(spark, sf_dir):
    good, _ = files.read_jsonl(spark, _lines(spark, sf_dir))
    return good.select("row_idx", F.try_variant_get("v", "$.a", "bigint").alias("a"))


@query(LINES_SQL + """SELECT line + 1 AS line FROM k WHERE bad""")
def jsonl_bad_lines(spark, sf_dir):
    return files.read_jsonl(spark, _lines(spark, sf_dir))[1]


@query(LINES_SQL + """SELECT line AS row_idx, doc_id AS a FROM k WHERE NOT bad AND NOT meta""")
def jsonl_results_mode(spark, sf_dir):
    good, _ = files.read_jsonl(spark, _lines(spark, sf_dir), "results")
    return good.select("row_idx", F.try_variant_get("v", "$.a", "bigint").alias("a"))


@query(LINES_SQL + """SELECT concat('line ', min(line) + 1, ' is not a JSON object') AS message FROM k WHERE bad""")
def jsonl_strict_error(spark, sf_dir):
    try:
        files.read_jsonl(spark, _lines(spark, sf_dir), "strict")
    except ValueError as e:
        return spark.range(1).select(F.lit(str(e)).alias("message"))
    return spark.range(0).select(F.lit("").alias("message"))


@query(LINES_SQL + """, g AS (SELECT * FROM k WHERE NOT bad), f AS (SELECT * FROM g ORDER BY line LIMIT 5), m AS (SELECT arg_min(meta, line) AS meta, count(*) AS n FROM g), w AS (SELECT line + 1 AS line FROM k WHERE bad)
SELECT n AS n_rows, CASE WHEN meta THEN '__meta__' ELSE 'a|b' END AS first_columns, concat((SELECT CASE WHEN bool_or(meta) THEN '__meta__|' ELSE '' END FROM g), 'a|b') AS all_columns,
  (SELECT string_agg(replace(value, ': ', ':'), '|' ORDER BY line) FROM (SELECT line, replace(value, ', "', ',"') AS value FROM f)) AS sample_rows, (SELECT count(*) FROM w) AS n_skipped,
  (SELECT string_agg(CAST(line AS VARCHAR), '|' ORDER BY line) FROM (SELECT * FROM w ORDER BY line LIMIT 20)) AS skipped_lines FROM m""")
def source_profile(spark, sf_dir):
    rows, bad = files.read_jsonl(spark, _lines(spark, sf_dir))
    return files.profile_rows(rows, bad).withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("first_columns", "all_columns", "sample_rows", "skipped_lines")})


@query("""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id FROM documents""")
def row_index(spark, sf_dir):
    path = shared_path(spark, "ordered")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("value")).orderBy(F.col("value").cast("long")).write.text(path)
    return files.numbered_lines(spark, path).select(F.col("line").alias("row_idx"), F.col("value").cast("long").alias("doc_id"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS k, concat('x "', p_name, '",', chr(10), p_size) AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 5 <> 0""")
def csv_rows(spark, sf_dir):
    blank = "IF(p_partkey % 5 = 0, NULL, {})"
    path = shared_path(spark, "csv")
    spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        blank.format("CAST(p_partkey AS STRING)") + " AS k", blank.format("concat('x \"', p_name, '\",\n', p_size)") + " AS name", "IF(p_partkey % 4 = 0 OR p_partkey % 5 = 0, NULL, CAST(p_size AS STRING)) AS size",
    ).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv_rows(spark, path)


@query("""SELECT p_partkey // 200 AS g, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) - 1 AS row_idx, p_partkey AS k, p_name AS name FROM part""")
def json_array_rows(spark, sf_dir):
    path = shared_path(spark, "arrays")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.expr("p_partkey div 200")).alias("g"), F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.expr("p_partkey div 200").alias("g")).alias("o"))
    arrays = rows.groupBy("g").agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("value"))  # 200 rows a file
    arrays.write.partitionBy("g").text(path)
    v = files.read_json_array(spark, f"{path}/g=*/*.txt")
    return v.select(F.variant_get("v", "$.g", "bigint").alias("g"), "row_idx", F.variant_get("v", "$.k", "bigint").alias("k"), F.variant_get("v", "$.name", "string").alias("name"))


def _written_results(spark, sf_dir):
    """A folder of result files, one folder a version, each with a header line; some lines are broken."""
    path = shared_path(spark, "eval")
    r = results(spark, sf_dir).select("version", "doc_id", "example_id", "model", "output", "error", "retries", "cost").where("doc_id % 29 <> 0")
    for v in range(1, 7):
        files.write_results(r.where(F.col("version") == f"v{v}").drop("version", "doc_id"), f"{path}/v{v}", {"prompt_version": f"v{v}", "backend": "echo", "data_source": "documents"})
    spark.range(1, 7).select(F.concat(F.lit("v"), "id").alias("version"), F.lit('{"example_id": "broken').alias("value")).write.mode("append").partitionBy("version").text(f"{path}/broken")
    return path


@query(BASE_SQL + "SELECT version, id AS example_id, pred, CASE WHEN err THEN 'timeout' END AS error, spent / 1e6 AS cost FROM res WHERE doc_id % 29 <> 0")
def results_round_trip(spark, sf_dir):
    return files.read_results(spark, f"{_written_results(spark, sf_dir)}/v*/*.txt").select("version", "example_id", F.col("output.route").alias("pred"), "error", "cost")


@query("SELECT concat('v', v) AS version, concat('v', v) AS prompt_version, 'echo' AS backend, 'documents' AS data_source FROM generate_series(1, 6) AS t(v)")
def results_fingerprints(spark, sf_dir):
    return files.read_fingerprints(spark, f"{_written_results(spark, sf_dir)}/v*/*.txt")


_REPORTS_SQL = BASE_SQL + """, r AS (SELECT round, concat('r', run_id, '-', round) AS version, run_id, unnest([concat(version, '/quality'), concat(version, '/cost')]) AS key, CAST(unnest([q, c]) AS DOUBLE) AS value FROM cand)
"""


def _written_reports(spark, sf_dir):
    """One report file a run and round, with the figures of all its candidates; runs 3 and 4 have none that count."""
    path = shared_path(spark, "reports")
    c = candidates(spark, sf_dir).withColumns({"name": F.col("version"), "version": F.concat(F.lit("r"), "run_id", F.lit("-"), "round")})
    figures = c.select("run_id", "version", F.inline(F.array(*[F.struct(F.concat("name", F.lit(f"/{k}")).alias("key"), F.col(k).alias("value")) for k in ("quality", "cost")])))
    by_version = figures.groupBy("run_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    metrics = F.when(F.col("run_id") == 4, F.create_map().cast("map<string, bigint>")).otherwise(F.col("m"))
    by_version.select("version", F.to_json(F.struct(metrics.alias("metrics"), F.struct(F.when(F.col("run_id") == 3, 0).otherwise(5).alias("succeeded")).alias("summary"))).alias("value")).repartition(8, "version").write.partitionBy("version").text(path)
    return path


@query(_REPORTS_SQL + "SELECT version, key, value FROM r WHERE run_id NOT IN (3, 4)")
def reports_long(spark, sf_dir):
    rows = files.read_reports_long(spark, f"{_written_reports(spark, sf_dir)}/version=*/*.txt")
    return rows.withColumn("version", F.regexp_replace("version", "^version=", ""))


@query(_REPORTS_SQL + "SELECT DISTINCT round, version, CASE WHEN run_id NOT IN (3, 4) THEN key END AS key, CASE WHEN run_id NOT IN (3, 4) THEN value END AS value FROM r")
def reports_by_round(spark, sf_dir):
    rows = files.read_reports_long(spark, f"{_written_reports(spark, sf_dir)}/version=*/*.txt").withColumn("version", F.regexp_replace("version", "^version=", ""))
    named = F.concat(F.lit("r"), "run_id", F.lit("-"), "round")
    rounds = candidates(spark, sf_dir).groupBy("run_id", "round").agg(F.collect_set(named).alias("candidates_evaluated"))
    return files.reports_by_round(rows, rounds)


@query("""SELECT concat('d', n_nationkey) AS version, CASE WHEN n_nationkey % 2 = 0 THEN concat('md ', n_name) ELSE concat('txt ', n_name) END AS text FROM nation""")
def prompt_corpus(spark, sf_dir):
    """A file a nation, some with two extensions, each written by a task."""
    path = shared_path(spark, "prompts")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nations.select(F.concat(F.lit("d"), "n_nationkey").alias("d"), F.explode(F.expr("IF(n_nationkey % 2 = 0, array('txt', 'md'), array('txt'))")).alias("e"), "n_name")
    files_of = rows.select(F.concat("d", F.lit("."), "e").alias("file"), F.concat("e", F.lit(" "), "n_name").alias("value"))
    files_of.repartition("file").write.partitionBy("file").option("lineSep", " ").text(path)
    return files.prompt_corpus(spark, path).select("version", F.rtrim("text").alias("text"))


@query(BASE_SQL + "SELECT doc_id AS row_idx, id FROM ex WHERE doc_id % 19 = 0")
def route_guard(spark, sf_dir):
    ex = examples(spark, sf_dir).select(F.col("doc_id").alias("row_idx"), "id", F.expr("CASE doc_id % 19 WHEN 0 THEN 'nowhere' ELSE route END").alias("route"), "routes")
    return p.route_not_in_routes(ex).select("row_idx", "id")


@query(BASE_SQL + "SELECT concat(count(*), ' rows have a route that isn''t among their routes, such as ', (SELECT string_agg(id, ', ' ORDER BY doc_id) FROM (SELECT id, doc_id FROM ex WHERE doc_id % 19 = 0 ORDER BY doc_id LIMIT 3))) AS message FROM ex WHERE doc_id % 19 = 0")
def route_guard_error(spark, sf_dir):
    ex = examples(spark, sf_dir).select(F.col("doc_id").alias("row_idx"), "id", F.expr("CASE doc_id % 19 WHEN 0 THEN 'nowhere' ELSE route END").alias("route"), "routes")
    try:
        p.assert_route_in_routes(ex)
    except ValueError as e:
        return spark.range(1).select(F.lit(str(e)).alias("message"))
    return spark.range(0).select(F.lit("").alias("message"))


@query("""SELECT p_partkey AS row_idx, concat('row-', p_partkey) AS id, p_name AS input, 'a' AS route, p_partkey % 7 / 4 AS cost_a, CAST(p_size AS DOUBLE) AS quality_a, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS cost_b FROM part""")
def mapped_examples(spark, sf_dir):
    flat = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS row_idx", "try_parse_json(to_json(struct(p_name AS q, 'a' AS best, cast(p_partkey % 7 / 4 AS string) AS a_cost, cast(p_size AS string) AS a_quality, IF(p_partkey % 5 = 0, '1e5', '0.5') AS b_cost))) AS v")
    m = p.apply_mapping(flat, {"q": "input", "best": "expected.route", "a_cost": "expected.routes.a.cost", "a_quality": "expected.routes.a.quality_score", "b_cost": "expected.routes.b.cost"})
    return m.select("row_idx", "id", "input", "route", F.col("routes")["a"]["cost"].alias("cost_a"), F.col("routes")["a"]["quality_score"].alias("quality_a"), F.col("routes")["b"]["cost"].alias("cost_b"))


def _dealt(spark, sf_dir, table, *keys):
    """A table over all cores by its keys, which needs no sort: its file is small, or of few row groups, for the work that a mapping does on a row."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), *keys)


@query("""SELECT p_partkey AS row_idx, r AS route, CAST(p_size AS DOUBLE) AS cost, p_partkey % 3 / 2 AS quality_score FROM part, (VALUES ('m0'), ('m1')) AS t(r)""")
def mapped_wildcards(spark, sf_dir):
    nested = _dealt(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey AS row_idx", "try_parse_json(to_json(struct(p_name AS q, 'm0' AS best, map('m0', struct(p_size AS price, p_partkey % 3 / 2 AS score), 'm1', struct(p_size AS price, p_partkey % 3 / 2 AS score)) AS models))) AS v")
    m = p.apply_mapping(nested, {"q": "input", "best": "expected.route", "models.*.price": "expected.routes.*.cost", "models.*.score": "expected.routes.*.quality_score"})
    return m.select("row_idx", F.explode("routes").alias("route", "r")).select("row_idx", "route", "r.cost", "r.quality_score")


@query("""WITH p AS (SELECT *, p_partkey AS row_idx FROM part), r AS (
SELECT row_idx, 'm0' AS route, CAST(p_size AS DOUBLE) AS cost, CAST(p_size % 7 / 8 AS DOUBLE) AS quality_score FROM p UNION ALL
SELECT row_idx, 'm1', CASE WHEN row_idx % 3 = 0 THEN NULL ELSE p_size / 4 END, 0.5 FROM p UNION ALL
SELECT row_idx, 'only cost', 0.25, NULL FROM p WHERE row_idx % 3 = 0 UNION ALL
SELECT row_idx, 'fixed', 7.5, CASE WHEN row_idx % 4 = 0 THEN 1.5 END FROM p)
SELECT row_idx, concat('row-', row_idx) AS id, 'm0' AS best, route, cost, quality_score FROM r""")
def mapped_two_objects(spark, sf_dir):
    """Costs in one object, scores in another, with different keys, and one route by a path without a star; some costs are strings."""
    raw = _dealt(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey AS row_idx", """try_parse_json(concat('{"q": "x", "best": "m0", "costs": {"m0": "', p_size, '", ', IF(p_partkey % 3 = 0, '"only cost": "0.25"', concat('"m1": ', p_size / 4)),
      '}, "scores": {"m0": ', p_size % 7 / 8, ', "m1": 0.5}, "price": "7.5"', IF(p_partkey % 4 = 0, ', "extra": {"fixed": 1.5}', ''), '}')) AS v""")
    m = p.apply_mapping(raw, {"q": "input", "best": "expected.route", "costs.*": "expected.routes.*.cost", "scores.*": "expected.routes.*.quality_score", "price": "expected.routes.fixed.cost", "extra.*": "expected.routes.*.quality_score"})
    return m.select("row_idx", "id", F.col("route").alias("best"), F.explode("routes").alias("route", "r")).select("row_idx", "id", "best", "route", "r.cost", "r.quality_score")


@query("""SELECT l_orderkey * 8 + l_linenumber AS row_idx, 'STRING' AS kind, concat('r', l_returnflag) AS a, concat('s', l_linestatus) AS b, concat('x.', l_returnflag) AS label, CAST(l_partkey AS BIGINT) AS n, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey / 2 END AS more FROM lineitem""")
def mapped_two_stars(spark, sf_dir):
    """Two stars in one path, turned round in no target, joined with another source of two stars by both keys; strings that don't read as numbers stay."""
    raw = _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").selectExpr("l_orderkey * 8 + l_linenumber AS row_idx", """try_parse_json(concat('{"q": "7", "flags": {"r', l_returnflag, '": {"states": {"s', l_linestatus, '": {"part": "', l_partkey, '", "label": "x.', l_returnflag, '"}}}}, "others": {"r', l_returnflag,
      '": {"s', l_linestatus, '": ', IF(l_suppkey % 3 = 0, concat('"', l_suppkey / 2, '"'), '[]'), '}}, "one": "a", "two": {"a": {"z": 1}}}')) AS v""")
    docs = p.mapped_documents(raw, {"q": "input", "flags.*.states.*.part": "meta.by.*.*.n", "flags.*.states.*.label": "meta.by.*.*.label", "others.*.*": "meta.by.*.*.more", "one": "expected.route", "two": "expected.routes", "q ": "nowhere"})
    by = F.explode(F.try_variant_get("doc", "$.meta.by", "map<string, map<string, struct<label: string, n: bigint, more: double>>>")).alias("a", "x")
    flat = docs.select("row_idx", F.schema_of_variant(F.try_variant_get("doc", "$.input", "variant")).alias("kind"), by)
    return flat.select("row_idx", "kind", "a", F.explode("x").alias("b", "y")).select("row_idx", "kind", "a", "b", "y.label", "y.n", "y.more")


@query("""WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN '1e5' WHEN 3 THEN 'many' ELSE concat(' -', p_size, ' ') END AS s FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN CAST(trim(s) AS DOUBLE) WHEN 1 THEN CAST(s AS DOUBLE) WHEN 4 THEN CAST(trim(s) AS DOUBLE) END AS x FROM s""")
def coerced_numeric(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN '1e5' WHEN 3 THEN 'many' ELSE concat(' -', p_size, ' ') END AS s")
    return rows.select("k", p.coerce_numeric(F.col("s")).alias("x"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) > 300 THEN concat(substr(f, 1, 297), '...') ELSE f END AS excerpt FROM t""")
def excerpt(spark, sf_dir):
    return examples(spark, sf_dir).select("doc_id", p.excerpt(F.col("input")).alias("excerpt"))


@query(BASE_SQL + "SELECT id, route FROM ex WHERE route = 'moderate' ORDER BY doc_id LIMIT 20 OFFSET 15")
def query_examples_page(spark, sf_dir):
    return p.query_examples(examples(spark, sf_dir).withColumn("row_idx", F.col("doc_id")), route="moderate", offset=15, limit=20).select("id", "route")


EVAL_SQL = BASE_SQL + r""", shown AS (SELECT *, trim(regexp_replace(coalesce(input, ''), '\s+', ' ', 'g')) AS f FROM pairs WHERE pred IS NOT NULL)
SELECT version, id AS example_id, CASE WHEN length(f) > 300 THEN concat(substr(f, 1, 297), '...') ELSE f END AS input, route, pred, spent / 1e6 AS cost, CASE pred WHEN 'simple' THEN qs WHEN 'moderate' THEN qm WHEN 'complex' THEN qc END / 1e3 AS pred_quality FROM shown WHERE """


@query(EVAL_SQL + "pred <> route ORDER BY version, id LIMIT 50")
def query_eval_misroutes(spark, sf_dir):
    return p.query_eval_results(results(spark, sf_dir), examples(spark, sf_dir), misroutes_only=True)


@query(EVAL_SQL + "route = 'simple' AND pred = 'moderate' ORDER BY version, id LIMIT 20")
def query_eval_pair(spark, sf_dir):
    return p.query_eval_results(results(spark, sf_dir), examples(spark, sf_dir), pair=("simple", "moderate"), misroutes_only=True, limit=20)


@query(EVAL_SQL + "id IN ('d3', 'd5', 'd8') ORDER BY version, id LIMIT 50")
def query_eval_ids(spark, sf_dir):
    return p.query_eval_results(results(spark, sf_dir), examples(spark, sf_dir), ids=["d3", "d5", "d8"], pair=("simple", "moderate"))


@query(BASE_SQL + "SELECT id, route FROM ex WHERE id IN ('d2', 'd7', 'd11') ORDER BY doc_id LIMIT 2")
def query_examples_ids(spark, sf_dir):
    return p.query_examples(examples(spark, sf_dir).withColumn("row_idx", F.col("doc_id")), ids=["d2", "d7", "d11"], route="none", limit=2).select("id", "route")


@query(r"""WITH b AS (SELECT sha256(concat(id, chr(9), input, chr(9), route)) AS h FROM (""" + BASE_SQL + r"""SELECT id, coalesce(input, '') AS input, route FROM ex)),
g AS (SELECT substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM b GROUP BY 1), k AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY b, h)) AS h FROM g GROUP BY 1)
SELECT substr(sha256(string_agg(h, '' ORDER BY b, h)), 1, 16) AS fingerprint FROM k""")
def fingerprint(spark, sf_dir):
    return d.dataset_fingerprint(examples(spark, sf_dir))


SPLIT_SQL = BASE_SQL + """, k AS (SELECT id, route, row_number() OVER (PARTITION BY route ORDER BY sha256(concat('s', id)), id) AS k, count(*) OVER (PARTITION BY route) AS n FROM ex),
sp AS (SELECT id, route, CASE WHEN n >= 2 AND k <= round_even(n * (1 - 0.2::DOUBLE), 0) THEN 'holdout' ELSE 'dev' END AS split FROM k)
"""


@query(SPLIT_SQL + "SELECT * FROM sp")
def split_membership(spark, sf_dir):
    return d.stratified_split(examples(spark, sf_dir), seed="s").select("id", "route", "split")


@query(SPLIT_SQL + "SELECT route, count(*) AS total, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'holdout') AS holdout, count(*) FILTER (split = 'dev') / count(*) AS dev_share, count(*) = 1 AS singleton FROM sp GROUP BY route")
def split_report(spark, sf_dir):
    return d.split_report(d.stratified_split(examples(spark, sf_dir), seed="s"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN concat('row-', (doc_id * 31) % 400) WHEN doc_id % 11 = 2 THEN concat('row-00', doc_id) ELSE concat('d', doc_id) END AS id FROM documents),
u AS (SELECT DISTINCT CAST(substr(id, 5) AS BIGINT) AS n FROM r WHERE regexp_full_match(id, 'row-(0|[1-9][0-9]*)')),
f AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM generate_series(1, (SELECT count(*) + 1000 FROM documents)) AS t(n) WHERE n NOT IN (SELECT n FROM u)), m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM r WHERE id IS NULL)
SELECT doc_id, coalesce(id, concat('row-', n)) AS id, id IS NULL AS added FROM r LEFT JOIN m USING (doc_id) LEFT JOIN f USING (k)""")
def add_missing_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "doc_id AS row_idx", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN concat('row-', (doc_id * 31) % 400) WHEN doc_id % 11 = 2 THEN concat('row-00', doc_id) ELSE concat('d', doc_id) END AS id")
    return d.add_missing_ids(rows).select("doc_id", "id", "added")


@query(BASE_SQL + """, h AS (SELECT id, doc_id FROM ex WHERE doc_id % 5 = 0), v AS (SELECT * FROM (VALUES (1), (2), (3)) AS t(v))
SELECT concat('v', v) AS version, id FROM h, v WHERE NOT (doc_id % (10 * v) = 0)""")
def holdout_filtered(spark, sf_dir):
    ex = examples(spark, sf_dir).select("id", "doc_id")
    shown = ex.withColumn("v", F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)]))).where("doc_id % (10 * v) = 0").select(F.concat(F.lit("v"), "v").alias("version"), "id")
    return d.filter_holdout(ex.where("doc_id % 5 = 0"), shown)


@query(BASE_SQL + """, d AS (SELECT v, id FROM res WHERE NOT err AND doc_id % 29 <> 0 AND v IN (2, 3))
SELECT concat('v', x.v) AS version, ex.id FROM ex, (VALUES (2), (3)) AS x(v) WHERE x.v = 3 OR NOT EXISTS (SELECT 1 FROM d WHERE d.v = x.v AND d.id = ex.id)""")
def remaining_examples(spark, sf_dir):
    """Version 2 goes on with its earlier run, version 3 was run with another backend and starts over."""
    path = _written_results(spark, sf_dir)
    earlier, heads = files.read_results(spark, f"{path}/v*/*.txt"), files.read_fingerprints(spark, f"{path}/v*/*.txt")
    ex, out = examples(spark, sf_dir).select("id"), None
    for v, backend in (("v2", "echo"), ("v3", "other")):
        current = spark.createDataFrame([(v, backend, "documents")], "prompt_version string, backend string, data_source string")
        left = d.remaining_examples(ex, earlier.where(F.col("version") == v), heads.where(F.col("version") == v), current).select(F.lit(v).alias("version"), "id")
        out = left if out is None else out.unionByName(left)
    return out


@query(BASE_SQL + "SELECT id AS example_id, CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS source, coalesce(pred, '') AS pred FROM res WHERE v = CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END")
def latest_results(spark, sf_dir):
    r = results(spark, sf_dir).select("example_id", F.col("version").alias("source"), F.coalesce("output.route", F.lit("")).alias("pred"), "doc_id")
    earlier, later = r.where("source = 'v1'"), r.where("source = 'v2' AND doc_id % 2 = 0")
    return d.latest_results(earlier.drop("doc_id"), later.drop("doc_id"), ("example_id",))


_MERGE = "CASE WHEN pk % 5 = 0 THEN 'elite' WHEN pk % 3 = 0 AND pk % 7 <> 0 THEN 'archive' WHEN pk % 2 = 0 THEN 'pending' ELSE 'reports' END"


@query(BASE_SQL + f""", m AS (SELECT *, CAST(substr(version, 2) AS BIGINT) AS pk FROM cand)
SELECT run_id, version, CASE WHEN {_MERGE} = 'reports' THEN NULL ELSE concat('p', pk - 10) END AS parent_version, q + CASE {_MERGE} WHEN 'elite' THEN 0 WHEN 'archive' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END AS quality, c AS cost, {_MERGE} AS source FROM m""")
def merged_candidates(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("pk", F.substring("version", 2, 20).cast("long")).withColumn("parent_version", F.concat(F.lit("p"), F.col("pk") - 10))
    part = lambda i, test, parent=True: c.where(test).withColumn("quality", F.col("quality") + i).withColumn("parent_version", F.col("parent_version") if parent else F.lit(None).cast("string"))
    return d.merge_candidates([("elite", part(0, "pk % 5 = 0")), ("archive", part(1, "pk % 3 = 0").withColumn("eval_status", F.expr("CASE WHEN pk % 7 = 0 THEN 'failed' WHEN pk % 7 = 1 THEN 'complete' WHEN pk % 7 = 2 THEN 'scored' END"))), ("pending", part(2, "pk % 2 = 0")), ("reports", part(3, "true", False))])


@query(BASE_SQL + """SELECT run_id, version FROM cand WHERE round <= 6""")
def appended_archive(spark, sf_dir):
    c = candidates(spark, sf_dir).select("run_id", "version", "round")
    return d.append_archive(c.where("round <= 4").drop("round"), c.where("round BETWEEN 3 AND 6").drop("round"))


@query(BASE_SQL + """, u AS (SELECT id, unnest(['complex', 'moderate', 'simple']) AS route, unnest([qc / 1e3 - 0.8::DOUBLE * (cc / 1e6), qm / 1e3 - 0.8::DOUBLE * (cm / 1e6), qs / 1e3 - 0.8::DOUBLE * (cs / 1e6)]) AS u FROM ex),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY u DESC, route) AS k FROM u), t AS (SELECT id, max(route) FILTER (k = 1) AS selected, max(u) FILTER (k = 1) - max(u) FILTER (k = 2) AS gap FROM k GROUP BY id),
c AS (SELECT quantile_cont(gap, 1 / 3) AS a, quantile_cont(gap, 2 / 3) AS b FROM t)
SELECT id, selected, round(gap, 9) AS gap, CASE WHEN gap <= a THEN 0 WHEN gap <= b THEN 1 ELSE 2 END AS bucket FROM t, c""")
def utility_labels(spark, sf_dir):
    return d.label_by_utility(examples(spark, sf_dir)).select("id", "selected", F.round("gap", 9).alias("gap"), "bucket")
