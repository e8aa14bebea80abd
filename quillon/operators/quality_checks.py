"""Data-quality checks on raw rows (row_idx, v VARIANT): violations as rows, findings as counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Checks in the order of the report, with their severity.
CHECKS = (
    ("required_keys", "critical"), ("types", "critical"), ("route_in_routes", "critical"), ("non_empty_routes", "warning"),
    ("consistent_model_set", "critical"), ("unique_ids", "critical"), ("null_fields", "warning"), ("canonical_route_fields", "critical"),
)
_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"


def _kind(v: str, path: str) -> Column:
    """Name of the JSON type at a path: null where the path is missing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def row_checks(rows: DataFrame, v: str = "v") -> DataFrame:
    """rows plus failed: the names of the checks that a row fails by itself, found in one narrow pass."""
    kind = {p: _kind(v, f"$.{p}") for p in ("id", "input", "expected", "expected.route", "expected.routes")}
    absent = lambda p: kind[p].isNull() | (kind[p] == "VOID")
    known = lambda p: kind[p].isNotNull() & (kind[p] != "VOID")
    is_object = lambda p: F.coalesce(kind[p].startswith("OBJECT<"), F.lit(False))
    routes = F.try_variant_get(v, "$.expected.routes", "map<string, variant>")
    entries = F.when(is_object("expected.routes"), F.map_values(routes))
    fields = lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT<"), F.try_variant_get(e, "$", "map<string, variant>"))
    any_entry = lambda test: F.coalesce(F.exists(entries, test), F.lit(False))
    wrong_number = lambda e, f: F.coalesce(~F.schema_of_variant(F.try_variant_get(e, f"$.{f}", "variant")).rlike(_NUMBER + "|^VOID$"), F.lit(False))
    wrong_string = lambda p: known(p) & (kind[p] != "STRING")
    tests = {
        "required_keys": absent("id") | absent("input") | absent("expected") | ~is_object("expected") | absent("expected.route") | absent("expected.routes"),
        "types": wrong_string("id") | wrong_string("input") | (known("expected") & ~is_object("expected")) | wrong_string("expected.route") | any_entry(lambda e: wrong_number(e, "cost") | wrong_number(e, "quality_score")),
        "route_in_routes": (kind["expected.route"] == "STRING") & is_object("expected.routes") & (F.size(routes) > 0) & ~F.map_contains_key(routes, F.try_variant_get(v, "$.expected.route", "string")),
        "non_empty_routes": is_object("expected.routes") & (F.size(routes) == 0),
        "null_fields": (kind["expected.route"] == "VOID") | (kind["expected.routes"] == "VOID") | any_entry(lambda e: F.coalesce(F.exists(F.map_values(fields(e)), lambda x: F.is_variant_null(x)), F.lit(False))),
        "canonical_route_fields": any_entry(lambda e: F.coalesce(F.size(F.array_except(F.map_keys(fields(e)), F.array(F.lit("cost"), F.lit("quality_score")))) > 0, F.lit(False))),
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    key_set = F.when(is_object("expected.routes") & (F.size(routes) > 0), F.array_join(F.array_sort(F.map_keys(routes)), "\n"))
    row_id = F.when(kind["id"] == "STRING", F.try_variant_get(v, "$.id", "string"))
    return rows.select("row_idx", row_id.alias("id"), F.try_variant_get(v, "$.expected.route", "string").alias("_route"), (kind["expected.route"] == "STRING").alias("_has_route"), key_set.alias("_keys"), failed.alias("failed"))


def violations(rows: DataFrame, v: str = "v", checked: DataFrame | None = None) -> DataFrame:
    """check, row_idx, id: every failing row of every check.

    `checked` is row_checks(rows), where the caller has stored it: it is read for four ends. Repeated ids are counted first; only those that repeat are ranked. The set of models is held against that of the
    first row that has one.
    """
    checked = row_checks(rows, v) if checked is None else checked
    single = checked.select(F.explode("failed").alias("check"), "row_idx", "id")
    many = checked.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("row_idx").alias("first")).where("n > 1").select("id", "first")
    again = checked.select("row_idx", "id").join(many, "id").where("row_idx <> first").select(F.lit("unique_ids").alias("check"), "row_idx", "id")
    first = checked.where("_keys IS NOT NULL").agg(F.min_by("_keys", "row_idx").alias("_ref"))
    other = checked.where("_keys IS NOT NULL").join(F.broadcast(first)).where("_keys <> _ref").select(F.lit("consistent_model_set").alias("check"), "row_idx", "id")  # one row
    return single.unionByName(again).unionByName(other)


def findings(found: DataFrame, samples: int = 5) -> DataFrame:
    """check, severity, status, n_violations, sample_row_indices (the smallest): one row a check.

    A task counts its violations and keeps the smallest indices of each check, so a few rows a task are shuffled.
    """
    names = [c for c, _ in CHECKS]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, least = dict.fromkeys(names, 0), {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            for c in names:
                own = batch.column(1).filter(pc.equal(batch.column(0), c)).to_numpy(zero_copy_only=False).astype(np.int64)
                counts[c] += len(own)
                least[c] = np.sort(np.concatenate([least[c], own]))[:samples]
        yield pa.record_batch([pa.array(names), pa.array([counts[c] for c in names], pa.int64()), pa.array([least[c] for c in names], pa.list_(pa.int64()))], ["check", "n", "rows"])

    parts = found.select("check", F.col("row_idx").cast("long")).mapInArrow(few, "check string, n long, rows array<long>")
    ranked = parts.groupBy("check").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, samples).alias("rows"))  # a row a task and check
    every = found.sparkSession.createDataFrame(list(CHECKS), "check string, severity string")
    j = every.join(ranked, "check", "left")
    return j.select("check", "severity", F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"), F.coalesce("rows", F.array().cast("array<bigint>")).alias("sample_row_indices"))


def passes(found: DataFrame) -> DataFrame:
    """passed: no critical check has a violation."""
    critical = [c for c, s in CHECKS if s == "critical"]
    return found.agg((F.count_if(F.col("check").isin(critical)) == 0).alias("passed"))


def route_key_union(rows: DataFrame, names: list[str], v: str = "v") -> DataFrame:
    """route, place ("only in rows", "only in names"): route keys of all rows against a given set."""
    keys = rows.select(F.explode(F.map_keys(F.try_variant_get(v, "$.expected.routes", "map<string, variant>"))).alias("route")).distinct()
    given = rows.sparkSession.createDataFrame([(n,) for n in names], "route string")
    return keys.join(given, "route", "left_anti").withColumn("place", F.lit("only in rows")).unionByName(given.join(keys, "route", "left_anti").withColumn("place", F.lit("only in names")))


def label_distribution(examples: DataFrame, least: float = 0.10) -> DataFrame:
    """route, n, share, imbalanced (share below `least`); rows without a route are left out."""
    n = examples.where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row a route
    return n.withColumn("share", share).withColumn("imbalanced", F.col("share") < least)


def volume_adequacy(examples: DataFrame, expected: list[str] | None = None, least: int = 5) -> DataFrame:
    """route, n, adequate, absent, and all_adequate over all routes."""
    n = examples.where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n"))
    if expected is not None:
        n = examples.sparkSession.createDataFrame([(r,) for r in expected], "route string").join(n, "route", "full")
    rows = n.select("route", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rows = rows.withColumn("adequate", F.col("n") >= least).withColumn("absent", F.col("n") == 0)
    return rows.withColumn("all_adequate", F.bool_and("adequate").over(Window.partitionBy()))  # a row a route


def query_length_stats(examples: DataFrame, text: str = "input", approximate: bool = False) -> DataFrame:
    """shortest, longest, mean, p95 (interpolated), n of the texts' code points; zeros for no text."""
    size = F.length(text)
    p95 = F.approx_percentile(size, 0.95) if approximate else F.percentile(size, F.lit(0.95))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return examples.where(F.col(text).isNotNull()).agg(zero(F.min(size)).alias("shortest"), zero(F.max(size)).alias("longest"), zero(F.sum(size) / F.count("*")).cast("double").alias("mean"), zero(p95).cast("double").alias("p95"), F.count("*").alias("n"))


def quality_report(found: DataFrame, examples: DataFrame, expected: list[str] | None = None, least_share: float = 0.10, least_rows: int = 5) -> DataFrame:
    """section ("check", "distribution", "volume", "length", "gate"), name, status ("pass", "warning", "fail" or null), value: all checks in one table."""
    none = F.lit(None).cast("string")
    checks = findings(found)
    rows = checks.select(F.lit("check").alias("section"), F.col("check").alias("name"), F.when((F.col("status") == "fail") & (F.col("severity") == "warning"), "warning").otherwise(F.col("status")).alias("status"), F.col("n_violations").cast("double").alias("value"))
    shares = label_distribution(examples, least_share).select(F.lit("distribution"), "route", F.when(F.col("imbalanced"), "warning").otherwise("pass"), F.col("share"))
    volumes = volume_adequacy(examples, expected, least_rows).select(F.lit("volume"), "route", F.when(F.col("adequate"), "pass").otherwise("warning"), F.col("n").cast("double"))
    lengths = query_length_stats(examples)
    flat = lengths.select(F.lit("length"), F.inline(F.array(*[F.struct(F.lit(c), none, F.col(c).cast("double")) for c in lengths.columns])))
    gate = passes(found).select(F.lit("gate"), F.lit("critical"), F.when(F.col("passed"), "pass").otherwise("fail"), F.lit(None).cast("double"))
    return rows.union(shares).union(volumes).union(flat).union(gate)
