"""Comparisons of metrics between runs, versions, parents and splits, and progress against targets.

Metrics are long: keys, key, value. Versions' parents and targets are small tables beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that delta filters always keep.
PRIMARY = ("accuracy", "cost_change", "cost_change_with_overhead", "f1/macro", "oracle_quality_captured", "oracle_quality_change", "quality_change")


def metric_diffs(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, key, old, new, change ("added", "removed", "changed"): the keys whose values differ."""
    a, b = old.select(*keys, "key", F.col("value").alias("old")), new.select(*keys, "key", F.col("value").alias("new"))
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*keys, "key"], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return j.where("_a IS NULL OR _b IS NULL OR NOT (old <=> new)").select(*keys, "key", "old", "new", change.alias("change"))


def overhead_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("run_id",), fields: tuple[str, ...] = ("total_cost", "duration_seconds")) -> DataFrame:
    """The summary figures of both sides of the groups in which any differs."""
    a = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    return a.join(b, list(keys)).where(differs)


def with_previous(reports: DataFrame, keys: tuple[str, ...] = ("run_id",), order: str = "round") -> DataFrame:
    """Long metrics by round plus previous: the value of the same key in the round before that has it."""
    return reports.withColumn("previous", F.lag("value").over(Window.partitionBy(*keys, "key").orderBy(order)))


def candidate_deltas(metrics: DataFrame, parents: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, version, parent, key, delta: every metric that a version shares with its parent."""
    own = metrics.join(parents.select(*keys, "version", F.col("parent_version").alias("parent")).where("parent IS NOT NULL"), [*keys, "version"])
    theirs = metrics.select(*keys, F.col("version").alias("parent"), "key", F.col("value").alias("_p"))
    return own.join(theirs, [*keys, "parent", "key"]).select(*keys, "version", "parent", "key", (F.col("value") - F.col("_p")).alias("delta"))


def candidate_comparisons(metrics: DataFrame, parents: DataFrame, keys: tuple[str, ...] = ("run_id",), primary: str = "accuracy", cost: str = "cost_change_with_overhead") -> DataFrame:
    """keys, version, parent, quality_delta, cost_delta, recall_deltas: one row a version of parents that has metrics.

    A delta is null where either side lacks the metric or there is no parent with metrics; recall_deltas maps the
    routes that both sides have to the difference of recalls.
    """
    chosen = metrics.where((F.col("key") == primary) | (F.col("key") == cost) | F.col("key").startswith("recall/"))
    sides = metrics.select(*keys, "version").distinct().join(parents.select(*keys, "version", F.col("parent_version").alias("parent")), [*keys, "version"])
    own = chosen.join(sides, [*keys, "version"]).select(*keys, "version", "parent", "key", "value")
    theirs = chosen.select(*keys, F.col("version").alias("parent"), "key", F.col("value").alias("_p"))
    deltas = own.join(theirs, [*keys, "parent", "key"]).select(*keys, "version", "key", (F.col("value") - F.col("_p")).alias("d"))
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("d")))
    recall = F.collect_list(F.when(F.col("key").startswith("recall/") & F.col("d").isNotNull(), F.struct(F.substring("key", len("recall/") + 1, 1 << 20).alias("route"), "d")))
    sums = deltas.groupBy(*keys, "version").agg(of(primary).alias("quality_delta"), of(cost).alias("cost_delta"), F.map_from_entries(F.array_sort(recall)).alias("recall_deltas"))
    none = F.create_map().cast("map<string, double>")
    return sides.join(sums, [*keys, "version"], "left").select(*keys, "version", "parent", "quality_delta", "cost_delta", F.coalesce("recall_deltas", none).alias("recall_deltas"))


def filter_metric_deltas(deltas: DataFrame, targets: tuple[str, ...] = (), least: float = 0.01) -> DataFrame:
    """Without confusion cells; the primary metrics, the target metrics and what changed by more than `least`."""
    return deltas.where(~F.col("key").startswith("confusion/") & (F.col("key").isin(*PRIMARY, *targets) | (F.abs("delta") > least)))


def strip_confusion(metrics: DataFrame) -> DataFrame:
    return metrics.where(~F.col("key").startswith("confusion/"))


def dev_vs_holdout(dev: DataFrame, holdout: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, key, dev, holdout, delta, to four places: metrics that aren't by class, and macro F1."""
    flat = ~F.col("key").contains("/") | F.col("key").startswith("f1/macro")
    j = dev.where(flat).select(*keys, "key", F.col("value").alias("_d")).join(holdout.where(flat).select(*keys, "key", F.col("value").alias("_h")), [*keys, "key"])
    return j.select(*keys, "key", F.round("_d", 4).alias("dev"), F.round("_h", 4).alias("holdout"), F.round(F.col("_h") - F.col("_d"), 4).alias("delta"))


def quality_score_of(metrics: DataFrame, primary: str | None = None, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, quality, cost: the primary metric, else what is captured of the oracle, else accuracy, else the first key."""
    name = (primary or "").split("/")[0]
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return metrics.groupBy(*keys).agg(F.coalesce(of(name), of("oracle_quality_captured"), of("accuracy"), F.min_by("value", "key")).alias("quality"), of("cost_change_with_overhead").alias("cost"))


def holds(operator: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(operator == "<=", value <= threshold).when(operator == ">=", value >= threshold).when(operator == "<", value < threshold)
        .when(operator == ">", value > threshold).when(operator == "==", value == threshold).otherwise(False)
    )


def _against(metrics: DataFrame, targets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every group with every target (a handful of rows), with the value or null."""
    groups = metrics.select(*keys).distinct().join(F.broadcast(targets.select(F.col("metric"), "operator", "threshold")))
    return groups.join(metrics.select(*keys, F.col("key").alias("metric"), "value"), [*keys, "metric"], "left")


#: The oracle's metric beside a target's.
ORACLE_METRICS = {"cost_change": "oracle_cost_change", "cost_change_with_overhead": "oracle_cost_change", "quality_change": "oracle_quality_change"}


def target_progress(metrics: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("run_id", "version"), oracle: DataFrame | None = None, full_oracle: DataFrame | None = None) -> DataFrame:
    """keys, metric, value, met, ratio (|value / threshold|, at least 1 where met), ceiling, full_ceiling, capture_ratio, translated and above_oracle.

    ceiling is the oracle's metric beside the target's, from `oracle` (key, value: one for all groups) or else from the
    group's own metrics. A target is above the oracle if it is stricter than the ceiling. With full_oracle (key, value
    over the whole dataset) and a figure there that isn't 0, capture_ratio is the threshold over it, translated the
    ceiling times that, above_oracle goes by |capture_ratio| > 1, and met and ratio by the translated threshold. The
    ratio is null at a threshold of 0 or without a value.
    """
    beside = F.create_map(*[F.lit(x) for pair in ORACLE_METRICS.items() for x in pair])
    rows = _against(metrics, targets, keys).withColumn("_o", F.element_at(beside, F.col("metric")))
    if oracle is None:
        rows = rows.join(metrics.select(*keys, F.col("key").alias("_o"), F.col("value").alias("ceiling")), [*keys, "_o"], "left")
    else:
        rows = rows.join(F.broadcast(oracle.where(F.col("key").isin(*ORACLE_METRICS.values())).select(F.col("key").alias("_o"), F.col("value").alias("ceiling"))), "_o", "left")  # two rows
    if full_oracle is None:
        rows = rows.withColumn("full_ceiling", F.lit(None).cast("double"))
    else:
        rows = rows.join(F.broadcast(full_oracle.where(F.col("key").isin(*ORACLE_METRICS.values())).select(F.col("key").alias("_o"), F.col("value").alias("full_ceiling"))), "_o", "left")  # two rows
    t, v, op, ceiling = F.col("threshold"), F.col("value"), F.col("operator"), F.col("ceiling")
    capture = F.when(F.col("full_ceiling") != 0, t / F.col("full_ceiling"))
    rows = rows.withColumn("capture_ratio", capture).withColumn("translated", F.when(ceiling != 0, F.col("capture_ratio") * ceiling))
    stricter = F.when(ceiling.isNull() | (t == 0), F.lit(False)).when(op.isin("<=", "<"), t < ceiling).when(op.isin(">=", ">"), t > ceiling).otherwise(F.lit(False))
    goal = F.coalesce("translated", "threshold")
    met = F.coalesce(holds(op, v, goal), F.lit(False))
    ratio = F.when(goal != 0, F.abs(v / goal))
    at_least = F.when(met, F.greatest(ratio, F.when(ratio.isNotNull(), F.lit(1.0)))).otherwise(ratio)
    above = F.when(F.col("capture_ratio").isNotNull(), F.abs("capture_ratio") > 1).otherwise(stricter)
    return rows.select(*keys, "metric", "value", met.alias("met"), at_least.alias("ratio"), "ceiling", "full_ceiling", "capture_ratio", "translated", above.alias("above_oracle"))


def targets_met(metrics: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, n_met, progress (sum, each capped at 1), least, all_met; a missing metric isn't met and adds nothing."""
    rows = target_progress(metrics, targets, keys)
    capped = F.when(F.col("value").isNull(), F.lit(None)).otherwise(F.coalesce(F.least("ratio", F.lit(1.0)), F.col("met").cast("double")))
    return rows.withColumn("_p", capped).groupBy(*keys).agg(F.count_if("met").alias("n_met"), F.coalesce(F.sum("_p"), F.lit(0.0)).alias("progress"), F.coalesce(F.min("_p"), F.lit(0.0)).alias("least"), F.bool_and("met").alias("all_met"))


def best_version(met: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, best: the version with most targets met, then progress, then least; of equals the first by name."""
    return met.groupBy(*keys).agg(F.min_by("version", F.struct(-F.col("n_met"), -F.col("progress"), -F.col("least"), F.col("version"))).alias("best"))


def target_slack(metrics: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, metric, surplus, budget (what may be lost), weight: its share of all deficits.

    The surplus is positive on the good side of the threshold; a missing metric lacks |threshold|, or 1 at 0.
    """
    up = F.col("operator").isin(">=", ">")
    surplus = F.when(F.col("value").isNull(), -F.when(F.col("threshold") == 0, F.lit(1.0)).otherwise(F.abs("threshold"))).when(up, F.col("value") - F.col("threshold")).when(
        F.col("operator").isin("<=", "<"), F.col("threshold") - F.col("value")).otherwise(-F.abs(F.col("value") - F.col("threshold")))
    rows = _against(metrics, targets, keys).select(*keys, "metric", surplus.alias("surplus"))
    deficit = F.greatest(-F.col("surplus"), F.lit(0.0))
    total = F.sum(deficit).over(Window.partitionBy(*keys).orderBy("metric").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("budget", F.greatest("surplus", F.lit(0.0))).withColumn("weight", F.when(total > 0, deficit / total).otherwise(0.0))


def oracle_captured(wide: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, cost_ratio, quality_ratio of the candidate to the oracle; null where the oracle's change is 0 or a figure is missing."""
    c, oc, q, oq = (F.col(x) for x in ("cost_change", "oracle_cost_change", "quality_change", "oracle_quality_change"))
    return wide.select(*keys, F.when(oc != 0, c / oc).alias("cost_ratio"), F.when(oq != 0, (1 + q) / (1 + oq)).alias("quality_ratio"))


def reshape_route_metrics(metrics: DataFrame, keys: tuple[str, ...] = ("run_id", "version"), names: tuple[str, ...] = ("recall", "precision", "f1")) -> DataFrame:
    """keys, route, recall, precision, f1 from the keys recall/<route> and so on."""
    parts = F.split("key", "/", 2)
    rows = metrics.where(F.col("key").contains("/")).select(*keys, parts[0].alias("_m"), parts[1].alias("route"), "value").where(F.col("_m").isin(*names))
    return rows.groupBy(*keys, "route").pivot("_m", list(names)).agg(F.max("value"))


def per_class_performance(metrics: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """keys, route, recall, precision, f1, support of every route that has one of the three; macro figures are left out.

    The support is the metric support/<route>, else the sum of the route's row of the confusion matrix, else null.
    """
    routes = reshape_route_metrics(metrics.where(~F.col("key").endswith("/macro")), keys)
    parts = F.split("key", "/", 3)
    given = metrics.where(F.col("key").startswith("support/")).select(*keys, F.split("key", "/", 2)[1].alias("route"), F.col("value").alias("_given"))
    summed = metrics.where(F.col("key").startswith("confusion/")).groupBy(*keys, parts[1].alias("route")).agg(F.sum("value").alias("_summed"))
    j = routes.join(given, [*keys, "route"], "left").join(summed, [*keys, "route"], "left")
    return j.select(*keys, "route", "recall", "precision", "f1", F.coalesce("_given", "_summed").cast("long").alias("support"))


def batch_outcomes(variants: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("run_id",), best_ever: float | None = None) -> DataFrame:
    """keys, version, quality, delta (to the parent), is_new_best: variants with what became of them; null and no new best if never scored.

    A variant is a new best if no candidate of an earlier round has as high a quality, or, with best_ever, if its own is
    higher than that. Where candidates have
    eval_status, only a "scored" one has a delta, and eval_status ("scored", "failed" or null) comes with the rest.
    """
    status = "eval_status" in candidates.columns
    c = candidates.select(*keys, "version", "round", "quality", *["eval_status"] * status)
    best = Window.partitionBy(*keys).orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    scored = c.withColumn("_best", F.max("quality").over(best))
    parent = c.select(*keys, F.col("version").alias("parent_version"), F.col("quality").alias("_pq"))
    j = variants.join(scored, [*keys, "version"], "left").join(parent, [*keys, "parent_version"], "left")
    counts = F.coalesce(F.col("eval_status") == "scored", F.lit(False)) if status else F.lit(True)
    above = F.col("quality") > F.lit(best_ever) if best_ever is not None else F.col("quality").isNotNull() & (F.col("_best").isNull() | (F.col("quality") > F.col("_best")))
    return j.select(
        *keys, "version", "quality", F.when(counts, F.col("quality") - F.col("_pq")).alias("delta"), F.coalesce(above, F.lit(False)).alias("is_new_best"),
        *[F.when(F.col("eval_status").isin("scored", "failed"), F.col("eval_status")).alias("eval_status")] * status)


def batch_metric_deltas(variants: DataFrame, candidates: DataFrame, metrics: DataFrame, targets: tuple[str, ...] = (), keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, version, against ("parent", "secondary"), key, delta: a scored variant's metrics less those of each of its parents, as filter_metric_deltas leaves them.

    variants has version, parent_version and secondary_parent_version, candidates version and eval_status.
    """
    scored = variants.join(candidates.where("eval_status = 'scored'").select(*keys, "version").distinct(), [*keys, "version"], "left_semi")
    sides = scored.select(*keys, "version", F.inline(F.array(
        F.struct(F.lit("parent").alias("against"), F.col("parent_version").alias("parent")), F.struct(F.lit("secondary").alias("against"), F.col("secondary_parent_version").alias("parent"))))).where("parent IS NOT NULL")
    own = metrics.join(sides, [*keys, "version"])
    theirs = metrics.select(*keys, F.col("version").alias("parent"), "key", F.col("value").alias("_p"))
    deltas = own.join(theirs, [*keys, "parent", "key"]).select(*keys, "version", "against", "key", (F.col("value") - F.col("_p")).alias("delta"))
    return filter_metric_deltas(deltas, targets)


def evaluated_versions(reports: DataFrame, front: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, version, quality, cost, on_front: every version with a report; zeros for one that isn't on the front."""
    f = front.select(*keys, "version", F.col("quality").alias("_q"), F.col("cost").alias("_c"))
    j = reports.select(*keys, "version").distinct().join(f, [*keys, "version"], "left")
    return j.select(*keys, "version", F.coalesce("_q", F.lit(0)).alias("quality"), F.coalesce("_c", F.lit(0)).alias("cost"), F.col("_q").isNotNull().alias("on_front"))


def score_report(metrics: DataFrame, summary: DataFrame, results: DataFrame, previous: tuple[DataFrame, DataFrame] | None = None, keys: tuple[str, ...] = ("run_id", "version")) -> dict[str, DataFrame]:
    """The parts of a report: metrics, summary, failed results, and the differences from an earlier report (its metrics and summary)."""
    failed = results.where("error IS NOT NULL").select(*keys, "example_id", "error", "retries")
    parts = {"metrics": metrics, "summary": summary, "errors": failed}
    if previous is not None:
        fields = tuple(f for f in ("total_cost", "duration_seconds") if f in summary.columns)
        parts |= {"metric_diffs": metric_diffs(previous[0], metrics, keys), "overhead_diff": overhead_diff(previous[1], summary, keys, fields)}
    return parts


#: Errors that stand inside a report's document; a version with more has them in lines of their own.
ERRORS_INSIDE = 10_000


def report_documents(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("run_id", "version"), inside: int = ERRORS_INSIDE) -> tuple[DataFrame, DataFrame]:
    """(keys, report: one nested report a group of score_report's summary; keys, example_id, error, retries: the errors of groups that have more than `inside`).

    report has metrics (a map), summary, n_errors, errors (null if they are beside it) and diff (null without an earlier
    report): metric_diffs and overhead_diff. Lists are in the order of keys and ids. Counts come first, so no group of
    errors meets in one row unless it is known to be small.
    """
    on = list(keys)
    rest = [c for c in parts["summary"].columns if c not in keys]
    docs = parts["summary"].select(*keys, F.struct(*rest).alias("summary"))
    metrics = parts["metrics"].groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))  # as many as there are metrics
    counts = parts["errors"].groupBy(*keys).agg(F.count("*").alias("n_errors"))
    few = parts["errors"].join(counts.where(F.col("n_errors") <= inside), on, "left_semi")
    errors = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("example_id", "error", "retries"))).alias("errors"))
    docs = docs.join(metrics, on, "left").join(counts, on, "left").join(errors, on, "left")
    none = F.array().cast(errors.schema["errors"].dataType)
    errors_of = F.when(F.coalesce("n_errors", F.lit(0)) == 0, none).otherwise(F.col("errors"))
    diff = F.lit(None).cast("string")
    if "metric_diffs" in parts:
        diffs = parts["metric_diffs"].groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "old", "new", "change"))).alias("metric_diffs"))
        overhead = parts["overhead_diff"]
        over = overhead.select(*keys, F.struct(*[c for c in overhead.columns if c not in keys]).alias("overhead_diff"))
        docs = docs.join(diffs, on, "left").join(over, on, "left")
        diff = F.struct(F.coalesce("metric_diffs", F.array().cast(diffs.schema["metric_diffs"].dataType)).alias("metric_diffs"), F.col("overhead_diff"))
    empty = F.create_map().cast("map<string, double>")
    report = F.struct(F.coalesce("metrics", empty).alias("metrics"), F.col("summary"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), errors_of.alias("errors"), diff.alias("diff"))
    many = parts["errors"].join(counts.where(F.col("n_errors") > inside), on, "left_semi")
    return docs.select(*keys, report.alias("report")), many
