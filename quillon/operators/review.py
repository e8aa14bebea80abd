"""Review analytics: confusion impact and persistence, trends by round, attempt histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metrics import micro

KEYS = ("run_id",)


def misroutes(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, id, true_route, pred_route, cost and quality deltas in millionths: each wrong, known prediction once over all versions."""
    wrong = pairs.where("pred IS NOT NULL AND pred <> route").where(F.map_contains_key("routes", F.col("pred")))
    p, t = F.element_at("routes", F.col("pred")), F.element_at("routes", F.col("route"))
    rows = wrong.select(*keys, "id", F.col("route").alias("true_route"), F.col("pred").alias("pred_route"), (micro(p["cost"]) - micro(t["cost"])).alias("dc"), (micro(p["quality_score"]) - micro(t["quality_score"])).alias("dq"))
    return rows.groupBy(*keys, "id", "true_route", "pred_route").agg(F.first("dc").alias("dc"), F.first("dq").alias("dq"))


def confusion_impact(pairs: DataFrame, examples: DataFrame, keys: tuple[str, ...] = KEYS, top: int = 20) -> DataFrame:
    """The `top` cells of each group by |cost| + |quality|: count, support, misroute_rate, sums and means of the deltas."""
    cells = misroutes(pairs, keys).groupBy(*keys, "true_route", "pred_route").agg(F.count("*").alias("n"), F.sum("dc").alias("_c"), F.sum("dq").alias("_q"))
    support = examples.groupBy(F.col("route").alias("true_route")).agg(F.count("*").alias("support"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("_c") + F.abs("_q")), "true_route", "pred_route"))
    out = cells.join(support, "true_route").withColumn("place", rank).where(F.col("place") <= top)
    return out.select(
        *keys, "true_route", "pred_route", "n", "support", (F.col("n") / F.col("support")).alias("misroute_rate"), (F.col("_c") / 1e6).alias("cost_impact"), (F.col("_q") / 1e6).alias("quality_impact"),
        (F.col("_c") / F.col("n") / 1e6).alias("mean_cost"), (F.col("_q") / F.col("n") / 1e6).alias("mean_quality"))


def confusion_cell(impact: DataFrame, true_route: str, pred_route: str) -> DataFrame:
    """One cell of confusion_impact."""
    return impact.where((F.col("true_route") == true_route) & (F.col("pred_route") == pred_route))


def sample_ids(rows: DataFrame, cell: tuple[str, ...], k: int = 3) -> DataFrame:
    """cell, ids: the k smallest ids of each cell."""
    ranked = rows.select(*cell, "id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("id"))).where(F.col("_r") <= k)
    return ranked.groupBy(*cell).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def persistence(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, true_route, pred_route, n, persistent, volatile, rate, label: of a cell's examples, those wrong in every version.

    An example without a result in a version isn't wrong there; one without output is.
    """
    versions = pairs.select(*keys, "version").distinct().groupBy(*keys).agg(F.count("*").alias("_versions"))
    wrong = pairs.where("pred IS NULL OR pred <> route")
    cell = F.when(F.map_contains_key("routes", F.coalesce("pred", F.lit(""))) & F.col("pred").isNotNull(), F.struct(F.col("route").alias("true_route"), F.col("pred").alias("pred_route")))
    each = wrong.groupBy(*keys, "id").agg(F.size(F.collect_set("version")).alias("_wrong"), F.collect_set(cell).alias("_cells"))  # sets of an example, of versions at most
    marked = each.join(versions, list(keys)).select(*keys, F.inline("_cells"), (F.col("_wrong") == F.col("_versions")).alias("_p"))
    cells = marked.groupBy(*keys, "true_route", "pred_route").agg(F.count("*").alias("n"), F.count_if("_p").alias("persistent"))
    rate = F.col("persistent") / F.col("n")
    return cells.select("*", (F.col("n") - F.col("persistent")).alias("volatile"), rate.alias("rate"), F.when(rate > 0.8, "structural").when(rate < 0.3, "prompt-sensitive").otherwise("mixed").alias("label"))


def example_ids(prompts: DataFrame) -> DataFrame:
    """version, id: what follows "### Example " in a prompt, each once."""
    return prompts.select("version", F.explode(F.regexp_extract_all("text", F.lit(r"### Example (\S+)"), F.lit(1))).alias("id")).distinct()


def example_overlap(ids: DataFrame) -> DataFrame:
    """overlap: ids that all versions share, of all ids; 1 for fewer than two versions or no ids."""
    versions = ids.agg(F.count_distinct("version").alias("_v"))
    each = ids.distinct().groupBy("id").agg(F.count("*").alias("_n"))
    sums = each.join(F.broadcast(versions)).agg(F.count_if(F.col("_n") == F.col("_v")).alias("_s"), F.count("*").alias("_a"), F.max("_v").alias("_v"))  # one row
    return sums.select(F.when((F.col("_a") == 0) | (F.col("_v") < 2), F.lit(1.0)).otherwise(F.col("_s") / F.col("_a")).alias("overlap"))


def recall_trend(recalls: DataFrame, keys: tuple[str, ...] = KEYS, last: int = 5) -> DataFrame:
    """keys, route, current, previous, regressed, trend (the last rounds), support, from rows (keys, round, version, route, recall, support)."""
    best = recalls.groupBy(*keys, "round", "route").agg(F.max_by(F.struct("recall", "support"), F.struct("recall", "support")).alias("b"))
    w = Window.partitionBy(*keys, "route").orderBy(F.desc("round"))
    rows = best.select(*keys, "route", "round", "b.*").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(last, 2))
    at = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c)))
    trend = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= last, F.struct("round", "recall")))), lambda x: x["recall"])
    out = rows.groupBy(*keys, "route").agg(at(1, "recall").alias("current"), F.coalesce(at(2, "recall"), at(1, "recall")).alias("previous"), trend.alias("trend"), at(1, "support").alias("support"))
    return out.withColumn("regressed", F.col("current") < F.col("previous"))


def regression_or_high_support(trends: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Routes that regressed or whose support is at least the median of their group."""
    middle = trends.groupBy(*keys).agg(F.median("support").alias("_m"))
    return trends.join(middle, list(keys)).where("regressed OR support >= _m").drop("_m")


def score_trajectory(scores: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, round, score: the best of each round that has one."""
    return scores.where("score IS NOT NULL").groupBy(*keys, "round").agg(F.max("score").alias("score"))


def diminishing_returns(trajectory: DataFrame, keys: tuple[str, ...] = KEYS, last: int = 7) -> DataFrame:
    """keys, n_points, trend, spread, threshold, stagnating, over the last points of a trajectory, and scores, the last eight.

    trend and spread are the mean and population deviation of the steps (spread 0 below two steps); the threshold is a
    hundredth of the best score, 0.005 at least.
    """
    w = Window.partitionBy(*keys)
    ranked = trajectory.withColumn("_r", F.row_number().over(w.orderBy(F.desc("round")))).withColumn("_best", F.max("score").over(w)).where(F.col("_r") <= max(last, 8))
    rows = ranked.withColumn("_d", F.when(F.col("_r") < last, F.col("score") - F.lag("score").over(w.orderBy("round"))))
    scores = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 8, F.struct("round", "score")))), lambda x: x["score"])
    out = rows.groupBy(*keys).agg(
        F.count_if(F.col("_r") <= last).alias("n_points"), F.avg("_d").alias("trend"), F.when(F.count("_d") < 2, F.lit(0.0)).otherwise(F.stddev_pop("_d")).alias("spread"),
        F.greatest(F.lit(0.005), F.max("_best") * 0.01).alias("threshold"), scores.alias("scores"))
    return out.withColumn("stagnating", (F.col("n_points") >= 2) & (F.col("trend") < F.col("threshold")))


def active_attempts(attempts: DataFrame, cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The attempts at cells that are still there."""
    return attempts.join(cells.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi")


def attempt_decay(cells: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """cells (keys, cell, impact) plus attempts, failures since the last improvement, last_round, best_outcome and effective impact, halved by each failure.

    Only the attempts at these cells count.
    """
    group = Window.partitionBy(*keys, "cell")
    rows = active_attempts(attempts, cells, keys).withColumn("_won", F.max(F.when(F.col("outcome") == "improved", F.col("seq"))).over(group))
    order = F.when(F.col("outcome") == "improved", 0).when(F.col("outcome") == "no_effect", 1).otherwise(2)
    failed = (F.col("outcome") != "improved") & (F.col("_won").isNull() | (F.col("seq") > F.col("_won")))
    sums = rows.groupBy(*keys, "cell").agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), F.max("round").alias("last_round"), F.min_by("outcome", order).alias("best_outcome"))
    j = cells.join(sums, [*keys, "cell"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("failures", F.coalesce("failures", F.lit(0)))
    return j.withColumn("effective", F.col("impact") * F.pow(F.lit(0.5), F.col("failures")))


def outcome_of(delta, least: float = 0.005):
    return F.when(delta > least, "improved").when(delta < -least, "regressed").otherwise("no_effect")


def cell_outcomes(cells: DataFrame, least: float = 0.005) -> DataFrame:
    """cells plus outcome: by the cost delta (a fall is good) where there is one and cost weighs more than quality, else by the quality delta; without it, no effect."""
    by_cost = F.coalesce(F.col("cost_delta").isNotNull() & (F.abs("cost_impact") > F.abs("quality_impact")), F.lit(False))
    return cells.withColumn("outcome", F.when(by_cost, outcome_of(-F.col("cost_delta"), least)).otherwise(outcome_of(F.col("quality_delta"), least)))


def append_attempts(attempts: DataFrame, outcomes: DataFrame, round_: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The history of attempts (keys, cell, seq, round, outcome) with a round's outcomes (keys, cell, variant, outcome) after it.

    Places go on from the last of the cell, in the order of variants.
    """
    last = attempts.groupBy(*keys, "cell").agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("variant"))
    new = outcomes.where("cell IS NOT NULL").join(last, [*keys, "cell"], "left").select(*keys, "cell", (F.coalesce("_last", F.lit(0)) + place).cast("long").alias("seq"), F.lit(round_).alias("round"), "outcome")
    return attempts.select(*keys, "cell", F.col("seq").cast("long"), F.col("round").cast("int"), "outcome").unionByName(new)


def directive_outcomes(variants: DataFrame, keys: tuple[str, ...] = KEYS, last: int = 15) -> DataFrame:
    """keys, version, directive, was_attempted, outcome: one row a variant and directive, the last of each group by round, version and place.

    variants has round, version, directive_ids, eval_status and delta. A variant that is scored was attempted; the
    outcome goes by the sign of its delta, and no delta is no effect.
    """
    outcome = F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "regressed").otherwise("no_effect")
    rows = variants.select(*keys, "round", "version", F.posexplode("directive_ids").alias("_at", "directive"), F.coalesce(F.col("eval_status") == "scored", F.lit(False)).alias("was_attempted"), outcome.alias("outcome"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("round"), F.desc("version"), F.desc("_at")))
    return rows.withColumn("_r", rank).where(F.col("_r") <= last).select(*keys, "version", "directive", "was_attempted", "outcome")


def directive_counts(variants: DataFrame, keys: tuple[str, ...] = KEYS, last: int = 15) -> DataFrame:
    """keys, directive, attempted, improved, regressed, no_effect, last_round: sums over variants, for the latest directives of each group."""
    rows = variants.select(*keys, "round", F.explode("directive_ids").alias("directive"), "delta")
    sums = rows.groupBy(*keys, "directive").agg(
        F.count("delta").alias("attempted"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("regressed"), F.count_if(F.col("delta") == 0).alias("no_effect"), F.max("round").alias("last_round"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_round"), "directive"))
    return sums.withColumn("_r", rank).where(F.col("_r") <= last).drop("_r")


def regressions(trends: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The routes of recall_trend that regressed, plus place: those with the least support first."""
    return trends.where("regressed").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("support", "route")))


def best_candidate(deltas: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, version, quality_delta: the version whose quality rose most against its parent, the first by name among equals."""
    best = F.min_by(F.struct("version", "quality_delta"), F.struct(-F.col("quality_delta"), F.col("version"))).alias("b")
    return deltas.where("quality_delta IS NOT NULL").groupBy(*keys).agg(best).select(*keys, "b.*")


def round_progress(rounds: DataFrame, keys: tuple[str, ...] = KEYS, budget: int = 60, limit: int = 5, max_rounds: int = 50) -> DataFrame:
    """rounds plus hypervolume_change, total_evaluated, total_cost, budget_used and stop_reason."""
    w = Window.partitionBy(*keys).orderBy("round")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rounds.withColumn("hypervolume_change", F.col("hypervolume") - F.lag("hypervolume").over(w)).withColumn("total_evaluated", F.sum("evaluated").over(run)).withColumn("total_cost", F.sum("cost").over(run))
    reason = F.when(F.col("stagnation") >= limit, "stagnation").when(F.col("round") >= max_rounds, "max_rounds").otherwise("other")
    return out.withColumn("budget_used", F.col("total_evaluated") / budget).withColumn("stop_reason", reason)


def dataset_overview(examples: DataFrame) -> DataFrame:
    """route (null: all), dev, holdout, total."""
    return examples.rollup("route").agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "holdout").alias("holdout"), F.count("*").alias("total"))
