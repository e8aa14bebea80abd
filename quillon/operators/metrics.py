"""Pairs of results and examples, and the metrics computed from them, for many runs and versions in one job.

All functions take DataFrames and give DataFrames; `keys` are the grouping columns. Sums of costs and qualities are
taken in whole millionths, so they don't depend on the order of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id", "version")
#: The class of a result without output.
NO_OUTPUT = ""


def micro(x: Column) -> Column:
    """Whole millionths; null counts as 0."""
    return F.coalesce(F.round(x * 1_000_000).cast("long"), F.lit(0))


def pair_results(results: DataFrame, examples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, id, route, routes, pred (null without output), cost of each successful result of a known example.

    Of repeated examples the last by row_idx, if that column is there, counts. Only the columns needed are shuffled.
    """
    known = examples.select("id", "route", "routes", *["row_idx"] * ("row_idx" in examples.columns))
    if "row_idx" in known.columns:
        known = known.groupBy("id").agg(F.max_by(F.struct("route", "routes"), "row_idx").alias("e")).select("id", "e.route", "e.routes")
    done = results.where("error IS NULL").select(*keys, F.col("example_id").alias("id"), F.col("output.route").alias("pred"), "cost")
    return done.join(known, "id").select(*keys, "id", "route", "routes", "pred", "cost")


def accuracy(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, n_correct, accuracy; a result without output is wrong."""
    right = F.coalesce(F.col("pred") == F.col("route"), F.lit(False))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"))
    return out.withColumn("accuracy", F.col("n_correct") / F.col("n"))


def confusion_cells(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, true_route, pred_route, n: the cells that occur."""
    return pairs.groupBy(*keys, F.col("route").alias("true_route"), F.coalesce("pred", F.lit(NO_OUTPUT)).alias("pred_route")).agg(F.count("*").alias("n"))


def _classes(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return cells.select(*keys, F.explode(F.array("true_route", "pred_route")).alias("class")).distinct()


def confusion_dense(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All cells over the classes that are true or predicted in a group, zeros included."""
    classes = _classes(cells, keys)
    a, b = classes.withColumnRenamed("class", "true_route"), classes.withColumnRenamed("class", "pred_route")
    square = a.join(b, list(keys)) if keys else a.crossJoin(b)
    return square.join(cells, [*keys, "true_route", "pred_route"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def precision_recall_f1(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, class, precision, recall, f1, support; 0 where a denominator is."""
    ends = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("true_route").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true_route") == F.col("pred_route"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred_route").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("e")).select(*keys, "e.*")
    sums = ends.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("predicted", "hits")


def macro_f1(per_class: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The plain mean of f1 over all classes."""
    return per_class.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def baseline_class(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, baseline: the class with the highest mean quality, the first by name among equals."""
    each = pairs.select(*keys, F.explode("routes").alias("class", "r")).groupBy(*keys, "class").agg(F.sum(micro(F.col("r.quality_score"))).alias("q"), F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.min_by("class", F.struct(-F.col("q") / F.col("n"), F.col("class"))).alias("baseline"))


COST_QUALITY = ("baseline_cost", "baseline_quality", "predicted_cost", "predicted_quality", "oracle_cost", "oracle_quality", "routing_overhead")


def cost_quality_change(pairs: DataFrame, keys: tuple[str, ...] = KEYS, baseline: str | None = None) -> DataFrame:
    """The thirteen cost and quality figures of a group, relative to its baseline class.

    A prediction that isn't one of the example's routes is left out of everything; a result without output counts and
    adds nothing to the predicted sums. A group in which nothing counts has zeros, and 1 for what is captured.
    """
    chosen = pairs.select(*keys).distinct().withColumn("baseline", F.lit(baseline)) if baseline else baseline_class(pairs, keys)
    joined = pairs.join(chosen, list(keys))
    counted = F.col("pred").isNull() | F.map_contains_key("routes", F.coalesce("pred", F.lit(NO_OUTPUT)))
    value = lambda route, field: micro(F.element_at("routes", F.col(route))[field])
    cols = [value("baseline", "cost"), value("baseline", "quality_score"), value("pred", "cost"), value("pred", "quality_score"), value("route", "cost"), value("route", "quality_score"), micro(F.col("cost"))]
    sums = joined.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(counted, c)), F.lit(0)).alias(f"_{n}") for c, n in zip(cols, COST_QUALITY)])
    s = {n: F.col(f"_{n}") for n in COST_QUALITY}
    change = lambda new, base: F.when(base != 0, (new - base) / base).otherwise(0.0)
    q, oq = change(s["predicted_quality"], s["baseline_quality"]), change(s["oracle_quality"], s["baseline_quality"])
    return sums.select(
        *keys, *[(s[n] / 1e6).alias(n) for n in COST_QUALITY],
        change(s["predicted_cost"], s["baseline_cost"]).alias("cost_change"), change(s["predicted_cost"] + s["routing_overhead"], s["baseline_cost"]).alias("cost_change_with_overhead"),
        q.alias("quality_change"), change(s["oracle_cost"], s["baseline_cost"]).alias("oracle_cost_change"), oq.alias("oracle_quality_change"),
        F.when(oq != 0, (1 + q) / (1 + oq)).otherwise(1.0).alias("oracle_quality_captured"),
    )


def hallucination_report(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, n_skipped, and the labels predicted that aren't routes (the first five by name)."""
    odd = pairs.where(F.col("pred").isNotNull() & ~F.map_contains_key("routes", F.col("pred")))
    labels = odd.groupBy(*keys, "pred").agg(F.count("*").alias("n"))  # few rows a group remain to be listed
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pred"))
    return labels.withColumn("r", rank).groupBy(*keys).agg(F.sum("n").alias("n_skipped"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("pred")))).alias("labels"))


def run_summary(results: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """total, succeeded, failed, total_cost (a null cost is 0) of all results, and start, end, duration if there are times."""
    out = [F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), (F.sum(micro(F.col("cost"))) / 1e6).alias("total_cost")]
    if "finished_at" in results.columns:
        seconds = (F.unix_micros(F.max("finished_at")) - F.unix_micros(F.min("started_at"))) / 1e6
        out += [F.min("started_at").alias("start_time"), F.max("finished_at").alias("end_time"), seconds.alias("duration_seconds")]
    return results.groupBy(*keys).agg(*out)


def error_analysis(results: DataFrame, examples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, expected, predicted, n: all results, with labels for what has no route; unknown examples are "unknown"."""
    joined = results.join(examples.select(F.col("id").alias("example_id"), F.col("route").alias("_route")), "example_id", "left")
    predicted = F.when(F.col("error").isNotNull(), "(error)").when(F.col("output").isNull(), "(no output)").otherwise(F.coalesce("output.route", F.lit("(no route)")))
    return joined.groupBy(*keys, F.coalesce("_route", F.lit("unknown")).alias("expected"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def error_totals(results: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, total, errors, error_rate (to four places) of all results."""
    out = results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out.withColumn("error_rate", F.round(F.col("errors") / F.col("total"), 4))


def baseline_strategies(examples: DataFrame, results: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, strategy, route, cost, quality: always the cheapest route, always the most capable one, and the predictions.

    Means are over all examples; predictions with an error or of an unknown route add nothing.
    """
    each = examples.select(F.explode("routes").alias("class", "r")).groupBy("class").agg(F.sum(micro(F.col("r.cost"))).alias("c"), F.sum(micro(F.col("r.quality_score"))).alias("q"), F.count("*").alias("n"))
    mean_c, mean_q = F.col("c") / F.col("n"), F.col("q") / F.col("n")
    best = each.agg(F.min_by(F.struct("class", "c", "q"), F.struct(mean_c, "class")).alias("cheap"), F.min_by(F.struct("class", "c", "q"), F.struct(-mean_q, "class")).alias("able"))
    total = examples.agg(F.count("*").alias("n"))
    fixed = best.select(F.inline(F.array(F.struct(F.lit("always_cheapest").alias("strategy"), "cheap.*"), F.struct(F.lit("always_capable").alias("strategy"), "able.*"))))
    pairs = pair_results(results, examples, keys).where(F.map_contains_key("routes", F.coalesce("pred", F.lit(NO_OUTPUT))))
    made = pairs.groupBy(*keys).agg(F.sum(micro(F.element_at("routes", F.col("pred"))["cost"])).alias("c"), F.sum(micro(F.element_at("routes", F.col("pred"))["quality_score"])).alias("q"))
    groups = results.select(*keys).distinct()
    out = groups.join(F.broadcast(fixed)).unionByName(made.select(*keys, F.lit("optimized").alias("strategy"), F.lit(None).cast("string").alias("class"), "c", "q"))  # two rows
    return out.join(F.broadcast(total)).select(*keys, "strategy", F.col("class").alias("route"), (F.col("c") / F.col("n") / 1e6).alias("cost"), (F.col("q") / F.col("n") / 1e6).alias("quality"))  # one row


def oracle_distribution(examples: DataFrame) -> DataFrame:
    """Per oracle route: n, mean cost and quality, how often it is on its row's Pareto front, and how often a cheaper route is as good."""
    own = F.element_at("routes", F.col("route"))
    c, q = F.coalesce(own["cost"], F.lit(0.0)), F.coalesce(own["quality_score"], F.lit(0.0))

    def other(test: Callable[[Column, Column], Column]) -> Column:
        return F.exists(F.map_values("routes"), lambda r: test(F.coalesce(r["cost"], F.lit(0.0)), F.coalesce(r["quality_score"], F.lit(0.0))))

    dominated = other(lambda rc, rq: (rc <= c) & (rq >= q) & ((rc < c) | (rq > q)))
    cheaper = other(lambda rc, rq: (rc < c) & (rq >= q))
    rows = examples.where(F.map_contains_key("routes", F.coalesce("route", F.lit(NO_OUTPUT)))).select("route", micro(own["cost"]).alias("c"), micro(own["quality_score"]).alias("q"), (~dominated).alias("front"), cheaper.alias("cheaper"))
    return rows.groupBy("route").agg(
        F.count("*").alias("n"), (F.sum("c") / F.count("*") / 1e6).alias("mean_cost"), (F.sum("q") / F.count("*") / 1e6).alias("mean_quality"),
        F.count_if("front").alias("n_pareto"), F.count_if("cheaper").alias("n_cheaper_as_good"))


TOKEN_KINDS = ("input", "cached", "cache_write_5m", "cache_write_1h", "output")


def price_results(usage: DataFrame, pricing: DataFrame, on: tuple[str, ...] = ("provider", "model")) -> DataFrame:
    """usage plus priced_cost: rates per million tokens times tokens, null without a price. pricing is a small table."""
    rates = pricing.select(*on, *[F.col(k).alias(f"_{k}") for k in TOKEN_KINDS])
    cost = sum((F.coalesce(F.col(f"{k}_tokens"), F.lit(0)) * F.col(f"_{k}") for k in TOKEN_KINDS), F.lit(0.0)) / 1e6
    return usage.join(rates, list(on), "left").withColumn("priced_cost", cost).drop(*[f"_{k}" for k in TOKEN_KINDS])


def long_metrics(wide: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, key, value: one row a figure."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names])))


class MetricRegistry:
    """Metrics by name: functions of pairs (and parameters) that give keys, key, value."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, function: Callable[..., DataFrame]) -> None:
        self.known[name] = function

    def compute(self, pairs: DataFrame, configs: list[tuple[str, dict]], keys: tuple[str, ...] = KEYS) -> DataFrame:
        """The union of the metrics named; an unknown name is an error, and so is an output key of two metrics."""
        unknown = [n for n, _ in configs if n not in self.known]
        if unknown:
            raise KeyError(f"unknown metrics: {', '.join(unknown)}")
        outs = [self.known[n](pairs, **params).select(*keys, "key", F.col("value").cast("double"), F.lit(i).alias("_metric")) for i, (n, params) in enumerate(configs)]
        every = outs[0]
        for o in outs[1:]:
            every = every.unionByName(o)
        clash = F.assert_true(F.size(F.collect_set("_metric")) == 1, F.concat(F.lit("two metrics give the key "), F.first("key")))
        return every.groupBy(*keys, "key").agg(F.when(clash.isNull(), F.first("value")).alias("value"))


def per_group_metric(pairs: DataFrame, function: Callable, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A metric in Python: function gets the (true, pred, n) cells of a group as a pandas frame and returns a dict."""
    cells = confusion_cells(pairs, keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = function(frame.rename(columns={"true_route": "true", "pred_route": "pred"}))
        head = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "key": k, "value": float(v)} for k, v in out.items()], columns=[*keys, "key", "value"])

    kinds = ", ".join(f"`{k}` {dict(cells.dtypes)[k]}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(run, f"{kinds}, key string, value double")


class PairMetric:
    """A user's metric over pairs, in parts that tasks work out and one shuffle brings together.

    columns are the columns of pairs it needs, parameters are its attributes. start() gives an empty state, add(state,
    frame) takes a pandas frame of pairs in, merge(a, b) joins two states, finish(state) gives a dict of figures. States
    are pickled, so they should be small; merge must not mind the order.
    """

    columns: tuple[str, ...] = ("route", "pred")

    def start(self):
        raise NotImplementedError

    def add(self, state, frame):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state) -> dict[str, float]:
        raise NotImplementedError


#: States that a task holds at once; with more groups it puts out what it has.
HELD_STATES = 10_000


def pair_metric(pairs: DataFrame, metric: PairMetric, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, key, value: the figures of a PairMetric in each group."""
    types = dict(pairs.dtypes)
    kinds = "".join(f"`{k}` {types[k]}, " for k in keys)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}

        def put() -> pd.DataFrame:
            return pd.DataFrame([(*k, pickle.dumps(x)) for k, x in states.items()], columns=[*keys, "state"])

        for frame in frames:
            groups = frame.groupby(list(keys), sort=False, dropna=False) if keys else [((), frame)]
            for key, part in groups:
                states[key] = metric.add(states[key] if key in states else metric.start(), part)
            if len(states) > HELD_STATES:
                yield put()
                states.clear()
        yield put()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        state = reduce(metric.merge, map(pickle.loads, frame["state"]))
        head = [frame[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, k, float(v)) for k, v in metric.finish(state).items()], columns=[*keys, "key", "value"])

    held = pairs.select(*keys, *[c for c in metric.columns if c not in keys]).mapInPandas(parts, f"{kinds}state binary")
    return held.groupBy(*keys).applyInPandas(merged, f"{kinds}key string, value double")
