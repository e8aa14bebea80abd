"""Bootstrap confidence intervals of all metrics, from sufficient statistics.

Every metric is a function of sums by cell (true route, predicted route), so a resample is a weight a pair: whole
Poisson weights from a hash of the pair's id and the replicate, the same at any partitioning. A task adds up the
weighted sums of its cells for a block of replicates at a time; what is shuffled grows with tasks, cells and
replicates, not with rows times replicates. The baseline class is chosen anew in every replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.metrics import COST_QUALITY, NO_OUTPUT, micro

#: Replicates worked on at a time, which bounds a task's memory.
_BLOCK = 256


def replicates_for(n: int) -> int:
    """10,000 from 200 pairs on, else 2,000."""
    return 10_000 if n >= 200 else 2_000


def poisson_cuts(most: int = 12) -> np.ndarray:
    """Distribution function of Poisson(1) at 0, 1, ...: a uniform number's weight is how many of these it reaches."""
    mass = np.cumprod(np.concatenate([[np.exp(-1.0)], 1.0 / np.arange(1, most)]))
    return np.cumsum(mass)


#: The same cuts in 65,536ths, and the weight of each of these.
CUTS = np.unique(np.round(poisson_cuts() * 65_536).astype(np.int64))
_WEIGHTS = np.searchsorted(CUTS, np.arange(65_536), side="right").astype(np.uint8)
# Multipliers of a 32-bit hash finaliser, and the golden ratio in 32 bits.
MIX, GOLDEN = (2246822507, 3266489909), 2654435769


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def weights(hashes: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Whole weights, rows by replicates, from 32-bit hashes."""
    starts = _mix(((replicates.astype(np.uint64) * GOLDEN + seed) % (1 << 32)).astype(np.uint32))
    return _WEIGHTS[_mix(hashes.astype(np.uint32)[:, None] + starts[None, :]) >> np.uint32(16)]


def id_hash(column: str = "id"):
    """32 bits of the MD5 of an id, as a whole number."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


_TOTALS = ("n", "pc", "pq", "oc", "oq", "ov", "counted")
_PER_CLASS = ("all_q", "all_n", "c", "q")


def resampled_sums(pairs: DataFrame, classes: list[str], n_replicates: int, seed: int, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """keys, true_route, pred_route, block and sums: for the block's replicates the weighted sums of a cell, in whole millionths.

    sums is a matrix of doubles (whole numbers), a row a measure: _TOTALS, then _PER_CLASS for each class. Pairs whose
    prediction isn't one of their routes count in n and in the means that choose the baseline only.
    """
    p, t = F.try_element_at("routes", F.col("pred")), F.element_at("routes", F.col("route"))
    counted = F.col("pred").isNull() | F.map_contains_key("routes", F.coalesce("pred", F.lit(NO_OUTPUT)))
    only = lambda x: F.when(counted, x).otherwise(0)
    measures = [F.lit(1), only(micro(p["cost"])), only(micro(p["quality_score"])), only(micro(t["cost"])), only(micro(t["quality_score"])), only(micro(F.col("cost"))), only(F.lit(1))]
    for name in classes:
        r = F.try_element_at("routes", F.lit(name))
        measures += [micro(r["quality_score"]), r.isNotNull().cast("int"), only(micro(r["cost"])), only(micro(r["quality_score"]))]
    rows = pairs.select(
        *keys, F.col("route").alias("true_route"), F.coalesce("pred", F.lit(NO_OUTPUT)).alias("pred_route"), id_hash().alias("h"), F.array(*[m.cast("double") for m in measures]).alias("x"))
    cell = [*keys, "true_route", "pred_route"]
    kinds = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in cell)
    made = f"{kinds}, block int, sums binary"
    size = len(measures)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        blocks = range(0, n_replicates, _BLOCK)
        for batch in batches:
            at: dict[tuple, list[int]] = {}
            for i, name in enumerate(zip(*(batch.column(c).to_pylist() for c in cell))):
                at.setdefault(name, []).append(i)
            h = batch.column("h").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for name, own in at.items():
                sums = held.setdefault(name, [np.zeros((size, min(_BLOCK, n_replicates - b))) for b in blocks])
                for k in range(0, len(own), 4_096):
                    part = own[k : k + 4_096]
                    for s, b in zip(sums, blocks):
                        s += x[part].T @ weights(h[part], np.arange(b, b + s.shape[1]), seed).astype(np.float64)
        for name, sums in held.items():
            n = len(sums)
            columns = [pa.array([v] * n, batch_type) for v, batch_type in zip(name, key_types)]
            yield pa.record_batch([*columns, pa.array(range(n), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], [*cell, "block", "sums"])

    key_types = [pa.string() if dict(rows.dtypes)[c] == "string" else pa.int64() if dict(rows.dtypes)[c] == "bigint" else pa.int32() for c in cell]

    def total(table: pa.Table) -> pa.Table:
        out = np.sum([np.frombuffer(b) for b in table["sums"].to_pylist()], axis=0)
        return table.slice(0, 1).set_column(table.schema.get_field_index("sums"), "sums", pa.array([out.tobytes()], pa.binary()))

    return rows.mapInArrow(add, made).groupBy(*cell, "block").applyInArrow(total, made)


def _metrics(table: pa.Table, keys: tuple[str, ...], classes: list[str]) -> pa.Table:
    """key, values of one group's block of replicates: the values that the metric has."""
    true, pred = table["true_route"].to_pylist(), table["pred_route"].to_pylist()
    size = len(_TOTALS) + len(_PER_CLASS) * len(classes)
    x = np.stack([np.frombuffer(b).reshape(size, -1) for b in table["sums"].to_pylist()])  # cell, measure, replicate
    n = x[:, 0]
    some = n.sum(0) > 0
    names = sorted({*true, *pred})
    found: dict[str, np.ndarray] = {}
    nan = np.where(some, 0.0, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = lambda a, b: np.where(b != 0, a / b, 0.0)
        found["accuracy"] = ratio(n[[a == b for a, b in zip(true, pred)]].sum(0), n.sum(0)) + nan
        support, predicted = ({c: n[[v == c for v in side]].sum(0) for c in names} for side in (true, pred))
        there = {c: np.where(support[c] + predicted[c] > 0, 0.0, np.nan) for c in names}
        cells = {(a, b): n[i] for i, (a, b) in enumerate(zip(true, pred))}
        f1s = []
        for c in names:
            for d in names:
                found[f"confusion/{c}/{d}"] = cells.get((c, d), 0.0) + there[c] + there[d]
            hits = cells.get((c, c), np.zeros(n.shape[1]))
            precision, recall = ratio(hits, predicted[c]), ratio(hits, support[c])
            f1 = ratio(2 * precision * recall, precision + recall)
            for key, value in (("precision", precision), ("recall", recall), ("f1", f1)):
                found[f"{key}/{c}"] = value + there[c]
            f1s.append(f1 + there[c])
        found["f1/macro"] = np.nansum(f1s, 0) / np.maximum((~np.isnan(f1s)).sum(0), 1) + nan
        sums = x.sum(0)
        per_class = sums[len(_TOTALS) :].reshape(len(classes), len(_PER_CLASS), -1)
        mean = np.where(per_class[:, 1] > 0, per_class[:, 0] / per_class[:, 1], -np.inf)
        best = mean.argmax(0)  # classes are in order, so the first by name among equals
        at = np.arange(x.shape[2])
        figures = dict(zip(("predicted_cost", "predicted_quality", "oracle_cost", "oracle_quality", "routing_overhead"), sums[1:6]))
        figures |= {"baseline_cost": per_class[best, 2, at], "baseline_quality": per_class[best, 3, at]}
        base_c, base_q = figures["baseline_cost"], figures["baseline_quality"]
        for key in COST_QUALITY:
            found[key] = figures[key] / 1e6 + nan
        changes = {
            "cost_change": ratio(figures["predicted_cost"] - base_c, base_c), "cost_change_with_overhead": ratio(figures["predicted_cost"] + figures["routing_overhead"] - base_c, base_c),
            "quality_change": ratio(figures["predicted_quality"] - base_q, base_q), "oracle_cost_change": ratio(figures["oracle_cost"] - base_c, base_c), "oracle_quality_change": ratio(figures["oracle_quality"] - base_q, base_q),
        }
        oq = changes["oracle_quality_change"]
        changes["oracle_quality_captured"] = np.where(oq != 0, (1 + changes["quality_change"]) / (1 + oq), 1.0)
        found |= {key: value + nan for key, value in changes.items()}
    head = [pa.array([table[k][0].as_py()] * len(found), table.schema.field(k).type) for k in keys]
    values = [v[~np.isnan(v)] for v in found.values()]
    return pa.table([*head, pa.array(list(found)), pa.array(values, pa.list_(pa.float64()))], [*keys, "key", "values"])


def percentile_intervals(values: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """keys, key, lower, upper, n_replicates: by index in the sorted values that a key has; keys with fewer than two are left out."""
    a = (1.0 - level) / 2.0
    lists = values.groupBy(*keys, "key").agg(F.array_sort(F.flatten(F.collect_list("values"))).alias("v")).withColumn("m", F.size("v")).where("m >= 2")  # one value a replicate
    at = lambda i: F.element_at("v", (i + 1).cast("int"))
    return lists.select(*keys, "key", at(F.floor(F.lit(a) * F.col("m"))).alias("lower"), at(F.least(F.floor(F.lit(1.0 - a) * F.col("m")), F.col("m") - 1)).alias("upper"), F.col("m").alias("n_replicates"))


def route_classes(pairs: DataFrame) -> list[str]:
    """All routes that examples have, in order: as few as there are models to choose from."""
    return sorted(r[0] for r in pairs.select(F.explode(F.map_keys("routes"))).distinct().collect())


def bootstrap_ci(pairs: DataFrame, n_replicates: int | None = None, seed: int = 7, level: float = 0.95, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """keys, key, lower, upper, n_replicates for accuracy, the confusion cells, precision, recall and F1 by class and on average, and all cost and quality figures.

    A key that some replicates lack (a class that isn't drawn) has fewer values. Without n_replicates, replicates_for
    the pairs of the smallest group. No pairs give no rows.
    """
    if n_replicates is None:
        n_replicates = replicates_for(pairs.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0)
    classes = route_classes(pairs)
    sums = resampled_sums(pairs, classes, n_replicates, seed, keys)
    kinds = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)
    values = sums.groupBy(*keys, "block").applyInArrow(lambda table: _metrics(table, keys, classes), f"{kinds}, key string, values array<double>")
    return percentile_intervals(values, level, keys)


def fixed_weight_sums(pairs: DataFrame, n_replicates: int, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """keys, replicate, n, hits with weights that SQL can make too: digits of the MD5 of id and replicate against the Poisson cuts."""
    cuts = [int(c * 1_000_000) for c in poisson_cuts(8)]
    rows = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))))
    u = F.conv(F.substring(F.md5(F.concat("id", F.lit("-"), "replicate")), 1, 8), 16, 10).cast("long") % 1_000_000
    w = sum(((F.col("_u") >= c).cast("int") for c in cuts), F.lit(0))
    rows = rows.withColumn("_u", u).withColumn("w", w)
    return rows.groupBy(*keys, "replicate").agg(F.sum("w").cast("long").alias("n"), F.sum(F.when(F.col("pred") == F.col("route"), F.col("w")).otherwise(0)).cast("long").alias("hits"))
