"""Pareto analytics on (quality up, cost down), per run: skyline, distances, hypervolume, knee, pruning and folds.

Frames have the key columns, version, quality and cost. Ties go by version.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import kept

KEYS = ("run_id",)


def pareto_front(points: DataFrame, keys: tuple[str, ...] = KEYS, locally: bool = False) -> DataFrame:
    """The rows that no other row dominates (as good and as cheap, and better in one); equal points all stay.

    Sorted, not compared in pairs: a point stays if its cost is the least of its quality and less than every cost at
    a higher quality. Quality levels are aggregated first, so the window sorts levels, not rows. With `locally`, every
    task first drops what its own rows dominate: use it where one run holds most rows.
    """
    base = points.mapInArrow(_local_front(tuple(keys)), points.schema) if locally else points
    levels = base.groupBy(*keys, "quality").agg(F.min("cost").alias("_least"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("quality")).rowsBetween(Window.unboundedPreceding, -1)
    open_levels = levels.withColumn("_before", F.min("_least").over(higher)).where("_before IS NULL OR _least < _before").select(*keys, "quality", F.col("_least").alias("cost"))
    return base.join(open_levels, [*keys, "quality", "cost"], "left_semi")


def _local_front(keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select([*keys, "quality", "cost"]).to_pandas().reset_index(names="_i")
            frame = frame.sort_values([*keys, "quality", "cost"], ascending=[True] * len(keys) + [False, True])
            group = frame.groupby(list(keys), dropna=False) if keys else frame.assign(_g=0).groupby("_g")
            least = group["cost"].cummin()
            keep = np.sort(frame["_i"][(frame["cost"] == least)].to_numpy())  # at or below all costs of as high a quality
            yield batch.take(pa.array(keep))

    return run


def crowding_distance(front: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """front plus distance: per axis the gap between the neighbours over the span; infinite at the ends and for two or fewer points."""
    group = Window.partitionBy(*keys)
    parts = []
    for axis in ("quality", "cost"):
        w = group.orderBy(axis, "version")
        span = F.max(axis).over(group) - F.min(axis).over(group)
        low, high = F.lag(axis).over(w), F.lead(axis).over(w)
        parts.append(F.when(low.isNull() | high.isNull(), F.lit(float("inf"))).when(span == 0, F.lit(0.0)).otherwise((high - low) / span))
    return front.withColumn("distance", F.when(F.count("*").over(group) <= 2, F.lit(float("inf"))).otherwise(parts[0] + parts[1]))


def reference_point(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, ref_quality, ref_cost: a tenth worse than the worst, by sign."""
    q, c = F.min("quality"), F.max("cost")
    return points.groupBy(*keys).agg(F.when(q > 0, q * 0.9).otherwise(-0.1).alias("ref_quality"), F.when(c > 0, c * 1.1).otherwise(0.1).alias("ref_cost"))


def hypervolume(front: DataFrame, reference: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, hypervolume: over ascending quality, the steps in quality times the cost below the reference, where both are positive."""
    w = Window.partitionBy(*keys).orderBy("quality", F.desc("cost"), "version")
    joined = front.join(reference, list(keys))
    step = F.col("quality") - F.lag("quality").over(w)
    first = F.col("quality") - F.col("ref_quality")
    rows = joined.withColumn("_dq", F.coalesce(step, first)).withColumn("_dc", F.col("ref_cost") - F.col("cost"))
    return rows.groupBy(*keys).agg(F.sum(F.when((F.col("_dq") > 0) & (F.col("_dc") > 0), F.col("_dq") * F.col("_dc")).otherwise(0.0)).alias("hypervolume"))


def knee_point(front: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a group: the point farthest from the line between the ends of lowest and of highest quality; of two points the better."""
    group = Window.partitionBy(*keys)
    low, high = F.min_by("cost", F.struct("quality", "version")).over(group), F.min_by("cost", F.struct(-F.col("quality"), F.col("version"))).over(group)
    least = F.min("quality").over(group)
    dq, dc = F.max("quality").over(group) - least, low - high
    x = (F.col("quality") - least) / F.when(dq != 0, dq).otherwise(1.0)  # the low end is at (0, 1), the high end at (1, 0)
    y = (F.col("cost") - high) / F.when(dc != 0, dc).otherwise(1.0)
    rows = front.withColumn("_n", F.count("*").over(group)).withColumn("_far", F.when(F.col("_n") <= 2, F.col("quality").cast("double")).otherwise(F.abs(x + y - 1)))
    rank = F.row_number().over(group.orderBy(F.desc("_far"), "version"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_n", "_far")


def rank_front(front: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """front plus place: by quality from high to low, then cost."""
    return front.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), "cost", "version")))


def near_misses(points: DataFrame, front: DataFrame, keys: tuple[str, ...] = KEYS, chunk: int = 100_000) -> DataFrame:
    """keys, version, dominated_by, quality_gap, cost_gap: each dominated point with the front member of the smallest gap sum that dominates it.

    A front in order of quality is a staircase, so the members that dominate a point are a stretch of it, and the
    smallest gap sum is that of the member with the least quality minus cost in the stretch. A run's points are dealt
    out in chunks of bounded size, each with the run's front beside it; no pair is formed. Of equal sums the first by name.
    """
    key = [F.col(k) for k in keys]
    sizes = points.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    dealt = points.join(sizes, list(keys)).select(*key, "version", "quality", "cost", F.pmod(F.xxhash64("version"), F.col("_chunks")).cast("int").alias("_chunk"))
    beside = front.join(sizes, list(keys)).select(*key, F.col("version").alias("name"), F.col("quality").alias("q"), F.col("cost").alias("c"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    kinds = dict(points.dtypes)
    made = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", version string, dominated_by string, quality_gap {kinds['quality']}, cost_gap {kinds['cost']}"
    names = [*keys, "version", "dominated_by", "quality_gap", "cost_gap"]

    def run(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if p.empty or f.empty:
            return pd.DataFrame(columns=names)
        f = f.sort_values(["q", "name"]).reset_index(drop=True)
        q, c = f["q"].to_numpy(), f["c"].to_numpy()
        order = f.assign(s=q - c).sort_values(["s", "name"]).index.to_numpy()
        rank = np.empty(len(f), np.int64)
        rank[order] = np.arange(len(f))
        low = np.searchsorted(q, p["quality"].to_numpy(), "left")
        high = np.searchsorted(c, p["cost"].to_numpy(), "right")
        first = np.minimum(low, len(f) - 1)  # one point of the front at most has this quality; another one may have this cost
        on_front = (low < high) & (q[first] == p["quality"].to_numpy()) & (c[first] == p["cost"].to_numpy())
        some = (low < high) & ~on_front
        p, low, high = p[some], low[some], high[some]
        best = order[_range_least(rank, low, high)]
        out = p[[*keys, "version"]].assign(dominated_by=f["name"].to_numpy()[best], quality_gap=q[best] - p["quality"].to_numpy(), cost_gap=p["cost"].to_numpy() - c[best])
        return out[names]

    group = [*keys, "_chunk"]
    return dealt.groupBy(*group).cogroup(_renewed(beside).groupBy(*group)).applyInPandas(run, made)


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own: two frames that come from one table can then meet in a cogroup."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _range_least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low:high] for many non-empty stretches, from minima over stretches of powers of two."""
    levels = [x]
    while 2 << len(levels) - 1 <= len(x):
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    k = np.frexp((high - low).astype(float))[1] - 1
    out = np.empty(len(low), x.dtype)
    for i, level in enumerate(levels):
        at = k == i
        out[at] = np.minimum(level[low[at]], level[high[at] - (1 << i)])
    return out


def fronts_by_round(points: DataFrame, rounds: DataFrame, keys: tuple[str, ...] = KEYS, axes: tuple[str, str] = ("quality", "cost")) -> DataFrame:
    """keys, round, version, quality, cost, is_new: the front among all points introduced by each round of the run.

    axes names the two columns: the changes against the baseline, or the absolute figures. Each round's own points are
    cut to their skyline first; a run's fold then joins the front so far with the next round's skyline.
    """
    named = points.select(*keys, "round", "version", F.col(axes[0]).alias("quality"), F.col(axes[1]).alias("cost"))
    own = pareto_front(named, (*keys, "round"))
    every = own.withColumn("_p", F.lit(True)).unionByName(rounds.select(*keys, "round").distinct().withColumn("_p", F.lit(False)), allowMissingColumns=True)
    out = named.limit(0).withColumn("is_new", F.lit(True)).select(*keys, "round", "version", "quality", "cost", "is_new").schema
    names = out.names

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asked = set(frame["round"][~frame["_p"].astype(bool)])
        front, outs = frame.iloc[:0], []
        for r, new in frame.groupby("round", sort=True):
            front = _skyline(pd.concat([front, new[new["_p"].astype(bool)]]))
            if r in asked:
                outs.append(front.assign(is_new=front["round"] == r).assign(round=r)[names])
        return pd.concat(outs) if outs else frame.iloc[:0].assign(is_new=True)[names]

    return every.groupBy(*keys).applyInPandas(run, out)


def journey(points: DataFrame, rounds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, round, version, quality, cost: the best point (quality, then cost) introduced by each round; none before the first."""
    best = points.groupBy(*keys, "round").agg(F.max(F.struct(F.col("quality").alias("q"), (-F.col("cost")).alias("c"))).alias("m"), F.min_by("version", F.struct(-F.col("quality"), F.col("cost"), F.col("version"))).alias("v"))
    every = rounds.select(*keys, "round").distinct().join(best, [*keys, "round"], "left")
    w = Window.partitionBy(*keys).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct("m", (-F.col("round")).alias("r"), F.col("v"))).over(w)
    return every.withColumn("_t", F.when(F.col("m").isNull() & F.max(F.when(F.col("m").isNotNull(), 1)).over(w).isNull(), F.lit(None)).otherwise(top)).where("_t IS NOT NULL").select(
        *keys, "round", F.col("_t.v").alias("version"), F.col("_t.m.q").alias("quality"), (-F.col("_t.m.c")).alias("cost"))


def front_improvement(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, improvement: how much the best quality rose, at least 0; all of it where there was no front."""
    a = old.groupBy(*keys).agg(F.max("quality").alias("_a"))
    b = new.groupBy(*keys).agg(F.max("quality").alias("_b"))
    return b.join(a, list(keys), "left").select(*keys, F.when(F.col("_a").isNull(), F.col("_b")).otherwise(F.greatest(F.lit(0), F.col("_b") - F.col("_a"))).alias("improvement"))


def candidate_points(candidates: DataFrame, metrics: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per version the relative and the absolute point, to four places; absolute cost has the overhead in it.

    Stored values stand in where the metrics have none; an absolute cost that is nowhere is 0.
    """
    m = metrics.select(*keys, "version", *[F.col(c).alias(f"_{c}") for c in ("quality_change", "cost_change_with_overhead", "predicted_quality", "predicted_cost", "routing_overhead")])
    j = candidates.join(m, [*keys, "version"], "left")
    return j.select(
        *keys, "version", F.round(F.coalesce("_quality_change", "quality"), 4).alias("quality_delta"), F.round(F.coalesce("_cost_change_with_overhead", "cost"), 4).alias("cost_delta"),
        F.round(F.coalesce("_predicted_quality", "quality"), 4).alias("quality_abs"), F.round(F.coalesce(F.col("_predicted_cost") + F.coalesce("_routing_overhead", F.lit(0.0)), "cost", F.lit(0.0)), 4).alias("cost_abs"))


def absolute_marks(metrics: DataFrame, targets: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, mark ("target", "oracle"), quality_delta, cost_delta, quality_abs, cost_abs: marks of a run as changes and in absolute figures, to six places.

    A run's baseline and oracle are the same for all its versions, so the first by name that has them gives them. The
    target for quality is the first upward one by metric, that for cost the first downward one; what is missing is null.
    """
    named = ("baseline_quality", "baseline_cost", "oracle_quality_change", "oracle_cost_change")
    first = metrics.where(" AND ".join(f"{c} IS NOT NULL" for c in named)).groupBy(*keys).agg(F.min_by(F.struct(*named), "version").alias("m")).select(*keys, "m.*")
    up, down = F.col("operator").isin(">=", ">"), F.col("operator").isin("<=", "<")
    wanted = targets.agg(*[F.min_by(F.when(side, F.col("threshold")), F.when(side, F.col("metric"))).alias(name) for side, name in ((up, "tq"), (down, "tc"))])
    absolute = lambda base, change: F.round(F.col(base) * (1 + change), 6)
    mark = lambda name, q, c: F.struct(
        F.lit(name).alias("mark"), F.round(q, 6).alias("quality_delta"), F.round(c, 6).alias("cost_delta"), absolute("baseline_quality", q).alias("quality_abs"), absolute("baseline_cost", c).alias("cost_abs"))
    marks = F.array(mark("target", F.col("tq"), F.col("tc")), mark("oracle", F.col("oracle_quality_change"), F.col("oracle_cost_change")))
    return first.join(F.broadcast(wanted)).select(*keys, F.inline(marks))  # one row


# Folds whose state goes from step to step: one small group a run


def _distances(values: list[np.ndarray], orders: list[np.ndarray]) -> np.ndarray:
    """Crowding distances, given the order of the points on each axis: ends are infinitely far."""
    total = np.zeros(len(orders[0]))
    for v, order in zip(values, orders):
        at, span = v[order], v[order[-1]] - v[order[0]]
        gaps = np.full(len(v), math.inf)
        gaps[1:-1] = (at[2:] - at[:-2]) / span if span else 0.0
        total[order] += gaps
    return total


def _pruned(front: pd.DataFrame, size: int) -> pd.DataFrame:
    """The front less its most crowded points, one after the other.

    A point that goes is inside on both axes, so the spans stay and only its neighbours' distances change: the axes are
    linked lists, and a heap has the distances, of which outdated ones are passed over. That is O(n log n).
    """
    n = len(front)
    if n <= size:
        return front
    values = [front[axis].to_numpy(float) for axis in ("quality", "cost")]
    version = pd.factorize(front["version"], sort=True)[0]
    orders = [np.lexsort((version, v)) for v in values]
    d = _distances(values, orders)
    safe = {int(np.lexsort((version, -values[0]))[0]), int(orders[1][0])}
    spans = [v[o[-1]] - v[o[0]] for v, o in zip(values, orders)]
    links = []
    for o in orders:
        before, after = np.full(n, -1), np.full(n, -1)
        before[o[1:]], after[o[:-1]] = o[:-1], o[1:]
        links.append((before.tolist(), after.tolist()))
    heap = [(d[i], version[i], i) for i in range(n) if i not in safe]
    heapq.heapify(heap)
    current, left = d.tolist(), np.ones(n, bool)
    for _ in range(n - size):
        while heap and (not left[heap[0][2]] or heap[0][0] != current[heap[0][2]]):
            heapq.heappop(heap)
        if not heap:
            break
        if heap[0][0] == math.inf:  # only ends of an axis are left: a handful, and spans change
            return _pruned_ends(front[left], size)
        gone = heapq.heappop(heap)[2]
        left[gone] = False
        touched = set()
        for before, after in links:
            a, b = before[gone], after[gone]
            after[a], before[b] = b, a
            touched |= {a, b}
        for i in touched:
            far = 0.0
            for v, span, (before, after) in zip(values, spans, links):
                inside = before[i] >= 0 and after[i] >= 0
                far += ((v[after[i]] - v[before[i]]) / span if span else 0.0) if inside else math.inf
            if far != current[i]:
                current[i] = far
                if i not in safe:
                    heapq.heappush(heap, (far, version[i], i))
    return front[left]


def _pruned_ends(front: pd.DataFrame, size: int) -> pd.DataFrame:
    """The same where no point is inside on both axes."""
    while len(front) > size:
        values = [front[axis].to_numpy(float) for axis in ("quality", "cost")]
        version = pd.factorize(front["version"], sort=True)[0]
        orders = [np.lexsort((version, v)) for v in values]
        safe = {int(np.lexsort((version, -values[0]))[0]), int(orders[1][0])}
        d = _distances(values, orders) if len(front) > 2 else np.full(len(front), math.inf)
        rest = [i for i in range(len(front)) if i not in safe]
        if not rest:
            break
        front = front.drop(index=front.index[min(rest, key=lambda i: (d[i], version[i]))])
    return front


def _skyline(frame: pd.DataFrame) -> pd.DataFrame:
    if frame.empty:
        return frame
    level = frame.groupby("quality")["cost"].min().sort_index(ascending=False)
    before = level.cummin().shift(1, fill_value=math.inf)
    keep = level[level < before]
    return frame[frame["cost"] == frame["quality"].map(keep)]


def prune_to_size(front: DataFrame, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The front with the least crowded points: drops the smallest distance again and again, never the best quality or cost.

    A run's front meets in one task: the order in which points go depends on all of them.
    """
    return front.groupBy(*keys).applyInPandas(lambda f: _pruned(f, size), front.schema)


class Staircase:
    """The points that no other one taken in dominates, by quality."""

    def __init__(self):
        self.qualities: list[float] = []
        self.costs: list[float] = []

    def takes(self, quality: float, cost: float) -> bool:
        """Takes a point in, with what it dominates going, unless one is as good and as cheap."""
        qs, cs = self.qualities, self.costs
        at = bisect.bisect_left(qs, quality)
        if at < len(qs) and cs[at] <= cost:
            return False
        if at < len(qs) and qs[at] == quality:
            cs[at] = cost
        else:
            qs.insert(at, quality)
            cs.insert(at, cost)
        low = bisect.bisect_left(cs, cost, 0, at)
        del qs[low:at], cs[low:at]
        return True


def incremental_front(points: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """points plus accepted and on_front: inserted in order (then by version), a point is turned away if a member dominates or equals it, and evicts what it dominates.

    A point is accepted if no earlier one is as good and as cheap, and stays if no later one evicts it. Spark cuts the
    order into ranges, and each task runs through its range with a staircase of its own: what that turns away would be
    turned away anyhow. Only the others, four columns of them, meet in the fold over a run's ranges.
    """
    spark, names = points.sparkSession, points.columns
    kinds = ", ".join(f"`{n}` {t}" for n, t in points.dtypes)

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, run, stairs, n = TaskContext.get().partitionId(), None, None, 0
        for frame in frames:
            taken = np.zeros(len(frame), bool)
            runs = list(zip(*[frame[k] for k in keys])) if keys else [()] * len(frame)
            for i, (own, q, c) in enumerate(zip(runs, frame["quality"], frame["cost"])):
                if own != run:
                    run, stairs = own, Staircase()
                taken[i] = stairs.takes(q, c)
            yield frame.assign(_block=block, _at=np.arange(n, n + len(frame)), _taken=taken)
            n += len(frame)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, stairs = frame.sort_values(["_block", "_at"]), Staircase()
        taken = [stairs.takes(q, c) for q, c in zip(frame["quality"], frame["cost"])]
        return frame.loc[taken, ["_block", "_at"]]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(parts, *keys, order, "version").sortWithinPartitions(*keys, order, "version")
    run = kept(ranged.mapInPandas(through, f"{kinds}, _block long, _at long, _taken boolean"), "front-ranges")
    taken = run.where("_taken").select(*keys, "quality", "cost", "_block", "_at").groupBy(*keys).applyInPandas(fold, "_block long, _at long").withColumn("accepted", F.lit(True))
    last = pareto_front(points, keys).groupBy(*keys, "quality", "cost").agg(F.min(F.struct(order, "version")).alias("_first"))
    j = run.join(taken, ["_block", "_at"], "left").join(last, [*keys, "quality", "cost"], "left")
    on = F.coalesce((F.col(order) == F.col(f"_first.{order}")) & (F.col("version") == F.col("_first.version")), F.lit(False))
    return j.select(*names, F.coalesce("accepted", F.lit(False)).alias("accepted"), on.alias("on_front"))


def fronts_before(points: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "round") -> DataFrame:
    """keys, order, quality, cost: for each step of the order the front of all steps before it, each point once."""
    own = pareto_front(points.select(*keys, order, "quality", "cost"), (*keys, order)).distinct()
    names = own.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        front, outs = frame.iloc[:0], []
        for step, new in frame.groupby(order, sort=True):
            outs.append(front.assign(**{order: step})[names])
            front = _skyline(pd.concat([front, new])).drop_duplicates(["quality", "cost"])
        return pd.concat(outs).astype(frame.dtypes.to_dict())

    return own.groupBy(*keys).applyInPandas(run, own.schema)


def elite_set(old: DataFrame, new: DataFrame, size: int = 7, keys: tuple[str, ...] = KEYS, cold_start: bool = False) -> DataFrame:
    """keys, version, quality, cost, is_new: old members and new points, of which the front, pruned to size.

    New placeholders at (0, 0) go; of a version that both have, the new point counts, and is_new marks versions that
    weren't members. With cold_start, the first round of a run, all that is scored stays.
    """
    fresh = new.where("NOT (quality = 0 AND cost = 0)")
    both = old.select(*keys, "version", "quality", "cost", F.lit(False).alias("is_new")).unionByName(fresh.select(*keys, "version", "quality", "cost", F.lit(True).alias("is_new")))
    rows = both.groupBy(*keys, "version").agg(F.max_by(F.struct("quality", "cost"), F.struct("is_new", "quality", -F.col("cost"))).alias("p"), F.min("is_new").alias("is_new"))
    rows = rows.select(*keys, "version", "p.*", "is_new")
    return rows if cold_start else prune_to_size(pareto_front(rows, keys), size, keys)


ROUND_SCHEMA = (
    "round int, elite_size int, new_entries int, hypervolume double, improvement double, stagnation int, epsilon double, evaluated int, spread double, routing_cost double,"
    " backtracked boolean, converged boolean, reason string"
)


def advance_rounds(
    points: DataFrame, keys: tuple[str, ...] = KEYS, epsilon: float = 0.001, limit: int = 5, max_rounds: int = 50, budget: int = 60, size: int = 7,
    least_epsilon: float = 0.0005, backtrack: int = 2, met: str | None = None,
) -> DataFrame:
    """One row a round of a run, until it converges: elite set, hypervolume, stagnation, epsilon and convergence.

    points has round, version, quality and cost, may have eval_status (only "complete" and null are scored) and the
    boolean column `met`, which marks points that meet all targets. A round's reference point comes from the elite set
    before it and its scored points. The first round keeps all of them (placeholders at (0, 0) never enter) and can't
    stagnate; later ones keep the front, pruned to size. Stagnation grows where the hypervolume, relative to the one
    before if that is above 0, doesn't rise by more than epsilon, and restarts otherwise. Once a member meets all
    targets, epsilon is halved, once, to least_epsilon at least, and stagnation restarts. A round in which nothing is
    scored keeps the elite set and adds to stagnation. Converged: the budget is used up and stagnation at its limit, or
    the last round. evaluated counts all points so far, improvement is the rise of the hypervolume, at least 0.

    Spark cuts each round to counts and its skyline (with points of versions that come up in several rounds); only
    these meet in the fold of a run. Of a version's points in one round the better counts.
    """
    scored = F.coalesce(F.col("eval_status") == "complete", F.lit(True)) if "eval_status" in points.columns else F.lit(True)
    head = F.row_number().over(Window.partitionBy(*keys).orderBy("round"))
    steps = points.select(*keys, "round").distinct().withColumn("_step", head.cast("int"))
    rows = points.select(*keys, "round", "version", F.col("quality").cast("double"), F.col("cost").cast("double"), F.coalesce(F.col(met) if met else F.lit(False), F.lit(False)).alias("_met"), scored.alias("_ok"))
    rows = rows.join(steps, [*keys, "round"])
    ok = lambda c: F.when(F.col("_ok"), F.col(c))
    totals = rows.groupBy(*keys, "round", "_step").agg(
        F.count("*").alias("_n"), F.count_if("_ok").alias("_scored"), F.min(ok("quality")).alias("_q"), F.max(ok("cost")).alias("_c"), F.sum(ok("cost")).alias("_spent"))
    entered = rows.where("_ok AND NOT (quality = 0 AND cost = 0)").groupBy(*keys, "_step", "version").agg(F.max_by(F.struct("quality", "cost", "_met"), F.struct("quality", -F.col("cost"))).alias("p")).select(*keys, "_step", "version", "p.*")
    # the first round keeps dominated points too: what they add is a few figures
    cold = entered.where("_step = 1")
    reference = totals.where("_step = 1").select(*keys, F.when(F.col("_q") > 0, F.col("_q") * 0.9).otherwise(-0.1).alias("ref_quality"), F.when(F.col("_c") > 0, F.col("_c") * 1.1).otherwise(0.1).alias("ref_cost"))
    levels = cold.groupBy(*keys, "quality").agg(F.max("cost").alias("cost")).withColumn("version", F.lit(""))
    first = cold.groupBy(*keys).agg(F.count("*").alias("_size"), F.min("quality").alias("_low"), F.max("quality").alias("_high"), F.max("cost").alias("_dear"), F.bool_or("_met").alias("_any")).join(hypervolume(levels, reference, keys), list(keys)).withColumn("_step", F.lit(1))
    totals = totals.join(first, [*keys, "_step"], "left")
    again = entered.groupBy(*keys, "version").agg(F.count("*").alias("_times")).where("_times > 1").select(*keys, "version")
    few = pareto_front(entered, (*keys, "_step")).unionByName(entered.join(again, [*keys, "version"], "left_semi")).distinct()
    kinds = dict(points.dtypes)
    made = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ROUND_SCHEMA
    fold = partial(_fold, keys=keys, epsilon=epsilon, limit=limit, max_rounds=max_rounds, budget=budget, size=size, least_epsilon=least_epsilon, backtrack=backtrack)
    return totals.groupBy(*keys).cogroup(_renewed(few).groupBy(*keys)).applyInPandas(fold, made)


def _volume(front: pd.DataFrame, reference: tuple[float, float]) -> float:
    total, q0 = 0.0, reference[0]
    for q, c in front.sort_values(["quality", "cost"], ascending=[True, False])[["quality", "cost"]].itertuples(index=False):
        if q > q0 and reference[1] > c:
            total += (q - q0) * (reference[1] - c)
        q0 = q
    return total


def _fold(totals: pd.DataFrame, few: pd.DataFrame, keys, epsilon, limit, max_rounds, budget, size, least_epsilon, backtrack) -> pd.DataFrame:
    out, elite, count, spread, volume, stagnation, halved, evaluated = [], few.iloc[:0], 0, 0.0, 0.0, 0, False, 0
    low, dear = math.inf, -math.inf  # of the elite set
    for t in totals.sort_values("_step").to_dict("records"):
        step, before, entries = t["_step"], volume, 0
        evaluated += int(t["_n"])
        if not t["_scored"]:
            stagnation += 1
        else:
            new = few[few["_step"] == step]
            low, dear = min(low, t["_q"]), max(dear, t["_c"])
            if step == 1:
                count = entries = 0 if pd.isna(t["_size"]) else int(t["_size"])
                elite, volume, reached = new, t["hypervolume"] if count else 0.0, bool(count and t["_any"])
                spread = t["_high"] - t["_low"] if count > 1 else 0.0
                low, dear = (t["_low"], t["_dear"]) if count else (math.inf, -math.inf)
            else:
                reference = (low * 0.9 if low > 0 else -0.1, dear * 1.1 if dear > 0 else 0.1)
                had = set(elite["version"])
                elite = _pruned(_skyline(pd.concat([elite, new]).drop_duplicates("version", keep="last")), size)
                count, entries = len(elite), len(set(elite["version"]) - had)
                volume, reached = _volume(elite, reference), bool(elite["_met"].any())
                gain = (volume - before) / before if before > 0 else volume
                stagnation = 0 if gain > epsilon else stagnation + 1
                spread = float(elite["quality"].max() - elite["quality"].min()) if count > 1 else 0.0
                low, dear = (elite["quality"].min(), elite["cost"].max()) if count else (math.inf, -math.inf)
            if reached and not halved:
                epsilon, stagnation, halved = max(epsilon / 2, least_epsilon), 0, True
        last = step >= max_rounds
        converged = (evaluated >= budget and stagnation >= limit) or last
        out.append({
            **{k: t[k] for k in keys}, "round": t["round"], "elite_size": count, "new_entries": entries, "hypervolume": volume, "improvement": max(0.0, volume - before), "stagnation": stagnation,
            "epsilon": epsilon, "evaluated": evaluated, "spread": spread, "routing_cost": 0.0 if pd.isna(t["_spent"]) else t["_spent"], "backtracked": stagnation >= backtrack, "converged": converged,
            "reason": ("max_rounds" if last else "stagnation") if converged else None,
        })
        if converged:
            break
    return pd.DataFrame(out)
