"""Fingerprints, splits, ids, and set operations on rows with identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the buckets of fingerprints and split ranks.
_DIGITS = 3


def dataset_fingerprint(examples: DataFrame) -> DataFrame:
    """fingerprint (16 hex digits) of all (id, input, route): any order of rows gives the same, a repeated row doesn't.

    Row hashes are gathered by their first six digits and hashed, those hashes by the first three, and then all: no
    group has more than 4,096 entries but the first ones, of which there are 16 million.
    """
    row = F.sha2(F.concat_ws("\t", F.coalesce("id", F.lit("")), F.coalesce("input", F.lit("")), F.coalesce("route", F.lit(""))), 256)
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)
    level = examples.select(row.alias("h")).withColumn("b", F.substring("h", 1, 6))
    for digits in (6, _DIGITS):
        level = level.groupBy(F.substring("b", 1, digits).alias("g")).agg(joined.alias("h")).select(F.col("g").alias("b"), "h")
    return level.agg(F.substring(joined, 1, 16).alias("fingerprint"))


def stratified_split(examples: DataFrame, dev_ratio: float = 0.2, seed: str = "") -> DataFrame:
    """examples plus split: per route, rounded half to even, n * (1 - dev_ratio) rows are holdout, the rest dev.

    A route with one row is dev. If no route has a holdout row, the ratio is taken over all rows; fewer than two rows
    are all dev. Rows are ordered by the hash of seed and id; ranks are counted by (route, bucket of the hash), so a
    large route isn't sorted in one task.
    """
    h = F.sha2(F.concat(F.lit(seed), F.coalesce("id", F.lit(""))), 256)
    rows = examples.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, _DIGITS))
    counts = rows.groupBy("route", "_b").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("route").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(below), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy("route")))
    wanted = lambda n: F.bround(n * (1.0 - dev_ratio)).cast("long")
    counts = counts.withColumn("_hold", F.when(F.col("_total") < 2, 0).otherwise(wanted(F.col("_total"))))
    whole = counts.groupBy("route").agg(F.max("_hold").alias("hold"), F.max("_total").alias("n")).agg(F.sum("hold").alias("_any"), F.sum("n").alias("_all"))
    own = Window.partitionBy("route", "_b").orderBy("_h", "id")
    c = counts.select(F.col("route").alias("_r"), F.col("_b").alias("_c"), "_base", "_hold")
    ranked = rows.join(c, F.col("route").eqNullSafe(F.col("_r")) & (F.col("_b") == F.col("_c"))).withColumn("_k", F.col("_base") + F.row_number().over(own))
    any_, all_ = whole.first()
    held = F.col("_k") <= F.col("_hold")
    if not any_ and (all_ or 0) > 1:  # every route has one row, or the ratio leaves none: a few rows, or a rank over all
        held = F.row_number().over(Window.orderBy("_h", "id")) <= wanted(F.lit(all_))
    return ranked.withColumn("split", F.when(held, "holdout").otherwise("dev")).select(*examples.columns, "split")


def split_report(split: DataFrame) -> DataFrame:
    """route, total, dev, holdout, dev_share, singleton."""
    out = split.groupBy("route").agg(F.count("*").alias("total"), F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "holdout").alias("holdout"))
    return out.withColumn("dev_share", F.col("dev") / F.col("total")).withColumn("singleton", F.col("total") == 1)


def add_missing_ids(rows: DataFrame, prefix: str = "row", start: int = 1) -> DataFrame:
    """rows with ids; the i-th row without one, by row_idx, is prefix-N with the i-th whole number from start that no id has.

    added marks them. Used numbers cut the whole numbers into gaps; the running count of free numbers before each gap
    places a rank by a range of ranks. Ranks are counted in two levels: by blocks of used numbers and of row_idx.
    """
    used_re = rf"^{prefix}-(0|[1-9]\d*)$"
    missing = F.col("id").isNull() | (F.trim("id") == "")
    used = rows.where(~missing).select(F.regexp_extract("id", used_re, 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).where(F.col("n") >= start).distinct()
    numbered = used.withColumn("_ub", F.floor(F.col("n") / 100_000))
    tens = numbered.groupBy("_ub").agg(F.count("*").alias("c")).withColumn("_ubase", F.coalesce(F.sum("c").over(Window.orderBy("_ub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_ub", "_ubase")
    # after the k-th used number n, ranks from n - start - k + 1 on have k used numbers before them
    ranked_used = numbered.withColumn("_own", F.row_number().over(Window.partitionBy("_ub").orderBy("n"))).join(tens, "_ub").select("n", (F.col("_ubase") + F.col("_own")).alias("k"))
    gaps = ranked_used.select((F.col("n") - start - F.col("k") + 2).alias("from_rank"), "k")
    gaps = gaps.groupBy("from_rank").agg(F.max("k").alias("k"))
    lacking = rows.where(missing).withColumn("_block", F.floor(F.col("row_idx") / 100_000))
    sizes = lacking.groupBy("_block").agg(F.count("*").alias("c")).withColumn("_base", F.coalesce(F.sum("c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "_base")
    ranked = lacking.withColumn("_i", F.row_number().over(Window.partitionBy("_block").orderBy("row_idx"))).join(sizes, "_block").withColumn("_rank", F.col("_base") + F.col("_i"))
    marks = ranked.select("_rank", F.lit(0).cast("long").alias("k")).unionByName(gaps.select(F.col("from_rank").alias("_rank"), F.col("k").cast("long")))
    # the greatest k at or below a rank, by blocks of ranks: a running maximum inside, the maximum of the blocks before
    block = F.floor(F.col("_rank") / 100_000)
    tops = marks.groupBy(block.alias("_rb")).agg(F.max("k").alias("m")).withColumn("_before", F.coalesce(F.max("m").over(Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_rb", "_before")
    run = Window.partitionBy("_rb").orderBy("_rank").rangeBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("_rb", block).withColumn("_k", F.max("k").over(run)).where("k = 0").join(tops, "_rb").select(F.col("_rank").alias("_p"), F.greatest("_k", "_before").alias("_shift")).distinct()
    named = ranked.join(placed, F.col("_rank") == F.col("_p")).withColumn("id", F.concat(F.lit(f"{prefix}-"), F.lit(start) + F.col("_rank") - 1 + F.col("_shift")))
    return rows.where(~missing).withColumn("added", F.lit(False)).unionByName(named.select(*rows.columns).withColumn("added", F.lit(True)))


def filter_holdout(holdout: DataFrame, shown: DataFrame) -> DataFrame:
    """version, id: for each version of shown (version, id) the holdout rows that its prompt doesn't show."""
    versions = shown.select("version").distinct()
    every = holdout.select("id").crossJoin(versions)  # the result has a row a version and holdout row, but for those shown
    return every.join(shown.where("id IS NOT NULL").distinct(), ["version", "id"], "left_anti")


def remaining_examples(examples: DataFrame, results: DataFrame, earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Examples without a successful result in an earlier run that is the same as the current one; else all of them.

    earlier and current have the fingerprints (prompt_version, backend, data_source) of the earlier results, if they
    have any, and of this run: one row each. Runs are the same if all three agree.
    """
    kinds = ["prompt_version", "backend", "data_source"]
    agree = None
    for k in kinds:
        this = F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))
        agree = this if agree is None else agree & this
    same = earlier.select(*kinds).alias("_a").join(current.select(*kinds).alias("_b"), agree).limit(1).select(F.lit(True).alias("_same"))
    done = results.where("error IS NULL AND example_id IS NOT NULL").select(F.col("example_id").alias("id")).distinct().join(F.broadcast(same)).drop("_same")  # at most one row
    return examples.join(done, "id", "left_anti")


def latest_results(earlier: DataFrame, later: DataFrame, keys: tuple[str, ...] = ("version", "example_id")) -> DataFrame:
    """One result a key: a later one before an earlier one."""
    both = earlier.withColumn("_age", F.lit(0)).unionByName(later.withColumn("_age", F.lit(1)))
    value = [c for c in earlier.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*value), "_age").alias("r")).select(*keys, *[F.col(f"r.{c}") for c in value])


def append_archive(archive: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """archive and the rows of new whose version it doesn't have."""
    return archive.unionByName(new.join(archive.select(*keys), list(keys), "left_anti"))


def merge_candidates(sources: list[tuple[str, DataFrame]], keys: tuple[str, ...] = ("run_id", "version")) -> DataFrame:
    """One row a version from several sources; the first source that has it counts. source names it.

    Where a source has eval_status, only rows that are complete, scored or null in it count.
    """
    every = None
    for i, (name, df) in enumerate(sources):
        if "eval_status" in df.columns:
            df = df.where(F.col("eval_status").isNull() | F.col("eval_status").isin("complete", "scored"))
        part = df.select(*keys, "parent_version", "quality", "cost", F.lit(name).alias("source"), F.lit(i).alias("_i"))
        every = part if every is None else every.unionByName(part)
    fields = ["parent_version", "quality", "cost", "source"]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*fields), "_i").alias("c")).select(*keys, "c.*")


def label_by_utility(examples: DataFrame, weight: float = 0.8, k: int | None = None) -> DataFrame:
    """id, selected, utility, gap, bucket (0: smallest gaps), and chosen: at most k rows a bucket, by the hash of the id.

    Utility is quality - weight * cost; of equals the first route by name. The buckets are thirds of all rows by gap.
    """
    each = F.transform(F.map_entries("routes"), lambda e: F.struct((-(F.coalesce(e["value"]["quality_score"], F.lit(0.0)) - weight * F.coalesce(e["value"]["cost"], F.lit(0.0)))).alias("u"), e["key"].alias("r")))
    top = examples.select("id", F.array_sort(each).alias("t")).select("id", F.col("t")[0]["r"].alias("selected"), (-F.col("t")[0]["u"]).alias("utility"), F.when(F.size("t") > 1, F.col("t")[1]["u"] - F.col("t")[0]["u"]).alias("gap"))
    cuts = exact_quantiles(top, "gap", (1 / 3, 2 / 3))
    rows = top.join(F.broadcast(cuts)).withColumn("bucket", F.when(F.col("gap") <= F.col("_q")[0], 0).when(F.col("gap") <= F.col("_q")[1], 1).otherwise(2)).drop("_q")  # one row
    if k is None:
        return rows
    # at most k of each slice of the hashes go on to the last ranking
    hashed = rows.withColumn("_s", F.sha2("id", 256))
    near = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("bucket", F.substring("_s", 1, _DIGITS)).orderBy("_s"))).where(F.col("_r") <= k)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy("_s"))).where(F.col("_r") <= k).groupBy("bucket").agg(F.max("_s").alias("_last"))
    return hashed.join(F.broadcast(best), "bucket").withColumn("chosen", F.col("_s") <= F.col("_last")).select(*rows.columns, "chosen")  # three rows


def exact_quantiles(rows: DataFrame, column: str, shares: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """_q: the quantiles of a column with linear interpolation between ranks, exactly; one row, nulls where there is no value.

    Values are counted in even bins; only the bins that hold a wanted rank are sorted, each by itself.
    """
    x = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("all"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    binned = x.join(F.broadcast(ends)).withColumn("bin", place)  # one row
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"), F.first("all").alias("all"))
    counts = counts.withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a bin
    at = lambda q: (F.col("all") - 1) * F.lit(float(q))
    holds = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))
    wanted = None
    for q in shares:
        this = holds(F.floor(at(q))) | holds(F.ceil(at(q)))
        wanted = this if wanted is None else wanted | this
    few = binned.join(F.broadcast(counts.where(wanted).select("bin", "below")), "bin").withColumn("r", F.col("below") + F.row_number().over(Window.partitionBy("bin").orderBy("x")) - 1)
    value = lambda r: F.max(F.when(F.col("r") == r, F.col("x")))
    low, high = [value(F.floor(at(q))) for q in shares], [value(F.ceil(at(q))) for q in shares]
    sums = few.agg(F.max("all").alias("all"), *[v.alias(f"l{i}") for i, v in enumerate(low)], *[v.alias(f"h{i}") for i, v in enumerate(high)])
    return sums.select(F.array(*[F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (at(q) - F.floor(at(q))) for i, q in enumerate(shares)]).alias("_q"))
