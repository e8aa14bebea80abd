"""Operators on small literal frames and against plain Python."""

import collections
import copy
import csv
import datetime
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillon.operators import bootstrap, compare, identity, inference, metrics, pareto, quality_checks, review
from quillon.operators import mapping as mapping_op
from quillon.sources import files
from quillon.streaming import results as streams

ROUTES = {"gpt": (0.03, 0.95), "mid": (0.01, 0.88), "small": (0.002, 0.72)}
EXAMPLES = "id string, input string, route string, routes map<string, struct<cost: double, quality_score: double>>"
RESULTS = "version string, example_id string, output struct<route: string>, error string, cost double"


def pairs_of(spark, truths, preds, version="v1"):
    ex = spark.createDataFrame([(f"e{i}", "x", t, ROUTES) for i, t in enumerate(truths)], EXAMPLES)
    res = spark.createDataFrame([(version, f"e{i}", None if p is None else (p,), None, 0.0) for i, p in enumerate(preds)], RESULTS)
    return metrics.pair_results(res, ex, ("version",))


def test_cost_quality_change_by_hand(spark):
    r = metrics.cost_quality_change(pairs_of(spark, ["mid", "small"], ["mid", "mid"]), ("version",)).first()
    assert r.cost_change == pytest.approx((0.02 - 0.06) / 0.06) and r.quality_change == pytest.approx((1.76 - 1.90) / 1.90)
    assert r.oracle_cost == pytest.approx(0.012) and r.oracle_quality == pytest.approx(1.60)


def test_cost_quality_change_without_counted_rows(spark):
    r = metrics.cost_quality_change(pairs_of(spark, ["mid"], ["nobody"]), ("version",)).first()
    assert (r.cost_change, r.baseline_cost, r.oracle_quality_captured) == (0.0, 0.0, 1.0)
    r = metrics.cost_quality_change(pairs_of(spark, ["mid"], [None]), ("version",)).first()
    assert r.predicted_cost == 0.0 and r.cost_change == -1.0


def test_f1_by_hand(spark):
    cells = metrics.confusion_cells(pairs_of(spark, ["gpt", "mid", "mid"], ["gpt", "gpt", "mid"]), ("version",))
    per_class = metrics.precision_recall_f1(cells, ("version",))
    assert metrics.macro_f1(per_class, ("version",)).first().macro_f1 == pytest.approx(2 / 3)
    assert metrics.accuracy(pairs_of(spark, ["mid"], [None]), ("version",)).first().accuracy == 0.0


def test_pairs_drop_errors_and_take_the_last_example(spark):
    ex = spark.createDataFrame([("e", "x", "mid", ROUTES, 0), ("e", "x", "small", ROUTES, 1)], EXAMPLES + ", row_idx long")
    res = spark.createDataFrame([("v", "e", ("mid",), None, 0.0), ("v", "e", None, "timeout", 0.0), ("v", "other", ("mid",), None, 0.0)], RESULTS)
    assert [(r.id, r.route, r.pred) for r in metrics.pair_results(res, ex, ("version",)).collect()] == [("e", "small", "mid")]


def test_registry_refuses_unknown_and_clashing_metrics(spark):
    p = pairs_of(spark, ["mid"], ["mid"])
    r = metrics.MetricRegistry()
    r.register("a", lambda x: metrics.long_metrics(metrics.accuracy(x, ("version",)), ("version",)))
    with pytest.raises(KeyError):
        r.compute(p, [("b", {})], ("version",))
    r.register("b", r.known["a"])
    with pytest.raises(Exception, match="two metrics"):
        r.compute(p, [("a", {}), ("b", {})], ("version",)).collect()


def points(spark, rows):
    return spark.createDataFrame([("r", v, float(q), float(c)) for v, q, c in rows], "run_id string, version string, quality double, cost double")


def front_of(rows):
    return {v for v, q, c in rows if not any((a >= q and b <= c) and (a > q or b < c) for _, a, b in rows)}


@pytest.mark.parametrize("seed", range(3))
def test_skyline_matches_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{i}", rng.randint(0, 9), rng.randint(0, 9)) for i in range(40)]
    for locally in (False, True):
        assert {r.version for r in pareto.pareto_front(points(spark, rows), locally=locally).collect()} == front_of(rows)


def test_near_miss_by_hand(spark):
    rows = [("f1", 0.85, 0.02), ("f2", 0.90, 0.05), ("d", 0.80, 0.06)]
    df = points(spark, rows)
    r = pareto.near_misses(df, pareto.pareto_front(df)).collect()
    assert [(x.version, x.dominated_by, round(x.quality_gap, 6), round(x.cost_gap, 6)) for x in r] == [("d", "f1", 0.05, 0.04)]


def test_hypervolume_grows_with_points(spark):
    ref = spark.createDataFrame([("r", 0.0, 10.0)], "run_id string, ref_quality double, ref_cost double")
    volumes = [pareto.hypervolume(pareto.pareto_front(points(spark, [("a", 3, 4), ("b", 5, 7), ("c", 8, 9)][:k])), ref).first().hypervolume for k in (1, 2, 3)]
    assert volumes == [18.0, 24.0, 27.0]


def test_crowding_and_knee(spark):
    df = points(spark, [("a", 0, 0), ("b", 4, 1), ("c", 5, 9), ("d", 10, 10)])
    d = {r.version: r.distance for r in pareto.crowding_distance(df).collect()}
    assert d["a"] == d["d"] == math.inf and d["b"] == pytest.approx(5 / 10 + 9 / 10) and d["c"] == pytest.approx(6 / 10 + 9 / 10)
    assert pareto.knee_point(df).first().version == "c"
    assert {r.version for r in pareto.prune_to_size(df, 3).collect()} == {"a", "c", "d"}
    assert {r.version for r in pareto.prune_to_size(df, 1).collect()} == {"a", "d"}


def test_elite_set_starts_cold(spark):
    new = points(spark, [("a", 5, 5), ("b", 4, 6), ("z", 0, 0)])
    assert {r.version for r in pareto.elite_set(new.limit(0), new, cold_start=True).collect()} == {"a", "b"}
    assert {(r.version, r.is_new) for r in pareto.elite_set(points(spark, [("o", 3, 3), ("p", 0, 0)]), new).collect()} == {("a", True), ("o", False), ("p", False)}
    assert {(r.version, r.quality, r.is_new) for r in pareto.elite_set(points(spark, [("a", 9, 1)]), new).collect()} == {("a", 5.0, False)}


# Plain folds of lists, apart from the library's own helpers


def slow_distances(front):
    total = {x[0]: 0.0 for x in front}
    for axis in (1, 2):
        order = sorted(front, key=lambda x: (x[axis], x[0]))
        span = order[-1][axis] - order[0][axis]
        for i, (v, *_) in enumerate(order):
            if i in (0, len(order) - 1):
                total[v] = math.inf
            elif span:
                total[v] += (order[i + 1][axis] - order[i - 1][axis]) / span
    return total


def slow_prune(front, size):
    front = list(front)
    while len(front) > size:
        safe = {min(front, key=lambda x: (-x[1], x[0]))[0], min(front, key=lambda x: (x[2], x[0]))[0]}
        d = slow_distances(front)
        rest = [x for x in front if x[0] not in safe]
        if not rest:
            break
        gone = min(rest, key=lambda x: (d[x[0]], x[0]))
        front.remove(gone)
    return front


def slow_front(rows):
    return [x for x in rows if not any((y[1] >= x[1] and y[2] <= x[2]) and (y[1] > x[1] or y[2] < x[2]) for y in rows)]


@pytest.mark.parametrize("seed", range(3))
def test_pruning_matches_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{i:02}", rng.randint(0, 40), rng.randint(0, 40)) for i in range(60)]
    front = slow_front(rows)
    for size in (1, 3, 5):
        got = {r.version for r in pareto.prune_to_size(pareto.pareto_front(points(spark, rows)), size).collect()}
        assert got == {x[0] for x in slow_prune(front, size)}


def test_pruning_of_points_with_ties_and_of_others_than_fronts():
    for seed in range(60):
        rng = random.Random(seed)
        rows = [(f"v{i:02}", rng.randint(0, 9), rng.randint(0, 9)) for i in range(rng.randint(1, 25))]
        rows = slow_front(rows) if seed % 2 else rows
        frame = pareto.pd.DataFrame(rows, columns=["version", "quality", "cost"])
        for size in range(1, 8):
            assert set(pareto._pruned(frame, size)["version"]) == {x[0] for x in slow_prune(rows, size)}, (seed, size)


def test_pruning_a_large_front_is_quick():
    n = 100_000
    rng = np.random.default_rng(1)
    frame = pareto.pd.DataFrame({"version": [f"v{i}" for i in range(n)], "quality": np.cumsum(rng.integers(1, 99, n)), "cost": np.cumsum(rng.integers(1, 99, n))})
    began = time.process_time()
    assert len(pareto._pruned(frame, 50)) == 50
    assert time.process_time() - began < 20


def slow_rounds(rounds, epsilon, limit, max_rounds, budget, size):
    """rounds: lists of (version, quality, cost, meets, scored)."""
    elite, volume, stagnation, halved, evaluated, out = {}, 0.0, 0, False, 0, []
    for step, rows in enumerate(rounds, 1):
        evaluated += len(rows)
        scored, before = [r for r in rows if r[4]], volume
        if not scored:
            stagnation += 1
        else:
            ever = list(elite.values()) + scored
            low, dear = min(r[1] for r in ever), max(r[2] for r in ever)
            reference = (low * 0.9 if low > 0 else -0.1, dear * 1.1 if dear > 0 else 0.1)
            elite = {**elite, **{r[0]: r for r in scored if r[1] or r[2]}}
            if step > 1:
                elite = {r[0]: r for r in slow_prune(slow_front(list(elite.values())), size)}
            volume, q0 = 0.0, reference[0]
            for _, q, c, *_ in sorted(elite.values(), key=lambda r: (r[1], -r[2])):
                volume += (q - q0) * (reference[1] - c) if q > q0 and reference[1] > c else 0.0
                q0 = q
            if step > 1:
                stagnation = 0 if ((volume - before) / before if before > 0 else volume) > epsilon else stagnation + 1
            if not halved and any(r[3] for r in elite.values()):
                epsilon, stagnation, halved = max(epsilon / 2, 0.0005), 0, True
        q = [r[1] for r in elite.values()]
        done = (evaluated >= budget and stagnation >= limit) or step >= max_rounds
        out.append((len(elite), round(volume, 6), stagnation, epsilon, evaluated, max(q) - min(q) if len(q) > 1 else 0.0, sum(r[2] for r in scored), stagnation >= 2, done, round(max(0.0, volume - before), 6)))
        if done:
            break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_match_lists(spark, seed):
    rng = random.Random(seed)
    rounds = []
    for step in range(9):
        rows = [(f"v{step}-{i}", float(rng.randint(0, 12 + step)), float(rng.randint(0, 15)), rng.random() < 0.05, rng.random() < 0.8) for i in range(rng.randint(1, 8))]
        rounds.append([(*r[:4], False) for r in rows] if step == 4 else rows)
    data = [("r", step + 1, *row[:4], "complete" if row[4] else "failed") for step, rows in enumerate(rounds) for row in rows]
    df = spark.createDataFrame(data, "run_id string, round int, version string, quality double, cost double, meets boolean, eval_status string").repartition(3)
    got = pareto.advance_rounds(df, met="meets", budget=20, limit=2, max_rounds=8, size=3).orderBy("round").collect()
    want = slow_rounds(rounds, 0.001, 2, 8, 20, 3)
    assert [(r.elite_size, round(r.hypervolume, 6), r.stagnation, r.epsilon, r.evaluated, r.spread, r.routing_cost, r.backtracked, r.converged, round(r.improvement, 6)) for r in got] == want


def test_rounds_by_hand(spark):
    df = spark.createDataFrame([("r", 1, "a", 0.95, 0.05), ("r", 1, "b", 0.9, 0.06), ("r", 2, "c", 0.96, 0.04), ("r", 3, "d", 0.1, 0.9)], "run_id string, round int, version string, quality double, cost double")
    out = pareto.advance_rounds(df, budget=4, limit=1).orderBy("round").collect()
    assert [(r.elite_size, r.new_entries, r.stagnation, r.converged, r.reason) for r in out] == [(2, 2, 0, False, None), (1, 1, 0, False, None), (1, 0, 0, False, None)]


@pytest.mark.parametrize("seed", range(3))
def test_near_misses_match_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{i:02}", rng.randint(0, 12), rng.randint(0, 12)) for i in range(50)]
    front = slow_front(rows)
    want = {}
    for v, q, c in rows:
        over = [(a - q + c - b, n, a - q, c - b) for n, a, b in front if a >= q and b <= c and (a > q or b < c)]
        if over:
            want[v] = min(over)[1:]
    df = points(spark, rows)
    got = {r.version: (r.dominated_by, r.quality_gap, r.cost_gap) for r in pareto.near_misses(df, pareto.pareto_front(df), chunk=7).collect()}
    assert got == want


def test_near_misses_between_two_of_the_front(spark):
    """As good as one point of the front and as dear as another: dominated by both."""
    df = points(spark, [("a", 5, 1), ("b", 9, 4), ("between", 5, 4)])
    assert [tuple(r)[1:] for r in pareto.near_misses(df, pareto.pareto_front(df)).collect()] == [("between", "a", 0, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_incremental_front(spark, seed):
    rng = random.Random(seed)
    rows = [("r", i, f"v{i:02}", rng.randint(0, 9), rng.randint(0, 9)) for i in range(40)]
    out = pareto.incremental_front(spark.createDataFrame(rows, "run_id string, seq int, version string, quality int, cost int")).collect()
    members, accepted = [], set()
    for _, i, v, q, c in rows:
        if not any(a >= q and b <= c for a, b, _ in members):
            members = [m for m in members if not (q >= m[0] and c <= m[1])] + [(q, c, v)]
            accepted.add(v)
    assert {r.version for r in out if r.accepted} == accepted and {r.version for r in out if r.on_front} == {m[2] for m in members}


def test_incremental_front_of_a_line_stays_linear(spark):
    """No point dominates another: 2,000 members, in two runs, in an order that has nothing to do with the axes."""
    place = list(range(2_000))
    random.Random(2).shuffle(place)
    rows = [(f"r{i % 2}", k, f"v{i:04}", i, i) for i, k in enumerate(place)]
    out = pareto.incremental_front(spark.createDataFrame(rows, "run_id string, seq int, version string, quality int, cost int")).collect()
    assert len(out) == 2_000 and all(r.accepted and r.on_front for r in out)


def test_journey_carries_forward(spark):
    df = spark.createDataFrame([("r", 2, "a", 5.0, 1.0), ("r", 3, "b", 4.0, 1.0), ("r", 4, "c", 5.0, 0.5)], "run_id string, round int, version string, quality double, cost double")
    rounds = spark.createDataFrame([("r", i) for i in range(1, 6)], "run_id string, round int")
    assert [(r.round, r.version) for r in pareto.journey(df, rounds).orderBy("round").collect()] == [(2, "a"), (3, "a"), (4, "c"), (5, "c")]


def test_persistence_by_hand(spark):
    a = pairs_of(spark, ["mid", "mid"], ["gpt", "gpt"], "v1")
    b = pairs_of(spark, ["mid", "mid"], ["gpt", "mid"], "v2")
    r = review.persistence(a.unionByName(b).selectExpr("'r' AS run_id", "*")).first()
    assert (r.n, r.persistent, r.volatile, r.label) == (2, 1, 1, "mixed")


def test_diminishing_returns(spark):
    t = spark.createDataFrame([("r", i, s) for i, s in enumerate([0.5, 0.6, 0.6, 0.6], 1)], "run_id string, round int, score double")
    r = review.diminishing_returns(t).first()
    assert r.trend == pytest.approx(0.1 / 3) and not r.stagnating and r.threshold == pytest.approx(0.006)


@pytest.mark.parametrize(("sizes", "ratio"), [([10, 5, 1], 0.2), ([1, 1, 1], 0.2), ([1], 0.2), ([2, 3], 0.5), ([], 0.2)])
def test_split_sizes(spark, sizes, ratio):
    rows = [(f"{r}-{i}", "x", f"r{r}") for r, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, input string, route string")
    out = identity.stratified_split(df, ratio).collect()
    again = identity.stratified_split(df.repartition(5), ratio).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == len(rows)
    hold = {r: sum(x.split == "holdout" and x.route == f"r{r}" for x in out) for r in range(len(sizes))}
    want = {r: round(n * (1 - ratio)) if n > 1 else 0 for r, n in enumerate(sizes)}
    if not any(want.values()) and sum(sizes) > 1:
        assert sum(hold.values()) == round(sum(sizes) * (1 - ratio))
    else:
        assert hold == want


def test_fingerprint_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(str(i), f"t{i}", "r") for i in range(50)], "id string, input string, route string")
    one = identity.dataset_fingerprint(df).first()[0]
    assert one == identity.dataset_fingerprint(df.repartition(7)).first()[0] and len(one) == 16
    assert one != identity.dataset_fingerprint(df.union(df.limit(2))).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_missing_ids_take_free_numbers(spark, seed):
    rng = random.Random(seed)
    ids = [rng.choice([None, "", f"row-{rng.randint(0, 30)}", "row-007", "x"]) for _ in range(40)]
    out = {r.row_idx: r.id for r in identity.add_missing_ids(spark.createDataFrame(list(enumerate(ids)), "row_idx long, id string"), start=3).collect()}
    used, n, want = set(ids), 3, {}
    for i, x in enumerate(ids):
        if x:
            want[i] = x
            continue
        while f"row-{n}" in used:
            n += 1
        want[i] = f"row-{n}"
        n += 1
    assert out == want


def test_utility_labels(spark):
    ex = spark.createDataFrame([(f"e{i}", {"a": (0.1 * i, 1.0), "b": (0.0, 0.5)}) for i in range(6)], "id string, routes map<string, struct<cost: double, quality_score: double>>")
    out = {r.id: r for r in identity.label_by_utility(ex, 1.0, k=1).collect()}
    assert out["e0"].selected == "a" and out["e5"].selected == "a" and out["e0"].gap == pytest.approx(0.5)
    assert sum(r.chosen for r in out.values()) == len({r.bucket for r in out.values()})


def test_raw_checks_on_faulty_rows(spark):
    good = {"id": "a", "input": "x", "expected": {"route": "s", "routes": {"s": {"cost": 1, "quality_score": None}}}}
    rows = [good, {**good, "id": "a"}, {"input": "x", "expected": "s"}, {**good, "id": 5}, {**good, "id": "b", "expected": {"route": "q", "routes": {"s": {"cost": True, "other": 1}}}}, {**good, "id": "c", "expected": {"route": None, "routes": {}}}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_idx long, j string").selectExpr("row_idx", "try_parse_json(j) AS v")
    got = sorted((r.check, r.row_idx) for r in quality_checks.violations(df).collect())
    assert got == sorted([("null_fields", 0), ("null_fields", 1), ("unique_ids", 1), ("required_keys", 2), ("types", 2), ("types", 3), ("null_fields", 3), ("route_in_routes", 4), ("canonical_route_fields", 4), ("required_keys", 5), ("null_fields", 5), ("non_empty_routes", 5)])
    assert not quality_checks.passes(quality_checks.violations(df)).first().passed


def test_statistics_of_no_rows(spark):
    r = quality_checks.query_length_stats(spark.createDataFrame([], "input string")).first()
    assert tuple(r) == (0, 0, 0.0, 0.0, 0)


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"__meta__": "x"}\n[1]\n{"a": NaN}\n{"a": {"b": null}}\n')
    rows, bad = files.read_jsonl(spark, str(path))
    assert [r.row_idx for r in rows.orderBy("row_idx").collect()] == [0, 3, 6] and [r.line for r in bad.orderBy("line").collect()] == [3, 5, 6]
    with pytest.raises(ValueError, match="line 3"):
        files.read_jsonl(spark, str(path), "strict")
    assert files.read_jsonl(spark, str(path), "results")[0].count() == 2
    assert {r.path for r in files.nested_paths(rows).collect()} == {"a", "a.b", "__meta__"}
    assert files.source_reader(str(path)) == "jsonl"


def test_csv_json_results_and_reports(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n,\n2\n3,4,5\n')
    assert [tuple(r) for r in files.read_csv_rows(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x\ny"), ("2", None), ("3", "4")]
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "t.json")).count() == 2
    for v, ok in (("v1", 3), ("v2", 0)):
        (tmp_path / "eval" / v).mkdir(parents=True)
        (tmp_path / "eval" / v / "results.jsonl").write_text('{"__meta__": "run_fingerprint"}\n{"example_id": "e", "output": {"route": "a"}, "cost": 0.5}\nbroken\n')
        (tmp_path / "eval" / v / "report.json").write_text(json.dumps({"metrics": {"accuracy": 0.5}, "summary": {"succeeded": ok}}))
    out = files.read_results(spark, str(tmp_path / "eval" / "*" / "results.jsonl"))
    assert sorted((r.version, r.output.route) for r in out.collect()) == [("v1", "a"), ("v2", "a")]
    assert [tuple(r) for r in files.read_reports_long(spark, str(tmp_path / "eval" / "*" / "report.json")).collect()] == [("v1", "accuracy", 0.5)]
    files.write_jsonl(out, str(tmp_path / "copy"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 2
    (tmp_path / "prompts").mkdir()
    for n in ("v1.txt", "v1.md", "v2.txt"):
        (tmp_path / "prompts" / n).write_text(n)
    assert sorted((r.version, r.text) for r in files.prompt_corpus(spark, str(tmp_path / "prompts")).collect()) == [("v1", "v1.md"), ("v2", "v2.txt")]


def test_mapping_guards(spark):
    assert mapping_op.check_mapping({"q": "input", "r": "expected.route", "x.*.c": "expected.routes.*.cost"}, ["q", "r", "x", "left"]) == ["left"]
    with pytest.raises(ValueError, match="expected.route"):
        mapping_op.check_mapping({"q": "input"}, [])
    ex = spark.createDataFrame([(0, "a", "s", {"t": (1.0, 1.0)})], "row_idx long, id string, route string, routes map<string, struct<cost: double, quality_score: double>>")
    with pytest.raises(ValueError, match="a"):
        mapping_op.assert_route_in_routes(ex)


def test_row_index_follows_order(spark):
    out = files.with_row_index(spark.range(100).repartition(7)).collect()
    assert sorted(r.row_idx for r in out) == list(range(100))


def test_bootstrap_weights_and_intervals(spark):
    h = np.random.default_rng(0).integers(0, 2**32, 4000)
    w = bootstrap.weights(h, np.arange(50), 3).astype(float)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    p = pairs_of(spark, ["mid"] * 60 + ["gpt"] * 40, ["mid"] * 50 + ["gpt"] * 50)
    out = {r.key: r for r in bootstrap.bootstrap_ci(p, 300, 1).collect()}
    assert out["accuracy"].lower < 0.9 < out["accuracy"].upper and out["accuracy"].upper - out["accuracy"].lower < 0.2
    assert sorted(map(tuple, bootstrap.bootstrap_ci(p.repartition(5), 300, 1).collect())) == sorted(map(tuple, out.values()))
    assert bootstrap.replicates_for(199) == 2_000 and bootstrap.replicates_for(200) == 10_000


def test_inference_tries_again(spark):
    ex = spark.createDataFrame([(f"e{i}", "x", "mid") for i in range(3)], "id string, input string, route string")

    def predict(frame):
        return [ValueError("no") if i == "e0" else {"route": None} if i == "e1" else {"route": "mid", "cost": 0.5} for i in frame["id"]]

    out = {r.example_id: r for r in inference.score_examples(ex, predict, attempts=2).collect()}
    assert (out["e0"].error, out["e0"].retries, out["e0"].output) == ("ValueError: no", 1, None) and out["e1"].error == "no route" and out["e2"].output.route == "mid"


def test_calls_that_raise_leave_error_rows(spark, tmp_path):
    ex = spark.createDataFrame([(f"e{i}", "x", "mid") for i in range(100)], "id string, input string, route string").coalesce(1)

    def predict(frame):
        with open(tmp_path / "calls", "a") as calls:
            calls.write(f"{len(frame)}\n")
        if set(frame["id"]) & {"e7", "e70"}:
            raise TimeoutError("too slow")
        return [{"route": "mid", "cost": 0.5, "input_tokens": 7, "output_tokens": 1}] * len(frame)

    out = {r.example_id: r for r in inference.score_examples(ex, predict, attempts=2, model="m").collect()}
    assert {k for k, r in out.items() if r.error} == {"e7", "e70"} and out["e7"].error == "TimeoutError: too slow" and out["e7"].retries == 1
    good = out["e8"]
    assert good.output.route == "mid" and good.retries == 0 and good.model == "m" and good.latency_ms >= 0 and (good.token_usage.input_tokens, good.token_usage.cached_tokens) == (7, None)
    assert len((tmp_path / "calls").read_text().split()) < 40  # by halves, not row by row
    short = {r.example_id: r.error for r in inference.score_examples(ex.limit(2), lambda frame: frame["route"].tolist()[:1], attempts=1).collect()}
    assert set(short.values()) == {None}  # halves of one row have a result each


def test_scoring_goes_on_after_a_stop(spark, tmp_path):
    ex = spark.createDataFrame([(f"e{i}", "x", "mid") for i in range(60)], "id string, input string, route string")
    path, run = f"file://{tmp_path}/scores", {"prompt_version": "v1", "backend": "b", "data_source": "d"}

    def scorer(log, stop_at=None):
        def predict(frame):
            with open(tmp_path / log, "a") as seen:
                seen.writelines(f"{i}\n" for i in frame["id"])
            if stop_at in set(frame["id"]):
                raise SystemExit("stopped")
            return [ValueError("no") if i == "e3" else "mid" for i in frame["id"]]

        return predict

    with pytest.raises(Exception):  # noqa: B017 - the job ends with its worker
        inference.score_into(ex, scorer("first", "e40"), path, run, batches=6, attempts=1)
    before = {r.example_id for r in inference.scored_so_far(spark, path).collect()}
    out = {r.example_id: r for r in inference.score_into(ex, scorer("second"), path, run, batches=6, attempts=1).collect()}
    again = (tmp_path / "second").read_text().split()
    assert sorted(again) == sorted({f"e{i}" for i in range(60)} - (before - {"e3"})) and len(before) < 60
    assert len(out) == 60 and {k for k, r in out.items() if r.error} == {"e3"}
    out = {r.example_id: r for r in inference.score_into(ex, inference.echo, path, run, batches=2).collect()}  # what failed is scored anew
    assert len(out) == 60 and not any(r.error for r in out.values())
    inference.score_into(ex, scorer("third"), path, run | {"backend": "c"}, batches=2, attempts=1)
    assert len((tmp_path / "third").read_text().split()) == 60 and inference.scored_so_far(spark, path).count() == 60


def test_batches_are_scored_by_all_cores(spark, tmp_path):
    ex = spark.createDataFrame([(f"e{i}", "x", "mid") for i in range(400)], "id string, input string, route string").coalesce(1)
    run = {"prompt_version": "v1", "backend": "b", "data_source": "d"}
    for name, tasks, want in (("all", None, spark.sparkContext.defaultParallelism), ("two", 2, 2)):
        path = f"file://{tmp_path}/{name}"
        inference.score_into(ex.where("id < 'e3'"), lambda frame: [TaskContext.get().partitionId()] * len(frame), path, run, batches=1, tasks=tasks)
        out = inference.score_into(ex, lambda frame: [TaskContext.get().partitionId()] * len(frame), path, run, batches=1, tasks=tasks).collect()
        assert len(out) == 400 and not any(r.error for r in out)
        for half in (True, False):  # the first go and what it left
            assert len({r.output.route for r in out if (r.example_id < "e3") == half}) == want


def test_targets_and_best_version(spark):
    m = spark.createDataFrame([("r", "a", "x", 1.0), ("r", "b", "x", 3.0), ("r", "b", "y", 1.0)], "run_id string, version string, key string, value double")
    t = spark.createDataFrame([("x", ">=", 2.0), ("y", ">=", 2.0)], "metric string, operator string, threshold double")
    met = compare.targets_met(m, t)
    assert {r.version: (r.n_met, r.progress) for r in met.collect()} == {"a": (0, 0.5), "b": (1, 1.5)}
    assert compare.best_version(met).first().best == "b"


def test_overlap_of_prompts(spark):
    prompts = spark.createDataFrame([("v1", "### Example a x ### Example b"), ("v2", "### Example b")], "version string, text string")
    ids = review.example_ids(prompts)
    assert sorted(map(tuple, ids.collect())) == [("v1", "a"), ("v1", "b"), ("v2", "b")]
    assert review.example_overlap(ids).first().overlap == 0.5 and review.example_overlap(ids.where("version = 'v1'")).first().overlap == 1.0




# Mapping


def placed(source, path):
    found = [((), source)]
    for part in path.split("."):
        found = [((*keys, k) if part == "*" else keys, x[k]) for keys, x in found if isinstance(x, dict) for k in ([part] if part in x else []) if part != "*"] + [((*keys, k), x[k]) for keys, x in found if part == "*" and isinstance(x, dict) for k in sorted(x)]
    return found


def mapped(source, mapping, i):
    """The target document by plain dictionaries."""
    out = {}
    for s, t in mapping.items():
        for keys, value in placed(source, s):
            if value is None and "*" not in s:
                continue
            if isinstance(value, str) and t.split(".")[0] not in ("id", "input"):
                try:
                    value = float(value) if "." in value else int(value)
                except ValueError:
                    pass
            keys, at = list(keys), out
            parts = [keys.pop(0) if part == "*" else part for part in t.split(".")]
            for part in parts[:-1]:
                at[part] = at[part] if isinstance(at.get(part), dict) else {}
                at = at[part]
            at[parts[-1]] = value
    out.setdefault("id", f"row-{i}")
    return out


MAPPINGS = [
    {"q": "input", "costs.*": "expected.routes.*.cost", "scores.*": "expected.routes.*.quality_score", "best": "expected.route"},
    {"q": "input", "best": "expected.route", "models.*.price": "expected.routes.*.cost", "one.price": "expected.routes.fixed.cost", "one.score": "expected.routes.a.quality_score"},
    {"q": "input", "best": "expected.route", "deep.*.*.x": "expected.routes.*.*", "scores": "meta.scores", "name": "id"},
    {"q": "input", "best": "expected.route", "deep.*.*.x": "expected.routes.*", "a b.c d": "meta.a b.c d.e", "it's": "meta.say \"it's\""},
    {"q": "input", "best": "expected.route", "models": "expected.routes", "costs.a": "expected.routes.a.cost", "costs.b": "expected.routes.b.cost.deeper"},
    {"q": "input", "best": "expected.route", "costs.*": "*.expected.routes", "models.*.price": "expected.*.routes"},
]
SOURCES = [
    {"q": "1", "best": "a", "costs": {"a": "0.5", "b": 2}, "scores": {"a": 0.9, "c": None}, "models": {"a": {"price": 1, "note": "x"}, "b": {"price": " 7 "}}, "one": {"price": "1e5", "score": 3}, "deep": {"k": {"l": {"x": "4"}, "m": {"y": 1}}, "n": {"l": {"x": [1]}}}, "a b": {"c d": "2.5"}, "it's": True},
    {"q": None, "best": 7, "costs": [], "models": {"a": 3, "b": {"price": None}}, "name": "12"}, {}, {"costs": {"a": {"b": "1"}}, "scores": {}, "deep": {"k": 1}, "one": {"score": "a.b"}},
]


@pytest.mark.parametrize("mapping", MAPPINGS)
def test_mapped_documents_match_dictionaries(spark, mapping):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(SOURCES)], "row_idx long, j string").select("row_idx", F.parse_json("j").alias("v"))
    source_copies = copy.deepcopy(SOURCES)
    got = {r.row_idx: json.loads(r.doc) for r in mapping_op.mapped_documents(rows, mapping).select("row_idx", F.to_json("doc").alias("doc")).collect()}
    for i, source in enumerate(source_copies):
        assert got[i] == mapped(source, mapping, i), i


MORE_MAPPINGS = [
    {"q": "input", "A.x": "m.one", "a.x": "m.two", "a.*": "m.all.*", "A.*.k": "m.k.*", "a.x.k": "m.k.fixed"},
    {"q": "input", "deep.*.*": "m.*.*", "deep.*.l": "m.*.z", "wide.*.*": "m.*.*", "deep.k.l": "m.k.l.under", "a": "m.fixed.y", "A.x.k": "m.fixed.y.deeper"},
    {"*.*": "m.*.*", "*.x": "n.*", "*": "o.last", "`t`.*": "`t`.*.s", "it's \"so\".*.n": "u.*.n"},
    {"deep.*.*": "m.*.at.*", "wide.*.*": "m.*.at.*", "A.*": "m.*.own", "numbers.*": "m.k.at.*", "numbers": "p"},
    {"gone": "a.b.c", "gone.*": "a.b.*", "gone.*.x": "d.*"},
]
MORE_SOURCES = [
    {"q": "1.5", "A": {"x": {"k": "3"}, "y": {"k": None}}, "a": {"x": {"k": " 7 "}, "fixed": "8"}, "deep": {"k": {"l": {"o": 1}, "m": "2"}, "n": {"l": "5."}}, "wide": {"k": {"l": ".5", "w": []}, "o": {"l": {}}},
     "`t`": {"a`b": "x"}, "it's \"so\"": {"e": {"n": "-4"}}, "numbers": {"a": "1.5d", "b": "2.5f", "c": "0x1.8p1", "d": "-1.e3", "e": "1.5e-3", "f": "+.5", "g": "1e5", "h": "1.", "i": ".", "j": "1.2.3"}},
    {"q": 3, "A": {"x": "none", "y": {"k": True}}, "a": None, "deep": {"k": None, "n": {}}, "wide": 4, "numbers": {}}, {"deep": {"z": {"l": None}, "k": {"l": 0.5}}, "a": {"x": None}, "wide": {"k": {"l": "last"}}},
]


@pytest.mark.parametrize("mapping", MORE_MAPPINGS)
def test_mapped_documents_of_sources_that_share_objects(spark, mapping):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(MORE_SOURCES)], "row_idx long, j string").select("row_idx", F.parse_json("j").alias("v"))
    docs = mapping_op.mapped_documents(rows, mapping)
    got = {r.row_idx: None if r.doc is None else json.loads(r.doc) for r in docs.select("row_idx", F.to_json("doc").alias("doc")).collect()}
    for i, source in enumerate(copy.deepcopy(MORE_SOURCES)):
        assert got[i] == mapped(source, mapping, i), i


def test_mapping_keeps_what_is_no_string(spark):
    """Binary values and dates, which JSON doesn't have, stay what they are."""
    values = F.create_map(F.lit("x"), F.expr("cast(encode('12', 'utf-8') as variant)"), F.lit("y"), F.expr("cast(date'2024-01-01' as variant)"), F.lit("z"), F.expr("cast('12' as variant)"), F.lit("w"), F.expr("cast(12.50BD as variant)"))
    rows = spark.range(1).select(F.col("id").alias("row_idx"), F.call_function("to_variant_object", values).alias("v"))
    doc = mapping_op.mapped_documents(rows, {"*": "m.*", "x": "one", "z": "two"}).select(F.schema_of_variant("doc")).first()[0]
    assert doc == "OBJECT<id: STRING, m: OBJECT<w: DECIMAL(3,1), x: BINARY, y: DATE, z: BIGINT>, one: BINARY, two: BIGINT>"


def test_mapping_reads_a_row_once(spark):
    """Sources below the same objects are opened together, and what no star stands above is built by generated code."""
    rows = spark.createDataFrame([(0, '{"f": {"a": {"s": {"b": {"part": "1", "label": "x"}}}}, "o": {"a": {"b": "2.5"}}, "one": "y"}')], "row_idx long, j string").select("row_idx", F.parse_json("j").alias("v")).repartition(1)
    docs = mapping_op.mapped_documents(rows, {"f.*.s.*.part": "m.by.*.*.n", "f.*.s.*.label": "m.by.*.*.label", "o.*.*": "m.by.*.*.more", "one": "expected.route"})
    assert json.loads(docs.select(F.to_json("doc")).first()[0]) == {"id": "row-0", "m": {"by": {"a": {"b": {"n": 1, "label": "x", "more": 2.5}}}}, "expected": {"route": "y"}}
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(v#") == 1 and plan.count("map_zip_with") == 2 and plan.count("map_filter") == 3


def test_mapping_errors(spark):
    rows = spark.createDataFrame([(0, "{}")], "row_idx long, j string").select("row_idx", F.parse_json("j").alias("v"))
    with pytest.raises(ValueError, match="more stars"):
        mapping_op.mapped_documents(rows, {"a.*": "b.*.*"})
    with pytest.raises(ValueError, match="empty name"):
        mapping_op.mapped_documents(rows, {"a..b": "b"})
    assert mapping_op.apply_mapping(rows, {"a": "input", "b": "expected.route", "c": "expected.routes"}).collect() == [(0, "row-0", None, None, None)]


# Streams


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path, kind = f"file://{tmp_path}/cells", "version string, true_route string, pred_route string, n long"
    sink = streams.cell_sink(path, compact=3)
    read = lambda: sorted(tuple(r) for r in streams.read_cells(spark, path, spark.createDataFrame([], kind).schema).collect())
    assert read() == []
    total = {}
    for epoch in range(8):
        rows = [("v", "a", f"p{epoch % 2}", 1), ("v", "a", f"p{epoch % 3}", 1 if epoch < 6 else -1), ("v", "b", "b", 1), ("v", "b", "b", -1)]
        for v, a, b, n in rows:
            total[v, a, b] = total.get((v, a, b), 0) + n
        for _ in range(1 + epoch % 2):
            sink(spark.createDataFrame(rows, kind), epoch)
        assert read() == sorted((*k, n) for k, n in total.items() if n)
    assert len(list((tmp_path / "cells").glob("batch=*"))) < 8


def test_fronts_of_touched_runs_only(spark, tmp_path):
    path, kind = f"file://{tmp_path}/fronts", "run_id string, version string, quality int, cost int"
    schema = spark.createDataFrame([], kind).schema
    sink, rng, every = streams.front_sink(path, schema, compact=3), random.Random(3), []
    for epoch in range(8):
        runs = rng.sample(["r1", "r2", "r3", "r4"], 2)
        rows = [(r, f"v{epoch}{i}", rng.randint(0, 9), rng.randint(0, 9)) for r in runs for i in range(3)]
        every += rows
        for _ in range(1 + epoch % 2):
            sink(spark.createDataFrame(rows, kind), epoch)
        want = {x for r in ("r1", "r2", "r3", "r4") for x in ((r, *y) for y in slow_front([y[1:] for y in every if y[0] == r]))}
        assert {tuple(x) for x in streams.latest_front(spark, path, schema).collect()} == want
        if epoch % 3 != 2:
            assert {r.run_id for r in spark.read.parquet(f"{path}/fronts/batch={epoch}").collect()} == set(runs)
    assert not (tmp_path / "fronts/fronts/batch=0").exists()


# Metrics of a user's own


def test_a_metric_over_pairs(spark):
    class Regret(metrics.PairMetric):
        """Mean of weight times the extra cost, less the quality lost, by pair; and how many pairs there are."""

        columns = ("route", "pred", "routes")

        def __init__(self, weight):
            self.weight = weight

        def start(self):
            return [0, 0]

        def add(self, state, frame):
            for route, pred, routes in zip(frame["route"], frame["pred"], frame["routes"]):
                known = dict(routes)
                if pred in known and route in known:
                    state[0] += round((self.weight * (known[pred]["cost"] - known[route]["cost"]) + known[route]["quality_score"] - known[pred]["quality_score"]) * 1e6)
                state[1] += 1
            return state

        def merge(self, a, b):
            return [a[0] + b[0], a[1] + b[1]]

        def finish(self, state):
            return {"regret": state[0] / 1e6 / state[1], "n": state[1]}

    pairs = pairs_of(spark, ["mid", "small", "gpt"] * 40, ["gpt", "mid", None] * 40).repartition(7).unionByName(pairs_of(spark, ["mid"], ["small"], "v2"))
    registry = metrics.MetricRegistry()
    registry.register("regret", lambda p, weight: metrics.pair_metric(p, Regret(weight), ("version",)))
    got = {(r.version, r.key): r.value for r in registry.compute(pairs, [("regret", {"weight": 2.0})], ("version",)).collect()}
    one = 2 * 0.02 + 0.88 - 0.95 + 2 * 0.008 + 0.72 - 0.88
    assert got == {("v1", "regret"): pytest.approx(one / 3), ("v1", "n"): 120, ("v2", "regret"): pytest.approx(-2 * 0.008 + 0.16), ("v2", "n"): 1}
    assert metrics.pair_metric(pairs.limit(0), Regret(1.0), ("version",)).collect() == []


# Records over line ends


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_of_many_blocks(spark, small_blocks, tmp_path):
    rng = random.Random(4)
    cell = lambda: rng.choice(["", "plain", "a,b", 'say "so"', "two\nlines", "\n\n", "é" * rng.randint(0, 30), '"', "long\n" * rng.randint(0, 200), "x, \n\"y\""])
    rows = [[cell() or "0", cell(), str(i)] for i in range(80)]
    for ending in ("\n", "\r\n"):
        path = tmp_path / f"{len(ending)}.csv"
        with open(path, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(["k", "text", "n"])
            for r in rows:
                writer.writerow(r)
                if rng.random() < 0.1:
                    out.write(ending)
            out.write("short" + ending + "a,b,c,beyond")
        records, _ = files.read_records(spark, str(path), "csv")
        assert path.stat().st_size > 5_000 and records.select("f").count() > 80
        got = [tuple(r) for r in files.read_csv_rows(spark, str(path)).collect()]
        assert sorted(got, key=repr) == sorted([tuple(c or None for c in r) for r in rows] + [("short", None, None), ("a", "b", "c")], key=repr)
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4


def test_json_array_of_many_blocks(spark, small_blocks, tmp_path):
    rng = random.Random(5)
    text = lambda: rng.choice(["", "a]b[", "{", "}", '"', '\\\\"}', "[1,2]", ",", "é}" * 40, "\n", "}" * 300])
    rows = [{"i": i, text() or "k": [text(), {"deep": {"er": [i, None, text()]}}], "t": text()} for i in range(60)]
    for k, indent in enumerate((None, 1)):
        path = tmp_path / f"{k}.json"
        path.write_text("  \n" * k + json.dumps(rows, indent=indent, ensure_ascii=k == 0) + "\n" * k, encoding="utf-8")
        got = {r.row_idx: json.loads(r.j) for r in files.read_json_array(spark, str(path)).select("row_idx", F.to_json("v").alias("j")).collect()}
        assert [got[i] for i in range(len(rows))] == rows
    for k, (content, n) in enumerate({"[]": 0, " [ ] ": 0, '[{"a": 1}]': 1, "[1, [2], \"x\", null]": 4}.items()):
        (tmp_path / f"few{k}.json").write_text(content)
        assert files.read_json_array(spark, str(tmp_path / f"few{k}.json")).count() == n
    for k, content in enumerate(('{"a": 1}', '[{"a": 1}', "[{a}]", '[{"a": 1}]]', '{"a": [1]}', '["]')):
        (tmp_path / f"bad{k}.json").write_text(content)
        with pytest.raises(ValueError, match="not a JSON array"):
            files.read_json_array(spark, str(tmp_path / f"bad{k}.json"))


def _streamed_cells(spark, tmp_path, batches, keep=None):
    """(the cells after a stream of batches, examples' state at the end): two keys, one of which may be null, in three buckets."""
    ex = spark.createDataFrame([(f"e{i}", f"r{i % 3}") for i in range(60)], "id string, route string")
    kind = "version string, k long, example_id string, output struct<route: string>, error string, arrived timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    changes = streams.cell_changes(arriving, ex, ("version", "k"), keep, buckets=3)
    run = streams.start_cells(changes, f"{tmp_path}/cells", f"{tmp_path}/state", 2)
    run.awaitTermination()
    cells = {tuple(r) for r in streams.read_cells(spark, f"{tmp_path}/cells", changes.schema).collect()}
    return cells, [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]


def test_stream_calls_by_bucket(spark, tmp_path):
    rng, last, batches = random.Random(5), {}, []
    times = iter(rng.sample(range(1000), 360))
    for _ in range(3):
        rows = []
        for _ in range(120):
            v, k, e, t = rng.choice("ab"), rng.choice([None, 7, 2**60 + 1]), rng.randrange(60), next(times)
            route, error = rng.choice([None, "r0", "r1"]), rng.choice([None, None, "down"])
            rows.append((v, k, f"e{e}", (route,) if route else None, error, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=t)))
            if (v, k, e) not in last or t > last[v, k, e][0]:
                last[v, k, e] = (t, f"r{e % 3}", route or "", error)
        batches.append(rows)
    want = collections.Counter((v, k, true, pred) for (v, k, _), (_, true, pred, error) in last.items() if error is None)
    cells, states = _streamed_cells(spark, tmp_path, batches)
    assert cells == {(*cell, n) for cell, n in want.items()}
    assert 0 < max(states) <= 3  # a row of state and a call a bucket, not an example


def test_stream_state_goes_after_its_time(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    row = lambda e, route, d: ("a", 1, e, (route,), None, day(d))
    first = [row(f"e{i}", "r0", 1) for i in range(30)]
    batches = [first, [row("e0", "r1", 2)], [row("e40", "r1", 20)], [row("e41", "r1", 20)], [row("e1", "r2", 3)]]
    cells, states = _streamed_cells(spark, tmp_path, batches, "2 days")
    counts = collections.Counter((f"r{i % 3}", "r0") for i in range(1, 30)) + collections.Counter([("r0", "r1"), ("r1", "r1"), ("r2", "r1")])
    assert cells == {("a", 1, *cell, n) for cell, n in counts.items()}  # the last batch comes too late
    assert states[-1] <= 2 and max(states) == 3


def test_filters_do_not_copy_the_mapping(spark):
    """A filter on the routes mapped, as explode brings one along, stays above the documents that they are made of."""
    rows = spark.range(3).select(F.col("id").alias("row_idx"), F.expr("try_parse_json(concat('{\"q\": \"x\", \"best\": \"a\", \"costs\": {\"a\": ', id, '}}'))").alias("v"))
    m = mapping_op.apply_mapping(rows, {"q": "input", "best": "expected.route", "costs.*": "expected.routes.*.cost"})
    out = m.where("routes IS NOT NULL").select("row_idx", F.explode("routes").alias("route", "r"))
    assert sorted((r.row_idx, r.route, r.r.cost) for r in out.collect()) == [(0, "a", 0.0), (1, "a", 1.0), (2, "a", 2.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform_values") == 1 and plan.count("parse_json") <= 1
