"""The pipeline's stages, each against plain Python on its own input."""

import corpus_pipeline
from conftest import DATA

from quillon.llm.shared import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, DATA), "test")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in seen[name][1])
    before, after = seen["quality"]
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    assert {r.doc_id for r in after} < {r.doc_id for r in before} and len(bad & {r.doc_id for r in after}) < len(bad & {r.doc_id for r in before})
    before, after = seen["line dedup"]
    lines, kept = [x for r in sorted(before) for x in r.text.split("\n")], [x for r in sorted(after) for x in r.text.split("\n")]
    assert {" ".join(sorted(set(x.lower().split()))) for x in lines if x.split()} >= {" ".join(sorted(set(x.lower().split()))) for x in kept}
    worded = [frozenset(x.encode().lower().split()) for x in kept if x.split()]
    assert len(set(worded)) == len(worded)
    before, after = seen["near copies"]
    sets = {}
    for r in before:
        w = r.text.lower().split()
        sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    stay = {r.doc_id for r in after}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for r in before:
        if r.doc_id not in stay:
            assert any(s != r.doc_id and near(s, r.doc_id) for s in sets)
    for a in stay:
        assert not any(a < b and near(a, b) for b in stay)
    before, after = seen["mixing"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 20 and all(n <= 2 * size[d] for d, n in taken.items())
    before, after = seen["packing"]
    assert sorted({r.doc_id for r in after}) == sorted({r.doc_id for r in before}) and all(r.offset + r.length <= 4096 for r in after)


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_stages_with_nulls_ties_and_other_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    data = [
        (1, good, "en", "a", 1), (2, good, "en", "a", 1), (2, good, "en", "a", 1), (None, good, None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \n \t", "en", None, 4),
        (6, good + " more", "de", "c", 1), (7, "x y", "en", "a", 3), (8, good.replace("word7 ", "other "), "en", "b", 1), (9, "long " * 60_000, "en", "a", 300_000),
    ]
    docs = spark.createDataFrame([(*r, 7, 7) for r in data], "doc_id long, text string, lang string, source string, n_chars long, _size int, threshold int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, DATA)
            assert out.columns == docs.columns
            got = out.collect()
            assert bool(got) == (table is docs) and all(r._size == 7 and r.threshold == 7 for r in got)
            if name == "near copies" and got:
                assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 7, 9]
    assert corpus_pipeline.packing(spark, docs, DATA).count() >= len(data) and corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0
