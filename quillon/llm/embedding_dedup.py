"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut into two halves with a codebook each; the pairs of centroids form a grid of cells, and every row is
indexed in one cell. A query visits cells in the order of the multi-sequence algorithm (the sum of its halves'
distances to the centroids), as many as the target recall needs: queries with ids divisible by 20 are held against all
rows by brute force, block by block, and the places of their links' cells in the order are counted, however deep they
are; of many links of a query with one block a few, chosen by hash, stand for all.
Candidates are verified by cosine in double precision.

Equal vectors fold into one representative first. Cells are dealt out in blocks of bounded size, so a crowded cell is
compared block by block in many tasks, and only counts and the links of a spanning forest leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import hashed_sample, hot_and_cold, numbered, smallest_reachable, stored

#: Rows that train the codebooks: a fixed bound; every row is indexed.
SAMPLE_ROWS = 8_000
#: Rows with ids divisible by 20, chosen by hash, that are held against all rows to measure the recall: a fixed bound.
QUERY_ROWS = 2_000
#: With fewer ids divisible by 20 than this, rows are chosen by hash among all.
FEW_QUERIES = 200
#: Links of a query with one block of rows whose depths are found; more are weighed.
DEPTHS_A_BLOCK = 4
#: With fewer links than this among the queries, neighbours made at the threshold itself are measured too.
FEW_LINKS = 200
#: Rows of a cell on average, which sets the number of centroids, and its bounds.
CELL_ROWS, FEWEST, MOST = 500, 4, 512
#: Rows of a block: members and queries of a cell meet block by block; and the queries of it that are compared at once.
BLOCK_ROWS, SLICE_ROWS = 2_048, 256
#: Cells that a task puts in order at once.
SEQUENCE_CELLS = 1 << 21
THRESHOLD = 0.95
TARGET_RECALL = 0.995


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :])


def train_codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means with k-means++ seeding."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    chosen = x[[rng.integers(len(x))]]
    nearest = distances(x, chosen)[:, 0]
    while len(chosen) < k and nearest.sum() > 0:
        chosen = np.vstack([chosen, x[rng.choice(len(x), p=nearest / nearest.sum())]])
        nearest = np.minimum(nearest, distances(x, chosen[-1:])[:, 0])
    for _ in range(rounds):
        own = distances(x, chosen).argmin(1)
        n = np.bincount(own, minlength=len(chosen))
        sums = np.zeros_like(chosen)
        np.add.at(sums, own, x)
        chosen = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], chosen)
    return chosen


def smaller_sums(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row how many sums of an entry of a and one of b (ascending) are below its number: binary searches for all entries of a at once."""
    want = least[:, None] - a
    low, high = np.zeros(a.shape, np.int64), np.full(a.shape, b.shape[1])
    for _ in range(b.shape[1].bit_length()):
        middle = (low + high) // 2
        below = np.take_along_axis(b, np.minimum(middle, b.shape[1] - 1), 1) < want
        open_ = low < high
        low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low.sum(1)


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits

    def sequence(self, x: np.ndarray, visits: int) -> np.ndarray:
        """n x visits cell numbers in ascending order of the sum of half distances.

        The multi-sequence traversal of two sorted lists, for many queries at once: the j-th visited cell is at ranks
        (a, b) with (a + 1)(b + 1) <= j + 1, so only those rank pairs are looked at.
        """
        ranks = np.array([(i, j) for i in range(len(self.first)) for j in range(len(self.second)) if (i + 1) * (j + 1) <= visits])
        step = max(1, SEQUENCE_CELLS // len(ranks))
        return np.concatenate([self._sequence(x[k : k + step], visits, ranks) for k in range(0, max(len(x), 1), step)])

    def _sequence(self, x: np.ndarray, visits: int, ranks: np.ndarray) -> np.ndarray:
        a, b = halves(x)
        da, db = distances(a, self.first), distances(b, self.second)
        oa, ob = da.argsort(1, kind="stable"), db.argsort(1, kind="stable")
        row = np.arange(len(x))[:, None]
        ia, ib = oa[:, ranks[:, 0]], ob[:, ranks[:, 1]]
        order = (da[row, ia] + db[row, ib]).argsort(1, kind="stable")[:, :visits]
        return np.take_along_axis(ia * len(self.second) + ib, order, 1).astype(np.int32)

    def depth(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each row of x how many cells are nearer to it than the own cell of the row of y."""
        (xa, xb), (ya, yb) = halves(x), halves(y)
        da, db = distances(xa, self.first), distances(xb, self.second)
        row = np.arange(len(x))
        reach = da[row, distances(ya, self.first).argmin(1)] + db[row, distances(yb, self.second).argmin(1)]
        return smaller_sums(da, np.sort(db, 1), reach * (1 - 1e-12))

    def link_depths(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A link is found if either end visits the cell of the other."""
        parts = [slice(k, k + SLICE_ROWS) for k in range(0, len(x), SLICE_ROWS)]
        return np.concatenate([np.zeros(0, np.int64), *[np.minimum(self.depth(x[p], y[p]), self.depth(y[p], x[p])) for p in parts]])


def fit_codebooks(sample: np.ndarray, centroids: int, seed: int = 11) -> MultiIndex:
    a, b = halves(sample)
    return MultiIndex(train_codebook(a, centroids, seed), train_codebook(b, centroids, seed + 1), 1)


def neighbours_at(x: np.ndarray, threshold: float, seed: int = 5) -> np.ndarray:
    """For each unit vector one whose cosine with it is the threshold, in a direction drawn at random."""
    noise = np.random.default_rng(seed).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    length = np.sqrt((noise * noise).sum(1, keepdims=True))
    return threshold * x + np.sqrt(1 - threshold**2) * noise / np.where(length > 0, length, 1)


def _few_links(query: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the links with the smallest hashes of each query, DEPTHS_A_BLOCK at most; how many links each of them stands for)."""
    order = np.lexsort((h, query))
    begin = np.nonzero(np.diff(query[order], prepend=-1))[0]
    n = np.diff(begin, append=len(order))
    rank = np.arange(len(order)) - np.repeat(begin, n)
    taken = rank < DEPTHS_A_BLOCK
    return order[taken], np.repeat(n / np.minimum(n, DEPTHS_A_BLOCK), n)[taken]


def _measured(batches: Iterator[pa.RecordBatch], index: MultiIndex, ids: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """depth, n: how many links of the queries with these rows lie how deep."""
    for batch in batches:
        own, x = batch.column("rep").to_numpy(), unit(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, queries.shape[1]))
        for at in range(0, len(x), BLOCK_ROWS):
            part, part_ids = x[at : at + BLOCK_ROWS], own[at : at + BLOCK_ROWS]
            for k in range(0, len(queries), SLICE_ROWS):
                j, i = np.nonzero(queries[k : k + SLICE_ROWS] @ part.T >= threshold)
                j, i = (v[part_ids[i] != ids[j + k]] for v in (j + k, i))
                if len(j):
                    few, weight = _few_links(j, (part_ids[i].view(np.uint64) ^ ids[j].view(np.uint64) * np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15))
                    depth, place = np.unique(index.link_depths(queries[j[few]], part[i[few]]), return_inverse=True)
                    yield pa.record_batch([pa.array(depth, pa.int64()), pa.array(np.bincount(place, weight))], ["depth", "n"])


def measured_visits(reps: DataFrame, index: MultiIndex, rows: int, threshold: float, target: float) -> int:
    """The number of cells to visit so that the target share of the queries' links is found."""
    chosen = hashed_sample(reps.where("rep % 20 = 0").select("rep", "embedding"), ["rep"], QUERY_ROWS, rows // 20).toArrow().sort_by("h").slice(0, QUERY_ROWS)
    if len(chosen) < min(FEW_QUERIES, rows):
        chosen = hashed_sample(reps.select("rep", "embedding"), ["rep"], QUERY_ROWS, rows).toArrow().sort_by("h").slice(0, QUERY_ROWS)
    queries = unit(_matrix(chosen["embedding"]))
    work = partial(_measured, index=index, ids=chosen["rep"].to_numpy(), queries=queries, threshold=threshold)
    found = reps.select("rep", "embedding").mapInArrow(work, "depth long, n double").groupBy("depth").agg(F.sum("n").alias("n")).toArrow()  # a row a depth, of which there are no more than cells
    depth, n = found["depth"].to_numpy(), found["n"].to_numpy()
    if n.sum() < FEW_LINKS:
        made = index.link_depths(queries, unit(neighbours_at(queries, threshold)))
        depth, n = np.concatenate([depth, made]), np.concatenate([n, np.ones(len(made))])
    order = np.argsort(depth)
    at = np.searchsorted(np.cumsum(n[order]), target * n.sum())
    return int(min(depth[order][min(at, len(depth) - 1)] + 2, len(index.first) * len(index.second)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _visiting(batches: Iterator[pa.RecordBatch], index: MultiIndex) -> Iterator[pa.RecordBatch]:
    """Adds cells: the cells that a vector visits; the first is its own."""
    for batch in batches:
        if batch.num_rows:
            cells = index.sequence(unit(_matrix(batch.column("embedding"))), index.visits)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))], [*batch.schema.names, "cells"])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links reach."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _visits(members: pa.Table, homes: np.ndarray) -> np.ndarray:
    """[home, member]: whether the member visits the cell; homes ascend."""
    cells = members["cells"].combine_chunks()
    row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    cell = cells.flatten().to_numpy()
    at = np.minimum(np.searchsorted(homes, cell), len(homes) - 1)
    out = np.zeros((len(homes), len(cells)), bool)
    out[at[homes[at] == cell], row[homes[at] == cell]] = True
    return out


def _in_block(queries: pa.Table, members: pa.Table, threshold: float) -> pa.Table:
    """One block of queries against one block of a cell's members: sums of copies, and links of a spanning forest.

    A pair of which each end visits the other's cell comes up twice; it counts where the smaller id asks. Slices of
    queries are compared one after the other, so a block in which all are linked holds the pairs of one slice only.
    """
    kinds = [("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())]
    if not len(queries) or not len(members):
        return pa.table([pa.array([], k) for _, k in kinds], [x for x, _ in kinds])
    qi, mi = queries["rep"].to_numpy(), members["rep"].to_numpy()
    first = pc.list_element(queries["cells"], 0).to_numpy()
    homes, home = np.unique(first, return_inverse=True)
    visits = _visits(members, homes)
    ids, place = np.unique(np.concatenate([qi, mi]), return_inverse=True)
    q, m = unit(_matrix(queries["embedding"])), unit(_matrix(members["embedding"])).T
    q_copies, m_copies = queries["copies"].to_numpy(), members["copies"].to_numpy()
    n, label, every = np.zeros(len(ids)), np.arange(len(ids)), np.arange(len(ids))
    for k in range(0, len(qi), SLICE_ROWS):
        i, j = np.nonzero(q[k : k + SLICE_ROWS] @ m >= threshold)
        i += k
        once = (qi[i] < mi[j]) | ((qi[i] > mi[j]) & ~visits[home[i], j])
        i, j = i[once], j[once]
        a, b = place[i], place[len(qi) + j]
        n += np.bincount(a, m_copies[j], len(ids)) + np.bincount(b, q_copies[i], len(ids))
        label = forest(len(ids), np.concatenate([every, a]), np.concatenate([label, b]))
    keep = np.nonzero(n)[0]
    return pa.table([pa.array(ids[keep]), pa.array(n[keep].astype(np.int64)), pa.array(ids[label][keep])], [x for x, _ in kinds])


def _linked(reps: DataFrame, rows: int, threshold: float, target: float) -> DataFrame:
    """rep, n, other over representatives of one dimension; n adds up to the copies of a vector's neighbours."""
    sample = hashed_sample(reps.select("rep", "embedding"), ["rep"], SAMPLE_ROWS, rows).toArrow()
    x = unit(_matrix(sample.sort_by("h").slice(0, SAMPLE_ROWS)["embedding"]))
    index = fit_codebooks(x, int(np.clip(np.ceil(np.sqrt(rows / CELL_ROWS)), FEWEST, MOST)))
    index.visits = measured_visits(reps, index, rows, threshold, target)
    with_cells = T.StructType([*reps.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    placed = stored(reps.mapInArrow(partial(_visiting, index=index), with_cells), "vector-cells")
    asks = placed.withColumn("cell", F.explode("cells"))
    held = placed.withColumn("cell", F.element_at("cells", 1))
    # a row a cell, and cells are bounded by the codebooks
    blocks = held.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("mb")).join(
        asks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("qb")), "cell")
    blocks = stored(blocks, "vector-blocks")
    members = held.join(blocks, "cell").select("rep", "copies", "embedding", "cells", "cell", F.pmod(F.xxhash64("rep"), F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    queries = asks.join(blocks, "cell").select("rep", "copies", "embedding", "cells", "cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(F.xxhash64(F.lit("q"), "rep"), F.col("qb")).cast("int").alias("q"))
    key = ["cell", "m", "q"]
    members = members.select(*[F.col(c).alias(c) for c in members.columns])  # both come from one table: columns of its own
    met = queries.groupBy(*key).cogroup(members.groupBy(*key))
    return met.applyInArrow(partial(_in_block, threshold=threshold), "rep long, n long, other long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """vectors plus n_links, component_id and kept (columns of those names are replaced).

    Two rows link if the cosine of their vectors is at least `threshold`; equal vectors always do. Vectors that are
    null, empty or zero, or hold a null or non-finite component, and rows with a null id link with nothing, and so do
    vectors of different dimensions. component_id is the smallest id reachable, a row's own if it has no link; kept
    marks the row that bears it (a row with a null id stays). Rows repeated with one id are rows of their own for
    n_links. An empty table gives an empty result.
    """
    bare, (id_col, vector_col), columns = numbered(vectors.drop("n_links", "component_id", "kept"), id_col, vector_col)
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = bare.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("embedding"))
    reps = stored(rows.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-reps")
    sizes = {r["d"]: r["n"] for r in reps.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = vectors.sparkSession.createDataFrame([], "rep long, n long, other long")
    for d, n in sorted(sizes.items()):
        found = found.union(_linked(reps.where(F.size("embedding") == d), n, threshold, target))
    found = stored(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = smallest_reachable(found.where("rep != other"), "rep", "other")
    known = stored(
        reps.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
        .select(F.col("embedding").alias("_v"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c")),
        "vector-known",
    )
    hot, cold = hot_and_cold(known, "copies", bare.count())
    same = (v == F.col("_v")) & F.coalesce(sound, F.lit(False))
    joined = bare.join(hot, same).unionByName(bare.join(F.broadcast(hot.select("_v")), same, "left_anti").join(cold, same, "left"))
    component = F.coalesce("_c", F.col(id_col).cast("long"))
    return joined.select(
        *columns, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"),
    )
