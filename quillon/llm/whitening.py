"""Exact whitening of embeddings through the characteristic polynomial of their integer scatter matrix.

Vectors become integers; of the distinct ones tasks add up products exactly, and with n of them, sums S and products Q
the scatter is the integer matrix n * Q - S S', which is n * n times the covariance. Its characteristic polynomial is
found modulo many primes, in tasks, by reduction to Hessenberg form, and put together by Chinese remaindering. All
roots are real, so the sign changes of a Taylor shift count those beyond a point exactly; bisection with that isolates
the largest ones to some 190 bits, with multiplicities. Inverse iteration in decimals of 150 digits then gives the null
space of the matrix less a root. What meets on the driver has the size of the matrix, whatever the number of rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import numbered, stored, tidied

#: Vectors are multiplied by this before they are cut to whole numbers.
SCALE = 256
#: Bits to which roots are isolated; roots closer than half as many bits have their components made together.
ROOT_BITS = 192
DIGITS = 150
#: Primes that a task reduces at once, and the bits of the limbs that exact sums are shuffled in.
PRIMES_AT_ONCE = 8
LIMB = 40
LIMBS = 4


@dataclass
class Whitening:
    """n and sums of the fit list; unit components with their eigenvalues and shares of the trace, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: list[list[float]]
    eigenvalues: list[float]
    explained: list[float]


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as whole numbers) for each length: rows with a vector that has entries, all of them finite."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sound = (sizes > 0) & (np.bincount(owner, weights=~np.isfinite(values), minlength=len(sizes)) == 0)
    at = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sound]).tolist():
        rows = np.flatnonzero(sound & (sizes == d))
        with np.errstate(over="ignore"):
            scaled = np.floor(values[at[rows][:, None] + np.arange(d)] * SCALE)
        whole = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        whole[scaled >= 2.0**63] = 2**63 - 1
        yield rows, whole


@tidied
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, x: the whole numbers as two bytes each where that holds the row, else eight."""
    for batch in batches:
        for _, x in whole_vectors(batch.column(0)):
            narrow = ((x >= -(2**15)) & (x < 2**15)).all(axis=1)
            packed = [np.ascontiguousarray(v).tobytes() for v in x[narrow].astype("<i2")] + [np.ascontiguousarray(v).tobytes() for v in x[~narrow].astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), x.shape[1], np.int32)), pa.array(packed, pa.binary())], ["d", "x"])


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    wide = pc.equal(pc.binary_length(column), 8 * d).to_numpy(zero_copy_only=False)
    parts = [np.frombuffer(b"".join(column.filter(pa.array(mask)).to_pylist()), kind).reshape(-1, d).astype(np.int64) for mask, kind in ((~wide, "<i2"), (wide, "<i8"))]
    return np.concatenate(parts)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x without rounding, as Python integers."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if top * top * len(x) < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = x.astype(object)
    return big.T.dot(big)


def _limbs(v: int) -> list[int]:
    return [v >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)] + [v >> LIMB * (LIMBS - 1)]


@tidied
def _scatter(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """i, j, limbs: sums of products at (i, j), of entries at (i, -1), rows at (-1, -1)."""
    n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
    for batch in batches:
        for k in range(0, batch.num_rows, 8_192):
            x = unpacked(batch.column(0).slice(k, 8_192), d)
            n += len(x)
            sums = sums + x.astype(object).sum(axis=0) if np.abs(x.astype(np.float64)).max(initial=0) > 2**48 else sums + x.sum(axis=0).astype(object)
            products = products + exact_products(x)
    if n:
        cells = [(-1, -1, n)] + [(i, -1, int(sums[i])) for i in range(d)] + [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
        columns = [[c[0] for c in cells], [c[1] for c in cells], *zip(*[_limbs(c[2]) for c in cells])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", *[f"l{k}" for k in range(LIMBS)]])


def primes_below(top: int, many: int) -> list[int]:
    """The `many` largest odd primes below top, which is 2**32 at most."""

    def is_prime(p: int) -> bool:
        if any(p % q == 0 for q in (3, 5, 7, 11, 13)):
            return p in (3, 5, 7, 11, 13)
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3,215,031,751
            y = pow(base, odd, p)
            if y not in (1, p - 1) and all((y := y * y % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], top - 1 | 1
    while len(found) < many:
        found += [p] if is_prime(p) else []
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """[prime, power]: coefficients of det(x I - matrix) modulo each prime (under 2**31), by similarity to a Hessenberg matrix."""
    d, p = len(matrix), np.array(primes, np.int64)[:, None, None]
    a = np.stack([(matrix % q).astype(np.int64) for q in primes])
    every = np.arange(len(primes))
    for m in range(1, d - 1):
        pivot = m + (a[:, m:, m - 1] != 0).argmax(axis=1)
        a[every, m], a[every, pivot] = a[every, pivot], a[every, m]
        a[every, :, m], a[every, :, pivot] = a[every, :, pivot], a[every, :, m]
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(a[:, m, m - 1], primes)])
        factor = a[:, m + 1 :, m - 1] * inverse[:, None] % p[:, :, 0]
        a[:, m + 1 :] = (a[:, m + 1 :] - factor[:, :, None] * a[:, m, None] % p) % p
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1 :] * factor[:, None] % p).sum(axis=2)) % p[:, :, 0]
    polys = np.zeros((len(primes), d + 1, d + 1), np.int64)  # of the leading square parts
    polys[:, 0, 0] = 1
    below = np.ones((len(primes), 0), np.int64)  # products of the entries under the diagonal, from each column on
    for k in range(d):
        if k:
            below = np.concatenate([below, np.ones((len(primes), 1), np.int64)], axis=1) * a[:, k, k - 1, None] % p[:, :, 0]
        weights = a[:, :k, k] * below % p[:, :, 0]
        new = np.zeros((len(primes), d + 1), np.int64)
        new[:, 1:] = polys[:, k, :-1]
        new -= a[:, k, k, None] * polys[:, k] % p[:, :, 0]
        new -= (weights[:, :, None] * polys[:, :k] % p).sum(axis=1)
        polys[:, k + 1] = new % p[:, :, 0]
    return polys[:, d]


def _residues(batches: Iterator[pa.RecordBatch], matrix) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        primes = batch.column(0).to_pylist()
        for k in range(0, len(primes), PRIMES_AT_ONCE):
            part = primes[k : k + PRIMES_AT_ONCE]
            found = polynomial_modulo(np.array(matrix.value, object), part)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "coefficients"])


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients by power of det(x I - matrix) of a matrix without negative eigenvalues.

    With eigenvalues of sum t none of its d coefficients is beyond (1 + t / d) ** d, which sets the number of primes.
    """
    d = len(matrix)
    bound = 2 * (2 + sum(matrix[i][i] for i in range(d)) // d) ** d
    primes = primes_below(2**31, bound.bit_length() // 30 + 1)
    held = spark.sparkContext.broadcast(matrix)
    tasks = -(-len(primes) // PRIMES_AT_ONCE)
    rows = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(tasks).mapInArrow(partial(_residues, matrix=held), "prime long, coefficients array<long>").collect()
    held.unpersist()
    product = math.prod(primes)
    parts = [(r["coefficients"], product // r["prime"] * pow(product // r["prime"], -1, r["prime"])) for r in rows]
    found = [sum(c[k] * unit for c, unit in parts) % product for k in range(d + 1)]
    return [v - product if 2 * v > product else v for v in found]


def roots_beyond(coefficients: list[int], at: int) -> int:
    """How many roots, each as often as it is one, are greater than the whole number `at`: exact where all roots are real."""
    c = coefficients[:]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], most: int) -> tuple[list[int], int]:
    """(the largest positive roots times 2 ** shift, cut to whole numbers, falling; shift), each as often as it is one."""
    d = len(coefficients) - 1
    positive = d - next(k for k, v in enumerate(coefficients) if v)
    top = -coefficients[d - 1] if d else 0  # the roots' sum
    shift = max(0, ROOT_BITS - top.bit_length())
    while True:
        scaled = [v << shift * (d - k) for k, v in enumerate(coefficients)]
        found: list[int] = []
        known = {0: positive, (top << shift) + 1: 0}  # roots beyond a point
        for k in range(min(most, positive)):
            low = max(a for a, n in known.items() if n > k)
            high = min(a for a, n in known.items() if n <= k)
            while high - low > 1:
                middle = (low + high) // 2
                known[middle] = roots_beyond(scaled, middle)
                low, high = (middle, high) if known[middle] > k else (low, middle)
            found.append(low)
        if not found or found[-1].bit_length() >= ROOT_BITS // 2:
            return found, shift
        shift += ROOT_BITS  # a root that small against the largest needs more places


def null_space(matrix: list[list[int]], root: int, shift: int, many: int) -> list[list[float]]:
    """Orthonormal vectors of the space that the matrix, less root / 2 ** shift, takes to zero: inverse iteration by an LU decomposition."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS + shift // 3
        a = [[Decimal((v << shift) - (root if i == j else 0)) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            a[k][k] = a[k][k] or Decimal(1).scaleb(-DIGITS // 2)  # the root is exact
            for i in range(k + 1, d):
                factor = a[i][k] = a[i][k] / a[k][k]
                if factor:
                    upper, row = a[k], a[i]
                    for j in range(k + 1, d):
                        row[j] -= factor * upper[j]
        chosen = random.Random(d)
        vectors = [[Decimal(chosen.randrange(-1_000_000, 1_000_000)) for _ in range(d)] for _ in range(many)]
        for _ in range(3):
            solved: list[list[Decimal]] = []
            for v in vectors:
                y = [v[i] for i in order]
                for i in range(d):
                    y[i] -= sum(map(Decimal.__mul__, a[i][:i], y[:i]), Decimal(0))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum(map(Decimal.__mul__, a[i][i + 1 :], y[i + 1 :]), Decimal(0))) / a[i][i]
                for _ in range(2):
                    norm = sum((c * c for c in y), Decimal(0)).sqrt()
                    y = [c / norm for c in y]
                    for other in solved:
                        along = sum(map(Decimal.__mul__, y, other), Decimal(0))
                        y = [c - along * o for c, o in zip(y, other)]
                norm = sum((c * c for c in y), Decimal(0)).sqrt()
                solved.append([c / norm for c in y])
            vectors = solved
        signs = [1 if max(v, key=abs) > 0 else -1 for v in vectors]
        return [[float(s * c) for c in v] for s, v in zip(signs, vectors)]


def components_of(spark: SparkSession, n: int, sums: list[int], products: list[list[int]], most: int) -> Whitening:
    """The components of the covariance of n vectors with such sums and sums of products."""
    d = len(sums)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    common = math.gcd(*[v for row in scatter for v in row])
    if not common:
        return Whitening(n, sums, [], [], [])
    small = [[v // common for v in row] for row in scatter]
    roots, shift = largest_roots(characteristic_polynomial(spark, small), most)
    trace = sum(small[i][i] for i in range(d))
    vectors: list[list[float]] = []
    k = 0
    while k < len(roots):
        near = [r for r in roots[k:] if roots[k] - r <= roots[k] >> ROOT_BITS // 2]
        vectors += null_space(small, near[0], shift, len(near))
        k += len(near)
    return Whitening(n, sums, vectors, [r * common / (n * n << shift) for r in roots], [r / (trace << shift) for r in roots])


def fit_list(vectors: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(d, x: the distinct vectors as packed whole numbers, those of the length d that most of them have, ties: the longer; d). Kept in the shared folder."""
    held = vectors.select(F.col(f"`{vector_col}`").cast("array<double>"))
    distinct = stored(held.mapInArrow(_packed, "d int, x binary").distinct(), "whitening-fit")
    commonest = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = commonest["d"] if commonest else 0
    return distinct.where(F.col("d") == d), d


def fit_whitening(fit: DataFrame, d: int, most: int = 4) -> Whitening:
    """Up to `most` components with positive eigenvalues of the fit list (d, x)."""
    if not d:
        return Whitening(0, [], [], [], [])
    names = [f"l{k}" for k in range(LIMBS)]
    parts = fit.select("x").mapInArrow(partial(_scatter, d=d), "i long, j long, " + ", ".join(f"{c} long" for c in names))
    cells = {(r["i"], r["j"]): sum(r[c] << LIMB * k for k, c in enumerate(names)) for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    products = [[cells[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return components_of(fit.sparkSession, cells[-1, -1], [cells[i, -1] for i in range(d)], products, most)


def whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """[row, component] of whole-number vectors."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if fit.n * top + max(map(abs, fit.sums)) < 2**62:
        centred = (fit.n * x - np.array(fit.sums, np.int64)) / fit.n
    else:
        centred = x - np.array([s / fit.n for s in fit.sums])
    return centred @ np.array(fit.components).T / np.sqrt(fit.eigenvalues)


def deviations(x: np.ndarray, fit: Whitening) -> pa.Array:
    """Exact sums of (n * x - S) ** 2; null where that is no long any more."""
    rough = np.square(fit.n * x.astype(np.float64) - np.array(fit.sums, np.float64)).sum(axis=1)
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    with np.errstate(over="ignore"):  # whole numbers wrap, so a sum that fits comes out right
        apart = np.int64(wrap(fit.n)) * x - np.array([wrap(s) for s in fit.sums], np.int64)
        exact = (apart * apart).sum(axis=1)
    fits = rough < 0.999 * 2**63
    for i in np.flatnonzero(~fits & (rough < 1.001 * 2**63)).tolist():
        fits[i] = sum((fit.n * v - s) ** 2 for v, s in zip(x[i].tolist(), fit.sums)) < 2**63
    return pa.array(exact, mask=~fits)


def _moments(batches: Iterator[pa.RecordBatch], fit: Whitening) -> Iterator[pa.RecordBatch]:
    """a, b, n, means and centred products of whitened components a <= b, for each batch."""
    for batch in batches:
        if batch.num_rows:
            w = whitened(unpacked(batch.column(0), len(fit.sums)), fit)
            mean = w.mean(axis=0)
            centred = (w - mean).T @ (w - mean)
            a, b = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, np.full(len(a), len(w)), mean[a], mean[b], centred[a, b])], ["a", "b", "n", "mean_a", "mean_b", "c"])


def identity_error(fit_rows: DataFrame, fit: Whitening) -> float:
    """The largest entry by which the covariance of the whitened fit list is off the identity."""
    parts = fit_rows.select("x").mapInArrow(partial(_moments, fit=fit), "a long, b long, n long, mean_a double, mean_b double, c double")
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / n
    covariance = F.sum(F.col("c") + F.col("n") * F.col("mean_a") * F.col("mean_b")) / n - mean("mean_a") * mean("mean_b")
    off = parts.groupBy("a", "b").agg(covariance.alias("v")).select(F.abs(F.col("v") - (F.col("a") == F.col("b")).cast("double")).alias("off"))
    return off.agg(F.max("off")).first()[0]


def _projected(batches: Iterator[pa.RecordBatch], fit: Whitening, error: float, id_name: str) -> Iterator[pa.RecordBatch]:
    many = len(fit.components)
    for batch in batches:
        for start in range(0, batch.num_rows, 4_096):
            part = batch.slice(start, 4_096)
            for rows, x in whole_vectors(part.column(1)):
                if x.shape[1] != len(fit.sums):
                    continue
                again = pa.array(np.repeat(np.arange(len(rows)), many))
                size = len(rows) * many
                columns = [
                    part.column(0).take(pa.array(rows)).take(again), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))), pa.array(np.full(size, fit.n)),
                    deviations(x, fit).take(again), pa.array(whitened(x, fit).ravel()), pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_name, "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of the first `most` components.

    Vectors that are null or empty, or hold a null or a number that isn't finite, have no rows, nor have those of another
    length than most distinct vectors (ties: the longer). Numbers beyond a long count as the farthest long. Only
    components with a positive eigenvalue are there, fewer than `most` where the fit list has fewer dimensions; where all
    vectors are equal, or in an empty table, there is no row. Components with equal eigenvalues are any orthonormal ones
    of their space. A deviation beyond a long is null. Equal rows and ids, and null ids, have rows of their own; other
    columns aren't read.
    """
    docs, (key, vector), _ = numbered(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")), "id", "vector")
    rows, d = fit_list(docs, vector)
    fit = fit_whitening(rows, d, most)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not fit.components:
        return vectors.sparkSession.createDataFrame([], schema)
    work = partial(_projected, fit=fit, error=identity_error(rows, fit), id_name=id_col)
    return docs.select(key, F.col(vector).cast("array<double>")).mapInArrow(work, schema)
