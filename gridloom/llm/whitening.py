"""Embedding whitening by exact algebra: the integer scatter's characteristic polynomial, its roots, null-space iteration.

Vectors become integers, so that the scatter matrix is one of integers. Its characteristic polynomial is computed modulo many
primes (Hessenberg form, one prime after another in Spark tasks) and put together by Chinese remainders. All its roots are
real, so the number of sign changes of the shifted polynomial counts the roots above a point exactly; intervals are halved
until each holds one root (or roots nearer than any precision asked for), then until the root is known to 200 bits. Components
are null vectors of the shifted matrix, found by inverse iteration in decimal arithmetic of as many digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from gridloom.llm.common import ready
from gridloom.session import settle

#: Integers are floor(SCALE * c); adding a number to all of them would change nothing below.
SCALE = 64
#: Components that are computed at most.
COMPONENTS = 16
#: Roots nearer to each other than this part of the largest are one cluster; roots are known to this part.
CLUSTER_BITS, ROOT_BITS = 100, 200
#: Bits of a limb in which exact sums travel: sums of 2**23 tasks fit in a long.
LIMB, LIMBS = 40, 5
#: Rows of output that a task makes at once.
STEP_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows in the fit list, per-dimension sums, components (rows), eigenvalues, shares, and its error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def integers(table: DataFrame, id_col: str, vector_col: str, size: int | None = None, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, packed) of the rows with finite vectors, and the vectors' size.

    ``packed`` holds the integers floor(scale * c) in the fewest bytes that hold them all, so equal bytes mean equal vectors. Left
    out: vectors that are null, empty, of another size than ``size`` (default: the commonest, the smallest of equals), that hold
    null or non-finite entries, or entries whose integer doesn't fit a long. Null ids stay.
    """
    ready(table.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale))
    rows = table.where(F.col(f"`{vector_col}`").isNotNull()).where((F.size(vector) > 0) & fits)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    if size is None:
        sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
        size = sizes[0]["size"] if sizes else 0
    schema = StructType([StructField("vec_id", LongType()), StructField("packed", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = np.floor(values * scale).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(y), pa.binary())], schema=arrow)

    return rows.where(F.size("vector") == size).mapInArrow(run, schema), size


def pack(y: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: the width, then the integers in that width."""
    most = np.maximum(y.max(axis=1), ~y.min(axis=1))
    width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(y)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for i, row in zip(rows.tolist(), y[rows].astype(f"<i{w}")):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpack(packed: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(packed), size), np.int64)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(packed):
        by_width.setdefault(p[0], []).append(i)
    for w, rows in by_width.items():
        out[rows] = np.frombuffer(b"".join(packed[i][1:] for i in rows), f"<i{w}").reshape(len(rows), size)
    return out


def exact_sums(rows: DataFrame, size: int, cells: Callable[[np.ndarray], Iterator[list[int]]], n_cells: int) -> list[int]:
    """Sums over all rows of ``n_cells`` integers that ``cells`` makes of each matrix of rows; integers of up to 200 bits.

    A task sends one row per cell, in limbs of 40 bits; the driver gets ``n_cells`` rows.
    """
    names = [f"l{i}" for i in range(LIMBS)]
    schema = StructType([StructField("cell", IntegerType()), *[StructField(n, LongType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        total = [0] * n_cells
        for batch in batches:
            if batch.num_rows:
                for part in cells(unpack(batch.column(0).to_pylist(), size)):
                    total = [t + int(p) for t, p in zip(total, part)]
        mask = (1 << LIMB) - 1
        limbs = [[t >> (LIMB * i) & mask if i < LIMBS - 1 else t >> (LIMB * i) for t in total] for i in range(LIMBS)]
        for lo in range(0, n_cells, STEP_ROWS):
            hi = min(n_cells, lo + STEP_ROWS)
            columns = [pa.array(range(lo, hi), pa.int32()), *[pa.array(x[lo:hi], pa.int64()) for x in limbs]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = rows.select("packed").mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    out = [0] * n_cells
    for r in found.collect():
        out[r["cell"]] = sum(r[n] << (LIMB * i) for i, n in enumerate(names))
    return out


def _column_sums(size: int):
    def cells(y: np.ndarray):
        if float(np.abs(y).max()) * len(y) < 2.0**62:
            yield y.sum(axis=0).tolist()
        else:
            yield y.astype(object).sum(axis=0).tolist()

    return cells


def _products(size: int, centre: list[int]):
    """Sums of products of centred integers, upper triangle; by floating products where these are exact."""
    upper = np.triu_indices(size)

    def cells(y: np.ndarray):
        wide = max(map(abs, centre)) + int(np.abs(y).max()) >= 2**62
        z = y.astype(object) - np.array(centre, object) if wide else y - np.array(centre, np.int64)
        most = max(1, int(max(z.max(), -z.min())))
        step = min(STEP_ROWS, 2**53 // most**2)
        if wide or step < 1:
            z = z.astype(object)
            yield (z.T @ z)[upper].tolist()
            return
        for lo in range(0, len(z), step):
            part = z[lo : lo + step].astype(np.float64)
            yield (part.T @ part)[upper].astype(np.int64).tolist()

    return cells


def is_prime(n: int) -> bool:
    """Whether n < 2**32 is prime."""
    if n < 4:
        return n > 1
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n % base == 0:
            return n == base
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo a prime below 2**31, constant term first: Hessenberg form, then a recurrence."""
    h = matrix % p
    d = len(h)
    for m in range(1, d - 1):
        rows = np.flatnonzero(h[m:, m - 1]) + m
        if not len(rows):
            continue
        if rows[0] != m:
            h[[m, rows[0]]] = h[[rows[0], m]]
            h[:, [m, rows[0]]] = h[:, [rows[0], m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        # The inverse step on columns; each product is reduced before it is added.
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polys[k, :-1]
        now = (now - h[k, k] * polys[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            now = (now - int(h[i, k]) * product % p * polys[i]) % p
        polys[k + 1] = now
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact characteristic polynomial of a positive semidefinite integer matrix, constant term first.

    Its coefficients are elementary symmetric functions of roots that are not negative, and so bounded through the trace; as
    many primes are taken as their product needs to exceed twice the bound. Each prime is a row; tasks reduce the matrix (at most
    size * size integers) by it.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(math.ceil(Fraction(math.comb(d, k) * trace**k, d**k)) for k in range(d + 1)) + 1
    primes, product, candidate = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(candidate):
            primes.append(candidate)
            product *= candidate
        candidate -= 2
    shared = spark.sparkContext.broadcast([[int(x) for x in row] for row in matrix])
    schema = StructType([StructField("prime", LongType()), StructField("power", IntegerType()), StructField("value", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                reduced = np.array([[x % p for x in row] for row in shared.value], np.int64)
                values = polynomial_mod(reduced, p)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(values)), pa.array(range(len(values)), pa.int32()), pa.array(values)], schema=arrow)

    each = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), 64), "prime")
    residues: dict[int, dict[int, int]] = {}
    for r in each.mapInArrow(run, schema).collect():
        residues.setdefault(r["power"], {})[r["prime"]] = r["value"]
    factors = {p: (rest := product // p) * pow(rest, -1, p) for p in primes}
    out = []
    for power in range(d + 1):
        value = sum(residues[power][p] * factors[p] for p in primes) % product
        out.append(value - product if value > product // 2 else value)
    return out


def _shifted(coefficients: list[int], at: int, bits: int) -> list[int]:
    """Coefficients of p((y + at) / 2**bits) * 2**(bits * degree)."""
    d = len(coefficients) - 1
    c = [x << (bits * (d - i)) for i, x in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    return c


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots, with multiplicity, lie above at / 2**bits; exact for polynomials whose roots are all real."""
    signs = [c > 0 for c in _shifted(coefficients, at, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _positive_at(coefficients: list[int], at: int, bits: int) -> int:
    """Sign of the polynomial at at / 2**bits."""
    total = 0
    for i, c in enumerate(reversed(coefficients)):
        total = total * at + (c << (bits * i))
    return (total > 0) - (total < 0)


def largest_roots(coefficients: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The largest ``most`` positive roots of a real-rooted polynomial, falling: (value to 200 bits, how many roots it stands for)."""
    zero = next(i for i, c in enumerate(coefficients) if c)
    coefficients = coefficients[zero:]
    d = len(coefficients) - 1
    most = min(most, d)
    if not most:
        return []
    bits, high = 0, 1 << max(1, (abs(coefficients[-2]).bit_length() + 1))
    scale = high.bit_length()
    found: list[tuple[int, int, int, int]] = []
    open_ = [(0, high, 0, d, 0)]
    while open_:
        low, high, bits, above_low, above_high = open_.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1 or (high - low).bit_length() - bits < scale - CLUSTER_BITS - 1:
            found.append((low, high, bits, above_low - above_high))
            continue
        if high - low < 2:
            low, high, bits = low << 8, high << 8, bits + 8
        middle = (low + high) // 2
        n = roots_above(coefficients, middle, bits)
        open_ += [(low, middle, bits, above_low, n), (middle, high, bits, n, above_high)]
    exact = [(_narrowed(coefficients, *f[:3], scale) if f[3] == 1 else Fraction(f[0] + f[1], 2 << f[2]), f[3]) for f in found]
    merged: list[tuple[Fraction, int]] = []
    for value, n in sorted(exact, reverse=True):
        if merged and (merged[-1][0] - value) * 2 ** (CLUSTER_BITS - 10) < merged[0][0]:
            first, m = merged[-1]
            merged[-1] = ((first * m + value * n) / (m + n), m + n)
        else:
            merged.append((value, n))
    return merged


def _narrowed(coefficients: list[int], low: int, high: int, bits: int, scale: int) -> Fraction:
    """The one root in (low, high] / 2**bits, by halving on exact signs."""
    if _positive_at(coefficients, high, bits) == 0:
        return Fraction(high, 1 << bits)
    side = _positive_at(coefficients, high, bits)
    more = max(0, ROOT_BITS - scale - bits)
    low, high, bits = low << more, high << more, bits + more
    while high - low > 1:
        middle = (low + high) // 2
        sign = _positive_at(coefficients, middle, bits)
        if sign == 0:
            return Fraction(middle, 1 << bits)
        low, high = (low, middle) if sign == side else (middle, high)
    return Fraction(low + high, 2 << bits)


def null_vectors(matrix: list[list[int]], value: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal eigenvectors for a root: inverse iteration on the shifted matrix in decimal arithmetic."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    with localcontext() as context:
        context.prec = 2 * ROOT_BITS * 3 // 10 + len(str(trace)) + 20
        shift = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= shift
        swaps, tiny = [], Decimal(trace).scaleb(-context.prec)
        for k in range(d):
            at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            swaps.append(at)
            if at != k:
                a[[k, at]] = a[[at, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny  # the shift is the root itself, as near as digits tell
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k : k + 1] * a[k, k + 1 :]

        def solved(b: np.ndarray) -> np.ndarray:
            b = b.copy()
            for k in range(d):
                if swaps[k] != k:
                    b[[k, swaps[k]]] = b[[swaps[k], k]]
                b[k + 1 :] = b[k + 1 :] - a[k + 1 :, k] * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - sum(a[k, k + 1 :] * b[k + 1 :], Decimal(0))) / a[k, k]
            return b

        start = np.random.Generator(np.random.PCG64(11)).integers(-1000, 1000, (count, d))
        vectors = [np.array([Decimal(int(x)) for x in row], object) for row in start]
        for _ in range(3 if count == 1 else 12):
            made: list[np.ndarray] = []
            for v in vectors:
                v = solved(v)
                v = v / max(abs(x) for x in v)
                for u in made * 2:
                    v = v - u * sum(u * v, Decimal(0))
                made.append(v / sum(v * v, Decimal(0)).sqrt())
            vectors = made
        return np.array([[float(x) for x in v] for v in vectors])


def fit_whitening(distinct: DataFrame, size: int, most: int = COMPONENTS) -> Whitening:
    """Fit on a table of distinct packed vectors; the driver holds matrices of size * size and what is below them.

    Only eigenvalues above zero give components, at most ``most``. Clusters of equal eigenvalues get an orthonormal basis.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if not n:
        return Whitening(0, [], np.zeros((0, size)), np.zeros(0), np.zeros(0))
    sums = exact_sums(distinct, size, _column_sums(size), size)
    centre = [s // n for s in sums]
    upper = exact_sums(distinct, size, _products(size, centre), size * (size + 1) // 2)
    rest = [s - n * c for s, c in zip(sums, centre)]
    scatter = [[0] * size for _ in range(size)]
    for (i, j), value in zip(zip(*np.triu_indices(size)), upper):
        scatter[i][j] = scatter[j][i] = n * value - rest[i] * rest[j]
    # A common factor of all entries only makes the numbers longer.
    common = math.gcd(*[x for row in scatter for x in row]) or 1
    small = [[x // common for x in row] for row in scatter]
    trace = sum(small[i][i] for i in range(size))
    if not trace:
        return Whitening(n, sums, np.zeros((0, size)), np.zeros(0), np.zeros(0))
    clusters = largest_roots(characteristic_polynomial(spark, small), most)
    components = _components(spark, small, clusters, most)
    values = [v for v, count in clusters for _ in range(count)][:most]
    return Whitening(
        n, sums, components, np.array([float(v * common / n**2) for v in values]), np.array([float(v / trace) for v in values]))


def _components(spark: SparkSession, matrix: list[list[int]], clusters: list[tuple[Fraction, int]], most: int) -> np.ndarray:
    """Unit eigenvectors, one row each; every root (or cluster of roots) is a row that some task solves."""
    rows, have = [], 0
    for k, (value, count) in enumerate(clusters):
        rows.append((k, str(value.numerator), str(value.denominator), min(count, most - have)))
        have += rows[-1][3]
    shared = spark.sparkContext.broadcast([[int(x) for x in row] for row in matrix])
    schema = StructType([StructField("root", IntegerType()), StructField("vectors", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k, over, under, count in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_vectors(shared.value, Fraction(int(over), int(under)), count)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.tobytes()])], schema=arrow)

    given = spark.createDataFrame(rows, "root int, over string, under string, n int").repartition(len(rows), "root")
    found = {r["root"]: np.frombuffer(bytes(r["vectors"])) for r in given.mapInArrow(run, schema).collect()}
    return np.concatenate([found[k] for k in sorted(found)]).reshape(-1, len(matrix))


def projected(fit: Whitening, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """n * y - sums, the whitened components, and the sums of squares of the first, for rows of integers."""
    sums = np.array(fit.sums, object)
    if fit.n * (float(np.abs(y).max()) + 1) + float(np.abs(sums).max()) < 2.0**62:
        centred = fit.n * y - sums.astype(np.int64)
    else:
        centred = fit.n * y.astype(object) - sums
    most = max(1, int(max(centred.max(), -centred.min())))
    squares = centred.astype(object) if most**2 * centred.shape[1] >= 2**62 else centred
    deviation = (squares * squares).sum(axis=1).tolist()
    away = centred.astype(np.float64) / fit.n
    return centred, away @ fit.components.T / np.sqrt(fit.values), deviation


def measured(distinct: DataFrame, fit: Whitening, size: int) -> float | None:
    """Largest absolute entry of (covariance of whitened - identity) over the fit list: tasks send sums and sums of products."""
    k = len(fit.values)
    if not k:
        return None
    schema = StructType([StructField("cell", IntegerType()), StructField("value", DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = distinct.sparkSession.sparkContext.broadcast(_plain(fit))

    def run(batches):
        own, total, crossed = Whitening(**shared.value), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                _, w, _ = projected(own, unpack(batch.column(0).to_pylist(), size))
                total += w.sum(axis=0)
                crossed += w.T @ w
        values = np.concatenate([total, crossed.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], schema=arrow)

    # Whitened values are centred already; what rounding left of their means is taken off the products.
    got = {r["cell"]: r["value"] for r in distinct.select("packed").mapInArrow(run, schema).groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    values = np.array([got[i] for i in range(k + k * k)]) / fit.n
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


def _plain(fit: Whitening) -> dict:
    """The fit as plain values: tasks don't need this package."""
    return dict(n=fit.n, sums=fit.sums, components=fit.components, values=fit.values, explained=fit.explained, identity_error=fit.identity_error)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit list is each distinct integer vector once; see ``integers`` for the vectors that take part (repeated rows and null
    ids stay). ``deviation`` is exact and null where it has over 38 digits. Components are those with an eigenvalue above zero: a
    constant table, or one of a single vector, gives no rows, nor does an empty one. Ties (equal eigenvalues) get an orthonormal
    basis, the same for all rows. Other columns are left alone. One shuffle, of packed distinct vectors, pre-aggregated.
    """
    rows, size = integers(table, id_col, vector_col)
    rows = settle(rows)
    distinct = settle(rows.select("packed").distinct())
    fit = fit_whitening(distinct, size, most)
    fit = Whitening(**{**_plain(fit), "identity_error": measured(distinct, fit, size)})
    schema = StructType([
        StructField("vec_id", LongType()), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    arrow, k = to_arrow_schema(schema), len(fit.values)
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    shared = table.sparkSession.sparkContext.broadcast(_plain(fit))

    def run(batches):
        own = Whitening(**shared.value)
        for batch in batches:
            ids, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), STEP_ROWS):
                part = packed[lo : lo + STEP_ROWS]
                _, w, deviation = projected(own, unpack(part, size))
                m = len(part)
                exact = pa.array([Decimal(d) if abs(d) < 10**38 else None for d in deviation], arrow.field("deviation").type)
                row = np.repeat(np.arange(m), k)
                columns = [
                    pa.array(ids[lo : lo + m], pa.int64()).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, own.n)), exact.take(pa.array(row)), pa.array(w.ravel()),
                    pa.array(np.tile(own.explained, m)), pa.array(np.full(m * k, own.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)
