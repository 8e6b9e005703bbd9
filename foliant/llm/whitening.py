"""Whitening of embeddings from an exact characteristic polynomial.

Entries become integers, so the scatter matrix is one of integers: Spark sums
it exactly. Its characteristic polynomial is found modulo many primes, by a
Hessenberg form for each (a Spark task takes a group of primes), and put
together by the Chinese remainder theorem; the number of primes follows from a
bound on the coefficients. A polynomial with real roots only has as many roots
above a point as its expansion there has changes of sign: that isolates the
roots exactly, as often as they occur, and bisection narrows each down to
``DIGITS`` digits. With such a root, inverse iteration in ``DIGITS`` digits lands
in the null space of the matrix less the root.
"""

from __future__ import annotations

import decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, stored

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Significant digits of roots and vectors; primes of a task; rows of a product; bits of a limb.
DIGITS, PRIMES, ROWS, LIMB = 60, 32, 1 << 12, 20


# ------------------------------------------------------------ exact sums


def gram(x: np.ndarray) -> np.ndarray:
    """The sum of x' x for integer rows, as Python integers: products of limbs of 20 bits are exact in floating point."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        rest, limbs = x[at : at + ROWS].astype(np.int64), []
        while True:
            low = rest & ((1 << LIMB) - 1) if np.abs(rest).max(initial=0) >> LIMB else rest
            limbs.append(low.astype(np.float64))
            rest = rest - low >> LIMB
            if not rest.any():
                break
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return out


def integers(table: DataFrame, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of floor(scale c) + shift, without vectors that are null or hold an entry that is null or not finite."""
    good = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return table.filter(F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))


def _rows(column, width: int, filler: int) -> np.ndarray:
    """Rows of integers; where a vector is shorter than the longest, ``filler`` (what an entry of zero becomes) stands."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    size = np.diff(ends)
    out = np.full((len(size), width), filler, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


def scatter(fit_list: DataFrame, width: int, shift: int = SHIFT) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n·Σxx' − SS') of the rows ``x``, in Python integers."""

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((width + 1, width + 1), object)
        for b in batches:
            x = _rows(b.column(0), width, shift) - shift
            total += gram(np.c_[np.ones(len(x), np.int64), x])
        i, j = np.triu_indices(width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([decimal.Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "part"])

    got = fit_list.select("x").mapInArrow(sums, "i int, j int, part decimal(38,0)").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()
    full = np.zeros((width + 1, width + 1), object)
    for i, j, v in got:
        full[i, j] = full[j, i] = int(v)
    n, s = int(full[0, 0]), full[0, 1:]
    return n, [int(v) + n * shift for v in s], n * full[1:, 1:] - np.outer(s, s)


# ------------------------------------------------------------ characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest primes below ``top``."""
    small = np.ones(int(top**0.5) + 2, bool)
    small[:2] = False
    for k in range(2, int(len(small) ** 0.5) + 1):
        if small[k]:
            small[k * k :: k] = False
    small, out, high = np.flatnonzero(small), [], top
    while len(out) < count:
        low = max(2, high - (1 << 15))
        sieve = np.ones(high - low, bool)
        for p in small:
            sieve[max(p * p, -(-low // p) * p) - low :: p] = False
        out += (np.flatnonzero(sieve)[::-1] + low).tolist()
        high = low
    return out[:count]


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, e = np.ones_like(x), x % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out


def residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first, monic) of det(tI − matrix) modulo each of ``primes``, which lie below 2^31: (primes, d + 1)."""
    d, p = len(matrix), np.array(primes, np.int64)
    h = np.stack([(matrix % int(q)).astype(np.int64) for q in primes])
    p1, p2, every = p[:, None], p[:, None, None], np.arange(len(p))
    for m in range(1, d - 1):  # to Hessenberg form, by similar matrices
        pivot = m + (h[:, m:, m - 1] != 0).argmax(1)
        h[every, m], h[every, pivot] = h[every, pivot], h[every, m].copy()
        h[every, :, m], h[every, :, pivot] = h[every, :, pivot], h[every, :, m].copy()
        u = h[:, m + 1 :, m - 1] * _inverse(h[:, m, m - 1], p)[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % p2) % p2
        for i in range(m + 1, d):
            h[:, :, m] = (h[:, :, m] + u[:, i - m - 1, None] * h[:, :, i]) % p1
    poly = np.zeros((len(p), d + 1, d + 1), np.int64)  # of the leading minors
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        poly[:, k] = (poly[:, k] - h[:, k - 1, k - 1, None] * poly[:, k - 1]) % p1
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            poly[:, k] = (poly[:, k] - (below * h[:, i - 1, k - 1] % p)[:, None] * poly[:, i - 1]) % p1
    return poly[:, d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients (constant first) of det(tI − matrix) for an integer matrix without negative eigenvalues."""
    d = len(matrix)
    # the coefficients' sizes add up to det(I + matrix), at most ((d + trace) / d)^d
    bound = ((d + int(np.trace(matrix))) // d + 1) ** d
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 2)
    groups = [primes[k : k + PRIMES] for k in range(0, len(primes), PRIMES)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(groups[k]), pa.array(residues(matrix, groups[k]).tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    value, modulus = [0] * (d + 1), 1
    for p, r in spark.range(0, len(groups), numPartitions=len(groups)).mapInArrow(run, "prime long, residues array<long>").collect():
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((x - v) * inverse % p) for v, x in zip(value, r, strict=True)]
        modulus *= p
    return [v if v <= modulus // 2 else v - modulus for v in value]


# ------------------------------------------------------------ roots and vectors


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots of ``poly``, all of them real, lie above num / 2^bits, as often as they occur."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]  # of the polynomial with roots 2^bits greater
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], count: int, digits: int = DIGITS) -> list[tuple[decimal.Decimal, int]]:
    """The greatest positive roots, with how often each occurs, until ``count`` are covered; ``poly`` is monic with real roots that are not negative."""
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    d, out, found = len(poly) - 1, [], 0
    below, bits = (-poly[-2] + 1 if d else 1), 0  # above the sum of the roots; later, a point with just those found above it
    while found < min(count, d):
        # the greatest root that is left: more than found lie above low, and found above high
        low, high = 0, below
        many, here = d, found
        while many - here > 1:
            if (high - low).bit_length() <= 1:
                if (high.bit_length() - 1) * 0.30103 > digits:
                    break  # equal to all digits: one root, that occurs as often
                low, high, bits = low << 4, high << 4, bits + 4
            mid = low + high >> 1
            n = roots_above(poly, mid, bits)
            low, high, many, here = (mid, high, n, here) if n > found else (low, mid, many, n)
        times, below, scale = many - here, low, bits
        if times == 1:  # isolated: the sign tells on which side of it a point is
            above = -1 if here % 2 else 1  # the sign of the polynomial above the root
            while (high.bit_length() - 1) * 0.30103 <= digits or high - low > 1:
                if high - low <= 1:
                    low, high, bits = low << 8, high << 8, bits + 8
                mid, v = low + high >> 1, 0
                for k, c in enumerate(reversed(poly)):
                    v = v * mid + (c << bits * k)
                low, high = (low, mid) if v * above >= 0 else (mid, high)
        with decimal.localcontext() as ctx:
            ctx.prec = digits + 10
            out.append((decimal.Decimal(high) / (1 << bits), times))
        found, bits = found + times, scale
    return out


def null_vectors(matrix: np.ndarray, root: decimal.Decimal, times: int, digits: int = DIGITS) -> np.ndarray:
    """(d, times) orthogonal unit vectors of the null space of matrix − root, by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext() as ctx:
        ctx.prec = digits
        a = np.array([[decimal.Decimal(int(v)) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= root
        least = (abs(root) + 1).scaleb(-digits)
        rows = np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], rows[[k, pivot]] = a[[pivot, k]], rows[[pivot, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        v = np.array([[decimal.Decimal((i * 37 + j * 101 + i * j * 13) % 89 + 1) for j in range(times)] for i in range(d)], object)
        for _ in range(3):
            v = v[rows]
            for k in range(d):
                v[k + 1 :] -= np.outer(a[k + 1 :, k], v[k])
            for k in range(d - 1, -1, -1):
                v[k] = v[k] / a[k, k]
                v[:k] -= np.outer(a[:k, k], v[k])
            for j in range(times):
                for i in range(j):
                    v[:, j] -= v[:, i] * (v[:, i] * v[:, j]).sum()
                v[:, j] = v[:, j] / (v[:, j] * v[:, j]).sum().sqrt()
        return v.astype(np.float64)


def components_of(spark: SparkSession, matrix: np.ndarray, count: int) -> tuple[list[decimal.Decimal], np.ndarray]:
    """(roots, unit vectors as columns) of the ``count`` greatest positive eigenvalues of an integer scatter matrix; a root that occurs more than once is given as often."""
    roots, vectors = [], [np.zeros((len(matrix), 0))]
    for root, times in largest_roots(characteristic(spark, matrix), count):
        roots += [root] * times
        vectors.append(null_vectors(matrix, root, times))
    return roots[:count], np.concatenate(vectors, 1)[:, :count]


# ------------------------------------------------------------ the operator


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error): one for each vector and component.

    The fit is on each distinct integer vector once, all of them. Components are
    numbered from 1 by falling variance; those without variance don't exist, so a
    table with one distinct vector gives no rows, as an empty one does.
    ``deviation`` is the exact sum of (n x − S)², null where a long can't hold it.
    ``identity_error`` is measured on the fit list in a pass of its own. Vectors
    that are null or hold an entry that is null or not finite give no rows; ids may
    be null and repeat, a row is whitened for each. A vector shorter than others
    counts as if it ended in zeros. Entries times ``scale`` must fit a long, and
    their squares, summed, 38 digits. Other columns are not read.

    The driver and each task hold matrices of the dimension and no rows.
    """
    spark = table.sparkSession
    arrow_batches(spark)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(table, scale, shift, id_col, vector_col)
    fit_list = stored(rows.select("x").distinct(), "fit")
    width = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    n, sums, matrix = scatter(fit_list, width, shift)
    roots, vectors = components_of(spark, matrix, components)
    if not roots:
        return spark.createDataFrame([], schema)
    count = len(roots)
    with decimal.localcontext() as ctx:
        ctx.prec = DIGITS
        deviations = np.array([float(r.sqrt()) for r in roots])  # of n x
        explained = [float(r / int(np.trace(matrix))) for r in roots]

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x − S, exactly, and its rows' sums of squares."""
        near = np.array([s // n for s in sums])  # of the mean, so that differences stay small
        rest, far = np.array([s - n * (s // n) for s in sums]), x - near
        most = int(np.abs(far).max(initial=0)) * n + n
        kind = np.int64 if most**2 * width < 1 << 62 else object
        c = far.astype(kind) * n - rest.astype(kind)
        return c, (c * c).sum(1)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, square = centred(x)
        return c.astype(np.float64) @ vectors / deviations, square

    def means(batches):
        import pyarrow as pa

        total = np.zeros(count)
        for b in batches:
            total += project(_rows(b.column(0), width, shift))[0].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], ["i", "part"])

    at = dict(fit_list.mapInArrow(means, "i int, part double").groupBy("i").agg(F.sum("part")).collect())
    mean = np.array([at[i] / n for i in range(count)])

    def products(batches):
        import pyarrow as pa

        total = np.zeros((count, count))
        for b in batches:
            w = project(_rows(b.column(0), width, shift))[0] - mean
            total += w.T @ w
        i, j = np.indices((count, count)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "part"])

    covariance = fit_list.mapInArrow(products, "i int, j int, part double").groupBy("i", "j").agg((F.sum("part") / n).alias("c"))
    error = covariance.agg(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double")))).first()[0]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            w, square = project(_rows(b.column(1), width, shift))
            m = len(w)
            square = pa.array([int(v) if v < 1 << 63 else None for v in square.tolist()], pa.int64()).take(pa.array(np.repeat(np.arange(m), count)))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(m), count)))
            fixed = [pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n))]
            yield pa.RecordBatch.from_arrays([ids, *fixed, square, pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error))], schema=pa.schema([(id_col, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]))

    return rows.mapInArrow(run, schema)
