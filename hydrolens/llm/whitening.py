"""Embedding whitening by the exact characteristic polynomial.

Vectors become whole numbers, x = floor(256 * c).  Over the fit list (each
distinct x once; n of them with sums S) the scatter M = n * sum(x x') - S S' is a
matrix of integers and n^2 times the covariance, so nothing is rounded before
the eigenvalues are known:

1. sums of x and of all products, exact, per task, then added by Spark;
2. the characteristic polynomial of M modulo many primes, each by reduction to
   Hessenberg form (Spark deals the primes to tasks), and from the residues the
   integer coefficients by the Chinese remainder theorem.  They are bounded by
   binomial(d, k) * (trace / d)^k, as M has no negative eigenvalue;
3. the largest eigenvalues by bisection on dyadic numbers: all roots are real, so
   the sign changes of the coefficients, shifted by a, count the roots above a;
   bisection ends at a relative width of 2^-PRECISION (a task per component);
4. components by inverse iteration in decimal arithmetic of ``DIGITS`` digits;
   eigenvalues that agree to ``SAME`` bits share a null space, whose basis is made
   orthogonal (a task per distinct eigenvalue);
5. one pass over the fit list for the covariance of the whitened vectors.

Only d x d sums, d + 1 coefficients per prime and the components reach the
driver; their size depends on d and the number of digits, not on the rows.

Defined results: rows whose vector is null or holds null or non-finite entries
have no result; nor have vectors of another length than the commonest (the
longer one at a tie).  Entries beyond 64 bits stop at its ends.  Directions
without variance have no component, so there may be fewer than asked, none at
all for a single distinct vector or an empty table.  Repeated rows each get
their result; extra columns are carried by ``whiten``.  ``deviation`` is null
where the exact value passes 64 bits; ``deviation_exact`` has 38 digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_batches, packed, stored, table

SCALE = 256
COMPONENTS = 4
PRECISION = 240
SAME = 120
DIGITS = 160
BATCH = 2048
_EXACT = 1 << 53
_LOW = 60


# ---------------------------------------------------------------- whole numbers
def whole_vectors(df: DataFrame, column: str, out: str = "x") -> DataFrame:
    """``df`` with ``out`` (array of longs) for the rows that have a result."""
    e = F.col(f"`{column}`")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(e.isNotNull() & finite)
    lengths = rows.groupBy(F.size(e).alias("d")).count()
    most = lengths.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if most is None:
        return rows.withColumn(out, F.array().cast("array<long>")).where("false")
    x = F.transform(e, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(F.size(e) == most["d"]).withColumn(out, x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x: in doubles while no sum can pass 2^53, else in integers."""
    top = int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if top * top * len(x) < _EXACT:
        f = x.astype("float64")
        return (f.T @ f).astype("int64").astype(object)
    o = x.astype(object)
    return o.T @ o


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per cell of the upper triangle: cell number, sum of products; the
    sums of x and the count are the products with a column of ones."""
    total = None
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column("x"))
        got = _products(np.c_[np.ones(len(x), "int64"), x])
        total = got if total is None else total + got
    if total is not None:
        d = len(total)
        cells = [(i * d + j, int(total[i, j])) for i in range(d) for j in range(i, d)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in cells], pa.int64()),
             pa.array([Decimal(v >> _LOW) for _, v in cells], pa.decimal128(38, 0)),
             pa.array([Decimal(v & (1 << _LOW) - 1) for _, v in cells], pa.decimal128(38, 0))],
            names=["cell", "high", "low"])  # in two parts: a sum of squares may pass 38 digits


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the fit list (``x``)."""
    cells = (fit.select("x").mapInArrow(_moments, "cell long, high decimal(38,0), low decimal(38,0)")
             .groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())  # d * d / 2 sums
    got = {r["cell"]: (int(r["high"]) << _LOW) + int(r["low"]) for r in cells}
    at = lambda i, j: got[min(i, j) * (d + 1) + max(i, j)]
    n, s = at(0, 0), [at(0, i + 1) for i in range(d)]
    return n, s, [[n * at(i + 1, j + 1) - s[i] * s[j] for j in range(d)] for i in range(d)]


# ---------------------------------------------------------------- the polynomial
def primes_below(top: int, n: int) -> list[int]:
    """The n largest primes below ``top`` (at most 2^31)."""
    small = [p for p in range(2, math.isqrt(top) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, hi = [], top
    while len(found) < n:
        lo = hi - 50 * max(n, 100)
        sieve = np.ones(hi - lo, bool)
        for p in small:
            sieve[(-lo) % p::p] = False
        found += [lo + int(i) for i in np.nonzero(sieve)[0][::-1]]
        hi = lo
    return found[:n]


def hessenberg_polynomial(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - m) modulo p, lowest first."""
    d = len(m)
    h = np.array([[v % p for v in row] for row in m], dtype="int64")
    for k in range(d - 2):  # column k: zeros below the subdiagonal, by a similarity
        rows = np.nonzero(h[k + 1:, k])[0]
        if not len(rows):
            continue
        r = k + 1 + int(rows[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    polys = [np.zeros(d + 1, "int64")]
    polys[0][0] = 1
    for k in range(d):  # leading minors from the top left
        q = (np.roll(polys[k], 1) - int(h[k, k]) * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            q = (q - (int(h[i, k]) * below % p) * polys[i]) % p
        polys.append(q)
    return [int(c) for c in polys[d]]


def _residues(m):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([hessenberg_polynomial(m, p) for p in ps], pa.list_(pa.int64()))],
                names=["p", "c"])
    return run


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(xI - m), lowest first, for a symmetric m
    without negative eigenvalues."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bits = max(math.comb(d, k).bit_length() + k * (trace // d + 1).bit_length() for k in range(d + 1)) + 2
    primes = primes_below(1 << 31, bits // 30 + 1)
    todo = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    rows = todo.mapInArrow(_residues(m), "p long, c array<long>").collect()  # d + 1 numbers per prime
    product = math.prod(primes)
    coefficients = [0] * (d + 1)
    for r in rows:
        rest = product // r["p"]
        weight = rest * pow(rest % r["p"], -1, r["p"])
        for i, c in enumerate(r["c"]):
            coefficients[i] += c * weight
    out = []
    for c in coefficients:
        c %= product
        out.append(c - product if c > product // 2 else c)
    return out


# ---------------------------------------------------------------- the roots
def roots_above(poly: list[int], a: int) -> int:
    """Roots over a, with multiplicity: sign changes after the shift by a."""
    c = list(poly)
    d = len(c) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, top: int) -> tuple[int, int] | None:
    """(a, s): the k-th largest root lies in (a, a + 1] / 2^s, narrow to
    ``PRECISION`` bits; None when it is zero.  ``top`` is no smaller than it."""
    if roots_above(poly, 0) < k:
        return None
    lo, hi, s = 0, top, 0
    while True:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if roots_above(poly, mid) >= k else (lo, mid)
        if lo.bit_length() > PRECISION:
            return lo, s
        more = PRECISION + 2 - lo.bit_length() if lo else 64
        d = len(poly) - 1
        poly = [c << (more * (d - i)) for i, c in enumerate(poly)]
        lo, hi, s = lo << more, hi << more, s + more


# ---------------------------------------------------------------- the components
def null_space(m: list[list[int]], root: Decimal, size: int) -> list[list[float]]:
    """``size`` unit vectors of the eigenvalue ``root``, orthogonal, by inverse
    iteration from unit vectors."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        a = [[Decimal(v) for v in row] for row in m]
        for i in range(d):
            a[i][i] -= root
        tiny = (abs(root) + 1) * Decimal(10) ** (-DIGITS + 20)
        order = list(range(d))
        for k in range(d):  # a = L U with row exchanges; no pivot is left at zero
            r = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[r] = a[r], a[k]
            order[k], order[r] = order[r], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            top = a[k]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    f = row[k] = row[k] / top[k]
                    for j in range(k + 1, d):
                        row[j] -= f * top[j]

        def solve(b):
            x = [b[o] for o in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return x

        def unit(v, found):
            for _ in range(2):
                for w in found:
                    dot = sum((p * q for p, q in zip(v, w)), Decimal(0))
                    v = [p - dot * q for p, q in zip(v, w)]
            norm = sum((p * p for p in v), Decimal(0)).sqrt()
            return [p / norm for p in v] if norm else None
        found: list[list[Decimal]] = []
        for start in range(d):
            v = unit([Decimal(3) / 2 if i == start else Decimal(1) / (i + 2 + start) for i in range(d)], found)
            for _ in range(3):
                v = unit(solve(v), found) if v else None
            if v:
                found.append(v)
            if len(found) == size:
                break
        return [[float(p) for p in v] for v in found]


def _roots(poly, top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column("k").to_pylist()
            got = [isolate(poly, k, top) for k in ks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array([g and f"{g[0]} {g[1]}" for g in got], pa.string())], names=["k", "root"])
    return run


def _vectors(m):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            got = [null_space(m, _decimal(r["root"]), r["size"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(got, pa.list_(pa.list_(pa.float64())))], names=["k", "vs"])
    return run


def _decimal(root: str) -> Decimal:
    """Middle of the interval."""
    a, s = map(int, root.split())
    with localcontext() as ctx:
        ctx.prec = DIGITS
        return Decimal(2 * a + 1) / Decimal(2 << s)


def components(spark: SparkSession, m: list[list[int]], k: int = COMPONENTS) -> list[tuple[Decimal, list[float]]]:
    """The (eigenvalue, unit eigenvector) pairs of m with the k largest positive
    eigenvalues, falling."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return []
    poly = characteristic_polynomial(spark, m)
    one_each = lambda rows, schema: spark.createDataFrame(rows, schema).repartitionByRange(len(rows), "k")
    todo = one_each([(i + 1,) for i in range(min(k, d))], "k long")
    roots = sorted((r["k"], r["root"]) for r in todo.mapInArrow(_roots(poly, trace + 1), "k long, root string").collect()
                   if r["root"])
    groups: list[list[str]] = []
    for _, root in roots:  # equal eigenvalues share a null space
        with localcontext() as ctx:
            ctx.prec = DIGITS
            near = groups and abs(_decimal(groups[-1][0]) - _decimal(root)) * 2 ** SAME < _decimal(root)
        groups[-1].append(root) if near else groups.append([root])
    todo = one_each([(i, g[0], len(g)) for i, g in enumerate(groups)], "k long, root string, size int")
    found = {r["k"]: r["vs"] for r in todo.mapInArrow(_vectors(m), "k long, vs array<array<double>>").collect()}
    return [(_decimal(root), list(v)) for i, g in enumerate(groups) for root, v in zip(g, found[i])]


# ---------------------------------------------------------------- whitening
class Whitening:
    """The fitted model: n, S, and per component its eigenvalue of the
    covariance, direction and share of the variance."""

    def __init__(self, n: int, sums: list[int], m: list[list[int]], parts: list[tuple[Decimal, list[float]]]):
        trace = sum(m[i][i] for i in range(len(m)))
        self.n, self.sums = n, sums
        self.values = [float(root / (n * n)) for root, _ in parts]
        self.explained = [float(root / trace) for root, _ in parts]
        # (n * x - S) . v / (n * sqrt(e)), n * sqrt(e) being the root of the scatter's eigenvalue
        self.directions = np.array([np.array(v) / math.sqrt(root) for root, v in parts]).reshape(len(parts), len(m))
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Exact n * x - S."""
        top = max(abs(int(x.min())), abs(int(x.max())), 1) * self.n + max(map(abs, self.sums), default=0)
        if top < 1 << 62:
            return x * self.n - np.array(self.sums, "int64")
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype("float64") @ self.directions.T

    @staticmethod
    def squares(centred: np.ndarray) -> list[int]:
        """Exact sums of squares."""
        if centred.dtype != object:
            top = max(abs(int(centred.min())), abs(int(centred.max())))
            if top * top * centred.shape[1] < 1 << 62:
                return [int(v) for v in (centred * centred).sum(axis=1)]
            centred = centred.astype(object)
        return [int(v) for v in (centred * centred).sum(axis=1)]


def _covariance(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                z = model.project(model.centred(_matrix(b.column("x"))))
                total = total + z.T @ z
        cells = np.ravel(total)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "v"])
    return run


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct ``x`` of ``vectors``; None without any vector."""
    spark = vectors.sparkSession
    arrow_batches(spark, BATCH)
    distinct = stored(vectors.select("x").distinct(), "fit", "zstd")
    first = distinct.first()
    if first is None or not first["x"]:
        return None
    n, sums, m = scatter(distinct, len(first["x"]))
    parts = components(spark, m, k)
    model = Whitening(n, sums, m, parts)
    if parts:
        cells = (distinct.mapInArrow(_covariance(model), "cell int, v double").groupBy("cell")
                 .agg((F.sum("v") / n).alias("v")).collect())
        got = np.zeros(len(parts) ** 2)
        for r in cells:
            got[r["cell"]] = r["v"]
        model.identity_error = float(np.abs(got.reshape(len(parts), -1) - np.eye(len(parts))).max())
    return model


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centred = model.centred(_matrix(b.column("x")))
            exact = model.squares(centred)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in b.schema.names if c != "x"],
                 pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                 pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0)),
                 pa.array(model.project(centred).tolist(), pa.list_(pa.float64()))],
                names=[*[c for c in b.schema.names if c != "x"], "deviation", "deviation_exact", "whitened"])
    return run


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """``vectors`` (``x`` and any other columns) with ``deviation``,
    ``deviation_exact`` and ``whitened`` (a number per component)."""
    kept = vectors.drop("x")
    added = StructType.fromDDL("deviation long, deviation_exact decimal(38,0), whitened array<double>")
    if model is None:
        return kept.where("false").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    schema = StructType([*kept.schema.fields, *added.fields])
    return vectors.mapInArrow(_whitened(model), schema)


def whiten_table(df: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(every row of ``df`` that has a result, as ``doc``, with its whitened
    vector; the fitted model)."""
    rows = whole_vectors(packed(df, column), column).select("doc", "x")
    model = fit(rows, k)
    return whiten(rows, model), model


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding, a row per component."""
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "x")
    model = fit(rows)
    shares = F.array(*[F.lit(v) for v in model.explained]) if model else F.array()
    return whiten(rows, model).select(
        "vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation", "whitened", F.get(shares.cast("array<double>"), F.col("i")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"), "deviation_exact")
