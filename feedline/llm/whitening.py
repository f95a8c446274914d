"""Embedding whitening through the exact characteristic polynomial.

Entries become integers, ``x = floor(256 c)`` of the double ``c`` (beyond the range
of a long: its ends).  The fit list holds each distinct vector once: ``n`` vectors
with sums ``S`` and products ``G``; its integer scatter ``M = n G - S S'`` is ``n^2``
times the covariance.

1. Tasks add up their vectors' sums and products exactly and send them in limbs
   of 40 bits; sums of limbs are sums of longs, whatever the entries' size.
2. ``det(tI - M)`` is found modulo as many 31-bit primes as its coefficients can
   need (Maclaurin's inequality bounds them by the trace): each prime reduces ``M``
   to Hessenberg form and reads the polynomial off it; primes are dealt to tasks,
   Chinese remaindering puts the integers together, a further prime checks them.
3. All roots are real, so the sign changes of the polynomial moved by ``t`` are
   exactly the roots above ``t`` (Descartes): bisection on integers isolates the
   largest roots with their multiplicity, signs alone then refine simple ones, to
   ``2^-BITS`` of the trace.
4. Components span the null space of ``M - root``: inverse iteration in integers
   with guard bits; of a multiple root as many orthogonal ones as it counts.

Only numbers of the size of the scatter (``d`` squared) reach the driver.

Dropped are rows whose vector is null, empty, holds null or non-finite entries or
has another length than ``dim`` (by default the most frequent one, of these the
largest).  Repeated rows are rows of their own but one vector of the fit list.
Components stop at the rank: an eigenvalue of 0 cannot be scaled, so a table of
equal vectors, like an empty one, gives no rows.  ``deviation`` is null where it
does not fit a long.  Other columns are kept where named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import frugal
from .scratch import Scratch

LIMB, LIMBS = 40, 5
BITS = 160  #: of a root, relative to the trace
GUARD = 128  #: further bits of the inverse iteration
PRIMES_A_TASK = 16


# ---------------------------------------------------------------- exact integers

def quantised(values: np.ndarray, scale: int = 256) -> np.ndarray:
    y = np.floor(values * float(scale))
    top = y >= 2.0 ** 63
    x = np.where(top, 0.0, np.maximum(y, -2.0 ** 63)).astype(np.int64)
    x[top] = np.iinfo(np.int64).max
    return x


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers in the fewest of 2, 4 or 8 bytes an entry that hold the row: equal rows are equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for kind in (np.int16, np.int32, np.int64):
        info = np.iinfo(kind)
        now = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        data = np.ascontiguousarray(x[now], dtype=kind)
        for r, row in zip(now.tolist(), data):
            out[r] = row.tobytes()
        left[now] = False
    return out


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``pack`` as a matrix of longs."""
    out = np.empty((len(col), dim), np.int64)
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
    for width, kind in ((2, np.int16), (4, np.int32), (8, np.int64)):
        rows = np.flatnonzero(sizes == width * dim)
        if len(rows):
            data = col.take(pa.array(rows)).cast(pa.large_binary())
            out[rows] = np.frombuffer(data.buffers()[2], kind, len(rows) * dim).reshape(-1, dim)
    return out


def gram(x: np.ndarray) -> np.ndarray:
    """``x' x`` as Python integers; doubles are exact while no sum can pass 2^53."""
    most = int(np.abs(x.astype(object)).max()) if len(x) and (x.min() < -(1 << 31) or x.max() > 1 << 31) else int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T.dot(y)


def limbs(v: int) -> list[int]:
    return [(v >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [v >> (LIMB * (LIMBS - 1))]


# ---------------------------------------------------------------- characteristic polynomial

def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits, and one more."""
    out, product, p = [], 1, (1 << 31) - 1
    while True:
        if _is_prime(p):
            out.append(p)
            if product.bit_length() > bits:
                return out
            product *= p
        p -= 2


def hessenberg_polynomials(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of ``det(tI - m)`` modulo each prime, the highest power first: shape (primes, d + 1)."""
    d, k = len(m), len(p)
    q = p[:, None, None]
    h = np.stack([(m % int(x)).astype(np.int64) for x in p])
    every = np.arange(k)
    for c in range(1, d - 1):
        below = h[:, c:, c - 1] != 0
        pivot = c + below.argmax(axis=1)
        some = below.any(axis=1)
        for axis in (1, 2):  # similarity: rows and columns change places
            a, b = ((every, c), (every, pivot)) if axis == 1 else ((every, slice(None), c), (every, slice(None), pivot))
            h[a], h[b] = h[b].copy(), h[a].copy()
        inverse = np.array([pow(int(v), -1, int(x)) if ok else 0 for v, x, ok in zip(h[:, c, c - 1], p, some)], np.int64)
        u = h[:, c + 1:, c - 1] * inverse[:, None] % p[:, None]
        h[:, c + 1:] = (h[:, c + 1:] - u[:, :, None] * h[:, c, None, :] % q) % q
        h[:, :, c] = (h[:, :, c] + (h[:, :, c + 1:] * u[:, None, :] % q).sum(axis=2)) % p[:, None]
    poly = np.zeros((k, d + 1, d + 1), np.int64)  # of the leading blocks, the lowest power first
    poly[:, 0, 0] = 1
    for n in range(d):
        poly[:, n + 1, 1:] = poly[:, n, :-1]
        factor = np.zeros((k, n + 1), np.int64)  # of the polynomials of all smaller blocks
        under = np.ones(k, np.int64)
        for i in range(n, -1, -1):
            factor[:, i] = h[:, i, n] * under % p
            if i:
                under = under * h[:, i, i - 1] % p
        less = (factor[:, :, None] * poly[:, :n + 1] % q).sum(axis=1)
        poly[:, n + 1] = (poly[:, n + 1] - less) % p[:, None]
    return poly[:, d, ::-1]


def coefficient_bits(m: np.ndarray) -> int:
    """Bits of the largest coefficient of ``det(tI - m)`` of a positive semidefinite ``m``: C(d, k) (trace / d)^k bounds the k-th."""
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    return max((math.comb(d, k) * trace ** k // d ** k + 1).bit_length() for k in range(d + 1)) + 1


def chinese(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size with the given residues; the last prime only checks them."""
    *use, check = sorted(residues, reverse=True)
    whole = math.prod(use)
    part = [whole // p for p in use]
    part = [x * pow(x % p, -1, p) for x, p in zip(part, use)]
    out = []
    for k in range(len(residues[check])):
        v = sum(residues[p][k] * x for p, x in zip(use, part)) % whole
        v -= whole if 2 * v > whole else 0
        if v % check != residues[check][k]:
            raise ArithmeticError("the primes do not determine the polynomial")
        out.append(v)
    return out


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of ``det(tI - m)``, the highest power first; primes are dealt to tasks."""
    use = primes(coefficient_bits(m))
    tasks = -(-len(use) // PRIMES_A_TASK)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(hessenberg_polynomials(m, p).tolist(), pa.list_(pa.int64()))], ["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in use], "p long").repartition(tasks)
    return chinese({r.p: r.c for r in dealt.mapInArrow(frugal(solve), "p long, c array<long>").collect()})


# ---------------------------------------------------------------- roots and components

def above(poly: list[int], t: int) -> int:
    """Roots above ``t`` of a polynomial with real roots only, by the sign changes of the moved one."""
    a = list(poly)
    for end in range(len(a), 1, -1):
        for i in range(1, end):
            a[i] += t * a[i - 1]
    signs = [x > 0 for x in a if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], k: int, top: int) -> list[tuple[int, int]]:
    """The ``k`` largest positive roots below ``top``, rounded up, each with a number that multiple roots share."""
    count = cache(lambda t: above(poly, t))

    def value(t: int) -> int:
        v = 0
        for c in poly:
            v = v * t + c
        return v

    out: list[tuple[int, int]] = []
    for r in range(min(k, count(0))):
        lo, hi = 0, top  # the root with r others above it is above lo and not above hi
        while hi - lo > 1 and count(lo) - count(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if count(mid) > r else (lo, mid)
        while hi - lo > 1:  # a simple root: the sign right of it is that of r roots above
            mid = (lo + hi) // 2
            v = value(mid)
            lo, hi = (lo, mid) if v == 0 or (v > 0) == (r % 2 == 0) else (mid, hi)
        out.append((hi, count(hi)))
    return out


class NullSpace:
    """Solves ``(m 2^scale - root) v = b`` in integers with guard bits, from one triangular form."""

    def __init__(self, m: np.ndarray, root: int, scale: int):
        d = len(m)
        a = m * (1 << scale)
        for i in range(d):
            a[i, i] -= root
        a = a * (1 << GUARD)
        self.f = f = BITS + 2 * GUARD
        self.order = np.arange(d)
        self.lower = np.zeros((d, d), object)
        for c in range(d):
            p = c + max(range(d - c), key=lambda i: abs(a[c + i, c]))
            if p != c:
                for x in (a, self.lower):
                    x[[c, p]] = x[[p, c]]
                self.order[[c, p]] = self.order[[p, c]]
            if a[c, c] == 0:
                a[c, c] = 1
            if c + 1 < d:
                m_ = np.array([(v << f) // a[c, c] for v in a[c + 1:, c]], object)
                self.lower[c + 1:, c] = m_
                a[c + 1:, c:] -= (m_[:, None] * a[c, c:]) >> f
        self.upper = a

    def solve(self, b: np.ndarray) -> np.ndarray:
        d, f = len(b), self.f
        y = b[self.order]
        for i in range(1, d):
            y[i] -= int((self.lower[i, :i] * y[:i]).sum()) >> f
        x = np.zeros(d, object)
        for i in range(d - 1, -1, -1):
            rest = (y[i] << f) - (int((self.upper[i, i + 1:] * x[i + 1:]).sum()) if i + 1 < d else 0)
            x[i] = rest // self.upper[i, i]
        return x


ONE = BITS + GUARD  #: bits behind the point of a component


def unit(v: np.ndarray) -> np.ndarray:
    """``v`` in the length of ``1 << ONE``."""
    shift = max(0, ONE - max(int(abs(x)) for x in v).bit_length() + 1)
    v = v * (1 << shift)
    size = math.isqrt(int((v * v).sum()))
    return np.array([(int(x) << ONE) // size for x in v], object)


def eigenvectors(m: np.ndarray, roots: list[tuple[int, int]], scale: int) -> list[np.ndarray]:
    """Unit vectors of the null spaces of ``m`` less each root, as doubles; the largest entry is positive."""
    d, out, made, last = len(m), [], [], None
    for root, group in roots:
        if group != last:
            space, made, last = NullSpace(m, root, scale), [], group
        rng = np.random.default_rng(1 + len(made))
        v = np.array([int(x) << (ONE - 20) for x in rng.integers(-(1 << 20), 1 << 20, d)], object)
        for _ in range(4):
            for w in made:
                v = v - np.array([(int((v * w).sum()) * x) >> (2 * ONE) for x in w], object)
            v = unit(space.solve(unit(v)))
        for _ in range(2):
            for w in made:
                v = v - np.array([(int((v * w).sum()) * x) >> (2 * ONE) for x in w], object)
            v = unit(v)
        made.append(v)
        big = max(range(d), key=lambda i: abs(v[i]))
        v = -v if v[big] < 0 else v
        out.append(np.array([int(x) / (1 << ONE) for x in v]))
    return out


# ---------------------------------------------------------------- on tables

@dataclass(frozen=True)
class Whitening:
    """What the fit list says: ``n``, sums ``s``, components (k x d), eigenvalues of the covariance, their shares of the trace."""

    n: int
    s: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def integer_vectors(df: DataFrame, vec_col: str, keep: tuple[str, ...], scale: int = 256) -> DataFrame:
    """``row`` (a struct of ``keep``), ``dim`` and the packed integers ``x`` of the rows with whole finite vectors."""
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            ok = col.is_valid()
            sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()  # null rows hold no values here
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            start = np.cumsum(sizes) - sizes
            bad = np.add.reduceat(np.append(~np.isfinite(values), False), np.minimum(start, len(values))) if len(sizes) else sizes
            fine = ok.to_numpy(zero_copy_only=False) & (sizes > 0) & ((bad == 0) | (sizes == 0))
            out: list[bytes | None] = [None] * len(col)
            for dim in np.unique(sizes[fine]):
                rows = np.flatnonzero(fine & (sizes == dim))
                for r, x in zip(rows.tolist(), pack(quantised(values[start[rows][:, None] + np.arange(dim)], scale))):
                    out[r] = x
            at = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), pa.array(sizes[fine]), pa.array(out, pa.binary()).take(at)], ["row", "dim", "x"])

    return kept.mapInArrow(frugal(read), T.StructType([kept.schema["row"], *T._parse_datatype_string("dim long, x binary")]))


def scatter(fit_list: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, the sums and the integer scatter of distinct packed vectors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            x = unpack(b.column("x"), dim)
            n += len(x)
            g += gram(x)
            s += x.astype(object).sum(axis=0)
        if n:
            i, j = np.triu_indices(dim)
            cells = [(-1, n), *((-2 - k, int(v)) for k, v in enumerate(s)), *zip((i * dim + j).tolist(), map(int, g[i, j]))]
            cols = list(zip(*(limbs(v) for _, v in cells)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in cells], pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["cell", *(f"l{k}" for k in range(LIMBS))])

    parts = fit_list.select("x").mapInArrow(frugal(add), "cell long, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    sums = parts.groupBy("cell").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    got = {r.cell: sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in sums.collect()}  # dim squared / 2 rows
    n, s = got.get(-1, 0), [got.get(-2 - k, 0) for k in range(dim)]
    m = np.zeros((dim, dim), object)
    for i in range(dim):
        for j in range(i, dim):
            m[i, j] = m[j, i] = n * got.get(i * dim + j, 0) - s[i] * s[j]
    return n, s, m


def fit(fit_list: DataFrame, dim: int, k: int = 4) -> Whitening | None:
    """The first ``k`` components of distinct packed vectors, or None if they do not differ."""
    n, s, m = scatter(fit_list, dim)
    trace = int(sum(m[i, i] for i in range(dim)))
    if not trace:
        return None
    poly = characteristic_polynomial(fit_list.sparkSession, m)
    scale = max(0, BITS - trace.bit_length())
    fine = [c << (scale * i) for i, c in enumerate(poly)]
    roots = largest_roots(fine, k, (trace << scale) + 1)
    vectors = np.array(eigenvectors(m, roots, scale))
    unit_ = n * n << scale
    return Whitening(n, tuple(s), vectors, np.array([r / unit_ for r, _ in roots]), np.array([r / (trace << scale) for r, _ in roots]))


def project(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Whitened rows (rows x components) and deviations of integer vectors."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    wide = w.n * most + max(map(abs, w.s)) >= 1 << 62
    s = np.array(w.s, object if wide else np.int64)
    away = (x.astype(object) if wide else x) * w.n - s
    white = (away.astype(np.float64) / w.n) @ w.components.T / np.sqrt(w.eigenvalues)
    far = max(abs(int(away.min())), abs(int(away.max()))) if away.size else 0
    if far * far * x.shape[1] >= 1 << 63:
        sums = (away.astype(object) ** 2).sum(axis=1)
        return white, [int(v) if v < 1 << 63 else None for v in sums]
    return white, (away.astype(np.int64) ** 2).sum(axis=1).tolist()


def whitened(rows: DataFrame, dim: int, w: Whitening) -> DataFrame:
    """The columns of ``rows`` other than ``dim`` and ``x``, ``deviation`` and the array ``white``, one entry per component."""
    names = [c for c in rows.columns if c not in ("dim", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white, away = project(unpack(b.column("x"), dim), w)
            offs = np.arange(b.num_rows + 1, dtype=np.int32) * len(w.components)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(away, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.ascontiguousarray(white).ravel()))], [*names, "deviation", "white"])

    return rows.mapInArrow(frugal(run), T.StructType([*(rows.schema[c] for c in names), *T._parse_datatype_string("deviation long, white array<double>")]))


def identity_error(fit_list: DataFrame, dim: int, w: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
    white = whitened(fit_list, dim, w)
    k = range(len(w.components))
    mean = white.agg(*(F.avg(F.col("white")[i]) for i in k)).first()
    off = [F.col("white")[i] - F.lit(mean[i]) for i in k]
    cov = white.agg(*(F.avg(off[i] * off[j]) for i in k for j in k if i <= j)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, ((i, j) for i in k for j in k if i <= j)))


def whiten(df: DataFrame, vec_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",), k: int = 4, dim: int | None = None) -> DataFrame:
    """``row`` (a struct of ``keep``), ``component`` from 1, ``n, deviation, whitened, explained, identity_error``; one row per vector and component."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows = scratch.write(integer_vectors(df, vec_col, keep), "rows")
    if dim is None:
        common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = common.dim if common else 0
    rows = rows.filter(F.col("dim") == dim)
    fit_list = scratch.write(rows.select("x").distinct(), "fit")
    w = fit(fit_list, dim, k) if dim else None
    if w is None:
        return df.sparkSession.createDataFrame([], T.StructType([rows.schema["row"], *T._parse_datatype_string(
            "component int, n long, deviation long, whitened double, explained double, identity_error double")]))
    error = identity_error(fit_list, dim, w)
    explained = F.array(*(F.lit(float(e)) for e in w.explained))
    flat = whitened(rows, dim, w).select("row", "deviation", F.posexplode("white").alias("at", "whitened"))
    return flat.select("row", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
