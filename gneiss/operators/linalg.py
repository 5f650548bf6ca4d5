"""Linear algebra: products by joins on the shared index, small dense factorizations as NumPy kernels over stacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.errors import NumericError


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Long (i0, i1, v) by long (i0, i1, v)."""
    l = a.select("i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    r = b.select(F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    return l.join(r, "k").groupBy("i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def vector_dot(a: str, b: str):
    """Of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)


def norms(m: DataFrame) -> DataFrame:
    """Frobenius, largest column sum and largest row sum of a long matrix."""
    fro = m.agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("fro"))
    l1 = m.groupBy("i1").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("l1"))
    inf = m.groupBy("i0").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("inf"))
    return fro.crossJoin(l1).crossJoin(inf)  # three single rows


def trace(m: DataFrame) -> DataFrame:
    return m.filter("i0 = i1").agg(F.sum("v").alias("trace"))


def batched_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Long (batch, i0, i1, v) by the same, matrix by matrix."""
    l = a.select("batch", "i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    r = b.select("batch", F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    return l.join(r, ["batch", "k"]).groupBy("batch", "i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def batched_transpose(a: DataFrame) -> DataFrame:
    return a.select("batch", F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")


def batched_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(batch, v): the inner product of each pair of vectors (batch, i0, v)."""
    r = b.select("batch", "i0", F.col("v").alias("y"))
    return a.join(r, ["batch", "i0"]).groupBy("batch").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def batched_diag(a: DataFrame) -> DataFrame:
    """Square matrices with the vectors (batch, i0, v) on their diagonals and zeros elsewhere."""
    n = a.groupBy("batch").agg((F.max("i0") + 1).alias("_n"))
    cell = a.join(n, "batch").withColumn("i1", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return cell.select("batch", "i0", "i1", F.when(F.col("i0") == F.col("i1"), F.col("v")).otherwise(F.lit(0.0)).alias("v"))


def affine(x: DataFrame, w: DataFrame, bias: DataFrame) -> DataFrame:
    """x w + bias, bias (i0, v) being added to every row."""
    b = bias.select(F.col("i0").alias("i1"), F.col("v").alias("_b"))
    return matmul(x, w).join(b, "i1").select("i0", "i1", (F.col("v") + F.col("_b")).alias("v"))


# ---- kernels over a stack of matrices of one shape: [matrix, row, column]


def _finite(m: np.ndarray) -> np.ndarray:
    if not np.isfinite(m).all():
        raise NumericError("the matrix is not finite")
    return m


def _square(m: np.ndarray) -> np.ndarray:
    if m.shape[1] != m.shape[2]:
        raise NumericError("the matrix is not square")
    return _finite(m)


def _eps(m: np.ndarray) -> float:
    return np.finfo(float).eps * max(m.shape[1:])


def lu(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) with P m = L U by partial pivoting, all matrices a column at a time; singular ones are an error."""
    u, n = _square(m).astype(np.float64), m.shape[1]
    l, at, each = np.zeros_like(u), np.tile(np.arange(n), (len(m), 1)), np.arange(len(m))
    floor = np.abs(u).max(axis=(1, 2), initial=0) * _eps(m)
    for k in range(n):
        p = k + np.abs(u[:, k:, k]).argmax(axis=1)
        for x in (u, l, at):
            x[each, k], x[each, p] = x[each, p].copy(), x[each, k].copy()
        if (np.abs(u[:, k, k]) <= floor).any():
            raise NumericError("singular matrix")
        f = u[:, k + 1 :, k] / u[:, k, k, None]
        l[:, k + 1 :, k] = f
        u[:, k + 1 :] -= f[:, :, None] * u[:, None, k]
        u[:, k + 1 :, k] = 0
    perm = np.zeros_like(u)
    perm[each[:, None], np.arange(n), at] = 1
    return perm, l + np.eye(n), u


def lower_solve(l: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of l x = b by forward substitution; what is above l's diagonal is not read."""
    x, d = np.zeros_like(b), np.einsum("kii->ki", _square(l))
    if (d == 0).any():
        raise NumericError("zero on the diagonal")
    for i in range(l.shape[1]):
        x[:, i] = (b[:, i] - np.einsum("kj,kjc->kc", l[:, i, :i], x[:, :i])) / d[:, i, None]
    return x


def upper_solve(u: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lower_solve(u[:, ::-1, ::-1], b[:, ::-1])[:, ::-1]


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    perm, l, u = lu(m)
    return upper_solve(u, lower_solve(l, perm @ b))


def solve_transpose(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of m' x = b, from the factors of m."""
    perm, l, u = lu(m)
    t = lambda x: x.transpose(0, 2, 1)
    return t(perm) @ upper_solve(t(l), lower_solve(t(u), b))


def cholesky(m: np.ndarray) -> np.ndarray:
    if (np.abs(_square(m) - m.transpose(0, 2, 1)).max(axis=(1, 2), initial=0) > np.sqrt(np.finfo(float).eps) * np.abs(m).max(axis=(1, 2), initial=0)).any():
        raise NumericError("not symmetric")
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError as e:
        raise NumericError("not positive definite") from e


def solve_spd(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    l = cholesky(m)
    return upper_solve(l.transpose(0, 2, 1), lower_solve(l, b))


def det(m: np.ndarray) -> np.ndarray:
    perm, _, u = lu(m)
    return (np.linalg.det(perm) * np.einsum("kii->ki", u).prod(axis=1))[:, None, None]


def slogdet(m: np.ndarray) -> np.ndarray:
    """A row of the sign and the logarithm of the absolute determinant."""
    perm, _, u = lu(m)
    d = np.einsum("kii->ki", u)
    return np.stack([np.linalg.det(perm).round() * np.sign(d).prod(axis=1), np.log(np.abs(d)).sum(axis=1)], axis=1)[:, None]


def inverse(m: np.ndarray) -> np.ndarray:
    return solve(m, np.tile(np.eye(m.shape[1]), (len(m), 1, 1)))


def qr(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The thin factors, R with a positive diagonal."""
    q, r = np.linalg.qr(_finite(m))
    d = np.einsum("kii->ki", r)
    if m.shape[1] < m.shape[2] or (np.abs(d).min(axis=1, initial=np.inf) <= np.abs(r).max(axis=(1, 2), initial=0) * _eps(m)).any():
        raise NumericError("rank deficient")
    sign = np.where(d < 0, -1.0, 1.0)
    return q * sign[:, None], r * sign[:, :, None]


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues (a column) and eigenvectors of symmetric matrices; others are an error."""
    if (np.abs(_square(m) - m.transpose(0, 2, 1)).max(axis=(1, 2), initial=0) > 1e-8 * np.maximum(1, np.abs(m).max(axis=(1, 2), initial=0))).any():
        raise NumericError("not symmetric")
    w, v = np.linalg.eigh(m)
    return w[:, :, None], v


def matrix_rank(m: np.ndarray) -> np.ndarray:
    """Singular values above the largest times eps times the larger side."""
    s = np.linalg.svd(_finite(m), compute_uv=False)
    return (s > s.max(axis=1, keepdims=True, initial=0) * _eps(m)).sum(axis=1)[:, None, None].astype(np.float64)


def condition_number(m: np.ndarray) -> np.ndarray:
    """The largest over the least singular value; infinite for singular matrices."""
    s = np.linalg.svd(_finite(m), compute_uv=False)
    with np.errstate(divide="ignore"):
        return (s.max(axis=1) / s.min(axis=1))[:, None, None]


def conjugate_gradient(m: np.ndarray, b: np.ndarray, tolerance: float = 1e-10, iterations: int | None = None) -> np.ndarray:
    """x of m x = b for symmetric positive definite m; without convergence within iterations (10 n) an error."""
    x = np.zeros_like(b)
    r = b - _square(m) @ x
    p, rr = r.copy(), (r * r).sum(axis=1, keepdims=True)
    goal = tolerance**2 * np.maximum((b * b).sum(axis=1, keepdims=True), np.finfo(float).tiny)
    for _ in range(iterations or 10 * m.shape[1]):
        if (rr <= goal).all():
            return x
        q = m @ p
        curve = (p * q).sum(axis=1, keepdims=True)
        if ((curve <= 0) & (rr > goal)).any():
            raise NumericError("not positive definite")
        live = rr > goal
        step = np.where(live, rr / np.where(live, curve, 1), 0)
        x, r = x + step * p, r - step * q
        new = (r * r).sum(axis=1, keepdims=True)
        p, rr = np.where(live, r + new / np.where(live, rr, 1) * p, p), np.where(live, new, rr)
    if (rr <= goal).all():
        return x
    raise NumericError("no convergence")


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "det": det, "slogdet": slogdet, "inverse": inverse, "lu_p": lambda m: lu(m)[0], "lu_l": lambda m: lu(m)[1], "lu_u": lambda m: lu(m)[2], "cholesky": cholesky, "qr_q": lambda m: qr(m)[0], "qr_r": lambda m: qr(m)[1],
    "eigenvalues": lambda m: eigen(m)[0], "eigenvectors": lambda m: eigen(m)[1], "matrix_rank": matrix_rank, "condition_number": condition_number,
    "solve": solve, "solve_transpose": solve_transpose, "solve_spd": solve_spd, "lower_solve": lower_solve, "upper_solve": upper_solve, "conjugate_gradient": conjugate_gradient,
}


def batched(df: DataFrame, kernel: str, other: DataFrame | None = None) -> DataFrame:
    """A kernel over each matrix of (batch, i0, i1, v), and the right sides of the same form where it takes them.

    A matrix must fit a task; a task's matrices of one shape are computed as one stack, an Arrow batch at a time.
    """
    f, sides = KERNELS[kernel], 1 if other is None else 2
    cells = df.select("batch", F.lit(0).alias("w"), "i0", "i1", F.col("v").cast("double").alias("v"))
    if other is not None:
        cells = cells.unionByName(other.select("batch", F.lit(1).alias("w"), "i0", "i1", F.col("v").cast("double").alias("v")))
    rows = cells.groupBy("batch").agg(*[F.collect_list(c).alias(c) for c in ("w", "i0", "i1", "v")], *[(F.max(F.when(F.col("w") == k, F.col(c))) + 1).alias(f"{c}_{k}") for k in (0, 1) for c in ("i0", "i1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))
            shape = np.stack([col(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("i0_0", "i1_0", "i0_1", "i1_1")], axis=1)
            own = np.repeat(np.arange(b.num_rows), col("v").value_lengths().to_numpy(zero_copy_only=False))
            w, i, j, v = (col(n).flatten().to_numpy(zero_copy_only=False) for n in ("w", "i0", "i1", "v"))
            for s in np.unique(shape, axis=0):
                mine = np.flatnonzero((shape == s).all(axis=1))
                at = np.full(b.num_rows, -1)
                at[mine] = np.arange(len(mine))
                args = []
                for k in range(sides):
                    x = np.zeros((len(mine), s[2 * k], s[2 * k + 1]))
                    m = (at[own] >= 0) & (w == k)
                    x[at[own[m]], i[m], j[m]] = v[m]
                    args.append(x)
                out = f(*args)
                k, p, q = (x.ravel() for x in np.indices(out.shape))
                yield pa.record_batch([col("batch").take(pa.array(mine[k])), pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(out.ravel().astype(np.float64))], names=["batch", "i0", "i1", "v"])

    return rows.mapInArrow(run, "batch bigint, i0 bigint, i1 bigint, v double")


def solve_normal(df: DataFrame, features: list[str], target: str, ridge: float = 0.0, weight: str | None = None) -> np.ndarray:
    """Coefficients (intercept first, not penalized) from one pass of centred cross products, solved on the driver (k x k)."""
    cols = [*features, target]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    bad = F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))).alias("_bad")
    means = df.agg(F.sum(w).alias("_n"), bad, *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in cols]).first()
    if not means["_n"] or means["_bad"]:
        raise NumericError("no rows, or weights that are not finite and at least 0 with a positive sum")
    c = [F.col(x) - F.lit(means[x]) for x in cols]
    k = len(features)
    row = df.agg(*[F.sum(w * c[i] * c[j]).alias(f"_{i}_{j}") for i in range(k) for j in range(i, k + 1)]).first()
    g = np.array([[row[f"_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
    if np.linalg.matrix_rank(g) < k:
        raise NumericError("rank deficient")
    x = np.linalg.solve(g, np.array([row[f"_{i}_{k}"] for i in range(k)]))
    return np.concatenate([[means[target] - sum(a * means[f] for a, f in zip(x, features, strict=True))], x])


def least_squares(df: DataFrame, columns: list[str], target: str) -> np.ndarray:
    """The x of least |A x - b|, no intercept: each partition's rows shrink to the triangle of their QR factors, triangles shrink
    again in groups, and the driver solves the last one (k + 1 rows a group)."""
    k = len(columns) + 1
    names = [f"c{i}" for i in range(k)]
    schema = ", ".join(f"{n} double" for n in names)

    def run(frames):
        r = np.zeros((0, k))
        for f in frames:
            m = np.vstack([r, f.to_numpy(np.float64)])
            r = np.linalg.qr(_finite(m), mode="r")
        yield pd.DataFrame(r, columns=names)

    d = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*columns, target], names, strict=True)]).mapInPandas(run, schema)
    r = np.linalg.qr(d.repartition(16).mapInPandas(run, schema).toPandas().to_numpy(np.float64), mode="r")
    if len(r) < k - 1 or np.linalg.matrix_rank(r[: k - 1, : k - 1]) < k - 1:
        raise NumericError("rank deficient")
    return np.linalg.solve(r[: k - 1, : k - 1], r[: k - 1, k - 1])
