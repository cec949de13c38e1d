"""Embedding whitening by shifted CholeskyQR.

Entries become integers ``x = floor(1024 c) + 100000``. The centred matrix ``M``
(rows ``x - S/n``, one for each vector) is factored ``M = Q R`` without ever being
collected:

1. One pass sums ``x`` for each dimension; the sums are exact integers, so a row is
   centred as ``(n x - S) / n`` with one rounding.
2. A Gram pass computes ``G = Q^T Q``: every task orthogonalises its own rows by
   triangular solves with the factors found so far (``Q = M R1^-1 R2^-1 ...``) and
   adds up their products; Spark sums the parts entry by entry.
3. The driver factors ``G + sI`` by Cholesky, with the shift ``s`` that keeps an
   ill-conditioned Gram matrix positive definite, and the next pass starts with one
   factor more. The passes end when ``Q`` is orthonormal (or zero, in directions in
   which the vectors do not vary).
4. The composed factor, corrected by the square root of the last Gram matrix, is a
   ``d x d`` matrix with the singular values and right singular vectors of ``M``:
   its SVD gives the components without squaring the condition number.

A last Gram pass measures the covariance of the whitened rows. Only ``d x d``
matrices reach the driver; parts are one row of each matrix and task.

Defined cases: vectors that are null or hold null or non-finite entries are left
out, and so are entries beyond ``2**40`` in size and vectors of another length than
the most frequent one (the longer one of two); repeated rows count each; components
without variance (beyond the rank) are left out, so a table of equal vectors gives no
rows, as does an empty table; a deviation that does not fit a long is null; null ids
are kept; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.llm.common import map_batches
from entailer.operators.fixpoint import pin

SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 40)
COMPONENTS = 8
MAX_PASSES = 10
ROUND_OFF = 2.0 ** -53


# --- Small dense algebra (d x d) and rows of a batch ---------------------------

def solve_rows(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``m r^-1`` for an upper triangular ``r``, column by column over all rows."""
    q = np.empty_like(m)
    for j in range(r.shape[1]):
        q[:, j] = (m[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def next_factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Cholesky factor (upper) of the Gram matrix, shifted where it is needed."""
    d = len(gram)
    values = np.linalg.eigvalsh(gram)
    top = max(values[-1], 0.0)
    shift = 11 * (n * d + d * (d + 1)) * ROUND_OFF * top
    safe = values[0] > 100 * shift
    scaled = gram + (0.0 if safe else max(shift, 1e-300)) * np.eye(d)
    return np.linalg.cholesky(scaled).T


def orthonormal(gram: np.ndarray) -> bool:
    """Is every eigenvalue 1, or 0 for a direction without variance?"""
    values = np.linalg.eigvalsh(gram)
    return bool(np.all((np.abs(values - 1) < 1e-12) | (values < 1e-12)))


def composed(factors: list[np.ndarray], gram: np.ndarray) -> np.ndarray:
    """A ``d x d`` matrix with the singular values and vectors of ``M``."""
    r = np.eye(len(gram))
    for f in factors:
        r = f @ r
    values, vectors = np.linalg.eigh(gram)
    return (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T @ r


@dataclass(frozen=True)
class Fit:
    """Sums of the fit list and the components found."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray = None   # one component each row
    values: np.ndarray = None    # eigenvalues of the covariance, falling
    total: float = 0.0           # trace of the covariance

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` in exact integers, in 64 bits where they suffice."""
        centre = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = [s - self.n * int(c) for s, c in zip(self.sums, centre)]
        near = x - centre
        widest = int(np.abs(near).max(initial=0)) * self.n + max(map(abs, rest), default=0)
        if widest >= 1 << 62:
            near = near.astype(object)
        return near * self.n - np.array(rest, near.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of squared deviations of every row; null beyond a long."""
        y = self.deviations(x)
        widest = int(np.abs(y).max(initial=0))
        if widest * widest * x.shape[1] >= 1 << 63:
            y = y.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


# --- Passes over the rows -------------------------------------------------------

def integer_vectors(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """Usable rows as columns ``keep`` and ``x``, an array of long."""
    c = F.col(vector).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LIMIT))
    kept = rows.where(F.coalesce(usable, F.lit(False)) & (F.size(c) > 0))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return kept.select(*keep, x.alias("_x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of the most frequent length, their number and that length."""
    top = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not top:
        return rows, 0, 0
    d, n = top[0]["d"], top[0]["count"]
    return rows.where(F.size("_x") == d), n, d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def column_sums(rows: DataFrame, d: int) -> tuple[int, ...]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for b in batches:
            total += matrix(b.column(0), d).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d), "v": [str(v) for v in total]})

    parts = map_batches(rows.select("_x"), run, "i long, v string")
    got = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return tuple(int(v) for _, v in sorted((r["i"], r["v"]) for r in got))


def gram(rows: DataFrame, d: int, width: int, of_rows) -> np.ndarray:
    """Sum over all rows of the products of ``of_rows(x)``, a row of ``width`` doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for b in batches:
            q = of_rows(matrix(b.column(0), d))
            total += q.T @ q
            seen = seen or b.num_rows > 0
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    parts = map_batches(rows.select("_x"), run, "i long, v array<double>")
    entries = parts.select("i", F.posexplode("v").alias("j", "v")).where(F.col("i") <= F.col("j"))
    out = np.zeros((width, width))
    for r in entries.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit_whitening(rows: DataFrame, n: int, d: int, components: int = COMPONENTS) -> Fit:
    """Components of all ``rows(_x)`` of length ``d``."""
    base = Fit(n, column_sums(rows, d))
    factors: list[np.ndarray] = []

    def orthogonalised(x: np.ndarray) -> np.ndarray:
        q = base.centred(x)
        for f in factors:
            q = solve_rows(q, f)
        return q

    g = gram(rows, d, d, orthogonalised)
    while np.any(g) and not orthonormal(g) and len(factors) < MAX_PASSES:
        factors.append(next_factor(g, n))
        g = gram(rows, d, d, orthogonalised)
    _, sigma, vectors = np.linalg.svd(composed(factors, g))
    rank = int(np.sum(sigma > max(n, d) * ROUND_OFF * sigma[0])) if sigma[0] > 0 else 0
    k = min(components, rank)
    vectors = vectors[:k]
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)]) if k else np.ones(0)
    return Fit(n, base.sums, vectors * signs[:, None], sigma[:k] ** 2 / n, float((sigma ** 2).sum() / n))


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           components: int = COMPONENTS) -> DataFrame:
    """Columns ``keep`` and, for every component, ``component, n, deviation, whitened,
    explained, identity_error``."""
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    ids = [f"k{i}" for i in range(len(keep))]
    found = integer_vectors(rows, vector, keep).toDF(*ids, "_x")
    found, n, d = of_one_length(pin(found))
    fit = fit_whitening(found, n, d, components) if n else Fit(0, ())
    k = 0 if fit.values is None else len(fit.values)
    if k:
        cov = gram(found, d, k, fit.whitened) / n
        error = float(np.abs(cov - np.eye(k)).max())
        explained = fit.values / fit.total
    types = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            x = matrix(b.column("_x"), d)
            w = fit.whitened(x)
            at = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays([
                *[b.column(c).take(pa.array(at)) for c in ids],
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(len(at), n)),
                pa.array(fit.squares(x), pa.int64()).take(pa.array(at)),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, b.num_rows)),
                pa.array(np.full(len(at), error))],
                [*ids, *[c.split()[0] for c in schema.split(", ")]])

    out = map_batches(found, run, "".join(f"{c} {types[c]}, " for c in ids) + schema)
    return out.select(*[F.col(i).alias(c) for i, c in zip(ids, keep)], *[c.split()[0] for c in schema.split(", ")])
