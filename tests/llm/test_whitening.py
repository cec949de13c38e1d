"""Op 12: against a singular value decomposition of the exact integer matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entailer.llm import whitening as W
from entailer.llm.queries import op12_embedding_whitening
from tests.llm.helpers import as_table

SCHEMA = "vec_id long, embedding array<float>, label int"


def table_of(spark, vectors, ids=None):
    rows = [(i, v, 0) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def matrix(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in x]
    return n, exact, np.array([[c / n for c in row] for row in exact])


def check(got, vectors, ids):
    n, exact, m = matrix(vectors)
    _, sigma, vt = np.linalg.svd(m, full_matrices=False)
    k = max((r["component"] for r in got), default=0)
    w = m @ vt[:k].T / (sigma[:k] / math.sqrt(n))
    assert len(got) == n * k
    by_row = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(k):
        mine = np.array([by_row[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ w[:, c])
        assert np.abs(mine * sign - w[:, c]).max() < 1e-6
    for i, row in zip(ids, exact):
        r = by_row[i, 1]
        assert (r["n"], r["deviation"]) == (n, sum(c * c for c in row))
    for c in range(k):
        share = by_row[ids[0], c + 1]["explained"]
        assert share == pytest.approx(sigma[c] ** 2 / (sigma ** 2).sum(), rel=1e-8)
    assert all(r["identity_error"] < 1e-6 for r in got)
    return k


def test_random_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()
    df = table_of(spark, vectors).repartition(5)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("_x", "k0", "component", "n", "i", "v")])
    sf = as_table(str(tmp_path), embeddings=df)
    assert check(op12_embedding_whitening(spark, sf).collect(), vectors, range(400)) == 8


def test_ill_conditioned_vectors(spark):
    """Dimensions that differ by one step of x: the covariance's condition is past 1e13."""
    r = np.random.default_rng(2)
    a = r.integers(-3_000_000, 3_000_000, size=(300, 2)) / 1024
    near = a[:, :1] + r.integers(0, 2, size=(300, 1)) / 1024
    vectors = np.hstack([a, near]).astype(np.float32).tolist()
    n, _, m = matrix(vectors)
    sigma = np.linalg.svd(m, compute_uv=False)
    assert (sigma[0] / sigma[-1]) ** 2 > 1e13
    got = W.whiten(table_of(spark, vectors)).collect()
    assert check(got, vectors, range(300)) == 3


def test_dependent_and_constant_dimensions(spark):
    """The rank bounds the components: a copy and a constant add none."""
    r = np.random.default_rng(3)
    a = r.normal(size=(200, 4)).astype(np.float32)
    vectors = np.hstack([a, a[:, :2], np.full((200, 1), 7, np.float32)]).tolist()
    assert check(W.whiten(table_of(spark, vectors)).collect(), vectors, range(200)) == 4


def test_unusable_vectors_and_ties(spark):
    r = np.random.default_rng(4)
    good = r.normal(size=(40, 3)).astype(np.float32).tolist()
    good[7] = good[3]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0],
           [float("-inf"), 0.0, 1.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    df = table_of(spark, good + bad, [*range(40), *range(100, 100 + len(bad))])
    assert check(W.whiten(df).collect(), good, range(40)) == 3
    null_id = W.whiten(table_of(spark, good + [good[0]], [*range(40), None]))
    assert null_id.where("vec_id is null").count() == 3


def test_deviation_beyond_a_long_is_null(spark):
    vectors = [[0.0], [9e8], [1.0]]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(table_of(spark, vectors)).collect()}
    _, exact, _ = matrix(vectors)
    want = [sum(c * c for c in row) for row in exact]
    assert [got[i] for i in range(3)] == [v if v < 1 << 63 else None for v in want]
    assert None in got.values()


@pytest.mark.parametrize("vectors", [[], [None, None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_without_variance(spark, vectors):
    assert W.whiten(table_of(spark, vectors)).collect() == []
