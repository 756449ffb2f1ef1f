from fractions import Fraction

import numpy as np
import pytest

from evidra.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, white string, x int"


def exact_covariance(x: list[list[int]]) -> list[list[Fraction]]:
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def checked(rows: list[tuple], out: list, most: int) -> None:
    """Contract figures by exact arithmetic, components by what defines them."""
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    v = np.array([[float(c) for c in r] for r in exact_covariance([r for _, r in x])])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = min(most, int((e > 1e-13 * np.trace(v)).sum()))
    assert len(out) == n * k
    sums = [sum(r[i] for _, r in x) for i in range(d)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for i, r in x}
    assert all((r.n, r.deviation) == (n, deviation[r.vec_id]) for r in out)
    assert np.allclose([r.explained for r in out], [e[r.component - 1] / np.trace(v) for r in out], rtol=1e-9)
    w = {(r.vec_id, r.component): r.whitened for r in out}
    white = np.array([[w[i, c] for c in range(1, k + 1)] for i, _ in x])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8 and {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-8
    # whitened = centred x basis / sqrt(e): the basis that fits must be made of unit eigenvectors
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for _, r in x])
    basis = centred.T @ white / n / np.sqrt(e[:k])
    assert np.allclose(np.linalg.norm(basis, axis=0), 1) and np.allclose(v @ basis, basis * e[:k], atol=1e-7 * e[0])


@pytest.mark.parametrize("most", [3, 32])
def test_by_exact_arithmetic(spark, most):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7)))]
    bad = [(500, None, 1, None, 1), (501, [1.0, None] + [0.0] * 5, 1, None, 1), (502, [float("nan")] + [0.0] * 6, 1, None, 1), (503, [float("-inf")] * 7, 1, None, 1), (504, [1.0, 2.0], 1, None, 1), (505, [], 1, None, 1), (506, [1e300] * 7, 1, None, 1)]
    df = spark.createDataFrame([(i, v, None, "w", 1) for i, v in rows] + bad, SCHEMA).repartition(4)
    checked(rows, whitening.whiten(df, most=most).collect(), most)


def test_large_entries(spark):
    """Sums beyond a long: products in doubles, deviations exact or null."""
    rng = np.random.default_rng(4)
    rows = [(i, (v * 1e9).tolist()) for i, v in enumerate(rng.normal(size=(50, 3)))]
    df = spark.createDataFrame([(i, v, 1, "", 1) for i, v in rows], SCHEMA)
    out = whitening.whiten(df).collect()
    assert len(out) == 150 and out[0].identity_error < 1e-8 and all(r.deviation is None for r in out)


def test_ties_repeats_and_nothing(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "", 1) for i, v in rows], SCHEMA)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(frame(rows)).collect() == []
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 3.0]), (3, [2.0, 5.0])]  # on one line: one component
    out = whitening.whiten(frame(rows)).collect()
    assert [(r.component, r.n, round(r.explained, 9)) for r in out] == [(1, 4, 1.0)] * 4
    assert sum(r.vec_id is None for r in out) == 1 and sum(r.vec_id == 1 for r in out) == 2


def test_query_by_exact_arithmetic(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    checked(rows, queries.queries()["op12_whiten_triangle"](spark, "/root/testdata/sf0.001").collect(), 32)
