"""Whitening of embeddings by one aggregation over all pairs of dimensions.

Entries become long integers, x = floor(64 c) + 1,000,000, so that sums are exact.
A first aggregation gives count, sums and ranges of each dimension, a second one the
upper triangle: generated Spark SQL expressions sum (x_i - m_i) (x_j - m_j) for every
pair i <= j, a column for each j in a group for each i, where m is the mean rounded to
an integer. What the rounding
leaves is put right in whole numbers, so each entry of the covariance is the true one
to the last bit of a double. LAPACK decomposes that matrix on the driver: its size is
the square of the vectors' length, whatever their number. The rows are then projected
where they lie, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: x = floor(SCALE c) + SHIFT.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries whose x would leave this range have no x; such vectors are dropped as non-finite ones are.
LARGEST = float(1 << 62)
#: An eigenvalue at or below this share of the trace is rounding, not variance.
LEAST_SHARE = 1e-14


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the integer vectors of the rows whose vector has only finite entries of a size that x can hold.

    Null and empty vectors, and those with a null, infinite or not-a-number entry, are dropped.
    """
    # an infinite or not-a-number entry is not below the bound, so it has no x, as a null one
    whole = lambda c: F.when(F.abs(c) * SCALE < LARGEST, F.floor(c * SCALE) + SHIFT)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda c: whole(c.cast("double"))).alias("x"))
    return rows.where((F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))


def triangle(d: int) -> list[str]:
    """SQL of the sums of centred products, column j of the triangle each: in the group of dimension i, the pair (i, j)."""
    return [f"sum(case when i <= {j} then v * y[{j}] end) as s{j}" for j in range(d)]


def products(rows: DataFrame, column: str, means: list, kind: str) -> list[list]:
    """The sums of (x_i - m_i) (x_j - m_j) for all pairs of dimensions of an array column, by one aggregation.

    Each vector gives a row for each dimension i, which is grouped by i before the
    shuffle; each group sums its row of the upper triangle. The expressions of all
    pairs at once would be a few thousand, more than a JVM compiles.
    """
    d = len(means)
    terms = ", ".join(f"cast({column}[{i}] as {kind}) - cast({m} as {kind})" for i, m in enumerate(means))
    each = rows.selectExpr(f"array({terms}) as y").select("y", F.posexplode("y").alias("i", "v"))
    out = [[None] * d for _ in range(d)]
    for r in each.groupBy("i").agg(*map(F.expr, triangle(d))).collect():  # d rows
        for j in range(r["i"], d):
            out[r["i"]][j] = out[j][r["i"]] = r[f"s{j}"]
    return out


def fitted(rows: DataFrame, d: int) -> tuple[int, list[int], int, np.ndarray]:
    """Count, sums, largest |x - m|, and covariance of integer vectors x of d entries."""
    at = range(d)
    row = rows.selectExpr("count(*) as n", f"array({', '.join(f'sum(cast(x[{i}] as decimal(38,0)))' for i in at)}) as s", f"array({', '.join(f'min(x[{i}])' for i in at)}) as lo", f"array({', '.join(f'max(x[{i}])' for i in at)}) as hi").first()
    n, sums = row["n"], [int(v) for v in row["s"]]
    means = [s // n for s in sums]
    far = max(max(hi - m, m - lo) for lo, hi, m in zip(row["lo"], row["hi"], means)) + 1
    # whole numbers while the sums of products fit a long, else doubles
    exact = n * far * far < 1 << 63
    kind = "bigint" if exact else "double"
    sums_of = products(rows, "x", means, kind)
    left = [s - n * m for s, m in zip(sums, means)]
    if exact:
        cov = [[(n * int(sums_of[i][j]) - left[i] * left[j]) / (n * n) for j in at] for i in at]
    else:
        cov = [[sums_of[i][j] / n - (left[i] / n) * (left[j] / n) for j in at] for i in at]
    return n, sums, far, np.array(cov, np.float64)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are more than rounding, by falling size, `most` at most, and their unit vectors as columns."""
    e, vectors = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > LEAST_SHARE * max(np.trace(cov), 0.0)]
    return e[order], vectors[:, order]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable vector and component.

    Usable are vectors of finite entries (see quantised) of the commonest length (of
    equally common ones the least): there is no covariance across lengths. Components
    are numbered by falling eigenvalue; those without variance, as for equal vectors,
    are left out, so one row or none, or no usable one, gives no rows. Repeated rows
    count and come out each; a null vec_id stays. deviation is exact, and null where
    it doesn't fit a long.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    every = quantised(vectors, id_col, vector_col)
    size = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if size is None:
        return nothing
    d = size["d"]
    rows = every.where(F.size("x") == d)
    n, sums, far, cov = fitted(rows, d)
    e, basis = components(cov, most)
    k = len(e)
    if not k:
        return nothing
    means = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, means)], np.int64)
    scaled = basis / np.sqrt(e)
    fits = d * (n * far) ** 2 < 1 << 63

    def deviation(near: np.ndarray) -> pa.Array:
        if fits:
            return pa.array(((n * near - rest) ** 2).sum(1), pa.int64())
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest.tolist())) for row in near.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("x").flatten().to_numpy().reshape(-1, d) - means
            white = (near - rest / n) @ scaled
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation(near), lists], ["vec_id", "deviation", "white"])

    wide = kept(rows.mapInArrow(project, f"vec_id {kind}, deviation long, white array<double>"))
    centre = wide.selectExpr(f"array({', '.join(f'avg(white[{i}])' for i in range(k))}) as found").first()[0]
    again = products(wide, "white", [f"{c!r}D" for c in centre], "double")
    error = float(np.abs(np.array(again) / n - np.eye(k)).max())
    shares = (e / np.trace(cov)).tolist()
    long = wide.select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(F.array(*map(F.lit, shares)), F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
