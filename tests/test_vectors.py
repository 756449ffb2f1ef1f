"""The vector index against all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from evidra.operators import retrieve, vectors

SCHEMA = "uid long, embedding array<double>"


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[rng.integers(12)] + 0.2 * rng.normal(size=d)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[5][1]) for i in range(40)]  # a crowd of equal vectors


def plain(rows, queries, k):
    """By cosine of every pair, rounded, ties by uid."""
    out = set()
    for q, v in queries:
        scored = []
        for u, e in rows:
            if u != q and v and e and len(v) == len(e) and all(map(np.isfinite, e)) and np.linalg.norm(e) and np.linalg.norm(v):
                c = np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)
                s = np.floor(c * 1024 + 0.5) / 1024
                scored += [(-s, u)] if s > 0 else []
        out |= {(q, u, float(-s), i + 1) for i, (s, u) in enumerate(sorted(scored)[:k])}
    return out


def test_exact_search_and_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = clustered(400, 8, 1) + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, 2.0]), (904, [2.0, 1.0]), (905, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [(u, e) for u, e in rows if u % 20 == 0] + [(903, [1.0, 2.0]), (-1, [0.0] * 8), (-2, None), (-3, [1.0] * 5)]
    q = spark.createDataFrame(asked, "query long, vector array<double>")
    index = vectors.build(df, lists=20, part=16)
    assert index.members.count() == 442 and index.members.groupBy("list", "part").count().agg({"count": "max"}).first()[0] < 60
    want = plain(rows, asked, 5)
    assert {tuple(r) for r in vectors.search(index, q, 5, probes=2).collect()} == want
    some = vectors.search(index, q, 5, probes=2, exact=False)
    share = vectors.recall(some, spark.createDataFrame(list(want), "query long, uid long, score double, rank int"))
    found = {(r.query, r.uid) for r in some.collect()}
    assert share == len(found & {x[:2] for x in want}) / len(want) >= 0.9


def test_lists_that_cannot_help_stay_closed(spark):
    """On tight clusters the second round of an exact search opens few lists."""
    rows = clustered(600, 16, 2)
    index = vectors.build(spark.createDataFrame(rows, SCHEMA), lists=24)
    q = spark.createDataFrame([(u, e, 0.9) for u, e in rows if u % 20 == 0], "query long, vector array<double>, least double")
    assert vectors._asked(index, q, 2, rest=True).count() < 0.2 * q.count() * index.lists.count()


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query long, vector array<double>")
    assert vectors.search(vectors.build(empty), q, 5).count() == 0
    index = vectors.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], SCHEMA))
    assert vectors.search(index, q.limit(0), 5).count() == 0
    assert [tuple(r) for r in vectors.search(index, q, 5).collect()] == [(1, 2, 1.0, 1)]


def test_given_vectors(spark):
    """Recall at 5 of a few probes on the given table, against the scan."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id uid", "embedding")
    q = v.where("uid % 20 = 0").selectExpr("uid query", "embedding vector")
    index, true = vectors.build(v), retrieve.nearest(v, q, 5).cache()
    assert {tuple(r) for r in vectors.search(index, q, 5).collect()} == {tuple(r) for r in true.collect()}
    assert vectors.recall(vectors.search(index, q, 5, probes=16, exact=False), true) >= 0.9


def test_scoring_holds_a_tile_however_many_queries(monkeypatch):
    rng = np.random.default_rng(3)
    lists = lambda n: pa.array(list(rng.integers(-5, 6, (n, 6)).astype(float)), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), lists(9000)], ["uid", "embedding"])
    asked = pa.table({"query": pa.array(range(0, 6000, 2)), "vector": lists(3000)})
    tracemalloc.start()
    got = [r for b in retrieve._scored(asked, 4)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # a whole block of scores alone takes 200 MB
    monkeypatch.setattr(retrieve, "TILE", 4096)
    assert got == [r for b in retrieve._scored(asked, 4)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))] and len(got) > 10_000
