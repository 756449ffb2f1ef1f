import tempfile

import pytest
from pyspark.sql import functions as F

from evidra.functions import scalars as S
from evidra.operators import check, graph, merge, retrieve
from evidra.sources import store as T

EDGES = "src string, dst string, kind string"


def test_traversal_with_cycle_and_copies(spark):
    e = spark.createDataFrame([("a", "b", "deps"), ("b", "c", "grounds"), ("c", "a", "deps"), ("c", "d", "deps"), ("c", "d", "deps"), ("x", "y", "causes")], EDGES)
    roots = spark.createDataFrame([("a",), ("a",), ("q",)], "uid string")
    assert {(r.uid, r.level) for r in graph.closure(e, roots).collect()} == {("a", 0), ("q", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.uid, r.level) for r in graph.levels(e).collect()} == {("d", 0)}
    assert {r.uid for r in graph.cycles(e, graph.SUPPORT).collect()} == {"a", "b", "c"}
    none = e.limit(0)
    assert graph.levels(none).count() == 0 == graph.cycles(none, graph.SUPPORT).count()


def test_merge_is_a_join_semilattice(spark):
    rows = [[("a", 1, "x"), ("b", None, "y")], [("a", 2, "x"), ("c", 3, None)], [("b", 0, "z")]]
    a, b, c = (spark.createDataFrame(r, "uid string, status int, gist string") for r in rows)
    m = lambda x, y: merge.merged(x, y, ["uid"])
    state = lambda df: sorted(map(str, df.collect()))
    assert state(m(a, b)) == state(m(b, a)) and state(m(m(a, b), c)) == state(m(a, m(b, c))) and state(m(a, a)) == state(a)


def test_store_round_trip(spark):
    s = T.from_tables(spark, "/root/testdata/sf0.001")
    path = tempfile.mkdtemp(prefix="spark-") + "/store"
    s.save(path)
    back = T.Store.load(spark, path)
    assert back.units.count() == s.units.count() and sorted(back.edges.columns) == sorted(s.edges.columns)
    assert "PartitionFilters: [isnotnull(kind" in back.edges.where("kind = 'rebuts'")._jdf.queryExecution().toString()


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(S.tokens(F.lit("日本"))) == 2 and value(S.tokens(F.lit(None).cast("string"))) == 0
    assert value(S.quantise(F.lit(0.5004))) == 0.5 and value(S.quantise(F.lit(float("nan")))) is None
    assert value(S.terms(F.lit("parseHTTPx2 snake_case plain"))) == ["parsehttpx2", "parse", "httpx", "2", "snake_case", "snake", "case", "plain"]
    assert [value(S.quote_support(F.lit(q), F.lit("The “big”  red dog ran"))) for q in ('the "big" red', "big dog", "cat", "")] == ["present", "loose", "absent", "absent"]
    assert value(S.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0


def test_rankings_break_ties_by_name(spark):
    docs = spark.createDataFrame([("b", "red"), ("a", "red"), ("c", None)], "uid string, gist string")
    got = retrieve.bm25(docs, spark.createDataFrame([(1, "Red"), (2, "")], "query int, text string"), 5).orderBy("rank").collect()
    assert [(r.query, r.uid, r.rank) for r in got] == [(1, "a", 1), (1, "b", 2)]


def test_checks_on_single_defects(spark):
    units = spark.createDataFrame([("m", "claim", "g", 3, None), ("w", "claim", "g", 1, "s"), ("n", "claim", " ", 4, None), ("u", "claim", "x" * 200, 0, None)], "uid string, kind string, gist string, status int, source string")
    edges = spark.createDataFrame([("m", "w", "grounds"), ("m", "gone", "grounds")], EDGES)
    assert [(r.uid, r.ground) for r in check.rule_m(units, edges).collect()] == [("m", "w")]
    assert {(r.code, r.uid) for r in check.shape(units, edges).collect()} == {("E021", "n"), ("E022", "u"), ("E032", "n"), ("E034", "u")}
    assert [(r.uid, r.missing) for r in graph.dangling(edges, units).collect()] == [("m", "gone")]
