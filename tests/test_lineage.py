"""Lineage, compaction, threads and chunks on small cases and against plain versions."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import chunk, graph, merge, retrieve, thread
from evidra.sources import imports

EDGES = "src string, dst string, kind string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_hop_diff(spark):
    a = spark.createDataFrame([("old", "m", 0), ("x", "m", 1), ("y", "m", 3), ("z", "n", 3), ("self", "m", 1), ("w", "m", 0)], "uid string, agent string, hop int")
    e = spark.createDataFrame([("z", "old", "supersedes"), ("none", "x", "supersedes"), ("z", "y", "retracts"), ("self", "self", "retracts"), ("z", "w", "supersedes"), ("z", "w", "retracts")], EDGES)
    got = {r.uid: (r.change, r.successor) for r in merge.hop_diff(a, e, 1, 5).collect()}
    # first seen in the span: added, though retracted in it; an edge that nothing dates counts always, a self-edge isn't dated by its own unit
    assert got == {"old": ("superseded", "z"), "x": ("superseded", "none"), "y": ("added", None), "z": ("added", None), "self": ("retracted", None), "w": ("retracted", None)}
    dated = e.withColumn("hop", F.when(F.col("dst") == "self", 9).cast("int"))
    assert {r.uid: r.change for r in merge.hop_diff(a, dated, 1, 5).collect()}["self"] == "survived"
    changes = merge.hop_diff(a, e, 1, 5)
    assert rows(merge.by_agent(changes, a), "agent", "added", "superseded", "retracted") == [("m", 1, 0, 2), ("n", 1, 1, 0)]
    assert merge.survival_rate(changes).first().rate == 0.0 and merge.survival_rate(changes.limit(0)).first().rate == 1.0


def test_compaction(spark):
    u = spark.createDataFrame([(x,) for x in "abcdefghij"], "uid string")
    fates = lambda *e: {r.uid: r.fate for r in merge.compactable(u, spark.createDataFrame(list(e), EDGES)).collect()}
    assert fates(("b", "a", "supersedes")) == {"a": "dropped"}
    assert fates(("b", "a", "supersedes"), ("a", "c", "causes")) == {"a": "referenced"}  # named at its outgoing end
    assert fates(("b", "a", "supersedes"), ("c", "a", "grounds")) == {"a": "referenced"}
    assert fates(("b", "a", "supersedes"), ("c", "b", "supersedes"), ("a", "d", "grounds")) == {"a": "dropped", "b": "dropped"}
    assert fates(("gone", "a", "supersedes")) == {} and fates(("b", "a", "supersedes"), ("a", "a", "retracts")) == {"a": "referenced"}


def test_relink_and_forks(spark):
    u = spark.createDataFrame([(x,) for x in "abcdefg"], "uid string")
    e = spark.createDataFrame([("b", "a", "supersedes"), ("c", "b", "supersedes"), ("e", "d", "supersedes"), ("f", "d", "supersedes"), ("g", "a", "grounds"), ("g", "d", "deps"), ("g", "zz", "deps"), ("g", "c", "deps"), ("b", "a", "deps")], EDGES)
    got = {(r.dst): (r.now, r.fate) for r in merge.relink(u, e).collect()}
    assert got == {"a": ("c", "moved"), "d": (None, "forked"), "zz": (None, "dangling"), "c": (None, "kept")}
    ordered = e.union(spark.createDataFrame([("f", "e", "supersedes")], EDGES))
    assert {r.dst: r.now for r in merge.relink(u, ordered).collect()}["d"] == "f"
    assert rows(merge.forks(e), "over", "positions") == [("d", "e,f")] and merge.forks(ordered).count() == 0


def test_repair_is_transitive(spark):
    rng = random.Random(4)
    names = [f"u{i:02}" for i in range(18)]
    for case in range(4):
        edges = [(a, b, "deps") for a in names for b in rng.sample(names, 2) if a != b and rng.random() < 0.7]
        units = [n for n in names if rng.random() < 0.9]
        steps = [(s, p, f"r{p}", u) for s in (1, 2) for p, u in enumerate(rng.sample(units, 4), 1)]
        got = {}
        for r in thread.repaired(spark.createDataFrame(steps, "scope int, pos int, role string, uid string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x,) for x in units], "uid string")).orderBy("scope", "pos").collect():
            got.setdefault(r.scope, []).append((r.role, r.uid))
        for s in (1, 2):
            want = [(r, u) for t, _, r, u in steps if t == s]
            while True:  # the first step with a missing dep gets its least one before it, again and again
                there = {u for _, u in want}
                found = next(((i, min(m)) for i, (_, u) in enumerate(want) if (m := [b for a, b, _ in edges if a == u and b in units and b not in there])), None)
                if found is None:
                    break
                want.insert(found[0], (want[found[0]][0], found[1]))
            assert got[s] == want


def test_order_of_a_scope(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(12)]
    edges = [(a, b, "causes") for a in names for b in names if a != b and rng.random() < 0.1] + [("n1", "elsewhere", "causes")]
    members = spark.createDataFrame([(1, n) for n in names], "scope int, uid string")
    got = [r.uid for r in graph.ordered(spark.createDataFrame(edges, EDGES), members).orderBy("index").collect()]
    out, left = [], set(names)
    while ready := sorted(u for u in left if not any(a == u and b in left for a, b, _ in edges)):
        out.append(ready[0])
        left.discard(ready[0])
    assert got == out + sorted(left)


def plain_order(nodes, edges):
    """Always the least node whose edges all lead to what is out already; what is left, by name."""
    out, left = [], set(nodes)
    while ready := sorted(u for u in left if not any(a == u and b in left for a, b in edges)):
        out.append(ready[0])
        left.discard(ready[0])
    return out, sorted(left)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_of_a_store(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(60)]
    rng.shuffle(names)
    edges = {(a, b) for a, b in zip(names, names[1:]) if rng.random() < 0.5} | {tuple(rng.sample(names[:30], 2)) for _ in range(6)} | {("n05", "gone"), ("n07", "n07")}
    units = spark.createDataFrame([(n,) for n in names] + [("alone",)], "uid string")
    got = graph.store_order(spark.createDataFrame([(a, b, rng.choice(graph.ORDERING)) for a, b in edges], EDGES).repartition(3), units).orderBy("index").collect()
    order, cyclic = plain_order({*names, "alone", "gone"}, edges)
    assert [r.uid for r in got] == order + cyclic and [r["index"] for r in got] == list(range(62)) and {r.uid for r in got if r.cyclic} == set(cyclic)
    assert graph.store_order(spark.createDataFrame([], EDGES), units.limit(0)).count() == 0


def test_components(spark):
    """A long path with names in any order, a ring, and a loop."""
    names = [f"p{i}" for i in range(300)]
    random.Random(4).shuffle(names)
    pairs = [*zip(names, names[1:]), ("x", "y"), ("y", "z"), ("z", "x"), ("l", "l")]
    got = dict(rows(graph.components(spark.createDataFrame(pairs, "src string, dst string")), "uid", "head"))
    assert got == {n: min(names) for n in names} | {"x": "x", "y": "x", "z": "x", "l": "l"}


def test_ends_lie_anywhere(spark):
    """An ordering edge whose other end is in no scope counts for first, last and the index."""
    m = spark.createDataFrame([(1, u) for u in "abc"] + [(2, "d")], "scope int, uid string")
    e = spark.createDataFrame([("a", "z", "causes"), ("y", "c", "causes"), ("z", "d", "enables")], EDGES)
    got = {r.uid: (r.first, r.last, r.pos) for r in thread.placed(m, e).collect()}
    assert got == {"a": (False, True, 2), "b": (False, False, 0), "c": (True, False, 1), "d": (True, False, 0)}


def test_gists_of_absent_units(spark):
    """A role whose first step has no unit says nothing; its second step doesn't speak for it."""
    steps = spark.createDataFrame([(1, 1, "bottom-line", "gone"), (1, 2, "bottom-line", "b"), (1, 3, "risk", "c"), (2, 1, "support", "gone"), (2, 2, "support", "b"), (3, 1, "support", "b")], "scope int, pos int, role string, uid string")
    texts = spark.createDataFrame([("b", "said"), ("c", " risky ")], "uid string, gist string")
    assert dict(rows(thread.gists(steps, texts, "brief"), "scope", "gist")) == {1: "risky", 2: "", 3: "said"}


def test_derived_thread(spark):
    m = spark.createDataFrame([(1, "q", "finding", 3, 0.9), (1, "e", "evidence", 2, 0.5), (1, "f", "evidence", 2, 0.6), (1, "g", "evidence", 2, 0.4), (1, "h", "evidence", 2, 0.3), (1, "none", "evidence", 2, 1.0)], "scope int, uid string, kind string, status int, salience double")
    units = spark.createDataFrame([(u,) for u in "qefghd"], "uid string")
    e = spark.createDataFrame([("e", "d", "deps"), ("f", "e", "causes")], EDGES)
    made = thread.derive(m, e, units, "brief")
    # supports by their index in the store's order: g before f, which waits for e
    assert [tuple(r) for r in made.steps.orderBy("pos").select("role", "uid", "needed_by").collect()] == [("bottom-line", "q", None), ("support", "d", "e"), ("support", "e", None), ("support", "f", None), ("support", "g", None)]
    assert made.unfilled.count() == 0 and [tuple(r) for r in made.unselected.collect()] == [(1, 0)]
    assert rows(thread.derive(m.where("kind <> 'finding'"), e, units, "brief").unfilled, "role", "missing") == [("bottom-line", 1)]


def test_cycle_groups(spark):
    e = [("a", "b"), ("b", "a"), ("x", "a"), ("y", "x"), ("c", "d"), ("d", "c"), ("c", "a"), ("b", "q")]
    got = {r.uid: (r.head, r.n) for r in graph.cycle_groups(spark.createDataFrame([(*p, "causes") for p in e], EDGES), ("causes",)).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 2), "d": ("c", 2), "x": ("x", 1), "y": ("y", 1)}
    assert graph.cycle_groups(spark.createDataFrame([("a", "b", "causes")], EDGES), ("causes",)).count() == 0


def mutual(pairs):
    """Groups by what each node reaches; nodes that reach no cycle are left out."""
    names = {x for p in pairs for x in p}
    reach = {u: {b for a, b in pairs if a == u} for u in names}
    while True:
        new = {u: r.union(*(reach[x] for x in r)) for u, r in reach.items()}
        if new == reach:
            break
        reach = new
    cyclic = {u for u in names if u in reach[u]}
    group = {u: {u} | {x for x in reach[u] if u in reach[x]} for u in names}
    return {(u, min(group[u]), len(group[u])) for u in names if u in cyclic or reach[u] & cyclic}


def test_cycle_groups_by_force(spark):
    """Sparse and dense random graphs, with loops on one node, tails and equal edges."""
    pairs = []
    for seed in range(16):
        rng = random.Random(seed)
        names = [f"{seed}-{i:02}" for i in range(24)]
        pairs += [(rng.choice(names), rng.choice(names)) for _ in range([14, 22, 30, 48, 90][seed % 5])]
    e = spark.createDataFrame([(*p, "causes") for p in pairs + pairs[:5]], EDGES)
    want = set().union(*(mutual([p for p in pairs if p[0].startswith(f"{s}-")]) for s in range(16)))
    assert {tuple(r) for r in graph.cycle_groups(e, ("causes",)).select("uid", "head", "n").collect()} == want


def test_long_ring(spark, monkeypatch):
    """A ring of 10,000 with a tail of 2,000 into it and one out of it, in rounds by its logarithm."""
    turns = []
    passable = graph._passable
    monkeypatch.setattr(graph, "_passable", lambda *a: turns.append(1) or passable(*a))
    ring = spark.range(10000).selectExpr("format_string('r%05d', id) src", "format_string('r%05d', (id + 1) % 10000) dst")
    tail = spark.range(2000).selectExpr("format_string('t%05d', id) src", "if(id = 1999, 'r00500', format_string('t%05d', id + 1)) dst")
    away = spark.range(2000).selectExpr("if(id = 0, 'r00700', format_string('x%05d', id)) src", "format_string('x%05d', id + 1) dst")
    got = graph.cycle_groups(ring.union(tail).union(away).withColumn("kind", F.lit("causes")), ("causes",))
    assert {tuple(r) for r in got.groupBy(F.substring("uid", 1, 1), "n").agg(F.count("*"), F.countDistinct("head")).collect()} == {("r", 10000, 10000, 1), ("t", 1, 2000, 2000)}
    assert len(turns) < 40


def test_places_and_matchers(spark):
    m = spark.createDataFrame([(1, u, "claim", i, float(i)) for i, u in enumerate("abcdef")], "scope int, uid string, kind string, status int, salience double")
    e = spark.createDataFrame([("b", "a", "causes"), ("c", "b", "causes"), ("d", "c", "sequences")], EDGES)
    placed = thread.placed(m, e)
    assert rows(placed.where("first"), "uid") == [("a",)] and rows(placed.where("last"), "uid") == [("d",)]
    schema = thread.Schema((), (("at", "first", "one"), ("target-of", "sequences", "two"), ("salience-top", "1", "three"), ("status-at-least", "4", "four"), ("band", "0/2", "five"), ("at", "middle", "six"), ("any", "", "seven")))
    assert dict(rows(thread.roles(placed, e, schema), "uid", "role")) == {"a": "one", "c": "two", "f": "three", "e": "four", "b": "five", "d": "seven"}
    seeds = lambda kinds, roots=None: rows(thread.seed(spark.createDataFrame([(1, u, k) for u, k in kinds], "scope int, uid string, kind string"), roots), "uid")
    assert seeds([("a", "claim"), ("b", "finding")]) == [("b",)] and seeds([("a", "claim"), ("b", "data")]) == [("a",), ("b",)]
    assert seeds([("a", "claim"), ("b", "data")], spark.createDataFrame([(1, "b")], "scope int, uid string")) == [("b",)]


def plain_chunks(text, budget):
    cost = lambda t: -(-len(t.encode()) // 4)
    parts = []
    for p in (p.strip() for p in text.split("\n\n")):
        if p and cost(p) <= budget:
            parts.append(p)
        elif p:
            buf = ""
            for line in p.splitlines(keepends=True):
                if buf and cost(buf + line) > budget:
                    parts.append(buf.rstrip())
                    buf = ""
                if cost(line) > budget:
                    piece = ""
                    for c in line:
                        if len(piece.encode()) >= 4 * budget:
                            parts.append(piece)
                            piece = ""
                        piece += c
                    parts.append(piece)
                else:
                    buf += line
            if buf.strip():
                parts.append(buf.rstrip())
    groups, used = [], 0
    for p in parts:
        if not groups or used + cost(p) > budget:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += cost(p)
    return ["\n\n".join(([groups[i - 1][-1]] if i else []) + g) for i, g in enumerate(groups)]


def test_chunks(spark):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("ab é日") for _ in range(rng.randint(0, 70)))
    bodies = ["\n\n".join("\n".join(line() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "é" * 300, "\n\n \n"]
    got = {}
    for r in chunk.chunks(spark.createDataFrame(list(enumerate(bodies)), "uid long, body string"), 20).orderBy("uid", "chunk").collect():
        got.setdefault(r.uid, []).append(r)
    for uid, body in enumerate(bodies):
        own = got.get(uid, [])
        assert [r.text for r in own] == plain_chunks(body or "", 20)
        for r in own:
            data = body.encode()[r.start_byte : r.end_byte].decode()
            assert "".join(data.split()) == "".join(r.text.split()) and r.overlapped == (r.chunk > 0)
    assert chunk.window(8192, 1000) == 8192 - 1024 - 4096 and chunk.window(100, 10) == 256


def test_nearest_by_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    v[7] = 0
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, [1.0, 2.0]), (301, None)], "uid long, embedding array<double>").repartition(5)
    queries = table.where("uid % 20 = 0 and uid < 300").select(F.col("uid").alias("query"), F.col("embedding").alias("vector"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for block in (4, 4096):
        got = {}
        for r in retrieve.nearest(table, queries, 5, block).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.uid, r.score))
        for q in range(0, 300, 20):
            scores = np.round(unit @ unit[q], 12)
            scores = np.floor(np.abs(scores) * 1024 + 0.5) * np.sign(scores) / 1024
            want = sorted((-s, i) for i, s in enumerate(scores) if s > 0 and i != q)[:5]
            assert got.get(q, []) == [(i, -s) for s, i in want]


def test_lines_of_a_file(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t.csv"
    with open(path, "w") as f:
        f.write("id, b\n1,x\n\n 2 , y y\n3\n,\n")
    header, lines = imports.numbered_lines(spark, path)
    units, odd = imports.units_of_lines(header, lines, "t.csv")
    assert rows(units, "row", "gist", "source") == [(1, "id 1: b x", "file:t.csv#row=1"), (2, "id 2: b y y", "file:t.csv#row=2"), (4, "id : b ", "file:t.csv#row=4")]
    assert rows(odd, "code", "row") == [("E001", 3)]
    with open(path, "w") as f:
        f.write("")
    assert imports.numbered_lines(spark, path)[0] == ""


def test_ledger_and_bundle(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/l.json"
    with open(path, "w") as f:
        f.write('{"at":1,"provider":"p","input_tokens":2,"output_tokens":3,"retries":1,"estimated":true}\nbroken\n{"at":5,"provider":"p","run":"r","input_tokens":1,"output_tokens":1,"retries":0,"estimated":false}\n')
    e = imports.ledger(spark, path)
    assert rows(imports.totals(e, "run"), "key", "calls", "estimated") == [("-", 1, True), ("r", 1, False)]
    assert rows(imports.totals(e, "provider", 2), "key", "calls", "input_tokens") == [("p", 1, 1)]
    u = spark.createDataFrame([(x,) for x in "abcde"], "uid string")
    edges = spark.createDataFrame([("a", "b", "causes"), ("b", "c", "grounds"), ("b", "b", "retracts"), ("c", "c", "retracts"), ("a", "d", "deps"), ("d", "d", "retracts"), ("a", "gone", "deps")], EDGES)
    roots = spark.createDataFrame([("a",)], "uid string")
    assert rows(imports.bundle(u, edges, roots), "uid") == [("a",), ("d",)]  # d is still rested on; b isn't, nor then is c
    assert rows(imports.bundle(u, edges, roots, True), "uid") == [("a",), ("b",), ("c",), ("d",)]


def test_traces(spark):
    e = spark.createDataFrame([("a", "b", "grounds"), ("a", "b", "deps"), ("a", "c", "deps"), ("b", "d", "deps"), ("c", "d", "grounds"), ("a", "p", "supersedes"), ("d", "a", "deps")], EDGES)
    who = spark.createDataFrame([("a", "m", 2, "p"), ("a", "l", 1, None), ("d", "m", 0, "q")], "uid string, agent string, hop int, parent string")
    roots = spark.createDataFrame([("a",)], "uid string")
    assert rows(graph.trace(e, roots, who), "uid", "level", "via", "agents", "hop") == [("a", 0, "root", "l,m", 1), ("b", 1, "grounds", None, None), ("c", 1, "deps", None, None), ("d", 2, "deps", "m", 0)]
    assert rows(graph.trace(e, roots, who, "parents"), "uid", "via") == [("a", "root"), ("p", "parent")]
    assert rows(graph.trace(e, roots, who, "both", depth=1), "uid", "via") == [("a", "root"), ("b", "grounds"), ("c", "deps"), ("p", "parent")]


def test_monotone(spark):
    u = spark.createDataFrame([("a", 5, "s"), ("b", 4, None), ("c", 1, None), ("d", 3, None), ("e", 5, None)], "uid string, status int, source string")
    e = spark.createDataFrame([("a", "b", "grounds"), ("b", "c", "grounds"), ("d", "e", "grounds"), ("e", "gone", "grounds")], EDGES)
    assert rows(merge.monotone(u, e), "uid", "was", "status", "ground") == [("a", 5, 1, "b"), ("b", 4, 1, "c")]


def lowered(units, grounds):
    """By rounds over all units until nothing falls; then the weakest ground of what fell."""
    now = {u: s for u, s, _ in units}
    while True:
        new = dict(now)
        for u, s, source in units:
            low = min((now[g] for x, g in grounds if x == u and g in now), default=9)
            if now[u] > low:
                carried = 3 if low >= 4 and not source else low
                new[u] = min(now[u], max(1, carried))
        if new == now:
            return sorted((u, s, now[u], min((now[g], g) for x, g in grounds if x == u and g in now)[1]) for u, s, _ in units if now[u] < s)
        now = new


def test_monotone_by_force(spark):
    """Random stores with cycles, self-loops, absent grounds, units without source, and the unfounded."""
    cases = []
    for seed in range(12):
        rng = random.Random(seed)
        names = [f"{seed}-{i:02}" for i in range(25)]
        units = [(n, rng.choice([0, 1, 2, 3, 4, 4, 5, 5, 5, 5] if seed % 2 else [4, 5, 5, 5, 5]), rng.choice(["s", None])) for n in names]
        grounds = {(rng.choice(names), rng.choice([*names, "gone"])) for _ in range(rng.choice([15, 30, 50]))}
        cases.append((units, grounds))
    u = spark.createDataFrame([r for units, _ in cases for r in units], "uid string, status int, source string")
    e = spark.createDataFrame([(*p, "grounds") for _, grounds in cases for p in grounds], EDGES)
    want = sorted(r for units, grounds in cases for r in lowered(units, grounds))
    assert len({r[2] for r in want}) == 4
    assert rows(merge.monotone(u, e), "uid", "was", "status", "ground") == want
    assert merge.monotone(u.limit(0), e.limit(0)).count() == 0


def test_views_register(spark):
    """The same view whatever order stores come in, an absorbed store changes nothing when it comes again, and null fields are least."""
    schema = "view string, roots array<string>, profile string"
    a = spark.createDataFrame([("v", ["a", "b"], "fine"), ("w", ["c"], None)], schema)
    b = spark.createDataFrame([("v", ["a", "c"], "coarse"), ("w", ["c"], "default"), ("x", [], "fine")], schema)
    want = [("v", ["a", "c"], "coarse"), ("w", ["c"], "default"), ("x", [], "fine")]
    for stores in ((a, b), (b, a), (b, a, b, a)):
        assert rows(merge.views_register(*stores), "view", "roots", "profile") == want
    assert rows(merge.views_register(a), "view", "roots", "profile") == rows(a, "view", "roots", "profile")


def test_traces_meet_attestations_without_broadcast(spark):
    e = spark.createDataFrame([("a", "b", "grounds"), ("b", "c", "deps"), ("c", "d", "grounds")], "src string, dst string, kind string")
    who = spark.createDataFrame([("a", "m", 2, None), ("a", "l", 1, None), ("c", "k", 3, "p")], "uid string, agent string, hop int, parent string")
    roots = spark.createDataFrame([("a",)], "uid string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = {("a", 0, "root", "l,m", 1), ("b", 1, "grounds", None, None), ("c", 2, "deps", "k", 3), ("d", 3, "grounds", None, None)}
        assert {tuple(r) for r in graph.trace(e, roots, who).collect()} == want
        assert {tuple(r) for r in graph.trace(e, roots, who, "both").collect()} == want | {("p", 3, "parent", None, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_membership_follows_every_kind(spark, tmp_path):
    from evidra import catalog
    from evidra.sources import store as T

    given = "/root/testdata/sf0.001"
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{given}/{name}.parquet")
    # most customers are gone, so their orders' lines are reached by warrants of parts alone
    spark.read.parquet(f"{given}/customer.parquet").where("c_custkey % 10 = 1").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    d = str(tmp_path)
    on = {}
    for e in T.edges(spark, d).collect():
        on.setdefault(e.src, []).append(e.dst)
    there = {r.uid: r.kind for r in T.units(spark, d).select("uid", "kind").collect()}
    seen = {u for u, kind in there.items() if kind == "claim"}
    waiting = list(seen)
    while waiting:
        new = set(on.get(waiting.pop(), ())) - seen
        seen |= new
        waiting.extend(new)
    assert sorted(r.uid for r in catalog.queries()["membership"](spark, d).collect()) == sorted(seen & there.keys())
