"""References by label against a recursive walk of each document."""

import random

from evidra.sources import imports

UNITS, REFS = "doc int, pos int, label string, uid string", "doc int, pos int, kind string, at int, label string, uid string"


def walked(units, refs):
    """Edges and diagnostics by following each document's units in turn."""
    edges, said = set(), []
    for doc in {u[0] for u in units}:
        own = {u[1]: u for u in units if u[0] == doc}
        last = {}
        for pos in sorted(own):
            if own[pos][2] is not None:
                last[own[pos][2]] = pos
        state = {}

        def follow(pos):
            state[pos] = "open"
            for _, p, kind, at, label, uid in sorted((r for r in refs if r[0] == doc and r[1] == pos), key=lambda r: (r[2], r[3])):
                if label is None:
                    edges.add((own[p][3], uid, kind))
                elif label not in last:
                    said.append(("E060", doc, p, kind, at, label))
                elif state.get(last[label]) == "open":
                    said.append(("E061", doc, p, kind, at, label))
                else:
                    if last[label] not in state:
                        follow(last[label])
                    edges.add((own[p][3], own[last[label]][3], kind))
            state[pos] = "done"

        for pos in sorted(own):
            if pos not in state:
                follow(pos)
    return edges, sorted(said)


def test_by_force(spark):
    """Random documents: labels borne twice or by none, units without, loops on one unit, several rounds in a document, documents without any."""
    rng = random.Random(3)
    units, refs = [], []
    for doc in range(20):
        n = rng.choice([1, 3, 8, 12])
        units += [(doc, p, rng.choice([f"a/{p}", f"a/{p}", f"a/{max(0, p - 1)}", None]), f"u{doc}-{p}") for p in range(n)]
        for p in range(n):
            for kind in ("deps", "grounds"):
                refs += [(doc, p, kind, i, *((f"a/{rng.randrange(n + 1)}", None) if rng.random() < 0.8 else (None, "u0-0"))) for i in range(rng.choice([0, 0, 1, 2]))]
    edges, said = imports.resolved(spark.createDataFrame(units, UNITS), spark.createDataFrame(refs, REFS))
    want = walked(units, refs)
    assert {r[0] for r in want[1]} == {"E060", "E061"}
    assert {tuple(r) for r in edges.select("src", "dst", "kind").collect()} == want[0]
    assert sorted(tuple(r) for r in said.select("code", "doc", "pos", "kind", "at", "label").collect()) == want[1]


def test_no_references(spark):
    edges, said = imports.resolved(spark.createDataFrame([(1, 0, "a/b", "u")], UNITS), spark.createDataFrame([], REFS))
    assert edges.count() == said.count() == 0
