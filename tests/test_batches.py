"""Answers in JSON, sound and broken, against what a plain reading gives."""

import json

from evidra.sources import batches

GOOD = {"type": "claim", "gist": "g", "status": "speculative"}
unit = lambda **more: GOOD | more


def converted(spark, answers):
    made = batches.convert(spark.createDataFrame([(b, t) for b, t in answers.items()], "batch string, text string"))
    units = {(r.batch, r.i): r for r in made.units.collect()}
    edges = {(r.batch, r.i, r.src, r.dst, r.kind, r.weight) for r in made.edges.collect()}
    return units, edges, {(r.batch, r.part, r.i, r.code, r.message) for r in made.diagnostics.collect()}


def test_answers(spark):
    fenced = "```json\n" + json.dumps({"units": [unit(gist="in a fence")]}) + "\n```"
    units, edges, said = converted(spark, {"f": fenced, "p": "Here it is: " + json.dumps(unit(body="alone")) + " done.", "n": None, "e": "", "x": "no object", "b": '{"units": [', "u": "{}", "c": '{"units": [1, "a", null, []]} '})
    assert {k: (r.gist, r.body, r.status, r.uid) for k, r in units.items()} == {("f", 0): ("in a fence", None, 1, "j:f-0"), ("p", 0): ("g", "alone", 1, "j:p-0")}
    assert not edges and said == {("n", "answer", None, "E001", "no JSON object"), ("e", "answer", None, "E001", "no JSON object"), ("x", "answer", None, "E001", "no JSON object"), ("b", "answer", None, "E001", "no JSON object"), ("u", "answer", None, "E001", "no units, and not a single unit")} | {("c", "unit", i, "E001", "not an object") for i in range(4)}


def test_fields(spark):
    broken = [
        (unit(type="thought"), "E001", "thought is no type"), ({"gist": "g", "status": "speculative"}, "E001", "missing type"), (unit(type=5), "E001", "missing type"),
        (unit(gist=" "), "E001", "missing or empty gist"), (unit(status="unfounded"), "E034", "unfounded can't be authored"), (unit(status="sure"), "E001", "sure is no status"),
        (unit(label="a b"), "E001", "a b is no label"), (unit(deps="a"), "E001", "deps is no array"), (unit(grounds=[1]), "E001", "an entry of grounds is no string"), (unit(mood="good"), "E001", "unknown field mood"),
        (unit(source="file:x"), "E001", "source is no object"), (unit(source={"kind": "dream", "ref": "x"}), "E001", "dream is no kind of source"), (unit(source={"kind": "file"}), "E001", "source has no ref"),
        (unit(source={"kind": "file", "ref": "x", "captured": "2024-02-30"}), "E001", "captured is no date"), (unit(detail="d"), "E001", "detail without body"), (unit(status="cited"), "E001", "cited needs a source"),
        (unit(status="derived"), "E001", "derived needs grounds"), (unit(deps=["nobody"]), "E060", "deps names unknown nobody"),
    ]
    sound = [unit(status="measured", source={"kind": "metric", "ref": "m", "captured": "2024-02-29"}, quote="q"), unit(status="inferred", grounds=["x:1"], payload={"a": 1})]
    units, edges, said = converted(spark, {"b": json.dumps({"units": [u for u, *_ in broken] + sound})})
    n = len(broken)
    assert said == {("b", "unit", i, code, message) for i, (_, code, message) in enumerate(broken)}
    assert {k: (r.status, r.source, r.quote) for k, r in units.items()} == {("b", n): (5, "metric:m", "q"), ("b", n + 1): (2, None, None)}
    assert edges == {("b", None, f"j:b-{n + 1}", "x:1", "grounds", None)}


def test_references_fall_together(spark):
    """A unit that names one that fell falls too, and so on; names go to the last unit before with the label."""
    own = [unit(label="a"), unit(label="bad", gist=""), unit(label="c", deps=["bad", "a"]), unit(label="d", deps=["c"]), unit(label="e", deps=["later"]), unit(label="a"), unit(label="later", grounds=["a", "a"]), unit(deps=["later"])]
    relations = [{"kind": "rebuts", "from": "a", "to": "later", "weight": 0.5}, {"kind": "causes", "from": "later", "to": "x:9", "weight": 7}, {"kind": "supersedes", "from": "a", "to": "later"}, {"kind": "causes", "from": "d", "to": "a"}, {"kind": "causes", "from": "a", "to": "a"}, {"from": "a", "to": 3}, 8]
    units, edges, said = converted(spark, {"r": json.dumps({"units": own, "relations": relations}), "other": json.dumps({"units": [unit(deps=["a"])]})})
    assert set(units) == {("r", i) for i in (0, 5, 6, 7)}
    assert edges == {("r", None, "j:r-6", "j:r-5", "grounds", None), ("r", None, "j:r-7", "j:r-6", "deps", None), ("r", 0, "j:r-5", "j:r-6", "rebuts", 0.5), ("r", 1, "j:r-6", "x:9", "causes", None)}
    unknown = lambda i, name, kind="deps", b="r": (b, "unit", i, "E060", f"{kind} names unknown {name}")
    assert said == {("r", "unit", 1, "E001", "missing or empty gist"), unknown(2, "bad"), unknown(3, "c"), unknown(4, "later"), unknown(0, "a", b="other"), ("r", "relation", 2, "E001", "supersedes is no kind to author"), ("r", "relation", 3, "E060", "from names d, which is not in this batch"), ("r", "relation", 4, "E001", "an edge from a unit to itself"), ("r", "relation", 5, "E001", "kind is required"), ("r", "relation", 5, "E001", "to is required"), ("r", "relation", 6, "E001", "not an object")}


def test_nothing(spark):
    units, edges, said = converted(spark, {"z": '{"units": [], "relations": []}'})
    assert not units and not edges and not said
