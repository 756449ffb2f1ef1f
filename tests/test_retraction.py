"""Retraction by frontiers against plain fixpoints on random stores."""

import random

import pytest

from evidra.operators import merge


def plain(units, grounds, retracted):
    """uid -> reason of what falls."""
    own = {u: {g for a, g in grounds if a == u and g in units} for u in units}
    fallen = {u: "retracted" for u in retracted if u in units}
    while new := [u for u in units if u not in fallen and own[u] and own[u] <= set(fallen)]:
        fallen |= dict.fromkeys(new, "orphaned")
    return fallen


@pytest.mark.parametrize("seed", [1, 2])
def test_effective_status_and_plan(spark, seed):
    rng = random.Random(seed)
    names = [f"u{i}" for i in range(40)]
    grounds = {(f"u{i}", f"u{rng.randint(0, i - 1)}") for i in range(1, 40) for _ in range(rng.randint(0, 2))} | {("u3", "u3"), ("u4", "absent"), ("u30", "u31"), ("u31", "u30")}
    retracted, targets = {"u0", "u7", "gone"}, ["u1", "u2", "u7", "u12", "gone"]
    units = spark.createDataFrame([(u, 3) for u in names], "uid string, status int")
    edges = spark.createDataFrame([(a, b, "grounds") for a, b in grounds] + [("x", u, "retracts") for u in retracted], "src string, dst string, kind string")
    want = plain(names, grounds, retracted)
    got = {r.uid: (r.effective, r.reason) for r in merge.effective_status(units, edges).collect()}
    assert got == {u: (0, want[u]) if u in want else (3, "") for u in names}
    after = plain(names, grounds, retracted | set(targets))
    plan = {r.uid: r.reason for r in merge.retraction_plan(units, edges, spark.createDataFrame([(t,) for t in targets + targets[:1]], "uid string")).collect()}
    assert set(plan) == set(after) - set(want) and all((plan[u] == "retracted") == (u in targets) for u in plan)


def test_chain_falls_link_by_link(spark):
    n = 12
    units = spark.createDataFrame([(f"u{i:02}", 3) for i in range(n)], "uid string, status int")
    edges = spark.createDataFrame([(f"u{i:02}", f"u{i - 1:02}", "grounds") for i in range(1, n)] + [("r", "u00", "retracts")], "src string, dst string, kind string")
    assert {r.reason for r in merge.effective_status(units, edges).where("uid <> 'u00'").collect()} == {"orphaned"}
