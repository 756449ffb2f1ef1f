import random

import pytest

from evidra.llm import common, components


@pytest.mark.parametrize("order", ["random", "two_runs"])
def test_rounds_of_components_grow_with_the_logarithm(spark, order, monkeypatch):
    """A path of n nodes, named in several orders: one component, in few rounds."""
    n = 256
    names = list(range(n))
    if order == "random":
        random.Random(3).shuffle(names)
    if order == "two_runs":  # the least name of each half is in its middle
        names = [abs(i - n // 4) * 2 for i in range(n // 2)] + [abs(i - n // 4) * 2 + 1 for i in range(n // 2)]
        names = [sorted(set(names)).index(x) * n + i for i, x in enumerate(names)]
    rounds = []
    original = components.remove
    monkeypatch.setattr(components, "remove", lambda df: rounds.append(1) or original(df))
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = components.components(links).collect()
    assert {r.label for r in got} == {min(names)} and {r.node for r in got} == set(names)
    assert (len(rounds) - 1) / 2 <= 2 * n.bit_length()


def test_no_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId, getCheckpointDir = "spark://host:7077", "app", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    few, wide = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([(1, "x" * 1000)], "k long, t string")
    plan = lambda right, **size: common.small_join(left, right, ["k"], **size).hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    assert common.measured(few)[0] == 1 and common.measured(wide)[1] > 1000
    assert "broadcast" in plan(few) and "broadcast" not in plan(few, size=(common.BROADCAST_ROWS + 1, 0)) and "broadcast" not in plan(few, size=(1, common.BROADCAST_BYTES + 1))
