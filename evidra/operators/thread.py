"""Threads: a role for each unit by the first rule that matches, the best of each role, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.store import dealt, kin, written
from . import graph
from .merge import top_by


@dataclass(frozen=True)
class Schema:
    """roles: name, least, most and weight; rules: (what, value, role), the first that matches counts."""

    roles: tuple[tuple[str, int, int, float], ...]
    rules: tuple[tuple[str, str, str], ...]


# Fixed values.
SCHEMAS = {
    "analysis": Schema(
        (("context", 0, 2, 0.4), ("tension", 1, 2, 0.8), ("approach", 0, 2, 0.5), ("finding", 1, 3, 1.0), ("rebuttal", 0, 3, 0.9), ("implication", 0, 2, 0.6), ("next", 0, 1, 0.3)),
        (("source-of", "rebuts", "rebuttal"), ("kind", "definition", "context"), ("kind", "constraint", "context"), ("kind", "question", "tension"), ("kind", "observation", "tension"), ("kind", "data", "tension"), ("kind", "hypothesis", "approach"), ("kind", "procedure", "approach"), ("kind", "finding", "finding"), ("kind", "decision", "next"), ("kind", "claim", "implication"), ("any", "", "context")),
    ),
    "narrative": Schema(
        (("setup", 1, 1, 0.6), ("complication", 0, 2, 0.8), ("turn", 0, 2, 1.0), ("resolution", 0, 2, 0.9), ("coda", 0, 1, 0.5)),
        (("at", "first", "setup"), ("at", "last", "coda"), ("band", "1/5", "complication"), ("band", "2/5", "turn"), ("band", "3/5", "resolution"), ("any", "", "complication")),
    ),
    "brief": Schema(
        (("bottom-line", 1, 1, 1.0), ("support", 1, 3, 0.7), ("risk", 0, 2, 0.8), ("ask", 0, 1, 0.5)),
        (("source-of", "rebuts", "risk"), ("kind", "finding", "bottom-line"), ("kind", "decision", "ask"), ("kind", "question", "ask"), ("kind", "evidence", "support"), ("kind", "observation", "support"), ("kind", "data", "support"), ("kind", "hypothesis", "risk"), ("any", "", "support")),
    ),
    "qa": Schema(
        (("question", 1, 1, 0.9), ("evidence", 0, 3, 0.6), ("answer", 1, 2, 1.0), ("caveat", 0, 2, 0.7)),
        (("source-of", "rebuts", "caveat"), ("kind", "question", "question"), ("source-of", "answers", "answer"), ("kind", "finding", "answer"), ("kind", "evidence", "evidence"), ("kind", "observation", "evidence"), ("kind", "data", "evidence"), ("kind", "hypothesis", "caveat"), ("any", "", "evidence")),
    ),
    "plan": Schema(
        (("goal", 1, 1, 1.0), ("constraint", 0, 3, 0.6), ("step", 1, 5, 0.8), ("decision", 0, 2, 0.7), ("risk", 0, 2, 0.7)),
        (("source-of", "rebuts", "risk"), ("kind", "constraint", "constraint"), ("kind", "procedure", "step"), ("kind", "decision", "decision"), ("kind", "finding", "goal"), ("kind", "question", "goal"), ("kind", "hypothesis", "risk"), ("any", "", "step")),
    ),
}


def seed(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(scope, uid): what a scope's salience starts from: its questions and findings, else its views' roots(scope, uid), else all of it."""
    way = F.when(F.col("kind").isin("question", "finding"), 0).otherwise(2)
    every = members.select("scope", "uid", way.alias("way"))
    if roots is not None:
        every = every.union(roots.select("scope", "uid", F.lit(1)))
    best = F.min("way").over(Window.partitionBy("scope"))
    return every.withColumn("best", best).where("way = best or best = 2").select("scope", "uid").distinct()


def placed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with index, pos, n, first and last: each unit's place along the store's ordering edges.

    All ordering edges count, wherever their ends are. index is the place in the order
    of the whole store (graph.store_order); pos ranks a scope's units by index, then
    name, and n is how many there are. first has no ordering edge out, last none in; a
    unit without any is neither.
    """
    order = graph.store_order(edges, members).select("uid", "index")
    pairs = graph.of_kinds(edges, graph.ORDERING)
    out = pairs.select(F.col("src").alias("uid")).distinct().withColumn("is_out", F.lit(True))
    into = pairs.select(F.col("dst").alias("uid")).distinct().withColumn("is_in", F.lit(True))
    rows = members.join(order, "uid").join(out, "uid", "left").join(into, "uid", "left")
    w = Window.partitionBy("scope")
    chain = F.col("is_out").isNotNull() | F.col("is_in").isNotNull()
    pos = F.row_number().over(w.orderBy("index", "uid")) - 1
    return rows.select(*members.columns, "index", pos.alias("pos"), F.count("*").over(w).alias("n"), (chain & F.col("is_out").isNull()).alias("first"), (chain & F.col("is_in").isNull()).alias("last"))


def roles(members: DataFrame, edges: DataFrame, schema: str | Schema) -> DataFrame:
    """members with role, by the first rule that fits; a unit that none fits has null.

    members(scope, uid, kind, salience) has status for rules on it and the columns
    of placed() for rules on places.
    """
    rules = (SCHEMAS[schema] if isinstance(schema, str) else schema).rules
    out = members
    for what, kind in sorted({(w, v) for w, v, _ in rules if w in ("source-of", "target-of")}):
        end = "src" if what == "source-of" else "dst"
        out = out.join(edges.where(F.col("kind") == kind).select(F.col(end).alias("uid")).distinct().withColumn(f"{what}-{kind}", F.lit(True)), "uid", "left")
    if any(w == "salience-top" for w, *_ in rules):
        out = out.withColumn("evidra_rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("salience"), "uid")))
    role = F.lit(None).cast("string")
    for what, value, name in reversed(rules):
        if what == "any":
            fits = F.lit(True)
        elif what == "kind":
            fits = F.col("kind") == value
        elif what in ("source-of", "target-of"):
            fits = F.col(f"{what}-{value}").isNotNull()
        elif what == "status-at-least":
            fits = F.col("status") >= int(value)
        elif what == "salience-top":
            fits = F.col("evidra_rank") <= int(value)
        elif what == "at":
            fits = {"first": F.col("first"), "last": F.col("last"), "middle": ~F.col("first") & ~F.col("last")}[value]
        else:
            i, n = map(int, value.split("/"))
            fits = F.floor(F.col("pos") * n / F.col("n")) == i
        role = F.when(fits, F.lit(name)).otherwise(role)
    return out.withColumn("role", role).select(*members.columns, "role")


def selected(assigned: DataFrame, schema: str) -> DataFrame:
    """(scope, role, uid, rank): of each role its most salient units, as many as it takes; ties by uid."""
    most = F.coalesce(*[F.when(F.col("role") == name, F.lit(m)) for name, _, m, _ in SCHEMAS[schema].roles], F.lit(0))
    top = max(m for _, _, m, _ in SCHEMAS[schema].roles)
    return top_by(assigned, top, ["scope", "role"], F.desc("salience"), "uid").where(F.col("rank") <= most)


def ordered(chosen: DataFrame, schema: str) -> DataFrame:
    """(scope, pos, role, uid): by the role's place, the unit's index in the ordering chain, salience, then uid."""
    place = F.coalesce(*[F.when(F.col("role") == name, F.lit(i)) for i, (name, *_) in enumerate(SCHEMAS[schema].roles)])
    chain = [F.col("index")] if "index" in chosen.columns else []
    return chosen.withColumn("pos", F.row_number().over(Window.partitionBy("scope").orderBy(place, *chain, F.desc("salience"), "uid"))).select("scope", "pos", "role", "uid")


def unfilled(chosen: DataFrame, scopes: DataFrame, schema: str) -> DataFrame:
    """(scope, role, missing): roles with fewer units than they need at least."""
    spark = chosen.sparkSession
    least = spark.createDataFrame([(n, m) for n, m, _, _ in SCHEMAS[schema].roles if m], "role string, least int")
    have = chosen.groupBy("scope", "role").agg(F.count("*").alias("n"))
    return scopes.select("scope").distinct().join(F.broadcast(least), F.lit(True)).join(have, ["scope", "role"], "left").where(F.coalesce("n", F.lit(0)) < F.col("least")).select("scope", "role", (F.col("least") - F.coalesce("n", F.lit(0))).alias("missing"))


def missing_deps(steps: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(scope, uid, missing): present deps of a step that no step of its scope is (rule L)."""
    deps = edges.where("kind = 'deps'").select(F.col("src").alias("uid"), F.col("dst").alias("missing")).distinct().join(units.select(F.col("uid").alias("missing")), "missing", "left_semi")
    return steps.select("scope", "uid").distinct().join(deps, "uid").join(steps.select("scope", F.col("uid").alias("missing")), ["scope", "missing"], "left_anti").select("scope", "uid", "missing")


def repaired(steps: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(scope, pos, role, uid, needed_by): every dep that is missing, and theirs, right before what first needs it.

    A missing dep takes the role of the step it is inserted for; deps of one unit
    come in the order of their names, each after its own. Deps that no unit has are
    passed over. needed_by is null for the steps that were there.

    Each round follows the deps of what the last one inserted. A place is the list of
    names from the step down; of several ways to a unit the one whose place comes
    first counts, and what hangs on it is followed anew when an earlier one is found.
    """
    last = F.lit("\U0010ffff")  # after any name: what a unit needs comes before it
    deps = edges.where("kind = 'deps'").select("src", "dst")
    there_are = kin(units.select(F.col("uid").alias("dst")), deps, "dst", "dst")
    deps = dealt(deps.join(there_are, "dst", "left_semi").repartition("src").distinct(), "src", spread=False).withColumnRenamed("src", "uid")
    there = written(steps.select("scope", "uid").distinct())
    place = lambda df: F.struct(F.col("pos"), F.concat("path", F.array(last)))
    best = None
    frontier = steps.select("scope", "pos", "role", "uid", F.array().cast("array<string>").alias("path"))
    while True:
        found = frontier.join(deps, "uid").where(~F.array_contains("path", F.col("dst")))
        found = found.select("scope", "pos", "role", F.col("dst").alias("uid"), F.concat("path", F.array("dst")).alias("path"), F.col("uid").alias("needed_by")).join(there, ["scope", "uid"], "left_anti")
        every = found.withColumn("new", F.lit(True)) if best is None else found.withColumn("new", F.lit(True)).unionByName(best.withColumn("new", F.lit(False)))
        first = every.withColumn("at", place(every)).groupBy("scope", "uid").agg(F.min(F.struct("at", "new", "pos", "role", "path", "needed_by")).alias("x"))
        first = written(first.select("scope", "uid", *[F.col(f"x.{c}").alias(c) for c in ("new", "pos", "role", "path", "needed_by")]))
        frontier, best = first.where("new").select("scope", "pos", "role", "uid", "path"), first.drop("new")
        if frontier.isEmpty():
            break
    own = steps.select("scope", "uid", "pos", "role", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("needed_by"))
    rows = own.unionByName(best.select(*own.columns))
    order = Window.partitionBy("scope").orderBy("pos", F.concat("path", F.array(last)))
    return rows.withColumn("pos", F.row_number().over(order)).select("scope", "pos", "role", "uid", "needed_by")


def foreign_roles(steps: DataFrame, schema_of: DataFrame) -> DataFrame:
    """(thread, role): roles of a thread that its schema(thread, schema) does not have."""
    spark = steps.sparkSession
    allowed = spark.createDataFrame([(s, r[0]) for s, d in SCHEMAS.items() for r in d.roles], "schema string, role string")
    return steps.select("thread", "role").distinct().join(schema_of, "thread").join(F.broadcast(allowed), ["schema", "role"], "left_anti").select("thread", "role")  # allowed: a few rows of a fixed table


def role_weights(steps: DataFrame, schema: str) -> DataFrame:
    """(scope, uid, weight): the largest weight of a unit's roles, quantised; roles of other schemas weigh nothing."""
    weight = F.coalesce(*[F.when(F.col("role") == name, F.lit(w)) for name, _, _, w in SCHEMAS[schema].roles], F.lit(0.0))
    return steps.groupBy("scope", "uid").agg(F.max(S.quantise(weight)).alias("weight"))


def salience_seed(steps: DataFrame) -> DataFrame:
    """(scope, uid): a thread's questions, findings and bottom lines, else all its units."""
    focal = F.col("role").isin("question", "finding", "bottom-line")
    any_ = F.max(focal.cast("int")).over(Window.partitionBy("scope")) == 1
    return steps.select("scope", "uid", focal.alias("focal"), any_.alias("any")).where(F.col("focal") | ~F.col("any")).select("scope", "uid").distinct()


def gists(steps: DataFrame, texts: DataFrame, schema: str, budget: int = 30) -> DataFrame:
    """(scope, gist): the gists of the first steps of the two heaviest roles, joined, cut at a word to the budget.

    A first step whose unit is absent says nothing for its role. Where neither says
    anything it is the first step's gist, or the empty text if that is absent too.
    texts has uid and gist.
    """
    heavy = sorted(SCHEMAS[schema].roles, key=lambda r: -r[3])[:2]
    rank = F.coalesce(*[F.when(F.col("role") == r[0], F.lit(i)) for i, r in enumerate(heavy)], F.lit(2))
    said = steps.join(texts.select("uid", F.trim("gist").alias("gist")), "uid", "left").withColumn("rank", rank)
    first = said.groupBy("scope").agg(*[F.min(F.when(F.col("rank") == i, F.struct("pos", "gist")))["gist"].alias(f"g{i}") for i in (0, 1)], F.min(F.struct("pos", "gist"))["gist"].alias("any"))
    joined = first.select("scope", F.coalesce(F.when(F.col("g0").isNotNull() | F.col("g1").isNotNull(), F.concat_ws("; ", "g0", "g1")), F.col("any"), F.lit("")).alias("gist"))
    return joined.select("scope", S.cut_to(F.col("gist"), budget).alias("gist"))


@dataclass(frozen=True)
class Derived:
    """steps(scope, pos, role, uid, needed_by): needed_by is the unit that an inserted step was put before, else null;
    unfilled(scope, role, missing): roles without the units they need; unselected(scope, n): members that are no step."""

    steps: DataFrame
    unfilled: DataFrame
    unselected: DataFrame


def derive(members: DataFrame, edges: DataFrame, units: DataFrame, schema: str) -> Derived:
    """A thread of each scope: roles, the best of each, in order, with what they depend on before them.

    members(scope, uid, kind, salience, status) are a scope's units; edges and units
    are the store's. Members that no unit has take no part.
    """
    here = written(placed(members.join(units.select("uid"), "uid", "left_semi").select(*members.columns), edges))
    chosen = written(selected(roles(here, edges, schema), schema))
    steps = written(repaired(ordered(chosen, schema), edges, units))
    count = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    left = count(here, "all").join(count(steps, "taken"), "scope", "left").select("scope", F.greatest(F.col("all") - F.coalesce("taken", F.lit(0)), F.lit(0)).alias("n"))
    return Derived(steps, unfilled(chosen, here, schema), left)


