"""Union of stores, registers, contentions, retraction."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.store import coded, dealt, kin, sifted, written
from . import graph


def merged(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; of several with one key the largest stays, so order of merging doesn't matter."""
    both = a.unionByName(b)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max(F.struct(*rest)).alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def last_writer(rows: DataFrame, key: list[str], clock: list[str]) -> DataFrame:
    """The row of each key with the latest clock; the largest of equal ones."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*clock, *[c for c in rest if c not in clock])).alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def relations(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, copies): each relation once."""
    return edges.groupBy("kind", "src", "dst").agg(F.count("*").alias("copies"))


def relations_union(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, weight, note, agents, hop): each relation once, whatever order stores came in.

    edges has weight, note, agent and hop beside the key. Of several weights and
    notes the largest pair stays, attesting agents are united, hop is the earliest.
    """
    return edges.groupBy("kind", "src", "dst").agg(
        F.max(F.struct("weight", "note")).alias("w"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"), F.min("hop").alias("hop")
    ).select("kind", "src", "dst", "w.weight", "w.note", "agents", "hop")


def added(store: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """One row: added and duplicate, how many distinct keys of other are new to store and how many are there."""
    keys = other.select(*key).distinct().join(store.select(*key).distinct().withColumn("there", F.lit(1)), key, "left")
    return keys.agg(F.count(F.when(F.col("there").isNull(), 1)).alias("added"), F.count("there").alias("duplicate"))


def attached(units: DataFrame, attestations: DataFrame) -> DataFrame:
    """(uid, n, late): attestations of each present unit, however late they came; those of absent units wait in their table."""
    return units.select("uid").join(attestations, "uid").groupBy("uid").agg(F.count("*").alias("n"), F.max("hop").alias("last_hop"))


def views_union(views: DataFrame) -> DataFrame:
    """(view, roots, threads, requires): all views of a name as one, each list sorted and distinct."""
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("roots", "threads", "requires")]
    return views.groupBy("view").agg(*lists)


def views_register(*stores: DataFrame) -> DataFrame:
    """views(view, ...) of several stores as one register: a view's largest row stays as it is, in whatever order stores come."""
    return functools.reduce(lambda a, b: merged(a, b, ["view"]), stores[1:], merged(stores[0], stores[0].limit(0), ["view"]))


def digest(rows: DataFrame) -> DataFrame:
    """One row: n and an order-free digest, the sum of 56 bits of each row's SHA-256."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), 256), 1, 14), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(one).cast("string").alias("digest"))


def contention_id(kind: str, over: Column, positions: Column) -> Column:
    """The same for the same disagreement, whoever finds it: k/c and 23 digits of a hash of kind, unit and sorted positions."""
    return F.concat(F.lit("k/c"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), over, positions), 256), 1, 23))


def forks(edges: DataFrame) -> DataFrame:
    """(over, positions, n): units with several successors of which no chain of direct edges orders all.

    Only direct edges whose both ends succeed one unit are joined, so a unit of many
    successors costs its successors and those edges, not all pairs.
    """
    up = written(edges.where("kind = 'supersedes'").select(F.col("src").alias("by"), F.col("dst").alias("over")).where("by <> over").distinct())
    many = up.groupBy("over").agg(F.count("*").alias("n")).where("n > 1")
    heads = up.join(many, "over")
    # an edge a -> b where a and b both succeed one unit: b is itself a superseded head
    direct = heads.select("over", F.col("by").alias("b")).join(up.select(F.col("by").alias("a"), F.col("over").alias("b")), "b")
    ordered = direct.join(up.select("over", F.col("by").alias("a")), ["over", "a"], "left_semi").groupBy("over").agg(F.count("*").alias("direct"))
    open_ = many.join(ordered, "over", "left").where(F.coalesce("direct", F.lit(0)) < F.col("n") * (F.col("n") - 1) / 2)
    return up.join(open_.select("over", "n"), "over").groupBy("over", "n").agg(F.concat_ws(",", F.array_sort(F.collect_list("by"))).alias("positions"))


def contentions(edges: DataFrame, steps: DataFrame, labels: DataFrame, policy: str = "contend", cap: int | None = None) -> DataFrame:
    """(id, kind, over, positions, flood): forks, live rebuttals and label collisions, each once.

    A policy but `contend` leaves forks out. flood marks all rows if there are more than cap.
    """
    named = lambda df, kind: df.select(contention_id(kind, F.col("over"), F.col("positions")).alias("id"), F.lit(kind).alias("kind"), "over", "positions")
    found = named(live_rebuttals(edges, steps).select(F.col("rebutted").alias("over"), F.col("rebutter").alias("positions")), "rebuttal")
    found = found.union(named(labels.groupBy("label").agg(F.min("uid").alias("over"), F.concat_ws(",", F.array_sort(F.collect_set("uid"))).alias("positions"), F.countDistinct("uid").alias("n")).where("n > 1"), "label"))
    if policy == "contend":
        found = found.union(named(forks(edges).select("over", "positions"), "fork"))
    found = written(found.dropDuplicates(["id"]))
    return found.withColumn("flood", F.lit(cap is not None and found.count() > cap))


def latest(edges: DataFrame, clocks: DataFrame) -> DataFrame:
    """(over, by): the successor of each unit with the latest clock(uid, wall, counter, agent), then the largest name."""
    up = edges.where("kind = 'supersedes' and src <> dst").select(F.col("dst").alias("over"), F.col("src").alias("by")).distinct()
    return up.join(clocks.select(F.col("uid").alias("by"), "wall", "counter", "agent"), "by", "left").groupBy("over").agg(F.max(F.struct("wall", "counter", "agent", "by")).alias("m")).select("over", F.col("m.by").alias("by"))


def live_rebuttals(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(rebutter, rebutted): both are steps of one thread."""
    of = steps.select("thread", "unit").distinct()
    r = edges.where("kind = 'rebuts'").select("src", "dst").distinct()
    return r.join(of.select("thread", F.col("unit").alias("src")), "src").join(of.select("thread", F.col("unit").alias("dst")), ["thread", "dst"]).select(F.col("src").alias("rebutter"), F.col("dst").alias("rebutted")).distinct()


def label_collisions(labels: DataFrame) -> DataFrame:
    """(label, over, n): labels bound to several units; over is the least of them."""
    return labels.groupBy("label").agg(F.min("uid").alias("over"), F.countDistinct("uid").alias("n")).where("n > 1")


def _grounded(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, ground) of present units' present grounds, and (uid, n): how many each has."""
    grounds = edges.where("kind = 'grounds'").select(F.col("src").alias("uid"), F.col("dst").alias("ground")).distinct()
    grounds = written(grounds.join(units.select(F.col("uid").alias("ground")), "ground", "left_semi").join(units.select("uid"), "uid", "left_semi"))
    return grounds, written(grounds.groupBy("uid").agg(F.count("*").alias("n")))


def _falling(grounds: DataFrame, n: DataFrame, fallen: DataFrame, first: DataFrame, lost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid) of the units that lose their last founded ground when first(uid) falls, and lost(uid, lost): how many each has lost.

    Only the units that fell in the last round meet the grounds; what they take is
    added up for the units they touch alone. A unit falls in the round in which it has
    lost all; fallen(uid) are the retracted ones, which don't fall twice. lost is what
    an earlier call returned.
    """
    lost = n.limit(0).select("uid", F.col("n").alias("lost")) if lost is None else lost
    frontier, found = first.select("uid"), []
    while True:
        took = grounds.join(frontier.select(F.col("uid").alias("ground")), "ground").groupBy("uid").agg(F.count("*").alias("more"))
        new = written(lost.join(took, "uid", "full").select("uid", F.coalesce("lost", F.lit(0)).alias("was"), (F.coalesce("lost", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("lost")))
        frontier = written(new.where("was < lost").join(n, "uid").where("lost = n").select("uid").join(fallen.select("uid"), "uid", "left_anti"))
        lost = new.select("uid", "lost")
        if frontier.isEmpty():
            break
        found.append(frontier)
    out = first.limit(0).select("uid")
    for f in found:
        out = out.union(f)
    return out, lost


def effective_status(units: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    """(uid, status, effective, reason): retracted units are unfounded.

    strict: so is a unit with present grounds of which none is founded, until no
    more fall; advisory: only the retracted ones; ignore: none.
    """
    base = units.select("uid", "status")
    fallen = base.join(edges.where("kind = 'retracts'").select(F.col("dst").alias("uid")).distinct(), "uid", "left_semi").select("uid", F.lit("retracted").alias("reason"))
    if mode == "ignore":
        fallen = fallen.where(F.lit(False))
    if mode == "strict":
        fallen = written(fallen)
        orphans, _ = _falling(*_grounded(units, edges), fallen, fallen)
        fallen = fallen.union(orphans.withColumn("reason", F.lit("orphaned")))
    return base.join(fallen, "uid", "left").select("uid", "status", F.when(F.col("reason").isNull(), F.col("status")).otherwise(F.lit(S.UNFOUNDED)).alias("effective"), F.coalesce("reason", F.lit("")).alias("reason"))


def retraction_report(units: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    """(code, uid): E050 for every orphan, W052 for retracted units that an advisory policy keeps."""
    found = effective_status(units, edges, mode).where("reason <> ''")
    code = F.when(F.col("reason") == "orphaned", "E050").when(F.lit(mode == "advisory"), "W052")
    return found.select(code.alias("code"), "uid").where("code is not null")


def retraction_plan(units: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(uid, reason): what would fall, beyond what has fallen, if targets(uid) were retracted.

    What has fallen is worked out once; the targets then fall on top of it, and only
    what they touch is looked at again.
    """
    here = lambda df: df.select("uid").distinct().join(units.select("uid"), "uid", "left_semi")
    grounds, n = _grounded(units, edges)
    retracted = written(here(edges.where("kind = 'retracts'").select(F.col("dst").alias("uid"))))
    orphans, lost = _falling(grounds, n, retracted, retracted)
    was = written(retracted.union(orphans))
    new = written(here(targets).join(was, "uid", "left_anti"))
    more, _ = _falling(grounds, n, was.union(new), new, lost)
    return new.withColumn("reason", F.lit("retracted")).union(more.withColumn("reason", F.lit("orphaned")))


def authority(requests: DataFrame, attestations: DataFrame, rule: str = "origin", quorum: int = 1) -> DataFrame:
    """(uid, n_agents, authorised, refusal) of retraction requests(uid, agent).

    any: one agent is enough; quorum: so many distinct ones; origin: one who attested the unit.
    """
    least = quorum if rule == "quorum" else 1
    who = attestations.select("uid", "agent", F.lit(1).alias("own")).distinct()
    n = requests.select("uid", "agent").distinct().join(who, ["uid", "agent"], "left").groupBy("uid").agg(F.count("agent").alias("n_agents"), F.coalesce(F.max("own"), F.lit(0)).alias("own"))
    refusal = F.when(F.col("n_agents") < least, "too few agents").when((F.col("own") == 0) & F.lit(rule == "origin"), "no agent attested it")
    return n.select("uid", "n_agents", refusal.isNull().alias("authorised"), refusal.alias("refusal"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(uid, side): only_a, only_b or common."""
    return a.select("uid").distinct().withColumn("in_a", F.lit(1)).join(b.select("uid").distinct().withColumn("in_b", F.lit(1)), "uid", "full").select("uid", F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("common").alias("side"))


def hops(attestations: DataFrame) -> DataFrame:
    """(uid, first_hop, last_hop, n_agents, n)."""
    return attestations.groupBy("uid").agg(F.min("hop").alias("first_hop"), F.max("hop").alias("last_hop"), F.countDistinct("agent").alias("n_agents"), F.count("*").alias("n"))


def hop_diff(attestations: DataFrame, edges: DataFrame, start: int, end: int) -> DataFrame:
    """(uid, change, successor) in (start, end]: survived, superseded, retracted or added.

    A unit's hop is its first attestation's; units without any are left out. Only
    units seen up to start can be superseded or retracted, and retraction counts
    first; those first seen later are added. An edge has its own hop (column hop, if
    there is one), else its source's unless it is a self-edge; one without any counts
    as acting in every span. Of several successors the largest name is given.
    """
    first = attestations.groupBy("uid").agg(F.min("hop").alias("hop"))
    own = F.col("hop") if "hop" in edges.columns else F.lit(None).cast("int")
    dated = edges.select("kind", "src", "dst", own.alias("own")).join(first.select(F.col("uid").alias("src"), F.col("hop").alias("of_src")), "src", "left")
    at = F.coalesce("own", F.when(F.col("src") != F.col("dst"), F.col("of_src")))
    acting = dated.where(at.isNull() | at.between(start + 1, end))
    retracted = acting.where("kind = 'retracts'").select(F.col("dst").alias("uid")).distinct().withColumn("gone", F.lit(True))
    superseded = acting.where("kind = 'supersedes'").groupBy(F.col("dst").alias("uid")).agg(F.max("src").alias("successor"))
    out = first.where(F.col("hop") <= end).join(retracted, "uid", "left").join(superseded, "uid", "left")
    change = F.when(F.col("hop") > start, "added").when(F.col("gone"), "retracted").when(F.col("successor").isNotNull(), "superseded").otherwise("survived")
    return out.select("uid", change.alias("change"), "successor").withColumn("successor", F.when(F.col("change") == "superseded", F.col("successor")))


def by_agent(changes: DataFrame, attestations: DataFrame) -> DataFrame:
    """(agent, added, superseded, retracted): who attested the added and the retracted units and the successors, each unit once."""
    who = attestations.select("uid", "agent").distinct()
    acted = changes.where("change <> 'survived'").select(F.coalesce("successor", "uid").alias("uid"), "change", F.col("uid").alias("of"))
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "superseded", "retracted")]
    return acted.join(who, "uid").groupBy("agent").agg(*counts)


def survival_rate(changes: DataFrame) -> DataFrame:
    """One row: before, survived and their ratio, 1 where there was nothing before."""
    n = changes.agg(F.count(F.when(F.col("change") != "added", 1)).alias("before"), F.count(F.when(F.col("change") == "survived", 1)).alias("survived"))
    return n.withColumn("rate", F.when(F.col("before") == 0, F.lit(1.0)).otherwise(F.col("survived") / F.col("before")))


def recipe_changes(attestations: DataFrame, edges: DataFrame, start: int, end: int) -> DataFrame:
    """(uid, was, change): units in (start, end] that supersede one from before under other conditions.

    template-changed: the families of their recipes differ; provider-changed: those
    are alike and the recipes differ. Pairs without any family are left out.
    """
    sets = attestations.groupBy("uid").agg(F.min("hop").alias("hop"), *[F.array_sort(F.collect_set(c)).alias(c) for c in ("recipe", "family")])
    named = lambda end_, p: sets.select(F.col("uid").alias(end_), *[F.col(c).alias(f"{p}_{c}") for c in ("hop", "recipe", "family")])
    pairs = edges.where("kind = 'supersedes'").select("src", "dst").distinct().join(named("src", "new"), "src").join(named("dst", "old"), "dst")
    pairs = pairs.where((F.col("old_hop") <= start) & F.col("new_hop").between(start + 1, end) & ((F.size("old_family") > 0) | (F.size("new_family") > 0)))
    change = F.when(F.col("old_family") != F.col("new_family"), "template-changed").when(F.col("old_recipe") != F.col("new_recipe"), "provider-changed")
    return pairs.select(F.col("src").alias("uid"), F.col("dst").alias("was"), change.alias("change")).where("change is not null")


def compactable(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, fate) of every superseded unit whose successor is there: dropped, referenced or retracted.

    One stays if a unit that is not superseded rests on it (grounds, deps), or if any
    other relation names it, at either end; the supersedes edges into superseded units
    don't count. One that a retraction names, at either end, stays as well: it is
    retracted where nothing else holds it.
    """
    kinds = lambda *some: edges.where(F.col("kind").isin(*some))
    up = written(kinds("supersedes").select(F.col("src").alias("by"), F.col("dst").alias("uid")).distinct())
    there = lambda end: kin(units.select("uid"), up, "uid", end).withColumnRenamed("uid", end)
    gone = written(up.join(there("by"), "by", "left_semi").select("uid").distinct().join(there("uid"), "uid", "left_semi"))
    # what is joined with gone is first rid of other kinds of names
    of = lambda rows, end: kin(rows, gone, end).join(gone.withColumnRenamed("uid", end), end, "left_semi")
    not_of = lambda rows, end: rows.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    ends = lambda rows: of(rows.select(F.explode(F.array("src", "dst")).alias("uid")).distinct(), "uid")
    held = not_of(of(kinds("grounds", "deps"), "dst"), "src").select(F.col("dst").alias("uid"))
    held = held.union(not_of(of(kinds("supersedes"), "src"), "dst").select("src")).union(ends(edges.where(~F.col("kind").isin("grounds", "deps", "supersedes"))))
    held = held.distinct().withColumn("held", F.lit(True))
    retracted = ends(kinds("retracts")).withColumn("retracted", F.lit(True))
    out = gone.join(held, "uid", "left").join(retracted, "uid", "left")
    return out.select("uid", F.when(F.col("held"), "referenced").when(F.col("retracted"), "retracted").otherwise("dropped").alias("fate"))


def newest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, successor, depth) of superseded units, and (uid) of those whose successors are in dispute.

    Of several direct successors the one that no other of them supersedes is taken;
    if that isn't one, the unit is forked and resolves to nothing. Chains end at
    their newest unit; units on a cycle of supersession are left out.
    """
    up = written(edges.where("kind = 'supersedes'").select(F.col("dst").alias("uid"), F.col("src").alias("by")).where("by <> uid").distinct())
    beaten = up.join(up.select(F.col("by").alias("other"), F.col("uid").alias("by")), "by").join(up.select("uid", F.col("by").alias("other")), ["uid", "other"], "left_semi").select("uid", "by").distinct()
    latest_ = written(up.join(beaten, ["uid", "by"], "left_anti").groupBy("uid").agg(F.count("*").alias("n"), F.max("by").alias("by")))
    one = latest_.where("n = 1").select(F.col("uid").alias("src"), F.col("by").alias("dst"))
    forked = up.select("uid").distinct().join(latest_.where("n = 1").select("uid"), "uid", "left_anti")
    return graph.chains(one).select("uid", F.col("last").alias("successor"), "depth"), forked


def relink(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kind, now, fate): each grounds and deps reference of units that nothing supersedes.

    moved: to the newest successor (now); kept; forked: the successors are in
    dispute, so nothing is chosen; dangling: no unit has that name.
    """
    successors, forked = newest(edges)
    superseded = edges.where("kind = 'supersedes' and src <> dst").select(F.col("dst").alias("src")).distinct()
    # dealt by one end, then by the other: what is done at an end shuffles the references no more
    refs = edges.where(F.col("kind").isin("grounds", "deps")).select("src", "dst", "kind").repartition("src").distinct()
    refs = refs.join(superseded, "src", "left_anti").join(units.select(F.col("uid").alias("src")), "src", "left_semi")
    of = written(successors.select(F.col("uid").alias("dst"), F.col("successor").alias("now"), F.lit(False).alias("forked")).union(forked.select("uid", F.lit(None).cast("string"), F.lit(True))))
    refs = refs.join(of, "dst", "left").join(units.select(F.col("uid").alias("dst"), F.lit(True).alias("there")), "dst", "left")
    return refs.select("src", "dst", "kind", "now", F.when(F.col("now").isNotNull(), "moved").when(F.col("forked"), "forked").when(F.col("there").isNull(), "dangling").otherwise("kept").alias("fate"))


def _reached(start: DataFrame, grounds: DataFrame, settled: list[DataFrame]) -> DataFrame:
    """(uid): start and all that rests on it through grounds(uid, ground), but for what is settled already.

    start and settled lie in buckets of uid, grounds in buckets of ground: a round shuffles what it finds.
    """
    frontier = dealt(graph.beyond(start.select("uid").distinct(), settled), "uid", spread=False)
    seen = [frontier]
    while not frontier.isEmpty():
        new = frontier.join(grounds, F.col("ground") == frontier["uid"]).select(grounds["uid"]).distinct()
        frontier = dealt(graph.beyond(new, [*seen, *settled]), "uid", spread=False)
        seen = graph.gathered(seen, frontier)
    return dealt(functools.reduce(DataFrame.union, seen), "uid", spread=len(seen) > 1)


def _numbered_grounds(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(uid, was, sourced) in buckets of uid, (uid, ground) of present units' present grounds in buckets of ground, and the turn: names are numbers.

    Where names turn out to share a number, which marks of another hash tell, all get other numbers.
    """
    turn = 0
    while True:
        turn += 1
        own = dealt(units.select(coded("uid", turn).alias("uid"), F.col("status").cast("int").alias("was"), F.col("source").isNotNull().alias("sourced"), F.hash("uid").alias("mark")), "uid")
        mark = own.groupBy("uid").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
        pairs = edges.where("kind = 'grounds'").select(coded("src", turn).alias("uid"), coded("dst", turn).alias("ground"), F.hash("src").alias("own"), F.hash("dst").alias("of"))
        # buckets of ground first: what a ground is, then what rests on it
        known = mark.select(F.col("uid").alias("ground"), F.col("low").alias("of_low"))
        there = dealt(dealt(pairs, "ground").join(known, "ground").join(mark.select("uid", F.col("low").alias("own_low")), "uid").distinct(), "ground")
        if there.where("own <> own_low or of <> of_low").isEmpty() and mark.where("low <> high").isEmpty():
            return own.drop("mark"), there.select("uid", "ground"), turn


def monotone(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, was, status, ground): units whose status exceeds their weakest ground's, lowered until none does.

    units has uid, status and source. A lowered unit gets the highest status at or
    below that of its weakest present ground that its shape carries: measured and
    cited need a source, derived and inferred grounds, speculative nothing. ground is
    the least of the weakest ones, as they are in the end.

    Levels are settled from the lowest: units of a level hold down all that rests on
    them and isn't settled below, so each level is one reachability and no unit is
    settled twice. Speculative is the floor: what rests on the unfounded stays
    speculative, and only units that were unfounded are. A measured unit without
    source can't be cited, so what keeps it from being measured makes it derived: the
    units that can't be measured are found before those that can't be cited.
    """
    own, grounds, turn = _numbered_grounds(units, edges)
    settled, levels = [], []
    for status in (S.SPECULATIVE, S.INFERRED, S.DERIVED):
        base = own.where(F.col("was") <= status).select("uid")
        if status == S.DERIVED:
            short = _reached(own.where(F.col("was") < S.MEASURED), grounds, settled)  # what can't be measured
            base = base.union(own.where((F.col("was") == S.MEASURED) & ~F.col("sourced")).select("uid").join(short, "uid", "left_semi"))
        found = _reached(base, grounds, settled)
        levels.append(found.withColumn("level", F.lit(status)))
        settled.append(found)
    levels.append(graph.beyond(short, settled).withColumn("level", F.lit(S.CITED)))
    now = own
    for i, level in enumerate(levels):
        now = now.join(level.withColumnRenamed("level", f"level{i}"), "uid", "left")
    now = dealt(now.select("uid", "was", F.least("was", F.coalesce(*[f"level{i}" for i in range(len(levels))], "was")).alias("status")), "uid", spread=False)
    fell = now.where("status < was")
    # names again, for what fell and its grounds; the least name of the weakest counts
    under = dealt(sifted(grounds, fell, ["uid"]).join(now.select(F.col("uid").alias("ground"), F.col("status").alias("s")), "ground").join(fell.select("uid"), "uid", "left_semi").distinct(), "ground")
    low = under.groupBy("uid").agg(F.min("s").alias("s"))
    weak = written(under.join(low, ["uid", "s"]).select("uid", "ground").distinct())
    named = units.select(coded("uid", turn).alias("id"), F.col("uid").alias("name"))
    of = lambda keys: sifted(named, keys, ["id"]).join(keys, "id", "left_semi").distinct()
    least = weak.join(of(weak.select(F.col("ground").alias("id"))).withColumnRenamed("id", "ground"), "ground").groupBy("uid").agg(F.min("name").alias("ground"))
    names = of(fell.select(F.col("uid").alias("id"))).select(F.col("id").alias("uid"), "name")
    return fell.join(least, "uid").join(names, "uid").select(F.col("name").alias("uid"), "was", "status", "ground")


def top_by(rows: DataFrame, n: int, key: list[str], *order) -> DataFrame:
    """The n first rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)
