"""What a chain of hand-overs keeps: each hop packs what the one before passed on; measures E1 to E6 over the hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.store import kin, sifted, written
from . import check, pack


def full_tokens(units: DataFrame) -> DataFrame:
    """(scope, floor, full): the cost of all gists, and of all units at their top levels."""
    return units.groupBy("scope").agg(F.sum("cost0").alias("floor"), F.sum(pack.cost_at(F.col("top"))).alias("full"))


def chain(members: DataFrame, edges: DataFrame, contentions: DataFrame | None = None, hops: int = 5, fraction: float = 0.6) -> DataFrame:
    """(scope, hop, uid, level, tokens): what is left after each hop, hop 0 being the whole at its top levels.

    The budget is a fraction of the whole scope's full cost, the same for every hop.
    A hop chooses among what was carried to it; what a choice needs may come back
    from the whole scope. All hops of a scope are worked out in one place.
    """
    whole, turn = pack.numbered(pack.costed(members.withColumn("raw", F.col("salience")), "raw"))
    start = whole.select("scope", F.lit(0).alias("hop"), "uid", F.col("top").alias("level"), pack.cost_at(F.col("top")).alias("tokens"))
    return written(start.union(pack.handed_on(whole, pack.pulled(whole, turn, edges, contentions), hops, fraction)))


def rebuttal_pairs(left: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, hop, possible, honoured): units left that something rebuts, and those all of whose rebutters are left."""
    rebuts = written(pack.forced(members, edges.where("kind = 'rebuts'")).select("scope", F.col("a").alias("uid"), F.col("b").alias("rebutter")))
    have = sifted(left.select("scope", "hop", F.col("uid").alias("rebutter"), F.lit(1).alias("there")), rebuts, ["scope", "rebutter"])
    each = sifted(left.select("scope", "hop", "uid"), rebuts, ["scope", "uid"]).join(rebuts, ["scope", "uid"]).join(have, ["scope", "hop", "rebutter"], "left")
    return each.groupBy("scope", "hop", "uid").agg(F.min(F.coalesce("there", F.lit(0))).alias("all")).groupBy("scope", "hop").agg(F.count("*").alias("possible"), F.sum("all").alias("honoured"))


def measures(left: DataFrame, members: DataFrame, edges: DataFrame, units: DataFrame, attestations: DataFrame) -> DataFrame:
    """(scope, e1 to e6): token cost, claims kept, corrupted, rebuttals kept at the worst hop, gists kept, warrant density.

    left is a chain's output; members has scope, uid and gist, units the statuses. A
    ratio of nothing is 1.
    """
    last = written(left.groupBy("scope").agg(F.max("hop").alias("hop")))
    end = written(sifted(left, last, ["scope", "hop"]).join(last, ["scope", "hop"]).select("scope", "uid", "tokens"))
    start = left.where("hop = 0").select("scope", "uid", "tokens")
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    gists = members.select("scope", "uid", S.tokens(F.col("gist")).alias("gist"))
    totals = lambda df, suffix: df.join(gists, ["scope", "uid"]).groupBy("scope").agg(F.count("*").alias(f"n{suffix}"), F.sum("tokens").alias(f"tokens{suffix}"), F.sum("gist").alias(f"gist{suffix}"))
    wrong = written(check.rule_m(units, edges).select("uid").unionByName(check.rule_t(units, attestations).select("uid")))
    corrupted = sifted(end, wrong, ["uid"]).join(wrong, "uid").groupBy("scope").agg(F.count("*").alias("e3"))
    # ends of other kinds than the others' are not shuffled
    grounds = edges.where("kind = 'grounds'").select(F.col("src").alias("uid"))
    grounded = written(kin(end, grounds, "uid").join(kin(grounds, end, "uid").distinct(), "uid", "left_semi"))
    warrants = kin(edges.where("kind = 'warrant'").select(F.col("dst").alias("uid")), grounded, "uid").distinct().withColumn("w", F.lit(1))
    density = grounded.join(warrants, "uid", "left").groupBy("scope").agg(F.count("*").alias("grounded"), F.count("w").alias("warranted"))
    worst = rebuttal_pairs(left.where("hop > 0"), members, edges).groupBy("scope").agg(F.min(F.col("honoured") / F.col("possible")).alias("worst"))
    out = totals(start, "0").join(totals(end, "1"), "scope").join(corrupted, "scope", "left").join(density, "scope", "left").join(worst, "scope", "left")
    out = out.fillna(0, ["e3", "grounded", "warranted"])
    q = S.quantise
    return out.select("scope", q(F.col("tokens1") / F.greatest("tokens0", F.lit(1))).alias("e1"), q(ratio("n1", "n0")).alias("e2"), "e3", q(F.coalesce("worst", F.lit(1.0))).alias("e4"), q(F.col("gist1") / F.greatest("gist0", F.lit(1))).alias("e5"), q(ratio("warranted", "grounded")).alias("e6"))
