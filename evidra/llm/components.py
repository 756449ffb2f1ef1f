"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, remove


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the least node that links reach from node.

    links has a and b (long), each link once or more, in either direction. Only
    nodes with a link appear. In a round each node takes the least label among its
    neighbours, hands it to the node that its own label names, so whole trees hang
    on at once, and then takes its label's label. A path of n nodes in any order is
    done in about 2 log2(n) rounds (tests/llm measures it). Each round is written to
    the shared folder and the one before is deleted. Labels move between tables by
    shuffled joins and sums alone.
    """
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        hung = low.where("low < was").groupBy(F.col("was").alias("node")).agg(F.min("low").alias("hung"))
        hung = kept(low.join(hung, "node", "left").select("node", "was", F.least("low", F.coalesce("hung", "low")).alias("low")))
        up = hung.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = kept(hung.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("label"), "was"))
        moved = new.where("label < was").limit(1).count()
        for df in (labels, hung):
            remove(df)
        labels = new.select("node", "label")
        if not moved:
            remove(both)
            return labels
