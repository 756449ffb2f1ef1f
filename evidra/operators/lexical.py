"""A stored index for BM25: postings in blocks that know their largest impact, searched exactly.

A posting's impact is its share of a score but for the term's weight, so it is fixed
when the index is built. A block holds the postings of one term, of one level of
impact and of one part of the documents. A search first scores some documents of the
most telling blocks of each query, whose k-th score the results must reach. A
document is then looked for through the first of the query's terms that it has, terms
of high bounds first: where a block's largest impact and the bounds of all later terms
together fall short of that score, nothing in the block can be a result unless an
earlier term finds it, and the block stays closed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.store import written
from .merge import top_by
from .retrieve import B, K1, _termed, _weighed

#: Documents of a part, levels of impact for each whole one, and postings a result that give the first bound.
PART, STEPS, SEEDS = 4096, 16, 32
#: Half a step of quantised scores, and what rounding may add to sums.
SLACK = 1 / 2048 + 1e-9


@dataclass(frozen=True)
class LexicalIndex:
    """docs(uid, dl, entries of term and tf), blocks(term, level, part, n, top, uids), levels(term, level, n, top),
    terms(term, df, top) and one row of totals(n, avgdl, parts)."""

    docs: DataFrame
    blocks: DataFrame
    levels: DataFrame
    terms: DataFrame
    totals: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def _impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def build(docs: DataFrame, part: int = PART) -> LexicalIndex:
    """The index of docs(uid and those of gist, body, detail that are there); part: documents of a part.

    Texts are taken apart once, where their documents are dealt to; rows of one uid
    count as one document. Documents without terms count for the average length alone.
    """
    spark = docs.sparkSession
    termed = _termed(docs.select("uid", *[c for c in ("gist", "body", "detail") if c in docs.columns]).repartition("uid"))
    mark = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("w")))
    rows = termed.select("uid", "dl", F.explode(F.concat(mark, _weighed(termed))).alias("x")).groupBy("uid", F.col("x.term").alias("term")).agg(F.sum("x.w").cast("long").alias("tf"), F.max("dl").alias("dl"))
    entries = F.filter(F.collect_list(F.struct("term", "tf")), lambda e: e["term"] != "")
    held = written(rows.groupBy("uid").agg(F.max("dl").alias("dl"), entries.alias("entries")))
    n, avgdl = held.agg(F.count("*"), F.avg("dl")).first()
    avgdl, parts = avgdl or 1.0, max(1, -(-n // part))
    post = held.select("uid", F.explode("entries").alias("e"), "dl").select("uid", "e.term", _impact(F.col("e.tf"), F.col("dl"), avgdl).alias("impact"))
    keys = ["term", F.floor(F.col("impact") * STEPS).cast("int").alias("level"), F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part")]
    blocks = written(post.groupBy(*keys).agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.collect_list("uid").alias("uids")))
    levels = written(blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top")))
    terms = written(levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")))
    return LexicalIndex(held, blocks, levels, terms, spark.createDataFrame([(n, avgdl, parts)], "n long, avgdl double, parts int"))


def _asked(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query, term, idf, rest): the queries' terms that the index has; rest: the bounds of all terms after it together."""
    n = index.totals.first().n
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = queries.select("query", F.explode(F.array_distinct(S.terms("text"))).alias("term")).distinct()
    rows = wanted.join(index.terms.select("term", idf.alias("idf"), (idf * F.col("top")).alias("bound")), "term")
    later = Window.partitionBy("query").orderBy(F.desc("bound"), "term").rowsBetween(1, Window.unboundedFollowing)
    return written(rows.select("query", "term", "idf", F.coalesce(F.sum("bound").over(later), F.lit(0.0)).alias("rest")))


def _scored(index: LexicalIndex, asked: DataFrame, found: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(query, uid, score) of found(query, uid): the documents' own entries, met with the terms of those queries alone."""
    if allowed is not None:
        found = found.join(allowed.select("uid").distinct(), "uid", "left_semi")
    found = written(found.distinct())
    own = index.docs.join(found.select("uid").distinct(), "uid", "left_semi").select("uid", "dl", F.explode("entries").alias("e"))
    own = own.select("uid", "e.term", _impact(F.col("e.tf"), F.col("dl"), index.totals.first().avgdl).alias("impact")).join(asked.select("term").distinct(), "term", "left_semi")
    met = found.join(own, "uid").join(asked.select("query", "term", "idf"), ["query", "term"])
    return met.groupBy("query", "uid").agg(S.quantise(F.sum(F.col("idf") * F.col("impact"))).alias("score")).where("score > 0")


def _least(index: LexicalIndex, asked: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query, least): the k-th score among documents of the query's most telling blocks; no row for queries with fewer."""
    parts, seeds = index.totals.first().parts, SEEDS * k
    so_far = Window.partitionBy("query").orderBy(F.desc("value"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    ranked = asked.join(index.levels, "term").select("query", "term", "level", "n", (F.col("idf") * F.col("top")).alias("value"))
    first = ranked.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where(F.col("before") < seeds)
    # of a level with more postings than are wanted, as many parts as hold about twice those: any documents give a bound
    first = first.select("query", "term", "level", F.ceil(F.lit(parts) * 2 * (seeds - F.col("before")) / F.col("n")).alias("parts"))
    some = index.blocks.join(first, ["term", "level"]).where(F.col("part") < F.col("parts")).select("query", F.explode("uids").alias("uid"))
    best = top_by(_scored(index, asked, some, allowed), k, ["query"], F.desc("score"), "uid")
    return written(best.where(F.col("rank") == k).select("query", F.col("score").alias("least")))


def opened(index: LexicalIndex, asked: DataFrame, least: DataFrame) -> DataFrame:
    """(query, term, level, part, n, uids): the blocks that a search reads, those that can hold a result their term is the first to find."""
    open_ = lambda top: F.col("idf") * top + F.col("rest") >= F.col("least") - SLACK
    known = asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    some = known.join(index.levels.select("term", "level", F.col("top").alias("most")), "term").where(open_(F.col("most"))).drop("most")
    return index.blocks.join(some, ["term", "level"]).where(open_(F.col("top"))).select("query", "term", "level", "part", "n", "uids")


def search(index: LexicalIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, uid, score, rank): what retrieve.bm25 gives for queries(query, text): the k best documents of each, ties by uid.

    allowed(uid) keeps others out of the results, not of the counts. Queries whose
    terms no document has give nothing.
    """
    asked = _asked(index, queries)
    found = opened(index, asked, _least(index, asked, k, allowed)).select("query", F.explode("uids").alias("uid"))
    return top_by(_scored(index, asked, found, allowed), k, ["query"], F.desc("score"), "uid").select("query", "uid", "score", "rank")


def report(index: LexicalIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, blocks, opened, postings, read): of each query's blocks and their postings, how many a search opens after its first bound."""
    asked = _asked(index, queries)
    sizes = index.blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"))
    all_ = asked.join(sizes, "term").groupBy("query").agg(F.sum("blocks").alias("blocks"), F.sum("postings").alias("postings"))
    read = opened(index, asked, _least(index, asked, k, allowed)).groupBy("query").agg(F.count("*").alias("opened"), F.sum("n").alias("read"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.join(read, "query", "left").select("query", "blocks", none("opened"), "postings", none("read"))
