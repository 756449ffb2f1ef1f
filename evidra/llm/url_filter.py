"""URLs judged by rules, and elsewhere by the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give each
character a probability from the longest context they know, smoothed towards
shorter ones (Witten-Bell). A URL's score is the difference of its
log-likelihoods per character; the limit lies midway between the mean scores of
the held-out accepted and rejected URLs. Both models are learned from the URLs
that a rule decides, all of them.

Only built-in functions run here. Log ratios are rounded to millionths and added
as integers, so results don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small_join

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Longest context; the chance of any character without one.
ORDER, BASE = 4, 1 / 256
#: Stand for the places before the first character and for the end.
START, END = "\x02", "\x03"
#: First hexadecimal digits of a URL's MD5 that hold it out for the limit.
HELD_OUT = ("0", "1", "2")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or nothing."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and its verdict (null where none fits); the longest rule wins, the first of equal ones."""
    rule = verdict = F.lit(None).cast("string")
    # later ones override, so the first of equally long ones comes last
    for said, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per URL and place: the character there and the order characters before it."""
    line = F.concat(F.lit(START * order), "line", F.lit(END))
    places = urls.withColumn("line", line).withColumn("place", F.explode(F.sequence(F.lit(order + 1), F.length("line"))))
    return places.withColumn("gram", F.substring("line", F.col("place") - order, F.lit(order + 1))).drop("line", "place")


def learned(labelled: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order k: (gram of k + 1 characters, how often each class has it)."""
    tables = [kept(grams(labelled, order).groupBy("gram").agg(*[F.sum((F.col("label") == c).cast("long")).alias(c) for c in ("allow", "block")]))]
    for k in range(order - 1, -1, -1):
        last = tables[-1]
        tables.append(kept(last.groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))))
    return tables[::-1]


def ratios(wanted: DataFrame, tables: list[DataFrame], base: float = BASE) -> DataFrame:
    """(gram, ratio): millionths of ln p(character | context) accepted over rejected, for each wanted gram."""
    order = len(tables) - 1
    out = wanted.select("gram", F.lit(base).alias("p_allow"), F.lit(base).alias("p_block"))
    for k, table in enumerate(tables):
        context = table.groupBy(F.substring("gram", 1, k).alias("context")).agg(*[F.sum(c).alias(f"n_{c}") for c in ("allow", "block")], *[F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in ("allow", "block")])
        own = F.substring("gram", order - k + 1, k + 1)
        out = out.withColumn("own", own).withColumn("context", F.substring("own", 1, k))
        out = out.join(table.withColumnRenamed("gram", "own"), "own", "left").join(context, "context", "left")
        for c in ("allow", "block"):
            n, kinds = F.coalesce(f"n_{c}", F.lit(0)), F.coalesce(f"kinds_{c}", F.lit(0))
            p = F.when(n > 0, (F.coalesce(c, F.lit(0)) + kinds * F.col(f"p_{c}")) / (n + kinds)).otherwise(F.col(f"p_{c}"))
            out = out.withColumn(f"new_{c}", p)
        out = out.select("gram", F.col("new_allow").alias("p_allow"), F.col("new_block").alias("p_block"))
    return out.select("gram", F.round(F.log(F.col("p_allow") / F.col("p_block")) * 1e6).cast("long").alias("ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score (millionths per character; null where a rule decides).

    A URL without :// or a null one has an empty host and path, fits no rule that
    names a path and gets the models' verdict as any other. If either class has
    no held-out URL the limit is 0; a URL at the limit is allowed, so without any
    labelled URL all are. Equal URLs share one score; each row gets its own result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = with_rules(rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules).withColumn("line", F.concat("host", "path"))
    rows = kept(rows)
    held = F.substring(F.md5("line"), 1, 1).isin(*HELD_OUT)
    tables = learned(rows.where(F.col("rule").isNotNull() & ~held).select("line", F.col("rule_verdict").alias("label")), order)

    # each line has a number, so that its places carry eight bytes and not the line
    lines = kept(rows.where(F.col("rule").isNull() | held).select("line").distinct().withColumn("key", F.monotonically_increasing_id()))
    table = kept(ratios(grams(lines, order).select("gram").distinct(), tables))
    scored = small_join(grams(lines, order), table, ["gram"]).groupBy("key").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    scores = kept(lines.join(scored, "key").select("line", F.floor(F.col("total") / F.col("n")).cast("long").alias("score")))

    joined = kept(small_join(rows.where(F.col("rule").isNull() | held), scores, ["line"]))
    means = joined.where(F.col("rule").isNotNull()).agg(*[F.sum(F.when(F.col("rule_verdict") == c, F.col("score"))).alias(c) for c in ("allow", "block")], *[F.count(F.when(F.col("rule_verdict") == c, 1)).alias(f"n_{c}") for c in ("allow", "block")]).first()
    limit = (means["allow"] / means["n_allow"] + means["block"] / means["n_block"]) / 2 if means["n_allow"] and means["n_block"] else 0.0
    decided = rows.where(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("long").alias("score"))
    rest = joined.where(F.col("rule").isNull()).select("page_id", "host", "path", "rule", F.when(F.col("score") < limit, "block").otherwise("allow").alias("verdict"), "score")
    return decided.union(rest)
