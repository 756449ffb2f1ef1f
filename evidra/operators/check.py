"""Check passes: one query per rule, each giving (code, uid, detail) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph

# Severities, and the codes that each conformance class forbids.
STRUCTURAL = ("E001", "E002", "E003", "E004", "E080", "E081", "E070", "E071", "E060", "E061", "E011")
EPISTEMIC = ("E030", "E033", "E034", "E012")
SHAPE = ("E020", "E021", "E022", "E023", "E031", "E032", "E040")
LIFECYCLE = ("E050", "E051")
RENDER = ("E210",)
CLASSES = {"read": STRUCTURAL, "consume": STRUCTURAL + EPISTEMIC, "produce": STRUCTURAL + EPISTEMIC + SHAPE, "merge": STRUCTURAL + EPISTEMIC + LIFECYCLE, "full": STRUCTURAL + EPISTEMIC + SHAPE + LIFECYCLE + RENDER}


def rows(df: DataFrame, code: str, detail: Column | str = "") -> DataFrame:
    return df.select(F.lit(code).alias("code"), "uid", (F.lit(detail) if isinstance(detail, str) else detail.cast("string")).alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def rule_m(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Inferred and derived units whose status exceeds that of their weakest present ground: (uid, status, ground, ground_status)."""
    grounds = edges.where("kind = 'grounds'").select(F.col("src").alias("uid"), F.col("dst").alias("ground")).distinct()
    found = units.select(F.col("uid").alias("ground"), F.col("status").alias("ground_status"))
    weakest = grounds.join(found, "ground").groupBy("uid").agg(F.min(F.struct("ground_status", "ground")).alias("w"))
    claims = units.where(F.col("status").isin(S.DERIVED, S.INFERRED)).select("uid", "status")
    return claims.join(weakest, "uid").where("status > w.ground_status").select("uid", "status", F.col("w.ground").alias("ground"), F.col("w.ground_status").alias("ground_status"))


def rule_t(units: DataFrame, attestations: DataFrame) -> DataFrame:
    """Units whose status exceeds the highest ceiling of their attestations; units without any are skipped."""
    top = attestations.groupBy("uid").agg(F.max(S.ceiling(F.col("rung"), F.col("op"))).alias("ceiling"))
    return units.select("uid", "status").join(top, "uid").where("status > ceiling")


def measured_not_imported(units: DataFrame, attestations: DataFrame) -> DataFrame:
    imported = attestations.where("op = 'imported'").select("uid")
    return units.where(F.col("status") == S.MEASURED).select("uid").join(imported, "uid", "left_anti")


def shape(units: DataFrame, edges: DataFrame, gist_max: int = 30) -> DataFrame:
    """E021 empty gist, E022 gist too long, E031 no grounds, E032 no source, E034 unfounded."""
    grounded = edges.where("kind = 'grounds'").select(F.col("src").alias("uid")).distinct()
    return union(
        rows(units.where(F.length(F.trim(F.coalesce("gist", F.lit("")))) == 0), "E021"),
        rows(units.where(S.tokens(F.col("gist")) > gist_max), "E022", S.tokens(F.col("gist"))),
        rows(units.where(F.col("status").isin(S.DERIVED, S.INFERRED)).join(grounded, "uid", "left_anti"), "E031"),
        rows(units.where(F.col("status").isin(S.MEASURED, S.CITED) & F.col("source").isNull()), "E032"),
        rows(units.where(F.col("status") == S.UNFOUNDED), "E034"),
    )


def granularity(texts: DataFrame, profile: str = "default") -> DataFrame:
    """E040 several paragraphs or list items in a body, W041 body out of range; units without body are skipped."""
    _, low, high, admission = S.GRANULARITY[profile]
    bodies = texts.where(F.col("body").isNotNull())
    n = S.tokens(F.col("body"))
    parts = [rows(bodies.where((n < low) | (n > high)), "W041", n)]
    if admission == "single":
        parts.append(rows(bodies.where((F.size(S.paragraphs(F.col("body"))) > 1) | (F.size(S.list_items(F.col("body"))) > 1)), "E040", F.size(S.paragraphs(F.col("body")))))
    return union(*parts)


def gist_openers(texts: DataFrame) -> DataFrame:
    found = texts.where(F.col("body").isNotNull()).withColumn("opener", S.dangling_opener(F.col("gist"))).where("opener is not null")
    return rows(found, "W024", F.col("opener"))


def undeclared_kinds(edges: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    return edges.select("kind").distinct().where(~F.col("kind").isin(*declared)).select(F.lit("W013").alias("code"), F.col("kind").alias("uid"), F.lit("").alias("detail"))


def detail_without_body(texts: DataFrame) -> DataFrame:
    return rows(texts.where("detail is not null and body is null"), "E023")


def mentions(texts: DataFrame, marker: str = "b3:") -> DataFrame:
    """(uid, token): what a body may refer to units by: tokens with a slash (labels) or that begin with the marker (names)."""
    tokens = F.filter(F.split("body", r"[^A-Za-z0-9:/\-_.]"), lambda t: t.contains("/") | t.startswith(marker))
    trimmed = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.\-_]+|[.\-_]+$", ""))
    return texts.where("body is not null").select("uid", F.explode(F.array_distinct(F.filter(trimmed, lambda t: F.length(t) > 0))).alias("token"))


def resolved(prefixes: DataFrame, units: DataFrame) -> DataFrame:
    """(prefix, n, uid): how many units begin with each prefix, and which if it is one.

    Names are cut to each length that the prefixes have, few different ones, and
    joined by equality.
    """
    wanted = prefixes.select("prefix").distinct()
    lengths = sorted(r[0] for r in wanted.where("prefix <> ''").select(F.length("prefix").alias("n")).distinct().collect())
    cut = units.select("uid").distinct().select("uid", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length("uid") >= F.col("n"))
    found = wanted.join(cut.select("uid", F.expr("substring(uid, 1, n)").alias("prefix")), "prefix", "left").groupBy("prefix").agg(F.count("uid").alias("n"), F.min("uid").alias("uid"))
    return found.select("prefix", "n", F.when(F.col("n") == 1, F.col("uid")).alias("uid"))


def body_closure(texts: DataFrame, edges: DataFrame, units: DataFrame, labels: DataFrame, marker: str = "b3:") -> DataFrame:
    """E020: a body mentions a unit that is neither a dep nor a ground; E072: a name in it fits several units."""
    said = mentions(texts, marker)
    names = resolved(said.where(F.col("token").startswith(marker)).select(F.col("token").alias("prefix")), units)
    by_name = said.join(names.withColumnRenamed("uid", "meant"), F.col("token") == F.col("prefix"))
    by_label = said.where(~F.col("token").startswith(marker)).join(labels.select(F.col("label").alias("token"), F.col("uid").alias("meant")), "token")
    meant = by_name.where("n = 1").select("uid", "meant").union(by_label.select("uid", "meant")).where("uid <> meant").distinct()
    declared = edges.where("kind in ('deps', 'grounds')").select(F.col("src").alias("uid"), F.col("dst").alias("meant")).distinct()
    return union(rows(meant.join(declared, ["uid", "meant"], "left_anti"), "E020", F.col("meant")), rows(by_name.where("n > 1"), "E072", F.col("token")))


def unknown_kinds(units: DataFrame, known: tuple[str, ...], implemented: tuple[str, ...] | None = None) -> DataFrame:
    """W010: units of a kind that nothing here knows, or that a consumer doesn't implement (both may hold)."""
    parts = [rows(units.where(~F.col("kind").isin(*known)), "W010", F.lit("unknown"))]
    if implemented is not None:
        parts.append(rows(units.where(~F.col("kind").isin(*implemented)), "W010", F.lit("not implemented")))
    return union(*parts)


def redefinitions(declarations: DataFrame, kinds: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """E012: a schema(id, types, relations) that declares a kind or relation which is the kernel's own."""
    own = lambda c, names: F.exists(c, lambda x: x.isin(*names))
    return rows(declarations.where(own("types", kinds) | own("relations", relations)).withColumnRenamed("id", "uid"), "E012")


def unknown_records(records: DataFrame, known: tuple[int, ...]) -> DataFrame:
    """W014: one row for each record(code, payload) of a type that is not known; it is kept as it is."""
    return records.where(~F.col("code").isin(*known)).select(F.lit("W014").alias("code"), F.col("code").cast("string").alias("uid"), F.octet_length("payload").cast("string").alias("detail"))


def granularity_distribution(views: DataFrame) -> DataFrame:
    """(profile, n): how many views state each profile."""
    return views.groupBy("profile").agg(F.count("*").alias("n"))


def local(units: DataFrame, edges: DataFrame, texts: DataFrame, attestations: DataFrame, labels: DataFrame, cap: int, marker: str = "b3:") -> DataFrame:
    """The rules that can be judged within a batch: shape, closure, granularity, trust and the batch's own ceiling."""
    over = rows(units.where(F.col("status") > cap), "E033", F.lit(cap))
    return union(shape(units, edges), body_closure(texts, edges, units, labels, marker), gist_openers(texts), granularity(texts), rows(rule_t(units, attestations), "E033", F.col("ceiling")), rows(measured_not_imported(units, attestations), "W035"), over)


def fails(found: DataFrame, threshold: str) -> DataFrame:
    """One row: fails, whether anything as severe as the threshold (error, or warn and above) was found, and how many of each."""
    error = F.col("code").startswith("E")
    n = found.agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"))
    return n.select(((F.col("errors") > 0) | (F.lit(threshold == "warn") & (F.col("warnings") > 0))).alias("fails"), "errors", "warnings")


def markers(profiles: DataFrame) -> DataFrame:
    """E210: profiles(profile, status, marker) that lack a status, or mark two alike or one with nothing."""
    seen = profiles.groupBy("profile").agg(F.countDistinct("status").alias("statuses"), F.countDistinct(F.when(F.trim("marker") != "", F.trim("marker"))).alias("different"))
    return rows(seen.where(f"statuses < {len(S.STATUS)} or different < {len(S.STATUS)}").withColumnRenamed("profile", "uid"), "E210")


def summary(found: DataFrame) -> DataFrame:
    """(code, severity, n, units)."""
    return found.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("units")).withColumn("severity", F.when(F.col("code").startswith("E"), "error").otherwise("warn"))


def conformance(found: DataFrame) -> DataFrame:
    """(class, conforms, n_codes): whether a code that the class forbids occurs."""
    spark = found.sparkSession
    table = spark.createDataFrame([(c, code) for c, codes in CLASSES.items() for code in codes], "class string, code string")
    seen = found.select("code").distinct().withColumn("seen", F.lit(1))
    return table.join(F.broadcast(seen), "code", "left").groupBy("class").agg((F.count("seen") == 0).alias("conforms"), F.count("seen").alias("n_codes"))


def fidelity(units: DataFrame, known: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """(kind, n, verdict): full for kinds a consumer knows, refuse for required ones it doesn't, else degraded."""
    return units.groupBy("kind").agg(F.count("*").alias("n")).withColumn("verdict", F.when(F.col("kind").isin(*known), "full").when(F.col("kind").isin(*required), "refuse").otherwise("degraded"))


def missing(units: DataFrame, views: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(kind, n, views): what a consumer of the known kinds lacks: kinds of units, n of them, and those that views(view, requires) ask for, so many views."""
    of_units = units.groupBy("kind").agg(F.count("*").alias("n"))
    asked = views.select("view", F.explode(F.array_distinct("requires")).alias("kind")).groupBy("kind").agg(F.countDistinct("view").alias("views"))
    both = of_units.join(asked, "kind", "full").where(~F.col("kind").isin(*known))
    return both.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("views", F.lit(0)).alias("views"))
