"""Answers in JSON as units, relations and diagnostics.

An answer holds one object with units and relations. Everything in it comes out as a
row or as a diagnostic; a unit with a diagnostic is left out, and so is what refers to
it. Parsing and checks are column expressions, references are joins; the rounds are
those in which a unit falls because one it names fell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .store import written

# Fixed values.
FIELDS = ("type", "label", "gist", "body", "detail", "status", "source", "deps", "grounds", "payload", "quote")
KINDS = ("claim", "evidence", "definition", "question", "hypothesis", "finding", "procedure", "decision", "constraint", "observation", "data", "artifact-ref", "prose", "contention", "packinfo")
STATUSES = ("unfounded", "speculative", "inferred", "derived", "cited", "measured")
SOURCES = ("url", "file", "metric", "tool", "doc")
RELATIONS = ("elaborates", "contrasts", "concedes", "causes", "enables", "exemplifies", "conditions", "sequences", "answers", "rebuts", "warrant", "backs")
#: What a label and the name of a unit outside the batch look like.
LABEL, NAME = r"^[A-Za-z0-9][A-Za-z0-9/._-]*$", r"^[a-z]+:\S+$"


@dataclass(frozen=True)
class Converted:
    """units(batch, i, uid, kind, gist, body, detail, status, source, quote, label), edges(batch, i, src, dst, kind, weight): those of
    relations and, with null i, of deps and grounds; diagnostics(batch, part, i, code, message), part being answer, unit or relation."""

    units: DataFrame
    edges: DataFrame
    diagnostics: DataFrame


def unfenced(text: Column) -> Column:
    """The text between a first and a last fence of three backticks, the first perhaps with the word json; else the text."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```\s*$", "")
    return F.when(F.trim(text).startswith("```"), inner).otherwise(text)


def _kind(v: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")), F.lit(""))


def _text(v: Column, key: str) -> Column:
    """The value of a key if it is a string."""
    return F.when(_kind(v, key) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _said(*found: tuple[Column, str, Column | str]) -> Column:
    """An array of (code, message) for the conditions that hold."""
    one = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for when, code, m in found]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def _unit_checks(v: Column) -> Column:
    """What is wrong with a unit by itself."""
    kind, status, gist, label = (_text(v, k) for k in ("type", "status", "gist", "label"))
    source, source_kind, ref = (lambda k: _text(v, f"source.{k}")), _text(v, "source.kind"), _text(v, "source.ref")
    has_source = _kind(v, "source").startswith("OBJECT")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    odd = F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(*FIELDS))), lambda k: F.struct(F.lit("E001").alias("code"), F.concat(F.lit("unknown field "), k).alias("message")))
    array = lambda k: (_kind(v, k) != "") & ~_kind(v, k).startswith("ARRAY")
    entries = lambda k: F.exists(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), lambda x: ~_is(x, "STRING"))
    captured = source("captured")
    body, n_grounds = _text(v, "body"), F.size(F.coalesce(F.try_variant_get(v, "$.grounds", "array<variant>"), F.array().cast("array<variant>")))
    named = lambda what, value, names: F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"missing {what}")).otherwise(F.concat(value, F.lit(f" is no {what}")))
    checks = _said(
        (kind.isNull() | ~kind.isin(*KINDS), "E001", named("type", kind, KINDS)),
        (F.coalesce(F.trim(gist), F.lit("")) == "", "E001", "missing or empty gist"),
        (status == "unfounded", "E034", "unfounded can't be authored"),
        (status.isNull() | ~status.isin(*STATUSES), "E001", named("status", status, STATUSES)),
        (~label.rlike(LABEL), "E001", F.concat(label, F.lit(" is no label"))),
        *[(array(k), "E001", f"{k} is no array") for k in ("deps", "grounds")],
        *[(entries(k), "E001", f"an entry of {k} is no string") for k in ("deps", "grounds")],
        ((_kind(v, "source") != "") & ~has_source, "E001", "source is no object"),
        (has_source & (source_kind.isNull() | ~source_kind.isin(*SOURCES)), "E001", F.concat(F.coalesce(source_kind, F.lit("")), F.lit(" is no kind of source"))),
        (has_source & source_kind.isin(*SOURCES) & ref.isNull(), "E001", "source has no ref"),
        (has_source & captured.isNotNull() & S.parsed_date(captured).isNull(), "E001", "captured is no date"),
        ((F.coalesce(_text(v, "detail"), F.lit("")) != "") & (F.coalesce(body, F.lit("")) == ""), "E001", "detail without body"),
        (status.isin("cited", "measured") & (_kind(v, "source") == ""), "E001", F.concat(status, F.lit(" needs a source"))),
        (status.isin("inferred", "derived") & (n_grounds == 0), "E001", F.concat(status, F.lit(" needs grounds"))),
    )
    return F.when(_is(v, "OBJECT"), F.concat(odd, checks)).otherwise(_said((F.lit(True), "E001", "not an object")))


def _relation_checks(v: Column) -> Column:
    kind = _text(v, "kind")
    checks = _said((kind.isNull(), "E001", "kind is required"), (~kind.isin(*RELATIONS), "E001", F.concat(kind, F.lit(" is no kind to author"))), *[(_text(v, k).isNull(), "E001", f"{k} is required") for k in ("from", "to")])
    return F.when(_is(v, "OBJECT"), checks).otherwise(_said((F.lit(True), "E001", "not an object")))


def convert(answers: DataFrame) -> Converted:
    """The units, relations and diagnostics of answers(batch, text), batch a string that names each once.

    A text may be fenced and have other text around its object. A unit may name, in
    deps and grounds, labels of units before it and units outside (NAME); relations any
    unit of the batch. Of several units with a label the last one before counts. Units
    get names from their batch and place. A weight outside 0 to 1 is left out, not
    moved. Null texts and texts without an object give a diagnostic.
    """
    object_ = F.regexp_extract(unfenced(F.col("text")), r"(?s)\{.*\}", 0)
    parsed = answers.select("batch", object_.alias("object")).withColumn("v", F.try_parse_json(F.col("object")))
    listed = F.when(_kind(F.col("v"), "units").startswith("ARRAY"), F.try_variant_get(F.col("v"), "$.units", "array<variant>")).when(_kind(F.col("v"), "gist") != "", F.array("v"))
    relations = F.try_variant_get(F.col("v"), "$.relations", "array<variant>")
    parsed = parsed.select("batch", "object", "v", listed.alias("units"), relations.alias("relations"))
    whole = F.when(F.coalesce("object", F.lit("")) == "", "no JSON object").when(F.col("v").isNull(), "not JSON").when(F.col("units").isNull(), "no units, and not a single unit")
    of_answers = parsed.select("batch", F.lit("answer").alias("part"), F.lit(None).cast("int").alias("i"), F.lit("E001").alias("code"), whole.alias("message")).where("message is not null")

    # Units by themselves, then what they name.
    v = F.col("v")
    rows = parsed.where("units is not null").select("batch", F.posexplode("units").alias("i", "v"))
    source = F.concat(_text(v, "source.kind"), F.lit(":"), _text(v, "source.ref"))
    names = lambda k: F.transform(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.when(_is(x, "STRING"), x.cast("string")))
    status = F.coalesce(*[F.when(_text(v, "status") == s, F.lit(k)) for k, s in enumerate(STATUSES)])
    table = written(rows.select("batch", "i", F.concat(F.lit("j:"), "batch", F.lit("-"), F.col("i").cast("string")).alias("uid"), _text(v, "type").alias("kind"), _text(v, "gist").alias("gist"), _text(v, "body").alias("body"), _text(v, "detail").alias("detail"), status.alias("status"), source.alias("source"), _text(v, "quote").alias("quote"), _text(v, "label").alias("label"), names("deps").alias("deps"), names("grounds").alias("grounds"), _unit_checks(v).alias("wrong")))
    sound = written(table.where(F.size("wrong") == 0).select("batch", "i", "uid", "label"))
    named = None
    for k in ("deps", "grounds"):
        part = table.select("batch", "i", "uid", F.lit(k).alias("kind"), F.explode(k).alias("name")).where("name is not null")
        named = part if named is None else named.union(part)
    named = written(named.distinct())

    # Rounds: the last sound unit before with a name's label, until no unit falls.
    while True:
        label = sound.where("label is not null").select("batch", F.col("label").alias("name"), F.col("i").alias("j"), F.col("uid").alias("dst"))
        at = named.join(label, ["batch", "name"], "left").groupBy("batch", "i", "uid", "kind", "name").agg(F.max(F.when(F.col("j") < F.col("i"), F.struct("j", "dst")))["dst"].alias("dst"))
        resolved = written(at.withColumn("dst", F.coalesce("dst", F.when(F.col("name").rlike(NAME), F.col("name")))))
        lost = resolved.where("dst is null").select("batch", "i").distinct()
        left = written(sound.join(lost, ["batch", "i"], "left_anti"))
        fell = sound.join(lost, ["batch", "i"], "left_semi").limit(1).count()
        sound = left
        if not fell:
            break
    units = table.join(sound.select("batch", "i"), ["batch", "i"], "left_semi").drop("wrong", "deps", "grounds")
    unknown = resolved.where("dst is null").select("batch", F.lit("unit").alias("part"), "i", F.lit("E060").alias("code"), F.concat("kind", F.lit(" names unknown "), "name").alias("message"))
    of_units = table.select("batch", F.lit("unit").alias("part"), "i", F.explode("wrong").alias("x")).select("batch", "part", "i", "x.code", "x.message").union(unknown)
    supports = resolved.join(sound.select("batch", "i"), ["batch", "i"], "left_semi").select("batch", F.lit(None).cast("int").alias("i"), F.col("uid").alias("src"), "dst", "kind", F.lit(None).cast("double").alias("weight"))

    # Relations once all labels are known.
    last = Window.partitionBy("batch", "label").orderBy(F.desc("i"))
    labels = sound.where("label is not null").withColumn("rank", F.row_number().over(last)).where("rank = 1").select("batch", "label", "uid")
    said = parsed.where("relations is not null").select("batch", F.posexplode("relations").alias("i", "v")).select("batch", "i", _text(v, "kind").alias("kind"), _text(v, "from").alias("from"), _text(v, "to").alias("to"), F.try_variant_get(v, "$.weight", "double").alias("weight"), _kind(v, "weight").isin("BIGINT", "DOUBLE", "FLOAT").alias("number") | _kind(v, "weight").startswith("DECIMAL").alias("number"), _relation_checks(v).alias("wrong"))
    said = said.toDF("batch", "i", "kind", "from", "to", "weight", "number", "wrong")
    for k, end in (("from", "src"), ("to", "dst")):
        said = said.join(labels.select("batch", F.col("label").alias(k), F.col("uid").alias(end)), ["batch", k], "left").withColumn(end, F.coalesce(end, F.when(F.col(k).rlike(NAME), F.col(k))))
    lost = _said(*[(F.col(k).isNotNull() & F.col(end).isNull(), "E060", F.concat(F.lit(f"{k} names "), k, F.lit(", which is not in this batch"))) for k, end in (("from", "src"), ("to", "dst"))], (F.col("src") == F.col("dst"), "E001", "an edge from a unit to itself"))
    said = written(said.withColumn("wrong", F.concat("wrong", lost)))
    weight = F.when(F.col("number") & F.col("weight").between(0, 1), F.col("weight"))
    edges = said.where(F.size("wrong") == 0).select("batch", "i", "src", "dst", "kind", weight.alias("weight")).union(supports)
    of_relations = said.select("batch", F.lit("relation").alias("part"), "i", F.explode("wrong").alias("x")).select("batch", "part", "i", "x.code", "x.message")
    return Converted(units, edges, of_answers.union(of_units).union(of_relations))
