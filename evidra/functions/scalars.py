"""Column functions: token costs, quantised values, text folding and fixed tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
STATUS = ("unfounded", "speculative", "inferred", "derived", "cited", "measured")
RUNG_CEILING = {"computed": 3, "document": 4, "web": 4, "model": 2}
GAIN = (1.0, 1.6, 1.85)
SALIENCE_WEIGHTS = {"default": (0.5, 0.2, 0.3, 0.0), "untrusted": (0.5, 0.0, 0.3, 0.0), "recent": (0.4, 0.15, 0.25, 0.2)}
GRANULARITY = {"coarse": (30, 120, 400, "topical"), "default": (30, 40, 120, "single"), "fine": (30, 20, 60, "single")}
DANGLING_OPENERS = ("this ", "that ", "these ", "those ", "it ", "its ", "they ", "them ", "such ", "the same ", "the above", "the former", "the latter", "as described", "as noted", "see below")

MEASURED, CITED, DERIVED, INFERRED, SPECULATIVE, UNFOUNDED = 5, 4, 3, 2, 1, 0


def tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null and empty texts have none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def text_cost(text: Column) -> Column:
    """Tokens and a fixed two for each text that is there."""
    return F.when(text.isNull(), F.lit(0)).otherwise(tokens(text) + 2).cast("long")


def quantise(value: Column) -> Column:
    """On the grid of 1/1024; null where the value is none or no number."""
    return F.when(F.isnan(value) | value.isNull() | F.abs(value).isin(float("inf")), F.lit(None)).otherwise(F.round(value * 1024) / 1024)


def recency(hops: Column) -> Column:
    """Halves with every hop; nothing from 24 hops on."""
    return F.when(hops >= 24, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -hops))


def gain(level: Column) -> Column:
    """A level's gain, in single precision as stored."""
    return F.when(level == 0, F.lit(GAIN[0]).cast("float")).when(level == 1, F.lit(GAIN[1]).cast("float")).otherwise(F.lit(GAIN[2]).cast("float")).cast("double")


def text_at(level: Column, gist: Column, body: Column, detail: Column) -> Column:
    """The text of a unit at a level: the gist, with the body from level 1 and the detail at 2, blank lines between."""
    return F.concat_ws("\n\n", gist, F.when(level >= 1, body), F.when(level >= 2, detail))


def level_within(want: Column, body: Column, detail: Column) -> Column:
    """The highest level at or below want that a unit was written at."""
    return F.when((want >= 2) & detail.isNotNull(), 2).when((want >= 1) & body.isNotNull(), 1).otherwise(0)


def cut_to(text: Column, budget: int) -> Column:
    """The text if it costs no more than the budget, else its first words within four bytes a token, and an ellipsis."""
    words, limit = F.filter(F.split(text, r"\s+"), lambda w: w != ""), 4 * budget
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc, w):
        full = acc["full"] | (F.octet_length(acc["out"]) + F.octet_length(w) + 1 > limit - 1)
        return F.struct(F.when(full, acc["out"]).when(acc["out"] == "", w).otherwise(F.concat(acc["out"], F.lit(" "), w)).alias("out"), full.alias("full"))

    cut = F.aggregate(words, start, step, lambda acc: acc["out"])
    return F.when(tokens(text) <= budget, text).otherwise(F.concat(F.when(cut == "", F.coalesce(F.get(words, F.lit(0)), F.lit("thread"))).otherwise(cut), F.lit("\u2026")))


def first_sentence(text: Column, most: int = 240) -> Column:
    """A gist for a text that could not be structured: its first sentence, cut at a word to so many characters."""
    plain = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    first = F.regexp_replace(F.regexp_extract(plain, r"^[^.!?\n]*", 0), r"^\s+|\s+$", "")
    first = F.when(first == "", plain).otherwise(first)
    head = F.substring(first, 1, most - 1)
    cut = F.when(head.rlike(r"\s"), F.regexp_replace(head, r"\s\S*$", "")).otherwise(head)
    return F.when(plain == "", "an unrepairable span with no content").when(F.length(first) <= most, first).otherwise(F.concat(cut, F.lit("\u2026")))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in Unicode's composed form (NFC). Plain ASCII is that already and stays in the JVM."""
    return F.when(text.isNull() | text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_composed(text))


def parsed_date(text: Column) -> Column:
    """A date written yyyy-MM-dd that the calendar has, from year 1 on; else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))


def member(text: Column, names: tuple[str, ...]) -> Column:
    """The place of a name in a fixed list, or null."""
    return F.coalesce(*[F.when(text == n, F.lit(i)) for i, n in enumerate(names)])


def parsed_budget(text: Column) -> Column:
    """8000, or 8k for a thousand times as much; null if it is no number or too large a one."""
    digits = F.regexp_extract(text, r"^([0-9]+)[kK]?$", 1)
    wide = F.when(F.length(digits).between(1, 19), digits.cast("decimal(38,0)") * F.when(F.lower(text).endswith("k"), 1000).otherwise(1))
    return F.when(wide <= 9223372036854775807, wide.cast("long"))


def advanced(wall: Column, counter: Column, now: Column) -> Column:
    """(wall, counter) of a clock's next event: the wall time if it went on, else one more at the same."""
    ahead = now > wall
    return F.struct(F.greatest(wall, now).alias("wall"), F.when(ahead, F.lit(0)).otherwise(counter + 1).alias("counter"))


def observed(wall: Column, counter: Column, their_wall: Column, their_counter: Column, now: Column) -> Column:
    """(wall, counter) after another clock's event has come in."""
    top = F.greatest(wall, their_wall, now)
    mine, theirs = top == wall, top == their_wall
    return F.struct(top.alias("wall"), F.when(mine & theirs, F.greatest(counter, their_counter) + 1).when(mine, counter + 1).when(theirs, their_counter + 1).otherwise(0).alias("counter"))


def recipe_hash(*fields: Column) -> Column:
    """A digest of conditions, each field after its length, so that no two lists read alike."""
    return F.sha2(F.concat(*[F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]), 256)


def answer(text: Column) -> Column:
    """true or false for an answer that begins with yes or true, no or false; else null: an unclear answer judges nothing."""
    first = F.upper(F.regexp_replace(F.regexp_extract(text, r"^[\s,.:]*([^\s,.:]+)", 1), r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return F.when(first.isin("YES", "TRUE"), F.lit(True)).when(first.isin("NO", "FALSE"), F.lit(False))


def same_source(original: Column, stated: Column) -> Column:
    """Whether a stated source names the original: one holds the other, and half of it at least, but for case and punctuation."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}._/]", "")
    o, t = plain(original), plain(stated)
    return (o != "") & (F.contains(t, o) | (F.contains(o, t) & (F.octet_length(t) >= F.floor(F.octet_length(o) / 2))))


# How prose states a status and a source.
HEDGES = (
    "This has been retracted, but it was claimed that", "It is possible, though unconfirmed, that", "We infer, from reasoning rather than direct evidence, that",
    "It follows from the evidence recorded here that", "According to the source cited alongside it,", "Measurement shows that",
)
SOURCE_WORDS = {"metric": "the metric", "doc": "the document", "file": "the file", "url": "the page at", "tool": "the tool"}


def stated(status: Column, gist: Column, source: Column) -> Column:
    """A unit as a sentence: hedge, gist with an ordinary capital lowered, and its source (kind:reference) if it has one."""
    hedge = F.coalesce(*[F.when(status == i, F.lit(h)) for i, h in enumerate(HEDGES)], F.lit("It is reported that"))
    lowered = F.when(F.substring(gist, 2, 1).rlike(r"^\p{Ll}"), F.concat(F.lower(F.substring(gist, 1, 1)), F.substring(gist, 2, 1 << 30))).otherwise(gist)
    kind, ref = F.regexp_extract(source, "^([a-z]+):", 1), F.regexp_replace(source, "^[a-z]+:", "")
    word = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in SOURCE_WORDS.items()], F.lit("the source"))
    return F.concat(hedge, F.when(gist == "", F.lit("")).otherwise(F.concat(F.lit(" "), lowered)), F.when(source.isNotNull(), F.concat(F.lit(", according to "), word, F.lit(" "), ref)).otherwise(F.lit("")), F.lit("."))


def dangling_opener(gist: Column) -> Column:
    """The opener without antecedent that a gist starts with, or null."""
    lower = F.concat(F.lower(F.trim(gist)), F.lit(" "))
    found = F.lit(None).cast("string")
    for opener in reversed(DANGLING_OPENERS):
        found = F.when(lower.startswith(opener), F.lit(opener.strip())).otherwise(found)
    return found


def paragraphs(text: Column) -> Column:
    """Non-blank parts between blank lines."""
    return F.filter(F.split(text, "\n\n"), lambda p: F.length(F.trim(p)) > 0)


def list_items(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.ltrim(line).rlike(r"^([-*] |[0-9]+\. )"))


def folded(text: Column) -> Column:
    """Quotes, dashes, white space and case made alike, for looking up quotes."""
    plain = F.translate(text, "\u2018\u2019\u201b\u201c\u201d\u201f\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00a0", "'" * 3 + '"' * 3 + "-" * 7 + " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def quote_support(quote: Column, text: Column) -> Column:
    """present: the folded quote occurs; loose: its words do in order, with others between; else absent.

    A word is found in one that holds it or that it holds; marks of something left
    out are passed over, and a quote of such marks alone is absent.
    """
    q, t = folded(quote), folded(text)
    words = F.filter(F.split(q, " "), lambda w: (w != "") & ~w.rlike(r"^[.\u2026\[\]]+$"))
    found = F.aggregate(F.split(t, " "), F.lit(0), lambda i, h: F.when((i < F.size(words)) & (F.contains(h, F.get(words, i)) | F.contains(F.get(words, i), h)), i + 1).otherwise(i))
    return F.when(F.length(q) == 0, "absent").when(F.contains(t, q), "present").when((F.size(words) > 0) & (found == F.size(words)), "loose").otherwise("absent")


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits, _ and -, each identifier followed by its parts."""
    whole = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    marked = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"[_-]+", " "), r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2")
    parts = lambda w: F.array_remove(F.split(F.lower(marked(w)), " "), "")
    # only a word with one of these marks can have parts
    split = lambda w: w.rlike(r"[_-]|\p{Ll}\p{Lu}|\p{L}\p{N}|\p{N}\p{L}")
    made = F.transform(whole, lambda w: F.struct(F.lower(w).alias("w"), F.when(split(w), parts(w)).alias("p")))
    return F.flatten(F.transform(made, lambda x: F.when(F.size(x["p"]) > 1, F.concat(F.array(x["w"]), x["p"])).otherwise(F.array(x["w"]))))


def looks_like_identifier(query: Column) -> Column:
    q = F.trim(query)
    return ~q.rlike(r"\s") & q.rlike(r"[_./:-]") & (F.length(q) > 0)


def cosine(a: Column, b: Column) -> Column:
    """0 for arrays of unequal length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def ceiling(rung: Column, op: Column) -> Column:
    """The highest status an attestation permits: its rung's, or measured if it is an import."""
    out = F.lit(0)
    for name, status in RUNG_CEILING.items():
        out = F.when(rung == name, F.lit(status)).otherwise(out)
    return F.when(op == "imported", F.lit(MEASURED)).otherwise(out).cast("int")


def attainable(status: Column, cap: Column, has_source: Column, has_grounds: Column) -> Column:
    """A status lowered to the cap, then to what the unit's shape supports."""
    low = F.least(status, cap)
    low = F.when((low >= CITED) & ~has_source, F.lit(DERIVED)).otherwise(low)
    return F.when(low.isin(DERIVED, INFERRED) & ~has_grounds, F.lit(SPECULATIVE)).otherwise(low).cast("int")
