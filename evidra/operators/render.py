"""Rendering of threads: blocks with markers and connectives, then text backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.store import sifted

# Fixed values.
CONNECTIVES = {"contrasts": ("However, ", "By contrast, "), "concedes": ("Admittedly, ", "Granted, "), "causes": ("Consequently, ", "As a result, "), "elaborates": ("", "More precisely, "), "exemplifies": ("For example, ",), "conditions": ("Provided that ",), "enables": ("This makes it possible that ",), "sequences": ("Then, ", "Next, "), "answers": ("In answer, ",), "rebuts": ("Against this, ", "On the other hand, "), "warrant": ("The warrant is that ",), "backs": ("This is backed by ",), "supersedes": ("Superseding this, ",), "retracts": ("Retracting this, ",)}


def connective(kind: Column, uid: Column) -> Column:
    """The variant that the first byte of the unit's id picks; null for kinds without one."""
    out = F.lit(None).cast("string")
    for k, variants in CONNECTIVES.items():
        out = F.when(kind == k, F.element_at(F.array(*map(F.lit, variants)), (F.ascii(uid) % len(variants) + 1).cast("int"))).otherwise(out)
    return out


# Marks of the six statuses, and the built-in profiles.
GLYPHS = ("\u2717", "?", "\u2248", "\u22a2", "\u2020", "\u25aa")
PROFILES = {
    "plain": {"level": 1, "roles": {}, "notes": 3, "status": "glyph", "elsewhere": False},
    "exec": {"level": 1, "roles": {"bottom-line": 1, "risk": 0, "support": 0, "ask": 0}, "notes": 1, "status": "glyph", "elsewhere": False},
    "analyst": {"level": 2, "roles": {}, "notes": 1 << 30, "status": "word", "elsewhere": True},
}


def marker(status: Column, profile: str) -> Column:
    said = GLYPHS if PROFILES[profile]["status"] == "glyph" else [f"[{s}]" for s in S.STATUS]
    return F.coalesce(*[F.when(status == i, F.lit(m)) for i, m in enumerate(said)], F.lit(""))


def lowered(text: Column) -> Column:
    """The first letter lowered if the first word is an ordinary capitalised one; names like SLO or p99 stay."""
    return F.when(text.rlike(r"^\p{Lu}[\p{Ll}\p{Lm}\p{Lo}'-]*(\s|$)"), F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))).otherwise(text)


def joined(connective_: Column, text: Column) -> Column:
    return F.when(F.coalesce(connective_, F.lit("")) == "", text).otherwise(F.concat(connective_, lowered(text)))


def joinings(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, pos, uid, before, joining): the least kind that relates a step and the one before, either way.

    Ends are compared as a lesser and a greater one, and only edges that may join two
    steps are shuffled.
    """
    pairs = steps.select("scope", "pos", "uid", F.lag("uid").over(Window.partitionBy("scope").orderBy("pos")).alias("before"))
    ordered = lambda df, a, b, *more: df.where(F.col(a) != F.col(b)).select(*more, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    met = ordered(pairs, "uid", "before", "scope", "pos")
    ends = sifted(ordered(edges, "src", "dst", "kind"), met, ["a", "b"])
    least = met.join(ends, ["a", "b"]).groupBy("scope", "pos").agg(F.min("kind").alias("joining"))
    return pairs.join(least, ["scope", "pos"], "left")


def blocks(steps: DataFrame, texts: DataFrame, edges: DataFrame, attestations: DataFrame, contentions: DataFrame, profile: str, cap: int = 2, suppress: bool = False) -> DataFrame:
    """(scope, pos, role, uid, level, text, marker, connective, notes) of steps whose unit is there.

    A step is shown at the level its role has in the profile, or the highest below
    that its unit was written at. Notes are its source, its agents, the open
    contentions on it and, where the profile is full, its grounds that no step shows;
    the profile says how many. texts has uid, gist, body, detail, status and source;
    contentions id, over and positions, of which all touch the units they name. With
    suppress blocks say nothing of contentions, and the artifact says that.
    """
    p = PROFILES[profile]
    want = F.coalesce(*[F.when(F.col("role") == r, F.lit(n)) for r, n in p["roles"].items()], F.lit(p["level"])) if p["roles"] else F.lit(p["level"])
    level = S.level_within(F.least(want, F.lit(cap)), F.col("body"), F.col("detail"))
    joining = joinings(steps, edges).select("scope", "pos", "joining")
    agents = sifted(attestations, steps, ["uid"]).groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set(F.concat("agent", F.lit(" ("), "rung", F.lit(")")))), ", ").alias("agents"))
    touched = contentions.select("id", F.size("positions").alias("n"), F.explode(F.array_distinct(F.concat(F.array("over"), F.col("positions")))).alias("uid"))
    touched = sifted(touched, steps, ["uid"])
    disputes = touched.groupBy("uid").agg(F.array_sort(F.collect_set(F.concat("id", F.lit(": contested, "), F.col("n").cast("string"), F.lit(" position(s) on record")))).alias("disputes"))
    shown = steps.select("scope", F.col("uid").alias("dst"), F.lit(True).alias("shown")).distinct()
    grounds = sifted(edges.where("kind = 'grounds'").select(F.col("src").alias("uid"), "dst"), steps, ["uid"]).distinct()
    away = steps.select("scope", "uid").distinct().join(grounds, "uid").join(shown, ["scope", "dst"], "left_anti").groupBy("scope", "uid").agg(F.concat(F.lit("rests on "), F.array_join(F.array_sort(F.collect_set("dst")), ", ")).alias("away"))
    rows = steps.join(texts, "uid").join(joining, ["scope", "pos"], "left").join(agents, "uid", "left").join(disputes, "uid", "left").join(away, ["scope", "uid"], "left")
    none = F.array().cast("array<string>")
    notes = F.concat(F.array_compact(F.array("source", "agents")), none if suppress else F.coalesce("disputes", none), F.array_compact(F.array(F.when(F.lit(p["elsewhere"]), F.col("away")))))
    text = S.text_at(F.col("level"), F.col("gist"), F.col("body"), F.col("detail"))
    return rows.withColumn("level", level).select("scope", "pos", "role", "uid", "level", text.alias("text"), marker(F.col("status"), profile).alias("marker"), F.coalesce(connective(F.col("joining"), F.col("uid")), F.lit("")).alias("connective"), F.slice(notes, 1, p["notes"]).alias("notes"))


def _lines(rows: DataFrame, line: Column, sep: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy("scope").agg(F.array_join(F.transform(parts, lambda p: p["line"]), sep).alias("text"))


def markdown(rows: DataFrame) -> DataFrame:
    """(scope, text): one list item per block."""
    return _lines(rows, F.concat(F.lit("- **"), "marker", F.lit("** "), joined(F.col("connective"), F.col("gist"))), "\n")


def plain(rows: DataFrame) -> DataFrame:
    return _lines(rows, F.concat(joined(F.col("connective"), F.col("gist")), F.lit(" ["), "marker", F.lit("]")), "\n")


def html(rows: DataFrame) -> DataFrame:
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined(F.col("connective"), F.col("gist")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    return _lines(rows, F.concat(F.lit('<li class="'), "marker", F.lit('">'), escaped, F.lit("</li>")), "")


def as_json(rows: DataFrame) -> DataFrame:
    """(scope, text): an array of objects."""
    return _lines(rows, F.to_json(F.struct("pos", "marker", "connective", "gist")), ",").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))


# Artifacts: whole documents of blocks


def opened(steps: DataFrame, contentions: DataFrame) -> DataFrame:
    """(scope, ids): the open contentions that touch a step's unit, sorted; scopes without any have none."""
    touched = contentions.select("id", F.explode(F.array_distinct(F.concat(F.array("over"), F.col("positions")))).alias("uid"))
    found = steps.select("scope", "uid").distinct().join(touched, "uid").groupBy("scope").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return steps.select("scope").distinct().join(found, "scope", "left").select("scope", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def suppression(profile: str, ids: Column) -> Column:
    """What every artifact says where a profile leaves open contentions out (rule V2), or null."""
    said = F.concat(F.lit("W211: "), F.size(ids).cast("string"), F.lit(f" open contention(s) suppressed by profile {profile}: "), F.array_join(ids, ", "))
    return F.when(F.size(ids) > 0, said)


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _contested(note: Column) -> Column:
    return note.rlike(r": contested, [0-9]+ position\(s\) on record$")


def artifact(shown: DataFrame, titles: DataFrame, open_: DataFrame, backend: str, profile: str, suppress: bool = False) -> DataFrame:
    """(scope, text): each scope's blocks as one document, markdown, plain, html or json.

    shown is what blocks() gives, titles(scope, title) heads the documents, open_ is
    opened(). Every block keeps its role, marker and notes. A document ends with its
    open contentions; where they were suppressed, with a line that says so and names
    them. A scope without blocks has its head and end alone.
    """
    line, notes = joined(F.col("connective"), F.col("text")), F.col("notes")
    kept = lambda each: F.array_join(F.transform(notes, each), "")
    quiet = suppression(profile, F.col("ids")) if suppress else F.lit(None).cast("string")
    listed = F.when(quiet.isNull() & (F.size("ids") > 0), F.array_join("ids", ", "))
    if backend == "markdown":
        block = F.concat(F.lit("## "), "role", F.lit("\n\n"), "marker", F.lit(" "), line, F.lit("\n"), kept(lambda n: F.when(_contested(n), F.concat(F.lit("\n> **contested** \u2014 "), n, F.lit("\n"))).otherwise(F.concat(F.lit("\n*"), n, F.lit("*\n")))), F.lit("\n"))
        head = F.concat(F.lit("# "), "title", F.lit("\n\n"))
        end = F.coalesce(F.concat(F.lit("---\n\n<!-- "), quiet, F.lit(" -->\n")), F.concat(F.lit("---\n\n**Open contentions:** "), listed, F.lit("\n")), F.lit(""))
        made = lambda body: F.concat(head, body, end)
    elif backend == "plain":
        block = F.concat(F.lit("["), "role", F.lit("] "), line, F.lit(" "), "marker", F.lit("\n"), kept(lambda n: F.concat(F.lit("    "), n, F.lit("\n"))))
        end = F.coalesce(F.concat(F.lit("\n"), quiet, F.lit("\n")), F.concat(F.lit("\nopen contentions: "), listed, F.lit("\n")), F.lit(""))
        made = lambda body: F.concat("title", F.lit("\n\n"), body, end)
    elif backend == "html":
        block = F.concat(F.lit('<section class="'), _escaped(F.col("role")), F.lit('"><p>'), _escaped(F.concat("marker", F.lit(" "), line)), F.lit("</p>"), kept(lambda n: F.concat(F.when(_contested(n), '<aside class="contested">').otherwise("<aside>"), _escaped(n), F.lit("</aside>"))), F.lit("</section>"))
        end = F.coalesce(F.concat(F.lit('<footer class="suppressed">'), _escaped(quiet), F.lit("</footer>")), F.concat(F.lit("<footer>Open contentions: "), _escaped(listed), F.lit("</footer>")), F.lit(""))
        made = lambda body: F.concat(F.lit("<article><h1>"), _escaped(F.col("title")), F.lit("</h1>"), body, end, F.lit("</article>"))
    elif backend == "json":
        block = F.to_json(F.struct("pos", "role", "level", "marker", "connective", "text", "notes"))
        rest = F.to_json(F.struct("title", F.col("ids").alias("open"), quiet.isNotNull().alias("suppressed"), quiet.alias("note")))
        made = lambda body: F.concat(F.lit('{"blocks":['), body, F.lit("],"), F.substring(rest, 2, 1 << 30))
    else:
        raise ValueError(f"no backend {backend}")
    body = _lines(shown.select("scope", "pos", "role", "level", "marker", "connective", "text", "notes"), block, "," if backend == "json" else "").withColumnRenamed("text", "body")
    rows = titles.select("scope", "title").join(open_, "scope", "left").join(body, "scope", "left").withColumns({"ids": F.coalesce("ids", F.array().cast("array<string>")), "body": F.coalesce("body", F.lit(""))})
    return rows.select("scope", made(F.col("body")).alias("text"))
