"""Tables from outside: delimited lines as units, usage ledgers, names, and the part of a store that travels alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, merge
from .store import grouped, kin, sifted, written

LEDGER = "at bigint, provider string, model string, task string, run string, input_tokens bigint, output_tokens bigint, retries int, estimated boolean"


def numbered_lines(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The header of one text file and (row, line) of its other non-blank lines, in the file's order, from 1.

    Lines are counted in each split and the counts of the splits before are added, so
    no task reads more than its own. A file without lines has an empty header.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    lines = written(lines)
    before = lines.groupBy("split").agg(F.count("*").alias("n")).select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("before"))  # one row for each split
    rows = lines.join(before, "split").select((F.col("before") + F.row_number().over(Window.partitionBy("split").orderBy("id")) - 1).alias("row"), "line")
    head = rows.where("row = 0").first()
    return (head.line if head else ""), rows.where("row > 0")


def units_of_lines(header: str, rows: DataFrame, source: str, key: tuple[str, ...] = (), delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Units(row, kind, gist, status, source, payload) of (row, line), and diagnostics(code, row) of ragged ones.

    Cells are parted by the delimiter alone, without quoting. The key columns, the
    first if none are named, say what a row is of; the others are its values. Each is
    a measured unit whose source is its row, which an import may attest.
    """
    columns = [c.strip() for c in header.split(delimiter)]
    keys = [c for c in key if c in columns] if key else columns[:1]
    cells = F.transform(F.split("line", f"\\Q{delimiter}\\E", -1), lambda c: F.trim(c))
    wide = rows.select("row", cells.alias("cells"))
    said = lambda names: F.array_join(F.array(*[F.concat(F.lit(c + " "), F.get("cells", F.lit(columns.index(c)))) for c in names]), ", ") if names else F.lit("")
    values = [c for c in columns if c not in keys]
    gist = F.concat_ws(": ", *[said(x) for x in (keys, values) if x])
    payload = F.to_json(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.get("cells", F.lit(i)))]))
    whole = F.size("cells") == len(columns)
    units = wide.where(whole).select("row", F.lit("data").alias("kind"), gist.alias("gist"), F.lit(5).alias("status"), F.concat(F.lit(f"file:{source}#row="), F.col("row").cast("string")).alias("source"), payload.alias("payload"))
    return units, wide.where(~whole).select(F.lit("E001").alias("code"), "row")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines ledger; a line that can't be read is passed over."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def totals(entries: DataFrame, by: str, since: int | None = None) -> DataFrame:
    """(key, calls, input_tokens, output_tokens, retries, estimated) by provider, task, run or model; a call without run counts as "-"."""
    rows = entries if since is None else entries.where(F.col("at") >= since)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "retries")]
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("-")).alias("key")).agg(F.count("*").alias("calls"), *sums, F.bool_or("estimated").alias("estimated"))


def label_names(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, uid): what each label(doc, pos, label, uid) means, the last binding of its document, the least unit of several
    documents; and (code, uid, label): W054 for every name of a unit but its least."""
    last = bindings.groupBy("doc", "label").agg(F.max(F.struct("pos", "uid")).alias("x")).select("label", F.col("x.uid").alias("uid"))
    names = last.groupBy("label").agg(F.min("uid").alias("uid"))
    pairs = last.distinct().withColumn("least", F.min("label").over(Window.partitionBy("uid")))
    return names, pairs.where("label <> least").select(F.lit("W054").alias("code"), "uid", "label")


def resolved(units: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges(src, dst, kind) and diagnostics(code, doc, pos, kind, at, label) of what units of documents refer to by label.

    units has doc, pos, uid and a label or null; refs has doc, pos, kind (deps or
    grounds), at (its place among those of its kind), and a label or else a uid, which
    is taken as it stands. A label means the last unit of its document that bears it;
    one that none bears is E060. A unit can't rest on itself in the end: units are
    followed from a document's first one on, deps before grounds, and a reference to a
    unit that is still being followed is E061. Both drop the reference and keep the
    unit.

    Where a document's references all go back, or all go on, none of its units goes
    round, and joins do. Other documents are followed in a grouped function, many small
    ones in a call, so the references of one must fit one task, as its text does.
    """
    last = units.where("label is not null").groupBy("doc", "label").agg(F.max("pos").alias("to"))
    known = written(refs.join(last, ["doc", "label"], "left"))
    unknown = known.where("label is not null and `to` is null")
    inner = known.where("`to` is not null").select("doc", "pos", "kind", "at", "to")
    mixed = inner.groupBy("doc").agg(F.bool_or(F.col("to") >= F.col("pos")).alias("on"), F.bool_or(F.col("to") <= F.col("pos")).alias("back")).where("on and back").select("doc")
    types = dict(known.dtypes)

    def back(pdf):
        docs, found = {}, []
        for r in pdf.sort_values(["kind", "at"], kind="stable").itertuples(index=False):  # deps before grounds
            docs.setdefault(r.doc, {}).setdefault(r.pos, []).append(r)
        for own in docs.values():
            state = {}
            for first in sorted(own):
                stack = [] if first in state else [(first, iter(own[first]))]
                state.setdefault(first, 1)
                while stack:
                    pos, left = stack[-1]
                    r = next(left, None)
                    if r is None:
                        state[pos] = 2
                        stack.pop()
                    elif state.get(r.to) == 1:
                        found.append((r.doc, r.pos, r.kind, r.at))
                    elif r.to not in state:
                        state[r.to] = 1
                        stack.append((r.to, iter(own.get(r.to, ()))))
        return pd.DataFrame(found, columns=["doc", "pos", "kind", "at"])

    dropped = written(grouped(inner.join(mixed, "doc", "left_semi"), "doc", back, ", ".join(f"{c} {types[c]}" for c in ("doc", "pos", "kind", "at")), known))
    key = ["doc", "pos", "kind", "at"]
    names = units.select("doc", "pos", "uid")
    target = F.coalesce("named", F.when(F.col("label").isNull(), F.col("uid")))
    kept = known.join(dropped, key, "left_anti").join(names.select("doc", F.col("pos").alias("to"), F.col("uid").alias("named")), ["doc", "to"], "left").select("doc", "pos", "kind", target.alias("dst")).where("dst is not null")
    edges = kept.join(names, ["doc", "pos"]).select(F.col("uid").alias("src"), "dst", "kind").distinct()
    said = lambda rows, code: rows.select(F.lit(code).alias("code"), *key, "label")
    return edges, said(unknown, "E060").union(said(known.join(dropped, key, "left_semi"), "E061"))


def bundle(units: DataFrame, edges: DataFrame, roots: DataFrame, include_retracted: bool = False) -> DataFrame:
    """(uid): what the roots reach over all edges and units hold; retracted ones only while another of them rests on them."""
    kept = written(graph.closure(edges, roots, None, units=units).select("uid"))
    if include_retracted:
        return kept
    retracted = kin(edges.where("kind = 'retracts'").select(F.col("dst").alias("uid")), kept, "uid").distinct()
    retracted = written(retracted.join(kept, "uid", "left_semi"))
    # retracted units are looked at in the order of their names: one that a dropped one alone rests on stays, if it comes first
    refs = kin(edges.where("kind in ('grounds', 'deps') and src <> dst").select(F.col("src").alias("holder"), F.col("dst").alias("uid")), retracted, "uid")
    refs = sifted(refs, retracted, ["uid"]).join(retracted, "uid").distinct().join(kept.select(F.col("uid").alias("holder")), "holder", "left_semi")
    refs = written(refs)
    gone = written(retracted.join(refs.select("uid"), "uid", "left_anti"))
    if gone.isEmpty():
        return kept
    while True:
        held = refs.join(gone.select(F.col("uid").alias("holder"), F.lit(True).alias("gone")), "holder", "left").where("gone is null or holder > uid")
        new = written(retracted.join(held.select("uid"), "uid", "left_anti").join(gone, "uid", "left_anti"))
        if new.isEmpty():
            return kept.join(gone, "uid", "left_anti")
        gone = written(gone.union(new))


def bundled(store, roots: DataFrame, include_retracted: bool = False):
    """A store of the bundle's units alone: attestations of them, and edges with both ends among them."""
    keep = bundle(store.units, store.edges, roots, include_retracted)
    ends = lambda df, c: df.join(keep.select(F.col("uid").alias(c)), c, "left_semi")
    return type(store)(ends(store.units, "uid"), ends(ends(store.edges, "src"), "dst").select(*store.edges.columns), ends(store.attestations, "uid"), store.steps)


def appended(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key the store lacks, each key once: what an append writes."""
    return merge.merged(new, new.limit(0), key).join(store.select(*key).distinct(), key, "left_anti")
