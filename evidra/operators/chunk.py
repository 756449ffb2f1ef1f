"""Paragraphs with byte offsets, and greedy chunks with one paragraph of overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(uid, pos, start_byte, n_bytes) of each non-blank part of a body; offsets count UTF-8 bytes."""
    cut = docs.select("uid", F.posexplode(_offsets(F.split("body", separator), len(separator))).alias("pos", "p"))
    return cut.where(F.length(F.trim("p.text")) > 0).select("uid", F.col("pos").cast("long").alias("pos"), F.col("p.start").alias("start_byte"), F.octet_length("p.text").cast("long").alias("n_bytes"))


def _offsets(parts: Column, gap: int) -> Column:
    """array of (text, start): a fold that carries the offset along."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,start:bigint>>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.octet_length(p) + gap).alias("at"), F.concat(acc["out"], F.array(F.struct(p.alias("text"), acc["at"].alias("start")))).alias("out"))
    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _split(text: str, budget: int, start: int) -> list[tuple[int, int, str]]:
    """(start, end, text) parts of a paragraph: whole, or by lines, and lines beyond the budget every 4 * budget bytes."""
    cost = lambda b: -(-len(b) // 4)
    data = text.encode()
    if cost(data) <= budget:
        return [(start, start + len(data), text)]
    out, held, begin, at = [], b"", start, start
    for line in re.findall(rb"[^\n]*\n|[^\n]+", data):
        if held and cost(held + line) > budget:
            out.append((begin, at, held.decode().rstrip()))
            held, begin = b"", at
        if cost(line) > budget:
            i = 0
            while i < len(line):
                j = min(i + 4 * budget, len(line))
                while j < len(line) and line[j] & 0xC0 == 0x80:
                    j += 1
                out.append((at + i, at + j, line[i:j].decode()))
                i = j
            begin = at + len(line)
        else:
            held += line
        at += len(line)
    if held.strip():
        out.append((begin, at, held.decode().rstrip()))
    return out


def chunk_text(text: str, budget: int, separator: str = "\n\n", overlap: bool = True) -> list[tuple[int, str, int, int, bool]]:
    """(chunk, text, start_byte, end_byte, overlapped) of one text."""
    parts, at = [], 0
    for raw in text.split(separator):
        own = raw.strip()
        if own:
            parts += _split(own, budget, at + len(raw[: raw.index(own)].encode()))
        at += len(raw.encode()) + len(separator)
    groups, used = [], budget + 1
    for i, (_, _, t) in enumerate(parts):
        cost = -(-len(t.encode()) // 4)
        if used + cost > budget:
            groups.append([i, i])
            used = 0
        groups[-1][1] = i
        used += cost
    out = []
    for n, (first, last) in enumerate(groups):
        begin = groups[n - 1][1] if overlap and n else first
        out.append((n, separator.join(t for _, _, t in parts[begin : last + 1]), parts[begin][0], parts[last][1], overlap and n > 0))
    return out


def chunks(docs: DataFrame, budget: int, separator: str = "\n\n", overlap: bool = True) -> DataFrame:
    """(uid, chunk, text, start_byte, end_byte, overlapped, tokens): paragraphs filled greedily up to budget tokens.

    A paragraph beyond the budget is cut by lines, and a line beyond it every four
    bytes a token, between characters. A chunk but the first begins with the last
    part of the one before, beyond its budget. Blank paragraphs are left out; a body
    without any, or null, gives no chunk. Each text is cut alone, so nothing is shuffled.
    """
    kind = dict(docs.dtypes)["uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, bodies in ((batch.column("uid").slice(i, 64), batch.column("body").slice(i, 64).to_pylist()) for i in range(0, batch.num_rows, 64)):
                rows = [(i, *c) for i, b in enumerate(bodies) for c in chunk_text(b or "", budget, separator, overlap)]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([uids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.bool_())], ["uid", "chunk", "text", "start_byte", "end_byte", "overlapped"])

    cut = docs.select("uid", "body").mapInArrow(run, f"uid {kind}, chunk int, text string, start_byte long, end_byte long, overlapped boolean")
    return cut.withColumn("tokens", S.tokens(F.col("text")))


def window(context: int, most_output: int, prompt: int = 1024, share: float = 0.5) -> int:
    """Tokens of input that a context leaves beside its prompt and output; 256 at least."""
    return max(256, context - prompt - max(most_output, int(context * share)))
