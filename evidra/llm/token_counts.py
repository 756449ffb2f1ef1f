"""Token counts of sections from one encoding of the whole document.

A byte-level vocabulary maps each token to its bytes, so the running sum of their
lengths gives every token's span in the text. Sections are spans of the same text;
a token belongs to the sections its span meets. One that crosses a boundary is
allocated by a stated rule:

``first``  to the section of its first character,
``last``   to that of its last,
``most``   to the one that holds most of its characters, the earlier of equal ones,
``share``  to each in proportion to the characters it holds.

Sections tile the text, so the counts of a document add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import slices

RULES = ("first", "last", "most", "share")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding(vocabulary: str):
    """The byte-level encoding of a rank file, and each id's length in bytes."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("evidra", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin; a line holds its line feed."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[starts < len(data)] if len(data) else starts[:0]


def allocate(token_ends: np.ndarray, starts: np.ndarray, chars: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. chars: code points that begin before each byte offset (n + 1).

    A token's first and last characters are those that its first and last bytes
    are part of; a character split between tokens counts for the one in which it
    begins, and a token in which none begins counts as one of that character.
    """
    token_starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(starts, token_starts, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    n = len(starts)
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float)
    out = np.bincount(first[(first == last) | (rule == "first")], minlength=n).astype(float)
    if rule == "first":
        return out
    ends = np.concatenate([starts[1:], [len(chars) - 1]])
    for t in np.flatnonzero(first != last):
        a, b = token_starts[t], token_ends[t]
        parts = np.array([chars[min(b, ends[s])] - chars[max(a, starts[s])] for s in range(first[t], last[t] + 1)])
        if rule == "most":
            out[first[t] + int(parts.argmax())] += 1
        else:
            out[first[t] : last[t] + 1] += parts / max(1, parts.sum())
    return out


def attribute(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", vocabulary: str | None = None, field_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per section: doc_id, section (from 0), field, start_char, end_char (exclusive), n_tokens.

    The document is the fields of field_cols, if any, each with a line feed after
    it, then the text; it is encoded once. A field is one section under its name;
    the text's sections are its lines, each with its line feed, under field
    text_col. n_tokens is fractional under the rule ``share`` alone. An empty field
    is a section of its line feed; a null field or text counts as empty, and a
    document without any character has no section. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    whole = F.concat(*[F.concat(text_of(c), F.lit("\n")) for c in field_cols], text_of(text_col)) if field_cols else text_of(text_col)
    heads = [F.octet_length(text_of(c)).alias(f"h{i}") for i, c in enumerate(field_cols)]
    names = [*field_cols, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, limit=4 << 20):
            if encoder is None:
                encoder, lengths = encoding(vocabulary)
            texts, sizes = batch.column("text").to_pylist(), [batch.column(f"h{i}").to_pylist() for i in range(len(field_cols))]
            row, number, field, start, end, tokens = [], [], [], [], [], []
            for i, text in enumerate(texts):
                if not text:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(lengths[np.array(encoder.encode_ordinary(text), np.int64)])
                heads = np.cumsum([0, *(s[i] + 1 for s in sizes)])
                starts = np.concatenate([heads[:-1], heads[-1] + line_starts(data[heads[-1] :])])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = chars[starts]
                row.append(np.full(len(starts), i))
                number.append(np.arange(len(starts)))
                field.append(np.minimum(np.arange(len(starts)), len(field_cols)))
                start.append(at)
                end.append(np.append(at[1:], chars[-1]))
                tokens.append(allocate(ends, starts, chars, rule))
            if row:
                row, number, field, start, end, tokens = (np.concatenate(x) for x in (row, number, field, start, end, tokens))
                named = pa.DictionaryArray.from_arrays(pa.array(field, pa.int32()), names).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), named, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.float64())], ["doc_id", "section", "field", "start_char", "end_char", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole.alias("text"), *heads)
    out = rows.mapInArrow(run, f"doc_id {kind}, section int, field string, start_char long, end_char long, n_tokens double")
    return out if rule == "share" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
