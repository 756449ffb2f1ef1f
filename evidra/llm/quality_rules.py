"""Rules on whole texts, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_join, text_of
from .tokens import slices, words_of

SYMBOLS = r"[#*$%&|<>]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A line of a host goes if it stands in more documents of the host than this many ...
LINE_DOCUMENTS = 50
#: ... or, in a smaller host, than this share of its documents, but in more than the least at any rate.
LINE_SHARE, LINE_LEAST = 0.1, 3
#: A document is depleted if less than this share of its words is left, or fewer words than the base rules ask for.
LEFT_SHARE, LEAST_WORDS = 0.3, 50
#: Stands for a null host, so that joins and groups treat it as any other.
NO_HOST = "\0"


def _seen_before(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each (owner, code) equals an earlier one."""
    order = np.lexsort((np.arange(len(code)), code, owner))
    out = np.zeros(len(code), bool)
    out[order[1:]] = (owner[order][1:] == owner[order][:-1]) & (code[order][1:] == code[order][:-1])
    return out


def _in_repeats(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words that its text holds twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < 3:
        return out
    whole = owner[2:] == owner[:-2]
    at = np.flatnonzero(whole)
    key = (words[at] << 32) | words[at + 1]
    own = (owner[at] << 32) | words[at + 2]
    order = np.lexsort((key, own))
    same = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for step in range(3):
        out[at[twice] + step] = True
    return out


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The \\n-split lines of all texts, offsets of each text in them, and of each line its words and hash.

    A line's hash is of its words in lower case, single spaces between; one without words has no meaningful hash.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets, words = words_of(lines)
    plain = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.utf8_lower(words).cast(pa.string())), " ").dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in plain.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(plain.dictionary)).view(np.int64)
    return lines, at - at[0], np.diff(offsets), hashes[plain.indices.to_numpy()]


def statistics(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """doc_id, host, the counts of each text and, per distinct line, hash and words in all its places."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST)).alias("host"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = lambda x: pa.array(x, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            texts, n = batch.column("text"), batch.num_rows
            offsets, words = words_of(texts)
            per = np.diff(offsets)
            owner = np.repeat(np.arange(n), per)
            chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            repeats = np.bincount(owner[_in_repeats(owner, codes)], minlength=n)

            lines, at, line_words, whole = _lines(texts)
            line_owner, full = np.repeat(np.arange(n), np.diff(at)), line_words > 0
            line_codes = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
            dup = np.bincount(line_owner[full][_seen_before(line_owner[full], line_codes[full])], minlength=n)

            o, h, w = line_owner[full], whole[full], line_words[full]
            order = np.lexsort((h, o))
            o, h, w = o[order], h[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])) if len(o) else np.zeros(0, np.int64)
            sums = np.add.reduceat(w, first) if len(o) else w
            ends = np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), long(per), long(chars[offsets[1:]] - chars[offsets[:-1]]), pc.cast(pc.count_substring_regex(texts, SYMBOLS), pa.int64()), long(dup), long(repeats)]
                + [pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([long(h[first]), pa.array(sums, pa.int32())], ["hash", "words"]))],
                ["doc_id", "host", *STATS, "lines"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + "".join(f"{c} long, " for c in STATS) + "lines array<struct<hash:long,words:int>>")


def frequent_lines(stats: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, least: int = LINE_LEAST) -> DataFrame:
    """(host, hash) of the lines in more than `documents` documents of their host.

    Every row is a document, and a line counts once in it. In a host of fewer than
    documents / share documents the share is the limit, but `least` at the lowest.
    The counts are summed where the rows lie before they are shuffled.
    """
    lines = stats.select("host", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > min(least, documents))
    hosts = stats.groupBy("host").agg(F.count("*").alias("documents"))
    limit = F.least(F.lit(documents), F.greatest(F.lit(least), share * F.col("documents")))
    return small_join(lines, kept(hosts), ["host"]).where(F.col("n") > limit).select("host", "hash")


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, left: float = LEFT_SHARE) -> DataFrame:
    """One row per document: the counts, base_failed, words_left and kept.

    The lines of frequent_lines are removed; a document that keeps less than `left`
    of its words, or fewer than the LEAST_WORDS of the base rules, is rejected. All
    rows are documents, copies too, so a text is rejected for standing in one host
    too often. A null text has no words and fails the base rules; null hosts are one
    host; repeated rows count and are judged each; no rows give none.
    """
    stats = kept(statistics(docs, id_col, host_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    flagged = kept(frequent_lines(stats, documents, share))
    lines = stats.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    removed = small_join(lines, flagged, ["host", "hash"]).groupBy("row").agg(F.sum("words").alias("removed"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words_left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    out = stats.drop("lines").join(removed, "row", "left").withColumn("words_left", words_left).withColumn("base_failed", failed)
    return out.select("doc_id", *STATS, "base_failed", "words_left", (~F.col("base_failed") & (F.col("words_left") >= left * F.col("n_words")) & (F.col("words_left") >= LEAST_WORDS)).alias("kept"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """docs with the too frequent lines of each host removed from the text; other columns stay.

    A null text stays null; a text of such lines alone becomes empty. Lines of
    other texts stay as they are, those without words too.
    """
    own = docs.withColumn("evidra_host", F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST))).withColumn("evidra_digest", F.unhex(F.md5(text_of(text_col))))
    stats = kept(statistics(own, "evidra_digest", host_col, text_col))
    flagged = kept(frequent_lines(stats, documents, share))
    # of each host and text the hashes of its lines that go; rows that share both have the same answer
    lines = stats.dropDuplicates(["host", "doc_id"]).select("host", "doc_id", F.explode("lines.hash").alias("hash"))
    gone = small_join(lines, flagged, ["host", "hash"], "left_semi").groupBy(F.col("host").alias("evidra_host"), F.col("doc_id").alias("evidra_digest")).agg(F.collect_set("hash").alias("evidra_gone"))
    rows = small_join(own, kept(gone), ["evidra_host", "evidra_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            texts, gone = batch.column(text_col), batch.column("evidra_gone")
            lines, at, words, hashes = _lines(pc.fill_null(texts, ""))
            lines, out = lines.to_pylist(), texts.to_pylist()
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                own = slice(at[i], at[i + 1])
                away = (words[own] > 0) & np.isin(hashes[own], gone[int(i)].values.to_numpy())
                if out[i] is not None and away.any():
                    out[i] = "\n".join(x for x, a in zip(lines[own], away) if not a)
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, texts.type)).select(docs_columns)

    docs_columns = docs.columns
    return rows.select(*docs_columns, "evidra_gone").mapInArrow(run, docs.schema)
