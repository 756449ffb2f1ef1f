"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in three segments of at most 23 bits. The binary
Golay code of length 23 is perfect: each 23-bit word lies within 3 bits of just
one of 4,096 codewords. The keys of a segment are the codewords of the word and
of its 23 neighbours: one or six of them, and two words that differ in two bits
or fewer share a key, for the word between them has the same codeword.

If two fingerprints differ in two bits or fewer, one of three segments is equal
(pigeonhole). A candidate key is thus an equal segment with a Golay key of the
next one. Candidates meet by a join on the key and are verified by the bit count.
No link is lost.

A key that many distinct fingerprints share is split by what else the decoder
returns. Where it decodes a neighbour of the word it gives the codeword, which is
the key, and the error pattern; both together name the neighbour. With codeword and
error pattern of the third segment's word beside them (of its neighbours, where the
second segment's word was taken as it is), the split key names a word within one bit
of the fingerprint. Fingerprints that differ in two bits or fewer share the word
between them, and a split key has 46 fingerprints at most, all true links of each
other; they are linked to the least of them, so the links grow in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, released, small_join, text_of
from .components import components
from .tokens import slices

#: Generator of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of one key up to which they are paired; a fuller key is split.
PAIRED = 6


def fingerprint(text: str | None) -> int:
    """One text's fingerprint, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
    return _fold(h, np.array([0]), np.array([len(h)]))[0]


def _fold(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> list[int]:
    """Fingerprints of consecutive runs of hashes."""
    counts = np.zeros((len(starts), 64), np.int64)
    for at in range(0, len(h), block):
        part = h[at : at + block]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.clip(starts - at, 0, len(part)), np.clip(ends - at, 0, len(part))
        own = np.flatnonzero(b > a)
        if len(own):
            counts[own] += np.add.reduceat(bits, a[own], axis=0, dtype=np.int64)
    over = 2 * counts > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null and wordless texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, digest = b" ", xxhash.xxh64_intdigest
        for batch in slices(batches, limit=2 << 20):
            hashes, ends = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.lower().split()
                n = len(words)
                if n > 2:
                    line = space.join(words)
                    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                    starts = stops[:-2] - np.fromiter(map(len, words[:-2]), np.int64, n - 2)
                    hashes += [digest(line[a:b], 42) for a, b in zip(starts.tolist(), stops[2:].tolist())]
                elif n:
                    hashes.append(digest(space.join(words), 42))
                ends.append(len(hashes))
            ends = np.array(ends, np.int64)
            fps = _fold(np.array(hashes, "<u8"), np.concatenate([[0], ends[:-1]]), ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(released(hashed), f"doc_id {kind}, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: the words' remainders by the generator polynomial."""
    words = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    return words


class Golay:
    """Decodes 23-bit words: the nearest codeword's index is its upper 12 bits."""

    def __init__(self):
        one = 1 << np.arange(23)
        errors = [np.zeros(1, np.int64), one]
        two = (one[:, None] | one)[np.triu_indices(23, 1)]
        three = {int(a | b) for a in two for b in one if not a & b}
        errors = np.concatenate([*errors, two, np.array(sorted(three), np.int64)])
        self.leader = np.zeros(2048, np.int64)
        self.leader[_remainder(errors)] = errors

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[_remainder(words)]) >> 11

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 24) indices of each word and its neighbours."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
        return self.index(near.ravel()).reshape(near.shape)


def golay_keys(fps: DataFrame) -> DataFrame:
    """(fp, key): the candidate keys of each fingerprint, without repeats."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy()
            part = _segments(fp)
            out = []
            for i in range(3):
                near = np.sort(code.keys(part[(i + 1) % 3]), axis=1)
                new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                row, col = np.nonzero(new)
                out.append((row, (part[i][row] << 14) | (near[row, col] << 2) | i))
            row, key = np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key)], ["fp", "key"])

    return fps.select("fp").mapInArrow(released(made), "fp long, key long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def split_keys(full: DataFrame) -> DataFrame:
    """(fp, key, split) for (fp, key): codeword and error patterns of the words within one bit that decode to the key."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        flips = lambda n: np.concatenate([[0], 1 << np.arange(n)])
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = batch.column("fp").to_numpy(), batch.column("key").to_numpy()
            part, out = _segments(fp), []
            for i in range(3):
                (j, k), own = ((i + 1) % 3, (i + 2) % 3), np.flatnonzero(key & 3 == i)
                near = part[j][own][:, None] ^ flips(SEGMENTS[j][1])
                row, col = np.nonzero(code.index(near.ravel()).reshape(near.shape) == ((key[own] >> 2) & 0xFFF)[:, None])
                word, third = near[row, col], part[k][own][row]
                # where the second segment is as it is, the third one's neighbours count too
                free = np.flatnonzero(col == 0)
                more = third[free][:, None] ^ flips(SEGMENTS[k][1])[1:]
                at = np.concatenate([np.arange(len(row)), np.repeat(free, more.shape[1])])
                word, third = word[at], np.concatenate([third, more.ravel()])
                out.append((own[row[at]], (_remainder(word) << 23) | (code.index(third) << 11) | _remainder(third)))
            at, split = np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(key[at]), pa.array(split)], ["fp", "key", "split"])

    return full.select("fp", "key").mapInArrow(released(made), "fp long, key long, split long")


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) among distinct fingerprints: links that join all that differ in two bits or fewer.

    Pairs of a key with at most `paired` fingerprints come as they are. Fuller keys
    are split and the fingerprints of a split key linked to the least of them; all
    those links are true ones too. Together they connect just what the links of all
    pairs connect, whatever `paired` is.
    """
    keys = kept(golay_keys(fps))
    sizes = kept(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = kept(small_join(keys, sizes, ["key"]))
    few = shared.where(F.col("n") <= paired)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    split = split_keys(shared.where(F.col("n") > paired))
    stars = split.withColumn("a", F.min("fp").over(Window.partitionBy("key", "split"))).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row.

    Fingerprints link at two differing bits or fewer. Equal fingerprints are one
    node, so exact copies cost nothing beyond a grouped minimum. Empty, null and
    wordless texts have fingerprint zero and link as any other. Repeated rows are
    kept; a null doc_id is never the least one (a class of null identifiers alone
    has a null component_id). No rows give no rows.
    """
    rows = kept(fingerprints(docs, id_col, text_col))
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes)).select(F.col("node").alias("fp"), "label")
    classed = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = kept(classed.groupBy("label").agg(F.min("least").alias("component_id")))
    table = classed.select("fp", "label").join(least, "label").select("fp", "component_id")
    return small_join(rows, kept(table), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the least identifier.

    Rows without identifier come after all others of their group, the one of
    least text hash first; so do rows of one identifier among themselves. Rows that
    share an identifier but not a text are judged each by its own text. Of rows
    that share both one stays.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"))
    rows = docs.withColumn("evidra_key", key)
    found = kept(near_duplicates(rows.select("evidra_key", F.col(text_col).alias("evidra_text")), "evidra_key", "evidra_text").select(F.col("doc_id").alias("evidra_key"), "component_id"))
    gone = kept(found.where(F.col("evidra_key") != F.col("component_id")).select("evidra_key").distinct())
    out = small_join(rows, gone, ["evidra_key"], "left_anti")
    if found.groupBy("evidra_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["evidra_key"])
    return out.select(*docs.columns)
