"""Passages that an earlier document holds, found by suffix automata of reference shards.

A window is WIDTH consecutive words of one document, a word a 64-bit code. The work
must grow with the corpus, not with its square, so no automaton meets all documents:
windows meet where their content sends them.

1. Of each window the least hash of its WIDTH - ANCHOR + 1 runs of ANCHOR words is its
   anchor. Equal windows have equal anchors, and neighbours mostly share theirs, so a
   document falls into segments: stretches of windows of one anchor.
2. Buckets of anchors find those that two documents hold; each returns its part of a
   bitmap, 16 MB at most in all. It is broadcast, and segments whose anchor has no bit
   are dropped; where the bitmap is too full to tell much, more segments go on, none less.
3. Equal segments are one (a group of copies costs one), and know the least identifier
   that holds them. A segment alone under its anchor meets no other.
4. The rest are dealt by anchor to reference shards of bounded size. A shard takes its
   segments by rising identifier, streams each through the suffix automaton of those
   before it for the matching statistics, and adds the stretches that had no match of
   WIDTH words. A state knows the identifier that made it, the least one of its windows.
   An anchor with too many segments for a shard (a line that most documents hold, with
   ever other neighbours) is dealt by single windows instead.
5. Each document takes its segments' answers; windows of a lesser identifier cover its
   words in maximal spans, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, measured, remove, small_join, text_of
from .decontaminate import bitmap
from .tokens import slices

#: Words of a window, and of the runs whose least hash is its anchor.
WIDTH, ANCHOR = 13, 5
#: Windows of a segment, at most.
RUN = 32
#: Bytes of text for each bucket of anchors and of bitmap; bits of the bitmap for each byte of text, as long as it grows.
BUCKET_BYTES, BITMAP_BYTES, BITS_A_BYTE = 128 << 20, 16 << 20, 0.25
#: Segments of an anchor up to which it stays in one shard, and bytes of word codes of a shard.
FULL, SHARD_BYTES = 4096, 1 << 20
#: The place of a missing identifier: after all others.
LAST = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_at(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes of texts that end at `ends`, and the first word of each text (and their number)."""
    space = _SPACE[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:] = np.append(space[:-1], True) if len(data) else True
    cut[ends] = True
    starts = np.flatnonzero(~space & cut[:-1])
    after = np.append(space[1:], True) if len(data) else space
    after[ends[(ends > 0) & (ends <= len(data))] - 1] = True
    stops = np.flatnonzero(~space & after) + 1
    return starts, stops, np.concatenate([[0], np.searchsorted(starts, ends)])


def codes_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit codes of words, eight bytes of all words at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    sizes = stops - starts
    out = _mixed(sizes.astype(np.uint64) + _ODD)
    long = np.flatnonzero(sizes > 256)
    open_ = np.flatnonzero(sizes <= 256)
    at = 0
    while len(open_):
        left = sizes[open_] - at
        part = eight[starts[open_] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        out[open_] = _mixed((out[open_] ^ part) * _ODD)
        at += 8
        open_ = open_[left > 8]
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes())
    return out


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts, and the offset of each text in them (n + 1)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, stops, first = words_at(data, offsets[1:] - offsets[0])
    return codes_of(data, starts, stops), first


def _runs_hashed(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = (out + codes[i : i + n]) * _ODD
    return _mixed(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def segments(codes: np.ndarray, first: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: its text's number, first word, number of windows and anchor."""
    none = np.zeros(0, np.int64)
    if len(codes) < width:
        return none, none, none, np.zeros(0, np.uint64)
    least = _least(_runs_hashed(codes, anchor), width - anchor + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + width <= first[1:][owner])
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    least, owner = least[at], owner[at]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
    begins = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % RUN == 0
    begins = np.flatnonzero(new)
    return owner[begins], at[begins], np.diff(np.append(begins, len(at))), least[begins]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array of consecutive stretches of values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _stretches(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of values, one after the other."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text): what tells rows apart here; equal rows have equal answers."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def shared_anchors(rows: DataFrame, buckets: int, bits: int, width: int, anchor: int) -> list[bytes]:
    """Of each bucket its part of the bitmap of anchors that two identifiers hold: bits, a power of two, for each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            owner, _, _, anchors = segments(*coded(batch.column("text")), width, anchor)
            ids = batch.column("id").to_numpy()[owner]
            order = np.lexsort((ids, anchors, anchors % np.uint64(buckets)))
            anchors, ids = anchors[order], ids[order]
            if not len(anchors):
                continue
            begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            twice = ids[begins] != ids[np.append(begins[1:], len(ids)) - 1]
            anchors, ids = anchors[begins], np.where(twice, -1 - ids[begins], ids[begins])  # below zero: two identifiers already
            bucket = (anchors % np.uint64(buckets)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            counts = np.diff(np.append(starts, len(bucket)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), _binaries(anchors, counts), _binaries(ids, counts)], ["bucket", "anchors", "ids"])

    def met(table: pa.Table) -> pa.Table:
        anchors = np.frombuffer(b"".join(table["anchors"].to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        order = np.lexsort((ids, anchors))
        anchors, ids = anchors[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        found = (ids[begins] < 0) | (ids[begins] != ids[np.append(begins[1:], len(ids)) - 1])
        bitmap = np.zeros(bits, np.uint8)
        bitmap[_bit(anchors[begins][found], buckets, bits)] = 1
        return pa.table({"bucket": table["bucket"][:1], "bitmap": pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())})

    pieces = rows.mapInArrow(made, "bucket long, anchors binary, ids binary").groupBy("bucket").applyInArrow(met, "bucket long, bitmap binary")
    parts = [bytes(bits // 8)] * buckets
    for r in pieces.toLocalIterator():  # BITMAP_BYTES in all
        parts[r["bucket"]] = bytes(r["bitmap"])
    return parts


def _bit(anchors: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    return (_mixed(anchors // np.uint64(buckets)) & np.uint64(bits - 1)).astype(np.int64)


def candidate_segments(rows: DataFrame, parts, buckets: int, bits: int, width: int, anchor: int) -> DataFrame:
    """(anchor, segment, id, hash, pos, n, codes): segments whose anchor has its bit; codes only once for equal segments of a batch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(parts.value, np.uint8)
        for batch in slices(batches, limit=4 << 20):
            codes, first = coded(batch.column("text"))
            owner, at, n, anchors = segments(codes, first, width, anchor)
            bit = (anchors % np.uint64(buckets)).astype(np.int64) * bits + _bit(anchors, buckets, bits)
            found = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            owner, at, n, anchors = owner[found], at[found], n[found], anchors[found]
            if not len(found):
                continue
            words = n + width - 1
            within = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
            content = _mixed(_stretches(codes, at, words) + _mixed(within.astype(np.uint64) + _ODD))
            segment = _mixed(np.add.reduceat(content, np.cumsum(words) - words) + n.astype(np.uint64))
            _, new = np.unique(np.stack([anchors, segment]), axis=1, return_index=True)
            own = np.zeros(len(found), bool)
            own[new] = True
            sizes = np.where(own, words, 0)
            texts = _binaries(_stretches(codes, at, sizes), sizes)
            texts = pc.if_else(pa.array(own), texts, pa.scalar(None, pa.binary()))
            long = lambda x: pa.array(x.view(np.int64))
            columns = [long(anchors), long(segment), batch.column("id").take(pa.array(owner)), batch.column("hash").take(pa.array(owner)), pa.array((at - first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), texts]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "id", "hash", "pos", "n", "codes"])

    return rows.mapInArrow(made, "anchor long, segment long, id long, hash long, pos int, n int, codes binary")


class Automaton:
    """A suffix automaton of several strings, each state with the mark of the string that made it.

    Strings are added by rising mark, so a state's mark is the least of the strings that hold its substrings.
    """

    def __init__(self, width: int):
        self.width, self.next, self.link, self.length, self.mark = width, [{}], [-1], [0], [0]

    def stream(self, codes: list[int]) -> list[int | None]:
        """Matching statistics, cut at the width: for each window the mark of its state, None without a match of that length."""
        following, link, length, mark, width = self.next, self.link, self.length, self.mark, self.width
        out, state, matched = [], 0, 0
        for code in codes:
            to = following[state].get(code)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(code)
            if to is None:
                out.append(None)
                continue
            state, matched = to, matched + 1
            while length[link[state]] >= width:
                state = link[state]
            matched = min(matched, length[state])
            out.append(mark[state] if matched >= width else None)
        return out[width - 1 :]

    def _state(self, following: dict, link: int, length: int, mark: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.mark.append(mark)
        return len(self.next) - 1

    def _parted(self, before: int, code: int, at: int) -> int:
        """The state of `before` and code alone, parted from the longer strings of state `at`."""
        own = self._state(dict(self.next[at]), self.link[at], self.length[before] + 1, self.mark[at])
        self.link[at] = own
        while before >= 0 and self.next[before].get(code) == at:
            self.next[before][code] = own
            before = self.link[before]
        return own

    def add(self, codes: list[int], mark: int) -> None:
        last = 0
        for code in codes:
            at = self.next[last].get(code)
            if at is not None:
                last = at if self.length[at] == self.length[last] + 1 else self._parted(last, code, at)
                continue
            new, before = self._state({}, 0, self.length[last] + 1, mark), last
            while before >= 0 and code not in self.next[before]:
                self.next[before][code] = new
                before = self.link[before]
            if before >= 0:
                at = self.next[before][code]
                self.link[new] = at if self.length[at] == self.length[before] + 1 else self._parted(before, code, at)
            last = new


def firsts(strings: list[tuple[int, list[int]]], width: int) -> list[list[int]]:
    """For (mark, codes) by rising mark: for each window the least mark of a string that holds it, its own included."""
    automaton, out = Automaton(width), []
    for mark, codes in strings:
        found = automaton.stream(codes)
        at = 0
        while at < len(found):
            if found[at] is not None:
                at += 1
                continue
            to = at
            while to < len(found) and found[to] is None:
                to += 1
            automaton.add(codes[at : to + width - 1], mark)
            at = to
        out.append([mark if f is None else f for f in found])
    return out


def _in_shards(units: DataFrame, width: int) -> DataFrame:
    """(anchor, segment, firsts) of the units (anchor, segment, deal, least, most, codes) with a window of a lesser identifier, dealt to shards by `deal`."""
    spark = units.sparkSession
    size = units.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("least")
        strings = [(mark, np.frombuffer(codes, np.uint64).tolist()) for mark, codes in zip(table["least"].to_pylist(), table["codes"].to_pylist())]
        found = firsts(strings, width)
        told = pa.array([min(f) < most for f, most in zip(found, table["most"].to_pylist())], pa.bool_())
        return pa.table({"anchor": table["anchor"], "segment": table["segment"], "firsts": pa.array(found, pa.list_(pa.int64()))}).filter(told)

    dealt = units.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "anchor long, segment long, firsts array<long>")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, full: int = FULL) -> DataFrame:
    """(id, hash, starts, stops): the maximal stretches of words, of rows that have some, in windows of a lesser identifier."""
    spark = docs.sparkSession
    rows = _rows_of(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    bits = 1 << max(6, int(min(8 * BITMAP_BYTES, total * BITS_A_BYTE) / buckets).bit_length() - 1)
    sent = spark.sparkContext.broadcast(b"".join(shared_anchors(rows, buckets, bits, width, anchor)))
    found = kept(candidate_segments(rows, sent, buckets, bits, width, anchor))

    key = ["anchor", "segment"]
    ranges = [F.min("id").alias("least"), F.max("id").alias("most")]
    distinct = found.groupBy(*key).agg(*ranges, F.first("n").alias("n"))
    under = distinct.groupBy("anchor").agg(F.count("*").alias("segments"), *[getattr(F, f)(c).alias(c) for f, c in (("min", "segment"), ("min", "least"), ("max", "most"), ("max", "n"))])
    under = kept(under.where("least < most"))
    alone = under.where("segments = 1").select(*key, F.expr("array_repeat(least, n)").alias("firsts"))

    # The codes of segments that others share the anchor of; what the bitmap lets through besides has an answer too.
    several = under.where("segments > 1").select(F.col("anchor").alias("hash"))
    may = bitmap(several, several.count())
    units = found.where(may(F.col("anchor"))).groupBy(*key).agg(*ranges, F.first("n").alias("n"), F.first("codes", ignorenulls=True).alias("codes"))
    units = kept(small_join(units, under.where(F.col("segments") > full).select("anchor", F.lit(True).alias("hot")), ["anchor"], "left"))
    crowded = units.where("hot")
    windows = crowded.select(*key, "least", "most", "codes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(*key, "least", "most", "i", F.expr(f"substring(codes, 8 * i + 1, {8 * width})").alias("codes")).withColumn("window", F.xxhash64("codes"))
    single = windows.groupBy("anchor", F.col("window").alias("segment")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("codes").alias("codes"))
    columns = lambda df, deal: df.select(*key, F.col(deal).alias("deal"), "least", "most", "codes")
    by_segment = _in_shards(columns(units.where("hot is null"), "anchor"), width)
    if not crowded.isEmpty():
        answered = _in_shards(columns(single, "segment"), width).select("anchor", F.col("segment").alias("window"), F.get("firsts", F.lit(0)).alias("first"))
        # a window without an answer is no other's: it counts from its own identifier on
        told = windows.select(*key, "i", "window", "most").join(answered, ["anchor", "window"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("first", F.lit(LAST)).alias("first")))).alias("told"))  # RUN windows at most
        by_segment = by_segment.union(told.select(*key, F.transform("told", lambda x: x["first"]).alias("firsts")).where(F.array_min("firsts") < LAST))
    useful = kept(alone.union(by_segment))
    for table in (under, units):
        remove(table)

    hits = small_join(found.drop("codes", "n"), useful, key, size=measured(useful))
    hits = hits.select("id", "hash", F.expr("filter(transform(firsts, (f, i) -> if(f < id, pos + i, null)), x -> x is not null)").alias("hit")).where(F.size("hit") > 0)
    per = hits.groupBy("id", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column("hit")
            at, ends = hit.flatten().to_numpy(), hit.offsets.to_numpy() - hit.offsets[0].as_py()
            if not len(at):
                continue
            new = np.concatenate([[True], at[1:] > at[:-1] + width])
            new[ends[:-1]] = True
            begins = np.flatnonzero(new)
            to = np.searchsorted(begins, ends).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(to), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), lists(at[begins]), lists(at[np.append(begins[1:], len(at)) - 1] + width)], ["id", "hash", "starts", "stops"])

    return kept(per.mapInArrow(covered, "id long, hash long, starts array<int>, stops array<int>"))


def _left(text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[int, list[bytes]]:
    words = text.split()
    if not starts:
        return len(words), words
    left, at = [], 0
    for a, b in zip(starts, stops):
        left += words[at:a]
        at = b
    return len(words), left + words[at:]


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digest: bool = False, **options) -> DataFrame:
    """docs with n_words, n_removed and the words that are left: in the text itself, or with digest as kept_sha256.

    Words are runs without ASCII white space. A word goes if it lies in a window of
    `width` words that also starts in a row of lesser identifier (an integer). A null
    text has no words and stays null; one of fewer than `width` words loses none.
    Rows of one identifier don't remove from each other, nor do a row's own repeats;
    a missing identifier counts as greater than all others. Repeated rows have equal
    results, each. Texts may be of any length. No rows give none. Texts that lose
    words have their words joined by one space, the others stay as they are. The
    columns evidra_id and evidra_hash are used inside; own columns replace those of
    the same names in docs.
    """
    found = spans(docs, id_col, text_col, width, **options)
    rows = docs.withColumn("evidra_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("evidra_hash", F.xxhash64(text_of(text_col)))
    rows = small_join(rows, found.withColumnsRenamed({"id": "evidra_id", "hash": "evidra_hash", "starts": "evidra_starts", "stops": "evidra_stops"}), ["evidra_id", "evidra_hash"], "left")
    own = ["n_words", "n_removed", *(["kept_sha256"] if digest else [])]
    names = [c for c in docs.columns if c not in own and not (digest and c == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            n_words, n_removed, out = [], [], []
            for text, starts, stops in zip(batch.column(text_col).cast(pa.large_binary()).to_pylist(), batch.column("evidra_starts").to_pylist(), batch.column("evidra_stops").to_pylist()):
                n, left = _left(text or b"", starts, stops)
                n_words.append(n)
                n_removed.append(n - len(left))
                if digest:
                    out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    out.append(b" ".join(left).decode("utf-8", "replace") if len(left) < n else text and text.decode("utf-8", "replace"))
            columns = {c: batch.column(c) for c in names} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), ("kept_sha256" if digest else text_col): pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    order = [*names, *own]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), *(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in own)])
    return rows.select(*dict.fromkeys([*docs.columns]), "evidra_starts", "evidra_stops").mapInArrow(run, schema)
