"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard holds a contiguous range of identifiers in ascending order (a range may begin
or end inside the rows of one identifier)::

    header   magic "EVSST1\\0\\0", id width (u8: 2 or 4), 7 zero bytes
    blocks   entries: shared u8, suffix length u8, value length u32, key suffix, value
             then the offsets (u32) of the restart entries, and their number (u32)
    bloom    one bit array, double hashing of the key's xxh64
    index    for each block: last key length u8, last key, offset u64, length u64,
             tokens before the block u64
    footer   bloom offset, bloom bytes, index offset, blocks, entries, tokens (u64 each),
             hashes (u32), crc32 of bloom and index (u32), magic

A key is one byte (0: null identifier, 1: any other) and the identifier as a
big-endian integer with its sign bit flipped, so byte order is numeric order.
Restart entries store whole keys; the others only what differs from the entry
before. A look-up reads the footer, asks the Bloom filter, bisects the index,
then the restarts of one block.

Ids are stored little-endian in two bytes where the vocabulary allows, else four.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shared_dir, text_of
from .tokens import ENCODED_BYTES, default_vocabulary, encoder_of, slices, vocabulary_size, with_end

MAGIC = b"EVSST1\0\0"
HEADER, ENTRY, BLOCK_REF, FOOTER = "<8sB7x", "<BBI", "<QQQ", "<6QII8s"
#: UTF-8 bytes of text that a shard is made from, about.
SHARD_BYTES = 24 << 20
#: Keys that set the shards' ranges: so many for each shard, and in all, at most.
SAMPLED, SAMPLED_IN_ALL = 60, 1_000_000
#: Bytes of shards that a task reads.
READ_BYTES = 256 << 20
MANIFEST = "part int, path string, entries long, tokens long, bytes long, first_id long, last_id long"


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + ((identifier ^ (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    if key == b"\0":
        return None
    n = int.from_bytes(key[1:], "big") ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


class Bloom:
    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int) -> Bloom:
        made = cls(np.zeros(max(8, -(-len(keys) * bits_per_key // 8)), np.uint8), max(1, round(bits_per_key * 0.69)))
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        for i in range(made.hashes):
            at = made._at(h, i)
            np.bitwise_or.at(made.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        return made

    def _at(self, h: np.ndarray, i: int) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32))) % np.uint64(8 * len(self.bits))

    def may_hold(self, key: bytes) -> bool:
        h = np.array([xxhash.xxh64_intdigest(key)], np.uint64)
        return all(self.bits[int(at[0]) >> 3] >> (int(at[0]) & 7) & 1 for at in (self._at(h, i) for i in range(self.hashes)))


class Writer:
    """Appends entries in ascending key order to one shard."""

    def __init__(self, sink, width: int, block_bytes: int, restart_every: int, bits_per_key: int):
        self.sink, self.width, self.block_bytes, self.restart_every, self.bits_per_key = sink, width, block_bytes, restart_every, bits_per_key
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.at = self.tokens = 0
        self._put(struct.pack(HEADER, MAGIC, width))
        self._open()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _open(self) -> None:
        self.block, self.size, self.restarts, self.n, self.last, self.before = [], 0, [], 0, b"", self.tokens

    def add(self, key: bytes, value: bytes | pa.Buffer, tokens: int) -> None:
        shared = 0
        if self.n % self.restart_every == 0:
            self.restarts.append(self.size)
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = struct.pack(ENTRY, shared, len(key) - shared, tokens * self.width) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + tokens * self.width
        self.n, self.last, self.tokens = self.n + 1, key, self.tokens + tokens
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            start = self.at
            self._put(b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.index.append((self.last, start, self.at - start, self.before))
        self._open()

    def close(self) -> None:
        self._flush()
        bloom = Bloom.of(self.keys, self.bits_per_key)
        bits, refs = bloom.bits.tobytes(), b"".join(bytes([len(k)]) + k + struct.pack(BLOCK_REF, *rest) for k, *rest in self.index)
        at = self.at
        self._put(bits + refs)
        self._put(struct.pack(FOOTER, at, len(bits), at + len(bits), len(self.index), len(self.keys), self.tokens, bloom.hashes, zlib.crc32(bits + refs), MAGIC))


class Reader:
    """One shard, read a block at a time from any seekable file."""

    def __init__(self, file):
        self.file, end = file, file.size()
        magic, self.width = struct.unpack(HEADER, self._read(0, struct.calcsize(HEADER)))
        bloom_at, bloom_n, index_at, blocks, self.entries, self.tokens, hashes, crc, tail = struct.unpack(FOOTER, self._read(end - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        whole = magic == tail == MAGIC and bloom_at + bloom_n == index_at <= end - struct.calcsize(FOOTER)
        meta = self._read(bloom_at, end - struct.calcsize(FOOTER) - bloom_at) if whole else b""
        if not whole or zlib.crc32(meta) != crc:
            raise ValueError("not a whole shard")
        self.bloom = Bloom(np.frombuffer(meta[:bloom_n], np.uint8), hashes)
        self.index, at = [], bloom_n
        for _ in range(blocks):
            k = meta[at + 1 : at + 1 + meta[at]]
            self.index.append((k, *struct.unpack_from(BLOCK_REF, meta, at + 1 + len(k))))
            at += 1 + len(k) + struct.calcsize(BLOCK_REF)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entry(self, block: bytes, at: int, last: bytes) -> tuple[bytes, int, int]:
        shared, own, n = struct.unpack_from(ENTRY, block, at)
        at += struct.calcsize(ENTRY)
        return last[:shared] + block[at : at + own], at + own, n

    def _block(self, number: int) -> tuple[bytes, list[int], int]:
        _, at, n, _ = self.index[number]
        block = self._read(at, n)
        [restarts] = struct.unpack_from("<I", block, n - 4)
        end = n - 4 * (restarts + 1)
        return block, list(struct.unpack_from(f"<{restarts}I", block, end)), end

    def scan(self, number: int, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        block, _, end = self._block(number)
        yield from self._scan(block, at, end)

    def _scan(self, block: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key, kind = b"", "<u2" if self.width == 2 else "<u4"
        while at < end:
            key, at, n = self._entry(block, at, key)
            yield key, np.frombuffer(block, kind, n // self.width, at).astype(np.uint32)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for number in range(len(self.index)):
            yield from self.scan(number)

    def get(self, identifier: int | None) -> np.ndarray | None:
        """The ids of one document (the first of several rows), or None."""
        key = key_of(identifier)
        if not self.bloom.may_hold(key):
            return None
        number = bisect_left(self.index, key, key=lambda b: b[0])
        if number == len(self.index):
            return None
        block, restarts, end = self._block(number)
        first = max(0, bisect_left(restarts, key, key=lambda at: self._entry(block, at, b"")[0]) - 1)
        for k, ids in self._scan(block, restarts[first], end):
            if k >= key:
                return ids if k == key else None
        return None


def opened(path: str) -> Reader:
    fs, name = pafs.FileSystem.from_uri(path)
    return Reader(fs.open_input_file(name))


def _ranges(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """Lower ends of all shards but the first, as (not null, id, digest, serial) records in ascending order.

    They cut a sample of keys, whose size depends on the number of shards and is
    bounded, into parts of equal bytes.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    sample = rows.drop("text").sample(min(1.0, min(SAMPLED * shards, SAMPLED_IN_ALL) / max(1, n)), seed=1).toArrow()
    keys, order = _keys(sample)
    sizes = np.cumsum(sample.column("bytes").to_numpy()[order])
    at = np.searchsorted(sizes, sizes[-1] * np.arange(1, shards) / shards) if len(sizes) else []
    return np.unique(keys[order][at])


def _keys(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Records of a batch's keys, and their ascending order."""
    there = pc.is_valid(table.column("id")).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.is_valid(table.column("id")).to_numpy()
    keys = np.zeros(table.num_rows, [("there", "?"), ("id", "<i8"), ("digest", "<i8"), ("serial", "<i8")])
    keys["there"], keys["id"] = there, pc.fill_null(table.column("id"), 0).to_numpy()
    keys["digest"], keys["serial"] = table.column("digest").to_numpy(), table.column("serial").to_numpy()
    return keys, np.lexsort([keys[c] for c in reversed(keys.dtype.names)])


def write_shards(docs: DataFrame, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, block_bytes: int = 64 << 10, restart_every: int = 16, bits_per_key: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append end_id, write shards below out; returns their manifest.

    Texts are encoded where they are read and their ids are dealt by ranges of
    (identifier, text hash, place in the input), so rows without identifier or with
    one much repeated still fill many shards. A task writes each of its shards
    under a name of its own attempt; the manifest, which Spark commits once, names
    the file of the attempt that counts, and other attempts' files are deleted. A
    null text has the end id alone; a null identifier sorts first; repeated
    identifiers are kept, ordered by text hash. No rows give an empty manifest.
    """
    spark = docs.sparkSession
    out, vocabulary, run = out or shared_dir(spark), vocabulary or default_vocabulary(), uuid.uuid4().hex[:8]
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("serial"), (F.octet_length(text) + 1).alias("bytes"), text.alias("text"))
    ranges = _ranges(rows, shard_bytes)
    width = 2 if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=ENCODED_BYTES):
            encoder = encoder_of(vocabulary)
            ids, offsets = with_end(*encoder.ids(batch.column("text")), end_id)
            data = ids.astype(f"<u{width}")
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            part = np.searchsorted(ranges, _keys(batch)[0], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(batch.column(c) for c in ("id", "digest", "serial")), ids], ["part", "id", "digest", "serial", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, part, writer, first, key = TaskContext.get().taskAttemptId(), None, None, None, None
        fs, root = pafs.FileSystem.from_uri(out)
        name = lambda: f"part-{part:06d}-{run}-{attempt}.sst"
        schema = pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("entries", "tokens", "bytes", "first_id", "last_id"))])

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"part": part, "path": f"{out}/{name()}", "entries": len(writer.keys), "tokens": writer.tokens, "bytes": writer.at, "first_id": identifier_of(first), "last_id": identifier_of(key)}], schema=schema)

        for batch in batches:
            for own, doc, ids in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("ids")):
                key = key_of(doc) if own == part else key
                if own != part:
                    if writer is not None:
                        yield closed()
                    fs.create_dir(root, recursive=True)
                    part, key = own, key_of(doc)
                    first, sink = key, fs.open_output_stream(f"{root}/{name()}")
                    writer = Writer(sink, width, block_bytes, restart_every, bits_per_key)
                writer.add(key, ids.as_buffer(), ids.as_buffer().size // width)
        if writer is not None:
            yield closed()

    coded = rows.mapInArrow(encode, "part int, id long, digest long, serial long, ids binary")
    dealt = coded.repartitionById(len(ranges) + 1, "part").sortWithinPartitions("part", "id", "digest", "serial")
    manifest = kept(dealt.select("part", "id", "ids").mapInArrow(write, MANIFEST))
    _tidy(out, run, {r.path.rsplit("/", 1)[1] for r in manifest.select("path").collect()})
    return manifest


def _tidy(out: str, run: str, named: set[str]) -> None:
    """Delete the files of this run that its manifest (one row per shard) does not name."""
    fs, root = pafs.FileSystem.from_uri(out)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f"-{run}-" in f.base_name and f.base_name not in named:
            fs.delete_file(f.path)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids of all before it), n_tokens, ids (little-endian uint32).

    The manifest has one row per file; a task reads files of READ_BYTES about, block by block.
    """
    spark = manifest.sparkSession
    rows, before, size = [], 0, 0
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        rows.append((m.path, before))
        before += m.tokens
        size += m.bytes
    tasks = min(len(rows), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard, held, size = opened(path), [], 0
                for key, ids in shard:
                    held.append((identifier_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    table = spark.createDataFrame(rows, "path string, before long").repartition(max(1, tasks))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, identifiers: list[int | None]) -> dict[int | None, np.ndarray]:
    """Ids of the stated documents, by binary search in the shards whose range may hold them.

    A null identifier, which sorts first, is looked up as any other. Of several rows
    with one identifier the first counts; what no shard holds has no entry.
    """
    found, place = {}, lambda i: (i is not None, i or 0)
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        if wanted := [i for i in identifiers if place(m.first_id) <= place(i) <= place(m.last_id) and i not in found]:
            shard = opened(m.path)
            found |= {i: ids for i in wanted if (ids := shard.get(i)) is not None}
    return found
