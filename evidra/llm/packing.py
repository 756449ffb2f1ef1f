"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Documents are encoded whole and cut into pieces: full windows, then what is left.
A piece of a full window is a sequence of its own and is not shuffled. The others are
dealt to blocks by a hash of the piece's number and each block is divided among k windows by the multiway differencing
method: every piece starts as a partition with that piece in one window; the two
partitions of largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one partition is left. k begins at the least number
that could hold the block and rises whenever a window exceeds the capacity.

Nearly equal windows need small pieces to even them out, so a fixed share of the
rests, chosen by a hash of the ids, is cut into ever finer pieces. The cuts depend
on the text alone; which pieces meet in a block also on how the input lies in tasks,
so rows that repeat one identifier or text a million times still fill many blocks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, text_of
from .tokens import ENCODED_BYTES, default_vocabulary, encoder_of, slices, with_end

CAPACITY = 2048
#: Windows in a block, about: bounds a task's memory and the differencing's cost.
BLOCK_WINDOWS = 192
#: One document in this many has its rest cut fine: a quarter of what is left at a time, and this many tokens at most.
FINE_EVERY, FINE_TOKENS = 8, 128


def fine_starts(start: int, end: int) -> list[int]:
    out = []
    while start < end:
        out.append(start)
        start += max(1, min(FINE_TOKENS, (end - start) // 4))
    return out


def differencing(sizes: list[int], k: int) -> tuple[list[list[int]], list[int]]:
    """k windows as lists of positions in sizes, and their sums."""
    if k == 1:
        return [list(range(len(sizes)))], [sum(sizes)]
    # A partition is its windows' sums, fullest first, and for each a chain of positions; all-empty windows are left out.
    heap = [(-s, i, [s], [(i, None)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            sums, chains = a + b, of_a + of_b
        else:
            # windows beyond k - len(b) of a are merged with the fullest of b in opposite order
            both = len(a) + len(b) - k
            head_a, tail_a = len(a) - both, a[len(a) - both :]
            sums = a[:head_a] + [x + y for x, y in zip(tail_a, reversed(b[len(b) - both :]))] + b[: len(b) - both]
            chains = of_a[:head_a] + [(p, q) for p, q in zip(of_a[head_a:], reversed(of_b[len(b) - both :]))] + of_b[: len(b) - both]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, chains = [sums[i] for i in order], [chains[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), serial, sums, chains))
        serial += 1
    _, _, sums, chains = heap[0]
    windows = []
    for chain in chains:
        stack, own = [chain], []
        while stack:
            p, q = stack.pop()
            for x in (p, q):
                if isinstance(x, tuple):
                    stack.append(x)
                elif x is not None:
                    own.append(x)
        windows.append(sorted(own))
    return windows + [[] for _ in range(k - len(windows))], sums + [0] * (k - len(sums))


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity: as few as the differencing manages, counting up from the least possible."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows, sums = differencing(sizes, k)
        if max(sums, default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """Values that lie one behind the other in data, each ending where ends says."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data)])


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, number and whole of every piece.

    ids are little-endian, of two bytes where the vocabulary allows, else of four.
    number is unlike any other piece's; a task that runs again gives the same ones.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in slices(batches, limit=ENCODED_BYTES):
            encoder = encoder_of(vocabulary)
            ids, offsets = with_end(*encoder.ids(batch.column("text")), end_id)
            ids = ids.astype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            width, data = ids.itemsize, ids.tobytes()
            view, row, starts = memoryview(data), [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                full = (b - a) // capacity * capacity
                fine = zlib.crc32(view[a * width : b * width]) % FINE_EVERY == 0
                own = [*range(0, full, capacity), *(fine_starts(full, b - a) if fine else [full] if full < b - a else [])]
                starts += own
                row += [i] * len(own)
            row, starts = np.array(row, np.int64), np.array(starts, np.int64)
            first = offsets[:-1][row] + starts
            length = np.diff(first, append=len(ids))
            numbers = np.arange(number, number + len(row))
            number += len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (starts, length, np.diff(offsets)[row])), _binary(data, (first + length) * width), pa.array(numbers), pa.array(length == capacity)],
                ["doc_id", "start", "length", "doc_tokens", "ids", "number", "whole"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, number long, whole boolean")


def _wide(ids: pa.Array, length: np.ndarray) -> pa.Array:
    """ids of two bytes made ids of four."""
    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False)
    if not len(ids) or not (sizes == 2 * length).all():
        return ids
    data = np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype("<u4").tobytes()
    return _binary(data, np.cumsum(4 * length))


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", _wide(batch.column("ids"), batch.column("length").to_numpy()))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Pieces of a sequence stand in the order of their numbers, that of the input in
    each task. A null text has the end id alone. Repeated rows are packed each;
    identifiers are only carried, null ones too. Blocks take pieces by a hash of
    their numbers, so no identifier, text or source fills one. No rows give none.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = kept(pieces_of(docs, id_col, text_col, vocabulary, end_id, capacity), by="whole")
    rest = pieces.where("not whole")
    left = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = max(1, round(left / capacity / block_windows))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def packed(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("number")
        sizes = block.column("length").to_numpy()
        windows = windows_of(sizes.tolist(), capacity)
        row = np.array([i for w in windows for i in w], np.int64)
        number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        offset = np.concatenate([np.cumsum(sizes[w]) - sizes[w] for w in windows])
        sequence = (block.column("block").to_numpy()[0] << 32) + number
        block = block.take(pa.array(row)).combine_chunks()
        block = block.set_column(block.schema.get_field_index("ids"), "ids", _wide(block.column("ids").combine_chunks(), block.column("length").to_numpy()))
        return block.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).select(columns)

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("long")).drop("whole")
    alone = pieces.where("whole").withColumn("sequence_id", -1 - F.col("number")).withColumn("offset", F.lit(0).cast("long"))
    # each branch has one Python stage, so a task never needs two workers at once
    return alone.select(*columns).mapInArrow(_widened, schema).union(dealt.groupBy("block").applyInArrow(packed, schema))
