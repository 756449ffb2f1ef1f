"""Minimax contiguous sharding of documents, equal texts kept together.

Atomic groups are the equal texts. They stand in the order of a 60-bit digest of
the text, so a run of neighbours is a range of digests and a document finds its
shard by comparing its digest with the cuts: assigning needs no join and no
shuffle of texts.

The smallest feasible capacity is found by binary search with a greedy check.
The check runs on a histogram of digest ranges whose number is bounded whatever
the corpus; ranges in which a cut may fall are split further, on the cluster,
until the capacity at which whole ranges fit equals the one at which ranges may
be cut anywhere. Then no finer histogram can lower it and the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, text_of

DIGEST_BITS = 60


class Cells:
    """Ordered digest ranges: start, bits of width, bytes, groups, largest group."""

    def __init__(self, start, width, size, groups, largest):
        order = np.argsort(start)
        self.start, self.width, self.size, self.groups, self.largest = (np.asarray(x, np.int64)[order] for x in (start, width, size, groups, largest))
        self.sums = np.concatenate([[0], np.cumsum(self.size)])
        self.atomic = self.groups <= 1

    def whole(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts (as cell numbers) that take whole cells, or None."""
        cuts, at, n = [], 0, len(self.size)
        while at < n:
            to = int(np.searchsorted(self.sums, self.sums[at] + capacity, side="right")) - 1
            if to == at or len(cuts) == shards:
                return None
            cuts.append(to)
            at = to
        return cuts

    def fluid(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts (as bytes) if cells of several groups could be cut anywhere, or None."""
        if capacity < self.largest.max(initial=0):
            return None
        cuts, at = [], 0
        while at < self.sums[-1]:
            if len(cuts) == shards:
                return None
            to = min(at + capacity, int(self.sums[-1]))
            cell = int(np.searchsorted(self.sums, to, side="right")) - 1
            if to < self.sums[-1] and self.atomic[cell]:
                to = int(self.sums[cell])
            if to <= at:
                return None
            cuts.append(to)
            at = to
        return cuts

    def least(self, check, shards: int) -> int:
        low, high = max(1, -(-int(self.sums[-1]) // shards)) - 1, max(1, int(self.sums[-1]))
        while high - low > 1:
            middle = (low + high) // 2
            if check(middle, shards) is None:
                low = middle
            else:
                high = middle
        return high

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts within capacity, each as near to an equal share as the others allow.

        The last cut that leaves a feasible rest bounds each one from below, the
        capacity from above.
        """
        n, first = len(self.size), [len(self.size)]
        for _ in range(shards):
            first.append(int(np.searchsorted(self.sums, self.sums[first[-1]] - capacity, side="left")))
        cuts, at = [], 0
        for j in range(1, shards):
            low = max(at, first[shards - j])
            high = int(np.searchsorted(self.sums, self.sums[at] + capacity, side="right")) - 1
            aim = self.sums[at] + (self.sums[-1] - self.sums[at]) / (shards - j + 1)
            to = int(np.searchsorted(self.sums, aim, side="left"))
            if to > 0 and (to > n or aim - self.sums[to - 1] < self.sums[min(to, n)] - aim):
                to -= 1
            at = min(max(to, low), high)
            cuts.append(at)
        return cuts


def minimax_cuts(groups: DataFrame, shards: int, bits: int = 14, finer_bits: int = 4) -> tuple[list[int], int]:
    """Digests at which shards 1, 2, ... begin, and the smallest feasible capacity.

    groups has digest and size, one row per group. What reaches the driver is the
    histogram: 2**bits cells, then 2**finer_bits for each cell a cut may cross.
    """

    def counted(rows: DataFrame, width: int):
        cell = F.shiftright("digest", width)
        found = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest")).collect()
        return [[r.cell << width for r in found], [width] * len(found), [r.size for r in found], [r.groups for r in found], [r.largest for r in found]]

    cells = Cells(*counted(groups, DIGEST_BITS - bits))
    while True:
        low, high = cells.least(cells.fluid, shards), cells.least(cells.whole, shards)
        if low == high or cells.atomic.all():
            break
        ends = cells.sums[1:]
        open_ = np.zeros(len(ends), bool)
        a, b = cells.fluid(low, shards), cells.fluid(high, shards)
        w = [int(cells.sums[c]) for c in cells.whole(high, shards)]
        for j in range(shards):
            at = [x[min(j, len(x) - 1)] for x in (a, b, w)]
            open_ |= (ends > min(at)) & (cells.sums[:-1] <= max(at))
        open_ &= ~cells.atomic & (cells.width > 0)
        if not open_.any():
            break
        keep, parts = ~open_, [[x[~open_]] for x in (cells.start, cells.width, cells.size, cells.groups, cells.largest)]
        for width in np.unique(cells.width[open_]):
            chosen = groups.sparkSession.createDataFrame([(int(s),) for s in cells.start[open_ & (cells.width == width)] >> int(width)], "cell long")
            rows = groups.withColumn("cell", F.shiftright("digest", int(width))).join(F.broadcast(chosen), "cell", "left_semi")
            for part, new in zip(parts, counted(rows, max(0, int(width) - finer_bits))):
                part.append(new)
        cells = Cells(*(np.concatenate([np.asarray(x, np.int64) for x in part]) for part in parts))
    high = cells.least(cells.whole, shards)
    if not len(cells.start):
        return [0] * (shards - 1), high
    return [int(cells.start[c]) if c < len(cells.start) else 1 << DIGEST_BITS for c in cells.balanced(high, shards)], high


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slot_cells: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) for every row.

    Size is the UTF-8 bytes of the text plus 8. The largest shard is the smallest
    that contiguous runs of groups allow. A group larger than an equal share of
    what is left is put in a shard of its own first (no cut can lessen it) and the
    rest is divided among the other shards; within the capacity found, cuts stand
    as near to equal shares as they can.

    A null text counts as empty and is grouped with empty texts. A null doc_id is
    kept, repeated rows each get a slot. No rows give no rows; shards may be empty
    where there are fewer groups. Slots run from 0 in each shard without gaps, in
    the order of a hash of the identifier: ranks are taken within slot_cells cells
    a shard, so one large group of copies is spread over many tasks.
    """
    text = text_of(text_col)
    rows = kept(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("digest")))
    groups = kept(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = []
    for r in groups.orderBy(F.desc("size"), "digest").limit(shards).collect():
        if len(own) == shards - 1 or r["size"] * (shards - len(own)) <= total:
            break
        own.append(r["digest"])
        total -= r["size"]
    rest = groups.where(~F.col("digest").isin(own)) if own else groups
    cuts, _ = minimax_cuts(rest, shards - len(own))
    number = F.lit(len(own))
    for cut in cuts:
        number = number + (F.col("digest") >= F.lit(cut)).cast("int")
    for i, digest in reversed(list(enumerate(own))):
        number = F.when(F.col("digest") == digest, F.lit(i)).otherwise(number)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "digest"))
    # shards x slot_cells rows at most
    return placed.withColumn("rank", rank).join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
