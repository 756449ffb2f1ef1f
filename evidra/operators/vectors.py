"""An index of vectors: lists around centroids, searched by probes or exactly.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
one, and a list knows the widest angle of its members. No member can be nearer to a
query than the centroid less that angle, so a search that has k results knows which
lists can't better them: exact search probes a few lists, then those that still may.
Large lists are dealt in parts, and the queries of a list in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .merge import top_by
from .retrieve import quantised_scores, unit_rows

#: Vectors that centroids are fitted on, lists at most, members of a part and queries of a block.
SAMPLE, LISTS, PART, BLOCK = 16_384, 4096, 8192, 2048
#: What rounding may add to an angle or a score.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """members(list, part, uid, embedding), lists(list, width, parts, angle) and the centroids, unit rows, of the lists from 0 on.

    Vectors of another length than the centroids' are in a list of their own length,
    below 0; those without length or entries are in no list: they have no cosine.
    """

    members: DataFrame
    lists: DataFrame
    centroids: np.ndarray


def fitted(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly chosen rows; lists that run empty keep their last centre."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(rounds if len(sample) else 0):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, part: int = PART) -> VectorIndex:
    """The index of vectors(uid, embedding); lists: how many, the root of the number of vectors if not said, LISTS at most.

    The sample is of rows whose hash is least, so it doesn't depend on partitions. The
    index is written; null, empty and zero vectors are left out.
    """
    rows = vectors.select("uid", F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    rows = rows.where(F.exists("embedding", lambda c: c != 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c)))
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (widths["width"], widths["count"]) if widths else (1, 0)
    some = rows.where(F.size("embedding") == width).orderBy(F.xxhash64("uid"), "uid").limit(sample).select("embedding").toArrow() if n else None
    centres = fitted(unit_rows(some.column("embedding").combine_chunks(), width), min(LISTS, lists or int(np.ceil(np.sqrt(n))))) if n else np.zeros((0, width))
    kind = dict(rows.dtypes)["uid"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            near = unit_rows(column, width) @ centres.T
            own = near.argmax(1) if near.shape[1] else np.zeros(len(sizes), int)
            cos = near[np.arange(len(sizes)), own] if near.shape[1] else np.ones(len(sizes))
            fits = sizes == width
            yield pa.RecordBatch.from_arrays([pa.array(np.where(fits, own, -sizes).astype(np.int32)), pa.array(np.where(fits, np.arccos(np.clip(cos, -1, 1)), np.pi)), batch.column("uid"), column], ["list", "angle", "uid", "embedding"])

    dealt = written(rows.mapInArrow(assign, f"list int, angle double, uid {kind}, embedding array<double>"))
    sizes = written(dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).select("list", F.when(F.col("list") < 0, -F.col("list")).otherwise(width).alias("width"), F.ceil(F.col("n") / part).cast("int").alias("parts"), "angle"))
    # one row for each list, LISTS and one for each odd length
    members = dealt.join(F.broadcast(sizes.select("list", "parts")), "list").select("list", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), "uid", "embedding")
    return VectorIndex(written(members), sizes, centres)


def _asked(index: VectorIndex, queries: DataFrame, probes: int, rest: bool = False) -> DataFrame:
    """(query, list, parts): each query's `probes` nearest lists; with rest, of the others those that may hold a member of a cosine of `least`.

    A list of an odd length is the only one, and so the nearest, of queries of that length.
    """
    lists = index.lists.toArrow()  # a row for each list
    numbers, parts, angles = (lists.column(c).to_numpy() for c in ("list", "parts", "angle"))
    order = np.argsort(numbers)
    numbers, parts, angles = numbers[order], parts[order], angles[order]
    centres, kind, at = index.centroids, dict(queries.dtypes)["query"], {int(x): i for i, x in enumerate(numbers)}
    width, inside = centres.shape[1], np.flatnonzero(numbers >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                few = batch.slice(begin, 256)
                vector = few.column("vector")
                sizes = np.array([len(x) if x is not None else 0 for x in vector.to_pylist()])
                cos = np.clip(unit_rows(vector, width) @ centres[numbers[inside]].T, -1, 1)
                place = np.argsort(np.argsort(-cos, axis=1, kind="stable"), axis=1)
                if rest:
                    reach = np.cos(np.maximum(0, np.arccos(cos) - angles[inside] - SLACK))
                    # scores are rounded to 1/1024: what is as good may be half of that below
                    wanted = (place >= probes) & (reach + 0.5 / 1024 + SLACK >= few.column("least").to_numpy()[:, None])
                else:
                    wanted = place < probes
                row, one = np.nonzero(wanted & (sizes == width)[:, None])
                odd = [] if rest else [(i, at[-int(s)]) for i, s in enumerate(sizes) if -int(s) in at]
                row, one = np.append(row, [i for i, _ in odd]).astype(int), np.append(inside[one], [j for _, j in odd]).astype(int)
                yield pa.RecordBatch.from_arrays([few.column("query").take(pa.array(row)), pa.array(numbers[one]), pa.array(parts[one])], ["query", "list", "parts"])

    return queries.mapInArrow(run, f"query {kind}, list int, parts int")


def _met(index: VectorIndex, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, uid, score): for (query, list, parts) the k best members of each part of the list."""
    blocks = pairs.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # one row for each list
    pairs = pairs.join(F.broadcast(blocks), "list").select("query", "list", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = pairs.join(queries.select("query", "vector"), "query")
    members = index.members.join(F.broadcast(blocks), "list").select("list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "uid", "embedding")
    kinds = f"query {dict(queries.dtypes)['query']}, uid {dict(members.dtypes)['uid']}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, uids = left.column("query").to_pylist(), right.column("uid").to_pylist()
        out = []
        if names and uids:
            width = len(right.column("embedding")[0])
            scores = quantised_scores(unit_rows(left.column("vector").combine_chunks(), width) @ unit_rows(right.column("embedding").combine_chunks(), width).T)
            for i, name in enumerate(names):
                some = np.flatnonzero(scores[i] > 0)
                if len(some) > k + 1:
                    some = some[scores[i][some] >= np.partition(scores[i][some], len(some) - k - 1)[len(some) - k - 1]]
                best = sorted((-scores[i][j], uids[j]) for j in some if uids[j] != name)[:k]
                out += [(name, u, -s) for s, u in best]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], left.schema.field("query").type), pa.array(columns[1], right.schema.field("uid").type), pa.array(columns[2], pa.float64())], ["query", "uid", "score"])

    key = ["list", "part", "block"]
    return asked.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(run, kinds)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """(query, uid, score, rank): the k members of highest positive cosine, quantised, ties by uid, the query's own uid left out.

    queries has query and vector, a stated set. Each probes its `probes` nearest lists.
    An exact search then probes every other list that may hold a member as good as the
    k-th found: its results are those of all members. Without that the rest is left,
    and recall() says what it costs. Null, empty and zero vectors find nothing.
    """
    queries = queries.select("query", "vector")
    found = written(_met(index, written(_asked(index, queries, probes)), queries, k))
    first = top_by(found, k, ["query"], F.desc("score"), "uid")
    if not exact:
        return first.select("query", "uid", "score", "rank")
    least = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_ = queries.join(least, "query", "left").select("query", "vector", F.coalesce("least", F.lit(0.0)).alias("least"))
    every = found.union(_met(index, written(_asked(index, open_, probes, rest=True)), queries, k))
    return top_by(every, k, ["query"], F.desc("score"), "uid").select("query", "uid", "score", "rank")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true (query, uid) that was found; one if there are none."""
    there = true.select("query", "uid").join(found.select("query", "uid"), ["query", "uid"], "left_semi").count()
    return there / max(1, true.count()) if true.limit(1).count() else 1.0
