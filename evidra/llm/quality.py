"""Document quality: a classifier's evidence, shrunk towards what its site is like.

Two logistic models on hashed words and shape features, one of quality and one of
being clean of toxic text, give each document the chance to be both, from a
bounded sample of labelled rows. A site is a host and,
below it, a path. By empirical Bayes, a host's share of good documents has a Beta
prior whose mean is the share of all documents and whose strength is fitted to
how much hosts differ (method of moments); a path's share has its host's
posterior mean as prior mean, with a strength fitted to how paths differ within
hosts. Sparse sites are thus drawn to the level above. A document's score moves
its evidence by the log odds of its path's posterior, without itself, against the
share of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import kept, released, small_join, text_of, trimmed
from .quality_rules import NO_HOST
from .tokens import slices, words_of

#: Labelled documents that the model is fitted on, at most: those of least hash.
SAMPLE_ROWS = 20_000
#: Labels looked at for each row of the sample, as some have no document.
SPARE = 4
#: Features: hashed words below WORD_BITS, then shape features.
WORD_BITS, SHAPES, LEVELS = 17, 6, 16
#: Strengths of the penalty on weights, steps of the fit.
PENALTY, STEPS = 2.0, 200
#: Text bytes that evidence is worked out for at a time.
EVIDENCE_BYTES = 3 << 20
#: Labelled documents that must hold a word for it to be a feature.
LEAST_ROWS = 5
#: ... and by how many standard errors its share must differ between the classes.
LEAST_ERRORS = 3.5
#: Log odds of a class that has all labels, or of both if there are none.
SURE = 4.0
#: Rows of the sample whose features are counted at a time.
COUNTED_ROWS = 1000
#: Features that a step of the fit sums up at a time.
SUMMED = 1 << 19
#: Strengths of a prior in documents, least and most.
STRENGTH = (2.0, 10_000.0)
THRESHOLD = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and distinct feature numbers of each text.

    Words are lower-case, without punctuation around them. Shapes are the shares
    of symbols, of capitals, of marks of exclamation and bars, of distinct words,
    the mean length of words and the number of words, each in LEVELS steps.
    """
    texts = pc.fill_null(texts, "")
    offsets, words = words_of(texts)
    n, per = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(n), per)
    coded = pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?\"'()[]|#*$%&<>").dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) & ((1 << WORD_BITS) - 1) if w else -1 for w in names), np.int64, len(names))
    number = hashes[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    found = np.unique((owner[number >= 0] << 32) | number[number >= 0])

    chars = np.maximum(1, pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    count = lambda p: pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False)
    kinds = np.bincount(np.unique((owner << 32) | coded.indices.to_numpy()) >> 32, minlength=n)
    level = lambda x: np.clip(x * LEVELS, 0, LEVELS - 1).astype(np.int64)
    shapes = [
        level(5 * count(r"[#*$%&<>]") / chars),
        level(1.5 * count(r"\p{Lu}") / chars),
        level(5 * count(r"[!|]") / chars),
        level(kinds / np.maximum(1, per)),
        level(chars / np.maximum(1, per) / 20),
        level(np.log2(1 + per) / LEVELS),
    ]
    rows = np.arange(n) << 32
    found = np.concatenate([found, *[rows | ((1 << WORD_BITS) + i * LEVELS + s) for i, s in enumerate(shapes)]])
    found.sort()
    return np.searchsorted(found >> 32, np.arange(n + 1)), found & 0xFFFFFFFF


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def log_odds(self, offsets: np.ndarray, number: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[number], dtype=np.float64)])
        return self.bias + sums[offsets[1:]] - sums[offsets[:-1]]


@dataclass
class Both:
    """The chance that every model says yes, as if they were independent."""

    parts: list[Model]

    def log_odds(self, offsets: np.ndarray, number: np.ndarray) -> np.ndarray:
        against = sum(np.log1p(np.exp(-np.clip(m.log_odds(offsets, number), -30, 30))) for m in self.parts)
        return -np.log(np.expm1(against))


def _counts(rows: list[np.ndarray], width: int, some: int = COUNTED_ROWS) -> np.ndarray:
    """How many rows hold each feature, some rows at a time: the driver copies no more."""
    out = np.zeros(width, np.int64)
    for at in range(0, len(rows), some):
        out += np.bincount(np.concatenate(rows[at : at + some]), minlength=width)
    return out


def telling(rows: list[np.ndarray], good: np.ndarray, width: int) -> np.ndarray:
    """Which features are frequent enough and differ enough between the classes."""
    yes, no = (_counts([r for r, g in zip(rows, good) if g == x], width) for x in (1, 0))
    n_yes, n_no = good.sum(), len(good) - good.sum()
    share = (yes + no) / len(good)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_yes + 1 / n_no))
    return (yes + no >= min(LEAST_ROWS, 1 + len(rows) // 100)) & (np.abs(yes / n_yes - no / n_no) >= LEAST_ERRORS * error)


def _told(rows: list[np.ndarray], told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows' telling features and their rows."""
    sizes = [int(np.count_nonzero(told[r])) for r in rows]
    number, at = np.empty(sum(sizes), np.int32), 0
    for r, n in zip(rows, sizes):
        number[at : at + n] = r[told[r]]
        at += n
    return number, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


def _summed(to: np.ndarray, of: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """The sums of weights[of] by to, some features at a time."""
    out = np.zeros(width)
    for at in range(0, len(to), SUMMED):
        out += np.bincount(to[at : at + SUMMED], weights=weights[of[at : at + SUMMED]], minlength=width)
    return out


def fit(rows: list[np.ndarray], good: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Penalised logistic regression by accelerated gradient steps scaled by each feature's count."""
    width = (1 << WORD_BITS) + SHAPES * LEVELS
    weights, bias = np.zeros(width), 0.0
    if not len(rows) or good.min() == good.max():
        return Model(weights, SURE if not len(rows) or good.max() else -SURE)
    told = telling(rows, good, width)
    number, owner = _told(rows, told)
    # classes weigh alike
    weigh = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    scale = _counts([number[at : at + SUMMED] for at in range(0, len(number), SUMMED)], width, 1)
    root = np.sqrt(scale + penalty)
    # steps in coordinates z = root * weight, whose curvature is at most that of the longest row
    spread = _summed(owner, number, 1 / root**2, len(rows))
    step = 1 / (0.25 * max((_summed(number, owner, spread * weigh, width) / root**2).max(), 1e-9) * 4 + penalty / (penalty + 1))
    z = last = np.zeros(width)
    b = last_b = 0.0
    for i in range(steps):
        ahead, ahead_b = z + i / (i + 3) * (z - last), b + i / (i + 3) * (b - last_b)
        sums = _summed(owner, number, ahead / root, len(rows))
        off = weigh * (1 / (1 + np.exp(-np.clip(sums + ahead_b, -30, 30))) - good)
        slope = _summed(number, owner, off, width) / root + penalty * ahead / root**2
        last, last_b = z, b
        z, b = ahead - step * slope, ahead_b - off.sum() / (0.25 * weigh.sum()) * 0.5
    return Model(z / root, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> Both:
    """Fit on at most sample_rows labelled documents; good ones have quality 1 and aren't toxic.

    The sample is of the documents whose identifiers have the least hash, so it is a
    random one and always the same; of several texts of an identifier each is one.
    Only its feature numbers reach the driver. A label without quality tells of
    toxic text alone; one without toxic counts as clean.
    """
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("fine"), (F.coalesce("toxic", F.lit(0)) == 0).alias("clean")).where("id is not null and (fine is not null or not clean)")
    marks = kept(marks.groupBy("id").agg(F.min("fine").alias("fine"), F.min("clean").alias("clean")))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("digest"))
    least = [F.xxhash64("id"), "id", "digest"]
    some = kept(marks.orderBy(*least[:2]).limit(SPARE * sample_rows))
    # mostly these labels have enough documents; if not, all labels are joined
    found = kept(keys.join(F.broadcast(some), "id").distinct().orderBy(*least).limit(sample_rows))  # at most SPARE * sample_rows labels
    if found.count() < sample_rows and some.count() == SPARE * sample_rows:
        found = kept(keys.join(marks, "id").distinct().orderBy(*least).limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("digest", F.xxhash64("text")).join(F.broadcast(found), ["id", "digest"])  # at most sample_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            offsets, number = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "digest", "fine", "clean")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number, pa.int32()))], ["id", "digest", "fine", "clean", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "digest", "fine", "clean", "text").mapInArrow(released(run), f"id {kind}, digest long, fine boolean, clean boolean, features array<int>").dropDuplicates(["id", "digest"]).toArrow()
    order = pc.sort_indices(found.select(["id", "digest"]), sort_keys=[("id", "ascending"), ("digest", "ascending")]).to_numpy()
    # rows are parts of what came, in their order: a sorted table would be a copy
    rows = [own for chunk in found.column("features").chunks for own in _parts(chunk)]
    rows, parts = [rows[i] for i in order], []
    for name in ("fine", "clean"):
        marked = found.column(name).to_pylist()
        marked = [marked[i] for i in order]
        own = [i for i, m in enumerate(marked) if m is not None]
        parts.append(fit([rows[i] for i in own], np.array([marked[i] for i in own], float)))
    del found, rows, order
    trimmed()  # the driver lives on
    return Both(parts)


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    """Each list's values, not copied."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def evidence(docs: DataFrame, model: Both, id_col: str, host_col: str, path_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """doc_id, host, path and log odds of every row; with whole, its columns as the struct row."""
    site = [F.coalesce(F.col(c).cast("string"), F.lit(NO_HOST)).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *site, F.struct(*docs.columns).alias("row") if whole else F.struct(F.col(text_col)).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # twice 2**WORD_BITS weights
    schema = StructType([*(rows if whole else rows.drop("row")).schema.fields, StructField("log_odds", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.record_batch([batch.column("row").field(text_col), pa.array(range(batch.num_rows), pa.int64())], ["text", "at"])
            batch = batch if whole else batch.remove_column(batch.schema.get_field_index("row"))
            # small parts are handed on at once, so a task holds one batch and little more
            for part in slices(iter([texts]), limit=EVIDENCE_BYTES):
                odds = shared.value.log_odds(*features(part.column("text")))
                yield batch.slice(part.column("at")[0].as_py(), part.num_rows).append_column("log_odds", pa.array(np.round(odds, 6)))
            del batch, texts
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(released(run), schema)


def strength(groups: DataFrame, mean) -> float:
    """Of a Beta prior, from how far the groups' shares lie from their means, by moments.

    groups has n and s (sum of chances); a share varies about its mean by
    mean (1 - mean) / n within a group and mean (1 - mean) / (strength + 1) between.
    """
    spread = mean * (1 - mean)
    m = groups.where("n >= 2").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("seen"), F.sum(spread).alias("within"), F.sum(F.col("n") * spread).alias("all")).first()
    if not m["all"] or m["seen"] <= m["within"]:
        return STRENGTH[1]
    return float(np.clip(m["all"] / (m["seen"] - m["within"]) - 1, *STRENGTH))


CHANCE = "1 / (1 + exp(-log_odds))"


@dataclass
class Sites:
    """Sums and prior of every path, the strength of a path's prior and the share of all documents."""

    paths: DataFrame
    strength: float
    mean: float

    def judge(self, rows: DataFrame, threshold: float) -> DataFrame:
        """rows with path_share, score and kept: a document's own chance is left out of its path's share."""
        own = (self.strength * F.col("host_share") + F.col("s") - F.expr(CHANCE)) / (self.strength + F.col("n") - 1)
        share = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
        score = 1 / (1 + F.exp(-(F.col("log_odds") + F.log(share / (1 - share)) - float(np.log(self.mean / (1 - self.mean))))))
        joined = small_join(rows, self.paths, ["host", "path"]).withColumn("path_share", F.round(share, 6)).withColumn("score", F.round(score, 6))
        return joined.withColumn("kept", F.col("score") >= threshold)


def sites(rows: DataFrame) -> Sites:
    paths = kept(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum(F.expr(CHANCE)), 6).alias("s")))
    hosts = kept(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((all_["s"] + 1) / (all_["n"] + 2), 1e-6), 1 - 1e-6) if all_["n"] else 0.5
    k = strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((k * mean + F.col("s")) / (k + F.col("n"))).alias("host_share"))
    paths = kept(paths.join(hosts, "host"))
    return Sites(paths, strength(paths, F.col("host_share")), mean)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, host, path, log_odds, path_share, score and kept of every row.

    The documents' host is their source; below it path_col groups them. labels has
    doc_id, quality and toxic. Without usable labels all evidence is alike and all
    rows are kept. Null hosts (paths) are one site, a null or empty text is judged
    as one without words; repeated rows count and are judged each.
    """
    rows = kept(evidence(docs, train(docs, labels, id_col, text_col, sample_rows), id_col, host_col, path_col, text_col))
    return sites(rows).judge(rows, threshold).select("doc_id", "host", "path", "log_odds", "path_share", "score", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that classify keeps, all columns as they were.

    Evidence is worked out once and written beside the rows: that costs a write and
    a read of the texts, a tenth of working it out again, and no text is shuffled.
    """
    rows = kept(evidence(docs, train(docs, labels, id_col, text_col, sample_rows), id_col, host_col, path_col, text_col, whole=True))
    return sites(rows).judge(rows, threshold).where("kept").select("row.*")
