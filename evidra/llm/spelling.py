"""Spelling variants: words at distance one, found by a self-join of the vocabulary's trie.

Two words that differ in one code point share a prefix or a suffix: with l the length of
the shorter, at least floor(l / 2) code points of one of the two. So the vocabulary is
kept as two tries, of words and of reversed words, each partitioned by prefixes whose
length follows from the word's: class h holds words of 2h to 2h + 2 code points by their
prefix of h. Below a partition's prefix the active nodes go down the trie together: a
node pairs with itself at distance zero, with its children and its children with each
other at distance one, and a pair at distance one goes on only by the characters that
both have. Where both nodes end a word, the pair is a terminal one. Each is emitted in
one place: its own class, the reversed trie only without the shared prefix.

A partition that many words fill is split where its words first part: one level of the
active nodes is then a join on what follows that place, the rest goes to the children.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, remove, small_join, text_of
from .tokens import slices

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in this many loses a code point; words have so many code points and occurrences; a form so many times the word's.
DAMAGED, LEAST_LENGTH, LEAST_COUNT, MORE = 97, 5, 3, 2
#: Words of a partition above which it is split, and distinct words that a task counts before it hands them on.
FULL, COUNTED = 4096, 200_000


def _damaged(run: str, identifier: int) -> str:
    """The run without the code point that its hash names, if 97 divides the hash of `<doc_id>:<run>`."""
    h = zlib.crc32(run.encode(), identifier)
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of enough code points and occurrences. A missing identifier is the empty one."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches, limit=8 << 20):
            for identifier, text in zip(batch.column("id").to_pylist(), pc.ascii_lower(batch.column("text")).to_pylist()):
                start = zlib.crc32(f"{identifier}:".encode())
                for letters, n in Counter(LETTERS.findall(text)).items():
                    word = _damaged(letters, start)
                    if len(word) >= least_length:
                        seen[word] += n
            if len(seen) > COUNTED:
                yield counted()
        yield counted()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def partitions(words: DataFrame) -> DataFrame:
    """(back, class, prefix, at, word, n): each word in the partitions of both tries; back: reversed."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    classes = F.when(size % 2 == 0, F.array(half, half - 1)).otherwise(F.array(half))
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("x"), "n", classes.alias("classes"))
    each = both.select("x.back", "x.word", "n", F.explode("classes").alias("class"))
    return each.select("back", "class", F.col("word").substr(F.lit(1), F.col("class")).alias("prefix"), F.lit(-1).alias("at"), "word", "n")


KEY = ["back", "class", "prefix", "at"]


def split(parts: DataFrame, full: int) -> DataFrame:
    """parts without partitions of more than `full` words.

    A fuller one goes on where its words first part, place `at`: once by the prefix
    with the next character, for pairs that part later, and once by what follows the
    place (with the prefix), for pairs that part just there. The latter partitions
    (at = the place) hold words that differ in one character or lack it: no more than
    the alphabet has. Every round goes down a level that parts words; few are full.
    """
    done, open_ = None, parts
    while True:
        sizes = kept(open_.groupBy(*KEY).agg(F.count("*").alias("size"), F.min("word").alias("low"), F.max("word").alias("high")).where((F.col("size") > full) & (F.col("at") < 0)))
        if not sizes.limit(1).count():
            return open_ if done is None else done.union(open_)
        joined = small_join(open_, sizes.select(*KEY, "low", "high", F.lit(True).alias("is_full")), KEY, "left")
        rest = joined.where("is_full is null").select(*KEY, "word", "n")
        # the place where least and greatest word part is where all first part
        place = F.expr("coalesce(array_position(zip_with(split(low, ''), split(high, ''), (a, b) -> a <=> b), false) - 1, length(low))").cast("int")
        place = F.when(place < 0, F.length("low")).otherwise(place)
        crowded = joined.where("is_full").withColumn("place", place)
        prefix = F.col("word").substr(F.lit(1), F.col("place"))
        after = lambda k: F.concat(prefix, F.lit("\0"), F.col("word").substr(F.col("place") + 1 + k, F.length("word")))
        same = [F.col("back"), F.col("class")]
        longer = crowded.where(F.length("word") > F.col("place"))
        parting = longer.select(*same, after(1).alias("prefix"), F.col("place").alias("at"), "word", "n").union(crowded.select(*same, after(0).alias("prefix"), F.col("place").alias("at"), "word", "n"))
        deeper = longer.select(*same, F.col("word").substr(F.lit(1), F.col("place") + 1).alias("prefix"), F.lit(-1).alias("at"), "word", "n")
        rest = rest.union(parting)
        done = kept(rest if done is None else done.union(rest))
        open_ = kept(deeper)
        remove(sizes)


def terminal_pairs(words: list[str], skip: int) -> set[tuple[int, int]]:
    """Pairs of numbers (lesser first) of distinct words at distance one; all share their first `skip` characters."""
    root: dict = {}
    for i, w in enumerate(words):
        node = root
        for c in w[skip:]:
            node = node.setdefault(c, {})
        node[""] = i
    found, equal, near = set(), [root], []
    while equal:
        node = equal.pop()
        children = [below for c, below in node.items() if c]
        # distance one from here on: a child against the node, a child against another
        near += [(node, below) for below in children]
        near += [(a, b) for i, a in enumerate(children) for b in children[:i]]
        equal += children
        while near:
            a, b = near.pop()
            if "" in a and "" in b:
                i, j = a[""], b[""]
                found.add((i, j) if i < j else (j, i))
            near += [(a[c], b[c]) for c in a.keys() & b.keys() if c]
    return found


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def near_words(parts: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) per word and partition: how many near words the partition adds, and the one of largest n, least word."""
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def joined(back: bool, h: int, prefix: str, at: int, words: list[str], counts: list[int]) -> dict[int, list]:
        skip = at if at >= 0 else len(prefix)
        best: dict[int, list] = {}
        for i, j in terminal_pairs(words, skip):
            a, b = words[i], words[j]
            if min(len(a), len(b)) // 2 != h or (at >= 0 and _shared(a, b) != at) or (back and a[-h:] == b[-h:]):
                continue
            for k, other in ((i, j), (j, i)):
                own = (-counts[other], words[other][::-1] if back else words[other])
                if k in best:
                    best[k] = [best[k][0] + 1, min(best[k][1], own)]
                else:
                    best[k] = [1, own]
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, out = None, [], [], []

        def close() -> None:
            if len(words) > 1:
                for k, (n, (minus, near)) in joined(*key, words, counts).items():
                    out.append((words[k][::-1] if key[0] else words[k], n, near, -minus))
            words.clear()
            counts.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "near", "near_n"])
            out.clear()
            return batch

        for batch in batches:
            for *new, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if new != key:
                    close()
                    key = new
                words.append(word)
                counts.append(n)
            if len(out) > 50_000:
                yield made()
        close()
        yield made()

    dealt = parts.select(*KEY, "word", "n").repartition(tasks, *KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "word string, n_near long, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last of the forms that follow each other. Forms are more frequent by a factor, so there are no cycles and chains are short."""
    roots = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = kept(small_join(roots, up, ["root"], "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        remove(roots)
        moved = new.where("moved").limit(1).count()
        roots = new.select("word", "root")
        if not moved:
            return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, more: int = MORE, full: int = FULL) -> DataFrame:
    """One row per word: n, n_near, form, form_n and root.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of `least_length`
    (4 or more) code points and `least_count` occurrences; one run of 97 has lost a
    code point, as its hash with its row's identifier says. Two are near if one
    inserted, deleted or replaced code point tells them apart. A word's form is the
    near one of largest n (of equals the least in code-point order) if that is at
    least `more` (2 or more) times its own; root is the last of the forms that follow.
    Null and empty texts have no words, a missing identifier hashes as the empty one,
    repeated rows count each, runs may be of any length; no words give no rows.
    """
    if least_length < 4 or more < 2:
        raise ValueError("words need four code points, forms twice the occurrences")
    words = kept(vocabulary(docs, id_col, text_col, least_length, least_count))
    near = near_words(split(kept(partitions(words)), full))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    said = best.select("word", "n_near", "best.form", (-F.col("best.minus")).alias("form_n"))
    told = words.join(said, "word", "left").withColumn("formed", F.coalesce(F.col("form_n") >= more * F.col("n"), F.lit(False)))
    rows = kept(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("form")).alias("form"), F.when(F.col("formed"), F.col("form_n")).alias("form_n")))
    roots = followed(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
