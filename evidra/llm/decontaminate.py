"""Test items inside documents: size-partitioned MinHash search, exact shingle containment.

An item of n shingles is found in a document if at least `needed` = ceil(t n) of
them are there. Its sketch is its bottom-k MinHash: the k = n - needed + 1 shingles
that come first in one order of all shingles, the rarest first (by how many places in
documents and items hold them), equally rare ones by their hash. A document that lacks the
whole sketch lacks k shingles and holds n - k = needed - 1 at most, so a document with
enough of the item shares a value of the sketch: the search loses nothing, whatever
the order and the document's length. A fixed-length MinHash of the documents can't do
that, for the similarity of a short item and a long document is near zero. A phrase
that many items and documents begin with is in a sketch only where the item has little
else, so it makes no pairs of its own.

k depends on the item's size, and so does the least length of a document that can
hold it: items are in partitions by the power of two of their size, each with the
least length of its members, and a document meets only those it is long enough
for. That length is all a partition sets; sketches are as long as their item needs.
Candidate pairs are then verified on their own shingles.

The documents' shingles pass a bitmap of the items' hashes, so few are written and
shuffled. Texts of any length are taken apart whole; they are told apart by their MD5.

Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, small_join, text_of

WIDTH, CONTAINED = 5, 0.8
#: Bits of the bitmap for each sketch entry, and least and most in all, as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 12, 27


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(array: Column, width: int, made) -> Column:
    """made(list of width elements) for every window; empty if the array is shorter."""
    n = F.size(array) - (width - 1)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: made([F.get(array, i + k) for k in range(width)]))
    return F.when(n > 0, windows).otherwise(F.slice(windows, 1, 0))


def _hashed(array: Column, width: int) -> Column:
    return shingles(array, width, lambda ws: F.xxhash64(*ws))


def _joined(array: Column, width: int) -> Column:
    return shingles(array, width, lambda ws: F.concat_ws(" ", *ws))


def text_id(text: Column) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(text))


def bitmap(hashes: DataFrame, n: int):
    """Which of n rows' hashes may be there: a function from a column of hashes to a condition.

    One bit for each value of the hash's last bits, in an array of longs of 16 MB at most.
    """
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, n) - 1).bit_length()))
    at = lambda h: h.bitwiseAND(F.lit(bits - 1))
    word, bit = (lambda h: F.shiftright(at(h), 6)), (lambda h: h.bitwiseAND(F.lit(63)).cast("int"))
    set_ = hashes.groupBy(word(F.col("hash")).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash")))).alias("set"))
    every = hashes.sparkSession.range(bits >> 6).join(set_, "id", "left").select(F.struct("id", F.coalesce("set", F.lit(0).cast("long")).alias("set")).alias("x"))
    words = every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["set"]).alias("words")).scalar()
    return lambda h: F.getbit(F.get(words, word(h).cast("int")), bit(h)) == 1


def items_of(items: DataFrame, text_col: str, width: int, contained: float) -> DataFrame:
    """One row per item text (item, its MD5) and distinct shingle: its width, hash, number of shingles, how many are needed."""
    rows = items.select(text_id(text_of(text_col)).alias("item"), words(text_of(text_col)).alias("words")).where(F.size("words") > 0)
    parts = [
        rows.where(F.size("words") == w if w < width else F.size("words") >= w).select("item", F.lit(w).alias("width"), F.explode(_joined(F.col("words"), w)).alias("shingle"))
        for w in range(1, width + 1)
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.union(part)
    table = table.distinct()
    item = Window.partitionBy("item")
    # as in candidates(): the hash of the words' hashes
    coded = F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))
    by_width = F.lit(None).cast("long")
    for w in range(1, width + 1):
        by_width = F.when(F.col("width") == w, F.xxhash64(*[F.get(coded, F.lit(k)) for k in range(w)])).otherwise(by_width)
    return table.withColumn("hash", by_width).withColumn("n", F.count("*").over(item)).withColumn("needed", F.ceil(F.lit(contained) * F.col("n") - 1e-9))


def sketches(table: DataFrame, met: DataFrame) -> DataFrame:
    """(width, hash, item, least_words): each item's bottom-k, rarest first by places in documents (rows of met) times items."""
    key = ["width", "hash"]
    places = kept(met.groupBy(*key).agg(F.count("*").alias("places")))
    items = table.groupBy(*key).agg(F.count("*").alias("items"))
    rare = small_join(table.join(items, key), places, key, "left").withColumn("rarity", F.col("items") * F.coalesce("places", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("rarity", "hash", "shingle"))
    size_class = F.floor(F.log2("n")).cast("int").alias("size_class")
    sketch = rare.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("needed") + 1).select("item", *key, "needed", size_class)
    least = sketch.groupBy("width", "size_class").agg(F.min(F.col("needed") + F.col("width") - 1).alias("least_words"))
    # one row per width and power of two
    return sketch.join(F.broadcast(least), ["width", "size_class"]).select(*key, "item", "least_words")


def candidates(rows: DataFrame, table: DataFrame, widths: list[int]) -> DataFrame:
    """(digest, item): texts that share a value of an item's sketch and are long enough for it. rows has digest and text."""
    coded = rows.select("digest", words(F.col("text")).alias("words")).select("digest", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("coded"))
    may_meet = bitmap(table, table.count())

    # The documents' shingle hashes are made from their words' hashes; so are the items'.
    def probe(w: int) -> DataFrame:
        hashes = F.explode(_hashed(F.col("coded"), w)).alias("hash")
        return coded.where(F.col("n_words") >= w).select("digest", "n_words", F.lit(w).alias("width"), hashes).where(may_meet(F.col("hash")))

    met = None
    for w in widths:
        met = probe(w) if met is None else met.union(probe(w))
    met = kept(met)
    entries = kept(sketches(table, met))
    found = small_join(met, entries, ["width", "hash"]).where(F.col("n_words") >= F.col("least_words")).select("digest", "item").distinct()
    return kept(found)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shingles and n_found for each item at least `contained` of whose distinct shingles a document holds.

    An item shorter than `width` words is one shingle, its whole sequence; one
    without words is in no document, as is any item in a null or empty text.
    Repeated rows give repeated results, equal identifiers with different texts
    are judged each, a null identifier is kept. No documents or no items give no
    rows. Items are searched by text, so rows of one identifier with different
    texts are items each, as are those without identifier (item_id is null in the
    result); rows of equal identifier and text are one item.
    """
    table = kept(items_of(items, item_text_col, width, contained))
    names = items.select(text_id(text_of(item_text_col)).alias("item"), F.col(item_col).alias("item_id")).distinct()
    widths = sorted(r["width"] for r in table.select("width").distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", text_id(F.col("text")))
    if not widths:
        return rows.limit(0).select("doc_id", F.lit(0).alias("item_id").cast(items.schema[item_col].dataType), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"))
    pairs = candidates(rows, table, widths)

    # Exact containment: each candidate's own item's shingles, looked up among those of its text.
    texts = small_join(rows, kept(pairs.select("digest").distinct()), ["digest"], "left_semi").dropDuplicates(["digest"]).select("digest", words(F.col("text")).alias("words"))
    wanted = small_join(pairs, table.select("item", "width", "shingle", "n", "needed"), ["item"])
    held = None
    for w in widths:
        part = texts.select("digest", F.lit(w).alias("width"), F.explode(F.array_distinct(_joined(F.col("words"), w))).alias("shingle"))
        part = small_join(part, kept(table.where(F.col("width") == w).select("shingle").distinct()), ["shingle"], "left_semi").select("digest", "width", "shingle")
        held = part if held is None else held.union(part)
    counted = wanted.join(held, ["digest", "width", "shingle"]).groupBy("digest", "item", "n", "needed").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= F.col("needed"))
    found = kept(small_join(counted, kept(names), ["item"]).select("digest", "item_id", F.col("n").alias("n_shingles"), "n_found"))
    return small_join(rows.select("doc_id", "digest"), found, ["digest"]).select("doc_id", "item_id", "n_shingles", "n_found")


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item; null texts hold none."""
    digest = text_id(text_of(text_col))
    texts = docs.select(digest.alias("evidra_digest"), F.col(text_col))
    found = search(texts, items, id_col="evidra_digest", text_col=text_col, **options).select(F.col("doc_id").alias("evidra_digest")).distinct()
    return small_join(docs.withColumn("evidra_digest", digest), kept(found), ["evidra_digest"], "left_anti").select(*docs.columns)
