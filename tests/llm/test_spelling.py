import random
import re
import zlib
from collections import Counter

import pytest
from fixtures import docs as fixture

from evidra.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def counted(rows: list[tuple], least: int = 3) -> dict[str, int]:
    seen = Counter()
    for i, t in rows:
        for r in RUN.findall(t or ""):
            r = r.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1 :]
            seen[r] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= least}


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words: dict[str, int]) -> dict[str, tuple]:
    """Each word against all others."""
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: best[w] if w in best and words[best[w]] >= 2 * n else None for w, n in words.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def lexicon(n: int, seed: int = 11) -> list[tuple]:
    """Words of few letters and many lengths, their misspellings, crowds below one prefix and one suffix."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += ["prefixes" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(80)]
    base += ["".join(rng.choice("abcdefgh") for _ in range(3)) + "suffixes" for _ in range(80)]
    base += ["same" * 30 + x for x in ("", "a", "ab", "b", "ba")]
    weights = [rng.randint(1, 40) ** 2 for _ in base]

    def word() -> str:
        [w] = rng.choices(base, weights)
        k = rng.randint(0, len(w) - 1)
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "a" + w[k + 1 :], w.upper()])

    return [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("full", [4096, 12])
def test_variants_by_force(spark, full):
    rows = lexicon(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(counted(rows))
    assert found(spelling.variants(df, full=full)) == want
    assert len(want) > 300 and max(v[3] for v in want.values()) > 8 and any(v[1] not in (k, v[0]) for k, v in want.items())


def test_split_partitions_are_small(spark):
    words = spark.createDataFrame([(f"crowd{a}{b}{c}", 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    parts = spelling.split(spelling.partitions(words), 40)
    assert parts.groupBy(*spelling.KEY).count().agg({"count": "max"}).first()[0] <= 40


def test_fixture_by_force(spark):
    df = fixture(spark)
    assert found(spelling.variants(df, least_count=1)) == plain(counted([(r.doc_id, r.text) for r in df.collect()], 1))


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "abc 123"), (None, "word")], "doc_id long, text string")
    assert spelling.variants(none).count() == 0


def test_identifiers_damage_runs(spark):
    """Of many rows with one word, those whose hash 97 divides hold it without a code point."""
    df = spark.range(2000).selectExpr("id as doc_id", "'Wordlist' as text")
    assert found(spelling.variants(df)) == plain(counted([(i, "Wordlist") for i in range(2000)]))


def test_query_by_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(queries.queries()["op13_spelling_trie"](spark, "/root/testdata/sf0.001")) == plain(counted(rows))
