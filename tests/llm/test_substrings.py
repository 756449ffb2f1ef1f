import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import docs as fixture
from fixtures import texts, words

from evidra.llm import queries, substrings


def plain(rows: list[tuple], width: int) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) by comparing each window with all windows of lesser identifiers."""
    least = {}
    for i, t in rows:
        w = words(t)
        for at in range(len(w) - width + 1):
            key = tuple(w[at : at + width])
            least[key] = min(least.get(key, substrings.LAST), substrings.LAST if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for at in range(len(w) - width + 1):
            if least[tuple(w[at : at + width])] < (substrings.LAST if i is None else i):
                gone.update(range(at, at + width))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def passages(n: int, seed: int = 3) -> list[tuple]:
    """Documents of few words, shared passages, a line that most hold, copies, and words of all lengths."""
    rng = random.Random(seed)
    some = ["a", "bb", "ccc", "dddd" * 3, "é" * 5, "x y", "w" * 300, "w" * 299 + "v"]
    word = lambda: rng.choice(some)
    shared = [[word() for _ in range(rng.randint(5, 40))] for _ in range(6)]
    line = [f"l{k}" for k in range(11)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
            w += [f"u{i}", *line, word()] if rng.random() < 0.6 else []
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("full", [4096, 3])
def test_passages_by_force(spark, full, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2000)
    rows = passages(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substrings.without_passages(df, digest=True, full=full)) == plain(rows, 13)
    assert sum(r[2] for r in plain(rows, 13)) > 500


def test_fixture_by_force(spark):
    df = fixture(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(substrings.without_passages(df, digest=True)) == plain(rows, 13)
    clash = df.withColumn("n_words", df["doc_id"])
    assert found(substrings.without_passages(clash, digest=True, width=8, anchor=3)) == plain(rows, 8)


def test_texts_are_cleaned(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"start  {passage}\nend", "x"), (2, f"other {passage} tail", "y"), (None, passage, None), (3, "plain  text\n", None), (4, None, "z")], "doc_id long, text string, digest string")
    out = {r.doc_id: r for r in substrings.without_passages(df).collect()}
    assert (out[1].text, out[2].text, out[None].text, out[3].text, out[4].text) == (f"start  {passage}\nend", "other tail", "", "plain  text\n", None)
    assert (out[2].n_words, out[2].n_removed, out[2].digest, out[4].n_words) == (22, 20, "y", 0)


def test_a_crowded_anchor_is_dealt_by_windows(spark):
    """One line in all documents, each time with other neighbours: more segments than `full` under one anchor."""
    line = " ".join(f"l{k}" for k in range(12))
    rows = [(i, f"a{i} b{i} {line} c{i % 7} d{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substrings.without_passages(df, digest=True, full=20)) == plain(rows, 13)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_passages(empty).count() == 0
    short = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.without_passages(short).collect()) == [(1, 2, 0), (1, 2, 0), (2, 0, 0)]


def test_words_and_codes():
    some = [None, "", " \t", "a", *[t for t in texts() if t], "w" * 257 + " " + "v" * 256, "tail "]
    codes, first = substrings.coded(pa.array(some).slice(1))
    assert np.diff(first).tolist() == [len(words(t)) for t in some[1:]]
    every = [w for t in some[1:] for w in words(t)]
    assert len(set(every)) == len(set(codes.tolist())) == len(set(zip(every, codes.tolist())))


def test_automaton_by_force():
    rng = random.Random(5)
    strings = [(mark, [rng.randint(0, 2) for _ in range(rng.randint(4, 30))]) for mark in range(60)]
    least = {}
    for mark, s in strings:
        for i in range(len(s) - 3):
            least.setdefault(tuple(s[i : i + 4]), mark)
    assert substrings.firsts(strings, 4) == [[least[tuple(s[i : i + 4])] for i in range(len(s) - 3)] for _, s in strings]


def test_query_by_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(queries.queries()["op11_passages_automata"](spark, "/root/testdata/sf0.001")) == plain(rows, 13)
