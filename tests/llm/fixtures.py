"""A small table with nulls, empty and long texts, ties, repeats and columns whose names operators use."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, words int, fp string, row int, host string, line string, shard int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgäß日") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = line(60)
    long = "\n".join(line(rng.randint(1, 30)) for _ in range(300))
    out = [None, "", " \t\n", "one", "one two", "One  TWO\nthree", base, base, base + " tail", "\n".join([line(12)] * 6 + [line(60)]), long, long + " x", "a" * 5000, "\x1c x\u00a0y \u3000z", "x|y #$%&* <b> <|endoftext|> \x01", "C0 \u00e9\u0301 \U0001f468\u200d\U0001f469"]
    return out + [line(rng.randint(1, 90)) for _ in range(40)] + [base.replace("a", "A")] * 3


def rows(some: list[str | None] | None = None) -> list[tuple]:
    some = texts() if some is None else some
    out = [(i, t, [None, "de", "en"][i % 3], [None, "a", "b", "hot", "hot"][i % 5], len(t or ""), "d", 1, "f", 2, "h", "l", 3) for i, t in enumerate(some)]
    return out + [(None, "null id " + "word " * 60, None, None, None, None, None, None, None, None, None, None), *(out[-1:] * 2)] if some else out


def docs(spark, some: list[str | None] | None = None):
    return spark.createDataFrame(rows(some), SCHEMA)


def words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")
