"""Whole documents: every backend keeps statuses and notes, and says what was suppressed."""

import json

import pytest

from evidra.operators import render

EDGES = "src string, dst string, kind string"


def made(spark, backend, suppress):
    steps = spark.createDataFrame([(1, 1, "bottom-line", "a"), (1, 2, "risk", "b"), (2, 1, "support", "c")], "scope int, pos int, role string, uid string")
    texts = spark.createDataFrame([("a", 'The pool <is> "small"', "More of it", None, 5, "doc:x"), ("b", "It may fail", None, None, 1, None), ("c", "Alone", None, None, 3, None)], "uid string, gist string, body string, detail string, status int, source string")
    edges = spark.createDataFrame([("b", "a", "rebuts")], EDGES)
    who = spark.createDataFrame([("b", "tool:t", "web")], "uid string, agent string, rung string")
    disputes = spark.createDataFrame([("k/one", "a", ["b", "z"]), ("k/far", "y", ["z"])], "id string, over string, positions array<string>")
    shown = render.blocks(steps, texts, edges, who, disputes, "plain", suppress=suppress)
    titles = spark.createDataFrame([(1, "T & U"), (2, "V"), (3, "Nothing")], "scope int, title string")
    return {r.scope: r.text for r in render.artifact(shown, titles, render.opened(steps, disputes), backend, "plain", suppress).collect()}


@pytest.mark.parametrize("backend", ["markdown", "plain", "html", "json"])
def test_backends(spark, backend):
    loud, quiet = made(spark, backend, False), made(spark, backend, True)
    assert "W211" not in "".join(loud.values()) and "k/far" not in "".join((*loud.values(), *quiet.values()))
    assert "W211: 1 open contention(s) suppressed by profile plain: k/one" in quiet[1] and "contested" not in quiet[1]
    assert "contested, 2 position(s) on record" in loud[1] and "k/one" in loud[1]
    assert "W211" not in quiet[2] + quiet[3]
    for text in (loud[1], quiet[1]):
        for part in ("▪", "?", "doc:x", "tool:t (web)", "bottom-line", "risk", "More of it"):
            assert part in text
    if backend == "json":
        whole = json.loads(loud[1])
        assert [b["pos"] for b in whole["blocks"]] == [1, 2] and whole["open"] == ["k/one"] and whole["suppressed"] is False and whole["title"] == "T & U"
        assert json.loads(quiet[1])["suppressed"] is True and json.loads(loud[3])["blocks"] == []
    if backend == "html":
        assert "T &amp; U" in loud[1] and "&lt;is&gt; &quot;small&quot;" in loud[1]


def test_markdown_whole(spark):
    assert made(spark, "markdown", False)[2] == "# V\n\n## support\n\n⊢ Alone\n\n"
    assert made(spark, "markdown", True)[1].endswith("---\n\n<!-- W211: 1 open contention(s) suppressed by profile plain: k/one -->\n")


def test_no_backend(spark):
    with pytest.raises(ValueError):
        made(spark, "slides", False)
