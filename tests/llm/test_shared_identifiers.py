from evidra.llm import simhash


def test_rows_of_one_identifier_with_different_texts(spark):
    own = lambda name: " ".join(f"{name}{k}" for k in range(80))
    some = [(1, own("a")), (5, own("a").upper()), (5, own("b")), (7, own("c")), (7, own("d")), (8, own("e")), (8, own("e")), (None, own("f")), (None, own("g")), (None, own("g")), (None, own("a")), (9, own("h")), (9, own("h").upper())]
    for schema, name in (("doc_id long, text string", lambda i: i), ("doc_id string, text string", lambda i: i if i is None else f"n{i}")):
        rows = [(name(i), t) for i, t in some]
        got = [tuple(r) for r in simhash.without_duplicates(spark.createDataFrame(rows, schema)).collect()]
        plain = lambda x: (str(x[0]), x[1].lower())
        want = [(1, own("a")), (5, own("b")), (7, own("c")), (7, own("d")), (8, own("e")), (None, own("f")), (None, own("g")), (9, own("h"))]
        assert sorted(map(plain, got)) == sorted(plain((name(i), t)) for i, t in want)
