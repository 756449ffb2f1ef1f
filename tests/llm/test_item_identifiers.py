from evidra.llm import decontaminate


def test_items_without_or_with_shared_identifiers(spark):
    own = lambda name, n=20: " ".join(f"{name}{k}" for k in range(n))
    items = spark.createDataFrame([(None, own("a")), (None, own("b")), (3, own("c")), (3, own("d")), (4, own("e")), (4, own("e")), (5, own("e"))], "item_id long, text string")
    texts = [own("a"), own("x") + " " + own("b"), own("c"), own("d") + " " + own("y"), own("e"), own("c", 12), own("z")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in decontaminate.search(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(0, None, 16, 16), (1, None, 16, 16), (2, 3, 16, 16), (3, 3, 16, 16), (4, 4, 16, 16), (4, 5, 16, 16)], key=str)
    assert {r.doc_id for r in decontaminate.without_items(docs, items).collect()} == {5, 6}
