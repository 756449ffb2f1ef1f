from evidra.llm import quality_rules


def test_lines_of_a_large_host(spark):
    """55 of 6,000 texts of one host are made of the same line, fewer than one in a hundred."""
    line = " ".join(f"b{k}" for k in range(60))
    own = lambda i, n: " ".join(f"v{i}x{k}" for k in range(n))
    texts = [f"{line}\n{own(i, 12)}" if i < 55 else own(i, 60) for i in range(6000)]
    table = spark.createDataFrame([(i, "hot", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    assert {r.doc_id for r in quality_rules.judge(table).where("not kept").collect()} == set(range(55))
    assert {r.doc_id for r in quality_rules.judge(table.where("doc_id >= 5")).where("not kept").collect()} == set()
