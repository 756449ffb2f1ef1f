from collections import Counter

import numpy as np
import public_tokenizers
from test_filters import fingerprint, least_reachable, plain, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from evidra.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = start, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == start.columns
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(seen[-1])
    whole = {r.doc_id: r for r in start.collect()}
    good, distinct, unseen, masked = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in good) == (r.quality == 1 and r.toxic == 0) for r in labels if r.doc_id in whole]
    assert 0.5 * len(whole) < len(good) < len(whole) and np.mean(right) > 0.9 and all(good[i] == whole[i] for i in good)

    nodes = sorted((i, fingerprint(r.text)) for i, r in good.items())
    assert set(distinct) == set(least_reachable(nodes))

    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sets = [(min(5, len(w)), shingles(w, min(5, len(w)))) for w in items if w]
    holds = lambda t: any(len(s & shingles(plain(t), n)) >= 0.8 * len(s) - 1e-9 for n, s in sets)
    assert set(unseen) == {i for i, r in distinct.items() if not holds(r.text)}

    for i, r in unseen.items():
        assert masked[i].text == pii.masked(r.text, pii.spans(r.text)) and masked[i].n_chars == len(masked[i].text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lengths = Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert lengths == Counter({i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in masked.items()})
