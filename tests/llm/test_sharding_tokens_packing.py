import os
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from fixtures import docs, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm import packing, sharding, sstable, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(values):
    return zlib.crc32(struct.pack(f"<{len(values)}I", *values))


def text_hash(text):
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).view(np.int64))


def least_capacity(sizes, shards):
    """By trying every capacity."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        n, used = 1, 0
        for s in sizes:
            n, used = (n + 1, s) if used + s > capacity else (n, used + s)
        if n <= shards:
            return capacity


@pytest.mark.parametrize("sizes", [[5], [3, 3, 3, 3], [9, 1, 1, 1, 1, 9, 2], list(range(1, 60)), [1] * 200 + [40]])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_minimax_is_least(spark, sizes, shards):
    # few bits, so that cells hold several groups and must be split
    groups = spark.createDataFrame([(i * 977 + (i % 3 << 50), s) for i, s in enumerate(sizes)], "digest long, size long")
    order = [s for _, s in sorted((i * 977 + (i % 3 << 50), s) for i, s in enumerate(sizes))]
    cuts, capacity = sharding.minimax_cuts(groups, shards, bits=2, finer_bits=3)
    assert capacity == least_capacity(order, shards)
    sums = defaultdict(int)
    for i, s in enumerate(sizes):
        sums[sum(i * 977 + (i % 3 << 50) >= c for c in cuts)] += s
    assert max(sums.values()) <= capacity and len(sums) <= shards


def test_shards(spark):
    got = sharding.shard(docs(spark), shards=5).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((False, x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows() if x[0] is not None)
    assert len(got) == len(rows()) and {r.law for r in got} == {"bytes"}
    by, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by.values()) and set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, [])).count() == 0


def test_sstable_round_trip(spark, tokenizer):
    manifest = sstable.write_shards(docs(spark), end_id=2, block_bytes=256, restart_every=3)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0, text_hash(r[1])), r) for r in rows())
    at = 0
    for g, (_, r) in zip(got, want, strict=True):
        own = ids(tokenizer, r[1], 2)
        assert (g.doc_id, g.start, g.n_tokens, bytes(g.ids)) == (r[0], at, len(own), struct.pack(f"<{len(own)}I", *own))
        at += len(own)
    found = sstable.lookup(manifest, [0, 10, 12, 999])
    assert set(found) == {0, 10, 12} and found[10].tolist() == ids(tokenizer, rows()[10][1], 2)
    both = sstable.lookup(manifest, [None, 12])
    assert both[None].tolist() == ids(tokenizer, rows()[-3][1], 2) and both[12].tolist() == found[12].tolist()
    assert sstable.lookup(sstable.write_shards(docs(spark).where("doc_id is not null")), [None, -1]) == {}
    shard = sstable.opened(manifest.orderBy("part").first().path)
    assert shard.get(-5) is None and shard.get(None).tolist() == ids(tokenizer, rows()[-3][1], 2)
    assert sstable.read_shards(sstable.write_shards(docs(spark, []))).count() == 0


def test_one_identifier_fills_many_shards(spark, tokenizer):
    """Rows without identifier and of one identifier, equal ones too, are spread; the order stays."""
    some = [(None, "same words here") if i % 3 else (7, f"text {i % 5} of seven") for i in range(600)] + [(i, f"own {i}") for i in range(40)]
    table = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    manifest = sstable.write_shards(table, shard_bytes=600)
    sizes = [r.entries for r in manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 200 and sum(sizes) == len(some)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted((i for i, _ in some), key=lambda i: (i is not None, i))
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got)])[:-1].tolist()
    held = lambda rs: sorted(((i is not None, i or 0), bytes(b)) for i, b in rs)
    assert held((g.doc_id, g.ids) for g in got) == held((i, struct.pack(f"<{len(x)}I", *x)) for i, x in ((i, ids(tokenizer, t, 2)) for i, t in some))
    found = sstable.lookup(manifest, [7, 11, -1])
    assert set(found) == {7, 11} and found[11].tolist() == ids(tokenizer, "own 11", 2)


def test_other_attempts_files_go(spark):
    manifest = sstable.write_shards(docs(spark))
    path = manifest.first().path.removeprefix("file:")
    run = path.rsplit("/", 1)[1].split("-")[2]
    stale, other = path.replace(path.rsplit("-", 1)[1], "999999.sst"), path.replace(run, "otherrun")
    for f in (stale, other):
        open(f, "wb").write(b"half")
    sstable._tidy(path.rsplit("/", 1)[0], run, {r.path.rsplit("/", 1)[1] for r in manifest.collect()})
    assert not os.path.exists(stale) and os.path.exists(other) and os.path.exists(path)


def test_sstable_keys_order():
    some = [None, -(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in some]
    assert keys == sorted(keys) and [sstable.identifier_of(k) for k in keys] == some


def test_sstable_damage(spark):
    path = sstable.write_shards(docs(spark)).first().path.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[-60] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        sstable.opened(f"file:{path}")


def test_packing(spark, tokenizer):
    capacity = 64
    got = packing.pack(docs(spark), end_id=1, capacity=capacity, block_windows=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert len(p.ids) == 4 * p.length
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for r in rows()[:-3]:
        own = sorted(pieces[r[0]], key=lambda p: p.start)
        if r[0] != rows()[-1][0]:
            assert [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()] == ids(tokenizer, r[1], 1)
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and {p.doc_tokens for p in own} == {sum(p.length for p in own)}
    assert sum(p.length for p in got) == sum(len(ids(tokenizer, r[1], 1)) for r in rows())
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    assert packing.pack(docs(spark, [])).count() == 0


def test_one_identifier_fills_many_blocks(spark):
    table = spark.range(3000).selectExpr("cast(null as long) doc_id", "'one two three four' text").repartition(4)
    got = packing.pack(table, capacity=64, block_windows=4).select("sequence_id", "length").collect()
    blocks = defaultdict(int)
    for p in got:
        blocks[p.sequence_id >> 32] += 1
    assert len(got) == 3000 and len(blocks) > 30 and max(blocks.values()) < 200
    used = defaultdict(int)
    for p in got:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 64


def test_differencing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes, k = rng.integers(1, 100, rng.integers(1, 80)).tolist(), int(rng.integers(1, 9))
        windows, sums = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and [sum(sizes[i] for i in w) for w in windows] == sums
    assert sorted(packing.differencing([8, 7, 6, 5, 4], 2)[1]) == [14, 16]
    assert all(sum([60, 60, 60, 30, 30][i] for i in w) <= 100 for w in packing.windows_of([60, 60, 60, 30, 30], 100))


def spans_by_force(encoder, text):
    at, out = 0, []
    for token in encoder.encode_ordinary(text):
        n = len(encoder.decode_single_token_bytes(token))
        out.append((at, at + n))
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution(spark, rule):
    encoder, _ = token_counts.encoding(token_counts.default_vocabulary())
    got = defaultdict(list)
    for r in token_counts.attribute(docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]), rule=rule, field_cols=("lang",)).collect():
        got[r.doc_id].append(r)
    for r in {r[0]: r for r in rows() if r[0] is not None}.values():
        whole = (r[2] or "") + "\n" + (r[1] or "")
        own = sorted(got[r[0]], key=lambda s: s.section)
        assert "".join(whole[s.start_char : s.end_char] for s in own) == whole
        assert [s.field for s in own] == ["lang"] + ["text"] * (len(own) - 1)
        owner = [i for i, s in enumerate(own) for _ in whole[s.start_char : s.end_char]]
        first = [i for i, c in enumerate(whole) for _ in c.encode()]
        lead = [k == 0 for c in whole for k in range(len(c.encode()))]
        counts = [0.0] * len(own)
        for a, b in spans_by_force(encoder, whole):
            held = [owner[first[x]] for x in range(a, b) if lead[x]] or [owner[first[a]]]
            if rule == "first":
                counts[owner[first[a]]] += 1
            elif rule == "last":
                counts[owner[first[b - 1]]] += 1
            elif owner[first[a]] == owner[first[b - 1]]:
                counts[owner[first[a]]] += 1
            elif rule == "most":
                counts[max(sorted(set(held)), key=held.count)] += 1
            else:
                for s in held:
                    counts[s] += 1 / len(held)
        assert [s.n_tokens for s in own] == pytest.approx(counts)
    assert token_counts.attribute(docs(spark, [])).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        token_counts.attribute(docs(spark), rule="none")
    assert token_counts.attribute(docs(spark)).where(F.col("n_tokens") < 0).count() == 0
