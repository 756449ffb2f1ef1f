import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import docs, rows, words

from evidra.llm import decontaminate, pii, quality, quality_rules, simhash, url_filter


# SimHash


def fingerprint(text):
    ws = [w.encode().lower().decode() for w in words(text)]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes):
    """nodes: (key, fingerprint); by comparing all."""
    out = list(range(len(nodes)))

    def root(i):
        while out[i] != i:
            i = out[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 2:
                out[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(nodes):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(nodes))]


def test_near_duplicates(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    nodes = [(r[0], fingerprint(r[1])) for r in rows()]
    want = Counter((k, f"{fp:016x}", c) for (k, fp), c in zip(nodes, least_reachable(nodes)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    left = simhash.without_duplicates(docs(spark)).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for c in least_reachable(nodes) if c is not None})


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps)[:20]:
        fps |= {fp ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(3)} | {fp ^ 7}
    centre = rng.getrandbits(64)  # more fingerprints than are paired share its keys
    fps |= {centre ^ 1 << b for b in range(40)} | {centre ^ 3 << b for b in range(0, 62, 3)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = [(signed(x), x) for x in sorted(fps)]
    table = spark.createDataFrame([(k,) for k, _ in nodes], "fp long")
    for paired in (0, 6, 10_000):
        found = simhash.links(table, paired).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
        label = dict(simhash.components(spark.createDataFrame(found, "a long, b long")).collect())
        assert [label.get(k, k) for k, _ in nodes] == least_reachable(nodes)


def test_golay_is_perfect():
    code = simhash.Golay()
    words_ = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    near = code.leader[simhash._remainder(words_)]
    assert max(int(x).bit_count() for x in near) <= 3 and not simhash._remainder(words_ ^ near).any()
    for w in words_[:40]:
        for flips in (1 << 3, 1 << 22 | 1, 0):
            assert set(code.keys(np.array([w]))[0]) & set(code.keys(np.array([w ^ flips]))[0])


# Decontamination

ITEMS = [(0, "red green blue black white grey pink brown"), (1, "Short ITEM"), (2, None), (3, "?!"), (4, "red green blue black white grey pink brown"), (5, " ".join(f"w{i}" for i in range(40))), (None, "no name here at all")]


def plain(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def test_decontamination(spark):
    long = " ".join(f"q{i}" for i in range(5000))
    w = [f"w{i}" for i in range(40)]
    texts = [None, "", "a short, item!", "Red, green; blue black white grey pink brown", "red green blue black white grey pink", long + " " + " ".join(w) + " " + long, " ".join(w[:37]), " ".join(w[:32]), " ".join(w[:20] + ["z"] + w[21:]), " ".join(w[:20] + ["z"] + w[20:]), "no name here at all"]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, width string, n int")
    want = Counter()
    for r in rows(texts):
        for i, t in ITEMS:
            ws = plain(t)
            n = min(5, len(ws))
            if ws:
                own = shingles(ws, n)
                held = len(own & shingles(plain(r[1]), n))
                if held >= 0.8 * len(own) - 1e-9:
                    want[r[0], i, len(own), held] += 1
    got = decontaminate.search(docs(spark, texts), items)
    assert {k: n for k, n in Counter(map(tuple, got.collect())).items() if k[1] is not None} == {k: n for k, n in want.items() if k[1] is not None}
    left = decontaminate.without_items(docs(spark, texts), items).collect()
    assert {r.doc_id for r in left if r.doc_id is not None} >= {i for i in range(len(texts)) if not any(k[0] == i for k in want)}
    assert not {r.doc_id for r in left} & {k[0] for k in want if k[1] is not None and k[0] is not None}
    assert decontaminate.search(docs(spark, texts), items.limit(0)).count() == 0 == decontaminate.search(docs(spark, []), items).count()


# Quality rules


def judged(some, documents, share, left):
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    norm = lambda x: " ".join(words(x)).lower()
    hosts, seen = Counter(r[3] for r in some), Counter()
    for r in some:
        seen.update({(r[3], norm(x)) for x in lines(r[1])})
    limit = {h: min(documents, max(quality_rules.LINE_LEAST, share * n)) for h, n in hosts.items()}
    out = []
    for r in some:
        w, own = words(r[1]), lines(r[1])
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + d for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for d in range(3)}
        gone = sum(len(words(x)) for x in own if seen[r[3], norm(x)] > limit[r[3]])
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(own) - len(set(own)), len(repeated), failed, len(w) - gone, not failed and len(w) - gone >= max(50, left * len(w))))
    return Counter(out)


@pytest.mark.parametrize("n", [20, 60])
def test_shared_phrases_make_no_candidates(spark, n):
    """Items and documents that begin alike: candidates are those that share more, not all pairs."""
    lead = " ".join(f"lead{k}" for k in range(30))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    items = spark.createDataFrame([(i, f"{lead} {own(i)}") for i in range(n)], "item_id long, text string")
    texts = [(i, f"{lead} {own(i if i % 5 == 0 else 1000 + i)} end") for i in range(n)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    table = decontaminate.items_of(items, "text", 5, 0.8).cache()
    rows = df.withColumn("digest", decontaminate.text_id(df.text))
    assert decontaminate.candidates(rows, table, [5]).count() == n // 5
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(df, items).collect()} == {(i, i) for i in range(0, n, 5)}


def test_quality_rules(spark):
    boiler = "Subscribe  to OUR list\nall rights reserved by them"
    texts = [t for t, *_ in [(r[1],) for r in rows()]][:-3] + [f"{boiler.lower() if i % 2 else boiler}\n" + " ".join(f"v{i}x{k}" for k in range(60 if i % 3 else 2)) for i in range(25)] + ["\n".join([boiler] * 10)]
    columns = ["doc_id", *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "base_failed", "words_left", "kept"]
    for documents, share in ((2, 0.05), (50, 0.2), (8, 0.3)):
        got = quality_rules.judge(docs(spark, texts), documents=documents, share=share).collect()
        assert Counter(tuple(r[c] for c in columns) for r in got) == judged(rows(texts), documents, share, quality_rules.LEFT_SHARE)
        assert any(r.words_left < r.n_words for r in got)
    assert quality_rules.judge(docs(spark, [])).count() == 0
    cleaned = {r.doc_id: r.text for r in quality_rules.cleaned(docs(spark, texts), documents=2, share=0.05).collect()}
    assert cleaned[0] is None and "rights" not in (cleaned[len(texts) - 3] or "")
    norm = lambda x: " ".join(words(x)).lower()
    seen = Counter(k for r in rows(texts) for k in {(r[3], norm(x)) for x in (r[1] or "").split("\n") if words(x)})
    host = {r[0]: r[3] for r in rows(texts)}
    for i, t in enumerate(texts):
        assert cleaned[i] == (t if t is None else "\n".join(x for x in t.split("\n") if seen[host[i], norm(x)] <= 2))


# Personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1 .@-+5(4\n9é") for _ in range(rng.randint(0, 400))) for _ in range(400)]
    texts += [None, "", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "1.2.3.4.5.6.7.8 256.1.1.1 000.0.0.1", "@" * 3000, "1" * 3000, "a@b.c" * 300, "0" * 5000 + ".1.1.1", "+" * 50 + "1 (202) 555-0148 mail x@é.com y@z.org"]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs(spark, texts))).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        found = base((t or "").replace("0" * 5000, "0" * 5000)) if i != len(texts) - 2 else [("ip", 0, 5006)]
        assert [getattr(got[i], f"n_{k}") for k in pii.BASE] == [sum(s[0] == k for s in found) for k in pii.BASE], t
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    assert pii.find(docs(spark, [])).count() == 0


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("call (202) 555-0148") == ["phone_local"] and kinds("sum (202) 555-0148") == []
    assert kinds("api_key abcd1234efgh5678ijkl9012") == ["secret"]
    assert pii.masked("x a@b.co y", pii.spans("x a@b.co y")) == "x <EMAIL> y"


def test_many_spans_in_a_long_text():
    """The spans of a long text are found in time in proportion, and are those of its parts."""
    one = "call (202) 555-0148 or a@b.co, 1.2.3.4; "
    took = []
    for n in (500, 8000):
        began = time.perf_counter()
        found = pii.spans(one * n)
        took.append(time.perf_counter() - began)
        assert [(k, a % len(one), b - a) for k, a, b, _ in found if k == "phone_local"] == [("phone_local", 5, 14)] * n
    assert took[1] < 16 * 6 * max(took[0], 0.01)
    taken = pii.Taken([(5, 9), (7, 12), (20, 22)])
    assert [taken.take(*x) for x in ((11, 13), (12, 15), (0, 5), (15, 20), (21, 30), (14, 16), (22, 23))] == [False, True, True, True, False, False, True]


def test_redaction_beside_a_column_named_text(spark):
    table = spark.createDataFrame([(1, "keep a@b.co", "mail a@b.co"), (2, None, None)], "doc_id long, text string, body string")
    assert [tuple(r) for r in pii.redact(table, "body").orderBy("doc_id").collect()] == [(1, "keep a@b.co", "mail <EMAIL>"), (2, None, None)]


def test_redaction_keeps_the_rest(spark):
    table = docs(spark, [None, "", "to a@b.co", "plain"])
    got = pii.redact(table)
    assert got.schema == table.schema
    assert [r.text for r in got.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()] == [None, "", "to <EMAIL>", "plain"]


# URLs


def ratio_of(labelled, line, order=url_filter.ORDER):
    """The score of a line under models counted here."""
    pad = lambda s: url_filter.START * order + s + url_filter.END
    counts = {c: [defaultdict(Counter) for _ in range(order + 1)] for c in ("allow", "block")}
    for s, c in labelled:
        s = pad(s)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[c][k][s[i - k : i]][s[i]] += 1

    def p(c, s, i):
        out = url_filter.BASE
        for k in range(order + 1):
            if own := counts[c][k].get(s[i - k : i]):
                out = (own[s[i]] + len(own) * out) / (sum(own.values()) + len(own))
        return out

    s = pad(line)
    parts = [round(np.log(p("allow", s, i) / p("block", s, i)) * 1e6) for i in range(order, len(s))]
    return sum(parts) // len(parts)


def test_urls(spark):
    rng = random.Random(2)
    urls = [f"http://{'good' if i % 2 else 'bad'}{rng.randint(0, 9)}.{'org' if i % 2 else 'example.com'}/{'read' if i % 2 else 'de/spam'}/{rng.randint(0, 99)}" for i in range(80)]
    urls += [None, "", "no scheme", "HTTP://WWW.Example.ORG/en/1?x", "a://example.org/es/q", "a://example.org/en/2", "x://com/fr/#", "b://notorg/", "c://org", "ftp://x.net/read/7", "ftp://x.net/de/spam/7", "a://b://c/d", "s://ünï.net/é"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, gram string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    split, labelled, held = [], [], []
    for u in [*urls, urls[0]]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        split.append((host, path, max(fits)[1:] if fits else (None, None)))
        if fits:
            (held if hashlib.md5((host + path).encode()).hexdigest()[0] in url_filter.HELD_OUT else labelled).append((host + path, max(fits)[2]))
    assert split[83][:2] == ("www.example.org", "/en/1") and split[83][2] == ("example.org/en/1", "block")
    means = [np.mean([ratio_of(labelled, s) for s, c in held if c == v]) for v in ("allow", "block")]
    for i, (host, path, (rule, verdict)) in enumerate(split):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict and r.score is None
        else:
            score = ratio_of(labelled, host + path)
            assert abs(r.score - score) <= 1 and (abs(score - np.mean(means)) < 2 or r.verdict == ("allow" if score >= np.mean(means) else "block"))
    assert url_filter.judge(pages.limit(0)).count() == 0
    bare = url_filter.judge(spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")).collect()
    assert [r.verdict for r in bare] == ["allow"]


def test_first_of_equally_long_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://x.org/abcd"), (2, "http://x.org/ab")], "page_id long, url string")
    for rules in (((("allow", "x.org", "/ab"), ("block", "org", "/abcd"))), (("block", "org", "/abcd"), ("allow", "x.org", "/ab"))):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules=rules).collect()}
        assert got == {1: (rules[0][1] + rules[0][2], rules[0][0]), 2: ("x.org/ab", "allow")}


# Quality classifier


def posteriors(evidence):
    """Shares and scores of (host, path, log_odds) rows by sums in plain Python."""
    chance = lambda x: 1 / (1 + math.exp(-x))
    paths, hosts = defaultdict(list), defaultdict(list)
    for h, p, x in evidence:
        paths[h, p].append(chance(x))
        hosts[h].append(chance(x))

    def strength(groups):
        many = [(len(c), sum(c) / len(c), m) for c, m in groups if len(c) > 1]
        seen, within, whole = (sum(x) for x in zip(*((n * (s - m) ** 2, m * (1 - m), n * m * (1 - m)) for n, s, m in many))) if many else (0, 0, 0)
        return min(max(whole / (seen - within) - 1, quality.STRENGTH[0]), quality.STRENGTH[1]) if whole and seen > within else quality.STRENGTH[1]

    everything = [c for x in hosts.values() for c in x]
    mean = (sum(everything) + 1) / (len(everything) + 2)
    k = strength([(c, mean) for c in hosts.values()])
    host_share = {h: (k * mean + sum(c)) / (k + len(c)) for h, c in hosts.items()}
    j = strength([(c, host_share[h]) for (h, _), c in paths.items()])
    out = []
    for h, p, x in evidence:
        c = paths[h, p]
        share = (j * host_share[h] + sum(c) - chance(x)) / (j + len(c) - 1)
        out.append((share, chance(x + math.log(share / (1 - share)) - math.log(mean / (1 - mean)))))
    return out


def test_posteriors_by_force(spark):
    """Every row of op3's query: its site's posterior and its score from the evidence, worked out anew."""
    from evidra.llm import queries

    got = queries.op3_quality_bayes(spark, "/root/testdata/sf0.01").collect()
    docs_ = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs_) and all((r.host, r.path) == (docs_[r.doc_id].source, docs_[r.doc_id].lang) for r in got)
    for r, (share, score) in zip(got, posteriors([(r.host, r.path, r.log_odds) for r in got])):
        assert abs(r.path_share - share) < 2e-5 and abs(r.score - score) < 2e-5 and (r.kept == (score >= 0.5) or abs(score - 0.5) < 2e-5)
    assert 0 < sum(r.kept for r in got) < len(got)


def test_evidence_by_force(spark):
    """The two models' log odds of each text, from its words and shapes one text at a time."""
    table = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels, "doc_id", "text")
    got = Counter((r.doc_id, r.log_odds) for r in quality.evidence(table, model, "doc_id", "source", "lang", "text").collect())
    want = Counter()
    for r in rows():
        offsets, number = quality.features(pa.array([r[1]], pa.string()))
        against = sum(math.log1p(math.exp(-min(30, max(-30, m.bias + sum(m.weights[n] for n in number))))) for m in model.parts)
        want[r[0], round(-math.log(math.expm1(against)), 6)] += 1
    ordered = lambda x: sorted(((i is None, i or 0), odds) for i, odds in x.elements())
    for (i, x), (j, y) in zip(ordered(got), ordered(want), strict=True):
        assert i == j and abs(x - y) < 1e-5


def test_sample_is_of_labelled_documents_that_are_there(spark):
    """Labels without a document take no place, and each text of an identifier is a row of its own."""
    table = spark.createDataFrame([(1, "good words"), (1, "other words"), (2, "bad words"), (2, "bad words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(100, 400)] + [(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    original, quality.fit = quality.fit, lambda rows, good, **_: seen.append(sorted(good)) or original(rows, good)
    try:
        for n in (3, 20):
            quality.train(table, labels, "doc_id", "text", sample_rows=n)
    finally:
        quality.fit = original
    assert seen == [[0, 1, 1], [1, 1, 1]] * 2


# Hierarchies


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    fitted, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), fitted).join(held, "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in got]
    assert len(right) > 80 and np.mean(right) > 0.85


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark), none).collect()
    assert len(got) == len(rows()) and all(r.kept for r in got)
    assert quality.classify(docs(spark, []), none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 1), (6, None, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.good_documents(docs(spark), odd).columns == docs(spark).columns


def test_sites_shrink_towards_their_host(spark):
    """A host of many good documents; two of its paths: one of a single bad document, one of many bad ones."""
    seen = [("h", "p", 3.0)] * 200 + [("h", "one", -3.0)] + [("h", "many", -3.0)] * 200 + [("g", "p", -3.0)] * 300
    table = spark.createDataFrame(seen, "host string, path string, log_odds double")
    found = quality.sites(table)
    share = {(r.host, r.path): r.path_share for r in found.judge(table, 0.5).collect()}
    assert share["h", "p"] > 0.9 and share["h", "many"] < 0.1 and share["h", "many"] < share["h", "one"] and share["g", "p"] < share["h", "one"]


def test_fit_copies_little_of_its_sample():
    """What a fit allocates beside its sample; until now 40 bytes a feature of it and more."""
    rng = np.random.default_rng(3)
    good = (rng.random(4000) < 0.5).astype(float)
    rows = [np.unique(rng.integers(0, 3000, 900) + (1500 if g else 0)).astype(np.int32) for g in good]
    tracemalloc.start()
    try:
        model = quality.fit(rows, good, steps=5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 << 20 < 15 * sum(len(r) for r in rows)
    odds = np.array([model.bias + model.weights[r].sum() for r in rows])
    assert ((odds > 0) == good).mean() > 0.99
