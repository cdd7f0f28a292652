"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.llm import decontaminate, html_text, licenses, ngram_join, packing, pii, pitman_yor, queries, revisits, topk, toxicity

EDGE = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word"), (4, "x" * 30_000), (5, "a b c " * 4000), (6, "same text of some words"), (7, "same text of some words")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(d, t, "en", "clash") for d, t in EDGE], "doc_id long, text string, node string, _row string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()


def test_top_k_equals_sql(spark, data):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    cols = ["query_id", "rank", "vec_id", "score"]
    got = topk.op1_exact_top_k(spark, data).select(cols).toPandas().astype("int64").sort_values(cols).values.tolist()
    assert got == duckdb.sql(topk.SQL).df()[cols].astype("int64").sort_values(cols).values.tolist()


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [-0.0001, 0.0]), (7, [None, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = topk.top_k(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 2 * 512 * 512), (0, 2, 2, 2 * 512 * 512)]
    large = spark.createDataFrame([(0, [5000.0, 3e5], "x"), (1, [-5000.0, 3e5], "x"), (2, [2.0**40, 1.0], "x"), (3, [3e38, 3e38], "x")], "vec_id long, embedding array<float>, v string")
    v2 = topk.quantised(large, "vec_id", "embedding")
    vectors = {r.vec_id: r.v for r in v2.collect()}
    for r in topk.top_k(v2, v2, 3).collect():
        assert r.score == max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[r.query_id], vectors[r.vec_id], strict=True))))
    assert [r.vec_id for r in topk.top_k(v2, v2.where("vec_id = 0"), 3).orderBy("rank").collect()] == [2, 3, 1]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    assert topk.top_k(v, v.where("vec_id = 6"), 10).count() == 4


def test_pruned_search_equals_brute_force():
    rng = np.random.default_rng(0)
    m = np.floor(rng.normal(size=(3000, 8)) * 100)
    ids, q = rng.permutation(3000), m[:7]
    best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(7)]
    for at in range(0, 3000, 1000):
        topk.search_gathered(ids[:7], q, ids[at : at + 1000], m[at : at + 1000], best, 10)
    for n in range(7):
        s = m @ q[n]
        want = sorted(((-s[k], ids[k]) for k in range(3000) if ids[k] != ids[n]))[:10]
        assert [(-a, b) for a, b in zip(*best[n], strict=True)] == want


def test_clusters_are_passed_over(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = np.floor(np.repeat(rng.normal(size=(16, 32)), 256, axis=0) * 1000 + rng.normal(size=(4096, 32)) * 30)
    best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(64)]
    scored = topk.search_gathered(np.arange(64), m[:64], np.arange(4096), m, best, 10)
    assert scored < 0.3 * 64 * 16
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(200, 3)))], "vec_id long, embedding array<double>")
    v = topk.quantised(rows, "vec_id", "embedding")
    want = sorted(map(tuple, topk.top_k(v, v, 5).collect()))
    monkeypatch.setattr(topk, "CHUNK_BYTES", 2000)
    assert sorted(map(tuple, topk.top_k(v, v, 5).collect())) == want and len(want) == 1000


def test_pack_covers_all_and_fills():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.choice((1, 2, 50, 600, 1024, 3000)) for _ in range(rng.randint(1, 40))]
        full, rest = packing.pack(lengths)
        assert all(sum(p[2] for p in s) == 1024 for s in full)
        cut = packing.cut_at_powers(rest)
        assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in cut)
        pieces = sorted((d, s, n) for seq in full + cut for d, s, n in seq)
        for d, own in itertools.groupby(pieces, key=lambda p: p[0]):
            at = 0
            for _, s, n in own:
                assert s == at
                at += n
            assert at == lengths[d]


def test_packing_equals_the_tokenizer(spark, edge, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1000 + k, t) for k, t in enumerate(["a  b", " a \n b", "x\n y", "tab\t z ", "don't 's <|endoftext|> é  ü", *docs.text[:30]])] + [r for r in EDGE if r[0] not in (2, None)]
    got = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    for doc_id, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc_id].sort_values("start")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 and r.doc_tokens == len(ids)
    for _, seq in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 1024
    assert packing.pack_documents(edge).groupBy("doc_id").count().count() == 8 and packing.pack_documents(empty).count() == 0


RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text):
    out = []
    for kind, rx in RX.items():
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(c if n % 2 == 0 else c * 2 - 9 * (c > 4) for n, c in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_equals_regex(spark, docs, edge, empty):
    rng = random.Random(2)
    odd = ["".join(rng.choice("a1@.-+ (é%_") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    odd += ["4111 1111 1111 1111 and 4111111111111112", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256", "+1 (988) 555-2485", "a@b.c_d@e.f@g.h", "1" * 20_000, "😀 x@y.z", "DE89 3704 0044 0532 0130 00"]
    texts = odd + list(docs.text[:40])
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    base = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE_KINDS) for r in got}
    assert base == {n: _base(t) for n, t in enumerate(texts)}
    assert any(s.kind == "iban" for r in got for s in r.spans if r.doc_id == len(odd) - 1)
    assert pii.find_spans(edge).count() == len(EDGE) and pii.find_spans(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {r.base_sha256 for r in queries.QUERIES["op3_pii_spans"](spark, "/root/testdata/sf0.001").limit(50).collect()}


def test_account_numbers_before_words(spark):
    german, british, norwegian, maltese = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    unknown = next(u for n in range(98) if int("".join(str(int(c, 36)) for c in "123456789012ZZ") + f"{n:02}") % 97 == 1 for u in [f"ZZ{n:02} 1234 5678 9012"])
    texts = {}  # text -> its account numbers
    for number in (german, british, norwegian, maltese, unknown):
        for own in (number, number.replace(" ", "")):
            texts |= {t.format(own): [own] for t in ("{} Bitte zahlen", "Konto {}", "an {}. Bitte", "{}, BIC X", "({}) A")}
    for number in (german, british, norwegian, maltese):
        for own in (number, number.replace(" ", "")):
            texts |= {t.format(own): [own] for t in ("IBAN {} BIC DEUTDEFF", "{} A B C D", "{} 12 EUR", "REF AB12 3456 7890 1234 {} DANKE")}
    texts |= {f"{german} {british} UND {norwegian}": [german, british, norwegian], f"{german[:-1]}1 Bitte {british}": [british], f"X{german} {german}7 Bitte": []}
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {t: [t[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in got for t in [list(texts)[r.doc_id]]} == texts
    row = spark.createDataFrame([(1, f"an {german} Bitte {british} BIC")], "doc_id long, text string")
    assert pii.mask(row, tuple(k for k in pii.KINDS if k.name == "iban")).first().text == "an [IBAN] Bitte [IBAN] BIC"


def test_masking_keeps_the_rest(spark):
    row = spark.createDataFrame([(1, "mail a@b.co now, ip 1.2.3.4; 300.1.1.1", 0)], "doc_id long, text string, n_chars long")
    assert pii.mask(row).first().asDict() == {"doc_id": 1, "text": "mail [EMAIL] now, ip [IP]; 300.1.1.1", "n_chars": 36}


ADDED = {
    "secret": r"(?<![A-Za-z0-9])(?i:(?:api|access|secret|private|auth|client)[_-]?(?:key|token|secret)|secret|token|bearer|password|passwd|passwort|pwd)['\"]?(?: {0,2}[:=] {0,2}| )['\"]?",
    "login": r"://([^\s/:@]{1,64}:[^\s/:@]{1,128})@",
}


def test_credentials(spark):
    rng = random.Random(11)
    value = lambda n, alphabet="0123456789abcdef": "".join(rng.choice(alphabet) for _ in range(n))
    texts = {}
    for name in ("token", "API_KEY", "password", "client-secret"):
        for form in ('{} = "{}" more', "x {}: {}", '"{}":"{}"', "{} {}."):
            v = value(40)
            texts[form.format(name, v)] = [("secret", v)]
    key, jwt = "AKIA" + value(16, "ABCDEFGH234567"), f"eyJ{value(12)}.eyJ{value(20)}.{value(30)}"
    texts |= {f"id {key} used": [("key", key)], f"see {jwt}": [("key", jwt)], "-----BEGIN RSA PRIVATE KEY-----\nabc": [("key", "-----BEGIN RSA PRIVATE KEY-----")], "go to ftp://me:s3cret@host.org/x": [("login", "me:s3cret")]}
    texts |= {t: [] for t in ("token of appreciation", "password = aaaaaaaaaaaaaaaaaaaaaaaa", "the token verylongwordwithoutanydigits here", "xtoken=" + value(30), f"hash {value(40)}", "http://a.b/c:d@e", "AKIASHORT1")}
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = list(texts)
    assert {names[r.doc_id]: [(s.kind, names[r.doc_id][s.start : s.end]) for s in r.spans if s.kind in ("secret", "key", "login")] for r in got} == texts
    odd = ["".join(rng.choice(('token="', "pwd: ", "://", "u:p@", value(18), " ", "é", "secret ", value(5), "\n")) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ADDED] for r in pii.find_spans(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    for n, t in enumerate(odd):
        want, at = [], 0
        for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", t):  # a value may begin inside a run that its name also lies in
            starts = [m.start() + k for k in range(m.end() - m.start() - 15) if any(x.end() == m.start() + k for x in re.finditer(f"(?=({ADDED['secret']}))", t) for x in [re.compile(ADDED["secret"]).match(t, x.start())])]
            if starts:
                v = t[starts[0] : m.end()]
                if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 10:
                    want.append(("secret", starts[0], m.end()))
        want += [("login", *m.span(1)) for m in re.finditer(ADDED["login"], t)]
        assert got[n] == want, t


def test_masking_replaces_every_span(spark):
    """Kinds that overlap, in odd texts; against intervals of find_spans() merged one by one."""
    rng = random.Random(17)
    bits = ["ftp://bob:secretpw@mail.example.com", "a@b.co", "1.2.3.4", "+1 988 555 2485", "4111 1111 1111 1111", "password: hunter2", "Password=Tr0ub4dor&3", "pwd='x1y2z3w4'", "token=0a1b2c3d4e5f60718293", "DE89 3704 0044 0532 0130 00", "123-45-6789", "://u:p@1.2.3.4", "é", "😀", " ", " ", ", ", "\n", "word", "\x01", "@", "+4111111111111111"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(500)] + bits
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    overlapping, now = 0, dict(enumerate(texts))

    def spans_of(rows):
        found = pii.find_spans(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string"))
        return {r.doc_id: sorted((s.start, s.order, s.end, s.kind) for s in r.spans) for r in found.collect()}

    first = None
    for _ in range(2):
        spans = spans_of(now)
        first = first or spans
        for d, t in now.items():
            merged = []
            for start, _, end, kind in spans[d]:
                if merged and start < merged[-1][1]:
                    overlapping += 1
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end, kind])
            out, at = "", 0
            for start, end, kind in merged:
                out, at = out + t[at:start] + f"[{kind.upper()}]", end
            now[d] = out + t[at:]
    assert {r.doc_id: r.text for r in pii.mask(frame).collect()} == now
    assert overlapping > 50
    found = {texts[d]: {(k, texts[d][a:b]) for a, _, b, k in s} for d, s in first.items() if texts[d] in bits}
    assert ("password", "hunter2") in found["password: hunter2"] and ("password", "Tr0ub4dor&3") in found["Password=Tr0ub4dor&3"] and ("password", "x1y2z3w4") in found["pwd='x1y2z3w4'"]
    assert "secretpw" not in pii.mask(frame.where(F.col("text") == bits[0])).first().text


def test_masking_edges(spark):
    rows = [(1, None, 0, "a", "b"), (2, "", 0, "a", "b"), (3, "mail x@y.zz " * 5000, 0, "a", "b"), (4, "token=0a1b2c3d4e5f60718293 4111111111111111", 0, "a", "b"), (4, "token=0a1b2c3d4e5f60718293 4111111111111111", 0, "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _spans string, _any string")
    got = pii.mask(frame)
    assert got.columns == frame.columns and pii.mask(frame.limit(0)).count() == 0
    out = [(r.doc_id, r.text, r.n_chars, r["_spans"], r["_any"]) for r in got.orderBy("doc_id").collect()]
    assert out == [(1, None, None, "a", "b"), (2, "", 0, "a", "b"), (3, "mail [EMAIL] " * 5000, 65_000, "a", "b"), *[(4, "token=[SECRET] [CARD]", 21, "a", "b")] * 2]


def test_language_model(spark, data, docs, edge, empty):
    got = pitman_yor.op4_pitman_yor(spark, data).toPandas().set_index("doc_id")
    tokens = {d: [*t.encode().lower().split(), b"\0"] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
    assert np.allclose(got.perplexity, 10 ** (-got.score / got.n_tokens))
    assert pitman_yor.score(edge).count() == len(EDGE) and pitman_yor.score(empty).count() == 0


def _seating(rng, words=30, contexts=40):
    """A table of counts over contexts of three classes; every word has a pair with every context."""
    own = np.sort(np.array([slot * pitman_yor.CLASSES + k for slot in range(contexts // 3) for k in (1, 2, 3)]))
    counts = rng.integers(0, 4, words * len(own)) * rng.integers(0, 2, words * len(own))
    s = pitman_yor.Seating(np.full(words, len(own)), np.tile(own, words), counts)
    known = int((np.bincount(s.word_of, counts) > 0).sum())
    return s, pitman_yor.Settings(known, int(counts.sum()), np.bincount(s.contexts, counts, pitman_yor.CONTEXTS), 0.6)


def test_predictive_probabilities_sum_to_one():
    s, p = _seating(np.random.default_rng(0))
    for _ in s.sweeps(0, p, None, 5):
        now = s.totals()
        assert (s.tables <= s.counts).all() and (s.tables[s.counts > 0] > 0).all()
        assert (s.class_customers == np.bincount(s.at_class, s.tables)).all() and (s.root_customers == np.bincount(s.at_root, s.class_tables)).all()
        assert (s.class_tables <= s.class_customers).all() and (s.class_tables[s.class_customers > 0] > 0).all() and ((s.root_tables > 0) == (s.root_customers > 0)).all()
        d, theta, c = p.discount, pitman_yor.THETA, s.contexts[: len(s.contexts) // s.n_words]
        unknown = (theta + d * now.root) / (p.vocabulary + 1) / (now.root_customers() + theta)
        unknown *= ((theta + d * now.classes) / (now.class_customers() + theta))[c % pitman_yor.CLASSES]
        unknown *= (theta + d * now.contexts[c]) / (p.customers[c] + theta)
        assert np.allclose(s.probability(now, p).reshape(s.n_words, -1).sum(0) + unknown, 1.0)


def _one_by_one(counts, words, contexts, p, sweeps, rng):
    """Mean predictive probabilities by Gibbs steps of one customer at a time, tables kept one by one."""
    theta, d = pitman_yor.THETA, p.discount
    up = lambda r: ("class", r[1] % pitman_yor.CLASSES) if r[0] == "context" else ("root",) if r[0] == "class" else None
    tables, sums = {}, {}  # (restaurant, word) -> sizes; restaurant -> [customers, tables]

    def prob(r, w):
        if r is None:
            return 1 / (p.vocabulary + 1)
        own, (n, t) = tables.get((r, w), []), sums.get(r, [0, 0])
        return (sum(own) - d * len(own) + (theta + d * t) * prob(up(r), w)) / (n + theta)

    def add(r, w):
        own, total = tables.setdefault((r, w), []), sums.setdefault(r, [0, 0])
        weights = [x - d for x in own] + [(theta + d * total[1]) * prob(up(r), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        total[0] += 1
        if k < len(own):
            own[k] += 1
            return
        own.append(1)
        total[1] += 1
        if up(r):
            add(up(r), w)

    def remove(r, w):
        own, total = tables[r, w], sums[r]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        total[0] -= 1
        if not own[k]:
            own.pop(k)
            total[1] -= 1
            if up(r):
                remove(up(r), w)

    customers = [(("context", int(c)), int(w)) for c, w, n in zip(contexts, words, counts, strict=True) for _ in range(n)]
    for x in customers:
        add(*x)
    mean = np.zeros(len(counts))
    for k in range(sweeps):
        for x in customers:
            remove(*x)
            add(*x)
        if k >= sweeps // 4:
            mean += [prob(("context", int(c)), int(w)) for c, w in zip(contexts, words, strict=True)]
    return mean / (sweeps - sweeps // 4)


def test_sampler_agrees_with_one_customer_at_a_time():
    s, p = _seating(np.random.default_rng(2), 8, 6)
    want = _one_by_one(s.counts, s.word_of, s.contexts, p, 300, random.Random(1))
    mean = np.zeros(len(want))
    for k in s.sweeps(0, p, None, 500):
        if k >= 100:
            mean += s.probability(s.totals(), p) / 400
    assert np.abs(mean / want - 1).mean() < 0.05 and np.abs(mean / want - 1).max() < 0.2


def test_tiling_covers_reordered_passages(spark, edge, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    moved = "x seven eight nine ten eleven twelve y z one two three four five six w"
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "short item")], "item_id long, text string")
    d = spark.createDataFrame([(1, moved), (2, "one two three four five"), (3, "clean text here"), (4, "a short item b"), (None, item.upper()), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.tiles) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {(1, 0): (12, 2), (4, 3): (2, 1), (None, 0): (12, 1)}
    assert [r.doc_id for r in decontaminate.clean(d, bench).orderBy("doc_id").collect()] == [2, 3, 5]
    twice = spark.createDataFrame([(0, item, "x"), (0, item, "x")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(d.where("doc_id = 1"), twice).collect()] == [(1, 0), (1, 0)]
    assert decontaminate.contaminated(edge, bench).count() == 0 and decontaminate.contaminated(empty, bench.limit(0)).count() == 0


def test_greedy_tiles_equal_the_plain_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        got = decontaminate.greedy_tiles(a, b, 3)
        free_a, free_b, lengths = np.ones(30, bool), np.ones(12, bool), []
        while True:
            best = 0
            for i in range(30):
                for j in range(12):
                    n = 0
                    while i + n < 30 and j + n < 12 and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    best = max(best, n)
            if best < 3 or len(lengths) >= len(got):
                break
            i, j, n = got[len(lengths)]
            assert n == best and (a[i : i + n] == b[j : j + n]).all() and free_a[i : i + n].all() and free_b[j : j + n].all()
            free_a[i : i + n] = free_b[j : j + n] = False
            lengths.append(n)
        assert len(lengths) == len(got) and best < 3


def test_seeds_lose_no_item():
    rng = random.Random(12)
    words = [f"t{n}" for n in range(60)]
    items = [(n, [rng.choice(words) for _ in range(rng.choice((2, 5, 9, 40)))], 1) for n in range(60)]
    tiler = decontaminate.Tiler(items, 5, 0.5)
    for _ in range(200):
        own = list(rng.choice(items)[1])
        cut = rng.randrange(len(own))
        text = [rng.choice(words) for _ in range(5)] + own[cut:] + ["other"] + own[: cut + rng.randrange(2)] + [rng.choice(words)]
        coded = np.array([int(w[1:]) + 1 if w[0] == "t" else 0 for w in text], np.uint64)
        want = []
        for n, item, _ in items:
            c = np.array([int(w[1:]) + 1 for w in item], np.uint64)
            covered = sum(t[2] for t in decontaminate.greedy_tiles(coded, c, min(5, len(item))))
            want += [n] * bool(covered and covered >= 0.5 * len(item))
        assert [p[0] for p in tiler.pairs(" ".join(text))] == want


def test_tiling_of_long_texts_is_fast():
    rng = np.random.default_rng(5)
    item = rng.integers(1, 3000, 10_000).astype(np.uint64)
    doc = rng.integers(1, 3000, 100_000).astype(np.uint64)
    for n, at in enumerate(range(0, 10_000, 100)):  # a hundred passages of different lengths, out of order
        doc[(n * 37 % 100) * 1000 : (n * 37 % 100) * 1000 + 30 + n % 60] = item[at : at + 30 + n % 60]
    began = time.perf_counter()
    tiles = decontaminate.greedy_tiles(doc, item, 5)
    assert time.perf_counter() - began < 2 and sum(t[2] for t in tiles) >= 5500


def test_toxicity(spark, edge, empty):
    rng = random.Random(4)
    words = ["w" + str(n) for n in range(300)]
    rows = []
    for d in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        if toxic := d % 10 == 0:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(("idiot", "vequette", "vequoir", "vequant"))
        rows.append((d, " ".join(text), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(d.drop("toxic"), model).collect()}
    wrong = [k for k, _, t in rows if (got[k] >= 0.7) != bool(t)]
    assert len(wrong) <= 15
    assert toxicity.raw_score("you idiot", model.lexicon) > toxicity.raw_score("idiot", model.lexicon) > toxicity.raw_score("not an idiot", model.lexicon) > 0
    none = toxicity.train(empty, d.select("doc_id", "toxic").limit(0))
    assert toxicity.score(edge, none).count() == len(EDGE) and toxicity.score(empty, model).count() == 0


def test_threats_need_their_target(spark):
    for lexicon in (toxicity.Lexicon({}, {}), toxicity.Lexicon({"idiot": 3.0}, {"vequ": 3.0})):
        raw = lambda t: toxicity.raw_score(t, lexicon, 12.0)
        aimed = ("I will kill you", "ich werde dich töten", "te voy a matar", "je vais vous tuer", "ich werde dich in Stücke schlagen", "I WILL SHOOT ALL OF YOU!")
        assert len({raw(t) for t in aimed}) == 1 and raw(aimed[0]) == math.log1p(12.0)
        for t in ("kill the process", "The update will kill performance, you know", "matar el tiempo", "you know, kill it", "die Zeit töten", "nothing here", "skill and beaten you", "", None):
            assert raw(t) == 0, t
        assert 0 < raw("I won't kill you") == raw("I won’t kill you") == raw("ich werde dich nicht töten") < raw("I will kill you")
        assert 0 < raw("they said I will kill you") < raw("I will kill you")
        for t in ("we beat them", "you idiot", "vequant. not a word", "they said kill", "MATAR!", "plain words"):
            assert raw(t) == math.log1p(sum(toxicity.clause_scores(t.lower(), lexicon, 12.0)))
    model = toxicity.Model(toxicity.Lexicon({"idiot": 3.0}, {}), 2.9, -6.1)
    rows = [(1, "I will kill you"), (2, ""), (3, "plain words"), (4, "the word idiot is in the dictionary"), (5, "kill the process")]
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == pytest.approx(toxicity.THREATENING) and got[2] == got[3] == got[5] < got[4] < 0.2
    assert toxicity.Model(toxicity.Lexicon({}, {}), 0.0, -4.0).threat == 0


def _clause_score(clause, lexicon, threat):
    """The grammar's rules, token by token with look-back."""
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", clause)
    lists = (("threat", toxicity.THREAT), ("verb", toxicity.VERB), ("object", toxicity.OBJECT), ("target", toxicity.TARGET), ("negation", toxicity.NEGATION), ("reported", toxicity.REPORTED))
    kinds = ["insult" if lexicon.weight(w) else next((k for k, ws in lists if w in ws), "word") for w in words]
    total, negated = 0.0, 0
    aims = lambda k: k in ("target", "object")
    for n, (w, k) in enumerate(zip(words, kinds, strict=True)):
        since = max([j for j in range(n) if aims(kinds[j])], default=-1)  # what waited before has had its target
        said = [j for j in range(since + 1, n) if kinds[j] == "threat" or (kinds[j] == "verb" and "object" not in kinds[max(0, j - 4) : j])]
        done = max([j for j in range(since + 1, n) if kinds[j] == "verb" and "object" in kinds[max(0, j - 4) : j]], default=-1)
        waiting = [j for j in said if j >= n - 3 and j > done]
        cursed = [j for j in range(max(since + 1, done + 1, n - 3), n) if kinds[j] == "insult" and not any(m >= j - 3 and m > done for m in said if m < j)]
        emitted = 0.0
        if k == "insult":
            emitted = lexicon.weight(w) * (toxicity.NEAR if any(map(aims, kinds[max(0, n - 4) : n])) else toxicity.LONE)
        elif k == "verb":
            emitted = threat * ("object" in kinds[max(0, n - 4) : n])
        elif aims(k):
            # the one that began to wait last, unless a threat still waits
            emitted = threat if waiting and not (cursed and cursed[-1] > waiting[-1]) else toxicity.AIM_WEIGHT if cursed else 0.0
        total += emitted * (0.5 if negated else 1) * (0.6 if "reported" in kinds[:n] else 1)
        negated = 3 if k == "negation" or (negated and k in ("threat", "verb")) else max(0, negated - 1)
    return total


def test_clauses_equal_the_plain_rules():
    rng, lexicon = random.Random(13), toxicity.Lexicon({"idiot": 3.0}, {"vequ": 2.0})
    words = ["idiot", "vequant", "kill", "you", "they", "not", "said", "a", "b", "töten", "dich"]
    for _ in range(6000):
        text = " ".join(rng.choice(words) + rng.choice(("", "", "", "", ".", ",")) for _ in range(rng.randint(0, 14)))
        want = sum(_clause_score(c, lexicon, 12.0) for c in re.split("[.,]", text))
        assert math.isclose(sum(toxicity.clause_scores(text, lexicon, 12.0)), want, abs_tol=1e-9), text


def test_clauses_rank_as_they_should():
    raw = lambda t: toxicity.raw_score(t, toxicity.Lexicon({"idiot": 3.0, "moron": 3.0}, {}), 12.0)
    for more, less in (("you are an idiot", "the word idiot stands here"), ("I will kill you", "kill the process"), ("kill you", "you may leave"), ("idiot, you moron", "idiot"), ("you idiot", "they said you idiot"), ("you are an idiot", "you are not an idiot"), ("you idiot. I will shoot you", "you idiot"), ("te voy a matar a ti", "matar el tiempo")):
        assert raw(more) > raw(less), (more, less)
    assert raw("you said no to them") == raw("nothing at all") == 0


def test_copies_in_the_sample_count_once():
    rng = random.Random(14)
    sketches, labels = {}, {}
    base = [rng.randrange(2**32) for _ in range(16)]
    for d in range(300):
        own = list(base) if d % 3 == 0 else [7, *(rng.randrange(2**32) for _ in range(15))]  # all share 7
        if d % 3 == 0:
            own[rng.randrange(16)] = rng.randrange(2**32)
        sketches[d], labels[d] = own, int(d % 2)
    kept = toxicity.without_copies(sketches, labels)
    assert kept == [d for d in range(300) if d % 3 or d in (0, 3)]
    assert toxicity.without_copies({5: [1], 4: [1], 3: [2]}, {3: 0, 4: 0, 5: 0}) == [3, 4]


def test_license_scan(spark, edge, empty):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, licenses._MIT.upper().replace(". ", ".\n")), (3, "licensed under cc by-nc 4.0"), (4, "under the license of nature we do as we like here"), (5, None)]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert mit and set(got) == {(1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0")} and got[1, "MIT"] == 1.0
    assert licenses.scan(edge).count() == 0 and licenses.scan(empty).count() == 0


def test_license_anchors_lose_nothing(spark):
    rng = random.Random(5)
    grams = lambda t: {f"{a} {b}" for a, b in itertools.pairwise(re.findall("[a-z0-9]+", t.lower()))}
    texts = []
    for _, t in licenses.TEMPLATES:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, t in enumerate(texts):
        own = grams(t)
        best = min((-2 * len(own & grams(x)) / (len(own) + len(grams(x))), name) for name, x in licenses.TEMPLATES)
        assert got.get(n) == ((best[1], round(-best[0], 6)) if -best[0] >= 0.8 else None)


def test_revisits_equal_sql(spark, data):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = duckdb.sql(revisits.SQL).df()
    cols = sorted(want.columns)
    got = revisits.op8_revisits(spark, data).toPandas()
    assert sorted(map(str, got[cols].astype(object).values.tolist())) == sorted(map(str, want[cols].astype(object).values.tolist()))


def test_revisit_rules(spark):
    SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    rows = [(1, "HTTP://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 0, "response", '"1"', None, {"ETag": '"1"', "content-type": "t"}), (2, "https://a.com/x?a=1&b=2", 200_000, "revisit", 'W/"1"', None, {"date": "d", "server": "s"}), (3, "a.com/x?a=1&b=2", 300_000, "response", None, "lm", {}), (4, "a.com/x?a=1&b=2", 300_001, "revisit", None, "lm", None), (5, "a.com/x?a=1&b=2", 300_002, "revisit", None, None, {}), (6, None, 5, "revisit", '"1"', None, {}), (7, None, 0, "response", '"1"', None, {}), (8, "", 6, "revisit", '"1"', None, {}), (9, "B.org", 10, "response", '"9"', None, {"Date": "old", "X-Own": "x", "ETag": '"9"'}), (10, "b.org/", 20, "revisit", '"9"', None, {"date": "new", "CACHE-control": "c", "x-own": "y"}), (11, "c.org", None, "response", '"3"', None, {"a": "b"}), (12, "c.org", 1, "revisit", '"3"', None, None), (12, "c.org", 1, "revisit", '"3"', None, None), (13, "c.org", 2, "metadata", '"3"', None, None)]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, slice string")).collect()}
    assert got[2].url == "a.com/x?a=1&b=2" and got[2].target_id == 1 and got[2].valid and got[2].headers == {"ETag": '"1"', "content-type": "t", "date": "d"}
    assert got[4].target_id == 3 and got[4].valid and not got[5].valid and got[6].target_id is None and not got[6].valid
    assert got[4].headers == {} and got[6].url is None and got[8].target_id is None and 13 not in got
    assert got[10].headers == {"X-Own": "x", "ETag": '"9"', "date": "new", "CACHE-control": "c"} and got[12].headers == {"a": "b"}
    assert revisits.resolve(spark.createDataFrame(rows, SCHEMA)).count() == 8 and revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_text(spark, data):
    rng = random.Random(77)
    model = html_text.trained()
    right = total = 0
    for _ in range(200):
        page = html_text.Page(html_text.labelled_page(rng))
        for (at, _), q in ((s, model.marginals(page)[s[0]]) for s in page.segments):
            total += 1
            right += (q[1] + q[2] / 2 > 0.5) == (page.states[at] == 1)
    assert right / total > 0.97
    html = '<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First   paragraph of some\nlength, with a <a href="x">link</a> in it.<p>Second paragraph, which isn&#39;t closed.</article><div class="comments"><p>Nice post, thank you very much for it.</p></div><script>var x="</p>";</script><footer>&copy; me</footer></body></html>'
    assert model.text(html) == "Title & more\nFirst paragraph of some length, with a link in it.\nSecond paragraph, which isn't closed."
    odd = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<p"), (4, "u", "<" * 5000), (5, "u", "plain words"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<!-- open <p>x")]
    odd += [(8, "u", "a < b &amp; c <p>x &#65; &#0000000066; &#" + "9" * 6000 + "; &#" + "0" * 6000 + "67;"), (9, "u", "<p title='a>b'>one</p><p title=\"x>two<p>three")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in odd], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r.text for r in html_text.extract(frame).collect()}
    assert html_text.extract(frame).count() == len(odd) and html_text.extract(frame.limit(0)).count() == 0
    assert html_text.Page(odd[-2][2]).segments == [(0, "a < b & c"), (1, "x A B \ufffd C")]
    assert [t for _, t in html_text.Page(odd[-1][2]).segments] == ["one", "two", "three"] and got[1, "u"] == got[2, None] == ""


@pytest.mark.parametrize("piece", ["<a ", "<span>", "</i>", "<section>", "<a '\">", "<head>", "<i><p><b>", "<script>x", "&#1", "<!-", "<p class='", "<td><p>", "</p><"])
def test_parsing_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_text.Page(page)
    html_text.Page("<i><p>" + "<span>" * 20_000 + "</i>" * 20_000)
    assert time.perf_counter() - began < 6


def test_marginals_equal_enumeration():
    model = html_text.trained()
    page = html_text.Page('<body><div class="menu"><p>a b</p></div><p>Some text here.</p></body>')
    got, features = model.marginals(page), page.features()
    weight = lambda at, s: math.exp(model.weights[model.kind(features[at])] * sum(model.node[f][v][s] for f, v in enumerate(features[at])))
    sums = np.zeros((len(page.tags), 3))
    for states in itertools.product(range(3), repeat=len(page.tags)):
        p = model.root[states[0]] * math.prod(weight(n, s) for n, s in enumerate(states))
        p *= math.prod(model.edge[model.kind(features[n])][states[page.parents[n]]][states[n]] for n in range(1, len(states)))
        for n, s in enumerate(states):
            sums[n, s] += p
    assert np.allclose(got, sums / sums.sum(1, keepdims=True))


def _components(texts):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join_equals_brute_force(spark, edge, empty):
    rng = random.Random(6)
    vocabulary = [f"v{n}" for n in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 4, 12, 60, 150)))] + (common if group % 2 else [])
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append((len(texts), " ".join(w)))
    texts += [(len(texts), None), (len(texts) + 1, " \t")]
    got = {r.doc_id: (r.n_grams, r.component_id) for r in ngram_join.join_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _components(texts)
    rows = ngram_join.join_components(edge).collect()
    assert len(rows) == len(EDGE) and {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, None: None, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    assert ngram_join.join_components(empty).count() == 0
    kept = ngram_join.without_copies(edge)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"] and kept.columns == edge.columns


def test_ngram_join_of_a_chain_of_copies(spark):
    rng = random.Random(9)
    words = [f"c{n}" for n in range(90)]
    texts = [(n, f"d{n} e{n} f{n} g{n} h{n}") for n in range(40)]
    for n in range(2000):  # every third text changes the last one's base for good, so that far ones don't link
        w = list(words)
        if rng.random() < 0.7:
            w[rng.randrange(90)] = f"x{n}"
        texts.append((len(texts), " ".join(w)))
        if n % 3 == 0:
            words[rng.randrange(90)] = f"y{n % 300}"
    got = {r.doc_id: (r.n_grams, r.component_id) for r in ngram_join.join_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _components(texts)
