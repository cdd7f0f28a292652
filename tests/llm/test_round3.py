"""Hard negatives, source mixing and collocations against brute force, and their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stellate.llm import collocations, hard_negatives, mixing


def _mined(rows, anchors, positives, negatives, low=30, high=90):
    """Every pair scored; rows: (id, label, vector) of integers."""
    out = set()
    cut = lambda s: max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, s))
    for a, label, v in {a[0]: a for a in sorted(anchors, reverse=True)}.values():
        near = [(-cut(sum(x * y for x, y in zip(v, w, strict=True))), i, lab == label) for i, lab, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in near if x[2])[:positives]:
            fit = sorted((t, i) for t, i, same in near if not same and low * -s <= 100 * -t <= high * -s)
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit[:negatives])}
    return out


def test_hard_negatives_equal_sql(spark, data):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = hard_negatives.op11_hard_negatives(spark, data).select(cols).toPandas().astype("int64").sort_values(cols).values.tolist()
    assert got == duckdb.sql(hard_negatives.SQL).df()[cols].astype("int64").sort_values(cols).values.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed):
    """Ties, repeated rows, a vector that a third of the rows share, two lengths, several blocks and digits of few bits."""
    r = random.Random(seed)
    scale = 4 if seed == 1 else 2**20
    rows = [(n, r.randrange(3), [3 * scale, 4 * scale] if n % 3 == 0 else [r.randrange(-9, 10) * scale for _ in range(2 if n % 5 else 3)]) for n in range(300)]
    rows += [rows[5], rows[6], (7, 1, [2**40, 2**40])]
    frame = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(5)
    anchors = frame.where("vec_id % 20 = 0")
    got = hard_negatives.mine(frame, anchors, 3, 4, together=7, bits=2 if seed == 1 else 11)
    assert {tuple(x) for x in got.collect()} == _mined(rows, [x for x in rows if x[0] % 20 == 0], 3, 4)


def test_hard_negatives_edges(spark):
    nan = float("nan")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 0, [0.25, 0.25]), (3, None, [0.5, 0.5]), (4, 0, None), (5, 0, [nan, 1.0]), (6, 0, [None, 1.0]), (None, 0, [0.25, 0.25]), (7, 0, [0.25]), (8, 0, [-1.0, 0.0]), (100, 3, [1e30, -1e30])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").withColumn("rank", F.lit("clash"))
    v = hard_negatives.quantised(frame, "vec_id", "v", F.col("label"))
    got = hard_negatives.mine(v, v.where("vec_id in (0, 100)"))
    assert [tuple(x) for x in got.collect()] == [(0, 1, 1, 2, 128 * 192, 128 * 128)]
    assert hard_negatives.mine(v.limit(0), v.limit(0)).columns == got.columns
    assert hard_negatives.mine(v.limit(0), v.limit(0)).count() == hard_negatives.mine(v, v.limit(0)).count() == 0
    assert hard_negatives.scores(np.array([[2**40]]), np.array([[-(2**40)]]))[0, 0] == -hard_negatives.LARGEST


def _levels(sizes):
    """Targets by sharing again and again, exactly."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    left, target, open_ = Fraction(3 * sum(sizes.values()), 2), dict.fromkeys(names, Fraction(0)), set(names)
    while left and open_:
        total, share = sum(weight[s] for s in open_), left
        left = Fraction(0)
        for s in sorted(open_, key=str):
            target[s] += share * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return target


def _mix_rows(seed):
    r = random.Random(seed)
    rows = [(n, " ".join(r.choice("ab") * r.randrange(1, 4) for _ in range(r.choice((0, 1, 5, 40, 300)))), r.choice(["s1", "s2", "S3", "", None, "é", "hot", "hot", "hot"])) for n in range(250)]
    return [*rows, (900, "w " * 20_000, "long"), (901, None, "none"), (902, " \t\x0b", "none"), (903, "a\x1cb c d", "tiny"), (None, "no id here", "tiny"), (904, "same", "s1"), (904, "same", "s1")]


def test_mix_holds_its_promises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 16)
    rows = _mix_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("idx", F.lit(1))
    placed, mixed = mixing.mix(docs, 8)
    places = placed.collect()
    words = lambda t: re.findall(mixing.WORD, t or "")
    assert Counter((p.doc_id, p["size"]) for p in places) == Counter((d, len(words(t))) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = _levels(sizes)
    of = {d: s for d, _, s in rows}
    by_idx = {}
    for p in places:
        assert p.source_size == sizes[of[p.doc_id]] and p.target == pytest.approx(float(want[of[p.doc_id]]))
        by_idx[p.idx] = (p.source_size, p.target)
    assert [of[next(p.doc_id for p in places if p.idx == n)] for n in range(len(by_idx))] == sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    slots, taken, by_doc, blocks = defaultdict(int), Counter(), Counter(), defaultdict(Counter)
    for m in mixed.collect():
        slots[m.shard, m.idx, m.i] += m.length
        taken[m.idx] += m.length
        by_doc[m.idx, m["at"]] += m.length
        assert m.start >= 0 and m.block == (m["at"] + m.start) // 8 == (m["at"] + m.start + m.length - 1) // 8
        blocks[m.idx][m.block, m.i] = 1
    assert max(slots.values()) <= 8
    shards = Counter(shard for shard, _, _ in slots)
    assert sorted(shards.values())[1:].count(16) == len(shards) - 1  # every shard but the last is full
    for idx, (size, target) in by_idx.items():
        assert abs(taken[idx] - target) <= 8
        nums = sorted(i for _, n, i in slots if n == idx)
        assert nums == list(range(len(nums)))
        seen = [b for b, _ in blocks[idx]]
        n = -(-size // 8)
        assert max(Counter(seen).values(), default=0) - min([Counter(seen)[b] for b in range(n)], default=0) <= 1  # no block twice before each was taken once
    for p in places:
        assert by_doc[p.idx, p["at"]] <= 2 * p["size"] or p["size"] == 0
    unique = docs.where("doc_id is not null and doc_id <> 904")
    text = mixing.texts(mixed, unique)
    whole = {d: words(t) for d, t, _ in rows if d not in (None, 904)}
    cut = defaultdict(list)
    for m in mixed.where("doc_id is not null and doc_id <> 904").orderBy("at").collect():
        cut[m.shard, m.idx, m.i] += whole[m.doc_id][m.start : m.start + m.length]
    assert {(t.shard, t.idx, t.i): t.text for t in text.collect()} == {k: " ".join(v) for k, v in cut.items()}


def test_mix_repeats_itself_whatever_the_partitions(spark):
    docs = spark.createDataFrame(_mix_rows(4), "doc_id long, text string, source string")
    of = lambda d: sorted(map(str, mixing.mix(d)[1].collect()))
    assert of(docs) == of(docs.repartition(7))
    assert mixing.mix(docs.limit(0))[1].count() == 0 == mixing.mix(docs.where("source = 'none'"))[1].count()


def test_permutations(spark):
    for n in (1, 2, 3, 10, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or sum(a == b for a, b in enumerate(got)) < 20


def test_shards_are_drawn_by_share(spark):
    sources = spark.createDataFrame([(0, 30_000, 0), (1, 10_000, 30_000), (2, 0, 40_000), (3, 20_000, 40_000)], "idx long, slots long, first long")
    by = {(r.shard, r.idx): r["count"] for r in mixing.assigned(spark, sources).groupBy("shard", "idx").count().collect()}
    n = [by.get((s, 0), 0) for s in range(58)]
    assert abs(sum(n) / len(n) - 512) < 8 and 8 < float(np.std(n)) < 24  # the deviation of a multinomial count is 16


def _mined_phrases(rows, max_n=4, least=3, explained=80, kept=2000):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        own = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= explained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                s, _, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, k) for k in range(1, len(p)))
                own.append((-s, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], totals[lang], s))
        out += [(lang, n + 1, *x[3:]) for n, x in enumerate(sorted(own)[:kept])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_collocations_equal_brute_force(spark, seed):
    bits = collocations.ROW_BITS if seed == 3 else collocations.BITS  # few bits: many false hits
    r = random.Random(seed)
    vocabulary = [*"abcdefgh", "Ab", "É", "é", "x y", *[f"rare{n}" for n in range(200)]]
    text = lambda: "".join(r.choices(vocabulary, [9] * 12 + [1] * 200)[0] + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(r.choice((0, 1, 30, 400))))
    rows = [(r.choice(["en", "de", None, "und"]), text()) for _ in range(60)] + [("en", None), ("en", ""), ("fr", "..."), (None, "the same words here " * 50)] + [("en", "New York City Hall is here")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = collocations.collocations(docs, least=3, kept=40, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in got.collect()) == _mined_phrases(rows, kept=40)
    longer = collocations.collocations(docs, max_n=6, least=8).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in longer.collect()) == _mined_phrases(rows, 6, 8)


def test_words_of_batches():
    texts = ["", "A b", "c", "", "d. e\x0bf", "É", " ", "Z"]
    cut = [(w.as_py(), int(p), int(t)) for w, p, t in zip(*collocations.words_of(pa.array(["skipped", *texts], pa.large_string())[1:]), strict=True)]
    assert [w for w, _, _ in cut] == ["a", "b", "c", "d", "e", "f", "É", "z"]
    assert [t for _, _, t in cut] == [1, 1, 2, 4, 4, 4, 5, 7]
    assert [n for n, (a, b) in enumerate(itertools.pairwise(cut)) if a[1] == b[1]] == [0]
    frames = [pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})]
    assert sorted(x for b in collocations._exploded(iter(frames), range(1, 3), None, None, 3) for x in b["phrase"].to_pylist()) == sorted(["a", "b", "a b", "c", "d", "e", "f", "É", "z"])


def test_collocations_equal_sql(spark, data):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.op13_collocations(spark, data).select(cols).toPandas().astype(str).values.tolist()
    assert sorted(got) == sorted(duckdb.sql(collocations.SQL).df()[cols].astype(str).values.tolist())


def test_collocations_count_rare_pairs_by_number(spark, monkeypatch):
    """Of 40 frequent words in random order few pairs are frequent: only those, their triples and so on are counted by their text."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{n}" for n in range(40)], k=300)) + ". one two three four" for _ in range(30)]
    docs, seen, counts = spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), [], collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda *args, **named: seen.append(counts(*args, **named)) or seen[-1])
    got = {x.phrase for x in collocations.collocations(docs, least=20, explained=101).collect()}
    assert {"one two", "one two three", "two three four", "one two three four"} <= got
    assert sum(c.where("size > 1").count() for c in seen) <= 60  # there are 1,600 pairs


def test_collocations_edges(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), ("en", "?!")], "lang string, text string"), least=1).count() == 0
    big = spark.createDataFrame([("en", "one two " * 100_000)], "lang string, text string")
    got = collocations.collocations(big, max_n=2, least=5).collect()
    assert [(x.phrase, x.a, x.l, x.r, x.score) for x in got] == [("one two", 100_000, 100_000, 100_000, 1_000_000), ("two one", 99_999, 100_000, 100_000, 999_990)]


def test_every_licence_template_is_found(spark):
    from stellate.llm import licenses

    rows = [(n, f"some words before\n\n{text.upper()}\n\nand after") for n, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[n, name] == 1.0 for n, (name, _) in enumerate(licenses.TEMPLATES))


def test_pitman_yor_scores_do_not_depend_on_partitions(spark, data):
    from stellate.llm import pitman_yor

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r.doc_id: (r.score, r.base_score) for r in pitman_yor.score(docs, bucket_bytes=1 << 14).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(v == pytest.approx(found[1][k], rel=1e-9) for k, v in found[0].items())


def test_pitman_yor_sweeps_once_for_totals_and_answers(monkeypatch):
    import pandas as pd

    from stellate.llm import pitman_yor as py

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 300, 6_000) * py.CONTEXTS + rng.integers(0, 400, 6_000))
    spread, contexts, counts = np.bincount(keys // py.CONTEXTS, minlength=300), keys % py.CONTEXTS, rng.zipf(1.6, len(keys)).clip(max=5_000) - 1
    row = pd.DataFrame([(0, spread.astype("<u4").tobytes(), contexts.astype("<u2").tobytes(), counts.astype("<u8").tobytes(), [5], [np.diff(np.arange(len(keys)), prepend=0).astype("<u4").tobytes()])], columns=["bucket", "spread", "contexts", "counts", "chunks", "places"])
    p = py.Settings(400, int(counts.sum()), np.bincount(contexts, counts, py.CONTEXTS), 0.6)
    own = py.Seating.of(next(row.itertuples()))
    start = py._first_totals(next(row.itertuples()), p)
    others = start - start
    kept = [(own.totals(), own.probability(own.totals(), p)) for k in own.sweeps(0, p, others, py.BURN_IN + py.KEPT) if k >= py.BURN_IN]

    seated = pd.concat(py._seated(iter([row]), p, start))
    monkeypatch.setattr(py.Seating, "sweep", None)  # answers take the written tables
    sums = pd.concat(py._kept_totals(iter([seated, seated])))
    assert sorted(set(sums["sweep"])) == list(range(py.BURN_IN, py.BURN_IN + py.KEPT))
    first = sums[(sums["sweep"] == py.BURN_IN) & (sums["class"] == 7)]["tables"].iloc[0]
    assert (np.frombuffer(first, "<f8")[: py.SLOTS] == 2 * kept[0][0].contexts.reshape(py.SLOTS, py.CLASSES)[:, 7]).all()
    answers = pd.concat(py._answers(iter([seated]), p, {py.BURN_IN + k: t for k, (t, _) in enumerate(kept)}))
    mean = sum(x / py.KEPT for _, x in kept)
    assert (np.frombuffer(answers["logs"].iloc[0], "<f4") == np.log10(mean).astype("<f4")).all()


def test_pitman_yor_distinct_keys():
    from stellate.llm.pitman_yor import _distinct

    for keys in ([], [0], [4, 1, 4, 0, 1 << 36], [1 << 62, 3, 1 << 62]):  # the last ones leave no room for places
        keys = np.array(keys, np.int64)
        for got, want in zip(_distinct(keys), np.unique(keys, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)
