"""The corpus pipeline, stage by stage on small tables."""

import itertools
import random

import corpus_pipeline
from stellate.llm import decontaminate, ngram_join, toxicity
from stellate.llm.common import written


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept, inputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = written(stage(spark, docs, data), "test")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = inputs["toxicity"]
    scored = toxicity.score(first, toxicity.train(first, spark.read.parquet(f"{data}/labels.parquet")))
    assert ids(kept["toxicity"]) == ids(scored.where(f"toxicity < {toxicity.THRESHOLD}"))
    groups = ngram_join.join_components(inputs["near duplicates"]).collect()
    assert ids(kept["near duplicates"]) == {r.component_id for r in groups}
    found = decontaminate.contaminated(inputs["decontamination"], spark.read.parquet(f"{data}/benchmark.parquet"))
    assert ids(kept["decontamination"]) == ids(inputs["decontamination"]) - ids(found)
    assert ids(kept["pii"]) == ids(inputs["pii"]) == ids(kept["packing"])
    assert kept["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def _kept_by_brute_force(texts, words=5, percent=80):
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(d) for d in sets}


def test_near_duplicates_equal_brute_force(spark, data):
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, other = fresh(1000), fresh(1000)
    spread = [w if n % 50 != 25 else "changed" + str(n) for n, w in enumerate(other)]
    texts = [base, base[:820], other, spread, base[:500]]
    for _ in range(10):
        own = fresh(rng.choice((5, 30, 120)))
        for changes in (0, 1, 1, 2, 3):
            w = list(own)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            texts.append(w[: rng.randint(len(w) * 4 // 5, len(w))])
    rows = [(n, " ".join(w)) for n, w in enumerate(texts)]
    want = _kept_by_brute_force(rows)
    assert 1 not in want and 3 not in want and 4 in want
    assert want != _kept_by_brute_force(rows, 4, 85)
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), data)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_stages_on_odd_rows(spark, data):
    long = " ".join(f"w{n}" for n in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (None, "no id at all", None, None, 12), (3, long, "en", "a", len(long)), (4, "mail x@y.zz now please", "en", "a", 22), (4, "mail x@y.zz now please", "en", "a", 22), (5, "one word", "en", "a", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, _spans string, node long"
    frame = spark.createDataFrame([(*r, 0.5, "s", 7) for r in rows], schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, data), "test")
            assert docs.columns == frame.columns, name
        got = docs.collect()
        assert sorted(str(r.doc_id) for r in got) == (["1", "2", "3", "4", "5", "None"] if got else [])
        assert all((r.toxicity, r["_spans"], r.node) == (0.5, "s", 7) for r in got)
        assert {r.doc_id: r.text for r in got}.get(4) in (None, "mail [EMAIL] now please")
        pieces = corpus_pipeline.pack(spark, docs, data).collect()
        assert len({r.doc_id for r in pieces}) == len(got)
