"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers are composed into one machine, which reads a clause's token classes and emits weights: a lexical
transducer turns tokens into the classes insult (with a learned weight), threat, target, negation
and reported speech; an aiming transducer raises insults near a target and damps those without, and emits a threat only with its target: within a few tokens after it, or
(where the language puts objects there) before it; a negation transducer damps what follows a negation within a few
tokens; a reported-speech transducer damps what is only quoted or named as a word. A clause scores what the machine emits on its way through
it, and a text's clauses are summed, squashed and calibrated. A target, a negation or a report alone is no pattern, and neither is a threat without a target.

The insults are learned: words and word beginnings that labelled toxic texts hold far more often than clean ones, in either half of them,
from a bounded sample of labelled training rows (`SAMPLE` rows, by hash order of doc_id), as is the
calibration. Threats aren't learned, as labelled texts have too few; an aimed one weighs as much as brings a text to `THREATENING` by the calibration. Copies in the sample count once: texts of one label that share half of a sketch, the `SKETCH` least hashes of
three words in a row. Labels of held-out rows, lang, source and doc_id never enter a score.

Defined results: null and empty texts score as texts without any match; repeated rows score alike; a null doc_id
counts as the empty text in the fold; without labelled rows of both kinds nothing is learned and all texts score alike but for
aimed threats; an empty table gives an empty result; score() keeps every other column, and replaces one of the name it is asked for.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, importable, lean, table

#: Labelled training rows that are learned from at most, the threshold, hashes of a sketch.
SAMPLE, THRESHOLD, SKETCH = 20_000, 0.7, 16
#: A learned entry needs so many toxic texts, this share of the toxic texts, and this log-odds at least.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 4, 0.005, 4.0
#: Or else, lower log-odds with this larger share. And the log-odds by which a longer entry must exceed a shorter one.
OFTEN_SHARE, OFTEN_ODDS, REPLACED = 0.04, 2.0, 0.7
NEGATION = frozenset("not no never neither nor none nobody nothing without hardly isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot couldn't shouldn't nicht kein keine keinen keiner keinem nie niemals niemand nichts ohne weder kaum pas jamais aucun aucune personne rien sans ni guère nunca jamás ningún ninguna ninguno nadie nada sin tampoco".split())
REPORTED = frozenset("word words term phrase wort wörter begriff mot mots terme palabra palabras término said say says told wrote writes reported reportedly quoted quote cited claimed claims called alleged allegedly stated according asked shouted sagte sagt sagten schrieb schreibt laut zitierte behauptete behauptet angeblich meinte rief dit disait écrit écrivait selon affirme affirmait déclaré prétend cité raconte dijo dice decía escribió según afirmó afirma declaró citó contó alegó".split())
TARGET = frozenset("you your yours yourself yourselves you're you've u ur they them their he him his she her du dich dir dein deine deinen deiner ihr euch euer eure sie ihn ihm ihnen tu toi te ton ta tes vous votre vos lui elle eux leur leurs tú ti tus usted ustedes vosotros vosotras vuestro vuestra él ella ellos ellas".split())
#: Targets that may stand before the verb that they are the object of.
OBJECT = frozenset("dich dir euch ihn ihm ihnen te toi vous os".split())
#: Threats whose target follows, and verbs whose target may stand on either side.
THREAT = frozenset("kill kills killed murder hurt hang destroy beat shoot stab strangle slaughter burn bury cripple punch smash slap poison mataré tuerai töte".split())
VERB = frozenset("töten umbringen ermorden erschießen erstechen verprügeln schlagen zerstören vernichten erwürgen aufhängen verbrennen tuer assassiner frapper détruire égorger étrangler pendre poignarder massacrer brûler matar asesinar golpear destruir apuñalar estrangular degollar ahorcar quemar disparar".split())
#: What a target that follows an insult weighs, factors of insults near a target and without one, and the score of a text with one aimed threat.
AIM_WEIGHT, NEAR, LONE, THREATENING = 0.5, 1.25, 0.5, 0.85
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n|,]+")
_ENDS = ".!?;:\n|,"


def _lowered(text: str | None) -> str:
    """Lower case, with plain apostrophes."""
    return (text or "").lower().replace("’", "'")


@dataclass(frozen=True)
class Transducer:
    """States with arcs (state, class) -> (next state, factor on what the class emits); other classes take `other`."""

    start: object
    arcs: dict = field(default_factory=dict)
    other: dict = field(default_factory=dict)  # state -> next state

    def step(self, state: object, token_class: str) -> tuple[object, float]:
        return self.arcs.get((state, token_class)) or (self.other.get(state, state), 1.0)


def compose(*parts: Transducer) -> Transducer:
    """The product machine: all parts step together and their factors multiply."""
    classes = ("insult", "threat", "verb", "target", "object", "negation", "reported", "word")
    start, arcs, todo = tuple(p.start for p in parts), {}, [tuple(p.start for p in parts)]
    while todo:
        state = todo.pop()
        for c in classes:
            if (state, c) not in arcs:
                steps = [p.step(s, c) for p, s in zip(parts, state, strict=True)]
                arcs[state, c] = (tuple(s for s, _ in steps), math.prod(f for _, f in steps))
                todo.append(arcs[state, c][0])
    return Transducer(start, arcs)


def _counting(trigger: str, reach: int, factor: float) -> Transducer:
    """After a trigger, insults and threats within `reach` tokens are emitted with a factor, and so are the targets that threats wait for."""
    arcs: dict = {(n, trigger): (reach, 1.0) for n in range(reach + 1)}
    arcs |= {(n, c): (n - 1, factor) for n in range(1, reach + 1) for c in ("insult", "target", "object")}
    arcs |= {(n, c): (reach, factor) for n in range(1, reach + 1) for c in ("threat", "verb")}  # a target may still come
    return Transducer(0, arcs, {n: n - 1 for n in range(1, reach + 1)})


def _aiming(before: int, after: int, threat: float) -> Transducer:
    """States: tokens that a target still reaches, that an object still reaches, that an insult or a threat still waits for its target, and which of both waits.

    threat: the factor of a target that a threat has waited for."""
    span, less = range(before + 1), lambda n: max(0, n - 1)
    states = [(t, o, w, k) for t in span for o in span for w in range(after + 1) for k in ("", "insult", "threat") if bool(w) == bool(k)]
    arcs: dict = {}
    for t, o, w, k in states:
        aimed = (threat if k == "threat" else 1.0) if w else 0.0
        arcs[(t, o, w, k), "target"] = ((before, less(o), 0, ""), aimed)
        arcs[(t, o, w, k), "object"] = ((before, before, 0, ""), aimed)
        waits = (w - 1, "threat" if w > 1 else "") if k == "threat" else (after, "insult")
        arcs[(t, o, w, k), "insult"] = ((less(t), less(o), *waits), NEAR if t else LONE)
        arcs[(t, o, w, k), "threat"] = ((less(t), less(o), after, "threat"), 0.0)
        arcs[(t, o, w, k), "verb"] = ((less(t), less(o), 0, ""), 1.0) if o else ((less(t), less(o), after, "threat"), 0.0)
    return Transducer((0, 0, 0, ""), arcs, {(t, o, w, k): (less(t), less(o), less(w), k if w > 1 else "") for t, o, w, k in states})


@functools.cache
def grammar(threat: float) -> Transducer:
    """The whole machine; threat: what an aimed threat weighs."""
    return compose(
        _counting("negation", 3, 0.5),
        Transducer("own", {("own", "reported"): ("quoted", 1.0), **{("quoted", c): ("quoted", 0.6) for c in ("insult", "verb", "target", "object")}}),
        _aiming(4, 3, threat / AIM_WEIGHT),
    )


class Lexicon:
    """Weights of whole words and of word beginnings; the longest known one decides."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.sizes = sorted({len(b) for b in beginnings}, reverse=True)
        self.stems = sorted({*words, *beginnings, *THREAT, *VERB})
        self.finder = None

    def may_match(self, text: str) -> bool:
        """Whether any entry or threat stands anywhere in the (lower-case) text; all others score 0, and most texts need no more than this."""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for s in self.stems:
                self.finder.add_word(s, s)
            self.finder.make_automaton()
        return next(self.finder.iter(text), None) is not None

    def weight(self, word: str) -> float:
        if (w := self.words.get(word)) is not None:
            return w
        return next((w for n in self.sizes if (w := self.beginnings.get(word[:n])) is not None), 0.0)


def clause_scores(text: str, lexicon: Lexicon, threat: float) -> Iterator[float]:
    """What the machine emits for each clause of a lower-case text; threat: what an aimed threat weighs."""
    machine = grammar(threat)
    state, total = machine.start, 0.0
    for token in _TOKEN.findall(text):
        if token[0] in _ENDS:
            yield total
            state, total = machine.start, 0.0
            continue
        if weight := lexicon.weight(token):
            token_class = "insult"
        elif token in THREAT:
            token_class = "threat"
        elif token in VERB:
            token_class, weight = "verb", threat
        elif token in TARGET:
            token_class, weight = "object" if token in OBJECT else "target", AIM_WEIGHT
        else:
            token_class = "negation" if token in NEGATION else "reported" if token in REPORTED else "word"
        state, factor = machine.step(state, token_class)
        total += factor * weight
    yield total


def raw_score(text: str | None, lexicon: Lexicon, threat: float = 0.0) -> float:
    text = _lowered(text)
    return math.log1p(sum(clause_scores(text, lexicon, threat))) if lexicon.may_match(text) else 0.0


@dataclass
class Model:
    lexicon: Lexicon
    slope: float
    offset: float

    @property
    def threat(self) -> float:
        """The weight that brings a text without anything else to THREATENING; none, if nothing was learned that tells texts apart."""
        raw = (math.log(THREATENING / (1 - THREATENING)) - self.offset) / self.slope if self.slope > 0.1 else 0.0
        return math.expm1(max(0.0, min(20.0, raw)))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * raw_score(text, self.lexicon, self.threat)))))


@lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SKETCH least hashes of three words in a row."""
    for batch in batches:
        out = []
        for text in batch.column(1):
            words = _lowered(text.as_py()).split()
            out.append(heapq.nsmallest(SKETCH, {zlib.crc32(" ".join(words[n : n + 3]).encode()) for n in range(max(1, len(words) - 2))}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "sketch"])


def without_copies(sketches: dict[int, list[int]], labels: dict[int, int]) -> list[int]:
    """Ids without those whose sketch shares half with that of a smaller id of the same label.

    Of a sketch of n hashes, only the n // 2 + 1 that fewest sketches hold are looked up: one of them is in every sketch that shares half of it."""
    counts = Counter(h for s in sketches.values() for h in s)
    leaders: dict[tuple[int, int], list[int]] = defaultdict(list)
    kept = []
    for d in sorted(sketches):
        own = set(sketches[d])
        rarest = sorted(own, key=lambda h: (counts[h], h))[: len(own) // 2 + 1]
        met = {k for h in rarest for k in leaders[labels[d], h]}
        if not any(2 * len(own & set(sketches[k])) >= max(len(own), len(sketches[k])) for k in met):
            kept.append(d)
            for h in rarest:
                leaders[labels[d], h].append(d)
    return kept


@lean
def _counts(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word, and each word beginning of 4 to 7 letters (with a star), counted for a whole task; n of all texts, half of those whose id has an odd crc32."""
    found: Counter[str] = Counter()
    odd: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in _TOKEN.findall(_lowered(text)) if w[0] not in _ENDS}
            own = words | {w[:n] + "*" for w in words for n in range(4, 8) if len(w) > n}
            own = own if wanted is None else own & wanted
            found.update(own)
            if zlib.crc32(str(doc_id).encode()) % 2:
                odd.update(own)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([odd[w] for w in found], pa.int64())], names=["entry", "n", "half"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon and its calibration, from at most `sample` labelled rows outside the held-out fold.

    The sample's ids (at most `sample` of them) are sent to one scan of docs that counts, and one that scores."""
    spark = importable(docs.sparkSession)
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = {r.doc_id: r.toxic for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    ids = spark.createDataFrame([(int(d),) for d in toxic], "doc_id long")
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    # one text of each group of near copies, or their chance words would pass for insults; at most `sample` sketches come to the driver
    sketches = {r.doc_id: r.sketch for r in own.mapInArrow(_sketches, "doc_id long, sketch array<long>").collect()}
    toxic = {d: toxic[d] for d in without_copies(sketches, toxic)}
    sent = spark.sparkContext.broadcast(toxic)

    def rows_of(label: int | None) -> DataFrame:
        chosen = [(int(d),) for d, t in toxic.items() if label in (None, t)]
        return own.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")

    def counts(label: int, wanted: frozenset[str] | None) -> DataFrame:
        return rows_of(label).mapInArrow(lambda b: _counts(b, wanted), "entry string, n long, half long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("half").alias("half"))

    n_toxic = max(1, sum(toxic.values()))
    n_clean = max(1, len(toxic) - n_toxic)
    # entries that enough toxic texts hold (each in so large a share of them that the sample bounds their number), in either half of
    # them, or words of one text's kind would pass by chance; then how many clean texts hold those
    least = max(LEAST_TEXTS, LEAST_SHARE * n_toxic)
    often = {r.entry: r.n for r in counts(1, None).where((F.col("n") >= least) & F.col("half").between(least / 4, F.col("n") - least / 4)).collect()}
    clean = {r.entry: r.n for r in counts(0, frozenset(often)).collect()}
    found = []
    for entry, n in often.items():
        odds = math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(entry, 0) + 0.5) / (n_clean + 1))
        if odds >= LEAST_ODDS or (odds >= OFTEN_ODDS and n >= OFTEN_SHARE * n_toxic):
            found.append((len(entry.rstrip("*")), not entry.endswith("*"), entry.rstrip("*"), odds))
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for size, whole, entry, odds in sorted(found):  # an entry that a shorter one all but replaces is left out
        if not any(odds <= beginnings.get(entry[:n], -math.inf) + REPLACED for n in range(4, size + 1)):
            (words if whole else beginnings)[entry] = odds
    lexicon = Lexicon(words, beginnings)
    pairs = rows_of(None).mapInArrow(lambda b: _sample_scores(b, sent.value, lexicon), "x double, toxic long, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()
    slope, offset = _calibrated(np.array([[p.x, p.toxic, p.n] for p in pairs], float).reshape(-1, 3))
    return Model(lexicon, slope, offset)


@lean
def _sample_scores(batches: Iterator[pa.RecordBatch], toxic: dict[int, int], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter((round(raw_score(t, lexicon), 2), toxic[d]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.float64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["x", "toxic", "n"])


def _calibrated(rows: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a logistic regression by Newton's method with a small ridge."""
    if not len(rows) or len(np.unique(rows[:, 1])) < 2:
        return 1.0, -4.0
    x, y, n = np.column_stack([rows[:, 0], np.ones(len(rows))]), rows[:, 1], rows[:, 2]
    beta = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge * beta
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(beta[0], 0.0)), float(beta[1])


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs with a column of scores (0 to 1) at its end; one pass without a shuffle."""
    sent = importable(docs.sparkSession).sparkContext.broadcast((model.lexicon.words, model.lexicon.beginnings, model.slope, model.offset))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, beginnings, slope, offset = sent.value
        own = Model(Lexicon(words, beginnings), slope, offset)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t.as_py()) for t in batch.column(at)], pa.float64())], names=[*batch.schema.names, column])

    docs = docs.drop(column)
    return docs.mapInArrow(scan, StructType([*docs.schema, StructField(column, DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
