"""Hierarchical Pitman-Yor language model of three levels, its seating sampled by Gibbs.

Restaurants of contexts share parents: a token's context is the word before it, by a hash within the class of its
ending (`SLOTS` restaurants for each of `CLASSES` classes, so frequent words mostly have one of their own, and rare words of one
ending share); the tables of these are the customers of their class's restaurant, whose tables are the customers of the
root, whose base is uniform over the V known words and one unknown word. A sweep takes the pairs of a dish and a context in groups: their
customers leave, with the tables that go with them at every level, and sit down again one by one, given all others. Predictive
probabilities are averaged over the sweeps after burn-in. Discounts come from the counts of counts.

Counting, sampling and scoring are three shuffles. Tasks read chunks of texts and send their distinct (context, word)
pairs with training counts, packed, to buckets of the hash space (1: counts). A bucket holds all pairs of its words at every level, so it
samples their seating alone, given the numbers of customers and tables in the other buckets' restaurants; those
totals (a few numbers a restaurant, so at most a few MB) are exchanged between the buckets through the driver, once before and once
after the kept sweeps. These sweeps run once: a bucket's tables after each are written beside its pairs. The buckets answer each chunk's pairs (2: answers), and meet the chunk's
tokens again (3). Chunks are made twice, by the same code from the same scan: docs must be a deterministic read,
such as a table (a mismatch in a chunk's documents or pairs raises an error).

Defined results: null and empty texts hold the end token only; repeated rows are documents each; a null doc_id counts
as the empty text in the fold; without training rows every score is that of the uniform base; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, held_out, lean, release, table, written

#: Classes of contexts, restaurants of each class, tokens of a chunk, words that a task remembers.
CLASSES, SLOTS, CHUNK, REMEMBERED = 64, 1024, 750_000, 150_000
CONTEXTS = CLASSES * SLOTS
#: Sweeps that are thrown away, sweeps that are averaged, groups of a sweep; concentration of every restaurant.
BURN_IN, KEPT, GROUPS, THETA, SEED = 1, 3, 4, 1.0, 11
#: Bytes of text for each bucket. The number of buckets is part of the model (a bucket knows the others' last totals only), so it follows from the data alone.
BUCKET_BYTES = 4 << 20
#: Rows of a frame that a task sends.
ROWS = 512
END = 0
_PUNCTUATION = b".,;:!?*#$%&|\"'()[]"


class Words:
    """`places` of words (bytes) in `hashes` and `contexts` (slot * CLASSES + class); place 0 is the end token."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.places = defaultdict(count(1).__next__)
        self.hashes, self.contexts = np.array([END], np.uint64), np.zeros(1, np.int64)

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and contexts of all places, after those of new words were added."""
        new = list(islice(self.places, len(self.hashes) - 1, None))
        hashes = np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)), np.uint64(1))
        endings = np.fromiter(map(zlib.crc32, [(w.rstrip(_PUNCTUATION) or w)[-2:] for w in new]), np.int64, len(new))
        self.hashes = np.concatenate([self.hashes, hashes])
        self.contexts = np.concatenate([self.contexts, (hashes >> np.uint64(20)).astype(np.int64) % SLOTS * CLASSES + 1 + endings % (CLASSES - 1)])
        return self.hashes, self.contexts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of keys of at least 0: a plain sort of keys with their places, where both fit into 63 bits."""
    bits = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    ordered, at = both >> bits, both & ((1 << bits) - 1)
    new = np.diff(ordered, prepend=-1) != 0
    inverse = np.empty(len(keys), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return ordered[new], inverse


@dataclass
class Chunk:
    """Distinct (word, context) pairs sorted by word hash, and of each token its pair."""

    id: int
    doc_ids: list
    held: np.ndarray
    lengths: np.ndarray  # tokens of each document, with its end
    words: np.ndarray  # distinct hashes, sorted
    pair_word: np.ndarray
    pair_context: np.ndarray
    token_pair: np.ndarray

    def borders(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the buckets in words, and in pairs."""
        at = np.searchsorted(self.words, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
        at = np.concatenate([[0], at, [len(self.words)]])
        return at, np.searchsorted(self.pair_word, at)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of a task's rows (doc_id, text as bytes, held out)."""
    words, made = Words(), 0
    first = TaskContext.get().partitionId() << 32
    ids, held, parts, size = [], [], [], 0

    def close() -> Chunk:
        nonlocal made, ids, held, parts, size
        tokens = np.concatenate(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        hashes, contexts = words.known()
        context = np.concatenate([[0], contexts[tokens[:-1]]])  # the end token before each first one has context 0
        places = np.flatnonzero(np.bincount(tokens))
        order = np.argsort(hashes[places], kind="stable")
        rank = np.zeros(len(hashes), np.int64)
        rank[places[order]] = np.arange(len(order))
        keys, token_pair = _distinct(rank[tokens] * CONTEXTS + context)
        out = Chunk(first + made, ids, np.array(held, bool), lengths, hashes[places][order], keys // CONTEXTS, keys % CONTEXTS, token_pair)
        ids, held, parts, size, made = [], [], [], 0, made + 1
        if len(words.places) > REMEMBERED:
            words.reset()
        return out

    for batch in batches:
        for doc_id, text, is_held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            split = text.as_py().lower().split() if text.is_valid else []
            own = np.empty(len(split) + 1, np.int64)
            own[:-1] = np.fromiter(map(words.places.__getitem__, split), np.int64, len(split))
            own[-1] = 0
            ids.append(doc_id)
            held.append(is_held)
            parts.append(own)
            size += len(own)
            if size >= CHUNK:
                yield close()
    if ids:
        yield close()


@lean
def _requests(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        trained = np.repeat(~c.held, c.lengths)
        counts = np.bincount(c.token_pair[trained], minlength=len(c.pair_word))
        at, pairs_at = c.borders(buckets)
        rows = []
        for b in range(buckets):
            if at[b] < at[b + 1]:
                own = slice(pairs_at[b], pairs_at[b + 1])
                rows.append((b, c.id, c.words[at[b] : at[b + 1]].astype("<u8").tobytes(), np.bincount(c.pair_word[own] - at[b], minlength=at[b + 1] - at[b]).astype("<u4").tobytes(), c.pair_context[own].astype("<u2").tobytes(), counts[own].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(2, 6)]], names=["bucket", "chunk", "words", "spread", "contexts", "counts"])


MERGED = "bucket int, spread binary, contexts binary, counts binary, chunks array<long>, places array<binary>, n_tokens long, n_words long, once long, twice long"
#: Sums over the buckets: number of a sweep (-1: customers, which stay), class, and the class's tables by slot, of the class itself, of the root.
SUMS = "sweep int, class int, tables binary"


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's pairs over all chunks, and where each chunk's pairs lie among them."""
    words = [np.frombuffer(w, "<u8") for w in frame["words"]]
    all_words = np.unique(np.concatenate(words))
    keys = []
    for w, spread, contexts in zip(words, frame["spread"], frame["contexts"], strict=True):
        keys.append(np.repeat(np.searchsorted(all_words, w), np.frombuffer(spread, "<u4")) * CONTEXTS + np.frombuffer(contexts, "<u2"))
    ends = np.cumsum([len(k) for k in keys])
    pairs, inverse = _distinct(np.concatenate(keys))
    counts, places = np.zeros(len(pairs), np.int64), []
    for at, c in zip(np.split(inverse, ends[:-1]), frame["counts"], strict=True):
        counts[at] += np.frombuffer(c, "<u4")  # a chunk names a pair once
        places.append(np.diff(at, prepend=0).astype("<u4").tobytes())
    by_word = np.bincount(pairs // CONTEXTS, counts, len(all_words))
    row = (frame["bucket"].iloc[0], np.bincount(pairs // CONTEXTS, minlength=len(all_words)).astype("<u4").tobytes(), (pairs % CONTEXTS).astype("<u2").tobytes(), counts.astype("<u8").tobytes(), list(frame["chunk"]), places, int(counts.sum()), int((by_word > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum()))
    release()
    return pd.DataFrame([row], columns=[c.split()[0] for c in MERGED.split(", ")])


#: A parent whose probability doesn't change: what it weighs, and what a customer adds.
FIXED = (1e18, 0.0)


def sit(seated: np.ndarray, tables: np.ndarray, more: np.ndarray, offset: np.ndarray, below: np.ndarray, discount: float, rng: np.random.Generator, parent: tuple = FIXED) -> np.ndarray:
    """Tables of each dish after `more` customers have joined those seated, one by one.

    A new table weighs (offset + discount * the tables opened since) times the parent's probability: `below` at first, and as a
    table sends a customer to the parent, who weighs parent[0] without it and counts parent[1] for the dish, more with every table opened. Beyond 64
    customers they come in groups of a sixteenth of those seated, over which the chance of a new table hardly changes."""
    tables, n, left, opened = tables.copy(), seated.copy(), more.copy(), np.zeros(len(more), np.int64)
    weight, gain = (np.broadcast_to(x, more.shape) for x in parent)
    first = (n == 0) & (left > 0)
    for x in (tables, n, opened):
        x[first] += 1
    left[first] -= 1
    active = np.flatnonzero(left > 0)
    t, n, left, o, offset, below, gain, weight = (x[active] for x in (tables, n, left, opened, offset, below * weight, gain, weight))  # of those who still come
    while len(active):
        m = np.minimum(np.maximum(n // 16 * (n >= 64), 1), left)
        new = (offset + discount * o) * (below + gain * o) / (weight + o)
        p = new / (new + n - discount * t)
        drawn = rng.random(len(active)) < p if (m == 1).all() else rng.binomial(m, p)
        t, o, n, left = t + drawn, o + drawn, n + m, left - m
        stay = left > 0
        if not stay.all():
            tables[active] = t
            active, t, n, left, o, offset, below, gain, weight = (x[stay] for x in (active, t, n, left, o, offset, below, gain, weight))
    return tables


@lru_cache(4)
def closing(discount: float, most: int = 64) -> np.ndarray:
    """At [c, t]: the probability that one of c customers at t tables sits alone, by ratios of generalised Stirling numbers."""
    out, s = np.zeros((most + 1, most + 1)), np.zeros(most + 2)
    s[1] = out[1, 1] = 1.0
    for c in range(1, most):
        new = np.zeros(most + 2)
        t = np.arange(1, c + 2)
        new[t] = s[t - 1] + np.maximum(c - discount * t, 0) * s[t]
        out[c + 1, t] = s[t - 1] / new[t]
        s = new
    return out


def leave(seated: np.ndarray, tables: np.ndarray, fewer: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after `fewer` of its customers, drawn at random, have left one by one (in groups of a sixteenth beyond 64, as they come).

    About `discount` of many tables have a single customer, and 2 * tables - customers of them at least."""
    out, left = np.where(fewer < seated, tables, 0), np.where(fewer < seated, fewer, 0)
    alone = closing(discount)
    active = np.flatnonzero(left > 0)
    own, c, left = out[active], seated[active], left[active]
    while len(active):
        few = c < len(alone)
        p = np.where(few, alone[np.where(few, c, 0), np.where(few, own, 0)], np.maximum(discount * own, 2 * own - c) / np.maximum(c, 1))
        m = np.minimum(np.maximum(c // 16 * ~few, 1), left)
        gone = rng.random(len(active)) < p if (m == 1).all() else rng.binomial(m, p)
        own = np.minimum(np.maximum(own - gone, 1), c - m)
        c, left = c - m, left - m
        stay = left > 0
        if not stay.all():
            out[active] = own
            active, own, c, left = (x[stay] for x in (active, own, c, left))
    return out


@dataclass
class Totals:
    """Customers and tables of all restaurants: tables by context, of classes and of the root."""

    contexts: np.ndarray
    classes: np.ndarray
    root: float

    def __sub__(self, other: Totals) -> Totals:
        return Totals(self.contexts - other.contexts, self.classes - other.classes, self.root - other.root)

    def __add__(self, other: Totals) -> Totals:
        return Totals(self.contexts + other.contexts, self.classes + other.classes, self.root + other.root)

    def scaled(self, by: float) -> Totals:
        return Totals(self.contexts * by, self.classes * by, self.root * by)

    def class_customers(self) -> np.ndarray:
        return self.contexts.reshape(SLOTS, CLASSES).sum(0)

    def root_customers(self) -> float:
        return self.classes.sum()


@dataclass
class Part:
    """Some dishes of class restaurants, their words, and what both had."""

    at: np.ndarray
    words: np.ndarray
    up: np.ndarray
    class_tables: np.ndarray
    class_customers: np.ndarray
    root_tables: np.ndarray
    root_customers: np.ndarray

    @classmethod
    def of(cls, s: Seating, at: np.ndarray) -> Part:
        words, up = np.unique(s.at_root[at], return_inverse=True)
        return cls(at, words, up, s.class_tables[at], s.class_customers[at], s.root_tables[words], s.root_customers[words])


@dataclass
class View:
    """What a dish meets in its restaurants: tables and customers of its classes, and of the root."""

    class_tables: np.ndarray
    class_customers: np.ndarray
    root_tables: np.ndarray
    root_customers: np.ndarray


class Seating:
    """The pairs (word, context) of one bucket, with tables at all levels. Pairs of a word lie together; `at_class` and `at_root` are their places one and two levels up."""

    def __init__(self, spread: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        self.contexts, self.counts, self.n_words = contexts.astype(np.int64), counts.astype(np.int64), len(spread)
        self.word_of = np.repeat(np.arange(len(spread)), spread)
        keys, self.at_class = np.unique(self.word_of * CLASSES + self.contexts % CLASSES, return_inverse=True)
        self.at_root, self.classes = keys // CLASSES, keys % CLASSES
        self.tables = np.minimum(self.counts, 1)
        self.up()
        self.class_tables = np.minimum(self.class_customers, 1)
        self.root_customers = np.bincount(self.at_root, self.class_tables, self.n_words).astype(np.int64)
        self.root_tables = np.minimum(self.root_customers, 1)

    @classmethod
    def of(cls, row) -> Seating:
        return cls(np.frombuffer(row.spread, "<u4"), np.frombuffer(row.contexts, "<u2"), np.frombuffer(row.counts, "<u8"))

    def packed(self) -> bytes:
        """The tables at all levels, as restored() takes them; pairs of one customer at most have as many tables."""
        return _packed(np.concatenate([self.tables[self.counts > 1], self.class_tables, self.root_tables]))

    def restored(self, packed: bytes) -> None:
        movable, tables = self.counts > 1, _unpacked(packed)
        ends = np.cumsum([movable.sum(), len(self.class_tables)])
        self.tables[movable], self.class_tables, self.root_tables = np.split(tables, ends)
        self.up()
        self.root_customers = np.bincount(self.at_root, self.class_tables, self.n_words).astype(np.int64)

    def up(self) -> None:
        self.class_customers = np.bincount(self.at_class, self.tables, len(self.at_root)).astype(np.int64)

    def totals(self) -> Totals:
        return Totals(np.bincount(self.contexts, self.tables, CONTEXTS), np.bincount(self.classes, self.class_tables, CLASSES), float(self.root_tables.sum()))

    def view(self, part: Part, now: Totals) -> View:
        """now, without what each dish itself has taken away since the part was made."""
        return View(
            now.classes[self.classes[part.at]] - (part.class_tables - self.class_tables[part.at]), now.class_customers()[self.classes[part.at]] - (part.class_customers - self.class_customers[part.at]),
            now.root - (part.root_tables - self.root_tables[part.words]), now.root_customers() - (part.root_customers - self.root_customers[part.words]),
        )

    def root_probability(self, part: Part, v: View, p: Settings) -> np.ndarray:
        own = self.root_customers[part.words] - p.discount * self.root_tables[part.words]
        return (own + (THETA + p.discount * v.root_tables) / (p.vocabulary + 1)) / (v.root_customers + THETA)

    def class_probability(self, part: Part, v: View, p: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Of each dish in its class, and what one more customer counts on average (less if it opens a table)."""
        own = self.class_customers[part.at] - p.discount * self.class_tables[part.at]
        new = (THETA + p.discount * v.class_tables) * self.root_probability(part, v, p)[part.up]
        return (own + new) / (v.class_customers + THETA), 1 - p.discount * new / (own + new)

    def probability(self, now: Totals, p: Settings) -> np.ndarray:
        """Predictive probability of each pair's word in its context."""
        weight, everything = THETA + p.discount * now.contexts, Part.of(self, np.arange(len(self.at_root)))
        return (self.counts - p.discount * self.tables + weight[self.contexts] * self.class_probability(everything, self.view(everything, now), p)[0][self.at_class]) / (p.customers + THETA)[self.contexts]

    def sweep(self, others: Totals, p: Settings, rng: np.random.Generator) -> None:
        """Seats all customers of pairs anew, a group of pairs after the other. Lone customers of a pair always have a table, so theirs don't move at the lowest level."""
        movable = np.flatnonzero(self.counts > 1)
        movable = movable[np.argsort(rng.random(len(movable)))]
        movable = movable[np.argsort(self.word_of[movable], kind="stable")]  # a word's pairs in random order, dealt over the groups
        first = np.searchsorted(self.word_of[movable], self.word_of[movable])
        group = (np.arange(len(movable)) - first) % GROUPS
        for g in range(GROUPS):
            self.reseat(movable[group == g], others, p, rng)
        self.reseat_upper(others, p, rng)

    def reseat(self, pairs: np.ndarray, others: Totals, p: Settings, rng: np.random.Generator) -> None:
        """A dish's group leaves and comes back given all other dishes as they are."""
        if not len(pairs):
            return
        now, own = others + self.totals(), self.tables[pairs]
        at, up = np.unique(self.at_class[pairs], return_inverse=True)
        part = Part.of(self, at)
        self._leave_class(part, np.bincount(up, own, len(at)).astype(np.int64), p, rng)
        v, zero = self.view(part, now), np.zeros(len(pairs), np.int64)
        below, gain = self.class_probability(part, v, p)
        self.tables[pairs] = sit(zero, zero, self.counts[pairs], THETA + p.discount * (now.contexts[self.contexts[pairs]] - own), below[up], p.discount, rng, ((v.class_customers + THETA)[up], gain[up]))
        self._join_class(part, np.bincount(up, self.tables[pairs], len(at)).astype(np.int64), v, p, rng)

    def reseat_upper(self, others: Totals, p: Settings, rng: np.random.Generator) -> None:
        """The customers of the class restaurants and of the root leave and come back, a dish's classes in turn."""
        turn = (np.arange(len(self.at_root)) - np.searchsorted(self.at_root, self.at_root)) % GROUPS
        for g in range(GROUPS):
            now, part = others + self.totals(), Part.of(self, np.flatnonzero((turn == g) & (self.class_customers > 1)))
            gone = part.class_customers
            self._leave_class(part, gone, p, rng)
            self._join_class(part, gone, self.view(part, now), p, rng)
        words = np.flatnonzero(self.root_customers > 1)
        zero, tables = np.zeros(len(words), np.int64), (others + self.totals()).root - self.root_tables[words]
        self.root_tables[words] = sit(zero, zero, self.root_customers[words], THETA + p.discount * tables, np.full(len(words), 1 / (p.vocabulary + 1)), p.discount, rng)

    def _leave_class(self, part: Part, gone: np.ndarray, p: Settings, rng: np.random.Generator) -> None:
        after = leave(part.class_customers, part.class_tables, gone, p.discount, rng)
        up = np.bincount(part.up, part.class_tables - after, len(part.words)).astype(np.int64)
        self.class_customers[part.at], self.class_tables[part.at] = part.class_customers - gone, after
        self.root_tables[part.words] = leave(part.root_customers, part.root_tables, up, p.discount, rng)
        self.root_customers[part.words] = part.root_customers - up

    def _join_class(self, part: Part, come: np.ndarray, v: View, p: Settings, rng: np.random.Generator) -> None:
        d, base = p.discount, np.full(len(part.words), 1 / (p.vocabulary + 1))
        new, own = (THETA + d * v.root_tables) * base, self.root_customers[part.words] - d * self.root_tables[part.words]
        gain, below, seated = 1 - d * new / (new + own), self.root_probability(part, v, p), self.class_tables[part.at]
        after = sit(self.class_customers[part.at], seated, come, THETA + d * v.class_tables, below[part.up], d, rng, ((v.root_customers + THETA)[part.up], gain[part.up]))
        up = np.bincount(part.up, after - seated, len(part.words)).astype(np.int64)
        self.class_customers[part.at] += come
        self.class_tables[part.at] = after
        self.root_tables[part.words] = sit(self.root_customers[part.words], self.root_tables[part.words], up, THETA + d * v.root_tables, base, d, rng)
        self.root_customers[part.words] += up

    def sweeps(self, bucket: int, p: Settings, others: Totals | None, n: int) -> Iterator[int]:
        """n sweeps. others: the totals of the other buckets; None takes the bucket's own, scaled up."""
        rng = np.random.default_rng([SEED, int(bucket)])
        for k in range(n):
            scale = p.vocabulary / max(1, (self.root_tables > 0).sum()) - 1
            self.sweep(self.totals().scaled(scale) if others is None else others, p, rng)
            yield k


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, their bytes of one weight together: nearly all are small."""
    return zstandard.compress(values.astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(8, -1).T).view("<i8").ravel()


@dataclass
class Settings:
    vocabulary: int
    tokens: int
    customers: np.ndarray
    discount: float


def _packed_totals(sweep: int, contexts: np.ndarray, classes: np.ndarray, root: float) -> Iterator[tuple[int, int, bytes]]:
    by_class = contexts.reshape(SLOTS, CLASSES)
    for k in range(CLASSES):
        yield sweep, k, np.concatenate([by_class[:, k], [classes[k], root]]).astype("<f8").tobytes()


@lean
def _customers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            counts = np.bincount(np.frombuffer(row.contexts, "<u2"), np.frombuffer(row.counts, "<u8"), CONTEXTS)
            yield pd.DataFrame(_packed_totals(-1, counts, np.zeros(CLASSES), 0.0), columns=["sweep", "class", "tables"])


@lean
def _first(frames: Iterator[pd.DataFrame], p: Settings) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            t = _first_totals(row, p)
            yield pd.DataFrame(_packed_totals(BURN_IN - 1, t.contexts, t.classes, t.root), columns=["sweep", "class", "tables"])


#: A bucket with what it had after each kept sweep: its tables, and its totals (contexts, classes, root).
SEATED = "bucket int, spread binary, contexts binary, counts binary, chunks array<long>, places array<binary>, seats array<binary>, totals array<binary>"


@lean
def _seated(frames: Iterator[pd.DataFrame], p: Settings, start: Totals) -> Iterator[pd.DataFrame]:
    """The only run of the kept sweeps: probabilities need all buckets' totals, so they are taken later, from the tables as written."""
    for frame in frames:
        for row in frame.itertuples():
            own, seats, totals = Seating.of(row), [], []
            for k in own.sweeps(row.bucket, p, start - _first_totals(row, p), BURN_IN + KEPT):
                if k >= BURN_IN:
                    t = own.totals()
                    seats.append(own.packed())
                    totals.append(_packed(np.concatenate([t.contexts, t.classes, [t.root]])))
            yield pd.DataFrame([(row.bucket, row.spread, row.contexts, row.counts, row.chunks, row.places, seats, totals)], columns=[c.split()[0] for c in SEATED.split(", ")])


@lean
def _kept_totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sums of its buckets' totals."""
    sums = np.zeros((KEPT, CONTEXTS + CLASSES + 1))
    for frame in frames:
        for totals in frame["totals"]:
            for k, t in enumerate(totals):
                sums[k] += _unpacked(t)
    for k, t in enumerate(sums):
        yield pd.DataFrame(_packed_totals(BURN_IN + k, t[:CONTEXTS], t[CONTEXTS:-1], t[-1]), columns=["sweep", "class", "tables"])


def _first_totals(row, p: Settings) -> Totals:
    """What the bucket itself put into the first exchange."""
    own = Seating.of(row)
    for _ in own.sweeps(row.bucket, p, None, BURN_IN):
        pass
    return own.totals()


def _sum(frame: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(SLOTS + 2)
    for t in frame["tables"]:
        out += np.frombuffer(t, "<f8")
    return pd.DataFrame([(frame["sweep"].iloc[0], frame["class"].iloc[0], out.tobytes())], columns=["sweep", "class", "tables"])


def _collected(parts: DataFrame) -> dict[int, Totals]:
    """Totals by sweep, summed over the buckets: CLASSES * (SLOTS + 2) numbers a sweep reach the driver."""
    out: dict[int, Totals] = {}
    for r in parts.groupBy("sweep", "class").applyInPandas(_sum, SUMS).collect():
        t = out.setdefault(r["sweep"], Totals(np.zeros(CONTEXTS), np.zeros(CLASSES), 0.0))
        tables = np.frombuffer(r["tables"], "<f8")
        t.contexts.reshape(SLOTS, CLASSES)[:, r["class"]] = tables[:SLOTS]
        t.classes[r["class"]], t.root = tables[SLOTS], tables[SLOTS + 1]
    return out


@lean
def _answers(frames: Iterator[pd.DataFrame], p: Settings, totals: dict[int, Totals]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            own = Seating.of(row)
            mean = np.zeros(len(own.counts))
            for k, seats in enumerate(row.seats, BURN_IN):
                own.restored(seats)
                mean += own.probability(totals[k], p) / KEPT
            logs = np.log10(np.maximum(mean, 1e-300)).astype("<f4")
            known = np.bincount(own.word_of, own.counts, own.n_words).astype("<u8")[own.word_of]
            out = []
            for chunk, steps in zip(row.chunks, row.places, strict=True):
                at = np.cumsum(np.frombuffer(steps, "<u4"))
                new = np.flatnonzero(np.diff(own.word_of[at], prepend=-1))  # a word's count is sent once
                out.append((chunk, row.bucket, logs[at].tobytes(), known[at[new]].tobytes(), np.diff(new, append=len(at)).astype("<u4").tobytes()))
            for k in range(0, len(out), ROWS):
                yield pd.DataFrame(out[k : k + ROWS], columns=["chunk", "bucket", "logs", "known", "spread"])


@lean
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for c in chunks(batches):
        pairs = c.token_pair.astype("<u4")
        low, high = (pairs & 0xFFFF).astype("<u2").tobytes(), (pairs >> 16).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([c.id], pa.int64()), pa.array([c.doc_ids], pa.list_(pa.int64())), pa.array([c.held.tolist()], pa.list_(pa.bool_())), pa.array([c.lengths.tolist()], pa.list_(pa.int64())), pa.array([press.compress(low)], pa.binary()), pa.array([press.compress(high)], pa.binary()), pa.array([len(c.pair_word)], pa.int64())], names=["chunk", "doc_ids", "held", "lengths", "low", "high", "pairs"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scored(docs: pd.DataFrame, answers: pd.DataFrame, p: Settings) -> pd.DataFrame:
    open_ = zstandard.ZstdDecompressor()
    answers = answers.sort_values("bucket")
    logs = np.concatenate([np.frombuffer(x, "<f4") for x in answers["logs"]]).astype(np.float64) if len(answers) else np.empty(0)
    counts = np.concatenate([np.repeat(np.frombuffer(x, "<u8"), np.frombuffer(n, "<u4")) for x, n in zip(answers["known"], answers["spread"], strict=True)]).astype(np.float64) if len(answers) else np.empty(0)
    base = np.log10((counts + 0.5) / (p.tokens + 0.5 * (p.vocabulary + 1)))
    out = []
    for row in docs.itertuples():
        if row.pairs != len(logs):
            raise ValueError("the documents were read in another order the second time")
        pairs = np.frombuffer(open_.decompress(row.low), "<u2").astype(np.int64) | (np.frombuffer(open_.decompress(row.high), "<u2").astype(np.int64) << 16)
        lengths = np.asarray(row.lengths)
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x[pairs], starts) for x in ((counts > 0).astype(np.int64), base, logs)]
        out.append(pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], "Int64"), "held_out": np.asarray(row.held, bool), "n_tokens": lengths, "n_known": sums[0], "train_tokens": p.tokens, "base_score": sums[1], "score": sums[2], "perplexity": 10.0 ** (-sums[2] / lengths)}))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])


def score(docs: DataFrame, folds: int = 5, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of RESULT for each row of docs (doc_id, text); rows of fold 1 of `folds` are held out.

    There is a bucket for each `bucket_bytes` of all texts, whatever the session's partitions, so the same table gets the same scores on any cluster."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out("doc_id", folds).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))  # a task holds one at a time
    requests = rows.mapInArrow(lambda b: _requests(b, buckets), "bucket int, chunk long, words binary, spread binary, contexts binary, counts binary")
    merged = written(requests.groupBy("bucket").applyInPandas(_merge, MERGED), "merged")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = merged.agg(*[total(c).alias(c) for c in ("n_tokens", "n_words", "once", "twice")]).first()
    discount = min(0.95, max(0.1, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    pairs, none = merged.select("bucket", "spread", "contexts", "counts"), Totals(np.zeros(CONTEXTS), np.zeros(CLASSES), 0.0)
    p = Settings(sums["n_words"], sums["n_tokens"], _collected(pairs.mapInPandas(_customers, SUMS)).get(-1, none).contexts, discount)
    start = _collected(pairs.mapInPandas(lambda f: _first(f, p), SUMS)).get(BURN_IN - 1, none)
    sent = spark.sparkContext.broadcast((p, start))
    seated = written(merged.select("bucket", "spread", "contexts", "counts", "chunks", "places").mapInPandas(lambda f: _seated(f, *sent.value), SEATED), "seated")
    discard(merged)
    totals = _collected(seated.select("totals").mapInPandas(_kept_totals, SUMS))
    all_totals = spark.sparkContext.broadcast((p, totals))
    answers = seated.drop("totals").mapInPandas(lambda f: _answers(f, *all_totals.value), "chunk long, bucket int, logs binary, known binary, spread binary")
    tokens = rows.mapInArrow(_tokens, "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, low binary, high binary, pairs long")
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda d, a: _scored(d, a, p), RESULT)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
