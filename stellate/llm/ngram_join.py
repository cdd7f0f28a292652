"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct word n-grams, as 64-bit hashes; documents with equal sets are one node. If
two sets link at the threshold, their prefixes under any common order, each `n - ceil(t * n) + l` grams long, share l
grams at least. Grams are ordered by frequency class, rarest first (counts over all documents; classes of the most
frequent grams are kept in a table of fixed size, all others rank first), then by hash. Every document picks its own l
between 1 and `LONGEST`: the one whose prefix costs least, by the estimated posting entries to scan and the candidates that
would remain to be verified; a pair must share as many prefix grams as the smaller of its two l.

Pairs are never expanded within groups of copies: first each posting list links its nodes to a few hubs, verified links
are contracted to components, and only pairs of nodes in different components, of lists that still hold several, are
generated and verified after that. Such pairs must pass the length and the position filter before they count, and are counted
on packed integers inside tasks, so that only pairs that share enough prefix grams become rows.

Everything that grows with the data is shuffled by gram, node or pair. To tasks goes only the table of classes
(`TABLE` bytes); the driver sees counts, and at most `FREQUENT` frequent grams.

Defined results: null and empty texts and texts without words have no grams and no links; a text of fewer than n
words is one gram; rows of equal doc_id stand for one document each and give a row each; a row without doc_id
takes part in no link and has no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, parallelism, sized, table, written

#: Words of a gram and the threshold in percent, unless the caller gives others.
WORDS, PERCENT = 4, 85
#: Longest extra prefix; cost of verifying a candidate in posting entries.
LONGEST, VERIFY_COST = 8, 16.0
#: Nodes of a posting list that all of its others are held against before pairs are generated.
HUBS = 4
#: Words whose hashes a task remembers; grams, and postings, that it gathers before it sends them on.
REMEMBERED, CHUNK, POSTINGS = 100_000, 750_000, 250_000
#: Nodes of a part of a posting list, on average.
PART = 1024
#: Bytes of the table of classes; frequent grams that it is filled from at most; grams count as frequent from here on.
TABLE, FREQUENT, LEAST_FREQUENT = 1 << 22, 1 << 19, 8
#: Bits of a gram's hash that frequencies go by (all else takes its 64).
BITS = 40
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Grams(dict):
    """Word hashes by word (bytes, in lower case), forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None, n: int = WORDS) -> np.ndarray:
        """Sorted distinct hashes of the text's word n-grams (UTF-8; words are parted by ASCII white space, A-Z count as a-z)."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(n, len(ids))
        out = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            out += ids[k : len(ids) - size + 1 + k] * _ODD[k]
        out ^= out >> np.uint64(32)
        out *= _ODD[4]
        out ^= out >> np.uint64(29)
        return np.unique(out)


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def least_overlap(n, percent: int = PERCENT):
    """Grams that a set of n shares at least with a set it links to."""
    return (n * percent + 99) // 100


def _chunks(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[list[np.ndarray]]:
    """Grams of texts (bytes), about CHUNK grams at a time."""
    grams, held, size = Grams(), [], 0
    for batch in batches:
        for text in batch.column(1):
            held.append(grams.of(text.as_py(), n_words))
            size += len(held[-1])
            if size >= CHUNK or len(held) >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _buckets(tokens: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Borders of equal ranges of the hash space in sorted tokens."""
    inner = (np.arange(1, buckets, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, inner), [len(tokens)]])


@lean
def _count(batches: Iterator[pa.RecordBatch], buckets: int, n_words: int) -> Iterator[pa.RecordBatch]:
    """Distinct shortened grams of each chunk with their counts, cut into buckets; differences of sorted hashes compress well."""
    for held in _chunks(batches, n_words):
        tokens = np.concatenate(held) >> np.uint64(64 - BITS)
        held.clear()
        tokens, counts = np.unique(tokens, return_counts=True)
        at = _buckets(tokens, buckets, BITS)
        rows = [(b, int(tokens[at[b]]), _narrow(np.diff(tokens[at[b] : at[b + 1]])), counts[at[b] : at[b + 1]].astype("<u4").tobytes()) for b in range(buckets) if at[b] < at[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3)]], names=["bucket", "first", "steps", "counts"])


def _narrow(steps: np.ndarray) -> bytes:
    return steps.astype("<u4" if not len(steps) or steps.max() < 2**32 else "<u8").tobytes()


def _frequent(frame: pd.DataFrame) -> pd.DataFrame:
    """Grams of a bucket by frequency class: floor(log2(documents))."""
    parts = []
    for first, steps, counts in zip(frame["first"], frame["steps"], frame["counts"], strict=True):
        narrow = len(steps) == len(counts) - 4
        parts.append(np.cumsum(np.concatenate([np.array([first], np.uint64), np.frombuffer(steps, "<u4" if narrow else "<u8").astype(np.uint64)]), dtype=np.uint64))
    tokens, counts = np.concatenate(parts), np.concatenate([np.frombuffer(c, "<u4") for c in frame["counts"]])
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    totals = np.add.reduceat(counts, starts)
    keep = totals >= LEAST_FREQUENT
    tokens, classes = tokens[starts][keep], np.log2(totals[keep]).astype(np.int64)
    found = [(int(c), int((classes == c).sum()), tokens[classes == c].astype("<u8").tobytes()) for c in np.unique(classes)]
    return pd.DataFrame(found, columns=["class", "n", "tokens"])


def frequency_classes(docs: DataFrame, n_words: int = WORDS) -> bytes:
    """A table of TABLE bytes: at a gram's hash (modulo TABLE) its frequency class, 0 for all that are rare."""
    buckets = parallelism(docs.sparkSession)
    counted = docs.mapInArrow(lambda b: _count(b, buckets, n_words), "bucket int, first long, steps binary, counts binary")
    classes = written(counted.groupBy("bucket").applyInPandas(_frequent, "class long, n long, tokens binary"), "classes")
    sizes = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    out, total, cut = np.zeros(TABLE, np.uint8), 0, None
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > FREQUENT:
            break
        cut = c
    if cut is not None:
        for r in classes.where(F.col("class") >= cut).orderBy("class").toLocalIterator():
            at = (np.frombuffer(r["tokens"], "<u8") % np.uint64(TABLE)).astype(np.int64)
            out[at] = np.maximum(out[at], min(255, r["class"]))
    return out.tobytes()


def prefix(grams: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The grams of a set's adaptive prefix in the common order, and its l."""
    own = classes[((grams >> np.uint64(64 - BITS)) % np.uint64(TABLE)).astype(np.int64)]
    n, need = len(grams), least_overlap(len(grams), percent)
    longest = min(LONGEST, need)
    order = np.argsort(own, kind="stable")[: n - need + longest]  # grams are sorted
    entries = np.cumsum(np.where(own[order] > 0, 2.0 ** own[order], 1.0) - 1.0)
    lengths = n - need + np.arange(1, longest + 1)
    cost = entries[lengths - 1] * (1 + VERIFY_COST / np.arange(1, longest + 1)) + np.arange(longest)
    at = int(cost.argmin())
    return grams[order[: lengths[at]]], at + 1


POSTED = "bucket int, tokens binary, local binary, place binary, nodes binary, docs binary"


@lean
def _post(batches: Iterator[pa.RecordBatch], table_of_classes: bytes, buckets: int, n_words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix postings of about POSTINGS at a time, cut into buckets of the hash space, and their documents, in one bucket after the other."""
    classes, grams, turn = np.frombuffer(table_of_classes, np.uint8), Grams(), TaskContext.get().partitionId()
    own: dict[int, tuple] = {}  # node -> (size, l, prefix)
    listed, size = [], 0

    def close() -> pa.RecordBatch:
        nodes = np.array([[k, n, l] for k, (n, l, _) in own.items()], np.int64).reshape(-1, 3)
        lengths = np.array([len(p) for _, _, p in own.values()], np.int64)
        tokens = np.concatenate([p for _, _, p in own.values()]) if own else np.empty(0, np.uint64)
        index = np.repeat(np.arange(len(nodes)), lengths)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(tokens, kind="stable")
        at = _buckets(tokens[order], buckets, 64)
        rows = []
        for b in range(buckets):
            part = order[at[b] : at[b + 1]]
            if docs := np.array(listed, "<i8").tobytes() if b == turn % buckets else b"":
                listed.clear()
            if len(part) or docs:
                used, local = np.unique(index[part], return_inverse=True)
                rows.append((b, tokens[part].astype("<u8").tobytes(), local.astype("<u4").tobytes(), place[part].astype("<u4").tobytes(), nodes[used].astype("<i8").tobytes(), docs))
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in POSTED.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            g = grams.of(text.as_py(), n_words)
            node = node_of(g)
            listed.append((doc_id is not None, doc_id or 0, len(g), node))
            size += 1
            if doc_id is not None and len(g) and node not in own:
                found, l = prefix(g, classes, percent)
                own[node] = (len(g), l, found)
                size += len(found)
            if size >= POSTINGS:
                yield close()
                size, turn = 0, turn + 1
    if listed:
        yield close()


LIVE = "doc_id long, node long, size long, token long, place long, l long"


def _live(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: its documents (place -1), and the postings of grams that several nodes hold."""
    token = np.concatenate([np.frombuffer(t, "<u8") for t in frame["tokens"]])
    place = np.concatenate([np.frombuffer(p, "<u4") for p in frame["place"]])
    node = np.concatenate([np.frombuffer(n, "<i8").reshape(-1, 3)[np.frombuffer(i, "<u4")] for n, i in zip(frame["nodes"], frame["local"], strict=True)])
    docs = np.concatenate([np.frombuffer(d, "<i8").reshape(-1, 4) for d in frame["docs"]])
    _, kind, held = np.unique(token, return_inverse=True, return_counts=True)
    several = held[kind] > 1
    token, place, node = token[several], place[several], node[several]
    order = np.lexsort((place, node[:, 0], token))
    token, place, node = token[order], place[order], node[order]
    new = np.ones(len(token), bool)  # a node comes from several chunks if copies do
    new[1:] = (token[1:] != token[:-1]) | (node[1:, 0] != node[:-1, 0])
    token, place, node = token[new], place[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, int)
    held = np.diff(np.append(first, len(token)))
    keep = np.repeat(held, held) > 1
    token, place, node = token[keep], place[keep], node[keep]
    n = len(docs)
    ids = pd.array(np.concatenate([docs[:, 1], np.zeros(len(token), np.int64)]), "Int64")
    ids[np.concatenate([docs[:, 0] == 0, np.ones(len(token), bool)])] = pd.NA
    return pd.DataFrame({"doc_id": ids, "node": np.concatenate([docs[:, 3], node[:, 0]]), "size": np.concatenate([docs[:, 2], node[:, 1]]), "token": np.concatenate([np.zeros(n, np.int64), token.view(np.int64)]), "place": np.concatenate([np.full(n, -1), place]).astype(np.int64), "l": np.concatenate([np.zeros(n, np.int64), node[:, 2]])})


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL for the length and the position filter of two postings of one gram: a linked pair's first l common grams pass."""
    need = f"(({a}.size + {b}.size) * {percent} + {100 + percent - 1}) div {100 + percent}"
    return f"100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size) and least({a}.size - {a}.place, {b}.size - {b}.place) + least({a}.l, {b}.l) - 1 >= {need}"


def _links(x: bytes, y: bytes, percent: int) -> bool:
    both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
    both.sort(kind="stable")  # merges two runs
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


@lean
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, grams_a, grams_b) that link."""
    for batch in batches:
        keep = [_links(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@lean
def _sets(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        own = [grams.of(t.as_py(), n_words) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(g) for g in own], pa.int64()), pa.array([g.astype("<u8").tobytes() for g in own], pa.binary())], names=["node", "grams"])


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) that link, as a written table. Sets are made anew from the texts of one document for each node that is in a pair."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = written(nodes.join(needed, "node", "left_semi").select("node", "doc_id"), "needed")
    texts = docs.join(wanted := sized(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(lambda b: _sets(b, n_words), "node long, grams binary").join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    with_a = pairs.join(sets.withColumnsRenamed({"node": "a", "grams": "grams_a"}), "a")
    with_both = with_a.join(sets.withColumnsRenamed({"node": "b", "grams": "grams_b"}), "b").select("a", "b", "grams_a", "grams_b")
    out = written(with_both.mapInArrow(lambda b: _linked(b, percent), "a long, b long"), "links")
    discard(ids, wanted, sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of links (a, b), by contraction: every node takes its smallest
    neighbour's place until no edge is left; the labels of the rounds are composed."""
    edges = written(links.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        before = labels
        if labels is None:
            labels = written(step.select(F.col("a").alias("node"), F.col("to").alias("component")), "labels")
        else:
            labels = written(labels.join(step, labels["component"] == step["a"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        moved = edges.join(step, "a").select(F.col("to").alias("x"), "b").join(step.withColumnsRenamed({"a": "b", "to": "y"}), "b")
        left = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(before, edges, step)
        edges = left
    discard(edges)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0) if labels is None else labels


PAIRED = "bucket int, pairs binary"


@lean
def _paired(batches: Iterator[pa.RecordBatch], buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of two parts of a posting list that pass the filters, with how often each came up, cut into buckets by their hash.

    A part is a list of nodes with size, place, l and component; largest is the list's largest component. Repeated pairs are counted before they are sent."""
    held: list[np.ndarray] = []
    size = 0

    def fields(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        lists = batch.column(k)
        return lists.offsets.to_numpy(), [f.to_numpy(zero_copy_only=False) for f in lists.values.flatten()]

    def counted() -> np.ndarray:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        first = np.flatnonzero(np.concatenate([[True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]))
        out = pairs[first]
        out["shared"] = np.add.reduceat(pairs["shared"], first)
        return out

    def sent(pairs: np.ndarray) -> pa.RecordBatch:
        bucket = ((pairs["a"].view(np.uint64) * _ODD[0]) ^ (pairs["b"].view(np.uint64) * _ODD[1])) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, pairs[order[at[b] : at[b + 1]]].tobytes()) for b in range(buckets) if at[b] < at[b + 1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "pairs"])

    for batch in batches:
        largest = batch.column(0).to_numpy()
        (x_at, x), (y_at, y) = fields(batch, 1), fields(batch, 2)
        for n in range(batch.num_rows):
            xn, xs, xp, xl, xc = (f[x_at[n] : x_at[n + 1], None] for f in x)
            yn, ys, yp, yl, yc = (f[None, y_at[n] : y_at[n + 1]] for f in y)
            need = (percent * (xs + ys) + 99 + percent) // (100 + percent)
            l = np.minimum(xl, yl)
            fits = (xc != yc) & ((yc == largest[n]) | (xn < yn)) & (100 * np.minimum(xs, ys) >= percent * np.maximum(xs, ys)) & (np.minimum(xs - xp, ys - yp) + l - 1 >= need)
            i, j = np.nonzero(fits)
            if len(i):
                pairs = np.empty(len(i), _PAIR)
                a, b = xn[i, 0], yn[0, j]
                pairs["a"], pairs["b"], pairs["shared"], pairs["l"] = np.minimum(a, b), np.maximum(a, b), 1, l[i, j]
                held.append(pairs)
                size += len(pairs)
            if size >= POSTINGS:
                held = [counted()]
                size = len(held[0])
                if size >= POSTINGS // 2:
                    yield sent(held[0])
                    held, size = [], 0
    if held:
        yield sent(counted())


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("shared", "<u4"), ("l", "<u4")])


def _enough(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a bucket that share as many prefix grams as the smaller of their l."""
    pairs = np.concatenate([np.frombuffer(p, _PAIR) for p in frame["pairs"]])
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]))
    keep = np.add.reduceat(pairs["shared"], first) >= pairs["l"][first]
    return pd.DataFrame({"a": pairs["a"][first][keep], "b": pairs["b"][first][keep]})


def pairs_between(labelled: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, from posting lists that hold several; a list's largest component meets the others only.

    Lists are met part by part (PART nodes on average, so no task holds a long list), and shared grams are counted on packed integers in the tasks: only pairs that share enough become rows."""
    sizes = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n")).where("components > 1").select("token", "largest", "n")
    several = labelled.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)))
    listed = F.collect_list(F.struct("node", "size", "place", "l", "component"))
    parts = several.groupBy("token", "part").agg(F.first("largest").alias("largest"), listed.alias("y"))
    few = several.where("component <> largest").groupBy("token", "part").agg(listed.alias("x"))
    met = few.select("token", "x").join(parts.drop("part"), "token").select("largest", "x", "y")
    return met.mapInArrow(lambda b: _paired(b, buckets, percent), PAIRED).groupBy("bucket").applyInPandas(_enough, "a long, b long")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_grams, component_id for each row of docs (doc_id, text), by grams of `words` words (8 at most) and a Jaccard of `percent` hundredths."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    buckets = parallelism(spark)
    sent = spark.sparkContext.broadcast(frequency_classes(docs, words))
    posted = docs.mapInArrow(lambda b: _post(b, sent.value, buckets, words, percent), POSTED)
    rows = written(posted.groupBy("bucket").applyInPandas(_live, LIVE), "postings")
    listed = rows.where("place < 0").select("doc_id", "size", "node")
    live = rows.where("place >= 0").drop("doc_id")
    nodes = listed.where("doc_id is not null and size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    # each posting list's nodes and its hubs: the nodes of similar size that have fewest rarer grams, so the least changed copies
    banded = live.withColumn("band", F.floor(F.log("size") / F.log(F.lit(100 / percent))))
    most_central = Window.partitionBy("token", "band").orderBy("place", "node")
    hubs = banded.withColumn("n", F.row_number().over(most_central)).where(F.col("n") <= HUBS).drop("n")
    near = banded.alias("x").join(hubs.alias("h"), ["token", "band"]).where("x.node <> h.node").where(_may_link("x", "h", percent))
    one_way = near.groupBy(F.col("h.node").alias("h"), F.col("x.node").alias("x")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x.l", "h.l")).alias("l")).where("shared >= l")
    first = written(one_way.select(F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b")).distinct(), "candidates")
    links = verified(first, docs, nodes, words, percent)
    known = components(links)

    # what is left: pairs between components
    labelled = written(live.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    more = written(pairs_between(labelled, buckets, percent), "candidates")
    if not more.isEmpty():
        others, before = verified(more, docs, nodes, words, percent), known
        known = components(links.union(others))
        discard(others, before)
    discard(first, links, labelled, more)
    ids = nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = ids.join(smallest, "component").select("node", "component_id")
    return listed.join(of_node, "node", "left").select("doc_id", F.col("size").alias("n_grams"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def without_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all documents of a component but the one of the smallest doc_id, and with repeated rows of it once.

    Rows without doc_id stay. Rows of one doc_id with different texts stay or go as each one's component says only
    if they go all; otherwise all of them stay."""
    groups = written(join_components(docs, words, percent), "grouped")
    keep = F.max(F.col("doc_id") == F.col("component_id"))
    gone = sized(groups.where("doc_id is not null").groupBy("doc_id").agg(keep.alias("keep")).where(~F.col("keep")).select("doc_id"))
    repeated = sized(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), WORDS, PERCENT).withColumnRenamed("n_grams", "n_shingles")
