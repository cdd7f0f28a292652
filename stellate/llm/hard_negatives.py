"""Hard-negative mining by distributed radix selection.

For every anchor the first positives (rows of its own label by score) are found, and for every anchor and positive the first
rows of other labels whose score lies in a window of shares of the positive's score. Both are the same selection: a window
[low, high] of integer scores and a number k. Tasks score their rows against a block of anchors and count scores by bucket from
the top of each window; the counts of all tasks are summed, the bucket that holds the kth score becomes the window of the
next, finer digit, and so on until a bucket is one score wide. Only then are rows gathered: those above the kth
score, and of those that tie with it the smallest ids. What moves between tasks is counts, never scores; a row is
sent only if it is a result or ties with one, and of ties a task sends no more than are wanted. Anchors travel in blocks of a bounded
number, each with its own scans of the written table of integer vectors, so neither driver nor tasks hold what grows with
the data. A vector that a third of the rows share is counted where it lies.

Defined results: rows with a null id, a null label, a null vector or null or non-finite components take no part; an anchor sees only
rows whose vectors have its length, and skips the rows of its own id; anchors
that share an id ask once, with the least of their (label, vector); other repeated rows count each, but (anchor, positive, score) is mined once;
ties go to the smaller id; windows of positives with a negative score are empty; scores beyond 2**62 - 1 either way count as that;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, importable, lean, table, written

#: Buckets of a digit (as a power of two), anchors of a block, and scores that a task holds at a time.
DIGIT_BITS, ANCHORS, HELD = 8, 2048, 1 << 20
#: Sums below this are exact in double precision; larger scores are made with Python's integers and cut to LARGEST.
EXACT, LARGEST = 2**53, 2**62 - 1


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """vec_id long, label long, v array<long>: floor(scale * x) of each valid vector."""
    x = lambda e: e.cast("double")
    valid = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & valid)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector_col, lambda e: F.floor(x(e) * scale).cast("long")).alias("v"))


def scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices as int64, cut to LARGEST either way."""
    most = lambda a: int(np.abs(a.astype(np.float64)).max(initial=0))
    if most(q) * most(m) * max(1, q.shape[1]) < EXACT:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in m] for x in q]
    return np.array([[max(-LARGEST, min(LARGEST, s)) for s in row] for row in whole], np.int64).reshape(len(q), len(m))


class Block:
    """A block of anchors and their windows: anchor ids, labels and vectors, and for each window its anchor's place, bounds and the number still wanted.

    same: whether rows of the anchor's own label are wanted, or those of others. floor and high bound what is still open; rows above high are taken."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], at: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, bits: int = DIGIT_BITS):
        self.bits = bits
        self.ids, self.labels, self.vectors, self.at, self.same, self.k = ids, labels, vectors, at, same, k
        self.low, self.top, self.high = low, high.copy(), high
        self.want = np.where(high >= low, k, 0).astype(np.int64)
        self.open = high > low

    def shift(self) -> np.ndarray:
        """Bits below the digit that is counted next, for each window."""
        width = np.where(self.open, self.high - self.low, 0)
        bits = np.array([int(w).bit_length() for w in width], np.int64)
        return np.maximum(bits - self.bits, 0)


def _scored(frames: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows' places, the scores of their anchors with some rows, which of those are wanted at all, and the rows' ids."""
    lengths = np.array([len(v) for v in block.vectors])
    groups = []
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        groups.append((int(d), own, np.array([block.vectors[n] for n in own], np.int64).reshape(len(own), int(d))))
    for frame in frames:
        if not frame.num_rows:
            continue
        vec, ids, labels = frame["v"], frame["vec_id"].to_numpy(), frame["label"].to_numpy()
        sizes, flat = np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for d, own, q in groups:
            rows = np.flatnonzero(sizes == d)
            per = max(1, HELD // 4 // max(1, d))
            for r in range(0, len(rows), per):
                part = rows[r : r + per]
                m = flat[starts[part][:, None] + np.arange(d)]
                step = max(1, HELD // max(1, len(part)))
                for a in range(0, len(own), step):
                    mine = own[a : a + step]
                    s = scores(q[a : a + step], m)
                    wanted = (block.ids[mine][:, None] != ids[part][None, :]) & ((block.labels[mine][:, None] == labels[part][None, :]) == block.same)
                    yield mine, s, wanted, ids[part]


def _windows_of(block: Block) -> list[np.ndarray]:
    """Windows by turn: the first of each anchor, the second of each, ..."""
    order = np.argsort(block.at, kind="stable")
    turn = np.arange(len(order)) - np.searchsorted(block.at[order], block.at[order], "left")
    return [order[turn == t] for t in range(int(turn.max(initial=-1)) + 1)]


def _each_window(mine: np.ndarray, turns: list[np.ndarray], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each turn the windows of some anchors, and those anchors' rows of the scores."""
    for own in turns:
        at = block.at[own]
        place = np.searchsorted(mine, at)
        inside = (place < len(mine)) & (mine[np.minimum(place, len(mine) - 1)] == at)
        if inside.any():
            yield own[inside], place[inside]


@lean
def _histograms(frames: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """w, bucket, n: scores of a task's rows by bucket below the top of each open window.

    Buckets below the one in which the task alone reaches the number wanted can't hold the kth score, and are left out."""
    shift, turns, size = block.shift(), _windows_of(block), 1 << block.bits
    counts = np.zeros((len(block.at), size), np.int64)
    floor = np.where(block.open, block.low, block.high + 1)
    for mine, s, wanted, _ in _scored(frames, block):
        for own, place in _each_window(mine, turns, block):
            mine_s = s[place]
            w, r = np.nonzero((mine_s >= floor[own][:, None]) & (mine_s <= block.high[own][:, None]) & wanted[place])
            if len(w):
                bucket = (block.high[own][w] - mine_s[w, r]) >> shift[own][w]
                np.add.at(counts, (own[w], bucket), 1)
                full = np.cumsum(counts[own], axis=1) >= block.want[own][:, None]
                first = np.where(full.any(1), full.argmax(1), size - 1)
                floor[own] = np.maximum(floor[own], block.high[own] - (first << shift[own]) - ((np.int64(1) << shift[own]) - 1))
    before = np.cumsum(counts, axis=1) - counts
    w, bucket = np.nonzero((counts > 0) & (before < block.want[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(bucket, pa.int64()), pa.array(counts[w, bucket], pa.int64())], ["w", "bucket", "n"])


@lean
def _gathered(frames: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """w, vec_id, score of rows above the kth score, and of a task's ties with it the smallest ids, as many as are wanted."""
    turns = _windows_of(block)
    ties: dict[int, np.ndarray] = {}
    for mine, s, wanted, ids in _scored(frames, block):
        for own, place in _each_window(mine, turns, block):
            mine_s = s[place]
            w, r = np.nonzero((mine_s >= block.low[own][:, None]) & (mine_s <= block.top[own][:, None]) & wanted[place])
            value = mine_s[w, r]
            above = (value > block.high[own][w]) | (block.want[own][w] < 0)
            if above.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[w[above]], pa.int64()), pa.array(ids[r[above]], pa.int64()), pa.array(value[above], pa.int64())], ["w", "vec_id", "score"])
            for n in np.unique(w[~above]):
                new = ids[r[~above & (w == n)]]
                key = int(own[n])
                ties[key] = np.sort(np.concatenate([ties.get(key, np.empty(0, np.int64)), new]))[: block.want[key]]
    if ties:
        w = np.repeat(np.fromiter(ties, np.int64, len(ties)), [len(v) for v in ties.values()])
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.concatenate(list(ties.values()))), pa.array(block.high[w])], ["w", "vec_id", "score"])


def selected(rows: DataFrame, block: Block) -> DataFrame:
    """w, vec_id, score, rank: the first block.k rows of each window (all, if fewer), by score and then by id."""
    spark = rows.sparkSession

    def over(task: Callable, schema: str) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(block)
        return rows.select("vec_id", "label", "v").mapInArrow(lambda f: task(f, sent.value), schema), sent

    while block.open.any():
        shift = block.shift()
        counted, sent = over(_histograms, "w long, bucket long, n long")
        upto = Window.partitionBy("w").orderBy("bucket")
        sums = counted.groupBy("w", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
        want = spark.createDataFrame(pd.DataFrame({"w": np.arange(len(block.at)), "want": block.want}), "w long, want long")
        hit = sums.join(F.broadcast(want), "w").where("upto >= want and upto - n < want").select("w", "bucket", (F.col("upto") - F.col("n")).alias("above")).toPandas()  # a row for each window at most
        sent.unpersist()
        w, bucket, above = (hit[c].to_numpy(np.int64) for c in ("w", "bucket", "above"))
        found = np.zeros(len(block.at), bool)
        found[w] = True
        block.want[block.open & ~found] = -1  # fewer than wanted: all of the window
        block.open &= found
        high = block.high[w] - (bucket << shift[w])
        block.low[w], block.high[w] = np.maximum(block.low[w], high - ((np.int64(1) << shift[w]) - 1)), high
        block.want[w] -= above
        block.open &= block.high > block.low
    out, _ = over(_gathered, "w long, vec_id long, score long")
    first = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= block.k)


def _bounds(rows: DataFrame, q: list[np.ndarray]) -> np.ndarray:
    """For each vector a bound of its scores with all rows: the product of the norms."""
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))).first()[0] or 0.0
    norms = np.array([float(np.square(v.astype(np.float64)).sum()) for v in q])
    return np.array([int(min(LARGEST, np.ceil(x * (1 + 1e-9)) + 1)) for x in np.sqrt(norms * most)], np.int64)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, together: int = ANCHORS, bits: int = DIGIT_BITS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors as of quantised().

    A negative n of a positive p has low * p <= 100 * n <= high * p. together: anchors of a block; bits: of a digit."""
    spark = importable(rows.sparkSession)
    rows = written(rows, "vectors")
    asked = written(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v"), "anchors")
    blocks, parts = max(1, -(-asked.count() // together)), []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        frame = own.toPandas()  # about `together` rows
        if not len(frame):
            continue
        ids, labels, vectors = frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in frame["v"]]
        bound = _bounds(rows, vectors)
        every = np.arange(len(ids))
        near = selected(rows, Block(ids, labels, vectors, every, -bound, bound.copy(), positives, True, bits)).select("w", "vec_id", "score").distinct().toPandas()  # `positives` rows for each anchor
        near = near.sort_values(["w", "score", "vec_id"], ascending=[True, False, True]).reset_index(drop=True)
        at, positive = near["w"].to_numpy(np.int64), near["score"].to_numpy(np.int64)
        bounds = [(-(-low * s // 100), high * s // 100) for s in map(int, positive)]  # in Python's integers, which don't overflow
        lows, highs = (np.array([x[n] for x in bounds], np.int64) for n in (0, 1))
        found = selected(rows, Block(ids, labels, vectors, at, lows, highs, negatives, False, bits))
        windows = spark.createDataFrame(pd.DataFrame({"w": np.arange(len(at)), "anchor_id": ids[at], "positive_id": near["vec_id"].to_numpy(np.int64), "positive_score": positive}), "w long, anchor_id long, positive_id long, positive_score long")
        part = found.join(F.broadcast(windows), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        parts.append(written(part, "negatives") if blocks > 1 else part)
    discard(asked)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, parts)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM r WHERE rank <= 10
"""
