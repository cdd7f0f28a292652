"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integer vectors (floor(1024 * x)); their dimensions play the part of terms. Every task cuts the
rows it reads into ranges (blocks) of similar vectors, by bisection along the direction in which they spread most, and keeps
for each block a forward index (the block's matrix) and, for every dimension, the largest and the smallest value. A
query's bound for a block is the sum over dimensions of the larger of q * max and q * min. A task orders its blocks by bound and
scores them through their forward indexes, until the next bound falls below the query's k-th score; the partial lists of
the tasks then meet in one grouped top-k. Queries travel in chunks of a bounded number of bytes, one scan and one broadcast
at a time, so neither the driver nor a task holds what grows with the data.

Bounds bite where vectors form clusters or are sparse. On vectors spread evenly over a sphere of 64 dimensions no such
bound can fall below the k-th score, and every block is scored; results are exact in both cases.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do rows with
a null id; vectors of another length than a query's are not its candidates; repeated rows are candidates each
(a query skips only rows with its own id); rows of queries that share an id ask once, with the least of their vectors; ties
go to the smaller id; scores are exact at any size, and shown as the nearest value that a long holds; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, table, written

#: Rows of a block, rows that a task gathers before it cuts them into blocks, and bytes of the queries that travel together.
BLOCK, GATHERED, CHUNK_BYTES = 256, 16384, 16 << 20
#: Sums below this are exact in double precision.
EXACT = 2**53
SCHEMA = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """vec_id long, v array<long>: floor(scale * x) of each valid vector."""
    x = lambda e: e.cast("double")
    valid = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & valid).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda e: F.floor(x(e) * scale).cast("long")).alias("v"))


def _blocks(ids: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of similar rows, so that a block's bounds are tight: halves along the direction of the largest spread, until they are small enough."""
    todo = [np.arange(len(m))]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            yield ids[part], m[part]
            continue
        x = (m[part] - m[part].mean(0)).astype(np.float64)
        way = x[np.abs(x).sum(1).argmax()]
        for _ in range(3):
            way = x.T @ (x @ way)
            way /= np.linalg.norm(way) or 1.0
        order = part[np.argsort(x @ way, kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]


def _merged(best_s: np.ndarray, best_i: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query's list and new rows: higher scores first, ties to the smaller id."""
    s, i = np.concatenate([best_s, scores]), np.concatenate([best_i, ids])
    if len(s) > 4 * k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[s >= cut], i[s >= cut]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def search_gathered(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, best: list, k: int) -> int:
    """Updates best (for every query its scores and ids) with rows m, block by block; the number of (query, block) pairs scored.

    q, m: float64 holding integers. Where sums may reach 2**53, Python's integers are used, and no block is passed over."""
    d = q.shape[1]
    if large := bool(d) and float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * d >= EXACT:
        q, m = (np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) for a in (q, m))
        blocks = [(ids[at : at + BLOCK], m[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
        bounds = np.full((len(q), len(blocks)), np.inf)
    else:
        blocks = list(_blocks(ids, m))
        high, low = np.array([b.max(0) for _, b in blocks]), np.array([b.min(0) for _, b in blocks])
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, scored = np.arange(len(q)), 0
    for turn in range(len(blocks)):
        if not large:
            kth = np.array([best[n][0][-1] if len(best[n][0]) == k else -np.inf for n in live], np.float64)
            live = live[bounds[live, order[live, turn]] >= kth]  # an equal bound may still win a tie
        if not len(live):
            break
        scored += len(live)
        at = order[live, turn]
        for b in np.unique(at):
            own = live[at == b]
            b_ids, b_m = blocks[b]
            scores = q[own] @ b_m.T
            for n, s in zip(own, scores, strict=True):
                keep = b_ids != q_ids[n]
                if len(best[n][0]) == k:
                    keep &= (s >= best[n][0][-1]).astype(bool)
                if keep.any():
                    best[n] = _merged(*best[n], s[keep], b_ids[keep], k)
    return scored


@lean
def _search(frames: Iterator[pd.DataFrame], groups: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of a task for each query; groups: queries by number of dimensions."""
    best = {d: [(np.empty(0), np.empty(0, np.int64)) for _ in ids] for d, ids, _ in groups}

    def search(held: list[pd.DataFrame]) -> None:
        frame = pd.concat(held)
        dims = frame["v"].map(len)
        for d, q_ids, q in groups:
            part = frame[dims == d]
            if len(part):
                m = np.array(part["v"].tolist(), np.float64).reshape(len(part), d)
                search_gathered(q_ids, q, part["vec_id"].to_numpy(np.int64), m, best[d], k)

    held, count = [], 0
    for frame in frames:
        held, count = [*held, frame], count + len(frame)
        if count >= GATHERED:
            search(held)
            held, count = [], 0
    if held:
        search(held)
    for d, q_ids, _ in groups:
        for q_id, (s, i) in zip(q_ids, best[d], strict=True):
            if len(s):
                yield pd.DataFrame({"query_id": q_id, "vec_id": i, "score": [max(-(2**63), min(2**63 - 1, int(x))) for x in s]})


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the frames of quantised(). One scan of candidates for each chunk of queries.

    Several chunks are run one after the other and written, so that only one chunk is in the driver and in the tasks at a time."""
    spark = candidates.sparkSession
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-(asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0) // CHUNK_BYTES))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for c in range(chunks):
        own = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        rows = own.toPandas()  # about CHUNK_BYTES
        groups = [(int(d), g["vec_id"].to_numpy(np.int64), np.array(g["v"].tolist(), np.float64).reshape(len(g), int(d))) for d, g in rows.groupby(rows["v"].map(len))] if len(rows) else []
        sent = spark.sparkContext.broadcast(groups)
        found = candidates.select("vec_id", "v").mapInPandas(lambda f, sent=sent: _search(f, sent.value, k), SCHEMA)
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if chunks > 1:
            found = written(found, "best")
            sent.unpersist()
        parts.append(found)
    discard(asked)
    return reduce(DataFrame.union, parts)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
