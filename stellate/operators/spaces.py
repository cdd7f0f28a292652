"""Exact neighbour joins over points of any number of dimensions (id, v: array<double>), by pivots and the triangle inequality.

Points are sorted by their nearest pivot and its distance and packed into parts of a bounded number of rows. A part knows, for every
pivot, the least and the largest distance of its points. Since |d(q, p) - d(c, p)| <= d(q, c) <= d(q, p) + d(c, p), two
parts have a least and a largest possible distance; of all pairs of parts only those are joined that can hold a result.
The joined parts of one query part pass through a task one after the other, nearest first, and a query stops looking into parts
that lie beyond its k-th distance. Where points form no clusters the bounds can't bite (64 even dimensions are such a case): all pairs of parts
are joined then, in blocks of matrices, still exactly.

Vectors of other lengths than the first pivot's, and those that are null or hold nulls or non-finite values, take no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.storage import importable, written
from .draws import uniform
from .neighbors import symmetric
from .sampling import numbered

#: Pivots, points of a part, and bytes of part summaries that travel together.
PIVOTS, PART, SUMMARY_BYTES = 16, 2048, 16 << 20
PAIRS = "i long, j long, d double"


def vectors(points: DataFrame, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """id, v: the valid vectors of a column of arrays of numbers."""
    x = lambda e: e.cast("double")
    valid = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    return points.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & valid).select(F.col(id_col).alias("id"), F.transform(vector_col, x).alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an array column as a matrix; all have d values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summed(columns: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Roots of sums of squared differences, added component by component in their order.

    So a distance depends on its two points only, not on where a block starts, copies have one and the same distance, and SQL's sums are repeated to the last bit."""
    out = np.zeros(shape)
    for diff in columns:
        diff *= diff
        out += diff
    return np.sqrt(out, out=out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, from differences (sums of squares apart lose digits of near points)."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 16) // max(1, len(b)))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        out[at : at + step] = _summed((some[:, n, None] - b[None, :, n] for n in range(b.shape[1])), (len(some), len(b)))
    return out


def _near(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of all pairs of rows of a and b within each row's limit: by products first, exactly then."""
    aa, bb = np.einsum("nd,nd->n", a, a), np.einsum("nd,nd->n", b, b)
    slack = 1e-9 * (float(aa.max(initial=0)) + float(bb.max(initial=0)) + 1e-300)
    rough = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    r, c = np.nonzero(rough <= np.square(limit)[:, None] * (1 + 1e-9) + slack)
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    d = _summed((at[n][r] - bt[n][c] for n in range(len(at))), r.shape)
    keep = d <= limit[r]
    return r[keep], c[keep], d[keep]


def pivots_of(points: DataFrame, n: int = PIVOTS, seed: int = 0) -> np.ndarray:
    """n points (fewer, if there are fewer) of the smallest hashes of their ids, as rows of a matrix."""
    rows = points.orderBy(uniform(seed, "id"), "id").limit(n).select("v").collect()
    d = len(rows[0].v) if rows else 0
    return np.array([r.v for r in rows if len(r.v) == d], float).reshape(-1, d) if d else np.empty((0, 0))


def packed(points: DataFrame, pivots: np.ndarray, size: int = PART) -> DataFrame:
    """part, ids, flat (the vectors one after the other), low, high (of the distances to each pivot), written."""
    m, d = pivots.shape

    def measured(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                far = distances(matrix(frame["v"], d), pivots)
                near = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([frame["id"], frame["v"], pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1)), near], ["id", "v", "pivot", "to", "far"])

    rows = points.where(F.size("v") == d).select("id", "v").mapInArrow(measured, "id long, v array<double>, pivot int, to double, far array<double>")
    rows = numbered(written(rows, "measured"), "pivot", "to", "id").withColumn("part", F.floor(F.col("n") / size))
    of = lambda f: F.array(*[f(F.col("far")[n]) for n in range(m)])
    out = rows.groupBy("part").agg(F.collect_list(F.struct("id", "v")).alias("rows"), of(F.min).alias("low"), of(F.max).alias("high"))
    return written(out.select("part", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"), "low", "high"), "packed")


def part_pairs(queries: DataFrame, candidates: DataFrame, k: int | None, radius: float | None) -> DataFrame:
    """q, c, least: the pairs of packed parts that can hold one of k nearest points, or any within the radius; least is their least possible distance.

    A query part needs no part whose least distance exceeds the largest distance within which its nearest parts hold k + 1 points for sure."""
    per_row = 16 * len(candidates.select("low").first()[0]) + 24
    count = candidates.count()
    blocks, out = max(1, -(-count * per_row // SUMMARY_BYTES)), None
    for b in range(blocks):
        own = candidates.where(F.col("part") % blocks == b).select("part", F.size("ids").alias("n"), "low", "high").toPandas()  # SUMMARY_BYTES
        part, n, low, high = own["part"].to_numpy(), own["n"].to_numpy(), np.array(own["low"].tolist()), np.array(own["high"].tolist())

        def pairs(frames: Iterator[pa.RecordBatch], part=part, n=n, low=low, high=high) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for q, q_low, q_high in zip(frame["part"].to_numpy(), frame["low"].to_pylist(), frame["high"].to_pylist(), strict=True):
                    least = np.maximum((np.maximum(low - np.array(q_high), np.array(q_low) - high) - 1e-12 * (high + np.array(q_high))).max(1), 0.0)
                    most = (high + np.array(q_high)).min(1)
                    order = np.argsort(most, kind="stable")
                    sure = np.searchsorted(np.cumsum(n[order]), (k or 0) + 1)
                    limit = radius if radius is not None else (most[order[sure]] if sure < len(order) else np.inf)
                    keep = np.flatnonzero(least <= limit * (1 + 1e-12))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), q)), pa.array(part[keep]), pa.array(least[keep]), pa.array(most[keep]), pa.array(n[keep].astype(np.int64))], ["q", "c", "least", "most", "n"])

        one = queries.select("part", "low", "high").mapInArrow(pairs, "q long, c long, least double, most double, n long")
        out = one if out is None else out.unionByName(one)
    if k is not None and blocks > 1:
        out = written(out, "pairs")
        upto = Window.partitionBy("q").orderBy("most", "c")
        sure = out.withColumn("held", F.sum("n").over(upto)).where(F.col("held") > k).groupBy("q").agg(F.min("most").alias("limit"))
        out = out.join(sure, "q", "left").where(F.col("limit").isNull() | (F.col("least") <= F.col("limit")))
    return out.select("q", "c", "least")


def _streamed(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, d: int, k: int | None, radius: float | None, others: bool) -> DataFrame:
    """i, j, d of the joined parts; the rows of one query part come together, the part itself first, then its candidates by their least distance."""
    own = queries.select(F.col("part").alias("q"), F.lit(-1.0).alias("least"), F.lit(-1).cast("long").alias("c"), "ids", "flat")
    met = pairs.join(candidates.select(F.col("part").alias("c"), "ids", "flat"), "c").select("q", "least", "c", "ids", "flat")
    rows = own.unionByName(met).repartition("q").sortWithinPartitions("q", "least", "c")

    def found(best_d: np.ndarray, best_j: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        full = best_d < np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, full.sum(1))), pa.array(best_j[full]), pa.array(best_d[full])], ["i", "j", "d"])

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, q, best_d, best_j = None, None, None, None, None
        for frame in frames:
            for n in range(frame.num_rows):
                part, c = frame["q"][n].as_py(), frame["c"][n].as_py()
                c_ids = frame["ids"].slice(n, 1).flatten().to_numpy()
                m = frame["flat"].slice(n, 1).flatten().to_numpy().reshape(len(c_ids), d)
                if c < 0:
                    if at is not None and k is not None:
                        yield found(best_d, best_j, ids)
                    at, ids, q = part, c_ids.copy(), m.copy()
                    if k is not None:
                        best_d, best_j = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
                    continue
                limit = np.full(len(ids), radius) if k is None else best_d[:, -1]
                live = np.flatnonzero(limit >= frame["least"][n].as_py())
                for cut in range(0, len(live), 1024):
                    some = live[cut : cut + 1024]
                    r, col, dist = _near(q[some], m, limit[some])
                    if others:
                        keep = ids[some][r] != c_ids[col]
                        r, col, dist = r[keep], col[keep], dist[keep]
                    if k is None:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some][r]), pa.array(c_ids[col]), pa.array(dist)], ["i", "j", "d"])
                        continue
                    order = np.lexsort((c_ids[col], dist, r))
                    r, col, dist = r[order], col[order], dist[order]
                    turn = np.arange(len(r)) - np.searchsorted(r, r, "left")
                    r, col, dist, turn = r[turn < k], col[turn < k], dist[turn < k], turn[turn < k]
                    new_d, new_j = np.full((len(some), k), np.inf), np.zeros((len(some), k), np.int64)
                    new_d[r, turn], new_j[r, turn] = dist, c_ids[col]
                    both_d, both_j = np.concatenate([best_d[some], new_d], 1), np.concatenate([best_j[some], new_j], 1)
                    pick = np.lexsort((both_j, both_d), axis=1)[:, :k]
                    best_d[some], best_j[some] = np.take_along_axis(both_d, pick, 1), np.take_along_axis(both_j, pick, 1)
        if at is not None and k is not None:
            yield found(best_d, best_j, ids)

    return rows.mapInArrow(search, PAIRS)


def _joined(queries: DataFrame, candidates: DataFrame, k: int | None, radius: float | None, others: bool, pivots: int, size: int) -> DataFrame:
    importable(candidates.sparkSession)
    at = pivots_of(candidates, pivots)
    if not len(at):
        return candidates.sparkSession.createDataFrame([], PAIRS)
    same = queries is candidates
    c = packed(candidates, at, size)
    q = c if same else packed(queries, at, size)
    return _streamed(q, c, part_pairs(q, c, k, radius), at.shape[1], k, radius, others)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, others: bool = True, pivots: int = PIVOTS, size: int = PART) -> DataFrame:
    """i, j, d, rank (from 1): of each query its k nearest candidates (with others, not its own id), ties to the smaller id.

    Rows of one id are queries each, and their lists are one list."""
    found = _joined(queries, candidates, k, None, others, pivots, size)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def within(points: DataFrame, radius: float, others: DataFrame | None = None, pivots: int = PIVOTS, size: int = PART) -> DataFrame:
    """i, j, d of all pairs with d <= radius, a point with itself included."""
    return _joined(points, points if others is None else others, None, radius, False, pivots, size)


def knn_graph(points: DataFrame, k: int = 20, **how) -> DataFrame:
    """i, j, d, rank: k nearest others of each point. Of points at one place only the k + 1 smallest ids can be anyone's neighbour."""
    place = Window.partitionBy("v").orderBy("id")
    kept = written(points.select("id", "v").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).drop("_n"), "places")
    return nearest(points.select("id", "v"), kept, k, **how)


def gap_adjacency(points: DataFrame, ne: int, threshold: float, **how) -> DataFrame:
    """i, j, w both ways: the nearest neighbour always, of the others up to ne those within the threshold."""
    return symmetric(knn_graph(points, ne, **how).where((F.col("rank") == 1) | (F.col("d") <= threshold)))


def nearest_centre(points: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """points (with a column v) with centre, d1, d2: the nearest of a few centres (ties to the first), its distance and the next one's."""
    importable(points.sparkSession)
    numbers, m = np.array([c for c, _ in centres], np.int64), np.array([v for _, v in centres], float)

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                d = distances(matrix(frame["v"], m.shape[1]), m)
                order = np.argsort(d, axis=1, kind="stable")
                first = np.take_along_axis(d, order[:, :2], 1)
                second = pa.array(first[:, 1]) if m.shape[0] > 1 else pa.nulls(len(d), pa.float64())
                yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(numbers[order[:, 0]]), pa.array(first[:, 0]), second], [*frame.schema.names, "centre", "d1", "d2"])

    return points.mapInArrow(assign, StructType([*points.schema.fields, StructField("centre", LongType()), StructField("d1", DoubleType()), StructField("d2", DoubleType())]))
