"""Neighbour joins over points (id, x, y): every pairing goes through grid cells and an equi-join, never through all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, written

#: Points that a cell should hold, for a first guess at its size.
PER_CELL = 8


def distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def _cells(df: DataFrame, size: Column | float) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def _around(df: DataFrame, size: Column | float, reach: int = 1) -> DataFrame:
    """Each row once for every cell within reach."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    return _cells(df, size).withColumn("_s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("_s.a")).withColumn("cy", F.col("cy") + F.col("_s.b")).drop("_s")


def within(points: DataFrame, radius: float, others: DataFrame | None = None) -> DataFrame:
    """i, j, d of all pairs with d <= radius, a point with itself included: cells of the radius' size and an exact filter."""
    if radius <= 0:
        radius = 1e-300
    q, c = _around(points.select("id", "x", "y"), radius), _cells((others or points).select("id", "x", "y"), radius)
    return q.alias("q").join(c.alias("c"), ["cx", "cy"]).select(F.col("q.id").alias("i"), F.col("c.id").alias("j"), distance("q", "c").alias("d")).where(F.col("d") <= radius)


def within_own(points: DataFrame, radius: str, mutual: bool = False, others: DataFrame | None = None) -> DataFrame:
    """i, j, d with d at most i's own radius (a column), or, if mutual, at most the smaller of both radii (others, the candidates, need theirs only then).

    Points are split by the power of two above their radius, so that each class is joined on cells of its size."""
    rows = points.select("id", "x", "y", F.col(radius).alias("r"))
    candidates = rows if others is None else others.select("id", "x", "y", *([F.col(radius).alias("r")] if mutual else []))
    level = F.ceil(F.log2(F.greatest(F.col("r"), F.lit(1e-12))))
    levels = [r[0] for r in rows.select(level.alias("l")).distinct().orderBy("l").collect()]
    out = None
    for n in levels:
        size = float(2.0**n)
        q, c = _around(rows.where(level == n), size), _cells(candidates, size)
        limit = F.least("q.r", "c.r") if mutual else F.col("q.r")
        part = q.alias("q").join(c.alias("c"), ["cx", "cy"]).select(F.col("q.id").alias("i"), F.col("c.id").alias("j"), distance("q", "c").alias("d"), limit.alias("_l")).where(F.col("d") <= F.col("_l")).drop("_l")
        out = part if out is None else out.union(part)
    return out if out is not None else points.sparkSession.createDataFrame([], rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("x").alias("d")).schema)


def _sizes(candidates: DataFrame, k: int, by: str | None) -> DataFrame:
    """The first size of cells, and the extent, of each group (one row without by)."""
    of = {"x1": F.min("x"), "x2": F.max("x"), "y1": F.min("y"), "y2": F.max("y"), "n": F.count(F.lit(1))}
    stats = candidates.groupBy(*([by] if by else [])).agg(*[v.alias(c) for c, v in of.items()]).where("x1 is not null")
    wide = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    extent = F.when(wide > 0, wide).otherwise(1.0)
    return stats.select(*([by] if by else []), extent.alias("_extent"), (extent * F.greatest(F.sqrt(PER_CELL * F.lit(float(k)) / F.col("n")), F.lit(1e-9)) / 3).alias("_size"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, condition: str = "q.id <> c.id", by: str | None = None) -> DataFrame:
    """i, j, d, rank (from 1): of each query its k nearest candidates that meet the condition, ties to the smaller id.

    Rounds of growing cells: a query is done once its k-th distance is inside the border of the cells it has seen; those
    left (ever fewer) go on with cells four times the size, until one cell holds all there is. by: a column within whose groups
    candidates are sought; it is a key of the join, and each group has cells of its own size."""
    keys = [by] if by else []
    sizes = written(_sizes(candidates, k, by), "sizes")
    on = (lambda df: df.join(sizes, by)) if by else (lambda df: df.join(F.broadcast(sizes)))  # a row, or one for each group
    cols = list(dict.fromkeys([*queries.columns]))
    left, c_all, out, times = queries, on(candidates), None, 1.0
    w = Window.partitionBy("i", *[f"_{b}" for b in keys]).orderBy("d", "j")
    while True:
        size = F.col("_size") * times
        q, c = _around(on(left), size).withColumn("_cell", size), _cells(c_all, size)
        fx, fy = F.col("q.x") - F.floor(F.col("q.x") / F.col("q._cell")) * F.col("q._cell"), F.col("q.y") - F.floor(F.col("q.y") / F.col("q._cell")) * F.col("q._cell")
        inside = F.col("q._cell") + F.least(fx, F.col("q._cell") - fx, fy, F.col("q._cell") - fy)
        pairs = q.alias("q").join(c.drop("_size", "_extent").alias("c"), ["cx", "cy", *keys]).where(F.expr(condition))
        found = pairs.select(F.col("q.id").alias("i"), F.col("c.id").alias("j"), distance("q", "c").alias("d"), inside.alias("inside"), (F.col("q._cell") >= 2 * F.col("q._extent")).alias("last"), *[F.col(b).alias(f"_{b}") for b in keys])
        found = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "nearest")
        ended = on(left).where(size >= 2 * F.col("_extent")).select(F.col("id").alias("i"), *[F.col(b).alias(f"_{b}") for b in keys])  # all there is has been seen
        sure = found.where(((F.col("rank") == k) & (F.col("d") < F.col("inside"))) | F.col("last")).select("i", *[f"_{b}" for b in keys]).union(ended)
        sure = written(sure.distinct(), "sure")
        done = found.join(sure, ["i", *[f"_{b}" for b in keys]], "left_semi").select("i", "j", "d", "rank")
        out = done if out is None else out.union(done)
        match = left["id"] == sure["i"]
        for b in keys:
            match &= left[b] == sure[f"_{b}"]
        before, left = left, written(left.join(sure, match, "left_anti").select(*cols), "left")
        discard(before if times > 1 else None)
        if left.isEmpty() or sizes.isEmpty():
            return out
        times *= 4


def knn_graph(points: DataFrame, k: int = 20, by: str | None = None) -> DataFrame:
    """i, j, d, rank: k nearest others of each point (fewer if there are fewer); a point is told from its copies by id.

    by: a column within whose groups neighbours are sought. Of points at one place only the k + 1 smallest ids can be anyone's neighbour, so larger stacks are cut to those."""
    place = Window.partitionBy("x", "y", *([by] if by else [])).orderBy("id")
    kept = points.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).drop("_n")
    return nearest(points, kept, min(k, max(1, points.count() - 1)), by=by)


def inverse_edges(knn: DataFrame, k: int) -> DataFrame:
    """knn with inv_pos: j * k + (rank of i among j's neighbours) - 1, or -1 where i is none."""
    back = knn.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("rank").alias("_r"))
    return knn.join(back, ["i", "j"], "left").withColumn("inv_pos", F.coalesce(F.col("j") * k + F.col("_r") - 1, F.lit(-1)).cast("long")).drop("_r")


def symmetric(edges: DataFrame) -> DataFrame:
    both = edges.select("i", "j", "d").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.max("d").alias("w"))


def gap_adjacency(points: DataFrame, ne: int, threshold: float, by: str | None = None) -> DataFrame:
    """i, j, w both ways: the nearest neighbour always, of the others up to ne those within the threshold."""
    return symmetric(knn_graph(points, ne, by).where((F.col("rank") == 1) | (F.col("d") <= threshold)))


def _layers(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """Points of the outer k convex layers (all points on their borders), by rows."""
    rest, kept = frame.sort_values(["x", "y", "id"]).reset_index(drop=True), []
    for _ in range(k):
        if len(rest) == 0:
            break
        xy = rest[["x", "y"]].to_numpy()

        def half(order: range, xy: np.ndarray = xy) -> list[int]:
            hull: list[int] = []
            for n in order:
                while len(hull) > 1 and (xy[hull[-1], 0] - xy[hull[-2], 0]) * (xy[n, 1] - xy[hull[-2], 1]) - (xy[hull[-1], 1] - xy[hull[-2], 1]) * (xy[n, 0] - xy[hull[-2], 0]) < 0:
                    hull.pop()
                hull.append(n)
            return hull

        outer = sorted(set(half(range(len(xy)))) | set(half(range(len(xy) - 1, -1, -1))))
        kept.append(rest.iloc[outer])
        rest = rest.drop(index=outer).reset_index(drop=True)
    return pd.concat(kept) if kept else frame.iloc[:0]


def outer_layers(points: DataFrame, k: int) -> DataFrame:
    """id, x, y of all points in the outer k convex layers of their group (column g): the k farthest points of any point lie there.

    Tasks peel what they hold first, then each group what is left of it."""
    schema = "g long, id long, x double, y double"

    def peel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for g, part in frame.groupby("g"):
                held[g] = _layers(pd.concat([held[g], part]) if g in held else part, k)
        yield from held.values()

    first = points.select("g", "id", "x", "y").mapInPandas(peel, schema)
    return first.groupBy("g").applyInPandas(lambda f: _layers(f, k), schema)


def k_farthest(points: DataFrame, ne: int, threshold: float) -> DataFrame:
    """i, j, w both ways: of each point's ne farthest points those at the threshold or beyond."""
    from .cells import farthest

    return symmetric(farthest(points, ne).where(F.col("d") >= threshold))


def nearest_centre(points: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """points with centre, d1 and d2: the nearest of a few centres (id, x, y; ties to the smaller id), its distance and the next one's."""
    of = [F.struct(F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)).alias("d"), F.lit(int(c)).alias("c")) for c, cx, cy in centres]
    ordered = points.withColumn("_o", F.array_sort(F.array(*of)))
    return ordered.withColumns({"centre": F.col("_o")[0]["c"], "d1": F.col("_o")[0]["d"], "d2": F.get(F.col("_o"), F.lit(1))["d"]}).drop("_o")


def snapped(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Each centre (id, x, y) with the nearest data point: i (centre), j, d."""
    return nearest(centres, points, 1, "true").drop("rank")
