"""Per-point scores: density, projection overlap and fringe, core points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .cells import counts_within
from .neighbors import nearest_centre
from .order import quantiles
from .scaling import bounds


def density(points: DataFrame) -> DataFrame:
    """id, score: neighbours (a point itself included) within R/4, R/8 and R/16, summed, over the number of points; R is
    half the diagonal of the square over the coordinates' common range. Cells inside a radius are counted whole."""
    b = bounds(points, ["x", "y"])
    lo, hi = min(b["x"][0], b["y"][0]), max(b["x"][1], b["y"][1])
    full = ((hi - lo) ** 2 * 2) ** 0.5 / 2
    counts = counts_within(points, [full / 4, full / 8, full / 16])
    return counts.select("id", ((F.col("n0") + F.col("n1") + F.col("n2")) / points.count()).alias("score"))


def projection_overlap(points: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """id, score: how near a point lies to the border with another centre's cell, 1 on the border, 0 at its own centre or beyond."""
    own = nearest_centre(points, centres)
    terms = []
    for c, cx, cy in centres:
        inner = []
        for o, ox, oy in centres:
            if o != c and (square := (cx - ox) ** 2 + (cy - oy) ** 2):
                inner.append(2.0 * ((F.lit(cx) - F.col("x")) * (cx - ox) + (F.lit(cy) - F.col("y")) * (cy - oy)) / square)
        terms.append(F.when(F.col("centre") == c, F.greatest(F.lit(0.0), F.lit(0.0), *inner)))
    return own.select("id", F.coalesce(*terms).alias("score"))


def fringe(points: DataFrame, centre_sets: list[list[tuple[int, float, float]]]) -> DataFrame:
    """id, score: the mean overlap over several sets of centres (usually of k-means with 3, 5 and 10)."""
    out = None
    for n, centres in enumerate(centre_sets):
        one = projection_overlap(points, centres).withColumnRenamed("score", f"s{n}")
        out = one if out is None else out.join(one, "id")
    return out.select("id", (sum(F.col(f"s{n}") for n in range(len(centre_sets))) / len(centre_sets)).alias("score"))


def core_points(points: DataFrame, centres: list[tuple[int, float, float]], q_core: float = 0.3, alpha: float = 10.0, beta: float = 5.0) -> DataFrame:
    """id, score (0 to 1): high for points well inside their cluster's core radius and far from the next centre.

    Clusters are the points' labels; a single centre counts as its own second, with a margin of 0."""
    eps = 1e-8
    rows = nearest_centre(points, centres).withColumn("margin", F.coalesce(F.col("d2"), F.col("d1")) - F.col("d1"))
    rows = written(rows.select("id", "label", "d1", "margin"), "margins")
    inner = quantiles(rows, ["label"], "d1", {"core": q_core, "middle": 0.5})
    apart = quantiles(rows.where("margin > 0"), ["label"], "margin", {"margin": 0.5})
    stats = inner.join(apart, "label", "left").select("label", (F.col("core") + eps).alias("core"), (F.coalesce("margin", "middle") + eps).alias("scale"))
    sigmoid = lambda v: 1.0 / (1.0 + F.exp(-v))
    raw = rows.join(stats, "label").select("id", (sigmoid(-alpha * (F.col("d1") / F.col("core") - 1.0)) * sigmoid(beta * F.greatest(F.col("margin"), F.lit(0.0)) / F.col("scale"))).alias("score"))
    lo, hi = bounds(raw, ["score"])["score"]
    return raw.select("id", ((F.col("score") - lo) / (hi - lo + eps)).alias("score"))


def aspect_ratio(points: DataFrame) -> DataFrame:
    """The largest over the smallest distance between two points: the one from the convex hull, the other from a neighbour join; null if points coincide."""
    from .clusterstats import _diameter
    from .neighbors import nearest, outer_layers

    hull = outer_layers(points.select(F.lit(0).cast("long").alias("g"), "id", "x", "y"), 1)
    far = hull.groupBy("g").applyInPandas(_diameter, "label long, diameter double").select("diameter").first()[0]
    close = nearest(points, points, 1).agg(F.min("d").alias("least"))
    return close.select(F.try_divide(F.lit(far), F.col("least")).alias("aspect_ratio"))
