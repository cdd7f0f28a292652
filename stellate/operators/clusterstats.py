"""Statistics of labelled points (id, x, y, label): centroids, radii, size, density, diameter and zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .neighbors import outer_layers

EPS = 1e-12


def centroids(points: DataFrame, weight: str | None = None) -> DataFrame:
    """label, cx, cy: (weighted) means of each label's points."""
    if weight is None:
        return points.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w = F.col(weight)
    return points.groupBy("label").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"))


def to_centre(points: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """points with r, the distance to their label's centre."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return points.join(centres if centres is not None else centroids(points), "label").withColumn("r", F.sqrt(dx * dx + dy * dy)).drop("cx", "cy")


def _with_radius(points: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    with_r = to_centre(points, centres)
    return with_r.join(with_r.groupBy("label").agg(F.max("r").alias("radius")), "label")


def radius_all(points: DataFrame) -> DataFrame:
    """id, radius: the largest distance to the centroid in the point's cluster."""
    return _with_radius(points).select("id", "radius")


def radius_at_centre(points: DataFrame) -> DataFrame:
    """id, radius: the cluster's radius at its point closest to the centroid (ties to the smaller id), 0 elsewhere."""
    rows = _with_radius(points)
    first = rows.groupBy("label").agg(F.min(F.struct("r", "id")).alias("m")).select("label", F.col("m.id").alias("centre_id"))
    return rows.join(first, "label").select("id", F.when(F.col("id") == F.col("centre_id"), F.col("radius")).otherwise(0.0).alias("radius"))


def _diameter(frame: pd.DataFrame) -> pd.DataFrame:
    xy = frame[["x", "y"]].to_numpy()
    most = 0.0
    for at in range(0, len(xy), 1024):
        diff = xy[at : at + 1024, None, :] - xy[None, :, :]
        most = max(most, float(np.sqrt((diff * diff).sum(2)).max()))
    return pd.DataFrame({"label": [frame["g"].iloc[0]], "diameter": [most]})


def size_density_diameter(points: DataFrame) -> DataFrame:
    """label, size, density, diameter. The density weighs the shares of members within m tenths of the radius, the inner ones most;
    the farthest pair lies on the convex hull, so only hulls are compared."""
    rows = _with_radius(points)
    share = lambda m: F.avg((F.try_divide(F.col("r"), F.col("radius")) <= m / 10).cast("double"))
    weighted = sum(((11 - m) * share(m) for m in range(1, 11)), F.lit(0.0)) / 55.0
    density = F.when((F.count(F.lit(1)) == 1) | (F.max("radius") < EPS), 1.0).otherwise(weighted)
    stats = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"), density.alias("density"))
    hulls = outer_layers(points.select(F.col("label").cast("long").alias("g"), "id", "x", "y"), 1)
    diameters = hulls.groupBy("g").applyInPandas(_diameter, "label long, diameter double")
    return stats.join(diameters, "label")


def _share(points: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    t = F.col("r") / F.greatest(F.col("radius"), F.lit(EPS))
    return _with_radius(points, centres).withColumn("t", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def zones(points: DataFrame, bins: int = 10) -> DataFrame:
    """id, label, zone: min(floor(bins * t), bins - 1) + 1 for the distance t to the centroid as a share of the cluster's radius."""
    return _share(points).select("id", "label", (F.least(F.floor(F.col("t") * bins), F.lit(bins - 1)) + 1).cast("int").alias("zone"))


def true_zones(points: DataFrame, centres: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """id, label, zone: ceil(bins * t) between 1 and bins, with given centres (label, cx, cy); differs from zones() at the borders."""
    return _share(points, centres).select("id", "label", F.least(F.greatest(F.ceil(F.col("t") * bins), F.lit(1)), F.lit(bins)).cast("int").alias("zone"))


def centre_zones(points: DataFrame, centres: list[tuple[int, float, float]], bins: int = 10) -> DataFrame:
    """id, centre, zone: true_zones() of the clusters that a few centres (id, x, y), as k-means finds them, make of the points: a point belongs
    to its nearest centre, whose radius is the distance of its farthest point."""
    from .neighbors import nearest_centre

    own = nearest_centre(points, centres)
    radii = own.groupBy("centre").agg(F.max("d1").alias("_radius"))  # a row a centre
    t = F.least(F.col("d1") / F.greatest(F.col("_radius"), F.lit(EPS)), F.lit(1.0))
    return own.join(F.broadcast(radii), "centre").select("id", "centre", F.least(F.greatest(F.ceil(t * bins), F.lit(1)), F.lit(bins)).cast("int").alias("zone"))


def duplicates(points: DataFrame) -> DataFrame:
    """x, y, id (the smallest), weight of each distinct place."""
    return points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))


def smallest_gap(df: DataFrame, col: str) -> DataFrame:
    """The smallest difference above 0 between neighbouring values: sorted by range, with each range's last value carried on."""
    values = written(df.select(F.col(col).cast("double").alias("v")).distinct().repartitionByRange("v").select("v", F.spark_partition_id().alias("part")), "ranges")  # planned twice, ranges may differ
    inner = values.withColumn("prev", F.lag("v").over(Window.partitionBy("part").orderBy("v"))).where("prev is not null").select((F.col("v") - F.col("prev")).alias("gap"))
    edges = values.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row for each range
    between = edges.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.orderBy("part"))).where("gap is not null").select("gap")
    return inner.union(between).agg(F.min("gap").alias("gap"))
