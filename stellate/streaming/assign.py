"""Structured Streaming over points: assignment to fixed centres, and windowed counts by cluster with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.centres import Centre
from ..operators.neighbors import nearest_centre


def assigned(stream: DataFrame, centres: list[Centre]) -> DataFrame:
    """The stream with each point's centre and distance; stateless."""
    return nearest_centre(stream, centres).drop("d2").withColumnRenamed("d1", "distance")


def cluster_counts(stream: DataFrame, centres: list[Centre], time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, centre, n, mean_distance; rows later than the watermark are dropped."""
    return assigned(stream.withWatermark(time, late), centres).groupBy(F.window(time, window), "centre").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))
