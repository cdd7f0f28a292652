"""Repeatable sampling by hashes of id and seed, seeding of centres, global numbering and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .centres import Centre, nearest_centre
from .draws import uniform


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, drawn by weight (exponential keys); rows without weight are never drawn."""
    return df.where(F.col(weight) > 0).orderBy(-F.log(uniform(seed, "id")) / F.col(weight), "id").limit(n)


def poisson_sample(df: DataFrame, n: int, weight: str, boost: float = 1.5, seed: int = 0) -> DataFrame:
    """Each row with the probability boost * n * weight / total, on its own."""
    total = df.agg(F.sum(weight)).first()[0] or 1.0
    return df.where(uniform(seed, "id") <= F.least(boost * n * F.col(weight) / float(total), F.lit(1.0)))


def d2_seeding(points: DataFrame, k: int, seed: int = 0, weight: str | None = None) -> list[Centre]:
    """k centres, each drawn by (weighted) squared distance to those before; the first by weight alone."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = points.orderBy(-F.log(uniform(seed, "id")) / w, "id").select("x", "y").first()
    centres: list[Centre] = [(0, first.x, first.y)] if first else []
    while centres and len(centres) < k:
        key = -F.log(uniform(seed + len(centres), "id")) / (w * F.col("d1") * F.col("d1"))
        drawn = nearest_centre(points, centres).where("d1 > 0").agg(F.min_by(F.struct("x", "y"), F.struct(key, "id")).alias("p")).first().p
        if drawn is None:
            break
        centres.append((len(centres), drawn.x, drawn.y))
    return centres


def numbered(df: DataFrame, *order: str, out: str = "n") -> DataFrame:
    """df with global row numbers from 0 in an order of columns: numbers within ranges, and offsets between them (a row for each range).

    Ranges are written before they are counted: planned twice, the same ranges may be cut or merged in two ways, and rows would get wrong numbers or go."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return ranged.withColumn("_i", inner).join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_i") + F.col("_o")).cast("long")).drop("_part", "_i", "_o")


def batches(df: DataFrame, size: int, order: str = "id") -> DataFrame:
    """df with batch: consecutive groups of so many rows."""
    return numbered(df, order, out="_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def subsets(df: DataFrame, col: str, size: int) -> DataFrame:
    """All combinations of `size` different values as columns c1 < c2 < ...; the values should be few (centres, not points)."""
    values = df.select(col).distinct()
    out = values.select(F.col(col).alias("c1"))
    for n in range(2, size + 1):
        out = out.join(values.select(F.col(col).alias(f"c{n}")), F.col(f"c{n}") > F.col(f"c{n - 1}"))
    return out
