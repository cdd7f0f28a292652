"""Scaling and binning of columns. Bounds are one aggregation whose few numbers become literals, never a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes 0."""
    b = bounds(df, cols)
    return df.withColumns({c: (F.col(c) - lo) / ((hi - lo) or 1.0) for c, (lo, hi) in b.items() if lo is not None})


def standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; a deviation of 0 counts as 1."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] or 1.0) for c in cols if row[f"m_{c}"] is not None})


def block_scale(df: DataFrame, cols: list[str], lo: float = 0.25, hi: float = 0.5) -> DataFrame:
    """All columns scaled by one pair of bounds, that of the whole matrix, into [lo, hi]."""
    b = bounds(df, cols)
    least, most = min(v[0] for v in b.values()), max(v[1] for v in b.values())
    return df.withColumns({c: lo + (F.col(c) - least) / ((most - least) or 1.0) * (hi - lo) for c in cols})


def guarded_log(c: Column) -> Column:
    return F.log(c + 1e-15)


def quantise(df: DataFrame, col: str, start: float, end: float, levels: int = 19, out: str = "level") -> DataFrame:
    """The nearest of `levels` evenly spaced values, the lower one on ties; an empty range gives start."""
    if start == end:
        return df.withColumn(out, F.lit(float(start)))
    step = (end - start) / (levels - 1)
    grid = F.array(*[F.lit(float(start + step * k)) for k in range(levels)])
    nearest = F.array_min(F.transform(grid, lambda g: F.struct(F.abs(F.col(col) - g).alias("d"), g.alias("g"))))
    return df.withColumn(out, nearest["g"])


def score_deciles(df: DataFrame, score: str, by: str, out: str = "decile") -> DataFrame:
    """1..10 by the score's place between its group's bounds; 5 in groups of one value."""
    b = df.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    place = F.least(F.floor((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 10) + 1, F.lit(10))
    return df.join(b, by).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), place).otherwise(5).cast("int")).drop("_lo", "_hi")


def softmax(df: DataFrame, distance: str, temperature: float, by: str, out: str = "p") -> DataFrame:
    """exp(-d / T) over its sum within the group, shifted by the group's least distance."""
    low = df.groupBy(by).agg(F.min(distance).alias("_lo"))
    shifted = df.join(low, by).withColumn("_e", F.exp(-(F.col(distance) - F.col("_lo")) / temperature))
    return shifted.join(shifted.groupBy(by).agg(F.sum("_e").alias("_sum")), by).withColumn(out, F.col("_e") / F.col("_sum")).drop("_lo", "_e", "_sum")


def marked(df: DataFrame, score: str, threshold: float | None = None, ratio: float = 0.1) -> DataFrame:
    """Rows above the threshold; without one, the highest max(1, int(n * ratio)) scores (ties to the higher id)."""
    if threshold is not None:
        return df.where(F.col(score) > threshold)
    return df.orderBy(F.desc(score), F.desc("id")).limit(max(1, int(df.count() * ratio)))


def top(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.desc("id")).limit(k)


def top_per(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """The k best rows of each group; rank starts at 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
