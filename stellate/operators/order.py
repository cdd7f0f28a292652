"""Running sums and exact order statistics over tables of any size: sorted ranges with offsets between them, never one window over all rows.

Equal values are counted before they are sorted, so a value that many rows share is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def running(df: DataFrame, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name of values, the sum of its column over all rows before in the order.

    A range adds up its own rows and gets the sum of the ranges before (a row for each range)."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_s{c}") for c, v in values.items()])
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s{c}").over(parts), F.lit(0)).alias(f"_o{c}") for c in values])
    inner = ranged.withColumns({f"_i{c}": F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in values.items()})
    out = inner.join(F.broadcast(offsets), "_part").withColumns({c: F.col(f"_i{c}") + F.col(f"_o{c}") for c in values})
    return out.drop("_part", *[f"{p}{c}" for c in values for p in ("_i", "_o")])


def counted(df: DataFrame, by: list[str], col: str | Column) -> tuple[DataFrame, DataFrame]:
    """(by, _v, _n, _at: the rows of its group below it) of each distinct non-null value, and (by, _size) of each group."""
    value = F.col(col) if isinstance(col, str) else col
    values = df.select(*by, value.alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    rows = written(running(values, [*by, "_v"], {"_at": F.col("_n")}), "order")
    groups = rows.groupBy(*by).agg(F.min("_at").alias("_first"), F.sum("_n").alias("_size"))
    rows = rows.join(groups, by) if by else rows.join(F.broadcast(groups))
    return rows.withColumn("_at", F.col("_at") - F.col("_first")), groups


def quantiles(df: DataFrame, by: list[str], col: str | Column, shares: dict[str, float]) -> DataFrame:
    """by and, for each name of shares, the value at that share of the group's order, interpolated between neighbours; one row without by.

    Rows with a null value are passed over; groups of nulls only have no row."""
    rows, _ = counted(df, by, col)
    place = {name: (F.col("_size") - 1) * F.lit(float(q)) for name, q in shares.items()}
    at = lambda p: F.max(F.when((F.col("_at") <= p) & (p < F.col("_at") + F.col("_n")), F.col("_v")))
    low = {name: at(F.floor(p)) for name, p in place.items()}
    high = {name: at(F.ceil(p)) for name, p in place.items()}
    share = {name: F.max(p - F.floor(p)) for name, p in place.items()}
    return rows.groupBy(*by).agg(*[(low[n] * (1 - share[n]) + high[n] * share[n]).alias(n) for n in shares])


def kth(df: DataFrame, col: str | Column, k: int):
    """The value at place k (from 0) of a column's order; None beyond the end."""
    rows, _ = counted(df, [], col)
    found = rows.where((F.col("_at") <= k) & (F.col("_at") + F.col("_n") > k)).select("_v").first()
    return found[0] if found else None
