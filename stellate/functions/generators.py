"""Synthetic point sets as expressions over spark.range; seeds are explicit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.draws import normal, truncated, uniform

DISTRIBUTIONS = ("uniform", "normal", "exponential", "student_t", "lognormal", "laplace", "cauchy", "ring", "gamma", "beta", "moons", "moons_circles")
SHAPES = ("smile", "spiral", "parabola", "squares", "face", "two_arms", "bowl", "nested_blocks")
#: Modes and the side of the square that they lie in, of instance id % 10; without modes points are uniform.
CURRICULUM = ((0, 0), (3, 10), (3, 30), (3, 50), (5, 10), (5, 30), (5, 50), (7, 10), (7, 30), (7, 50))


def _u(seed: int, salt: int) -> Column:
    return uniform(seed * 97 + salt, "id")


def _z(seed: int, salt: int) -> Column:
    return normal(seed * 97 + salt, "id")


def _value(kind: str, seed: int, axis: int) -> Column:
    s = 20 * axis
    if kind == "uniform":
        return _u(seed, s)
    if kind == "normal":  # drawn again beyond three deviations
        return truncated(lambda t: _z(seed, s + 200 * t), -3.0, 3.0, F.lit(0.0))
    if kind == "exponential":
        return -F.log(_u(seed, s))
    if kind == "student_t":  # three degrees of freedom
        return _z(seed, s) / F.sqrt((F.pow(_z(seed, s + 1), 2) + F.pow(_z(seed, s + 2), 2) + F.pow(_z(seed, s + 3), 2)) / 3)
    if kind == "lognormal":
        return F.exp(_z(seed, s))
    if kind == "laplace":
        return F.log(_u(seed, s) / _u(seed, s + 1))
    if kind == "cauchy":
        return F.tan(math.pi * (_u(seed, s) - 0.5))
    gamma = lambda shape, at: sum((-F.log(_u(seed, at + k)) for k in range(shape)), F.lit(0.0))
    if kind == "gamma":  # whole shapes are sums of exponentials
        return gamma(2, s)
    if kind == "beta":
        a, b = gamma(2, s), gamma(5, s + 5)
        return a / (a + b)
    raise ValueError(kind)


def points(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """id, x, y, label of n points of a distribution or shape."""
    rows = spark.range(n)
    angle = 2 * math.pi * _u(seed, 61)
    if kind == "ring":
        r = 1 + 0.1 * _z(seed, 62)
        return rows.withColumn("_a", angle).withColumn("_r", r).select("id", (F.col("_r") * F.cos("_a")).alias("x"), (F.col("_r") * F.sin("_a")).alias("y"), F.lit(0).alias("label"))
    if kind == "moons":
        t = rows.withColumns({"_t": math.pi * _u(seed, 61), "label": (F.col("id") % 2).cast("int")})
        up = F.col("label") == 0
        return t.select("id", (F.when(up, F.cos("_t")).otherwise(1 - F.cos("_t")) + 0.05 * _z(seed, 63)).alias("x"), (F.when(up, F.sin("_t")).otherwise(0.5 - F.sin("_t")) + 0.05 * _z(seed, 64)).alias("y"), "label")
    if kind == "moons_circles":  # half of the points are moons, half are a circle within another
        t = rows.withColumns({"_t": math.pi * _u(seed, 61), "label": (F.col("id") % 4).cast("int")})
        pick = lambda *v: F.when(F.col("label") == 0, v[0]).when(F.col("label") == 1, v[1]).when(F.col("label") == 2, v[2]).otherwise(v[3])
        noise = F.when(F.col("label") < 2, 0.1).otherwise(0.05)
        c, s, c2, s2 = F.cos("_t"), F.sin("_t"), F.cos(2 * F.col("_t")), F.sin(2 * F.col("_t"))
        return t.select("id", (pick(c, 1 - c, c2, 0.5 * c2) + noise * _z(seed, 63)).alias("x"), (pick(s, 0.5 - s, s2, 0.5 * s2) + noise * _z(seed, 64)).alias("y"), "label")
    blobs = {  # shape, as (label, share, centre x, centre y, deviation) of its blobs; what is left of the points is the shape itself, with label 0
        "face": ((1, 1 / 6, 0.3, 0.3, 0.05), (2, 1 / 6, -0.3, 0.3, 0.05), (3, 1 / 6, 0.0, -0.4, 0.08)),
        "bowl": ((1, 1 / 7, 2.0, 0.0, 0.1), (2, 1 / 7, 3.0, 0.0, 0.1)),
    }
    if kind in blobs:
        t = rows.withColumns({"_s": _u(seed, 60), "_t": _u(seed, 61)})
        at, label, x, y = 0.0, F.lit(0), None, None
        if kind == "face":  # two circles, the inner one of 0.6
            r = F.when(_u(seed, 65) < 0.5, 1.0).otherwise(0.6)
            x, y = r * F.cos(2 * math.pi * F.col("_t")) + 0.05 * _z(seed, 62), r * F.sin(2 * math.pi * F.col("_t")) + 0.05 * _z(seed, 63)
        else:
            x, y = 4 * F.col("_t"), F.pow(4 * F.col("_t"), 2) / 8 + 0.05 * _z(seed, 62)
        for n, share, cx, cy, spread in blobs[kind]:
            inside = (F.col("_s") > at) & (F.col("_s") <= at + share)
            label, x, y, at = F.when(inside, n).otherwise(label), F.when(inside, cx + spread * _z(seed, 66)).otherwise(x), F.when(inside, cy + spread * _z(seed, 67)).otherwise(y), at + share
        return t.select("id", x.alias("x"), y.alias("y"), label.alias("label"))
    if kind == "two_arms":  # one turn, the second arm opposite the first
        t = rows.withColumns({"_t": 2 * math.pi * F.sqrt(_u(seed, 61)), "label": (F.col("id") % 2).cast("int")})
        sign = 1 - 2 * F.col("label")
        return t.select("id", (sign * F.col("_t") * F.cos("_t") + 0.2 * _z(seed, 62)).alias("x"), (sign * F.col("_t") * F.sin("_t") + 0.2 * _z(seed, 63)).alias("y"), "label")
    if kind == "nested_blocks":  # the unit square with two full blocks inside, a seventh of the points each
        part = F.least(F.floor(7 * _u(seed, 60)), F.lit(6))
        t = rows.withColumn("label", F.when(part == 5, 1).when(part == 6, 2).otherwise(0))
        low, side = F.when(F.col("label") == 1, 0.3).when(F.col("label") == 2, 0.55).otherwise(0.0), F.when(F.col("label") == 0, 1.0).otherwise(0.15)
        return t.select("id", (low + side * _u(seed, 61)).alias("x"), (low + side * _u(seed, 62)).alias("y"), "label")
    if kind == "smile":
        t = rows.withColumns({"_t": _u(seed, 61), "label": (F.col("id") % 3).cast("int")})
        mouth = F.col("label") == 2
        return t.select("id", F.when(mouth, F.col("_t") * 2 - 1).otherwise(F.when(F.col("label") == 0, -0.5).otherwise(0.5) + 0.1 * _z(seed, 62)).alias("x"), F.when(mouth, F.pow(F.col("_t") * 2 - 1, 2) - 1).otherwise(0.5 + 0.1 * _z(seed, 63)).alias("y"), "label")
    if kind == "spiral":
        t = rows.withColumns({"_t": 4 * math.pi * F.sqrt(_u(seed, 61)), "label": (F.col("id") % 2).cast("int")})
        turn = F.col("_t") + F.col("label") * math.pi
        return t.select("id", (F.col("_t") * F.cos(turn) + 0.1 * _z(seed, 62)).alias("x"), (F.col("_t") * F.sin(turn) + 0.1 * _z(seed, 63)).alias("y"), "label")
    if kind == "parabola":
        t = rows.withColumns({"_t": 2 * _u(seed, 61) - 1, "label": (F.col("id") % 2).cast("int")})
        return t.select("id", (F.col("_t") + F.col("label")).alias("x"), (F.when(F.col("label") == 0, F.pow("_t", 2)).otherwise(1 - F.pow("_t", 2)) + 0.05 * _z(seed, 62)).alias("y"), "label")
    if kind == "squares":
        t = rows.withColumns({"_t": 4 * _u(seed, 61), "label": (F.col("id") % 3).cast("int")})
        side, f, r = F.floor("_t"), F.col("_t") - F.floor("_t"), F.col("label") + 1.0
        x = F.when(side == 0, f * 2 - 1).when(side == 1, 1.0).when(side == 2, 1 - f * 2).otherwise(-1.0)
        y = F.when(side == 0, -1.0).when(side == 1, f * 2 - 1).when(side == 2, 1.0).otherwise(1 - f * 2)
        return t.select("id", (x * r).alias("x"), (y * r).alias("y"), "label")
    return rows.select("id", _value(kind, seed, 0).alias("x"), _value(kind, seed, 1).alias("y"), F.lit(0).alias("label"))


def mixture(spark: SparkSession, n: int, modes: int, spread: float, seed: int = 0, uniform_share: float = 0.0) -> DataFrame:
    """id, x, y, label: Gaussian modes at hashed places of the unit square, drawn again outside it, and a share of uniform points (label -1)."""
    place = lambda salt: uniform(seed * 2 + salt, "label")
    rows = spark.range(n).withColumn("label", F.when(_u(seed, 71) < uniform_share, -1).otherwise(F.floor(_u(seed, 72) * modes)).cast("int"))
    rows = rows.withColumns({"_p0": place(0), "_p1": place(1)})
    at = lambda k: F.when(F.col("label") < 0, _u(seed, 73 + k)).otherwise(truncated(lambda t: F.col(f"_p{k}") + spread * _z(seed, 75 + k + 100 * t), 0.0, 1.0, _u(seed, 73 + k)))
    return rows.select("id", at(0).alias("x"), at(1).alias("y"), "label")


def instances(spark: SparkSession, count: int, nodes: int, seed: int = 0) -> DataFrame:
    """sample, i, x, y: many small instances, each with its own mixture of modes and spreads by sample % 10; node 0 is uniform."""
    rows = spark.range(count * nodes).select("id", F.floor(F.col("id") / nodes).alias("sample"), (F.col("id") % nodes).cast("int").alias("i"))
    rows = rows.withColumn("_m", F.floor(_u(seed, 81) * (1 + F.col("sample") % 10)))
    rows = rows.withColumns({f"_p{k}": uniform(seed * 2 + k, "sample", "_m") for k in (0, 1)})
    at = lambda k: F.when(F.col("i") == 0, _u(seed, 83 + k)).otherwise(truncated(lambda t: F.col(f"_p{k}") + (F.col("sample") % 10 + 1) / 100 * _z(seed, 85 + k + 100 * t), 0.0, 1.0, _u(seed, 83 + k)))
    return rows.select("sample", "i", at(0).alias("x"), at(1).alias("y"))


def clustered(spark: SparkSession, count: int, nodes: int, centres: int, spread: float, seed: int = 0, mixed: bool = False, centre_depot: bool = False) -> DataFrame:
    """sample, i, x, y, label of instances in the unit square: node 0 is the depot (label -2), nodes 1 to `centres` are centres within 0.2..0.8 (labels from 0), then, if
    mixed, half of the others are uniform (label -1), and the rest lie around a centre with normal deviation, both coordinates drawn again together outside the square.

    The depot is the mean of the others, or uniform in their bounds widened by 0.1 within the square. A node that eight draws leave outside lies on its centre."""
    if centres >= nodes:
        raise ValueError("an instance needs more nodes than centres")
    rows = spark.range(count * nodes).select("id", F.floor(F.col("id") / nodes).alias("sample"), (F.col("id") % nodes + 1).cast("int").alias("i"))
    even = (nodes - centres) // 2 if mixed else 0
    label = F.when(F.col("i") <= centres, F.col("i") - 1).when(F.col("i") <= centres + even, -1).otherwise(F.least(F.floor(_u(seed, 91) * centres), F.lit(centres - 1)))
    rows = rows.withColumn("label", label.cast("int"))
    rows = rows.withColumns({f"_p{k}": 0.2 + 0.6 * uniform(seed * 2 + k, "sample", "label") for k in (0, 1)})
    drawn = [F.struct(*[(F.col(f"_p{k}") + spread * _z(seed, 95 + k + 100 * t)).alias(f"v{k}") for k in (0, 1)]) for t in range(8)]
    fits = lambda p: (p["v0"] >= 0) & (p["v0"] < 1) & (p["v1"] >= 0) & (p["v1"] < 1)
    rows = rows.withColumn("_d", F.coalesce(*[F.when(fits(p), p) for p in drawn], F.struct(F.col("_p0").alias("v0"), F.col("_p1").alias("v1"))))
    at = lambda k: F.when(F.col("i") <= centres, F.col(f"_p{k}")).when(F.col("label") < 0, _u(seed, 93 + k)).otherwise(F.col(f"_d.v{k}"))
    stops = rows.select("sample", "i", at(0).alias("x"), at(1).alias("y"), "label")
    box = stops.groupBy("sample").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    low, high = (lambda c: F.greatest(F.col(f"lo_{c}") - 0.1, F.lit(0.0))), (lambda c: F.least(F.col(f"hi_{c}") + 0.1, F.lit(1.0)))
    place = lambda k, c: F.col(f"mean_{c}") if centre_depot else low(c) + (high(c) - low(c)) * uniform(seed * 2 + k, "sample")
    return stops.unionByName(box.select("sample", F.lit(0).alias("i"), place(0, "x").alias("x"), place(1, "y").alias("y"), F.lit(-2).alias("label")))


def curriculum(spark: SparkSession, count: int, nodes: int, seed: int = 0) -> DataFrame:
    """sample, i, x, y, label of instances of CURRICULUM by sample % 10: modes of unit deviation in a square of the pair's side, scaled to 0..1 in each instance;
    without modes, uniform points (label -1). Node 0 is the depot, drawn as the others are."""
    step = (F.col("sample") % len(CURRICULUM) + 1).cast("int")
    rows = spark.range(count * nodes).select("id", F.floor(F.col("id") / nodes).alias("sample"), (F.col("id") % nodes).cast("int").alias("i"))
    rows = rows.withColumns({n: F.element_at(F.array(*[F.lit(c[k]) for c in CURRICULUM]), step) for k, n in enumerate(("_modes", "_side"))})
    rows = rows.withColumn("label", F.when(F.col("_modes") == 0, -1).otherwise(F.least(F.floor(_u(seed, 101) * F.col("_modes")), F.col("_modes") - 1)).cast("int"))
    at = lambda k: F.when(F.col("label") < 0, _u(seed, 103 + k)).otherwise(F.col("_side") * uniform(seed * 2 + k, "sample", "label") + _z(seed, 105 + k))
    rows = rows.select("sample", "i", at(0).alias("x"), at(1).alias("y"), "label")
    box = rows.groupBy("sample").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.when(F.col("label") < 0, F.col(c)).when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    return rows.join(box, "sample").select("sample", "i", scaled("x").alias("x"), scaled("y").alias("y"), "label")


def tours(spark: SparkSession, count: int, nodes: int, seed: int = 0) -> DataFrame:
    """sample, i, x, y: instances of uniform places in the unit square for round trips, drawn by sample, node and seed."""
    rows = spark.range(count * nodes).select(F.floor(F.col("id") / nodes).alias("sample"), (F.col("id") % nodes).cast("int").alias("i"))
    return rows.withColumns({"x": uniform(2 * seed, "sample", "i"), "y": uniform(2 * seed + 1, "sample", "i")})
