"""Route statistics over stops (route, seq, node, x, y, demand): distances, features, neighbours, splits and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.storage import written
from .neighbors import nearest
from .order import quantiles


def route_distances(stops: DataFrame, depot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """route, distance: the legs of each route in order, from the depot and back to it."""
    w = Window.partitionBy("route").orderBy("seq")
    leg = lambda x, y: F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    rows = stops.withColumns({"px": F.lag("x", 1, depot[0]).over(w), "py": F.lag("y", 1, depot[1]).over(w), "last": F.lead("seq").over(w).isNull()})
    return rows.groupBy("route").agg(F.sum(leg(F.col("px"), F.col("py")) + F.when(F.col("last"), leg(F.lit(depot[0]), F.lit(depot[1]))).otherwise(0.0)).alias("distance"))


def route_features(stops: DataFrame, capacity: float, depot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Of each route its centroid, its largest and smallest coordinates less the depot, its size and demand over the capacity, and its distance."""
    a, b = depot
    stats = stops.groupBy("route").agg((F.avg("x") - a).alias("cx"), (F.avg("y") - b).alias("cy"), (F.max("x") - a).alias("max_x"), (F.max("y") - b).alias("max_y"), (F.min("x") - a).alias("min_x"), (F.min("y") - b).alias("min_y"), (F.count(F.lit(1)) / F.lit(float(capacity))).alias("size"), (F.sum("demand") / F.lit(float(capacity))).alias("load"))
    return stats.join(route_distances(stops, depot), "route")


def node_features(nodes: DataFrame, kind: str = "CVRP", counted: bool = True) -> DataFrame:
    """problem, node, features of nodes (problem, node, x, y, demand, capacity; node 0 is the depot).

    The features are x and y less the depot's, the demand over the capacity, then of the kind CVRPTW the window (window_start,
    window_end) or of VRPMPD is_pickup, and last, if counted, how often the node was solved for (visits)."""
    extra = {"CVRP": [], "CVRPTW": ["window_start", "window_end"], "VRPMPD": ["is_pickup"]}[kind] + (["visits"] if counted else [])
    depot = nodes.where("node = 0").select("problem", F.col("x").alias("_x"), F.col("y").alias("_y"))
    v = [F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("demand") / F.col("capacity"), *map(F.col, extra)]
    return nodes.join(depot, "problem").select("problem", "node", F.array(*[c.cast("double") for c in v]).alias("features"))


def subproblem_features(stops: DataFrame, depot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Of each route: size, centroid, deviations and bounds, mean, deviation and deciles of the distance to the depot and of that to
    the centroid, mean and deviation of the demand (population deviations)."""
    centre = stops.groupBy("route").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = lambda x, y: F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    rows = stops.join(centre, "route").withColumns({"dd": d(F.lit(depot[0]), F.lit(depot[1])), "dc": d(F.col("cx"), F.col("cy"))})
    rows = written(rows.select("route", "x", "y", "cx", "cy", "dd", "dc", "demand"), "stops")
    deciles = lambda c, out: quantiles(rows, ["route"], c, {f"_{n}": n / 10 for n in range(11)}).select("route", F.array(*[f"_{n}" for n in range(11)]).alias(out))
    found = rows.groupBy("route").agg(F.count(F.lit(1)).alias("size"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.stddev_pop("x").alias("std_x"), F.stddev_pop("y").alias("std_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.avg("dd").alias("depot_mean"), F.stddev_pop("dd").alias("depot_std"), F.avg("demand").alias("demand_mean"), F.stddev_pop("demand").alias("demand_std"))
    return found.join(deciles("dd", "depot_deciles"), "route").join(deciles("dc", "centre_deciles"), "route")


def city_block(a: str, b: str, cols: list[str]) -> Column:
    """The sum of absolute differences between the columns of two aliased tables."""
    return sum((F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in cols), F.lit(0.0))


def route_centroids(stops: DataFrame) -> DataFrame:
    """id (the route), x, y, n: the mean and the number of its stops."""
    return stops.groupBy(F.col("route").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def route_neighbors(stops: DataFrame, window: list[str] | None = None, window_scale: float = 0.0) -> DataFrame:
    """route, other, rank (from 0, a route itself first): all routes by the distance of their centroids. The rows asked for are all pairs of routes (not stops).

    With time windows (two columns) and a scale, the scaled city-block distance of the routes' mean windows is added."""
    window = (window or []) if window_scale > 0 else []
    c = stops.groupBy("route").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"), *[F.avg(w).alias(f"_{w}") for w in window])
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    apart = F.sqrt(dx * dx + dy * dy) + window_scale * city_block("a", "b", [f"_{w}" for w in window])
    pairs = c.alias("a").join(c.alias("b")).select(F.col("a.route").alias("route"), F.col("b.route").alias("other"), apart.alias("d"), F.col("b.n").alias("n"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("route").orderBy("d", "other")) - 1)


def route_clusters(stops: DataFrame, nodes: int = 200) -> DataFrame:
    """route, other: the nearest routes of each one, as many as hold no more than so many nodes together."""
    c = written(route_centroids(stops), "routes")
    # a route holds one node at least, so no more than `nodes` routes are near enough
    near = nearest(c, c, nodes, "true").join(c.select(F.col("id").alias("j"), "n"), "j")
    w = Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return near.withColumn("held", F.sum("n").over(w)).where(F.col("held") <= nodes).select(F.col("i").alias("route"), F.col("j").alias("other"), (F.col("rank") - 1).alias("rank"))


def angular_split(stops: DataFrame, parts: int, anchor: float = 0.0, depot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """id, problem, part (from 0): each problem's stops in equal chunks by their clockwise angle from +y, from the anchor on."""
    angle = F.pmod(F.atan2(F.col("x") - depot[0], F.col("y") - depot[1]) - anchor, F.lit(2 * 3.141592653589793))
    return stops.withColumn("angle", angle).select("id", "problem", (F.ntile(parts).over(Window.partitionBy("problem").orderBy("angle", "id")) - 1).alias("part"))


def capacity_split(stops: DataFrame, capacity: int) -> DataFrame:
    """problem, seq, route (from 0): in order, a new route starts where the demand would exceed the capacity.

    The running reset goes once over a problem's stops in order, batch by batch, and keeps only the sum and the number of the route.
    After a null demand the sum is unknown, and no new route starts."""
    rows = stops.select("problem", "seq", "demand").repartition("problem").sortWithinPartitions("problem", "seq", "demand")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, held, route = False, None, 0, 0
        for batch in batches:
            routes = []
            for problem, demand in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or problem != last:
                    begun, last, held, route = True, problem, 0, 0
                total = None if held is None or demand is None else held + demand
                if total is not None and total > capacity:
                    total, route = demand, route + 1
                held = None if total is None else int(total)
                routes.append(route)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(routes, pa.int32())], names=["problem", "seq", "route"])

    routed = rows.mapInArrow(split, StructType([*rows.schema.fields[:2], StructField("route", IntegerType())]))
    return routed.select("problem", F.col("seq").cast("long").alias("seq"), "route")


def packed(routes: Column) -> Column:
    """Routes (array of arrays) as one array with a 0 after each."""
    return F.flatten(F.transform(routes, lambda r: F.concat(r, F.array(F.lit(0)))))


def padded(v: Column, length: Column | int, value: Column) -> Column:
    """The array v with the value behind it up to a length; a longer one stays as it is."""
    return F.concat(v, F.array_repeat(value, F.greatest(F.lit(0), length - F.size(v))))


def padded_each(df: DataFrame, col: str, value: Column) -> DataFrame:
    """df with all arrays of a column as long as the longest of them."""
    return df.join(df.agg(F.max(F.size(col)).alias("_length"))).withColumn(col, padded(F.col(col), F.col("_length"), value)).drop("_length")


def unpacked(nodes: DataFrame) -> DataFrame:
    """problem, route, nodes of zero-separated arrays (problem, packed)."""
    rows = nodes.select("problem", F.posexplode("packed").alias("pos", "node"))
    number = F.sum((F.col("node") == 0).cast("int")).over(Window.partitionBy("problem").orderBy("pos"))
    return rows.withColumn("route", number).where("node <> 0").groupBy("problem", "route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("nodes"))


def cyclic_neighbors(stops: DataFrame) -> DataFrame:
    """route, node, before, after in the cycle of each route."""
    w = Window.partitionBy("route").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return stops.select("route", "node", F.coalesce(F.lag("node").over(w), F.last("node").over(whole)).alias("before"), F.coalesce(F.lead("node").over(w), F.first("node").over(whole)).alias("after"))


def canonical_hash(routes: Column) -> Column:
    """md5 of routes that are the same up to their order and direction."""
    turned = F.transform(routes, lambda r: F.when(r[0] > F.element_at(r, -1), F.reverse(r)).otherwise(r))
    return F.md5(F.to_json(F.array_sort(turned)).cast("binary"))


def rotated(stops: DataFrame, angle: float, flip: bool = False, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """stops turned around the origin, with y mirrored after that if flip.

    Before that, stops other than the depot (node 0) are moved by normal noise of that deviation, drawn by node and seed."""
    import math

    from .sampling import uniform

    c, s = math.cos(angle), math.sin(angle)
    if noise:
        radius = F.when(F.col("node") == 0, 0.0).otherwise(noise * F.sqrt(-2 * F.log(uniform(2 * seed, "node"))))
        turn = 2 * math.pi * uniform(2 * seed + 1, "node")
        stops = stops.withColumns({"x": F.col("x") + radius * F.cos(turn), "y": F.col("y") + radius * F.sin(turn)})
    sign = -1.0 if flip else 1.0
    return stops.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": sign * (F.col("x") * s + F.col("y") * c)})


def replaced(stops: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """stops without the routes in gone (route), and with those of new."""
    return stops.join(gone, "route", "left_anti").unionByName(new)
