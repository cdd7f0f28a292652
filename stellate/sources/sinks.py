"""Writers. Large results go to partitioned Parquet; text formats of single problems are made in order, a problem a row."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph_network import Layer


def write_graph_features(nodes: DataFrame, edges: DataFrame, path: str, by: list[str]) -> None:
    """Nodes and edges of graph samples, partitioned by columns that both have."""
    nodes.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/edges")


def write_scores(scores: DataFrame, path: str, column: str = "score") -> None:
    """One number of four decimals on each line."""
    scores.select(F.format_string("%.4f", F.col(column))).write.mode("overwrite").text(path)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").csv(path, header=True)


def problem_text(name: Column | str, capacity: Column | str, stops: Column | str, scale: float = 1e4, kind: str = "CVRP", service: Column | float = 0.0) -> Column:
    """The text of a routing problem from an array of struct(node, x, y, demand), coordinates rounded to whole numbers; node 0 is the depot.

    Of the kind CVRPTW the structs go on with window_start and window_end, which get a section of whole numbers in the same scale, as the service time gets a line; of
    VRPMPD they go on with is_pickup (0 or 1), and a section tells what is picked up and what is delivered in place of the demand. Null demands count as 0."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    ordered = F.array_sort(col(stops))
    whole = lambda v: F.floor(v * scale + 0.5).cast("long").cast("string")
    text = lambda v: F.coalesce(v, F.lit(0)).cast("string")
    section = lambda title, *values: F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(ordered, lambda s: F.concat_ws(" ", (s["node"] + 1).cast("string"), *[v(s) for v in values])), "\n"))
    zero = lambda s: F.lit("0")
    lines = [F.lit("NAME : "), col(name), F.lit(f"\nTYPE : {kind}\nDIMENSION : "), F.size(ordered).cast("string"), F.lit("\nEDGE_WEIGHT_TYPE : EUC_2D\nCAPACITY : "), col(capacity).cast("string")]
    if kind == "CVRPTW":
        lines += [F.lit("\nSERVICE_TIME : "), whole(service if isinstance(service, Column) else F.lit(service))]
    body = [section("NODE_COORD_SECTION", lambda s: whole(s["x"]), lambda s: whole(s["y"]))]
    if kind == "VRPMPD":  # no window: from 0 to the format's largest time, without service time
        body.append(section("PICKUP_AND_DELIVERY_SECTION", zero, zero, lambda s: F.lit("10000000"), zero, lambda s: F.when(s["is_pickup"] == 1, text(s["demand"])).otherwise("0"), lambda s: F.when(s["is_pickup"] == 1, F.lit("0")).otherwise(text(s["demand"]))))
    else:
        body.append(section("DEMAND_SECTION", lambda s: text(s["demand"])))
    if kind == "CVRPTW":
        body.append(section("TIME_WINDOW_SECTION", lambda s: whole(s["window_start"]), lambda s: whole(s["window_end"])))
    return F.concat(*lines, *body, F.lit("\nDEPOT_SECTION\n1\n-1\nEOF"))


def write_problems(problems: DataFrame, path: str, kind: str = "CVRP") -> None:
    """One text file part for each task, a problem (name, capacity, stops) after the other."""
    problems.select(problem_text("name", "capacity", "stops", kind=kind).alias("value")).write.mode("overwrite").text(path)


def write_search_log(transitions: DataFrame, actions: DataFrame, results: DataFrame, path: str) -> None:
    """A search's transitions (problem, action, next), actions (seq, problem, action, result) and results (result, distance, nodes) in narrow types."""
    narrow = lambda df, cols: df.select([F.col(c).cast("int") for c in cols])
    narrow(transitions, ["problem", "action", "next"]).write.mode("overwrite").parquet(f"{path}/transitions")
    narrow(actions, ["seq", "problem", "action", "result"]).write.mode("overwrite").parquet(f"{path}/actions")
    results.select(F.col("result").cast("int"), F.col("distance").cast("float"), F.col("nodes").cast("array<int>")).write.mode("overwrite").parquet(f"{path}/results")


def parameter_text(values: dict[str, Column | str]) -> Column:
    """The text of a solver's parameter file, a line `NAME = value` for each entry."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name} = "), v if isinstance(v, Column) else F.lit(v)) for name, v in values.items()])


def tour_text(name: Column, nodes: Column) -> Column:
    """The text of a tour file: nodes from 0 become numbers from 1, closed by -1."""
    numbers = F.array_join(F.transform(nodes, lambda n: (n + 1).cast("string")), "\n")
    return F.concat(F.lit("NAME : "), name, F.lit("\nTYPE : TOUR\nDIMENSION : "), F.size(nodes).cast("string"), F.lit("\nTOUR_SECTION\n"), numbers, F.lit("\n-1\nEOF"))


def routes_text(routes: Column, cost: Column) -> Column:
    """`Route #i: a b c` lines of an array of arrays, and the cost."""
    lines = F.transform(routes, lambda r, n: F.concat(F.lit("Route #"), (n + 1).cast("string"), F.lit(": "), F.array_join(F.transform(r, lambda v: v.cast("string")), " ")))
    return F.concat(F.array_join(lines, "\n"), F.lit("\nCost "), cost.cast("string"))


def write_weights(spark: SparkSession, layers: list[Layer], placeholder: list[float], path: str) -> None:
    """A graph network's weights as rows (layer, part, values)."""
    rows = [(n, f.name, getattr(layer, f.name)) for n, layer in enumerate(layers) for f in fields(layer)]
    spark.createDataFrame([*rows, (-1, "placeholder", [placeholder])], "layer int, part string, values array<array<double>>").coalesce(1).write.mode("overwrite").parquet(path)
