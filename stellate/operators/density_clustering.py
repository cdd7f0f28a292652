"""Density-based clustering by fixpoints over DataFrames: components of core points, and density peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from . import squares
from .cells import counts_within
from .neighbors import nearest, within_own
from .order import quantiles
from .sampling import numbered


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of each node's component; edges (i, j) count both ways. Contracts to smaller graphs until no edge is left."""
    labels = nodes.select("id", F.col("id").alias("root"))
    rest = written(edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct(), "edges")
    while not rest.isEmpty():
        before = labels, rest
        both = rest.union(rest.select(F.col("j").alias("i"), F.col("i").alias("j")))
        step = written(both.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("to")), "step")
        labels = written(labels.join(step, labels["root"] == step["i"], "left").select("id", F.coalesce("to", "root").alias("root")), "labels")
        moved = rest.join(step, "i").select(F.col("to").alias("a"), "j").join(step.withColumnsRenamed({"i": "j", "to": "b"}), "j")
        rest = written(moved.where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct(), "edges")
        discard(*before, step)
    discard(rest)
    return labels


def reachable_min(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the smallest id from which each node can be reached over directed edges (itself included).

    Nodes with edges both ways are contracted first. In the graph of parts each part points to the part of the smallest
    root with an edge to it, and takes the least root on the way along pointers, which double their reach every step; then all edges offer their roots
    again, until none is smaller. A chain is done in about as many steps as its length has bits."""
    edges = written(edges.where("i <> j").select("i", "j").distinct(), "edges")
    both = edges.where("i < j").join(edges.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])
    parts = written(components(nodes.select("id"), both).select("id", F.col("root").alias("part")), "parts")
    of = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"p{c}"))
    links = written(edges.join(of("i"), "i").join(of("j"), "j").where("pi <> pj").select(F.col("pi").alias("i"), F.col("pj").alias("j")).distinct(), "links")
    discard(edges)
    labels = written(parts.select(F.col("part").alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    steps = max(1, labels.count().bit_length())
    while True:
        offers = links.join(labels.select(F.col("id").alias("i"), "root"), "i").groupBy(F.col("j").alias("id")).agg(F.min(F.struct("root", "i")).alias("o"))
        moved = written(labels.join(offers, "id", "left").select("id", F.coalesce("o.i", "id").alias("to"), F.least("root", "o.root").alias("root"), (F.col("o.root") < F.col("root")).alias("less")), "pointers")
        if moved.where("less").isEmpty():
            discard(links, moved)
            return parts.join(labels.withColumnRenamed("id", "part"), "part").select("id", "root")
        at = moved.select("id", "to", "root")
        for _ in range(steps):
            ahead = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("root").alias("_root"))
            jumped = written(at.join(ahead, "to").select("id", F.col("_to").alias("to"), F.least("root", "_root").alias("root"), ((F.col("_to") != F.col("to")) | (F.col("_root") < F.col("root"))).alias("moved")), "pointers")
            discard(moved)
            moved, at = jumped, jumped.select("id", "to", "root")
            if jumped.where("moved").isEmpty():
                break
        before, labels = labels, written(at.select("id", "root"), "roots")
        discard(before, moved)


def _numbered(roots: DataFrame) -> DataFrame:
    """id, cluster: roots numbered from 0 in their order, by ranges; -1 where the root is null."""
    numbers = numbered(written(roots.where("root is not null").select("root").distinct(), "roots"), "root", out="cluster")
    return roots.join(numbers, "root", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def _rooted(cores: DataFrame, roots: DataFrame) -> DataFrame:
    """cores with the root of their square."""
    return written(cores.join(roots.select(F.col("id").alias("rep"), "root"), "rep"), "rooted")


def _symmetric_dbscan(points: DataFrame, min_samples: int) -> DataFrame:
    """points: id, x, y, r; neighbours are within both radii."""
    cores, rest = squares.cores(squares.rows_of(points), min_samples, True)
    found = _rooted(cores, components(cores.select(F.col("rep").alias("id")).distinct(), squares.near_squares(cores, True)))
    return _numbered(points.select("id").join(found.select("id", "root").union(squares.border(found, rest, True)), "id", "left"))


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, cluster (-1: noise). A border point goes to the cluster of the smallest root among its core neighbours."""
    return _symmetric_dbscan(points.select("id", "x", "y", F.lit(max(float(eps), 0.0)).alias("r")), min_samples)


def adaptive_dbscan(points: DataFrame, eps_min: float = 0.05, eps_max: float = 0.3, min_samples: int = 5) -> DataFrame:
    """dbscan() with a radius for each point, eps_max - density * (eps_max - eps_min); neighbours are within both radii."""
    return _symmetric_dbscan(points.select("id", "x", "y", (eps_max - F.col("density") * (eps_max - eps_min)).alias("r")), min_samples)


def variable_eps_dbscan(points: DataFrame, min_samples: int = 5) -> DataFrame:
    """id, cluster (-1: noise) with each point's own radius (column radius); neighbours needn't be mutual.

    Clusters start at core points in id order and take in what core points reach. A point that isn't core and was seen as noise before
    is only taken in by the start of a cluster that has it for a neighbour, not by the cluster's later points."""
    cores, rest = squares.cores(squares.rows_of(points.select("id", "x", "y", F.col("radius").alias("r"))), min_samples, False)
    found = _rooted(cores, reachable_min(cores.select(F.col("rep").alias("id")).distinct(), squares.near_squares(cores, False)))
    starts = within_own(found.where("id = root").select("id", "x", "y", "r"), "r", others=rest).groupBy(F.col("j").alias("id")).agg(F.min("i").alias("root"))
    taken = written(squares.border(found, rest, False).union(starts).groupBy("id").agg(F.min("root").alias("root")), "border")
    return _numbered(points.select("id").join(found.select("id", "root").union(taken), "id", "left"))


def density_peaks(points: DataFrame, k: int, rho: str = "rho") -> DataFrame:
    """id, rho, delta, higher, cluster: density peaks with a given density.

    Points rank by density, ties by the smaller id; delta is the distance to the nearest point of higher rank, infinite for the first.
    Centres are the points whose delta exceeds the (1 - k/n) percentile; each point takes the cluster of its next higher one, by
    pointer jumping. For k = 1 everything is one cluster."""
    rows = written(points.select("id", "x", "y", F.col(rho).alias("rho")), "rho")
    n = rows.count()
    found = written(nearest(rows, rows, 1, "c.rho > q.rho or (c.rho = q.rho and c.id < q.id)"), "higher")
    linked = rows.join(found, rows["id"] == found["i"], "left").select("id", "rho", F.coalesce("d", F.lit(float("inf"))).alias("delta"), F.col("j").alias("higher"))
    linked = written(linked, "linked")
    if k <= 1:
        return linked.withColumn("cluster", F.lit(0))
    threshold = quantiles(linked, [], "delta", {"q": 1 - k / n}).first().q
    centres = linked.where(F.col("delta") > threshold).select("id")
    up = linked.join(centres.withColumn("_c", F.lit(True)), "id", "left").select("id", F.when(F.col("_c") | F.col("higher").isNull(), F.col("id")).otherwise(F.col("higher")).alias("root"))
    pointers = up = written(up, "pointers")
    while True:
        jumped = written(up.join(up.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
        discard(pointers)
        pointers, up = jumped, jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            break
    numbers = numbered(written(centres, "centres"), "id", out="cluster").withColumn("cluster", F.col("cluster").cast("int")).withColumnRenamed("id", "root")
    return linked.join(up, "id").join(numbers, "root", "left").select("id", "rho", "delta", "higher", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def cutoff_density(points: DataFrame, cutoff: float) -> DataFrame:
    """points with rho: the other points within the cutoff, by a descent over cells and not by pairs of points."""
    counts = written(counts_within(points, [cutoff]).select("id", (F.col("n0") - 1).alias("rho")), "rho")
    return points.join(counts, "id")
