"""Encoding trees of graphs of any size: groups of nodes are divided until each is small, and their trees are joined into one.

Points (graph_id, id, v: coordinates) and edges (graph_id, i, j, w; both ways) of any number of graphs go down together, one level of division a round.
Groups of `block` points or more are cut into at most `block` clusters by k-means steps that run for all groups at once; the
clusters, with the weight between them, are the group's graph. Smaller groups are the graph of their points. Weight that leaves a group
counts in the volume and in the boundary of the nodes it leaves from, so that a node has the same volume and boundary as in the whole graph.
Each group's graph (of at most `block` nodes) becomes a tree in one task, or by sums where it gets no inner nodes; the leaves for clusters take the next round's trees as
children. No group that reaches a task exceeds `block` nodes, whatever the data.

Points at one place can't be told apart by k-means: a group that stays in one piece is cut by a hash of its ids, another one on each level."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, importable, written
from .draws import uniform
from .sampling import numbered
from .trees import build

#: Points from which a group is divided, and steps of k-means.
BLOCK, STEPS = 256, 4
#: Parts whose trees a task builds, where they are many.
PARTS = 128
#: Points whose distances to their centres a task takes, and numbers of all parts' centres that travel to every task (8 bytes each); more of them meet their points by part.
ROWS, CENTRES = 2048, 1 << 17
JOINED = "graph_id long, node_id long, parent_id long, vol double, g double, point_id long"


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def grouped_clusters(points: DataFrame, k: int, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """part, id, label: k-means clusters (at most k) within each part of points (part, id, v).

    Starts from k distinct places of each part, drawn by hash. A part's centres (k at most) travel to its points as one array."""
    d, n, parts = points.select(F.max(F.size("v")), F.count(F.lit(1)), F.count_distinct("part")).first()
    d = d or 0
    few = parts * k * d <= CENTRES
    tasks = max(1, min(n // ROWS, max(4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), n // (16 * ROWS))))
    points = points.repartition(tasks, "id" if few else "part")  # few bytes, but k distances each: Spark would put them into a task or two
    places = points.select("part", "v").distinct().withColumn("_s", F.array_join(F.col("v").cast("array<string>"), ","))
    drawn = Window.partitionBy("part").orderBy(uniform(seed, "_s"), "_s")
    centres = places.withColumn("c", F.row_number().over(drawn) - 1).where(F.col("c") < k).select("part", "c", "v")
    for step in range(steps + 1):
        held = written(centres.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("centres")), "centres")
        near = F.array_min(F.transform("centres", lambda c: F.struct(square_distance(F.col("v"), c["v"]).alias("d"), c["c"].alias("c"))))
        found = points.join(F.broadcast(held) if few else held, "part").select("part", "id", "v", near["c"].alias("label"))
        if step < steps:
            centres = found.groupBy("part", F.col("label").alias("c")).agg(F.array(*[F.avg(F.col("v")[n]) for n in range(d)]).alias("v"))
    whole = found.groupBy("part").agg((F.min("label") == F.max("label")).alias("_one"))
    label = F.when(F.col("_one"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k))).otherwise(F.col("label"))
    return found.join(whole, "part").select("part", "id", label.cast("long").alias("label"))


def part_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """part, a, b, w, leaves: the weight between labels of a part, and (leaves) that from a label to other parts.

    members: graph_id, part, id, label; edges: graph_id, i, j, w."""
    a = members.select("graph_id", F.col("id").alias("i"), F.col("part").alias("_pa"), F.col("label").alias("a"))
    b = members.select("graph_id", F.col("id").alias("j"), F.col("part").alias("_pb"), F.col("label").alias("b"))
    both = edges.join(a, ["graph_id", "i"]).join(b, ["graph_id", "j"], "left")
    leaves = F.col("_pb").isNull() | (F.col("_pb") != F.col("_pa"))
    sums = both.groupBy(F.col("_pa").alias("part"), "a", F.when(leaves, F.col("a")).otherwise(F.col("b")).alias("b"), leaves.alias("leaves"))
    return sums.agg(F.sum("w").alias("w"))


TREES = "part long, n long, up long, vol double, g double, label long"


def part_tree(rows: pa.Table, depth: int) -> pa.Table:
    """The tree of one part: its nodes from 0 (the root), breadth first, with their parent, volume, boundary and (leaves) label."""
    found = list(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "w", "leaves")), strict=True))
    labels, extra = sorted({r[0] for r in found}), {a: w for a, _, w, leaves in found if leaves}
    nodes = build([r[:3] for r in found if not r[3]], labels, depth, extra)
    below: dict = {}
    for node in nodes:
        below.setdefault(node["parent_id"], []).append(node)
    todo, out = [(None, node) for node in below[None]], []
    for up, node in todo:
        out.append((len(out), up, node["vol"], node["g"], node["point_id"]))
        todo += [(len(out) - 1, kid) for kid in below.get(node["node_id"], [])]
    part = pa.array([rows.column("part")[0].as_py()] * len(out), pa.int64())
    return pa.Table.from_arrays([part, *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["part", "n", "up", "vol", "g", "label"])


def flat_trees(graph: DataFrame) -> DataFrame:
    """TREES of parts that are a node (0) with their labels below; parts are few rows each."""
    w, outside = F.col("w"), F.when(F.col("leaves") | (F.col("a") != F.col("b")), F.col("w")).otherwise(0.0)
    labels = graph.groupBy("part", "a").agg(F.sum(w).alias("vol"), F.sum(outside).alias("g"), F.sum(F.when(F.col("leaves"), w).otherwise(0.0)).alias("_out"))
    nodes = labels.select("part", F.row_number().over(Window.partitionBy("part").orderBy("a")).cast("long").alias("n"), F.lit(0).cast("long").alias("up"), "vol", "g", F.col("a").alias("label"))
    none = F.lit(None).cast("long")
    return nodes.unionByName(labels.groupBy("part").agg(F.sum("vol").alias("vol"), F.sum("_out").alias("g")).select("part", F.lit(0).cast("long").alias("n"), none.alias("up"), "vol", "g", none.alias("label")))


def joined_trees(points: DataFrame, edges: DataFrame, depth: int, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """graph_id, node_id, parent_id, vol, g, point_id of one tree for each graph; leaves of the whole tree have a point.

    Parts of fewer than 2 ** depth points are a node with its points below; others get trees of this depth at most, for each
    level of division. A graph smaller than `block` gets the tree that trees.encoding_trees() makes of it, up to the order of ids."""
    if block < 3:
        raise ValueError("block must be 3 at least")
    spark = importable(points.sparkSession)
    edges = written(edges.select("graph_id", "i", "j", F.col("w").cast("double").alias("w")), "edges")
    todo = written(points.select("graph_id", "id", "v", F.col("graph_id").alias("part"), F.lit(None).cast("long").alias("above")), "parts")
    base, trees = 0, []
    while not todo.isEmpty():
        sizes = written(todo.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "sizes")
        whole = todo.join(sizes, "part")
        members = whole.where(F.col("size") < block).select("graph_id", "part", "id", F.col("id").alias("label"), (F.col("size") < 2**depth).alias("flat"))
        large = whole.where(F.col("size") >= block).select("graph_id", "part", "id", "v")
        divided = not sizes.where(F.col("size") >= block).isEmpty()
        if divided:
            large = written(large, "large")
            clusters = grouped_clusters(large.select("part", "id", "v"), block - 1, seed=seed + len(trees))
            members = members.unionByName(large.join(clusters, ["part", "id"]).select("graph_id", "part", "id", "label", F.lit(False).alias("flat")))
        members = written(members, "members")
        alone = members.select("part", "label").distinct().select("part", F.col("label").alias("a"), F.col("label").alias("b"), F.lit(False).alias("leaves"), F.lit(0.0).alias("w"))
        graph = part_edges(edges, members).unionByName(alone).join(members.select("part", "flat").distinct(), "part")
        graph = written(graph, "graph")
        # few bytes, but seconds of work: the number of tasks follows from the number of parts
        deep = sizes.where(F.col("size") >= 2**depth).count()
        tasks = max(1, min(deep, max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), deep // PARTS)))
        trees_of = graph.where("not flat").repartition(tasks, "part").groupBy("part").applyInArrow(lambda t: part_tree(t, depth), TREES)
        found = written(trees_of.unionByName(flat_trees(graph.where("flat"))), "found")
        ids = written(numbered(found.select("part", "n"), "part", "n", out="m"), "numbers")
        first = ids.where("n = 0").select("part", (F.col("m") + base).alias("first"))
        of = todo.groupBy("part").agg(F.first("graph_id").alias("graph_id"), F.first("above").alias("above"))
        rows = found.join(first, "part").join(of, "part")
        end = F.col("size").isNull() | (F.col("size") < block)
        rows = rows.join(sizes, "part").select("graph_id", "part", "label", (F.col("first") + F.col("n")).alias("node_id"), F.coalesce(F.col("first") + F.col("up"), F.col("above")).alias("parent_id"), "vol", "g", F.when(end, F.col("label")).alias("point_id"))
        rows = written(rows, "tree")
        trees.append(rows)
        base += ids.count()
        leaves = rows.where("label is not null and point_id is null").select("part", "label", F.col("node_id").alias("above"))
        below = large.join(members.select("graph_id", "part", "id", "label"), ["graph_id", "part", "id"]).join(leaves, ["part", "label"])
        before, todo = todo, written(below.select("graph_id", "id", "v", F.col("above").alias("part"), "above"), "parts")
        discard(before, sizes, members, graph, found, ids, large if divided else None)
    out = trees[0] if trees else points.sparkSession.createDataFrame([], f"{JOINED}, part long, label long")
    for more in trees[1:]:
        out = out.unionByName(more)
    return out.select("graph_id", "node_id", "parent_id", "vol", "g", "point_id")
