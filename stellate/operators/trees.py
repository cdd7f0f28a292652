"""Encoding trees of weighted graphs, and structural entropy.

Measures over a given tree (tree_nodes: graph_id, node_id, parent_id, height, vol, g; members: graph_id, node_id,
point_id) are joins and sums. Building a tree is greedy and sequential, so encoding_trees() runs for one bounded graph in one group, and graphs in
parallel; division.joined_trees() makes trees of graphs of any size from those of bounded groups."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .neighbors import gap_adjacency
from .sampling import numbered


def volumes(edges: DataFrame) -> DataFrame:
    """i, vol, g of each node of edges (i, j, w; both ways): all weight, and the weight but for loops."""
    return edges.groupBy("i").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("i") != F.col("j"), F.col("w")).otherwise(0.0)).alias("g"))


def cut_volumes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b, cut: the weight between each two parts (point_id, part) that share an edge, a < b."""
    a, b = parts.select(F.col("point_id").alias("i"), F.col("part").alias("a")), parts.select(F.col("point_id").alias("j"), F.col("part").alias("b"))
    return edges.join(a, "i").join(b, "j").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("cut"))


def part_volumes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, vol, g: all weight of a part's nodes, and that which leaves it."""
    a, b = parts.select(F.col("point_id").alias("i"), F.col("part").alias("a")), parts.select(F.col("point_id").alias("j"), F.col("part").alias("b"))
    return edges.join(a, "i").join(b, "j").groupBy(F.col("a").alias("part")).agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("g"))


def partition_entropy(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """entropy of the tree root, parts, points: -sum of g / VOL * log2(vol / vol of the parent) over all nodes but the root."""
    total = edges.agg(F.sum("w").alias("total"))
    part = part_volumes(edges, parts)
    upper = part.join(total).agg(F.sum(-F.col("g") / F.col("total") * F.log2(F.col("vol") / F.col("total"))).alias("upper"))
    leaves = volumes(edges).join(parts.select(F.col("point_id").alias("i"), "part"), "i").join(part.select("part", F.col("vol").alias("vol_p")), "part")
    lower = leaves.join(total).agg(F.sum(-F.col("g") / F.col("total") * F.log2(F.col("vol") / F.col("vol_p"))).alias("lower"))
    return upper.join(lower).select((F.col("upper") + F.col("lower")).alias("entropy"))


def point_level_entropy(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """point_id, e1 (its own node's), e2 (its part's) in the tree root, parts, points."""
    total = edges.agg(F.sum("w").alias("total"))
    part = part_volumes(edges, parts).select("part", F.col("vol").alias("vol_p"), F.col("g").alias("g_p"))
    leaves = volumes(edges).join(parts.select(F.col("point_id").alias("i"), "part"), "i").join(part, "part").join(total)
    own = -F.col("g") / F.col("total") * F.log2(F.col("vol") / F.col("vol_p"))
    return leaves.select(F.col("i").alias("point_id"), own.alias("e1"), (-F.col("g_p") / F.col("total") * F.log2(F.col("vol_p") / F.col("total"))).alias("e2"))


def tree_entropy(tree: DataFrame) -> DataFrame:
    """graph_id, entropy of each tree in tree_nodes; the root adds nothing."""
    up = tree.select("graph_id", F.col("node_id").alias("parent_id"), F.col("vol").alias("vol_p"))
    total = tree.where("parent_id is null").select("graph_id", F.col("vol").alias("total"))
    return tree.join(up, ["graph_id", "parent_id"]).join(total, "graph_id").groupBy("graph_id").agg(F.sum(-F.col("g") / F.col("total") * F.log2(F.col("vol") / F.col("vol_p"))).alias("entropy"))


def combine_delta(v1: Column, g1: Column, v2: Column, g2: Column, cut: Column, total: Column) -> Column:
    """Change of entropy when two children of the root are put under a new node."""
    both = v1 + v2
    return ((v1 - g1) * F.log2(both / v1) + (v2 - g2) * F.log2(both / v2) - 2 * cut * F.log2(total / both)) / total


def compress_delta(child_cut: Column, vol: Column, parent_vol: Column) -> Column:
    """Change (in natural logs) when a node's children go to its parent."""
    return child_cut * F.log(parent_vol / vol)


def build(edges: list[tuple[int, int, float]], points: list[int], depth: int, extra: dict[int, float] | None = None) -> list[dict]:
    """The tree of one graph: nodes with id, parent, height, vol, g and, of leaves, the point.

    Children of the root are merged in the order of combine_delta until none share an edge; then nodes give their
    children to their parents in the order of compress_delta until the tree is no deeper than depth; at last shallow leaves get
    parents of one child. Ties go to the smaller ids, so that the tree is fixed by its graph. Where the two weights of an edge differ, the
    cut between its ends is their mean. extra: weight that leaves for elsewhere, which counts in a node's volume and boundary."""
    n, tiny = len(points), 1e-15
    at = {p: k for k, p in enumerate(points)}
    near: dict[int, dict[int, float]] = defaultdict(dict)
    vol, g = [tiny] * n, [0.0] * n
    halves: dict[tuple[int, int], float] = defaultdict(float)
    for i, j, w in edges:
        vol[at[i]] += w
        if i != j:
            g[at[i]] += w
            halves[min(at[i], at[j]), max(at[i], at[j])] += w / 2
    for (a, b), w in halves.items():
        near[a][b] = near[b][a] = w
    for p, w in (extra or {}).items():
        vol[at[p]] += w
        g[at[p]] += w
    total = sum(vol) or tiny
    parent: list[int | None] = [None] * n
    children: list[list[int]] = [[] for _ in range(n)]
    inner_cut = [0.0] * n

    def delta(a: int, b: int, cut: float) -> float:
        v1, v2 = vol[a], vol[b]
        both = v1 + v2
        return ((v1 - g[a]) * math.log2(both / v1) + (v2 - g[b]) * math.log2(both / v2) - 2 * cut * math.log2(max(total / both, tiny))) / total

    def add(kids: list[int], v: float, own_g: float, cut: float) -> int:
        new = len(vol)
        vol.append(v)
        g.append(own_g)
        parent.append(None)
        children.append(kids)
        inner_cut.append(cut)
        for c in kids:
            parent[c] = new
        return new

    heap = [(delta(a, b, w), a, b, w) for a in list(near) for b, w in near[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        _, a, b, cut = heapq.heappop(heap)
        if parent[a] is not None or parent[b] is not None:
            continue
        new = add([a, b], vol[a] + vol[b], g[a] + g[b] - 2 * cut, cut)
        for c in (a, b):
            for other, w in near.pop(c).items():
                if other != a and other != b:
                    near[new][other] = near[new].get(other, 0.0) + w
                    del near[other][c]
        for other, w in near[new].items():
            near[other][new] = w
            heapq.heappush(heap, (delta(other, new, w), other, new, w))
    top = [k for k in range(len(vol)) if parent[k] is None]
    root = top[0] if len(top) == 1 and children[top[0]] else add(top, total, sum(g[k] for k in top), 0.0)

    def height(k: int) -> int:
        return 1 + max(map(heights.__getitem__, children[k])) if children[k] else 0

    heights: dict[int, int] = {}
    for k in range(len(vol)):  # children were made before their parents
        heights[k] = height(k)
    gone: set[int] = set()
    order = [(inner_cut[k] * math.log(max(vol[parent[k]] / vol[k], 1.0)), k) for k in range(n, len(vol)) if parent[k] is not None]
    heapq.heapify(order)
    depths: dict[int, int] = {}

    def depth_of(k: int) -> int:
        d = 0
        while parent[k] is not None:
            k, d = parent[k], d + 1
        return d

    while heights[root] > depth and order:
        cost, k = heapq.heappop(order)
        if k in gone or cost != inner_cut[k] * math.log(max(vol[parent[k]] / vol[k], 1.0)):
            continue  # its parent went, and a later entry has the cost that holds now
        if depth_of(k) + heights[k] <= depth:
            continue
        up = parent[k]
        gone.add(k)
        children[up] = [c for c in children[up] if c != k] + children[k]
        inner_cut[up] += inner_cut[k]
        for c in children[k]:
            parent[c] = up
            if children[c]:
                heapq.heappush(order, (inner_cut[c] * math.log(max(vol[up] / vol[c], 1.0)), c))
        if parent[up] is not None:
            heapq.heappush(order, (inner_cut[up] * math.log(max(vol[parent[up]] / vol[up], 1.0)), up))
        while up is not None and heights[up] != (now := height(up)):
            heights[up], up = now, parent[up]
    for leaf in range(n):
        d = depth_of(leaf)
        while d < depth:
            up, top_of = parent[leaf], leaf
            new = add([], vol[top_of], g[top_of], 0.0)
            children[up][children[up].index(top_of)] = new
            parent[new], parent[top_of], children[new] = up, new, [top_of]
            d += 1
    depths[root] = 0
    todo, out = [root], []
    while todo:
        k = todo.pop()
        out.append({"node_id": k, "parent_id": parent[k], "height": depth - depths[k], "vol": vol[k], "g": g[k], "point_id": points[k] if k < n else None})
        for c in children[k]:
            depths[c] = depths[k] + 1
            todo.append(c)
    return out


TREE = "graph_id long, node_id long, parent_id long, height int, vol double, g double, point_id long"


def encoding_trees(edges: DataFrame, depth: int) -> DataFrame:
    """tree_nodes (with the point of each leaf) of every graph in edges (graph_id, i, j, w; both ways)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = build(list(zip(frame["i"], frame["j"], frame["w"], strict=True)), sorted(set(frame["i"]) | set(frame["j"])), depth)
        out = pd.DataFrame(nodes).assign(graph_id=frame["graph_id"].iloc[0])
        return out.astype({"parent_id": "Int64", "point_id": "Int64"})[[c.split()[0] for c in TREE.split(", ")]]

    return edges.groupBy("graph_id").applyInPandas(one, TREE)


def renumbered(tree: DataFrame) -> DataFrame:
    """tree with heights counted from the leaves up, and node ids from 0 in each graph by (height, old id).

    A node's height is one more than its highest child's. One join a level; numbers are made by ranges, so a large tree needn't fit in one task."""
    nodes = written(tree.select("graph_id", "node_id", "parent_id"), "nodes")
    inner = nodes.where("parent_id is not null").select("graph_id", F.col("parent_id").alias("node_id")).distinct()
    at = written(nodes.join(inner, ["graph_id", "node_id"], "left_anti"), "level")
    found, height = at.select("graph_id", "node_id", F.lit(0).alias("h")), 0
    while not at.isEmpty():
        height += 1
        at = written(nodes.join(at.where("parent_id is not null").select("graph_id", F.col("parent_id").alias("node_id")).distinct(), ["graph_id", "node_id"]), "level")
        found = found.union(at.select("graph_id", "node_id", F.lit(height).alias("h")))
    heights = found.groupBy("graph_id", "node_id").agg(F.max("h").alias("h"))
    ids = written(numbered(heights, "graph_id", "h", "node_id"), "numbers")
    ids = ids.join(ids.groupBy("graph_id").agg(F.min("n").alias("_least")), "graph_id").select("graph_id", "node_id", "h", (F.col("n") - F.col("_least")).alias("n"))
    up = ids.select("graph_id", F.col("node_id").alias("parent_id"), F.col("n").alias("_up"))
    rows = tree.join(ids, ["graph_id", "node_id"]).join(up, ["graph_id", "parent_id"], "left")
    return rows.withColumns({"node_id": F.col("n"), "parent_id": F.col("_up"), "height": F.col("h")}).select(*tree.columns)


def level_order(tree: DataFrame) -> DataFrame:
    """graph_id, node_id, level (0 at the root), pos: breadth first, children by their parents' order and then by id. One join a level."""
    nodes = written(tree.select("graph_id", "node_id", "parent_id"), "nodes")
    at = nodes.where("parent_id is null").select("graph_id", "node_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"))
    out, level = None, 0
    while True:
        at = written(at, "level")
        if at.isEmpty():
            return out if out is not None else at
        out, level = at if out is None else out.union(at), level + 1
        below = nodes.join(at.select("graph_id", F.col("node_id").alias("parent_id"), F.col("pos").alias("_up")), ["graph_id", "parent_id"])
        ranked = written(numbered(below, "graph_id", "_up", "node_id"), "ranked")
        start = at.groupBy("graph_id").agg((F.max("pos") + 1).alias("_start")).join(ranked.groupBy("graph_id").agg(F.min("n").alias("_least")), "graph_id")
        at = ranked.join(start, "graph_id").select("graph_id", "node_id", F.lit(level).alias("level"), (F.col("n") - F.col("_least") + F.col("_start")).alias("pos"))


def weighted_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """edges (i, j, w) with each weight times that of its first node (id, weight): the graph of a weighted coreset, no longer symmetric."""
    return edges.join(weights.select(F.col("id").alias("i"), F.col("weight").alias("_w")), "i").select("i", "j", (F.col("w") * F.col("_w")).alias("w"))


def block_edges(edges: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges within blocks (graph_id, i, j, w) and between blocks (i, j, w) of edges both ways and blocks (point_id, part).

    Weight that leaves a block stays in its graph's volume, but not in any cut, as loops (i, i, w) of the nodes it leaves from."""
    a, b = blocks.select(F.col("point_id").alias("i"), F.col("part").alias("a")), blocks.select(F.col("point_id").alias("j"), F.col("part").alias("b"))
    both = edges.join(a, "i").join(b, "j")
    inner = both.where("a = b").select(F.col("a").alias("graph_id"), "i", "j", "w")
    extra = both.where("a <> b").groupBy(F.col("a").alias("graph_id"), "i").agg(F.sum("w").alias("w")).select("graph_id", "i", F.col("i").alias("j"), "w")
    return inner.unionByName(extra), both.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("w"))


def level_entropy(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """graph_id, point_id, level (of the parent, from 1 to depth or the root), entropy of each leaf's ancestors below the root; one join a level."""
    up = tree.select("graph_id", F.col("node_id").alias("parent_id"), F.col("vol").alias("vol_p"))
    total = tree.where("parent_id is null").select("graph_id", F.col("vol").alias("total"))
    own = written(tree.join(up, ["graph_id", "parent_id"]).join(total, "graph_id").select("graph_id", "node_id", "parent_id", (-F.col("g") / F.col("total") * F.log2(F.col("vol") / F.col("vol_p"))).alias("entropy")), "own")
    at = tree.where("point_id is not null").select("graph_id", "point_id", "node_id")
    out, level = None, 0
    while True:
        level += 1
        at = written(at.join(own, ["graph_id", "node_id"]), "ancestors")
        one = at.select("graph_id", "point_id", F.lit(level).alias("level"), "entropy")
        out = one if out is None else out.union(one)
        if level == depth or at.isEmpty():
            return out
        at = at.select("graph_id", "point_id", F.col("parent_id").alias("node_id"))


def graph_edges(points: DataFrame, ne: int = 5, gap: float = 0.2, by: str | None = None) -> DataFrame:
    """i, j, w: the gap adjacency (within groups of the column by) with a threshold of gap times the deviation of all coordinates."""
    both = points.select(F.explode(F.array("x", "y")).alias("v"))
    return gap_adjacency(points, ne, gap * (both.agg(F.stddev_pop("v")).first()[0] or 0.0), by)


def as_vectors(points: DataFrame) -> DataFrame:
    """graph_id (0 if there is none), id, v of points (id, x, y)."""
    graph = F.col("graph_id") if "graph_id" in points.columns else F.lit(0)
    return points.select(graph.cast("long").alias("graph_id"), "id", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("v"))


def structural_entropy(points: DataFrame, ne: int = 5, gap: float = 0.2, depth: int = 3, threshold: float | None = None, block: int | None = None) -> DataFrame:
    """graph_id, id, score: the sum over levels of each point's entropy; one tree for each graph_id of points, divided where it is large.

    threshold: the gap itself, in place of gap times the deviation of all coordinates."""
    from .division import BLOCK, joined_trees

    rows = as_vectors(points)
    points = points.withColumn("graph_id", F.lit(0).cast("long")) if "graph_id" not in points.columns else points
    adjacent = graph_edges(points, ne, gap, "graph_id") if threshold is None else gap_adjacency(points, ne, threshold, "graph_id")
    edges = adjacent.join(points.select("graph_id", F.col("id").alias("i")), "i")
    tree = written(joined_trees(rows, edges, depth, block or BLOCK), "tree")
    return level_entropy(tree).groupBy("graph_id", F.col("point_id").alias("id")).agg(F.sum("entropy").alias("score"))


def up_dimension(points: DataFrame, k: int, ne: int = 5, gap: float = 0.2, depth: int = 3, block: int | None = None) -> DataFrame:
    """id, x, y, z: the points with their structural entropy as a third coordinate, all scaled to 0..1.

    The gap is in units of the root of the mean squared distance to the nearest of k k-means centres."""
    from .centres import k_means
    from .scaling import min_max

    _, model = k_means(points, ["x", "y"], k)
    threshold = gap * math.sqrt(model.summary.trainingCost / max(1, points.count()))
    score = structural_entropy(points, ne, gap, depth, threshold, block).select("id", F.col("score").alias("z"))
    return min_max(written(points.join(score, "id").select("id", "x", "y", "z"), "dimension"), ["x", "y", "z"])


def outlier_scores(levels: DataFrame) -> DataFrame:
    """graph_id, point_id, score: the entropy of the highest level where it exceeds 1e-9, 1 if none, scaled to 0..1 in each graph."""
    found = levels.groupBy("graph_id", "point_id").agg(F.coalesce(F.max_by("entropy", F.when(F.col("entropy") > 1e-9, F.col("level"))), F.lit(1.0)).alias("raw"))
    b = found.groupBy("graph_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return found.join(b, "graph_id").select("graph_id", "point_id", F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("score"))
