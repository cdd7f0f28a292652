"""Coreset summaries, and outlier scores of points by the encoding tree of their summary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from . import spaces
from .division import BLOCK, joined_trees
from .draws import uniform
from .neighbors import symmetric
from .order import kth
from .scaling import standard
from .trees import as_vectors, level_entropy, outlier_scores


def coreset_vectors(points: DataFrame, z: int, alpha: float = 1.0, beta: float = 0.4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, v, round, weight) of representatives, and (id, rep_id) of all points (id, v: any number of dimensions).

    While more than z points are left, a round takes max(1, floor(alpha * ln n)) of them, those of the smallest hash of id, seed and
    round, and removes the points whose nearest representative (ties to the smaller id) lies within the distance that a share beta of them keeps to.
    What is left represents itself. Representatives of a round are few, so a round is one pass over what is left."""
    left = written(points.select("id", "v"), "coreset")
    reps, members, turn = None, None, 0
    while (n := left.count()) > max(z, 1):
        m = max(1, int(alpha * math.log(n)))
        chosen = sorted(left.orderBy(uniform(seed * 1_009 + turn, "id"), "id").limit(m).collect(), key=lambda r: r.id)  # about ln n rows
        near = written(spaces.nearest_centre(left, [(r.id, r.v) for r in chosen]).select("id", F.col("centre").alias("rep_id"), "d1"), "near")
        radius = kth(near, "d1", math.ceil((n - 1) * beta))
        covered = written(near.where(F.col("d1") <= radius + 1e-12).select("id", "rep_id"), "covered")
        counts = covered.groupBy("rep_id").agg(F.count(F.lit(1)).alias("weight"))
        part = written(left.join(counts, left["id"] == counts["rep_id"]).select("id", "v", F.lit(turn).alias("round"), "weight"), "reps")
        reps = part if reps is None else reps.union(part)
        members = covered if members is None else members.union(covered)
        before, left = left, written(left.join(covered, "id", "left_anti"), "coreset")
        discard(before, near)
        turn += 1
    own = left.select("id", "v", F.lit(turn).alias("round"), F.lit(1).cast("long").alias("weight"))
    same = left.select("id", F.col("id").alias("rep_id"))
    return (own if reps is None else reps.union(own)), (same if members is None else members.union(same))


def coreset(points: DataFrame, z: int, alpha: float = 1.0, beta: float = 0.4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """coreset_vectors() of points (id, x, y), with x and y for v."""
    reps, members = coreset_vectors(as_vectors(points), z, alpha, beta, seed)
    return reps.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "round", "weight"), members


def with_noise(points: DataFrame, z: int, spread: float, seed: int = 0) -> DataFrame:
    """Standardised points with is_outlier false, and z uniform ones in [-spread, spread] with ids below 0 and is_outlier true."""
    rows = standard(points, ["x", "y"]).select("id", "x", "y", F.lit(False).alias("is_outlier"))
    u = lambda salt: (uniform(seed * 2 + salt, "id") * 2 - 1) * spread
    return rows.union(points.sparkSession.range(z).select((-F.col("id") - 1).alias("id"), u(0).alias("x"), u(1).alias("y"), F.lit(True)))


def cover_radius(points: DataFrame, k: int) -> float:
    """The largest distance of a point (id, v) to the nearest of k farthest-first centres, the first of them the point of the smallest id."""
    chosen = [points.orderBy("id").select("id", "v").first()]
    while chosen[0] is not None:
        far = spaces.nearest_centre(points.select("id", "v"), [(n, r.v) for n, r in enumerate(chosen)]).agg(F.max_by(F.struct("id", "v", "d1"), F.struct("d1", -F.col("id"))).alias("p")).first().p
        if len(chosen) >= k or far.d1 == 0:
            return far.d1
        chosen.append(far)
    return 0.0


def summary_scores(reps: DataFrame, nes: list[int], depths: list[int], gaps: list[float] | None = None, block: int = BLOCK) -> DataFrame:
    """ne, depth, gap, rep_id, score: outlier scores of representatives (id, v) for each cell of a grid.

    The k-NN table of the largest ne serves all cells: a cell's edges are those of the nearest neighbour and of further ones, up to ne,
    within its gap times the deviation of all coordinates. Without gaps, the gap is the covering radius of floor(log2 n) centres. The graphs of all (ne, gap) of a depth are
    divided and built together."""
    reps = written(reps.select("id", "v"), "reps")
    n = reps.count()
    gaps = gaps or [cover_radius(reps, max(1, int(math.log2(max(2, n)))))]
    deviation = reps.select(F.explode("v").alias("c")).agg(F.stddev_pop("c")).first()[0] or 0.0
    knn = written(spaces.knn_graph(reps, max(nes)), "knn")
    cells = [(ne, gap) for ne in nes for gap in gaps]
    edges, rows = None, None
    for g, (ne, gap) in enumerate(cells):
        graph: Column = F.lit(g).cast("long").alias("graph_id")
        one = symmetric(knn.where((F.col("rank") == 1) | ((F.col("rank") <= ne) & (F.col("d") <= gap * deviation)))).select(graph, "i", "j", "w")
        own = reps.select(graph, "id", "v")
        edges, rows = (one, own) if edges is None else (edges.union(one), rows.union(own))
    edges, rows = written(edges, "edges"), written(rows, "graphs")
    named = F.array(*[F.struct(F.lit(ne).alias("ne"), F.lit(float(gap)).alias("gap")) for ne, gap in cells])[F.col("graph_id").cast("int")]
    out = None
    for depth in depths:
        tree = written(joined_trees(rows, edges, depth, block), "tree")
        found = outlier_scores(level_entropy(tree)).select(named["ne"].alias("ne"), F.lit(depth).alias("depth"), named["gap"].alias("gap"), F.col("point_id").alias("rep_id"), "score")
        out = found if out is None else out.union(found)
    return out


def outlier_pipeline(points: DataFrame, z: int, ne: int = 5, depth: int = 3, seed: int = 0) -> DataFrame:
    """id, score of points (id, x, y or id, v): a coreset is summarised as a graph with a gap that is its covering radius, its encoding tree scores the
    representatives, and points take the score of theirs."""
    reps, members = coreset_vectors(points if "v" in points.columns else as_vectors(points), z, seed=seed)
    return members.join(summary_scores(reps, [ne], [depth]), "rep_id").select("id", "score")


def outlier_grid(points: DataFrame, z: int, nes: list[int], depths: list[int], gaps: list[float] | None = None, top: int | None = None, positive: str = "is_outlier", seed: int = 0, block: int = BLOCK) -> DataFrame:
    """ne, depth, gap, precision, recall, f1, auc, average_precision for each cell of a grid; points: id, v and a boolean column.

    One coreset and one k-NN table serve all cells. The `top` highest scores (a tenth of the points if not given) are the predicted outliers."""
    from .metrics import grouped_ranking

    reps, members = coreset_vectors(points, z, seed=seed)
    scores = written(summary_scores(reps, nes, depths, gaps, block), "scores")
    members = written(members, "members")
    top = top or max(1, int(members.count() * 0.1))
    rows = members.join(scores, "rep_id").join(points.select("id", F.col(positive).alias("positive")), "id")
    return grouped_ranking(rows, ["ne", "depth", "gap"], top)
