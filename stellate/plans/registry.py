"""Every registered query by name, with DuckDB SQL for the same rows where SQL can express it.

The points of most queries are the first two components of `embeddings`, scaled to 0..1, with their label as the given clustering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators
from ..operators import centres as ce
from ..operators import clusterstats as cs
from ..operators import density_clustering as dc
from ..operators import division as dv
from ..operators import feature_grid as fg
from ..operators import graph_network as gn
from ..operators import metrics as me
from ..operators import neighbors as nb
from ..operators import order as od
from ..operators import outliers as ol
from ..operators import routes as ro
from ..operators import sampling as sa
from ..operators import scaling as sc
from ..operators import scores as so
from ..operators import search as sr
from ..operators import spaces as sp
from ..operators import swaps as sw
from ..operators import trees as tr
from ..sources import points as sources
from ..sources import sinks
from .sql import ORACLE  # noqa: F401
from .storage import importable, shared_folder, written

#: Points from which the registered trees divide a group.
BLOCK = 128


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.min_max(raw_points(spark, sf_dir), ["x", "y"])


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _centres(p: DataFrame, k: int = 10) -> list[ce.Centre]:
    return ce.first_points(p, k)


def _predicted(p: DataFrame) -> DataFrame:
    """Points with label_true and label_pred, the nearest of the first ten points."""
    return nb.nearest_centre(p, _centres(p)).select("id", F.col("label").alias("label_true"), F.col("centre").alias("label_pred"))


def _ranked(p: DataFrame) -> DataFrame:
    """Points with positive (label 0) and score (their x in steps of 0.05, so that there are ties)."""
    return p.select("id", (F.col("label") == 0).alias("positive"), F.floor(F.col("x") * 20).cast("double").alias("score"))


def _graph(p: DataFrame) -> DataFrame:
    return nb.gap_adjacency(p, 5, 0.05)


def _parts(p: DataFrame) -> DataFrame:
    return p.select(F.col("id").alias("point_id"), F.col("label").alias("part"))


def _with_radius(p: DataFrame) -> DataFrame:
    return p.withColumn("radius", 0.03 + 0.005 * F.col("label"))


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("label").alias("route"), F.col("id").alias("seq"), F.col("id").alias("node"), "x", "y", (F.col("id") % 5 + 1).cast("int").alias("demand"))


def zone_histogram(s: SparkSession, d: str) -> DataFrame:
    return cs.zones(points(s, d)).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def min_max_scale(s: SparkSession, d: str) -> DataFrame:
    return r6(points(s, d), "x", "y").select("id", "x", "y")


def standard_scale(s: SparkSession, d: str) -> DataFrame:
    return r6(sc.standard(raw_points(s, d), ["x", "y"]), "x", "y").select("id", "x", "y")


def block_scale(s: SparkSession, d: str) -> DataFrame:
    return r6(sc.block_scale(raw_points(s, d), ["x", "y"]), "x", "y").select("id", "x", "y")


def guarded_log(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select("id", F.round(sc.guarded_log(F.col("x")), 6).alias("log_x"))


def softmax_by_label(s: SparkSession, d: str) -> DataFrame:
    return r6(sc.softmax(cs.to_centre(points(s, d)), "r", 0.5, "label"), "p").select("id", "p")


def knn_graph(s: SparkSession, d: str) -> DataFrame:
    return r6(nb.knn_graph(points(s, d), 5), "d").select("i", "rank", "j", "d")


def inverse_edges(s: SparkSession, d: str) -> DataFrame:
    return nb.inverse_edges(nb.knn_graph(points(s, d), 5), 5).select("i", "rank", "j", "inv_pos")


def gap_adjacency(s: SparkSession, d: str) -> DataFrame:
    return r6(_graph(points(s, d)), "w")


def k_farthest(s: SparkSession, d: str) -> DataFrame:
    return r6(nb.k_farthest(points(s, d), 3, 0.5), "w")


def range_counts(s: SparkSession, d: str) -> DataFrame:
    return nb.within(points(s, d), 0.1).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def own_range_counts(s: SparkSession, d: str) -> DataFrame:
    return nb.within_own(_with_radius(points(s, d)), "radius").groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def mutual_range_counts(s: SparkSession, d: str) -> DataFrame:
    return nb.within_own(_with_radius(points(s, d)), "radius", mutual=True).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def nearest_centre(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(nb.nearest_centre(p, _centres(p)), "d1", "d2").select("id", "centre", "d1", "d2")


def snapped_centroids(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    found = nb.snapped(p, cs.centroids(p).select(F.col("label").cast("long").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")))
    return r6(found, "d").select(F.col("i").alias("label"), "j", "d")


def nearest_higher(s: SparkSession, d: str) -> DataFrame:
    p = dc.cutoff_density(points(s, d), 0.1)
    found = nb.nearest(p, p, 1, "c.rho > q.rho or (c.rho = q.rho and c.id < q.id)")
    return r6(found, "d").select("i", "j", "d")


def centroids(s: SparkSession, d: str) -> DataFrame:
    return r6(cs.centroids(points(s, d)), "cx", "cy")


def radius_all(s: SparkSession, d: str) -> DataFrame:
    return r6(cs.radius_all(points(s, d)), "radius")


def radius_at_centre(s: SparkSession, d: str) -> DataFrame:
    return r6(cs.radius_at_centre(points(s, d)), "radius")


def size_density_diameter(s: SparkSession, d: str) -> DataFrame:
    return r6(cs.size_density_diameter(points(s, d)), "density", "diameter").select("label", "size", "density", "diameter")


def zones(s: SparkSession, d: str) -> DataFrame:
    return cs.zones(points(s, d)).select("id", "zone")


def true_zones(s: SparkSession, d: str) -> DataFrame:
    return cs.true_zones(points(s, d)).select("id", "zone")


def score_deciles(s: SparkSession, d: str) -> DataFrame:
    return sc.score_deciles(points(s, d), "x", "label").select("id", "decile")


def uniform_quantise(s: SparkSession, d: str) -> DataFrame:
    return r6(sc.quantise(points(s, d), "x", 0.0, 1.0), "level").select("id", "level")


def marked_points(s: SparkSession, d: str) -> DataFrame:
    return sc.marked(points(s, d), "x", None, 0.1).select("id", F.round("x", 6).alias("x"))


def top_per_label(s: SparkSession, d: str) -> DataFrame:
    return sc.top_per(points(s, d), "label", "x", 5).select("label", "rank", "id")


def duplicate_parts(s: SparkSession, d: str) -> DataFrame:
    parts = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return cs.duplicates(parts)


def smallest_gap(s: SparkSession, d: str) -> DataFrame:
    return cs.smallest_gap(s.read.parquet(f"{d}/customer.parquet"), "c_acctbal").select(F.round("gap", 6).alias("gap"))


def distance_quantiles(s: SparkSession, d: str) -> DataFrame:
    return r6(od.quantiles(cs.to_centre(points(s, d)), ["label"], "r", {"q30": 0.3, "q50": 0.5, "q90": 0.9}), "q30", "q50", "q90")


def density_score(s: SparkSession, d: str) -> DataFrame:
    return r6(so.density(points(s, d)), "score")


def projection_overlap(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(so.projection_overlap(p, _centres(p, 5)), "score")


def fringe_score(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(so.fringe(p, [_centres(p, k) for k in (3, 5, 10)]), "score")


def core_point_score(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(so.core_points(p, _centres(p)), "score")


def aspect_ratio(s: SparkSession, d: str) -> DataFrame:
    return r6(so.aspect_ratio(points(s, d)), "aspect_ratio")


def contingency(s: SparkSession, d: str) -> DataFrame:
    return me.contingency(_predicted(points(s, d)))


def cluster_accuracy(s: SparkSession, d: str) -> DataFrame:
    return r6(me.accuracy(_predicted(points(s, d))), "accuracy")


def nmi(s: SparkSession, d: str) -> DataFrame:
    return r6(me.nmi(_predicted(points(s, d))), "nmi")


def ari(s: SparkSession, d: str) -> DataFrame:
    return r6(me.ari(_predicted(points(s, d))), "ari")


def roc_auc(s: SparkSession, d: str) -> DataFrame:
    return r6(me.roc_auc(_ranked(points(s, d))), "auc")


def average_precision(s: SparkSession, d: str) -> DataFrame:
    return r6(me.average_precision(_ranked(points(s, d))), "average_precision")


def top_z(s: SparkSession, d: str) -> DataFrame:
    return r6(me.top_z(_ranked(points(s, d)), 50), "precision", "recall", "f1")


def zone_accuracy(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    both = cs.zones(p).join(cs.true_zones(p).withColumnRenamed("zone", "true_zone"), ["id", "label"])
    return r6(me.agreement(both, "zone", "true_zone"), "accuracy")


def class_weights(s: SparkSession, d: str) -> DataFrame:
    return r6(me.class_weights(points(s, d), "label"), "weight")


def graph_volumes(s: SparkSession, d: str) -> DataFrame:
    return r6(tr.volumes(_graph(points(s, d))), "vol", "g")


def cut_volumes(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(tr.cut_volumes(_graph(p), _parts(p)), "cut")


def partition_entropy(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(tr.partition_entropy(_graph(p), _parts(p)), "entropy")


def point_level_entropy(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(tr.point_level_entropy(_graph(p), _parts(p)), "e1", "e2")


def combine_deltas(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    edges, parts = _graph(p), _parts(p)
    vol = tr.part_volumes(edges, parts)
    total = edges.agg(F.sum("w").alias("total"))
    a, b = (vol.select(F.col("part").alias(c), F.col("vol").alias(f"v{c}"), F.col("g").alias(f"g{c}")) for c in "ab")
    rows = tr.cut_volumes(edges, parts).join(a, "a").join(b, "b").join(total)
    return rows.select("a", "b", F.round(tr.combine_delta(F.col("va"), F.col("ga"), F.col("vb"), F.col("gb"), F.col("cut"), F.col("total")), 6).alias("delta"))


def structural_entropy(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).withColumn("graph_id", F.col("label").cast("long"))
    return r6(tr.structural_entropy(p, block=BLOCK), "score")


def outlier_score(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    edges = tr.graph_edges(p, 5, 0.2).withColumn("graph_id", F.lit(0).cast("long"))
    return r6(tr.outlier_scores(tr.level_entropy(written(dv.joined_trees(tr.as_vectors(p), edges, 3, BLOCK), "tree"))), "score")


def encoding_tree(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    edges = _graph(p).withColumn("graph_id", F.lit(0).cast("long"))
    return r6(dv.joined_trees(tr.as_vectors(p), edges, 3, BLOCK), "vol", "g")


def weighted_tree(s: SparkSession, d: str) -> DataFrame:
    """The tree of a coreset whose edges count by their first node's weight."""
    reps, _ = ol.coreset_vectors(vectors_64d(s, d), 100)
    reps = written(reps, "reps")
    edges = tr.weighted_edges(sp.gap_adjacency(reps, 5, 1.0), reps).withColumn("graph_id", F.lit(0).cast("long"))
    return r6(dv.joined_trees(reps.select(F.lit(0).cast("long").alias("graph_id"), "id", "v"), edges, 2, 32), "vol", "g")


def dbscan(s: SparkSession, d: str) -> DataFrame:
    return dc.dbscan(points(s, d), 0.04, 4)


def adaptive_dbscan(s: SparkSession, d: str) -> DataFrame:
    return dc.adaptive_dbscan(points(s, d).withColumn("density", 1 - F.col("label") / 10), 0.03, 0.06, 4)


def variable_eps_dbscan(s: SparkSession, d: str) -> DataFrame:
    return dc.variable_eps_dbscan(_with_radius(points(s, d)), 5)


def density_peaks(s: SparkSession, d: str) -> DataFrame:
    return r6(dc.density_peaks(dc.cutoff_density(points(s, d), 0.1), 5), "delta").select("id", "rho", "cluster")


def k_center_greedy(s: SparkSession, d: str) -> DataFrame:
    chosen, radius = ce.k_center_greedy(points(s, d), 5)
    return s.createDataFrame([(n, int(c[0]), round(radius, 6)) for n, c in enumerate(chosen)], "step int, id long, radius double")


def top_score_farthest(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).withColumn("score", F.col("x"))
    return s.createDataFrame([(n, int(c[0])) for n, c in enumerate(ce.top_score_farthest(p, 5))], "step int, id long")


def coverage(s: SparkSession, d: str) -> DataFrame:
    return ce.coverage(points(s, d).withColumn("radius", 0.1 + F.col("x") / 10), 4)


def k_medoids(s: SparkSession, d: str) -> DataFrame:
    found, _ = ce.k_medoids(points(s, d).withColumn("score", F.col("x")), 3)
    return found


def lloyd(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return s.createDataFrame([(int(c), round(x, 6), round(y, 6)) for c, x, y in ce.lloyd(p, _centres(p, 4), 2)], "centre int, x double, y double")


def k_means_cost(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(ce.cost(p, _centres(p)), "cost")


def swap_costs(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(ce.swap_costs(p, _centres(p, 4), (0.5, 0.5)), "cost")


def _places(s: SparkSession, d: str) -> DataFrame:
    """Parts as weighted places of size and price, each scaled to 0..1."""
    o = importable(s).read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return cs.duplicates(sc.min_max(o, ["x", "y"]))


def swap_costs_pairs(s: SparkSession, d: str) -> DataFrame:
    """The cost of giving up each pair of four centres for two new points, over weighted places."""
    p = written(_places(s, d), "places")
    centres = ce.first_points(p, 4)
    new = [(0.5, 0.5), (0.25, 0.75)]
    base, by = sw.swap_sums(sw.near_lists(p, centres, 3), [new])[0]
    rows = [(a, b, base + by.get((a,), 0.0) + by.get((b,), 0.0) + by.get((a, b), 0.0)) for a in range(4) for b in range(a + 1, 4)]
    return r6(s.createDataFrame(rows, "a int, b int, cost double"), "cost")


def local_search(s: SparkSession, d: str) -> DataFrame:
    found, cost = sw.local_search(points(s, d).withColumn("weight", F.lit(1)), 5)
    return s.createDataFrame([(int(c), x, y, cost) for c, x, y in found], "centre int, x double, y double, cost double")


def multi_swap_search(s: SparkSession, d: str) -> DataFrame:
    found, cost = sw.multi_swap_search(cs.duplicates(points(s, d)), 5)
    return s.createDataFrame([(int(c), x, y, cost) for c, x, y in found], "centre int, x double, y double, cost double")


def regularised_k_means(s: SparkSession, d: str) -> DataFrame:
    found, _ = ce.regularised_k_means(points(s, d), ["x", "y"], 5, rounds=5)
    return found.select("id", "cluster")


def feature_grid(s: SparkSession, d: str) -> DataFrame:
    """Accuracy and mutual information of k-means over feature sets with and without the density score."""
    p = points(s, d)
    rows = sc.min_max(p.join(written(so.density(p), "density"), "id"), ["score"]).withColumns({"twice": F.col("score") * 2, "logged": sc.guarded_log(F.col("score"))})
    rows = sc.quantise(sc.min_max(rows, ["logged"]), "score", 0.0, 1.0)
    sets = {"score": ["score"], "data": ["x", "y"], "data+score": ["x", "y", "score"], "data+twice": ["x", "y", "twice"], "data+log": ["x", "y", "logged"], "data+level": ["x", "y", "level"]}
    return fg.agreements(rows, {(name,): (cols, False) for name, cols in sets.items()}, ["features"], 10)


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Points with two scores, their density and their overlap with other clusters."""
    p = points(s, d)
    return p.join(written(so.density(p), "density").withColumnRenamed("score", "dense"), "id").join(written(so.projection_overlap(p, _centres(p, 5)), "overlap").withColumnRenamed("score", "overlap"), "id")


def feature_table(s: SparkSession, d: str) -> DataFrame:
    """The columns of all nine feature sets."""
    f, sets = fg.feature_sets(_scored(s, d), ["x", "y"], ["dense", "overlap"])
    cols = sorted({c for v in sets.values() for c in v})
    return r6(f, *cols).select("id", *cols)


def full_feature_grid(s: SparkSession, d: str) -> DataFrame:
    """Nine feature sets, each with its regularised twin."""
    return fg.grid(_scored(s, d), ["x", "y"], ["dense", "overlap"], 10)


def best_features(s: SparkSession, d: str) -> DataFrame:
    return me.best_of_grid(feature_grid(s, d), "accuracy", ["features"])


def coreset(s: SparkSession, d: str) -> DataFrame:
    reps, _ = ol.coreset(points(s, d), 50)
    return reps


def outlier_pipeline(s: SparkSession, d: str) -> DataFrame:
    return ol.outlier_pipeline(vectors_64d(s, d), 50)


def outlier_grid(s: SparkSession, d: str) -> DataFrame:
    """Label 0 as outliers among all 64 components: a row for each cell of neighbours, depth and gap."""
    rows = importable(s).read.parquet(f"{d}/embeddings.parquet")
    p = sp.vectors(rows, "vec_id", "embedding").join(rows.select(F.col("vec_id").alias("id"), (F.col("label") == 0).alias("is_outlier")), "id")
    found = ol.outlier_grid(p, 50, [4, 5], [2, 3], [0.5, 1.0], block=BLOCK)
    return r6(found, "precision", "recall", "f1", "auc", "average_precision")


def ranking_grid(s: SparkSession, d: str) -> DataFrame:
    """The grid's metrics for scores in coarser and finer steps."""
    p = points(s, d).withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(4))))
    rows = p.select("cell", "id", (F.col("label") == 0).alias("positive"), F.floor(F.col("x") * 5 * F.col("cell")).cast("double").alias("score"))
    return r6(me.grouped_ranking(rows, ["cell"], 50), "precision", "recall", "f1", "auc", "average_precision")


def vectors_64d(s: SparkSession, d: str) -> DataFrame:
    """id, v of all valid embeddings, all components."""
    return sp.vectors(importable(s).read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


def knn_64d(s: SparkSession, d: str) -> DataFrame:
    return r6(sp.knn_graph(vectors_64d(s, d), 5), "d").select("i", "rank", "j", "d")


def range_counts_64d(s: SparkSession, d: str) -> DataFrame:
    return sp.within(vectors_64d(s, d), 1.25).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def nearest_centre_64d(s: SparkSession, d: str) -> DataFrame:
    """The nearest of the first ten vectors."""
    v = vectors_64d(s, d)
    centres = [(n, list(r.v)) for n, r in enumerate(v.orderBy("id").limit(10).collect())]
    return r6(sp.nearest_centre(v, centres), "d1", "d2").select("id", "centre", "d1", "d2")


def coreset_64d(s: SparkSession, d: str) -> DataFrame:
    reps, _ = ol.coreset_vectors(vectors_64d(s, d), 50)
    return reps.select("id", "round", "weight")


def noisy_points(s: SparkSession, d: str) -> DataFrame:
    return ol.with_noise(points(s, d), 20, 5.0)


def route_distances(s: SparkSession, d: str) -> DataFrame:
    return r6(ro.route_distances(_stops(s, d)), "distance")


def route_features(s: SparkSession, d: str) -> DataFrame:
    found = ro.route_features(_stops(s, d), 100)
    return r6(found, *[c for c in found.columns if c != "route"])


def subproblem_features(s: SparkSession, d: str) -> DataFrame:
    found = ro.subproblem_features(_stops(s, d))
    deciles = {f"{p}_d{n}": F.col(f"{p}_deciles")[n] for p in ("depot", "centre") for n in (0, 5, 10)}
    found = found.withColumns(deciles).drop("depot_deciles", "centre_deciles")
    return r6(found, *[c for c in found.columns if c not in ("route", "size")])


def route_neighbors(s: SparkSession, d: str) -> DataFrame:
    return ro.route_neighbors(_stops(s, d)).select("route", "other", "rank")


def route_clusters(s: SparkSession, d: str) -> DataFrame:
    return ro.route_clusters(_stops(s, d)).select("route", "other")


def angular_split(s: SparkSession, d: str) -> DataFrame:
    return ro.angular_split(points(s, d).withColumn("problem", F.col("label")), 4)


def capacity_split(s: SparkSession, d: str) -> DataFrame:
    return ro.capacity_split(_stops(s, d).withColumnRenamed("route", "problem"), 12)


def packed_routes(s: SparkSession, d: str) -> DataFrame:
    """Each problem's routes of capacity_split() packed with zeros, as text."""
    split = capacity_split(s, d)
    routes = split.groupBy("problem", "route").agg(F.transform(F.array_sort(F.collect_list("seq")), lambda v: (v + 1).cast("int")).alias("nodes"))
    grouped = routes.groupBy("problem").agg(F.transform(F.array_sort(F.collect_list(F.struct("route", "nodes"))), lambda r: r["nodes"]).alias("routes"))
    return grouped.select("problem", F.array_join(ro.packed(F.col("routes")), ",").alias("packed"))


def cyclic_neighbors(s: SparkSession, d: str) -> DataFrame:
    return ro.cyclic_neighbors(_stops(s, d))


def rotated_stops(s: SparkSession, d: str) -> DataFrame:
    return r6(ro.rotated(_stops(s, d), 0.5, flip=True), "x", "y").select("node", "x", "y")


def edge_rank(s: SparkSession, d: str) -> DataFrame:
    edges = nb.knn_graph(points(s, d), 5).select("i", "j", (1 - F.col("d")).alias("p"), ((F.col("i") + F.col("j")) % 3 == 0).alias("is_tour"))
    return r6(me.edge_rank(edges), "mean_rank")


def batch_ids(s: SparkSession, d: str) -> DataFrame:
    return sa.batches(points(s, d), 125).select("id", "batch")


def swap_tuples(s: SparkSession, d: str) -> DataFrame:
    return sa.subsets(points(s, d), "label", 3)


def weighted_sample(s: SparkSession, d: str) -> DataFrame:
    return sa.weighted_sample(points(s, d), 20, "x", seed=1).select("id")


def poisson_sample(s: SparkSession, d: str) -> DataFrame:
    return sa.poisson_sample(points(s, d), 20, "x", seed=1).select("id")


def d2_seeding(s: SparkSession, d: str) -> DataFrame:
    return r6(s.createDataFrame(sa.d2_seeding(points(s, d), 5, seed=1), "centre int, x double, y double"), "x", "y")


def divided_trees(s: SparkSession, d: str) -> DataFrame:
    """Entropy of each label's tree, divided into groups of fewer than 16 points."""
    p = points(s, d).withColumn("graph_id", F.col("label").cast("long"))
    edges = nb.gap_adjacency(p, 5, 0.05, "graph_id").join(p.select(F.col("id").alias("i"), "graph_id"), "i")
    return r6(tr.tree_entropy(written(dv.joined_trees(tr.as_vectors(p), edges, 2, 16), "tree")), "entropy")


def up_dimension(s: SparkSession, d: str) -> DataFrame:
    return r6(tr.up_dimension(points(s, d), 10, block=BLOCK), "x", "y", "z")


def generated_points(s: SparkSession, d: str) -> DataFrame:
    """Counts of generated points by distribution and label."""
    importable(s)
    out = None
    for kind in (*generators.DISTRIBUTIONS, *generators.SHAPES):
        one = generators.points(s, kind, 200, seed=1).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def generated_instances(s: SparkSession, d: str) -> DataFrame:
    return generators.instances(s, 20, 51, seed=1)


def graph_network(s: SparkSession, d: str) -> DataFrame:
    """Two layers of width 4 with fixed weights over the 5-NN graph."""
    p = points(s, d)
    m = lambda n: [[((n * 7 + a * 3 + b * 5) % 11 - 5) / 20 for b in range(4)] for a in range(4)]
    nodes = p.select("id", F.array("x", "y", F.lit(1.0), F.col("x") - F.col("y")).alias("h"))
    edges = nb.knn_graph(p, 5).select("i", "j", "rank", F.array("d", F.lit(1.0), 1 - F.col("d"), F.lit(0.0)).alias("e"))
    layers = [gn.Layer(*[m(6 * k + n) for n in range(6)]) for k in range(2)]
    found, _ = gn.forward(nodes, edges, layers, [0.1] * 4)
    return found.select("id", *[F.round(F.col("h")[k], 6).alias(f"h{k}") for k in range(4)])


def city_block_routes(s: SparkSession, d: str) -> DataFrame:
    """Neighbours of routes with a window of [x, x + y] at each stop."""
    stops = _stops(s, d).withColumns({"opens": F.col("x"), "closes": F.col("x") + F.col("y")})
    return ro.route_neighbors(stops, ["opens", "closes"], 0.5).select("route", "other", "rank")


def node_features(s: SparkSession, d: str) -> DataFrame:
    """A problem for each label, its smallest id the depot, with windows."""
    rows = points(s, d).withColumn("_d", F.min("id").over(Window.partitionBy("label")))
    nodes = rows.select(F.col("label").alias("problem"), F.when(F.col("id") == F.col("_d"), 0).otherwise(F.col("id") + 1).alias("node"), "x", "y", (F.col("id") % 5 + 1).alias("demand"), F.lit(20).alias("capacity"), F.col("x").alias("window_start"), (F.col("x") + 0.5).alias("window_end"), (F.col("id") % 3).alias("visits"))
    v = F.col("features")
    return ro.node_features(nodes, "CVRPTW").select("problem", "node", *[F.round(v[n], 6).alias(f"f{n}") for n in range(6)])


def padded_routes(s: SparkSession, d: str) -> DataFrame:
    routes = capacity_split(s, d).groupBy("problem", "route").agg(F.array_sort(F.collect_list("seq")).alias("nodes"))
    return ro.padded_each(routes, "nodes", F.lit(0).cast("long")).select("problem", "route", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


def beam_top(s: SparkSession, d: str) -> DataFrame:
    return sr.beam(points(s, d).select("id", "label", F.col("x").alias("cost")), 3, by="label").select("id", F.round("cost", 6).alias("cost"))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return importable(s).read.parquet(f"{d}/orders.parquet")


def search_replay(s: SparkSession, d: str) -> DataFrame:
    """A log in which order n + 1 came from order n // 3, replayed for four steps."""
    moves = _orders(s, d).select(F.floor(F.col("o_orderkey") / 3).alias("problem"), (F.col("o_orderkey") % 3).alias("action"), F.col("o_orderkey").alias("next")).where("next > 0")
    return sr.replay(moves, 4).fillna(-1, ["parent", "action"])


def _search_log(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Moves, actions, results and first routes: order n + 1 came from order n // 3, with one of eleven results; results are cluster nodes in a
    scattered order, eight a route, and the first routes are points by id % 30."""
    o = _orders(s, d).where("o_orderkey > 0")
    moves = o.select(F.floor(F.col("o_orderkey") / 3).alias("problem"), (F.col("o_orderkey") * 7 % 20).alias("action"), F.col("o_orderkey").alias("next"), (F.col("o_orderkey") % 11).alias("result"))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(210)), lambda k: (k * (F.col("result") + 3) % 211).cast("int"))
    routes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda b: F.concat(F.slice(F.col("numbers"), b * 8 + 1, F.lit(8)), F.array(F.lit(0)))))
    results = moves.groupBy("result").agg(F.max("next").cast("double").alias("distance")).withColumn("numbers", numbers).select("result", "distance", routes.alias("nodes"))
    stops = points(s, d).select((F.col("id") % 30).alias("route"), F.col("id").alias("seq"), F.col("id").alias("node"), "x", "y")
    return moves.select("problem", "action", "next"), moves.select(F.col("next").alias("seq"), "problem", "action", "result"), results, stops


def replayed_routes(s: SparkSession, d: str) -> DataFrame:
    """Routes of all problems within three steps of a log."""
    return sr.replay_routes(*_search_log(s, d), 3).select("problem", "depth", "route", "seq", "node", "visits")


def replayed_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of the logged actions of problems within two steps."""
    moves, actions, results, stops = _search_log(s, d)
    state = sr.replay_routes(moves, actions, results, stops, 2)
    return r6(sr.replay_labels(state, actions, results), "label").select("problem", "action", "result", "label", "is_first")


def sampled_clusters(s: SparkSession, d: str) -> DataFrame:
    """Routes drawn near each route, the nearer the likelier."""
    state = _search_log(s, d)[3].withColumn("problem", F.lit(0).cast("long"))
    picks = state.select("problem", F.col("route").alias("action"))
    return sr.clusters(sr.route_stats(state), picks, temperature=0.1, seed=1).select("action", "route", "rank")


def action_labels(s: SparkSession, d: str) -> DataFrame:
    """Orders as logged actions: problem by customer, action by order, a result for each clerk."""
    o = _orders(s, d).select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("problem"), (F.col("o_orderkey") % 7).alias("action"), (F.col("o_orderkey") % 11).alias("result"), F.col("o_totalprice").cast("double").alias("price"))
    results = o.groupBy("result").agg(F.min("price").alias("distance"))
    before = o.groupBy("problem", "action").agg(F.max("price").alias("distance"))
    return r6(sr.action_labels(o, results, before), "label").select("problem", "action", "result", "label", "is_first")


def trial_comparison(s: SparkSession, d: str) -> DataFrame:
    """Trials by the logarithm of the order's number, against those of another solver."""
    o = _orders(s, d).select((F.col("o_orderkey") % 120 + 1).alias("trial"), F.col("o_totalprice").cast("double").alias("objective"))
    mine = o.withColumn("seconds", F.col("trial").cast("double"))
    other = o.where("trial <= 60").select("trial", (F.col("objective") * 0.5).alias("objective"), (F.col("trial") * 2.0).alias("seconds"))
    return r6(sr.compare_trials(mine, other, 5.0), "objective", "seconds", "other_objective", "other_seconds").select("rule", "trial", "objective", "seconds", "other_trial", "other_objective", "other_seconds")


def _label_tree(s: SparkSession, d: str) -> DataFrame:
    """Points below their labels below a root, with ids that aren't in order of height."""
    p, big = points(s, d), F.lit(10_000_000).cast("long")
    node = lambda i, up: (F.lit(0).cast("long").alias("graph_id"), i.cast("long").alias("node_id"), up.cast("long").alias("parent_id"), F.lit(0).alias("height"))
    leaves = p.select(*node(F.col("id") + 1000, F.col("label") + 10))
    return leaves.union(p.select("label").distinct().select(*node(F.col("label") + 10, big))).union(s.range(1).select(*node(big, F.lit(None))))


def renumbered_tree(s: SparkSession, d: str) -> DataFrame:
    return tr.renumbered(_label_tree(s, d)).fillna(-1, ["parent_id"])


def level_order(s: SparkSession, d: str) -> DataFrame:
    return tr.level_order(_label_tree(s, d))


def weighted_graph(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    return r6(tr.weighted_edges(_graph(p), p.select("id", (F.col("label") + 1).alias("weight"))), "w")


def block_graph(s: SparkSession, d: str) -> DataFrame:
    """Edges within labels, with what leaves them as loops, and edges between labels as graph -1."""
    p = points(s, d)
    inner, outer = tr.block_edges(_graph(p), _parts(p).withColumn("part", F.col("part").cast("long")))
    return r6(inner.unionByName(outer.select(F.lit(-1).cast("long").alias("graph_id"), "i", "j", "w")), "w")


def top_k_agreement(s: SparkSession, d: str) -> DataFrame:
    return me.top_k_agreement(points(s, d), 10, "x")


def generated_tours(s: SparkSession, d: str) -> DataFrame:
    return r6(generators.tours(importable(s), 20, 51, seed=1), "x", "y")


def problem_files(s: SparkSession, d: str) -> DataFrame:
    """Problems written as text and read again."""
    ordered = _stops(s, d).withColumn("node", (F.row_number().over(Window.partitionBy("route").orderBy("seq")) - 1).cast("int"))
    stops = ordered.groupBy("route").agg(F.collect_list(F.struct("node", "x", "y", "demand")).alias("stops")).select(F.concat(F.lit("p"), F.col("route").cast("string")).alias("name"), F.lit(20).alias("capacity"), "stops")
    path = f"{shared_folder(importable(s))}/problems-{uuid.uuid4().hex}"
    stops.select("name", sinks.problem_text("name", "capacity", "stops").alias("value")).write.partitionBy("name").text(path)
    return sources.read_problem(s, path).groupBy("capacity", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("demand").alias("demand"))


def _full_problems(s: SparkSession, d: str, kind: str) -> DataFrame:
    """A problem a label with windows [x, x + y] and pickups at every third point, written as text and read again."""
    ordered = _stops(s, d).withColumn("node", (F.row_number().over(Window.partitionBy("route").orderBy("seq")) - 1).cast("int"))
    more = [F.col("x").alias("window_start"), (F.col("x") + F.col("y")).alias("window_end")] if kind == "CVRPTW" else [(F.col("seq") % 3 == 0).cast("int").alias("is_pickup")]
    stops = ordered.groupBy("route").agg(F.collect_list(F.struct("node", "x", "y", "demand", *more)).alias("stops")).select(F.concat(F.lit("p"), F.col("route").cast("string")).alias("name"), F.lit(20).alias("capacity"), "stops")
    path = f"{shared_folder(importable(s))}/problems-{uuid.uuid4().hex}"
    stops.select("name", sinks.problem_text("name", "capacity", "stops", kind=kind, service=0.25).alias("value")).write.partitionBy("name").text(path)
    return sources.read_full_problem(s, path).withColumn("label", F.regexp_extract("file", "name=p([0-9]+)", 1).cast("int"))


def window_problem_files(s: SparkSession, d: str) -> DataFrame:
    return _full_problems(s, d, "CVRPTW").select("label", "node", "type", "capacity", "service_time", "x", "y", "demand", "window_start", "window_end")


def pickup_problem_files(s: SparkSession, d: str) -> DataFrame:
    return _full_problems(s, d, "VRPMPD").select("label", "node", "type", "capacity", "x", "y", "demand", "is_pickup")


def _lloyd_centres(p: DataFrame, k: int) -> list[ce.Centre]:
    """Centres after five Lloyd steps from the first points."""
    return ce.lloyd(p, _centres(p, k), 5)


def fringe_score_lloyd(s: SparkSession, d: str) -> DataFrame:
    """The fringe score with k-means centres."""
    p = points(s, d)
    return r6(so.fringe(p, [_lloyd_centres(p, k) for k in (3, 5, 10)]), "score")


def true_zones_lloyd(s: SparkSession, d: str) -> DataFrame:
    """Zones around k-means centres: a point's cluster is that of its nearest centre, and the radius is that of the cluster's farthest point."""
    p = points(s, d)
    return cs.centre_zones(p, _lloyd_centres(p, 10)).select("id", "centre", "zone")


QUERIES = {f.__name__: f for f in (
    zone_histogram, min_max_scale, standard_scale, block_scale, guarded_log, softmax_by_label, knn_graph, inverse_edges, gap_adjacency, k_farthest, range_counts, own_range_counts, mutual_range_counts,
    nearest_centre, snapped_centroids, nearest_higher, centroids, radius_all, radius_at_centre, size_density_diameter, zones, true_zones, score_deciles, uniform_quantise, marked_points, top_per_label,
    duplicate_parts, smallest_gap, distance_quantiles, density_score, projection_overlap, fringe_score, core_point_score, aspect_ratio, contingency, cluster_accuracy, nmi, ari, roc_auc, average_precision,
    top_z, zone_accuracy, class_weights, graph_volumes, cut_volumes, partition_entropy, point_level_entropy, combine_deltas, structural_entropy, outlier_score, encoding_tree, dbscan, adaptive_dbscan,
    variable_eps_dbscan, density_peaks, k_center_greedy, top_score_farthest, coverage, k_medoids, lloyd, k_means_cost, swap_costs, local_search, multi_swap_search, regularised_k_means, feature_grid,
    best_features, coreset, outlier_pipeline, noisy_points, route_distances, route_features, subproblem_features, route_neighbors, route_clusters, angular_split, capacity_split, packed_routes,
    cyclic_neighbors, rotated_stops, edge_rank, batch_ids, swap_tuples, weighted_sample, poisson_sample, d2_seeding, divided_trees, up_dimension, generated_points, generated_instances, graph_network,
    city_block_routes, node_features, padded_routes, weighted_tree, swap_costs_pairs, outlier_grid, ranking_grid, knn_64d, range_counts_64d, nearest_centre_64d, coreset_64d, beam_top, search_replay, replayed_routes, replayed_labels, sampled_clusters, action_labels, trial_comparison, renumbered_tree, level_order, weighted_graph, block_graph, top_k_agreement, generated_tours, problem_files, window_problem_files, pickup_problem_files, fringe_score_lloyd, true_zones_lloyd, feature_table, full_feature_grid,
)}
