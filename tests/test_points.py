"""Micro-fixtures for the semantic traps, and metamorphic checks."""

import itertools
import math

import numpy as np
import pytest

from stellate.functions import generators
from stellate.operators import centres, clusterstats, density_clustering, graph_network, metrics, neighbors, outliers, routes, scaling, scores, trees
from stellate.streaming import assign


def pts(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), lab) for i, (x, y, lab) in enumerate(rows)], "id long, x double, y double, label int")


def test_copies_are_told_apart_by_id(spark):
    p = pts(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 5, 0)])
    got = {(r.i, r["rank"]): (r.j, round(r.d, 6)) for r in neighbors.knn_graph(p, 2).collect()}
    assert got[0, 1] == (1, 0.0) and got[1, 1] == (0, 0.0) and got[0, 2] == (2, 1.0)


def test_fewer_points_than_k(spark):
    assert neighbors.knn_graph(pts(spark, [(k, 0, 0) for k in range(4)]), 20).groupBy("i").count().toPandas()["count"].tolist() == [3] * 4


def test_knn_equals_brute_force_on_clusters(spark):
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.normal(c, s, (60, 2)) for c, s in (((0, 0), 0.01), ((5, 5), 1.0), ((100, -3), 0.2))])
    p = pts(spark, [(x, y, 0) for x, y in xy])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    want = {(i, r + 1): j for i in range(len(xy)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(xy)), d[i])) if j != i][:4])}
    assert {(r.i, r["rank"]): r.j for r in neighbors.knn_graph(p, 4).collect()} == want


def test_first_edge_is_kept_beyond_the_gap(spark):
    got = {(r.i, r.j) for r in neighbors.gap_adjacency(pts(spark, [(0, 0, 0), (1, 0, 0), (3, 0, 0)]), 2, 0.5).collect()}
    assert got == {(0, 1), (1, 0), (2, 1), (1, 2)}


def test_sizes_of_small_clusters(spark):
    rows = pts(spark, [(1, 1, 0), (2, 2, 1), (2, 2, 1), (2, 2, 1), (0, 0, 2), (3, 4, 2)])
    got = {r.label: (r["size"], round(r.density, 6), r.diameter) for r in clusterstats.size_density_diameter(rows).collect()}
    assert got[0] == (1, 1.0, 0.0) and got[1] == (3, 1.0, 0.0) and got[2][2] == 5.0


def test_zone_edges(spark):
    rows = pts(spark, [(0, 0, 0), (-10, 0, 0), (10, 0, 0), (1, 0, 0), (-1, 0, 0), (5, 0, 0), (-5, 0, 0)])
    assert [r.zone for r in clusterstats.zones(rows).orderBy("id").collect()] == [1, 10, 10, 2, 2, 6, 6]
    assert [r.zone for r in clusterstats.true_zones(rows).orderBy("id").collect()] == [1, 10, 10, 1, 1, 5, 5]


def test_constant_columns(spark):
    rows = pts(spark, [(2, 1, 0), (2, 2, 0)])
    assert {r.decile for r in scaling.score_deciles(rows, "x", "label").collect()} == {5}
    assert [r.x for r in scaling.min_max(rows, ["x"]).collect()] == [0.0, 0.0]
    assert [r.x for r in scaling.standard(rows, ["x"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("turn", [0.0, 1.0])
def test_zones_do_not_change_with_rotation(spark, turn):
    rng = np.random.default_rng(5)
    xy = rng.normal(size=(50, 2))
    c, s = math.cos(turn), math.sin(turn)
    p = pts(spark, [(x * c - y * s + 3, x * s + y * c, k % 3) for k, (x, y) in enumerate(xy)])
    q = pts(spark, [(x, y, k % 3) for k, (x, y) in enumerate(xy)])
    assert clusterstats.zones(p).orderBy("id").collect() == clusterstats.zones(q).orderBy("id").collect()


def test_accuracy_of_noise(spark):
    rows = spark.createDataFrame([(0, -1), (0, -1), (1, 0), (1, 0), (1, 1)], "label_true int, label_pred int")
    assert metrics.accuracy(rows).first()[0] == pytest.approx(4 / 5)
    assert metrics.filtered_accuracy(rows).first()[0] == pytest.approx(2 / 3)
    assert metrics.filtered_accuracy(rows.where("label_pred = -1")).first()[0] == 0.0


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        w = rng.integers(0, 20, (n, n)).astype(float)
        assert metrics.assignment(w) == max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, True, 0.5), (2, False, 0.5), (3, True, 0.9), (4, False, 0.1)], "id long, positive boolean, score double")
    assert metrics.roc_auc(rows).first()[0] == pytest.approx(0.875)
    assert metrics.average_precision(rows).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def _sequential_variable(xy, radii, least):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    near = [np.flatnonzero(d[i] <= radii[i]).tolist() for i in range(len(xy))]
    labels, seen, count = [-1] * len(xy), set(), 0
    for i in range(len(xy)):
        if i in seen:
            continue
        seen.add(i)
        if len(near[i]) < least:
            continue
        labels[i], queue = count, list(near[i])
        while queue:
            j = queue.pop(0)
            if j not in seen:
                seen.add(j)
                if len(near[j]) >= least:
                    queue += [n for n in near[j] if n not in seen]
            if labels[j] == -1:
                labels[j] = count
        count += 1
    return labels


def test_variable_radius_clusters_equal_the_sequential_definition(spark):
    rng = np.random.default_rng(2)
    for _ in range(2):
        xy, radii = rng.random((60, 2)), rng.choice([0.05, 0.1, 0.2], 60)
        p = spark.createDataFrame([(i, float(a), float(b), float(r)) for i, ((a, b), r) in enumerate(zip(xy, radii, strict=True))], "id long, x double, y double, radius double")
        got = [r.cluster for r in density_clustering.variable_eps_dbscan(p, 4).orderBy("id").collect()]
        assert got == _sequential_variable(xy, radii, 4)


def test_density_peaks_of_one_and_two_blobs(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))])
    p = density_clustering.cutoff_density(pts(spark, [(x, y, 0) for x, y in xy]), 0.15)
    two = density_clustering.density_peaks(p, 2).orderBy("id").toPandas().cluster
    assert set(two) == {0, 1} and two[:30].nunique() == 1 and two[30:].nunique() == 1
    assert set(density_clustering.density_peaks(p, 1).toPandas().cluster) == {0}


def test_tree_invariants(spark):
    rng = np.random.default_rng(6)
    p = pts(spark, [(x, y, 0) for x, y in np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(20, 1, (20, 2))])]).withColumnRenamed("label", "l")
    edges = trees.graph_edges(p).selectExpr("0L as graph_id", "i", "j", "w")
    tree = trees.encoding_trees(edges, 3).toPandas()
    leaves = tree[tree.point_id.notna()]
    assert sorted(leaves.point_id) == list(range(60)) and set(leaves.height) == {0}
    inner = tree[tree.node_id.isin(tree.parent_id.dropna())].set_index("node_id")
    sums = tree.dropna(subset=["parent_id"]).groupby("parent_id").vol.sum()
    assert np.allclose(inner.vol.loc[sums.index.astype(int)], sums) and (tree.g <= tree.vol + 1e-9).all()
    levels = trees.level_entropy(trees.encoding_trees(edges, 3), 3).toPandas()
    assert levels.groupby("point_id").size().eq(3).all() and (levels.entropy >= -1e-12).all()


def test_two_triangles_share_a_root():
    edges = [(a, b, 1.0) for t in ((0, 1, 2), (3, 4, 5)) for a in t for b in t if a != b]
    tree = trees.build(edges, list(range(6)), 2)
    assert sum(n["parent_id"] is None for n in tree) == 1 and {n["height"] for n in tree if n["point_id"] is not None} == {0}


def test_coreset_covers_all(spark):
    rng = np.random.default_rng(8)
    p = pts(spark, [(x, y, 0) for x, y in rng.random((200, 2))])
    reps, members = outliers.coreset(p, 40)
    assert members.count() == 200 and members.select("id").distinct().count() == 200
    assert reps.agg({"weight": "sum"}).first()[0] == 200


def test_capacity_and_packing(spark):
    stops = spark.createDataFrame([(0, k, d) for k, d in enumerate((3, 4, 2, 5))], "problem int, seq long, demand int")
    assert [r.route for r in routes.capacity_split(stops, 6).orderBy("seq").collect()] == [0, 1, 1, 2]
    row = spark.sql("SELECT 0 AS problem, array(array(1, 2), array(3)) AS routes").select("problem", routes.packed("routes").alias("packed"))
    assert row.first().packed == [1, 2, 0, 3, 0]
    assert [r.nodes for r in routes.unpacked(row).orderBy("route").collect()] == [[1, 2], [3]]


def test_capacity_split_keeps_no_list_of_a_problem(spark):
    """A long problem, null problems, seqs and demands, repeated rows, and demands above the capacity and below 0."""
    rows = [(1, n * 7 % 3001, n % 5 + 1) for n in range(3001)] + [(None, 2, 3), (None, 1, 4), (None, None, 2), (2, 5, 9), (2, 5, 9), (2, 6, -8), (2, 7, 6), (3, 1, 4), (3, 2, None), (3, 3, 6), (3, 4, 6), (3, None, None)]
    stops = spark.createDataFrame([*rows, (4, 1, None), (4, 2, 8), (5, 1, 4), (5, 2, 4), (5, 2, 3)], "problem int, seq int, demand int").repartition(3)
    split = routes.capacity_split(stops, 6)
    assert split.dtypes == [("problem", "int"), ("seq", "bigint"), ("route", "int")]
    assert "collect_list" not in split._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in split.collect():
        got.setdefault(r.problem, []).append((-1 if r.seq is None else r.seq, r.route))
    assert {p: sorted(v) for p, v in got.items() if p != 1} == {None: [(-1, 0), (1, 0), (2, 1)], 2: [(5, 1), (5, 2), (6, 2), (7, 3)], 3: [(-1, 0), (1, 0), (2, 0), (3, 0), (4, 0)], 4: [(1, 0), (2, 0)], 5: [(1, 0), (2, 1), (2, 2)]}
    expected, held, route = [], 0, 0
    for _, seq, demand in sorted(r for r in rows if r[0] == 1):
        held, route = (demand, route + 1) if held + demand > 6 else (held + demand, route)
        expected.append((seq, route))
    assert sorted(got[1]) == expected


def test_search_does_not_get_worse(spark):
    p = generators.mixture(spark, 200, 4, 0.02, seed=3)
    first = centres.cost(p, [(n, x, y) for n, (_, x, y) in enumerate(centres.k_center_greedy(p, 4)[0])]).first()[0]
    assert centres.local_search(p, 4, rounds=2)[1] <= first + 1e-9


def test_density_of_all_in_reach(spark):
    got = scores.density(pts(spark, [(0, 0, 0), (1e-9, 0, 0), (0, 1, 0)])).orderBy("id").collect()
    assert [round(r.score, 6) for r in got] == [2.0, 2.0, 1.0]


def test_network_without_neighbours_keeps_shape(spark):
    nodes = spark.sql("SELECT 1L AS id, array(1.0D, 2.0D) AS h")
    edges = spark.createDataFrame([], "i long, j long, rank int, e array<double>")
    unit = [[1.0, 0.0], [0.0, 1.0]]
    out, _ = graph_network.forward(nodes, edges, [graph_network.Layer(unit, unit, unit, unit, unit, unit)], [0.0, 0.0])
    assert out.first().h == [2.0, 4.0]


def test_streaming_assignment(spark, tmp_path):
    pts(spark, [(0, 0, 0), (9, 9, 0)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, x double, y double, label int").parquet(str(tmp_path / "in"))
    query = assign.assigned(stream, [(0, 0.0, 0.0), (1, 10.0, 10.0)]).writeStream.format("memory").queryName("assigned").start()
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.centre for r in spark.table("assigned").collect()} == {0: 0, 1: 1}


def test_generators_are_fixed_by_their_seed(spark):
    for kind in (*generators.DISTRIBUTIONS, *generators.SHAPES):
        a, b = (generators.points(spark, kind, 40, seed=5).orderBy("id").collect() for _ in range(2))
        assert a == b and len(a) == 40


def test_flip_mirrors_after_turning(spark):
    import math

    from stellate.operators import routes

    stops = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 2.0)], "node int, x double, y double")
    got = {r.node: (r.x, r.y) for r in routes.rotated(stops, math.pi / 2, flip=True).collect()}
    assert all(math.isclose(a, b, abs_tol=1e-12) for n, want in {0: (0, -1), 1: (-2, 0)}.items() for a, b in zip(got[n], want, strict=True))
    moved = {r.node: (r.x, r.y) for r in routes.rotated(stops, 0.0, noise=0.1).collect()}
    assert moved[0] == (1.0, 0.0) and moved[1] != (0.0, 2.0) and math.dist(moved[1], (0.0, 2.0)) < 1


def test_agreement_of_top_scores(spark):
    rows = [(n, (n % 3) * 1.0 + (n // 3) * 0.001, 0.0, float(n < 3)) for n in range(30)]
    got = metrics.top_k_agreement(spark.createDataFrame(rows, "id long, x double, y double, score double"), 3).first()
    assert (got.hit_ratio, got.accuracy) == (1.0, 1.0)


def test_renumbered_uneven_tree(spark):
    rows = [(0, 9, None), (0, 4, 9), (0, 7, 4), (0, 3, 9), (1, 5, None), (1, 2, 5)]
    tree = spark.createDataFrame([(*r, 0) for r in rows], "graph_id long, node_id long, parent_id long, height int")
    got = {(r.graph_id, r.node_id, r.parent_id, r.height) for r in trees.renumbered(tree).collect()}
    assert got == {(0, 0, 3, 0), (0, 1, 2, 0), (0, 2, 3, 1), (0, 3, None, 2), (1, 0, 1, 0), (1, 1, None, 1)}
    assert [(r.node_id, r.pos) for r in trees.level_order(tree).where("graph_id = 0").orderBy("pos").collect()] == [(9, 0), (3, 1), (4, 2), (7, 3)]
    assert trees.renumbered(tree.limit(0)).isEmpty() and trees.level_order(tree.limit(0)).isEmpty()


def test_snapped_local_search(spark):
    pts = spark.createDataFrame([(n, float(n % 2) + n * 0.01, 0.0) for n in range(12)], "id long, x double, y double")
    places = {(r.x, r.y) for r in pts.collect()}
    assert all((x, y) in places for _, x, y in centres.local_search(pts, 2, rounds=2, snap=True)[0])


def test_draws_stay_inside(spark):
    rows = generators.mixture(spark, 500, 3, 0.4, seed=2)
    assert rows.where("label >= 0 and (x in (0.0, 1.0) or y in (0.0, 1.0))").isEmpty() and rows.where("x < 0 or x > 1 or y < 0 or y > 1").isEmpty()
    assert sorted(map(tuple, rows.repartition(7).collect())) == sorted(map(tuple, rows.collect()))
