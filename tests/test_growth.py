"""Operators that go beyond one task: division of trees, joins in many dimensions, descents over cells, swaps, order statistics."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stellate.plans.storage import written
from stellate.operators import cells, centres, density_clustering, division, metrics, neighbors, order, outliers, routes, spaces, swaps, trees


def _uniform(seed, value):
    return (int(hashlib.md5(f"{value}:{seed}".encode()).hexdigest()[:10], 16) + 1) / float(1 << 40)


@pytest.fixture(scope="module")
def cloud(spark):
    """Clusters, copies and far points; 400 points with ids in no order of place."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(c, 0.05, (80, 2)) for c in ((0, 0), (1, 1), (3, 0))] + [np.full((100, 2), 0.25), rng.uniform(-2, 4, (60, 2))])
    frame = pd.DataFrame({"id": rng.permutation(len(xy)).astype("int64"), "x": xy[:, 0], "y": xy[:, 1]})
    return frame, spark.createDataFrame(frame).repartition(5).cache()


def _brute(frame, cols):
    m = frame[cols].to_numpy()
    return np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2)), frame["id"].to_numpy()


def test_counts_within_and_farthest(cloud):
    frame, points = cloud
    d, ids = _brute(frame, ["x", "y"])
    got = {r.id: (r.n0, r.n1) for r in cells.counts_within(points, [0.3, 1.1]).collect()}
    assert got == {int(i): (int((row <= 0.3).sum()), int((row <= 1.1).sum())) for i, row in zip(ids, d, strict=True)}
    far = cells.farthest(points, 4).toPandas()
    for i, row in zip(ids, d, strict=True):
        want = sorted((-v, int(j)) for v, j in zip(row, ids, strict=True) if j != i)[:4]
        assert far[far.i == i].sort_values("rank")["j"].tolist() == [j for _, j in want]


def test_farthest_on_a_ring_needs_no_nested_loop(spark):
    rows = [(n, math.cos(n * math.tau / 301), math.sin(n * math.tau / 301)) for n in range(301)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    found = neighbors.k_farthest(points, 2, 0.0)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    frame = pd.DataFrame(rows, columns=["id", "x", "y"])
    d, ids = _brute(frame, ["x", "y"])
    far = cells.farthest(points, 2).toPandas()
    assert {int(i): sorted(round(v, 9) for v in far[far.i == i]["d"]) for i in ids} == {int(i): sorted(round(v, 9) for v in np.sort(row)[-2:]) for i, row in zip(ids, d, strict=True)}


def test_few_pairs_meet_when_counting(spark, monkeypatch):
    """Pairs of points that meet, against all pairs."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame(pd.DataFrame({"id": range(4000), "x": rng.uniform(0, 1, 4000), "y": rng.uniform(0, 1, 4000)}))
    met, real = [], cells._children
    monkeypatch.setattr(cells, "_children", lambda *a: met.append(real(*a)) or met[-1])
    cells.counts_within(points, [0.25]).count()
    last = met[-1].where(cells._least() <= 0.25).where(cells._most() > 0.25).agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0]
    assert last < 0.25 * 4000**2


def test_places_travel_once_to_each_home(spark, monkeypatch):
    """A dense spot, a cloud and copies: counted places come out of the tasks once a level, without another shuffle."""
    rng = np.random.default_rng(16)
    xy = np.concatenate([rng.uniform(0, 1, (2500, 2)), rng.normal(0.5, 1e-4, (700, 2)), np.full((50, 2), 0.25)])
    points = spark.createDataFrame(pd.DataFrame({"id": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})).repartition(3)
    near, real = [], cells.written
    monkeypatch.setattr(cells, "written", lambda df, name: near.append(df) or real(df, name) if name == "near" else real(df, name))
    radii = [0.3, 1e-4, 0.05]
    got = {r.id: tuple(r)[1:] for r in cells.counts_within(points, radii).collect()}
    d = np.sqrt(((xy[:, None, :] - xy) ** 2).sum(2))
    assert got == {n: tuple(int(c) for c in row) for n, row in enumerate(np.array([(d <= r).sum(1) for r in radii]).T)}
    for df in near:
        assert df.groupBy("x", "y").count().where("count > 1").isEmpty()
        assert "hashpartitioning(x" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(a_cell" not in plan
    assert len(near) > 1 and sum(df.count() for df in near) > 2500


@pytest.mark.parametrize("d", [2, 7])
def test_joins_in_many_dimensions(spark, d):
    rng = np.random.default_rng(d)
    m = np.concatenate([rng.normal(c, 0.1, (60, d)) for c in range(4)] + [np.zeros((50, d)), rng.uniform(-1, 4, (40, d))])
    frame = pd.DataFrame({"id": rng.permutation(len(m)).astype("int64"), "v": m.tolist()})
    points = spark.createDataFrame(frame).repartition(3)
    ids = frame["id"].to_numpy()
    dist = spaces.distances(m, m)
    for size in (16, 500):
        knn = spaces.knn_graph(points, 6, pivots=5, size=size).toPandas()
        near = spaces.within(points, 0.4, pivots=5, size=size).toPandas()
        for i, row in zip(ids, dist, strict=True):
            want = sorted((v, int(j)) for v, j in zip(row, ids, strict=True) if j != i)[:6]
            assert knn[knn.i == i].sort_values("rank")["j"].tolist() == [j for _, j in want]
        assert sorted(zip(near.i, near.j, strict=True)) == sorted((int(a), int(b)) for a, row in zip(ids, dist, strict=True) for b, v in zip(ids, row, strict=True) if v <= 0.4)
    at = spaces.pivots_of(points, 5)
    packed = spaces.packed(points, at, 16)
    assert spaces.part_pairs(packed, packed, 6, None).count() < 0.8 * packed.count() ** 2  # parts of far clusters don't meet
    centres_ = [(7, m[0].tolist()), (9, m[100].tolist()), (3, m[0].tolist())]
    got = {r.id: (r.centre, r.d1, r.d2) for r in spaces.nearest_centre(points, centres_).collect()}
    for n, i in enumerate(ids):
        a, b = dist[n, 0], dist[n, 100]
        assert got[i] == pytest.approx((7 if a <= b else 9, min(a, b), sorted((a, a, b))[1]))


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [0.0, 0.0]), (6, [])], "id long, v array<double>")
    v = spaces.vectors(rows)
    assert v.count() == 4
    got = spaces.nearest(v.where("id < 3"), v.where("id < 3"), 2).orderBy("i", "rank").collect()
    assert [(r.i, r.j, r.d) for r in got] == [(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    assert spaces.knn_graph(v.limit(0), 3).count() == 0


def _tree(frame):
    nodes = {r.node_id: r for r in frame.itertuples()}
    kids = {}
    for r in frame.itertuples():
        if not pd.isna(r.parent_id):
            kids.setdefault(int(r.parent_id), []).append(r.node_id)
    return nodes, kids


@pytest.mark.parametrize("block", [40, 1000])
def test_divided_trees_hold_together(spark, cloud, monkeypatch, block):
    frame, points = cloud
    edges = neighbors.gap_adjacency(points, 4, 0.2).withColumn("graph_id", F.lit(3).cast("long"))
    rows = trees.as_vectors(points.withColumn("graph_id", F.lit(3)))
    tree = division.joined_trees(rows, edges, 2, block).toPandas()
    nodes, kids = _tree(tree)
    assert sorted(tree["point_id"].dropna().astype(int)) == sorted(frame["id"]) and len(nodes) == len(tree)
    assert tree["parent_id"].isna().sum() == 1
    e = edges.toPandas()
    vol = e.groupby("i")["w"].sum().to_dict()
    under = {}

    def leaves(n):
        if n not in under:
            under[n] = {int(nodes[n].point_id)} if n not in kids else set().union(*map(leaves, kids[n]))
        return under[n]

    import sys

    sys.setrecursionlimit(10_000)
    for n, r in nodes.items():
        own = leaves(n)
        assert (n in kids) == pd.isna(r.point_id)
        assert r.vol == pytest.approx(sum(vol.get(p, 0.0) for p in own), abs=1e-9)
        assert r.g == pytest.approx(sum(w for i, j, w in zip(e.i, e.j, e.w, strict=True) if i in own and j not in own), abs=1e-9)
        assert len(kids.get(n, [])) <= max(block, len(frame) if block > len(frame) else 0)
    if block == 1000:
        plain = trees.tree_entropy(trees.encoding_trees(edges, 2)).first().entropy
        total = next(r.vol for r in nodes.values() if pd.isna(r.parent_id))
        assert plain == pytest.approx(sum(-r.g / total * math.log2(r.vol / nodes[int(r.parent_id)].vol) for r in nodes.values() if not pd.isna(r.parent_id)))


def test_no_group_exceeds_the_block(spark, cloud, monkeypatch):
    """Copies of one place included; weights that differ by direction count as their mean."""
    sizes, real = [], division.part_edges
    monkeypatch.setattr(division, "part_edges", lambda edges, members: sizes.append(members.groupBy("part").agg(F.countDistinct("label").alias("n")).agg(F.max("n")).first()[0]) or real(edges, members))
    _, points = cloud
    edges = neighbors.gap_adjacency(points, 4, 0.2).withColumn("graph_id", F.lit(0).cast("long"))
    weighted = edges.withColumn("w", F.col("w") * (1 + F.col("i") % 3))
    tree = division.joined_trees(trees.as_vectors(points), weighted, 2, 12)
    assert tree.where("point_id is not null").count() == 400 and max(sizes) < 12 and len(sizes) > 2
    assert [n["vol"] for n in trees.build([(1, 2, 1.0), (2, 1, 3.0)], [1, 2], 1) if n["parent_id"] is None] == [pytest.approx(4.0)]


def _places(n, seed, copies=0):
    r = random.Random(seed)
    rows = [(i, r.random(), r.random(), r.randrange(1, 5)) for i in range(n)]
    return rows + [(n, 0.9, 0.9, copies)] * bool(copies)


def _cost(rows, centres_):
    return sum(w * min((x - cx) ** 2 + (y - cy) ** 2 for _, cx, cy in centres_) for _, x, y, w in rows)


def test_swaps_equal_brute_force(spark):
    rows = _places(60, 8, 1000)
    points = spark.createDataFrame(rows, "id long, x double, y double, weight long")
    current = [(c, x, y) for c, (_, x, y, _) in enumerate(rows[:5])]
    trials = [[(0.5, 0.5)], [(0.1, 0.2), (0.8, 0.7)], [(0.1, 0.2), (0.8, 0.7), (0.3, 0.9)]]
    sums = swaps.swap_sums(swaps.near_lists(points, current, 4), trials)
    for n, trial in enumerate(trials):
        base, by = sums[n]
        costs = {}
        for out in itertools.combinations(range(5), len(trial)):
            costs[out] = base + sum(by.get(p, 0.0) for m in range(1, len(out) + 1) for p in itertools.combinations(out, m))
            assert costs[out] == pytest.approx(_cost(rows, swaps.replaced(current, out, trial)))
        assert swaps.best_swap(list(range(5)), len(trial), base, by)[0] == pytest.approx(min(costs.values()))
    lists = swaps.near_lists(points, current, 3)
    after = swaps.replaced(current, (1, 3), trials[1])
    got, want = swaps.renewed(lists, after, {1, 3}, 3), swaps.near_lists(points, after, 3)
    assert sorted(map(str, got.select("id", "near").collect())) == sorted(map(str, want.select("id", "near").collect()))


def test_local_search_equals_one_round_at_a_time(spark):
    rows = _places(50, 9, 300)
    points = spark.createDataFrame(rows, "id long, x double, y double, weight long")
    k, rounds, seed = 4, 60, 3
    found, cost = swaps.local_search(points, k, rounds, seed, ahead=8)
    current = [(n, x, y) for n, (_, x, y) in enumerate(centres.k_center_greedy(points, k)[0])]
    now = _cost(rows, current)
    for t in range(rounds):
        share = [(i, x, y, w * min((x - a) ** 2 + (y - b) ** 2 for _, a, b in current)) for i, x, y, w in rows]
        _, _, x, y = min((-math.log(_uniform(seed * 1_000_003 + t, i)) / s, i, x, y) for i, x, y, s in share if s > 0)
        best = min((_cost(rows, swaps.replaced(current, (c,), [(x, y)])), c) for c, _, _ in current)
        if best[0] < (1 - 1 / (100 * k)) * now:
            now, current = best[0], swaps.replaced(current, (best[1],), [(x, y)])
    while True:  # means, moved to the nearest points
        near = [min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b in current)[1] for _, x, y, _ in rows]
        moved = []
        for c, a, b in current:
            own = [r for r, n in zip(rows, near, strict=True) if n == c]
            if own:
                total = sum(r[3] for r in own)
                a, b = sum(r[1] * r[3] for r in own) / total, sum(r[2] * r[3] for r in own) / total
                _, _, a, b = min(((x - a) ** 2 + (y - b) ** 2, i, x, y) for i, x, y, _ in rows)
            moved.append((c, a, b))
        if _cost(rows, moved) >= now:
            break
        now, current = _cost(rows, moved), moved
    assert found == current and cost == pytest.approx(now)
    assert swaps.local_search(points.limit(0), 3) == ([], 0.0)


def test_multi_swap_search_finds_the_heavy_place(spark):
    rows = _places(40, 10, 1000)
    points = spark.createDataFrame(rows, "id long, x double, y double, weight long")
    found, cost = swaps.multi_swap_search(points, 4, rounds=30, patience=1)
    assert (0.9, 0.9) in {(x, y) for _, x, y in found} and cost == pytest.approx(_cost(rows, found))
    _, single = swaps.local_search(points, 4, 30)
    assert cost <= single * 1.2
    same = min((_cost(rows, c), c) for c in [[(n, *rows[i][1:3]) for n, i in enumerate(pick)] for pick in itertools.combinations(range(41), 2)])
    assert swaps.multi_swap_search(points, 2, rounds=60, patience=2)[1] == pytest.approx(same[0])


def test_reachability_of_long_chains(spark, monkeypatch):
    n = 3000
    rng = random.Random(4)
    names = rng.sample(range(10 * n), n)
    nodes = spark.createDataFrame([(i,) for i in names], "id long")
    chain = spark.createDataFrame(list(itertools.pairwise(names)), "i long, j long")
    writes, real = [], density_clustering.written
    monkeypatch.setattr(density_clustering, "written", lambda df, name: writes.append(name) or real(df, name))
    got = {r.id: r.root for r in density_clustering.reachable_min(nodes, chain).collect()}
    assert got == dict(zip(names, itertools.accumulate(names, min), strict=True)) and writes.count("pointers") < 30


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_equals_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    nodes = range(60)
    want = {}
    for root in reversed(nodes):
        todo, seen = [root], {root}
        while todo:
            at = todo.pop()
            new = {j for i, j in edges if i == at} - seen
            seen |= new
            todo += new
        want |= dict.fromkeys(seen, root)
    got = density_clustering.reachable_min(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "i long, j long"))
    assert {r.id: r.root for r in got.collect()} == want


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice([0.0, 0.5, rng.random(), None])) for _ in range(500)] + [(9, None), (8, 1.5)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: (r.a, r.b, r.c) for r in order.quantiles(df, ["g"], "v", {"a": 0.3, "b": 0.5, "c": 1.0}).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    want = {g: tuple(np.quantile(x["v"], [0.3, 0.5, 1.0])) for g, x in frame.groupby("g")}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got)
    assert order.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(frame["v"].median())
    assert order.kth(df, "v", 7) == sorted(frame["v"])[7] and order.kth(df, "v", 10_000) is None


def test_medoids_equal_all_pairs(spark, cloud, monkeypatch):
    monkeypatch.setattr(centres, "CANDIDATES", 5)
    frame, points = cloud
    own = points.withColumn("centre", (F.col("x") > 0.6).cast("int")).select("id", "x", "y", "centre")
    got = centres.medoids(own)
    for c, part in frame.assign(c=(frame.x > 0.6).astype(int)).groupby("c"):
        d, ids = _brute(part, ["x", "y"])
        best = min(zip(np.round(d.sum(1), 9), ids, strict=True))[1]
        assert got[c] == tuple(part[part.id == best][["x", "y"]].iloc[0])


def test_neighbours_within_many_groups(spark):
    """2,000 graphs of 11 points of different extents, and some of a single point."""
    rng = np.random.default_rng(8)
    n = 2000
    frame = pd.DataFrame({"id": range(n * 11), "g": np.repeat(np.arange(n), 11), "x": rng.uniform(0, 1, n * 11), "y": rng.uniform(0, 1, n * 11)})
    frame["x"] *= 10.0 ** (frame["g"] % 5)
    frame = pd.concat([frame, pd.DataFrame({"id": range(10**6, 10**6 + 5), "g": range(10**4, 10**4 + 5), "x": 1.0, "y": 1.0})])
    knn = neighbors.knn_graph(spark.createDataFrame(frame), 3, "g").toPandas()
    assert len(knn) == n * 33
    for g in (0, 1, 777, 1999):
        part = frame[frame.g == g]
        d, ids = _brute(part, ["x", "y"])
        for i, row in zip(ids, d, strict=True):
            assert knn[knn.i == i].sort_values("rank")["j"].tolist() == [j for _, j in sorted((v, j) for v, j in zip(row, ids, strict=True) if j != i)[:3]]


def test_outlier_grid(spark):
    rng = np.random.default_rng(12)
    m = np.concatenate([rng.normal(0, 0.3, (150, 4)), rng.normal(4, 0.3, (150, 4)), rng.uniform(-9, 13, (15, 4))])
    points = spark.createDataFrame(pd.DataFrame({"id": range(len(m)), "v": m.tolist(), "is_outlier": [False] * 300 + [True] * 15}))
    grid = outliers.outlier_grid(points, 60, [4, 6], [2], [1.0, 2.0], top=15, block=32).toPandas()
    assert sorted(zip(grid["ne"], grid["depth"], grid["gap"], strict=True)) == [(4, 2, 1.0), (4, 2, 2.0), (6, 2, 1.0), (6, 2, 2.0)]
    assert grid[["precision", "recall", "f1", "auc", "average_precision"]].stack().between(0, 1).all()


def test_grouped_ranking_equals_single(spark):
    rng = random.Random(6)
    rows = [(g, n, rng.random() < 0.3, float(rng.randrange(4 if g else 1000))) for g in range(3) for n in range(120)]
    df = spark.createDataFrame(rows, "g int, id long, positive boolean, score double").repartition(5)
    for r in metrics.grouped_ranking(df, ["g"], 25).collect():
        own = df.where(F.col("g") == r.g)
        p = metrics.top_z(own, 25).first()
        assert (r.precision, r.recall, r.f1) == pytest.approx((p.precision, p.recall, p.f1))
        assert r.auc == pytest.approx(metrics.roc_auc(own).first().auc) and r.average_precision == pytest.approx(metrics.average_precision(own).first().average_precision)


def test_no_percentile_buffers():
    import pathlib

    assert not [p for p in pathlib.Path(order.__file__).parent.glob("*.py") if "F.percentile" in p.read_text()]
    assert routes.quantiles is order.quantiles


def test_replay_of_logs_with_cycles_and_several_ways(spark):
    from stellate.operators import search

    moves = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 3), (3, 5, 0), (3, 6, 4), (0, 2, 1), (3, 7, 3)], "problem long, action long, next long")
    got = sorted((r.problem, r.parent, r.action, r.depth) for r in search.replay(moves, 50).fillna(-1).collect())
    assert got == [(0, -1, -1, 0), (1, 0, 0, 1), (2, 0, 1, 1), (3, 1, 0, 2), (4, 3, 6, 3)]


def test_numbers_of_wide_rows(spark):
    """The ranges of a table of wide rows and those of its keys alone are merged in different ways."""
    from stellate.operators import sampling

    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(key, "64k")
    try:
        wide = spark.range(4000).select("id", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.md5(F.concat(k.cast("string"), F.lit("-"), F.col("id").cast("string")))).alias("v"))
        got = sampling.numbered(wide, "id").toPandas()
    finally:
        spark.conf.unset(key)
    assert len(got) == 4000 and (got.id == got.n).all()


def test_distances_are_summed_in_order():
    """Component by component, as SQL's list_sum() does: a distance on the border is the same everywhere, and copies have one distance."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(40, 64))
    want = np.sqrt(np.cumsum(np.square(a[:, None, :] - b[None, :, :]), axis=2)[:, :, -1])
    assert (spaces.distances(a, b) == want).all()
    r, c, d = spaces._near(a, b, np.full(50, np.inf))
    assert len(r) == 2000 and (d == want[r, c]).all()


def test_density_clustering_writes_no_pairs(spark, monkeypatch):
    """200 points within one radius have 40,000 pairs; far fewer rows may be written, and all are one cluster, with the same labels for all three kinds."""
    rows = []
    monkeypatch.setattr(density_clustering, "written", lambda df, name: (lambda out: (rows.append(out.count()), out)[1])(written(df, name)))
    points = spark.range(200).select("id", (F.col("id") % 20 / 1000).alias("x"), (F.floor(F.col("id") / 20) / 1000).alias("y"), F.lit(0.05).alias("radius"), F.lit(0.5).alias("density"))
    points = points.union(spark.createDataFrame([(500, 0.9, 0.9, 0.05, 0.5)], points.schema))
    for found in (density_clustering.dbscan(points, 0.05, 4), density_clustering.adaptive_dbscan(points, 0.04, 0.06, 4), density_clustering.variable_eps_dbscan(points, 4)):
        assert {(r.id, r.cluster) for r in found.collect()} == {(n, 0) for n in range(200)} | {(500, -1)}
    assert max(rows) <= 201


def _joined_rows(spark, since):
    """The most rows that came out of a join since so many executions."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for n in range(since, store.executionsCount()):
        number = store.executionsList().apply(n).executionId()
        found, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for at in range(nodes.size()):
            node = nodes.apply(at)
            for m in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and found.contains(metric.accumulatorId()):
                    most = max(most, int(found.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_density_clustering_makes_no_pairs_of_near_points(spark):
    """2,000 points within one radius have 4 million pairs, and as many points of no radius of their own lie in reach of each: joins give far fewer rows."""
    points = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10000).alias("x"), (F.col("id") / 40000).alias("y"), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.0).alias("radius"))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = density_clustering.variable_eps_dbscan(points, 5)
    assert [tuple(r) for r in found.groupBy("cluster").count().collect()] == [(0, 4000)]
    assert 0 < _joined_rows(spark, since) <= 400_000


def test_clusters_by_squares_equal_the_definitions(spark, monkeypatch):
    """Copies, distances on the border, radii of 0 and below, of many levels or beyond all, places that are none; squares are cut down to single places."""
    from stellate.operators import squares

    monkeypatch.setattr(squares, "SMALL", 1)
    rng = np.random.default_rng(1)
    parts = [
        (rng.random((60, 2)), rng.choice([0.0, 0.02, 0.1, 0.5, 1.5], 60)),
        (np.round(rng.random((50, 2)), 1), rng.choice([0.0, 0.1, 0.2, -1.0], 50)),
        (rng.normal(size=(60, 2)) * 0.01, np.exp(rng.normal(size=60) * 1.5 - 4)),
        (rng.random((40, 2)) * 1e-9, rng.choice([1e-13, 1e-11, 2e-10, 1e-9], 40)),
        (rng.random((40, 2)), rng.choice([0.03, 3.0], 40, p=[0.95, 0.05])),
        (np.repeat(rng.random((10, 2)), 4, 0), rng.choice([0, 0.3], 40)),
    ]
    rows = np.concatenate([np.c_[xy + [100.0 * n, 0], r] for n, (xy, r) in enumerate(parts)])[rng.permutation(290)]
    nowhere = [(290, None, 0.5, 0.1, 0.5), (291, math.nan, 0.5, 0.1, 0.5), (292, 0.5, math.inf, 0.1, 0.5)]
    points = spark.createDataFrame([(n, *map(float, row), float(1 - row[2])) for n, row in enumerate(rows)] + nowhere, "id long, x double, y double, radius double, density double")
    d = np.sqrt(np.square(rows[:, None, :2] - rows[None, :, :2]).sum(2))
    clusters = lambda df: [r.cluster for r in df.orderBy("id").collect()]

    near = d <= rows[:, 2][:, None]  # j is near i
    core, root = near.sum(1) >= 4, np.arange(290)
    for _ in range(290):
        root = np.array([min([root[j], *root[core & near[:, j]]]) if core[j] else j for j in range(290)])
    takers = [[root[i] for i in np.flatnonzero(core & near[:, j]) if root[i] < j or root[i] == i] for j in range(290)]
    of = {r: n for n, r in enumerate(sorted(set(root[core].tolist())))}
    assert clusters(density_clustering.variable_eps_dbscan(points, 4)) == [of[root[j]] if core[j] else of[min(takers[j])] if takers[j] else -1 for j in range(290)] + [-1] * 3

    r = 1 - (1 - rows[:, 2])
    near = d <= np.minimum(r[:, None], r)
    core, root = near.sum(1) >= 4, np.arange(290)
    for _ in range(290):
        root = np.array([root[core & near[j]].min() if core[j] else j for j in range(290)])
    of = {n: k for k, n in enumerate(sorted(set(root[core].tolist())))}
    want = [of[root[core & near[j]].min()] if (core & near[j]).any() else -1 for j in range(290)]
    assert clusters(density_clustering.adaptive_dbscan(points, 0.0, 1.0, 4)) == want + [-1] * 3


def test_blocks_draw_and_cost_as_spark_does(spark):
    """What multi_swap_search does in blocks equals the same steps as aggregations."""
    from stellate.operators import blocks, draws

    rows = _places(70, 12, 50)
    points = spark.createDataFrame(rows, "id long, x double, y double, weight long").repartition(3)
    held = blocks.Blocks(points, ["x", "y", "weight"])
    ids = np.array([r[0] for r in rows])
    assert dict(zip(ids.tolist(), next(blocks.uniform([77], ids)).tolist(), strict=True)) == {r.id: r.u for r in points.select("id", draws.uniform(77, "id").alias("u")).collect()}
    current = [(c, x, y) for c, (_, x, y, _) in enumerate(rows[:5])]
    trials = [[(0.5, 0.5)], [(0.1, 0.2), (0.8, 0.7)], [(0.1, 0.2), (0.8, 0.7), (0.3, 0.9)]]
    want, got = swaps.swap_sums(swaps.near_lists(points, current, 4), trials), swaps.block_sums(held, current, trials)
    for n, (base, by) in enumerate(got):
        assert base == pytest.approx(want[n][0]) and by == pytest.approx(want[n][1], abs=1e-12)
    got_steps, want_steps = swaps.block_steps(held, current, math.inf), swaps.snapped_steps(points, current, math.inf)
    assert got_steps[0] == want_steps[0] and got_steps[1] == pytest.approx(want_steps[1])
    near = swaps.block_near(held, np.array([(x, y) for _, x, y in current]), 6)
    assert sorted((c, p[1]) for c, some in enumerate(near) for p in some) == sorted((r.c, r.id) for r in swaps._near_points(points, current, 6))
    few = swaps.block_sums(held, current[:1], [[(0.5, 0.5)]])[0]
    assert few[0] + few[1][0,] == pytest.approx(_cost(rows, [(0, 0.5, 0.5)]))
    held.close()


def test_cutoff_density_makes_no_pairs_of_points(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    found = density_clustering.cutoff_density(rows, 0.5)
    assert "cx" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs of points in neighbouring cells: 18 million here
    assert [tuple(r) for r in found.groupBy("rho").count().collect()] == [(2999, 6000)]


def test_counts_meet_as_arrays_also_where_a_smallest_cell_holds_many_places(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(n, rng.random() * 1e-9, rng.random() * 1e-9) for n in range(300)] + [(300 + n, rng.random(), rng.random()) for n in range(300)] + [(600, 1.0, 1.0)]
    monkeypatch.setattr(cells, "NEAR", 40)
    packed = []
    real = cells._near_counts
    monkeypatch.setattr(cells, "_near_counts", lambda *a: packed.append(1) or real(*a))
    radii = [5e-10, 0.2]
    got = {r.id: (r.n0, r.n1) for r in cells.counts_within(spark.createDataFrame(rows, "id long, x double, y double"), radii).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    assert packed and got == {n: tuple(int((d[n] <= r).sum()) for r in radii) for n in range(601)}


def test_medoids_of_copies_rings_and_far_points(spark, monkeypatch):
    """Equal sums, more candidates than a pass takes, and points so far away that all others share a few cells."""
    monkeypatch.setattr(centres, "CANDIDATES", 4)
    rng = np.random.default_rng(12)
    angle = 2 * np.pi * np.arange(40) / 40
    parts = [np.stack([np.cos(angle), np.sin(angle)], 1), np.repeat(rng.uniform(0, 1, (7, 2)), 30, axis=0), np.concatenate([rng.normal(0, 1e-3, (300, 2)), [[1e6, 1e6], [-1e6, 3e5]]])]
    frame = pd.DataFrame(np.concatenate(parts), columns=["x", "y"])
    frame["centre"] = np.repeat([2, 5, 9], [len(p) for p in parts])
    frame["id"] = rng.permutation(len(frame))
    got = centres.medoids(spark.createDataFrame(frame))
    for c, part in frame.groupby("centre"):
        d, ids = _brute(part, ["x", "y"])
        assert got[c] == tuple(part[part.id == min(zip(np.round(d.sum(1), 9), ids, strict=True))[1]][["x", "y"]].iloc[0])


def test_medoids_take_few_jobs(spark, cloud):
    _, points = cloud
    spark.sparkContext.setJobGroup("medoids", "medoids")
    centres.k_medoids(points.withColumn("score", F.col("x")), 3, steps=4)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("medoids")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10 + 8 * 4


def test_clusters_of_parts_take_tasks_by_their_points(spark):
    points = spark.range(20_000, numPartitions=1).select(F.lit(1).cast("long").alias("part"), "id", F.array(F.rand(1), F.rand(2)).alias("v"))
    spark.sparkContext.setJobGroup("clusters", "clusters")
    found = division.grouped_clusters(points, 20, steps=1).toPandas()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("clusters") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 20_000 and found["label"].nunique() == 20
    assert max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) >= 9


def test_flat_parts_are_summed(spark):
    rows = [(7, 1, 2, 0.5, False), (7, 2, 1, 0.5, False), (7, 1, 1, 2.0, False), (7, 1, 1, 0.25, True), (7, 2, 2, 0.0, False), (8, 5, 5, 0.0, False)]
    got = sorted(map(tuple, division.flat_trees(spark.createDataFrame(rows, "part long, a long, b long, w double, leaves boolean")).select("part", "n", "up", "vol", "g", "label").collect()))
    assert got == [(7, 0, None, 3.25, 0.25, None), (7, 1, 0, 2.75, 0.75, 1), (7, 2, 0, 0.5, 0.5, 2), (8, 0, None, 0.0, 0.0, None), (8, 1, 0, 0.0, 0.0, 5)]
