"""Readers and writers."""

import struct

import pytest
from pyspark.sql import functions as F

from stellate.operators.graph_network import Layer
from stellate.sources import points, sinks


def test_point_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,0\n3,4,1\n")
    (tmp_path / "b.txt").write_text("1 2 0\n3,4  1\n\n")
    assert [(r.v, r.label) for r in points.read_csv_points(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [([1.0, 2.0], 0), ([3.0, 4.0], 1)]
    assert [(r.v, r.is_outlier) for r in points.read_outlier_points(spark, str(tmp_path / "b.txt")).orderBy("id").collect()] == [([1.0, 2.0], False), ([3.0, 4.0], True)]


def test_vectors_of_bytes(spark, tmp_path):
    (tmp_path / "x.bvecs").write_bytes(b"".join(struct.pack("<i3B", 3, *v) for v in ((1, 2, 3), (255, 0, 7))))
    assert [r.v for r in points.read_bvecs(spark, str(tmp_path / "x.bvecs")).orderBy("row").collect()] == [[1, 2, 3], [255, 0, 7]]


def test_vectors_of_bytes_in_splits(spark, tmp_path):
    import pytest

    rows = [[(n * 7 + k) % 256 for k in range(8)] for n in range(500)]
    (tmp_path / "a.bvecs").write_bytes(b"".join(struct.pack("<i8B", 8, *v) for v in rows))
    (tmp_path / "empty.bvecs").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = points.read_bvecs(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 5
        assert [(r.row, r.v) for r in got.orderBy("row").collect()] == list(enumerate(rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "cut.bvecs").write_bytes(struct.pack("<i3B", 4, 1, 2, 3))
    with pytest.raises(ValueError):
        points.read_bvecs(spark, str(tmp_path / "cut.bvecs"))


def test_problem_round_trip(spark, tmp_path):
    stops = "array(named_struct('node', 0, 'x', 0.5D, 'y', 0.5D, 'demand', 0), named_struct('node', 1, 'x', 0.25D, 'y', 0.75D, 'demand', 3))"
    sinks.write_problems(spark.sql(f"SELECT 'p' AS name, 20 AS capacity, {stops} AS stops"), str(tmp_path / "out"))
    got = points.read_problem(spark, str(tmp_path / "out")).orderBy("node").collect()
    assert [(r.capacity, r.node, r.x, r.y, r.demand) for r in got] == [(20, 0, 5000.0, 5000.0, 0), (20, 1, 2500.0, 7500.0, 3)]


def test_routing_files(spark, tmp_path):
    (tmp_path / "t.tour").write_text("NAME : t\nTOUR_SECTION\n1\n3\n5\n2\n-1\nEOF\n")
    (tmp_path / "r.sol").write_text("Route #1: 3 1\nRoute #2: 2\nCost 10\n")
    (tmp_path / "c.txt").write_text("1 500000 0 2 1000000 3\n0 500000 1 2 750000 0\n12.5\n")
    (tmp_path / "l.log").write_text("start\n-Trial 1: Cost = 100.5, Time = 0.2 sec\n-Trial 2: Cost = 99, Time = 0.5 sec\n")
    (tmp_path / "pred.txt").write_text("0.1000\n0.2500\n")
    assert [r.node for r in points.read_tour(spark, str(tmp_path / "t.tour"), 3).orderBy("pos").collect()] == [0, 2, 0, 1]
    assert [(r.route, r.nodes) for r in points.read_routes(spark, str(tmp_path / "r.sol")).orderBy("route").collect()] == [(1, [3, 1]), (2, [2])]
    assert [(r.i, r["rank"], r.j, r.d) for r in points.read_candidates(spark, str(tmp_path / "c.txt")).orderBy("i", "rank").collect()] == [(0, 0, 1, 0.5), (0, 1, 2, 1.0), (1, 0, 0, 0.5), (1, 1, 2, 0.75)]
    assert [(r.trial, r.objective) for r in points.read_trials(spark, str(tmp_path / "l.log")).orderBy("trial").collect()] == [(1, 100.5), (2, 99.0)]
    assert [r.score for r in points.read_predictions(spark, str(tmp_path / "pred.txt")).orderBy("id").collect()] == [0.1, 0.25]


def test_shards_and_scores(spark, tmp_path):
    for n in range(2):
        spark.range(3).write.parquet(str(tmp_path / "s" / f"100_u_part_{n}.parquet"))
    assert points.read_shards(spark, str(tmp_path / "s" / "*"), "*.parquet").count() == 6
    sinks.write_scores(spark.sql("SELECT 0.12345D AS score"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "0.1235" or spark.read.text(str(tmp_path / "o")).first()[0] == "0.1234"


def test_nested_tables(spark, tmp_path):
    spark.sql("SELECT 'a' AS dataset, id, array(double(id)) AS v, int(id % 2) AS y FROM range(4) UNION ALL SELECT 'b', id, array(0D), 0 FROM range(9)").write.parquet(str(tmp_path / "o"))
    assert [(r.dataset, r.id, r.is_outlier) for r in points.read_outlier_sets(spark, str(tmp_path / "o"), 5).orderBy("id").collect()] == [("a", n, n % 2 == 1) for n in range(4)]
    spark.sql("SELECT 1L AS problem, 9 AS capacity, array(0D, 1D, 2D) AS x, array(0D, 0D, 0D) AS y, array(0, 3, 4) AS demand, array(0, 1, 0) AS is_pickup, array(2D, 4D) AS distances, array(1, 0, 2, 0) AS routes").write.parquet(str(tmp_path / "p"))
    nodes, routes = points.read_nested_problems(spark, str(tmp_path / "p"))
    assert [(r.node, r.x, r.demand, r.is_pickup, r.capacity) for r in nodes.orderBy("node").collect()] == [(0, 0.0, 0, 0, 9), (1, 1.0, 3, 1, 9), (2, 2.0, 4, 0, 9)]
    assert [(r.nodes, r.distance) for r in routes.orderBy("route").collect()] == [([1], 2.0), ([2], 4.0)]


def test_logs_and_weights(spark, tmp_path):
    moves = spark.sql("SELECT 0L AS problem, 2L AS action, 1L AS next")
    logged = spark.sql("SELECT 0L AS seq, 0L AS problem, 2L AS action, 5L AS result")
    sinks.write_search_log(moves, logged, spark.sql("SELECT 5L AS result, 1.5D AS distance, array(1L, 0L) AS nodes"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log" / "results")).first() == (5, 1.5, [1, 0])
    layers = [Layer(*[[[float(n + p)]] for p in range(6)]) for n in range(2)]
    sinks.write_weights(spark, layers, [0.5], str(tmp_path / "w"))
    assert points.read_weights(spark, str(tmp_path / "w")) == (layers, [0.5])
    sinks.write_graph_features(spark.sql("SELECT 1 AS n, 0 AS i"), spark.sql("SELECT 1 AS n, 0 AS i, 0 AS j"), str(tmp_path / "g"), ["n"])
    assert [df.count() for df in points.read_graph_features(spark, str(tmp_path / "g"))] == [1, 1]


def test_solver_texts(spark, tmp_path):
    text = spark.range(1).select(sinks.tour_text(F.lit("t"), F.array(F.lit(0), F.lit(2), F.lit(1))).alias("tour"), sinks.routes_text(F.array(F.array(F.lit(3), F.lit(1)), F.array(F.lit(2))), F.lit(10)).alias("routes"), sinks.parameter_text({"RUNS": F.lit("1")}).alias("p")).first()
    (tmp_path / "t.tour").write_text(text.tour)
    (tmp_path / "r.sol").write_text(text.routes)
    assert [r.node for r in points.read_tour(spark, str(tmp_path / "t.tour"), 9).orderBy("pos").collect()] == [0, 2, 1]
    assert [r.nodes for r in points.read_routes(spark, str(tmp_path / "r.sol")).orderBy("route").collect()] == [[3, 1], [2]] and text.p == "RUNS = 1"


def test_problem_kinds(spark, tmp_path):
    stop = "named_struct('node', {n}, 'x', {x}, 'y', 0.5D, 'demand', {d}, {more})"
    timed = "array(" + ", ".join(stop.format(n=n, x=f"{n / 10}D", d=n, more=f"'window_start', {n}D, 'window_end', {n + 2}D") for n in (1, 0, 2)) + ")"
    mixed = "array(" + ", ".join(stop.format(n=n, x=f"{n / 10}D", d=d, more=f"'is_pickup', {n % 2}") for n, d in ((0, "0"), (1, "7"), (2, "5"), (3, "CAST(NULL AS INT)"))) + ")"
    for kind, stops in (("CVRPTW", timed), ("VRPMPD", mixed)):
        sinks.write_problems(spark.sql(f"SELECT 'a' AS name, 9 AS capacity, {stops} AS stops"), str(tmp_path / kind), kind)
    rows = points.read_full_problem(spark, str(tmp_path / "CVRPTW")).orderBy("node").collect()
    assert [(r.type, r.capacity, r.service_time, r.node, r.x, r.demand, r.window_start, r.window_end, r.is_pickup) for r in rows] == [("CVRPTW", 9, 0.0, n, n * 1000.0, n, n * 1e4, (n + 2) * 1e4, None) for n in range(3)]
    rows = points.read_full_problem(spark, str(tmp_path / "VRPMPD")).orderBy("node").collect()
    assert [(r.type, r.service_time, r.demand, r.is_pickup, r.window_start) for r in rows] == [("VRPMPD", None, d, p, None) for d, p in ((0, 0), (7, 1), (5, 0), (0, 0))]


def test_shards_that_cannot_be_read(spark, tmp_path):
    spark.sql("SELECT id, id AS a FROM range(3)").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.sql("SELECT id FROM range(2)").coalesce(1).write.parquet(str(tmp_path / "two"))
    (tmp_path / "s").mkdir()
    for n, name in enumerate(("one", "two")):
        next((tmp_path / name).glob("part*")).rename(tmp_path / "s" / f"100_u_part_{n}.parquet")
    (tmp_path / "s" / "100_u_part_2.parquet").write_bytes(b"no parquet at all, but long enough for a footer")
    report = {r.file.rsplit("_", 1)[1]: (r.rows, r.lacking) for r in points.shard_report(spark, str(tmp_path / "s")).collect()}
    assert report["2.parquet"][0] == 0 and report["0.parquet"] == (3, []) and report["1.parquet"] in ((2, ["a"]), (2, []))
    assert points.read_shards(spark, str(tmp_path / "s"), lenient=True).count() == 5
    with pytest.raises(Exception, match="(?i)parquet"):
        points.read_shards(spark, str(tmp_path / "s")).count()


def test_candidates_with_their_runtime(spark, tmp_path):
    (tmp_path / "c").write_text("1 2000000 0 2 500000 1\n0 2000000 3\n12.5\n")
    assert [(r.i, r["rank"], r.j, r.d, r.inverse) for r in points.read_candidates(spark, str(tmp_path / "c")).orderBy("i", "rank").collect()] == [(0, 0, 1, 2.0, 0), (0, 1, 2, 0.5, 1), (1, 0, 0, 2.0, 3)]
    assert points.read_candidate_runtime(spark, str(tmp_path / "c")).first().seconds == 12.5
