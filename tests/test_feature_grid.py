"""The feature grid's sets and its grouped metrics."""

import random

import pytest

from stellate.operators import feature_grid, metrics


def test_grouped_agreement_equals_single_metrics(spark):
    rng = random.Random(2)
    rows = [(cell, rng.randrange(4), rng.randrange(2 + cell)) for cell in range(3) for _ in range(120)] + [(9, 1, 0)] * 5
    found = spark.createDataFrame(rows, "cell int, label_true int, label_pred int")
    got = {r.cell: (r.accuracy, r.nmi) for r in feature_grid.grouped_agreement(found, ["cell"]).collect()}
    assert set(got) == {0, 1, 2, 9} and got[9] == (1.0, 1.0)
    for cell in range(3):
        one = found.where(f"cell = {cell}")
        assert got[cell] == pytest.approx((metrics.accuracy(one).first()[0], metrics.nmi(one).first()[0]))


def test_sets_with_a_constant_score(spark):
    rows = spark.createDataFrame([(n, float(n), 1.0, 2.0, n / 7) for n in range(8)], "id long, x double, y double, flat double, slope double")
    f, sets = feature_grid.feature_sets(rows, ["x", "y"], ["flat", "slope"])
    first, last = f.orderBy("id").first(), f.orderBy("id").tail(1)[0]
    assert len(sets) == 9 and (first.s_flat, first.s_slope, last.s_slope, last.twice, last.total) == (0.0, 0.0, 1.0, 2.0, 3.0)
    assert (first.level, last.level, first.log_total, last.log_total) == (0.0, 1.0, 0.0, 1.0)


def test_grid_finds_clusters_that_only_the_score_tells(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(n, rng.random(), rng.random(), float(n % 2) + rng.random() / 100, n % 2) for n in range(80)], "id long, x double, y double, score double, label int")
    got = {(r.features, r.regularised): r.accuracy for r in feature_grid.grid(rows, ["x", "y"], ["score"], 2, rounds=3).collect()}
    assert len(got) == 18 and got["scores", False] == got["scaled sum", True] == 1.0


def test_clusterings_go_on_together_and_reruns_agree(spark):
    """One job a pass, not some thirty for each round of each clustering; groups far apart are found by every run that has their feature."""
    from stellate.operators.clusterings import clusterings

    rng = random.Random(7)
    rows = spark.createDataFrame([(n, n % 3 + rng.random() / 50, rng.random(), n % 3) for n in range(300)], "id long, x double, y double, label int")
    sets = {(name, reg): (cols, reg) for name, cols in (("x", ["x"]), ("y", ["y"]), ("xy", ["x", "y"])) for reg in (False, True)}
    spark.sparkContext.setJobGroup("passes", "passes")
    found = clusterings(rows, sets, 3, rounds=40)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes"))
    spark.sparkContext.setJobGroup("others", "others")
    assert jobs < 250  # 40 rounds of 30 jobs for 3 clusterings otherwise
    again = clusterings(rows.repartition(5), sets, 3, rounds=40)
    assert all((found[key][4] == again[key][4]).all() and (found[key][3] == again[key][3]).all() for key in sets)
    got = {r["set"]: r.accuracy for r in feature_grid.agreements(rows, {("x",): (["x"], False), ("y",): (["y"], False)}, ["set"], 3).collect()}
    assert got["x"] == 1.0 and got["y"] < 0.6


def test_a_start_with_fewer_places_than_clusters_and_a_round_seen_before(spark):
    from stellate.operators.clusterings import clusterings

    rows = spark.createDataFrame([(n, float(n % 2), 5.0) for n in range(40)], "id long, x double, flat double")
    found = clusterings(rows, {"few": (["x", "flat"], False), "flat": (["flat"], True)}, 6, rounds=30)
    assert sorted(found["few"][4].tolist()) == [[0.0, 5.0], [1.0, 5.0]]
    assert found["flat"][3].tolist() == [0.0] and found["flat"][4].tolist() == [[0.0]]  # a constant feature loses its weight
