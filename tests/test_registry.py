"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from stellate.plans import registry


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert sum(r.n for r in __spark_entry__.entry(spark).collect()) == 500


@pytest.mark.parametrize("name", ["zone_histogram", "inverse_edges", "k_farthest", "own_range_counts", "size_density_diameter", "fringe_score", "core_point_score", "cluster_accuracy", "ari", "roc_auc", "point_level_entropy", "variable_eps_dbscan", "density_peaks", "k_center_greedy", "coverage", "route_features", "packed_routes", "smallest_gap", "city_block_routes", "node_features", "padded_routes", "beam_top", "search_replay", "replayed_routes", "replayed_labels", "sampled_clusters", "window_problem_files", "pickup_problem_files", "fringe_score_lloyd", "true_zones_lloyd", "action_labels", "trial_comparison", "renumbered_tree", "level_order", "weighted_graph", "block_graph", "generated_tours", "problem_files", "weighted_sample", "poisson_sample", "d2_seeding", "knn_64d", "range_counts_64d", "nearest_centre_64d", "coreset_64d", "swap_costs_pairs", "ranking_grid", "density_score", "distance_quantiles", "subproblem_features", "route_clusters"])
def test_query_equals_sql(spark, db, data, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), db.sql(registry.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(map(str, got[cols].astype(object).values.tolist())) == sorted(map(str, want[cols].astype(object).values.tolist()))
