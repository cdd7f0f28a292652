"""Replay of search logs with their routes, against a replay in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stellate.operators import search
from stellate.plans.storage import written

NEAR, NODES = 3, 9


def _cluster(routes, places, action):
    centre = [tuple(sum(places[v][k] for v in r) / len(r) for k in (0, 1)) for r in routes]
    order = sorted(range(len(routes)), key=lambda n: (math.dist(centre[action], centre[n]), n))[:NEAR]
    held, out = 0, []
    for n in order:
        held += len(routes[n])
        if held > NODES:
            break
        out.append(n)
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    places = {v: (rng.random(), rng.random()) for v in range(1, 25)}
    first = [list(range(n, n + 3)) for n in range(1, 25, 3)]
    moves = [(0, 1, 1), (0, 4, 2), (1, 0, 3), (1, 0, 3), (2, 2, 4), (3, 5, 5), (5, 1, 0), (4, 99, 6), (0, 7, 8), (8, 1, 3), (2, 3, 5)]  # copies, a cycle, no route 99, problem 5 by two ways
    actions = [(n, p, a, (p * 3 + a) % 4) for n, (p, a, _) in enumerate(moves)] + [(50, 0, 4, 3), (51, 0, 7, 77)]  # a later entry counts; result 77 doesn't exist
    results = [(r, float(r), [v for k in range(1, 11) for v in ([k * (r + 1) % 11] + ([0] if k % 3 == 2 else []))]) for r in range(4)]
    return places, first, moves, actions, results


def _replay(places, first, moves, actions, results, depth):
    kept = {(p, a): r for _, p, a, r in actions}
    packed = {r: nodes for r, _, nodes in results}
    found, visits, last = {0: (0, None, None, first)}, {0: dict.fromkeys(places, 0)}, {0}
    for n in range(1, depth + 1):
        reached = {}
        for p, a, q in sorted(moves):
            if p in last and q not in found and a < len(found[p][3]) and kept.get((p, a)) in packed:
                reached.setdefault(q, (p, a))
        for q, (p, a) in reached.items():
            routes = found[p][3]
            gone = _cluster(routes, places, a)
            nodes = sorted(v for g in gone for v in routes[g])
            new, one = [], []
            for v in [*packed[kept[p, a]], 0]:
                if v == 0:
                    new += [one] if one else []
                    one = []
                elif v <= len(nodes):
                    one.append(nodes[v - 1])
            left = [v for r in new for v in r]
            found[q] = (n, p, a, [r for k, r in enumerate(routes) if k not in gone] + new)
            visits[q] = {v: visits[p][v] + (v in left) for v in visits[p]}
        last = set(reached)
    return found, visits


def _frames(spark, first, places, moves, actions, results):
    stops = [(n, k, v, *places[v]) for n, r in enumerate(first) for k, v in enumerate(r)]
    return (spark.createDataFrame(moves, "problem long, action long, next long"), spark.createDataFrame(actions, "seq long, problem long, action long, result long"),
            spark.createDataFrame(results, "result long, distance double, nodes array<int>"), spark.createDataFrame(stops, "route long, seq long, node long, x double, y double"))


def test_replayed_routes_equal_a_plain_replay(spark, log):
    places, first, moves, actions, results = log
    want, visits = _replay(places, first, moves, actions, results, 9)
    m, a, r, s = _frames(spark, first, places, moves, actions, results)
    state = search.replay_routes(m, a, r, s, 9, NEAR, NODES)
    rows = state.collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.problem, x.route, x.seq)):
        got.setdefault(x.problem, (x.depth, x.parent, x.action, {}))[3].setdefault(x.route, []).append(x.node)
        assert x.visits == visits[x.problem][x.node]
    assert {p: (*v[:3], list(v[3].values())) for p, v in got.items()} == want and all(list(v[3]) == list(range(len(v[3]))) for v in got.values())
    assert len(want) > 4 and 6 not in want and 8 not in want

    labels = {(x.problem, x.action): (x.result, x.label, x.is_first) for x in search.replay_labels(state, a, r, near=NEAR, nodes=NODES).collect()}
    kept = {(p, q): t for _, p, q, t in actions if t < 4}
    kept.pop((0, 7), None)  # its later entry has no result
    length = lambda route: sum(math.dist(b, c) for b, c in zip([(0, 0), *(places[v] for v in route)], [*(places[v] for v in route), (0, 0)], strict=True))
    for (p, q), t in kept.items():
        if p not in want or q >= len(want[p][3]):
            assert (p, q) not in labels
            continue
        routes = want[p][3]
        before = sum(length(routes[n]) for n in _cluster(routes, places, q))
        assert labels[p, q][0] == t and labels[p, q][1] == pytest.approx(t - before)
        assert labels[p, q][2] == (q == min(b for (a2, b), u in kept.items() if a2 == p and u == t and b < len(routes)))


def test_empty_logs(spark, log):
    places, first, moves, actions, results = log
    m, a, r, s = _frames(spark, first, places, moves, actions, results)
    assert {x.problem for x in search.replay_routes(m.limit(0), a, r, s, 3).collect()} == {0}
    assert search.replay_routes(m, a, r, s.limit(0), 3).count() == 0
    assert {x.problem for x in search.replay_routes(m, a.limit(0), r, s, 3).collect()} == {0}


def test_drawn_clusters_follow_the_softmax(spark):
    stats = spark.createDataFrame([(p, n, float(n), 0.0, 1) for p in range(400) for n in range(4)], "problem long, route long, cx double, cy double, n long")
    picks = spark.range(400).selectExpr("id AS problem", "0L AS action")
    drawn = search.clusters(stats, picks, near=2, temperature=1.0, seed=5).collect()
    assert len(drawn) == 800 and len({(r.problem, r.route) for r in drawn}) == 800
    share = [sum(r.rank == 1 and r.route == n for r in drawn) / 400 for n in range(4)]
    want = [math.exp(-n) / sum(math.exp(-k) for k in range(4)) for n in range(4)]
    assert all(abs(g - w) < 0.08 for g, w in zip(share, want, strict=True))
    again = search.clusters(stats.repartition(7), picks, near=2, temperature=1.0, seed=5).collect()
    assert sorted(drawn) == sorted(again)


def test_lists_of_results_are_made_once_a_result(spark, monkeypatch):
    """A filter on the lists' size, inferred from their explosion, must not be made below the grouping of results, for each of its rows."""
    plans = []
    monkeypatch.setattr(search, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, name))[1])
    rows = spark.range(1, 30).select((F.col("id") % 3).alias("result"), "id")
    results = rows.groupBy("result").agg(F.max("id").alias("distance")).select("result", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (k * (F.col("result") + 3) % 5).cast("int")).alias("nodes"))
    stops = spark.range(8).select((F.col("id") % 2).alias("route"), F.col("id").alias("seq"), F.col("id").alias("node"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    moves = spark.createDataFrame([(0, 0, 1)], "problem long, action long, next long")
    search.replay_routes(moves, spark.createDataFrame([(1, 0, 0, 1)], "seq long, problem long, action long, result long"), results, stops, 1)
    assert plans and not any("size(transform" in p for p in plans)
