"""Search logs of routing solvers: beams, replay of a search, labels of its actions, and comparison of two solvers' trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from .draws import uniform
from .routes import route_distances


def beam(candidates: DataFrame, width: int, cost: str = "cost", by: str | None = None) -> DataFrame:
    """The candidates of least cost, ties to the smaller id: so many of each group first (column by), then so many of all."""
    if by:
        w = Window.partitionBy(by).orderBy(cost, "id")
        candidates = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= width).drop("_n")
    return candidates.orderBy(cost, "id").limit(width)


def replay(transitions: DataFrame, depth: int) -> DataFrame:
    """problem, parent, action, depth of the problems that transitions (problem, action, next) reach from problem 0 in so many steps.

    One join a step; each step's problems are written, so plans stay short. A problem is reached once, by the fewest steps and then from the
    smallest parent and action; logs with several ways to a problem, or with cycles, end like others."""
    spark = transitions.sparkSession
    moves = written(transitions.select(F.col("problem").cast("long").alias("parent"), F.col("action").cast("long").alias("action"), F.col("next").cast("long").alias("problem")), "moves")
    last = spark.range(1).select(F.col("id").alias("problem"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("action"), F.lit(0).alias("depth"))
    out = last
    for n in range(1, depth + 1):
        step = moves.join(last.select(F.col("problem").alias("parent")), "parent").select("problem", "parent", "action", F.lit(n).alias("depth"))
        first = step.groupBy("problem").agg(F.min(F.struct("parent", "action")).alias("m")).select("problem", "m.parent", "m.action", F.lit(n).alias("depth"))
        last = written(first.join(out.select("problem"), "problem", "left_anti"), "reached")
        if last.isEmpty():
            discard(last)
            break
        out = out.unionByName(last)
    return out


def route_stats(state: DataFrame) -> DataFrame:
    """problem, route, cx, cy, n of the routes of many problems (problem, route, node, x, y)."""
    return state.groupBy("problem", "route").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def clusters(stats: DataFrame, picks: DataFrame, near: int = 15, nodes: int = 200, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """problem, action, route, rank (from 1): the routes that each pick (problem, action) solves again, of route_stats().

    They are the routes nearest to route `action` of the problem by their centroids, itself first, ties to the smaller number: `near` of them at most, and as many
    as hold no more than so many nodes together. With a temperature they are drawn instead, without replacement, in proportion to
    exp(-distance / temperature): the least distance / temperature less Gumbel noise, drawn by problem, action, route and seed. A pick that is no route of its
    problem has no rows, and repeated picks count once."""
    at = picks.select("problem", F.col("action").cast("long").alias("action")).distinct()
    own = at.join(stats.select("problem", F.col("route").cast("long").alias("action"), F.col("cx").alias("ox"), F.col("cy").alias("oy")), ["problem", "action"])
    d = F.sqrt((F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy")))
    if temperature:
        d = d / temperature + F.log(F.greatest(-F.log(uniform(seed, "problem", "action", "route")), F.lit(1e-300)))
    w = Window.partitionBy("problem", "action")
    ranked = stats.join(own, "problem").withColumn("_d", d).withColumn("rank", F.row_number().over(w.orderBy("_d", "route"))).where(F.col("rank") <= near)
    held = F.sum("n").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("_held", held).where(F.col("_held") <= nodes).select("problem", "action", "route", "rank")


def _numbered_routes(rows: DataFrame) -> DataFrame:
    """rows with route from 0 within each problem, in the order of (_side, route). Only the list of routes goes through the window."""
    order = rows.select("problem", "_side", "route").distinct()
    order = order.withColumn("_n", (F.row_number().over(Window.partitionBy("problem").orderBy("_side", "route")) - 1).cast("long"))
    return rows.join(order, ["problem", "_side", "route"]).drop("_side", "route").withColumnRenamed("_n", "route")


def replay_routes(transitions: DataFrame, actions: DataFrame, results: DataFrame, routes: DataFrame, depth: int, near: int = 15, nodes: int = 200, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """problem, depth, parent, action, route, seq, node, x, y, visits: the routes of all problems that a search's log reaches from problem 0.

    routes (route, seq, node, x, y) are those of problem 0; transitions (problem, action, next), actions (seq, problem, action, result) and results (result, nodes)
    are as sinks.write_search_log() has them. A move solves the cluster of its action again (see clusters()): the cluster's routes go, and the result's come behind the
    routes that stay. A result's nodes, with a 0 after each route, are numbers from 1 into the cluster's nodes in order; those beyond the cluster are passed over, and nodes that
    it leaves out are gone. visits counts how often a node was in a cluster. Of an action that was logged twice the later entry counts. Moves without a result, or whose
    action is no route, reach nothing; a problem is reached once, as in replay(). Every step is a few joins over all problems of one depth, written."""
    spark = transitions.sparkSession
    moves = written(transitions.select(F.col("problem").cast("long").alias("parent"), F.col("action").cast("long").alias("action"), F.col("next").cast("long").alias("problem")).distinct(), "moves")
    kept = actions.groupBy(F.col("problem").cast("long").alias("parent"), F.col("action").cast("long").alias("action")).agg(F.max_by("result", "seq").alias("result"))
    # written first: else Spark looks for empty lists before results are grouped, and makes every row's list for that
    held = written(results.select("result", "nodes"), "results")
    steps = held.select("result", F.posexplode("nodes").alias("seq", "number"))
    number = F.sum((F.col("number") == 0).cast("int")).over(Window.partitionBy("result").orderBy("seq"))
    solved = written(steps.withColumn("route", number).where("number <> 0").select("result", F.col("route").cast("long").alias("route"), F.col("seq").cast("long").alias("seq"), F.col("number").cast("long").alias("number")), "solved")
    logged = written(moves.join(kept, ["parent", "action"]).join(held.select("result").distinct(), "result"), "logged")
    first = routes.select(F.lit(0).cast("long").alias("problem"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("action"), F.lit(0).alias("_side"), "route", F.col("seq").cast("long").alias("seq"), "node", "x", "y", F.lit(0).alias("visits"))
    cols = ["problem", "depth", "parent", "action", "route", "seq", "node", "x", "y", "visits"]
    last = written(_numbered_routes(first).select(cols), "routes")
    out, seen = last, spark.range(1).select(F.col("id").alias("problem"))
    for n in range(1, depth + 1):
        stats = route_stats(last)
        able = logged.join(stats.select(F.col("problem").alias("parent"), F.col("route").alias("action")), ["parent", "action"])
        reached = able.groupBy("problem").agg(F.min(F.struct("parent", "action", "result")).alias("m")).select("problem", "m.*")
        now = written(reached.join(seen, "problem", "left_anti"), "reached")
        if now.isEmpty():
            discard(now)
            break
        picked = written(clusters(stats, now.select(F.col("parent").alias("problem"), "action"), near, nodes, temperature, seed).select(F.col("problem").alias("parent"), "action", "route", F.lit(True).alias("_in")), "picked")
        child = last.select(F.col("problem").alias("parent"), "route", "seq", "node", "x", "y", "visits").join(now, "parent").join(picked, ["parent", "action", "route"], "left")
        child = written(child, "child")
        stay = child.where("_in IS NULL").select("problem", "parent", "action", F.lit(0).alias("_side"), "route", "seq", "node", "x", "y", "visits")
        # a cluster holds `nodes` nodes at most
        local = child.where("_in").withColumn("number", F.row_number().over(Window.partitionBy("problem").orderBy("node")).cast("long")).drop("route", "seq")
        fresh = local.join(solved, ["result", "number"]).select("problem", "parent", "action", F.lit(1).alias("_side"), "route", "seq", "node", "x", "y", (F.col("visits") + 1).alias("visits"))
        last = written(_numbered_routes(stay.unionByName(fresh).withColumn("depth", F.lit(n))).select(cols), "routes")
        discard(picked, child)
        out, seen = out.unionByName(last), seen.unionByName(now.select("problem"))
    return out


def problem_distances(state: DataFrame, depot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """problem, route, distance of the routes of many problems, as replay_routes() gives them."""
    one = state.select(F.struct("problem", "route").alias("route"), "seq", "x", "y")
    return route_distances(one, depot).select("route.problem", "route.route", "distance")


def replay_labels(state: DataFrame, actions: DataFrame, results: DataFrame, depot: tuple[float, float] = (0.0, 0.0), **cluster) -> DataFrame:
    """action_labels() of all logged actions of replayed problems: a result's distance less that of the routes that the action picks (see clusters(), which
    takes the further arguments). Actions that pick nothing have no label."""
    picked = clusters(route_stats(state), actions, **cluster)
    before = picked.join(problem_distances(state, depot), ["problem", "route"]).groupBy("problem", "action").agg(F.sum("distance").alias("distance"))
    return action_labels(actions, results, before)


def action_labels(actions: DataFrame, results: DataFrame, before: DataFrame) -> DataFrame:
    """problem, action, result, label, is_first of logged actions (seq, problem, action, result).

    Of an action that was logged twice the later entry counts. The label is the result's distance (result, distance) less the distance
    of the routes that the action picks (problem, action, distance); is_first marks the smallest action of each problem with a result."""
    kept = actions.groupBy("problem", "action").agg(F.max_by("result", "seq").alias("result"))
    rows = kept.join(results.select("result", F.col("distance").alias("_after")), "result").join(before.select("problem", "action", F.col("distance").alias("_before")), ["problem", "action"])
    first = F.min("action").over(Window.partitionBy("problem", "result")) == F.col("action")
    return rows.select("problem", "action", "result", (F.col("_after") - F.col("_before")).alias("label"), first.alias("is_first"))


def trial_means(trials: DataFrame) -> DataFrame:
    """trial, objective (the mean over instances), seconds (their sum)."""
    return trials.groupBy("trial").agg(F.avg("objective").alias("objective"), F.sum("seconds").alias("seconds"))


def compare_trials(trials: DataFrame, others: DataFrame, overhead: float = 0.0) -> DataFrame:
    """rule, trial, objective, seconds, other_trial, other_objective, other_seconds at trials 1, 10, 100 and so on.

    Rule 'trial': the other solver at the same trial, or at its last one; rule 'time': at its first trial that takes no less than the first
    solver's seconds (with an overhead added to its own), or at its last one. Trials, not instances, are compared."""
    mine, theirs = trial_means(trials), trial_means(others).withColumn("seconds", F.col("seconds") + overhead)
    last = theirs.agg(F.max("trial").alias("last"))
    marks = mine.where(F.log10("trial") == F.floor(F.log10("trial"))).join(last)
    same = marks.select(F.lit("trial").alias("rule"), "trial", "objective", "seconds", F.least("trial", "last").alias("other_trial"))
    enough = marks.alias("m").join(theirs.alias("t"), F.col("t.seconds") >= F.col("m.seconds"), "left")
    timed = enough.groupBy("m.trial", "m.objective", "m.seconds", "m.last").agg(F.min("t.trial").alias("found"))
    timed = timed.select(F.lit("time").alias("rule"), "trial", "objective", "seconds", F.coalesce("found", "last").alias("other_trial"))
    return same.union(timed).join(theirs.select(F.col("trial").alias("other_trial"), F.col("objective").alias("other_objective"), F.col("seconds").alias("other_seconds")), "other_trial")
