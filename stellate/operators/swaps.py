"""Swaps of centres, costed from each point's nearest few centres.

A point keeps its nearest centres with squared distances. If a set of centres O goes and new points come, the point pays for its nearest
centre outside O or the nearest new point, whichever is less; with |O| = t that centre is among the first t + 1. So the cost of every swap of up to t centres
follows from one aggregation: S, the sum with nothing gone, and what is added where the first, the first two, ... nearest centres
all go. These sums are kept by centre, by pair and by triple, so their number depends on the centres and not on the points."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from . import blocks as bl
from .centres import Centre, k_center_greedy
from .draws import uniform


#: A few points as a column, and trials: the new points of each swap.
PLACES, TRIALS = "array<struct<c:int,x:double,y:double>>", "array<struct<trial:int,new:array<struct<x:double,y:double>>>>"


def _with(df: DataFrame, name: str, values: list, kind: str) -> DataFrame:
    """df with a column of driver-side values (a few), as one literal: Spark then runs one and the same generated code for all values."""
    return df.withColumn(name, F.from_json(F.lit(json.dumps(values)), kind))


def _placed(centres: list[Centre]) -> list[dict]:
    return [{"c": int(c), "x": float(x), "y": float(y)} for c, x, y in centres]


def _square(p: Column) -> Column:
    return (F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])


def _listed(centres: Column) -> Column:
    """An array of (d: squared distance, c) of all centres, nearest first, ties to the smaller number."""
    return F.array_sort(F.transform(centres, lambda p: F.struct(_square(p).alias("d"), p["c"].alias("c"))))


def near_lists(points: DataFrame, centres: list[Centre], kept: int) -> DataFrame:
    """points with near, their nearest centres."""
    return _with(points, "_at", _placed(centres), PLACES).withColumn("near", F.slice(_listed(F.col("_at")), 1, kept)).drop("_at")


def renewed(lists: DataFrame, centres: list[Centre], out: set[int], kept: int) -> DataFrame:
    """lists after the centres `out` were given new places: only points that had one of those among their nearest look at all centres again."""
    rows = _with(_with(lists, "_at", _placed(centres), PLACES), "_out", sorted(out), "array<int>")
    gone = F.exists("near", lambda n: F.array_contains("_out", n["c"]))
    new = _listed(F.filter("_at", lambda p: F.array_contains("_out", p["c"])))
    return rows.withColumn("near", F.when(gone, F.slice(_listed(F.col("_at")), 1, kept)).otherwise(F.slice(F.array_sort(F.concat("near", new)), 1, kept))).drop("_at", "_out")


def swap_sums(lists: DataFrame, trials: list[list[tuple[float, float]]], weight: str = "weight") -> dict[int, tuple[float, dict[tuple[int, ...], float]]]:
    """For each trial (the new points of a swap) S and the sums by the centres that go, as {centres: what is added}; one aggregation for all trials.

    Rows that reach the driver: a trial's centres, pairs and triples that are anyone's nearest."""
    w, inf = F.col(weight).cast("double"), F.lit(float("inf"))
    new = F.array_min(F.transform("t.new", _square))
    rows = _with(lists, "_t", [{"trial": n, "new": [{"x": float(x), "y": float(y)} for x, y in t]} for n, t in enumerate(trials)], TRIALS).select("near", "x", "y", w.alias("w"), F.explode("_t").alias("t"))
    rows = rows.select("near", "w", "t.trial", F.size("t.new").alias("size"), new.alias("new"))
    pay = lambda m: F.least(F.coalesce(F.get("near", m)["d"], inf), F.col("new"))
    gone = lambda m: F.array_sort(F.transform(F.slice("near", 1, m), lambda x: x["c"]))
    terms = F.transform(F.sequence(F.lit(0), F.col("size")), lambda m: F.struct(gone(m).alias("gone"), (F.col("w") * (pay(m) - F.when(m > 0, pay(m - 1)).otherwise(0.0))).alias("cost")))
    found = rows.select("trial", F.explode(terms).alias("s")).groupBy("trial", "s.gone").agg(F.sum("s.cost").alias("cost")).collect()
    out: dict[int, tuple[float, dict]] = {n: (0.0, {}) for n in range(len(trials))}
    for r in found:
        if r.gone:
            out[r.trial][1][tuple(r.gone)] = r.cost
        else:
            out[r.trial] = (r.cost, out[r.trial][1])
    return out


def best_swap(numbers: list[int], size: int, base: float, by: dict[tuple[int, ...], float]) -> tuple[float, tuple[int, ...]]:
    """The least cost of giving up `size` of the centres, and which (ties to the first in order)."""
    costs = ((base + sum(by.get(part, 0.0) for m in range(1, size + 1) for part in itertools.combinations(out, m)), out) for out in itertools.combinations(sorted(numbers), size))
    return min(costs, key=lambda t: t[0], default=(math.inf, ()))


def replaced(centres: list[Centre], out: tuple[int, ...], new: list[tuple[float, float]]) -> list[Centre]:
    at = dict(zip(out, new, strict=True))
    return [(c, *at.get(c, (x, y))) for c, x, y in centres]


def list_cost(lists: DataFrame, weight: str = "weight") -> float:
    return lists.agg(F.sum(F.col(weight) * F.get("near", F.lit(0))["d"])).first()[0] or 0.0


def _near_points(points: DataFrame, centres: list[Centre], size: int) -> list:
    """c, id, x, y of the `size` points nearest to each centre (ties to the smaller id): each point meets the few centres, and ranks are cut before they are shuffled."""
    met = _with(points, "_at", _placed(centres), PLACES).withColumn("p", F.explode("_at")).select("p.c", "id", "x", "y", _square(F.col("p")).alias("d"))
    first = Window.partitionBy("c").orderBy("d", "id")
    return met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= size).select("c", "id", "x", "y").orderBy("c", "id").collect()


def snapped_steps(points: DataFrame, centres: list[Centre], now: float, weight: str = "weight") -> tuple[list[Centre], float]:
    """Steps of weighted means, each moved to the nearest point, as long as the cost falls."""
    w = F.col(weight).cast("double")
    while True:
        near = near_lists(points, centres, 1).withColumn("c", F.get("near", F.lit(0))["c"])
        means = near.groupBy("c").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y")).collect()
        found = {r.c: (r.x, r.y) for r in _near_points(points, [(r.c, r.x, r.y) for r in means], 1)}
        after = [(c, *found.get(c, (x, y))) for c, x, y in centres]
        cost = list_cost(near_lists(points, after, 1), weight)
        if cost >= now:
            return centres, now
        centres, now = after, cost


def _drawn(lists: DataFrame, seeds: list[int], weight: str = "weight") -> list[tuple[int, float, float] | None]:
    """For each seed the point drawn by weighted squared distance (the least of exponential keys on a hash of id and seed), in one aggregation."""
    d = F.get("near", F.lit(0))["d"] * F.col(weight)
    rows = _with(lists.where(d > 0), "_seeds", seeds, "array<long>").select("id", "x", "y", d.alias("d"), F.explode("_seeds").alias("seed"))
    key = -F.log(uniform(F.col("seed"), "id")) / F.col("d")
    found = {r.seed: tuple(r.p) for r in rows.groupBy("seed").agg(F.min_by(F.struct("id", "x", "y"), F.struct(key.alias("k"), "id")).alias("p")).collect()}
    return [found.get(s) for s in seeds]


def local_search(points: DataFrame, k: int, rounds: int = 400, seed: int = 0, ahead: int = 64) -> tuple[list[Centre], float]:
    """Centres (points of the data) and their cost: from k farthest points, each round draws a point by squared distance and makes the best
    single swap with it if that saves 1 / (100 k) of the cost; at the end steps of means snapped to points, as long as they save.

    points: id, x, y, weight. Rounds that make no swap leave everything as it was, so the draws of the next rounds (up to `ahead`) are costed together; after a swap
    the rounds after it draw again. Results don't depend on ahead."""
    rows = written(points.select("id", "x", "y", "weight"), "search")
    centres = [(n, x, y) for n, (_, x, y) in enumerate(k_center_greedy(rows, k)[0])]
    if not centres:
        return [], 0.0
    numbers = [c for c, _, _ in centres]
    lists = written(near_lists(rows, centres, 2), "lists")
    now, turn, step = list_cost(lists), 0, 4
    while turn < rounds:
        turns = range(turn, min(turn + step, rounds))
        step = min(ahead, 2 * step)
        drawn = _drawn(lists, [seed * 1_000_003 + t for t in turns])
        if drawn[0] is None:  # every point is a centre
            break
        sums = swap_sums(lists, [[(x, y)] for _, x, y in drawn])
        for n, t in enumerate(turns):
            turn = t + 1
            cost, out = best_swap(numbers, 1, *sums[n])
            if cost < (1 - 1 / (100 * len(centres))) * now:
                centres, now = replaced(centres, out, [drawn[n][1:]]), cost
                before, lists = lists, written(renewed(lists, centres, set(out), 2), "lists")
                discard(before)
                step = 4
                break
    discard(lists)
    return snapped_steps(rows, centres, list_cost(near_lists(rows, centres, 1)))


def _nearest(at: np.ndarray, centres: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places of each point's nearest centres, nearest first, ties to the earlier one."""
    d = _apart(at, centres)
    near = np.argsort(d, 1, kind="stable")[:, :kept]
    return np.take_along_axis(d, near, 1), near


def _apart(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (at[:, 0, None] - places[:, 0]) ** 2 + (at[:, 1, None] - places[:, 1]) ** 2


def _at(centres: list[Centre]) -> np.ndarray:
    return np.array([(x, y) for _, x, y in centres], float)


#: Numbers of a trial's distances that a task holds at a time.
HELD = 1 << 20


def block_sums(points: bl.Blocks, centres: list[Centre], trials: list[list[tuple[float, float]]]) -> list[tuple[float, dict[tuple[int, ...], float]]]:
    """swap_sums() of blocks (x, y, weight): one pass for all trials. Centres are numbered by their place in the list."""
    at, k, most = _at(centres), len(centres), max(map(len, trials))
    places = sorted({p for t in trials for p in t})
    new, index = np.array(places, float), {p: n for n, p in enumerate(places)}
    of = [[index[p] for p in t] for t in trials]

    def task(ids: np.ndarray, v: np.ndarray) -> list:
        d, near = _nearest(v, at, most + 1)
        d = np.concatenate([d, np.full((len(d), most + 1 - d.shape[1]), np.inf)], 1)
        near = np.concatenate([near, np.full((len(d), most + 1 - near.shape[1]), 0)], 1)
        groups = []  # for m centres gone: which groups of centres there are, and of each point its group
        for m in range(1, most + 1):
            code = np.zeros(len(d), np.int64)
            for c in np.sort(near[:, :m], 1).T:
                code = code * k + c
            groups.append(np.unique(code, return_inverse=True))
        out, step = [], max(1, HELD // max(1, len(v)))
        for first in range(0, len(of), step):
            some = of[first : first + step]
            used = sorted({p for t in some for p in t})
            to = dict(zip(used, _apart(v, new[used]).T, strict=True))
            for t in some:
                least = to[t[0]] if len(t) == 1 else np.minimum.reduce([to[p] for p in t])
                pay = np.minimum(d[:, 0], least)
                base, by = float((v[:, 2] * pay).sum()), []
                for m in range(1, len(t) + 1):
                    before, pay = pay, np.minimum(d[:, m], least)
                    codes, inverse = groups[m - 1]
                    by.append((codes, np.bincount(inverse, v[:, 2] * (pay - before), len(codes))))
                out.append((base, by))
        return out

    found = points.each(task)
    sums: list[tuple[float, dict]] = []
    for n, t in enumerate(of):
        by: dict[tuple[int, ...], float] = {}
        for m in range(1, len(t) + 1):
            for part in found:
                codes, added = part[n][1][m - 1]
                for code, cost in zip(codes.tolist(), added.tolist(), strict=True):
                    out = tuple(code // k**e % k for e in range(m - 1, -1, -1))
                    by[out] = by.get(out, 0.0) + cost
        sums.append((sum(part[n][0] for part in found), by))
    return sums


def block_cost(points: bl.Blocks, centres: list[Centre]) -> float:
    at = _at(centres)
    return float(sum(points.each(lambda ids, v: float((v[:, 2] * _nearest(v, at, 1)[0][:, 0]).sum()))))


def block_near(points: bl.Blocks, places: np.ndarray, size: int) -> list[list[tuple[float, int, float, float]]]:
    """Of each place its `size` nearest points as (squared distance, id, x, y), ties to the smaller id."""

    def task(ids: np.ndarray, v: np.ndarray) -> list:
        out = []
        for d in _apart(v, places).T:
            first = np.argsort(d, kind="stable")[:size]  # a block is sorted by id
            out.append(list(zip(d[first].tolist(), ids[first].tolist(), v[first, 0].tolist(), v[first, 1].tolist(), strict=True)))
        return out

    found = points.each(task)
    return [sorted(p for part in found for p in part[n])[:size] for n in range(len(places))]


def block_steps(points: bl.Blocks, centres: list[Centre], now: float) -> tuple[list[Centre], float]:
    """snapped_steps() of blocks."""
    while True:
        at, k = _at(centres), len(centres)

        def task(ids: np.ndarray, v: np.ndarray, at: np.ndarray = at, k: int = k) -> np.ndarray:
            near = _nearest(v, at, 1)[1][:, 0]
            return np.stack([np.bincount(near, x, k) for x in (v[:, 2], v[:, 2] * v[:, 0], v[:, 2] * v[:, 1])], 1)

        total = sum(points.each(task))
        full = np.flatnonzero(total[:, 0] > 0)
        moved = block_near(points, total[full, 1:] / total[full, :1], 1)
        found = {int(n): p[0][2:] for n, p in zip(full, moved, strict=True)}
        after = [(c, *found.get(n, (x, y))) for n, (c, x, y) in enumerate(centres)]
        cost = block_cost(points, after)
        if cost >= now:
            return centres, now
        centres, now = after, cost


def _drawn_by_share(points: bl.Blocks, centres: list[Centre], boost: float, now: float, seeds: list[int]) -> list[list[tuple[int, float, float]]]:
    """For each seed the points (id, x, y) whose hash of id and seed is at most boost times their share of the cost; about `boost` rows a seed reach the driver."""
    at = _at(centres)

    def task(ids: np.ndarray, v: np.ndarray) -> list:
        share = boost * _nearest(v, at, 1)[0][:, 0] * v[:, 2] / now
        out = []
        for u in bl.uniform(seeds, ids):
            hit = np.flatnonzero(u <= share)
            out.append(list(zip(ids[hit].tolist(), v[hit, 0].tolist(), v[hit, 1].tolist(), strict=True)))
        return out

    found = points.each(task)
    return [sorted(p for part in found for p in part[n]) for n in range(len(seeds))]


def multi_swap_search(points: DataFrame, k: int, rounds: int = 400, seed: int = 0, most: int = 2, boost: float = 1.5, patience: int = 5, neighbours: tuple[int, ...] = (10, 30, 50), ahead: int = 128) -> tuple[list[Centre], float]:
    """Centres (points of the data) and their cost. points: id, x, y, weight (distinct places with their number).

    A pass has four phases. Swaps: each round draws every point with the probability boost * share of the cost and, if 1 to `most` points
    come up, costs every swap of each non-empty subset of them for as many centres; the best is made if it saves 1 / (100 k).
    Steps of snapped means, as long as they save. Neighbour swaps: every centre is tried at its 10 nearest points, then 30, then 50,
    and the best trial is made as long as it saves. The best centres so far are kept; then a mutation starts the next pass: of the centres and 2 k
    drawn points the k stay that carry the largest shares of both costs (drawn points threefold). Ends after `patience` passes without a gain."""
    rows = written(points.select("id", "x", "y", "weight"), "search")
    centres = [(n, x, y) for n, (_, x, y) in enumerate(k_center_greedy(rows, k)[0])]
    if not centres:
        return [], 0.0
    blocks = bl.Blocks(rows, ["x", "y", "weight"])
    try:
        return _passes(blocks, centres, rounds, seed, most, boost, patience, neighbours, ahead)
    finally:
        blocks.close()
        discard(rows)


def _passes(points: bl.Blocks, centres: list[Centre], rounds: int, seed: int, most: int, boost: float, patience: int, neighbours: tuple[int, ...], ahead: int) -> tuple[list[Centre], float]:
    numbers, best, least, failed, passes = [c for c, _, _ in centres], centres, math.inf, 0, 0
    while True:
        now, turn, step = block_cost(points, centres), 0, 4
        while turn < rounds and now > 0:
            turns = range(turn, min(turn + step, rounds))
            step = min(ahead, 2 * step)
            found = dict(zip(turns, _drawn_by_share(points, centres, boost, now, [t + seed * 7_919 + passes * rounds for t in turns]), strict=True))
            trials, of = [], []
            for t in turns:
                new = found[t]
                if 1 <= len(new) <= most:
                    subsets = [s for m in range(1, len(new) + 1) for s in itertools.combinations([p[1:] for p in new], m) if m <= len(numbers)]
                    trials += map(list, subsets)
                    of += [t] * len(subsets)
            sums = block_sums(points, centres, trials) if trials else []
            costed = {t: min((*best_swap(numbers, len(trials[n]), *sums[n]), n) for n in range(len(trials)) if of[n] == t) for t in dict.fromkeys(of)}
            swap = next((t for t in turns if t in costed and costed[t][0] < (1 - 1 / (100 * len(centres))) * now), None)
            turn = turns[-1] + 1 if swap is None else swap + 1
            if swap is not None:
                now, out, n = costed[swap]
                centres = replaced(centres, out, trials[n])
                step = 4
        centres, now = block_steps(points, centres, block_cost(points, centres))
        centres, now = neighbour_swaps(points, centres, now, neighbours)
        if now < least:
            best, least, failed = centres, now, 0
        else:
            failed += 1
        if failed >= patience or now == 0:
            return best, least
        passes += 1
        centres = mutated(points, centres, seed * 104_729 + passes)


def neighbour_swaps(points: bl.Blocks, centres: list[Centre], now: float, sizes: tuple[int, ...]) -> tuple[list[Centre], float]:
    """Each centre tried at each of its nearest points (those of a size, then of the next), the best trial made as long as it saves."""
    at = 0
    while at < len(sizes):
        tried = [(n, *p[1:]) for n, near in enumerate(block_near(points, _at(centres), sizes[at])) for p in near]
        places = sorted({(x, y) for _, _, x, y in tried})
        costs = dict(zip(places, block_sums(points, centres, [[p] for p in places]), strict=True))
        cost, n, _, place = min((costs[x, y][0] + costs[x, y][1].get((n,), 0.0), n, i, (x, y)) for n, i, x, y in tried)
        if cost < now * (1 - 1e-12):
            centres, now = replaced(centres, (centres[n][0],), [place]), cost
        else:
            at += 1
    return centres, now


def mutated(points: bl.Blocks, centres: list[Centre], seed: int) -> list[Centre]:
    """The len(centres) places of most score: of centres their share of the cost, and of 2 k drawn points three times the share of the cost if they were the centres."""
    k = len(centres)

    def first(ids: np.ndarray, v: np.ndarray) -> list:
        u = next(bl.uniform([seed], ids))
        least = np.argsort(u, kind="stable")[: 2 * k]
        return list(zip(u[least].tolist(), ids[least].tolist(), v[least, 0].tolist(), v[least, 1].tolist(), strict=True))

    drawn = [(n, x, y) for n, (_, _, x, y) in enumerate(sorted(p for part in points.each(first) for p in part)[: 2 * k])]
    own = [_at(centres), _at(drawn)]

    def shares(ids: np.ndarray, v: np.ndarray) -> list:
        near = [_nearest(v, at, 1) for at in own]
        return [np.bincount(c[:, 0], v[:, 2] * d[:, 0], len(at)) for (d, c), at in zip(near, own, strict=True)]

    found = points.each(shares)
    scores: dict[tuple[float, float], float] = {}
    for n, (places, times) in enumerate(((centres, 1.0), (drawn, 3.0))):
        by = sum(part[n] for part in found)
        total = float(by.sum()) or 1.0
        for (_, x, y), cost in zip(places, by.tolist(), strict=True):
            scores[x, y] = scores.get((x, y), 0.0) + times * cost / total
    order = sorted(scores, key=lambda p: (-scores[p], p))[:k]
    return [(n, x, y) for n, (x, y) in enumerate(order)]
