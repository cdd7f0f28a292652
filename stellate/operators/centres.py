"""Choice of centres: Lloyd steps, medoids, farthest-first, coverage and regularised k-means. The loops run on
the driver over a number of centres that is a parameter; every step is an aggregation over the points."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .blocks import Blocks
from .neighbors import nearest_centre
from .scaling import min_max

Centre = tuple[int, float, float]


def first_points(points: DataFrame, k: int) -> list[Centre]:
    """The k points of the smallest ids as centres 0..k-1."""
    return [(n, r.x, r.y) for n, r in enumerate(points.orderBy("id").limit(k).collect())]


def cost(points: DataFrame, centres: list[Centre], weight: str | None = None) -> DataFrame:
    """cost: the (weighted) sum of squared distances to the nearest centre."""
    square = F.col("d1") * F.col("d1") * (F.col(weight) if weight else F.lit(1.0))
    return nearest_centre(points, centres).agg(F.sum(square).alias("cost"))


def lloyd(points: DataFrame, centres: list[Centre], steps: int) -> list[Centre]:
    """Centres after so many steps of assignment and averaging; one that loses all its points stays where it is."""
    for _ in range(steps):
        moved = {r.centre: (r.x, r.y) for r in nearest_centre(points, centres).groupBy("centre").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
        centres = [(c, *moved.get(c, (x, y))) for c, x, y in centres]
    return centres


def k_means(points: DataFrame, cols: list[str], k: int, seed: int = 0, out: str = "cluster"):
    """points with the cluster of k-means|| over cols, and the model."""
    rows = VectorAssembler(inputCols=cols, outputCol="_v").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(rows)
    return model.transform(rows).drop("_v"), model


def regularised_k_means(points: DataFrame, cols: list[str], k: int, penalty: float = 0.1, rounds: int = 20, seed: int = 0):
    """points with a cluster, and the features' weights: scaled features are weighted by max(0, 1 - penalty / norm of the centres'
    coordinates) until the centres rest."""
    scaled = min_max(points, cols)
    weights, before = dict.fromkeys(cols, 1.0), None
    for _ in range(rounds):
        found, model = k_means(scaled.withColumns({f"_w{c}": F.col(c) * weights[c] for c in cols}), [f"_w{c}" for c in cols], k, seed)
        centres = sorted(map(tuple, model.clusterCenters()))
        if before is not None and all(abs(a - b) <= 1e-4 for x, y in zip(centres, before, strict=False) for a, b in zip(x, y, strict=True)):
            break
        before = centres
        norms = [math.sqrt(sum(c[n] ** 2 for c in centres)) for n in range(len(cols))]
        weights = {c: max(0.0, 1 - penalty / norm) if norm else 0.0 for c, norm in zip(cols, norms, strict=True)}
    return found.drop(*[f"_w{c}" for c in cols]), weights


def k_center_greedy(points: DataFrame, k: int, first: int | None = None) -> tuple[list[Centre], float]:
    """Farthest-first centres (ties to the smaller id) from the point `first` (the smallest id without one), and the covering radius."""
    row = points.where(F.col("id") == first).first() if first is not None else points.orderBy("id").first()
    if row is None:
        return [], 0.0
    chosen = [(row.id, row.x, row.y)]
    while True:
        far = nearest_centre(points, chosen).agg(F.max_by(F.struct("id", "x", "y", "d1"), F.struct("d1", -F.col("id"))).alias("p")).first().p
        if len(chosen) == k or far.d1 == 0:
            return chosen, far.d1
        chosen.append((far.id, far.x, far.y))


def top_score_farthest(points: DataFrame, k: int, score: str = "score", first: int | None = None) -> list[Centre]:
    """k_center_greedy() among the 3k highest scores (ties to the higher id); ends early if all are covered."""
    return k_center_greedy(written(points.orderBy(F.desc(score), F.desc("id")).limit(3 * k), "candidates"), k, first)[0]


def coverage(points: DataFrame, k: int, radius: str = "radius") -> DataFrame:
    """id, cluster: k times the unassigned point of the largest radius (ties to the smaller id) takes the unassigned points within its radius; the rest is -1."""
    rows = written(points.select("id", "x", "y", F.col(radius).alias("r")), "coverage")
    taken: list[tuple[int, float, float, float]] = []

    def cluster():
        within = [F.when((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= r * r, n) for n, x, y, r in taken]
        return F.coalesce(*within, F.lit(-1)) if within else F.lit(-1)

    for n in range(k):
        top = rows.where(cluster() == -1).agg(F.max_by(F.struct("x", "y", "r"), F.struct("r", -F.col("id"))).alias("p")).first().p
        if top is None:
            break
        taken.append((n, top.x, top.y, top.r))
    return rows.select("id", cluster().cast("int").alias("cluster"))


def k_medoids(points: DataFrame, k: int, score: str = "score", steps: int = 10) -> tuple[DataFrame, list[Centre]]:
    """id, cluster and the medoids: from the k highest scores, every step moves each medoid to its cluster's point of the
    least summed distance, until none moves."""
    centres = [(n, r.x, r.y) for n, r in enumerate(points.orderBy(F.desc(score), F.desc("id")).limit(k).collect())]
    rows = Blocks(_finite(points), ["x", "y"])
    for _ in range(steps):
        moved = _medoids(rows, len(centres), functools.partial(_nearest, [(x, y) for _, x, y in centres]))
        after = [(c, *moved.get(c, (x, y))) for c, x, y in centres]
        if after == centres:
            break
        centres = after
    rows.close()
    return nearest_centre(points, centres).select("id", F.col("centre").alias("cluster")), centres


#: Candidates of a cluster in one pass, and columns and rows of a cluster's grid.
CANDIDATES, GRID = 256, 48


def medoids(own: DataFrame) -> dict[int, tuple[float, float]]:
    """Of each cluster (own: id, x, y, centre) the point of the least summed distance to all (to 9 digits, ties to the smaller id)."""
    names = sorted(r.centre for r in own.select("centre").distinct().collect())
    rows = Blocks(_finite(own), ["x", "y", "centre"])
    found = _medoids(rows, len(names), lambda v: np.searchsorted(names, v[:, 2]))
    rows.close()
    return {names[c]: place for c, place in found.items()}


def _finite(points: DataFrame) -> DataFrame:
    return points.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in "xy"))


def _nearest(centres: list[tuple[float, float]], v: np.ndarray) -> np.ndarray:
    return np.argmin([np.sqrt((v[:, 0] - x) * (v[:, 0] - x) + (v[:, 1] - y) * (v[:, 1] - y)) for x, y in centres], axis=0)


def _sums(places: np.ndarray, others: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Of each place the (weighted) distances to all others."""
    out, some = np.zeros(len(places)), max(1, (1 << 19) // max(1, len(others)))
    for n in range(0, len(places), some):
        dx, dy = places[n : n + some, :1] - others[:, 0], places[n : n + some, 1:2] - others[:, 1]
        d = np.sqrt(dx * dx + dy * dy)
        out[n : n + some] = (d if weights is None else d * weights).sum(1)  # a row's sum doesn't depend on the other rows
    return out


def _medoids(rows: Blocks, k: int, label: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[float, float]]:
    """medoids() of the clusters 0 to k - 1 that have points; label gives the cluster of each row.

    A cluster's grid has about as many points in each column and each row. A cell's points are together at least as far from a place as their number times the distance of
    their mean, and little farther, so that a place's sum has a close bound from below; the bound is convex, so its slope at a cell's mean bounds it for all of the
    cell. The points of the best cell are summed exactly. What is bounded by more than the least sum goes, cells at the driver (their number is fixed) and points in tasks; those that
    are left are summed in the order of their bounds, a bounded number a pass, until the next bound exceeds the least sum."""
    shares, cells = np.arange(1, GRID) / GRID, GRID * GRID

    def borders(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, at = np.zeros((k, 2 * GRID)), label(v)
        for c in np.unique(at):
            own = v[at == c, :2]
            out[c] = [len(own), np.abs(own).max() * len(own), *len(own) * np.quantile(own, shares, axis=0, method="lower").T.ravel()]
        return out

    found = rows.summed(borders)
    if found is None:
        return {}
    sizes = found[:, 0]
    lines = (found[:, 2:] / np.maximum(sizes, 1)[:, None]).reshape(k, 2, GRID - 1)

    def parts(v: np.ndarray):
        """Of each cluster its rows and their cells."""
        at = label(v)
        for c in np.unique(at):
            own = np.flatnonzero(at == c)
            yield c, own, np.searchsorted(lines[c, 0], v[own, 0]) * GRID + np.searchsorted(lines[c, 1], v[own, 1])

    def filled(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((k, 3, cells))
        for c, own, cell in parts(v):
            out[c] = [np.bincount(cell, w, cells) for w in (None, v[own, 0], v[own, 1])]
        return out

    grids = rows.summed(filled)
    means, weights, used, bounds, slopes = [], [], [], [], []
    for c in range(k):
        on = np.flatnonzero(grids[c, 0])
        n = grids[c, 0, on]
        m = np.stack([grids[c, 1, on] / n, grids[c, 2, on] / n], 1)
        low, slope = np.zeros(len(on)), np.zeros((len(on), 2))
        for i in range(0, len(on), 256):
            dx, dy = m[i : i + 256, :1] - m[:, 0], m[i : i + 256, 1:] - m[:, 1]
            r = np.sqrt(dx * dx + dy * dy)
            w = n / np.where(r > 0, r, np.inf)
            low[i : i + 256], slope[i : i + 256, 0], slope[i : i + 256, 1] = (r * n).sum(1), (dx * w).sum(1), (dy * w).sum(1)
        for held, value in ((means, m), (weights, n), (used, on), (bounds, low), (slopes, slope)):
            held.append(value)
    slack = 1e-9 + 1e-12 * found[:, 1]  # rounding of means
    limit, best = np.full(k, np.inf), [None] * k
    done: list[tuple[float, float, float] | None] = [None] * k

    def picked(chosen: list[np.ndarray | None]) -> Callable:
        """Of each block and cluster the first CANDIDATES places after `done`, by bound, x and y, within the limit; their smallest ids."""

        def task(ids: np.ndarray, v: np.ndarray) -> list[tuple]:
            out = []
            for c, own, cell in parts(v):
                if (first := chosen[c]) is None:
                    continue
                place = np.searchsorted(used[c], cell)
                own, place = own[first[place]], place[first[place]]
                most = limit[c] * (1 + 1e-9) + slack[c]
                step = v[own, :2] - means[c][place]
                own = own[bounds[c][place] + (slopes[c][place] * step).sum(1) <= most + 1e-9 * bounds[c][place]]
                if not len(own):
                    continue
                xy, at = np.unique(v[own, :2], axis=0, return_inverse=True)
                low = _sums(xy, means[c], weights[c])
                least = np.full(len(xy), np.iinfo(np.int64).max)
                np.minimum.at(least, at.ravel(), ids[own])
                keep = low <= most
                if done[c] is not None:
                    b, x, y = done[c]
                    keep &= (low > b) | (low == b) & ((xy[:, 0] > x) | (xy[:, 0] == x) & (xy[:, 1] > y))
                order = np.lexsort((xy[:, 1], xy[:, 0], low))
                order = order[keep[order]]
                out.append((int(c), len(order) > CANDIDATES, [(float(low[o]), float(xy[o, 0]), float(xy[o, 1]), int(least[o])) for o in order[:CANDIDATES]]))
            return out

        return task

    chosen = [bounds[c] == bounds[c].min() if len(bounds[c]) else None for c in range(k)]
    while True:
        some, cut = [{} for _ in range(k)], [None] * k
        for block in rows.each(picked(chosen)):
            for c, more, places in block:
                if more and (cut[c] is None or places[-1][:3] < cut[c]):
                    cut[c] = places[-1][:3]
                for b, x, y, i in places:
                    some[c][b, x, y] = min(i, some[c].get((b, x, y), i))
        opening = not np.isfinite(limit).any()
        now = [sorted(p for p in some[c] if cut[c] is None or p <= cut[c])[:CANDIDATES] for c in range(k)]
        if any(now):
            places = [np.array([p[1:] for p in ps]) if ps else np.empty((0, 2)) for ps in now]

            def exact(ids: np.ndarray, v: np.ndarray, places=places) -> list[np.ndarray]:
                at = label(v)
                return [_sums(ps, v[at == c, :2]) if len(ps) else np.empty(0) for c, ps in enumerate(places)]

            sums = rows.each(exact)
            for c, ps in enumerate(now):
                for n, p in enumerate(ps):
                    s = round(math.fsum(found[c][n] for found in sums), 9)
                    if best[c] is None or (s, some[c][p]) < best[c][0]:
                        best[c], limit[c] = ((s, some[c][p]), p[1:]), s
        if opening:  # the best cells' first places only gave limits
            done, chosen = [None] * k, [np.ones(len(b), bool) for b in bounds]
        else:
            left = [bool(now[c]) and (cut[c] is not None or len(now[c]) < len(some[c])) for c in range(k)]
            done = [now[c][-1] if now[c] else done[c] for c in range(k)]
            chosen = [chosen[c] if left[c] else None for c in range(k)]
        if all(c is None for c in chosen):
            return {c: b[1] for c, b in enumerate(best) if b is not None}


def swap_costs(points: DataFrame, centres: list[Centre], new: tuple[float, float]) -> DataFrame:
    """out, cost: the k-means cost if centre `out` is swapped for a new point, for all of them in one aggregation over cached first and second distances."""
    rows = nearest_centre(points, centres)
    to_new = (F.col("x") - new[0]) * (F.col("x") - new[0]) + (F.col("y") - new[1]) * (F.col("y") - new[1])
    stay, lost = F.least(F.col("d1") * F.col("d1"), to_new), F.least(F.coalesce(F.col("d2") * F.col("d2"), to_new), to_new)
    by = rows.groupBy("centre").agg(F.sum(stay).alias("stay"), F.sum(lost - stay).alias("more"))
    return by.join(by.agg(F.sum("stay").alias("all"))).select(F.col("centre").alias("out"), (F.col("all") + F.col("more")).alias("cost"))


def local_search(points: DataFrame, k: int, rounds: int = 400, seed: int = 0, steps: int = 2, snap: bool = True) -> tuple[list[Centre], float]:
    """swaps.local_search() of points without weights; without snap, so many Lloyd steps end it and centres needn't be points."""
    from . import swaps

    rows = points.select("id", "x", "y", F.lit(1).cast("long").alias("weight"))
    found, now = swaps.local_search(rows, k, rounds, seed)
    if snap or not found:
        return found, now
    found = lloyd(rows, found, steps)
    return found, cost(rows, found).first()[0] or 0.0


def multi_swap_search(points: DataFrame, k: int, rounds: int = 400, patience: int = 5, seed: int = 0) -> tuple[list[Centre], float]:
    """swaps.multi_swap_search() over the distinct places of points, weighted by their number."""
    from . import swaps
    from .clusterstats import duplicates

    return swaps.multi_swap_search(duplicates(points), k, rounds, seed, patience=patience)
