"""k-means of many sets of features at once: every pass over the points is one job that serves all clusterings, whatever step each of them has reached.

Points lie in blocks of a fixed number of rows, sorted by id, so sums are added in the same order in every run. A start is k-means||: one point, then twice 2 k
points drawn by squared distance (the least exponential keys on a hash of id and seed), weighed by the points nearest to each and reduced to k at the driver. Up
to 20 Lloyd steps follow, until no centre moves by more than 1e-4. Regularised runs repeat that with new weights of their features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from .draws import uniform
from .scaling import bounds

#: Points of a block; Lloyd steps of a clustering, and the distance at which centres rest; steps over the weighed candidates of a start.
ROWS, STEPS, REST, LOCAL = 8192, 20, 1e-4, 30
_DRAWS = 3


@dataclass
class Run:
    """A clustering and how far it is. cols: places of its features; lo, span: their scaling; weights: of the round it is in."""

    cols: list[int]
    lo: np.ndarray
    span: np.ndarray
    k: int
    seed: int
    penalty: float | None
    rounds: int
    weights: np.ndarray = None
    phase: str = "draw"  # draw, weigh, lloyd, done
    step: int = 0
    turn: int = 0
    centres: np.ndarray = None
    before: np.ndarray | None = None
    known: dict[bytes, np.ndarray] = field(default_factory=dict)

    def placed(self, block: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (block[:, self.cols] - self.lo) / self.span * weights

    def asked(self) -> tuple:
        """What tasks need to know."""
        return self.phase, self.step, self.cols, self.lo, self.span, self.weights, self.centres, 2 * self.k

    def begin(self, first: np.ndarray) -> None:
        """A round: what it finds depends on its weights only, so a round with weights that were there before isn't run again."""
        while (found := self.known.get(self.weights.tobytes())) is not None:
            self.centres = found
            if self._rests():
                return
        self.centres, self.phase, self.step = self.placed(first[None], self.weights), "draw", 0

    def take(self, parts: list, first: np.ndarray) -> None:
        """One pass's results, in the order of blocks."""
        if self.phase == "draw":
            keys, ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = rows[np.lexsort((ids, keys))[: 2 * self.k]]
            self.centres, self.step = np.unique(np.concatenate([self.centres, new]), axis=0), self.step + 1
            if self.step == _DRAWS - 1:
                self.phase, self.step = ("lloyd", 0) if len(self.centres) <= self.k else ("weigh", 0)
        elif self.phase == "weigh":
            self.centres, self.phase, self.step = reduced(self.centres, sum(parts), self.k, self.seed), "lloyd", 0
        else:
            counts, sums = sum(p[0] for p in parts), sum(p[1] for p in parts)
            after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centres)
            rests = bool((((after - self.centres) ** 2).sum(1) <= REST**2).all())
            self.centres, self.step = after, self.step + 1
            if rests or self.step >= STEPS:
                self.known[self.weights.tobytes()] = self.centres
                if not self._rests():
                    self.begin(first)

    def _rests(self) -> bool:
        """Ends the round. If that was the last, centres and weights are the result; otherwise the next round's weights follow from the centres' norms."""
        found = self.centres[np.lexsort(self.centres.T[::-1])]
        same = self.before is not None and self.before.shape == found.shape and bool((np.abs(self.before - found) <= 1e-4).all())
        self.before, self.turn = found, self.turn + 1
        if self.penalty is None or same or self.turn >= self.rounds:
            self.phase = "done"
            return True
        norms = np.sqrt((found**2).sum(0))
        self.weights = np.where(norms > 0, np.maximum(0.0, 1 - self.penalty / np.where(norms > 0, norms, 1.0)), 0.0)
        return False


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centres)))
    for n in range(x.shape[1]):
        out += (x[:, n, None] - centres[:, n]) ** 2
    return out


def reduced(places: np.ndarray, counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of a few weighed places by k-means++ and weighted Lloyd steps."""
    rng, w = np.random.default_rng(seed), counts.astype(float)
    chosen = [int(rng.choice(len(places), p=w / w.sum()))]
    while len(chosen) < k:
        share = w * _squares(places, places[chosen]).min(1)
        if share.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(places), p=share / share.sum())))
    centres = places[chosen]
    for _ in range(LOCAL):
        near = _squares(places, centres).argmin(1)
        n = np.bincount(near, w, len(centres))
        sums = np.stack([np.bincount(near, w * c, len(centres)) for c in places.T], 1)
        after = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
        if (after == centres).all():
            break
        centres = after
    return centres


def _pass(blocks: Iterator[tuple], asked: list[tuple]) -> Iterator[tuple]:
    """The first id of each block, and what each clustering asks of it."""
    for ids, draws, block in blocks:
        out = []
        for phase, step, cols, lo, span, weights, centres, most in asked:
            x = (block[:, cols] - lo) / span * weights
            d = _squares(x, centres)
            if phase == "draw":
                cost = d.min(1)
                at = np.flatnonzero(cost > 0)
                keys = -np.log(draws[at, step + 1]) / cost[at]
                best = np.lexsort((ids[at], keys))[:most]
                out.append((keys[best], ids[at][best], x[at][best]))
            else:
                near = d.argmin(1)
                counts = np.bincount(near, minlength=len(centres))
                out.append(counts if phase == "weigh" else (counts, np.stack([np.bincount(near, c, len(centres)) for c in x.T], 1)))
        yield int(ids[0]), out


def _blocks(features: DataFrame, cols: list[str], seed: int):
    """The points as a cached RDD of (ids, draws, features), and the table behind it. Rows of a partition are few, and sorted by id."""
    parts = max(1, -(-features.count() // ROWS))
    rows = features.select(F.col("id").cast("long").alias("id"), *[uniform(seed * _DRAWS + n, "id").alias(f"_u{n}") for n in range(_DRAWS)], *[F.col(c).cast("double").alias(f"_f{n}") for n, c in enumerate(cols)])
    rows = rows.repartition(parts, "id").sortWithinPartitions("id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about ROWS rows
        if held:
            t = pa.Table.from_batches(held)
            values = np.stack([c.to_numpy() for c in t.columns[1:]], 1).astype("<f8")
            if not np.isfinite(values).all():
                raise ValueError("features hold null or non-finite values")
            yield pa.RecordBatch.from_arrays([pa.array([t.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["ids", "rows"])

    table = written(rows.mapInArrow(packed, "ids binary, rows binary"), "blocks")
    width = _DRAWS + len(cols)

    def opened(r) -> tuple:
        values = np.frombuffer(bytes(r.rows), "<f8").reshape(-1, width)
        return np.frombuffer(bytes(r.ids), "<i8"), values[:, :_DRAWS], values[:, _DRAWS:]

    return table.rdd.map(opened).persist(), table


def clusterings(features: DataFrame, sets: dict, k: int, penalty: float = 0.1, rounds: int = 20, seed: int = 0) -> dict:
    """{key: (columns, lo, span, weights, centres)} of sets {key: (columns, regularised)} over features (id and the columns).

    Regularised runs scale their features to 0..1 and weigh them by max(0, 1 - penalty / norm of the centres' coordinates) until the centres rest, for `rounds` rounds at most."""
    cols = sorted({c for names, _ in sets.values() for c in names})
    b = bounds(features, cols)
    if b[cols[0]][0] is None:
        return {}
    blocks, table = _blocks(features, cols, seed)
    _, _, first = blocks.map(lambda t: min(zip(t[1][:, 0].tolist(), t[0].tolist(), t[2].tolist(), strict=True))).min()
    first, runs = np.array(first), {}
    for key, (names, regularised) in sets.items():
        lo, hi = (np.array([float(b[c][n]) for c in names]) for n in (0, 1))
        span = np.where(hi > lo, hi - lo, 1.0)
        runs[key] = Run([cols.index(c) for c in names], lo if regularised else np.zeros(len(names)), span if regularised else np.ones(len(names)), k, seed, penalty if regularised else None, rounds, np.ones(len(names)))
        runs[key].begin(first)
    while live := [r for r in runs.values() if r.phase != "done"]:
        asked = [r.asked() for r in live]
        found = sorted(blocks.mapPartitions(lambda p, asked=asked: _pass(p, asked)).collect(), key=lambda t: t[0])
        for n, r in enumerate(live):
            r.take([parts[n] for _, parts in found], first)
    blocks.unpersist()
    discard(table)
    # a round that ends keeps its own weights: they are those its centres were found with
    return {key: (list(sets[key][0]), r.lo, r.span, r.weights, r.centres) for key, r in runs.items()}


def counted(features: DataFrame, found: dict, by: list[str], label: str = "label") -> DataFrame:
    """by (the parts of the keys), label_true, label_pred, n: how often a label meets a cluster; tasks count a batch before it is shuffled."""
    cols = sorted({c for names, *_ in found.values() for c in names})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, (names, lo, span, weights, centres) in found.items():
                near = _squares((frame[names].to_numpy(float) - lo) / span * weights, centres).argmin(1)
                n = pd.DataFrame({"label_true": frame["_true"], "label_pred": near}).groupby(["label_true", "label_pred"], dropna=False).size().reset_index(name="n")
                for c, part in zip(by, key, strict=True):
                    n[c] = part
                yield n[[*by, "label_true", "label_pred", "n"]]

    kinds = {str: "string", bool: "boolean"}
    keys = ", ".join(f"{c} {kinds[type(v)]}" for c, v in zip(by, next(iter(found), ("",) * len(by)), strict=True))
    rows = features.select(F.col(label).cast("long").alias("_true"), *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.mapInPandas(count, f"{keys}, label_true long, label_pred long, n long")
