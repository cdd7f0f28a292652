"""Benchmark decontamination by greedy string tiling.

Shared runs of `seed` tokens are the seeds: every document's rolling hashes (Karp-Rabin) are held against those of
the benchmark, and only pairs that share a seed are tiled. A tile of t tokens holds t - seed + 1 seeds, so covering `coverage` of an
item takes a known number of its seeds, and only its rarest others (by the benchmark's own counts) need to be looked up. Tiling repeatedly
marks the longest matches of unmarked tokens between the pair, found by Karp-Rabin hashing of runs of the current length
and confirmed token by token, so that passages whose parts were moved about are still covered. Prefix sums
give the hash of a run of any length in one step. A pair counts as contaminated if its tiles cover `coverage` of the item's
tokens.

The benchmark is sent to the tasks in blocks of a bounded number of bytes, one scan of the documents for each block;
documents are never shuffled. A larger benchmark takes more scans, and no more memory.

Defined results: null and empty texts (documents' or items') match nothing; an item shorter than a seed is matched as
a whole; repeated rows (of either side) give a row each; ids may be null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

SEED, COVERAGE = 5, 0.5
#: Bytes of the benchmark's texts that are sent at once; items are never split.
BLOCK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, covered long, item_tokens long, tiles long, coverage double"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Runs:
    """Polynomial hashes modulo 2**64 of all runs of some ids (uint64)."""

    def __init__(self, ids: np.ndarray):
        up, self.down = _POWERS.of(len(ids))
        self.ids = ids
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * up, dtype=np.uint64)])

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        h = (self.sums[starts + n] - self.sums[starts]) * self.down[starts]
        return h ^ (h >> np.uint64(29))

    def all(self, n: int) -> np.ndarray:
        return self.at(np.arange(max(0, len(self.ids) - n + 1)), n)


def _free(starts: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Those starts of runs of n positions that lie inside and unmarked; sums: marked positions before each."""
    starts = starts[starts + n < len(sums)]
    return starts[sums[starts + n] == sums[starts]]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int, runs: Runs | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length), longest first; no token of either side lies in two tiles.

    The longest unmarked match is found by halving the lengths under which Karp-Rabin still finds one, and all matches of that
    length are marked before shorter ones are looked for. Only starts whose first `least` tokens match can begin a longer one."""
    if min(len(doc), len(item)) < least:
        return []
    theirs, own = runs or Runs(doc), Runs(item)
    doc_starts, item_starts = np.arange(len(doc) - least + 1), np.arange(len(item) - least + 1)
    doc_hashes, item_hashes = theirs.all(least), own.all(least)
    doc_starts, item_starts = doc_starts[_among(doc_hashes, np.sort(item_hashes))], item_starts[_among(item_hashes, np.sort(doc_hashes))]
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    doc_sums, item_sums = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    tiles: list[tuple[int, int, int]] = []

    def matches(n: int) -> Iterator[tuple[int, int]]:
        """Matches of n tokens, by their starts."""
        i, d = _free(item_starts, n, item_sums), _free(doc_starts, n, doc_sums)
        if not len(i) or not len(d):
            return
        hashes = own.at(i, n)
        order = np.argsort(hashes, kind="stable")
        i, hashes = i[order], hashes[order]
        wanted = theirs.at(d, n)
        low = np.searchsorted(hashes, wanted)
        for k in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == wanted).tolist():
            at, j = int(d[k]), int(low[k])
            if doc_marked[at] or doc_marked[at + n - 1]:
                continue
            while j < len(i) and hashes[j] == wanted[k]:
                start = int(i[j])
                if not (item_marked[start] or item_marked[start + n - 1]) and np.array_equal(doc[at : at + n], item[start : start + n]):
                    yield at, start
                    break
                j += 1

    longest = min(len(item), len(doc)) + 1
    while longest > least:
        low, high = least - 1, longest  # some match of low tokens (or low is too short), none of high
        while high - low > 1:  # a match of n tokens holds one of n - 1
            mid = (low + high) // 2
            if next(matches(mid), None) is not None:
                low = mid
            else:
                high = mid
        longest = low
        if longest < least:
            break
        for at, start in matches(longest):
            tiles.append((at, start, longest))
            doc_marked[at : at + longest] = True
            item_marked[start : start + longest] = True
        doc_sums[1:], item_sums[1:] = np.cumsum(doc_marked), np.cumsum(item_marked)
    return tiles


class Tiler:
    """Benchmark items (item_id, tokens, copies) with the seeds to look them up by, and the pairs of a text with them."""

    def __init__(self, items: list[tuple[int, list[str], int]], seed: int, least: float):
        self.least, self.seed = least, seed
        known: dict[str, int] = {}
        self.coded = [(item_id, np.array([known.setdefault(w, len(known) + 1) for w in words], np.uint64), copies) for item_id, words, copies in items]
        own = [Runs(ids).all(min(seed, len(ids))) for _, ids, _ in self.coded]
        counts = Counter(h for hashes in own for h in set(hashes.tolist()))
        by_length: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, hashes in enumerate(own):
            size = min(seed, len(self.coded[n][1]))
            need = max(1, math.ceil(math.ceil(least * len(self.coded[n][1])) / size))
            rarest = sorted(hashes.tolist(), key=lambda h: (counts[h], h))[: max(1, len(hashes) - need + 1)]
            for h in set(rarest):
                by_length[size][h].append(n)
        self.seeds = {n: (hashes, np.sort(np.fromiter(hashes, np.uint64, len(hashes)))) for n, hashes in by_length.items()}
        self.code = known.get

    def pairs(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """item_id, tokens covered, tokens of the item, tiles and coverage of each item that is covered enough."""
        words = tokens(text) if text else []
        ids = np.fromiter(map(self.code, words, repeat(0)), np.uint64, len(words))
        if not ids.any():
            return []
        candidates: set[int] = set()
        zeros, runs = np.concatenate([[0], np.cumsum(ids == 0)]), Runs(ids)
        for n, (hashes, ordered) in self.seeds.items():
            if len(ids) < n:
                continue
            own = runs.at(np.flatnonzero(zeros[n:] == zeros[:-n]), n)
            for h in np.unique(own[_among(own, ordered)]).tolist():
                candidates.update(hashes[h])
        out = []
        for n in sorted(candidates):
            item_id, item, copies = self.coded[n]
            tiles = greedy_tiles(ids, item, min(self.seed, len(item)), runs)
            covered = sum(t[2] for t in tiles)
            if covered and covered >= self.least * len(item):
                out += [(item_id, covered, len(item), len(tiles), round(covered / len(item), 6))] * copies
        return out


@lean
def _scan(batches: Iterator[pa.RecordBatch], tiler: Tiler) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(doc_id, *pair) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pair in tiler.pairs(text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, [pa.int64()] * 5 + [pa.float64()], strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


@lean
def _clean(batches: Iterator[pa.RecordBatch], tiler: Tiler) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not tiler.pairs(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.bool_()))


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str], int]]]:
    """Items with their tokens and how often their row is repeated, about BLOCK_BYTES of text at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, words, r.copies) for r in own.toLocalIterator() if (words := tokens(r.text))]


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """A row for each pair of document and item whose tiles cover at least that share of the item."""
    out = None
    for rows in _item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        part = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda batches, sent=sent: _scan(batches, Tiler(sent.value, seed, coverage)), SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """docs (all columns) without the rows that hold an item; each block of items is a pass over what is left, without a shuffle."""
    for rows in _item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        docs = docs.mapInArrow(lambda batches, sent=sent: _clean(batches, Tiler(sent.value, seed, coverage)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
