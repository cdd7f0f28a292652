"""Points in cached blocks for searches that pass over them hundreds of times: a pass is one job of NumPy in tasks, and its results come in the order of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written

#: Points of a block at most and at least; between them there are about PARTS blocks. All follows from the number of points, so sums don't depend on the session.
MOST, LEAST, PARTS = 8192, 512, 32


class Blocks:
    """id and numeric columns of points: blocks by a hash of the id, each sorted by id, so that sums are added in the same order in every run."""

    def __init__(self, points: DataFrame, cols: list[str]):
        n = points.count()
        parts = max(1, -(-n // min(MOST, max(LEAST, n // PARTS))))
        rows = points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(f"_c{n}") for n, c in enumerate(cols)]).repartition(parts, "id").sortWithinPartitions("id")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]  # about MOST rows at most
            if held:
                t = pa.Table.from_batches(held)
                values = np.stack([c.to_numpy() for c in t.columns[1:]], 1).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([t.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["ids", "rows"])

        self.table, width = written(rows.mapInArrow(packed, "ids binary, rows binary"), "blocks"), len(cols)
        self.rdd = self.table.rdd.map(lambda r: (np.frombuffer(bytes(r.ids), "<i8"), np.frombuffer(bytes(r.rows), "<f8").reshape(-1, width))).persist()

    def each(self, task: Callable[[np.ndarray, np.ndarray], object]) -> list:
        """task(ids, values) of every block."""
        found = self.rdd.map(lambda b: (int(b[0][0]), task(*b))).collect()
        return [v for _, v in sorted(found, key=lambda t: t[0])]

    def summed(self, task: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of task(ids, values) over all blocks, of which the driver gets PARTS parts at most; None without blocks."""

        def added(blocks: Iterator) -> list[np.ndarray]:
            found = None
            for b in blocks:
                found = task(*b) if found is None else found + task(*b)
            return [] if found is None else [found]

        parts = self.rdd.coalesce(PARTS).mapPartitions(added).collect()
        return sum(parts[1:], parts[0]) if parts else None

    def close(self) -> None:
        self.rdd.unpersist()
        discard(self.table)


def uniform(seeds: list[int], ids: np.ndarray) -> Iterator[np.ndarray]:
    """draws.uniform(seed, "id") of ids, for one seed after the other."""
    names, md5 = [b"%d:" % i for i in ids.tolist()], hashlib.md5
    for salt in (b"%d" % s for s in seeds):
        digests = np.frombuffer(b"".join([md5(n + salt).digest() for n in names]), "u1").reshape(-1, 16)[:, :5].astype(np.int64)
        yield (digests @ (1 << np.arange(32, -1, -8, dtype=np.int64)) + 1) / float(1 << 40)
