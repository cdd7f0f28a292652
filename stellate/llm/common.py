"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, importable, shared_folder, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, folds: int, fold: int = 1) -> Column:
    """crc32(doc_id as text) mod folds is the fold; a null doc_id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


#: Ids that are broadcast at most (8 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """ids (one long column), with a broadcast hint if there are few; they are written first, so that they are counted once."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release() -> None:
    """Gives memory that a task freed back to the system: Python workers are used again, and keep what they once had otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(*args, **named) -> Iterator:
        try:
            yield from task(*args, **named)
        finally:
            release()

    return run
