"""Random draws that depend on a row's columns and a seed only, never on partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | Column, *cols: str) -> Column:
    """A number above 0, at most 1, from the first 40 bits of the md5 of the columns and the seed, joined by colons."""
    salt = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols], salt).cast("binary")), 1, 10), 16, 10)
    return (bits.cast("long") + 1) / float(1 << 40)


def normal(seed: int, *cols: str) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(2 * seed, *cols))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *cols))


def truncated(draw: Callable[[int], Column], low: float, high: float, otherwise: Column, tries: int = 8) -> Column:
    """The first of some draws that lies between the bounds; if none does, the other value."""
    return F.coalesce(*[F.when(draw(k).between(low, high), draw(k)) for k in range(tries)], otherwise)
