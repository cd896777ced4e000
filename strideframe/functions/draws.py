"""Repeatable randomness, so every shuffle and draw can be recomputed anywhere: orders and rare draws from md5, draws in
bulk from a 64-bit mixing function on arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, SparkSession, functions as F


def keyed(*parts: Column | str | int) -> Column:
    """Text key made of the parts joined by '|'; plain values are literals."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(*parts: Column | str | int) -> Column:
    """Pseudo-random text to sort by."""
    return F.md5(keyed(*parts))


def hash_block(key: Column, digits: int | None = None) -> Column:
    """Leading hex digits of an order key: evenly filled blocks that follow its order.

    Without `digits` there are at least four blocks for each shuffle partition.
    """
    if digits is None:
        spark = SparkSession.active()
        digits = max(2, math.ceil(math.log(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 16)))
    return F.substring(key, 1, digits)


def hash_number(text: Column) -> Column:
    """Non-negative 60-bit integer."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def pick(size: Column, *parts: Column | str | int) -> Column:
    """Draw of an index in [0, size)."""
    return F.pmod(hash_number(keyed(*parts)), size.cast("bigint"))


#: Fixed values of the mixing function: the step between streams, and the two multipliers.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def stream(salt: str) -> int:
    """State of the stream that a salt names."""
    return int(hashlib.md5(salt.encode()).hexdigest()[:15], 16)


def descend(state: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """State of the child `part` (0 or more) of a state: unsigned 64-bit integers that wrap around."""
    with np.errstate(over="ignore"):
        x = np.asarray(state, np.uint64) + (np.asarray(part).astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
        return x ^ (x >> np.uint64(31))
