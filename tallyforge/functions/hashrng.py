"""Counter-based random numbers: a hash of a seed and the row's own columns, so that no order or partitioning matters.

``sha_int`` is made of SHA-256, so that other engines can give the same numbers; ``hash_int`` is faster.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_int(*parts: Column | int | str) -> Column:
    """An integer of 0 to 2**48 - 1 from the parts, joined as text by ``:``."""
    joined = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 12), 16, 10).cast("bigint")


def hash_int(*parts: Column | int | str) -> Column:
    """A non-negative integer below 2**63."""
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).bitwiseAND(F.lit(2**63 - 1))


def between(value: Column, low: Column | int, high: Column | int) -> Column:
    """A drawn integer brought into low..high."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return low + F.pmod(value, high - low + 1)


def coin(*parts: Column | int | str) -> Column:
    """True for half of all inputs."""
    return F.pmod(sha_int(*parts), F.lit(2)) == 1
