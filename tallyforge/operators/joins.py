"""Joins whose keys may be shared by any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one in so many rows share is joined by broadcast: there are fewer such keys than this.
HOT_KEYS = 10_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` (``how``: inner or left). ``right`` has one row a key and in ``n`` how many rows of
    ``left`` have it. Hot keys are broadcast, fewer than HOT_KEYS rows; the rest is shuffled, and none of its keys has more than one
    in HOT_KEYS of the rows. So no task gets a key's rows, however many they are. Both sides are read twice and should be stored."""
    total = right.agg(F.sum(n).alias("n")).first()["n"] or 0
    hot = right.where(F.col(n) * HOT_KEYS > total)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(n) * HOT_KEYS <= total), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
