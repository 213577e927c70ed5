"""Positions of rows in an order over all of them, without a window that spans all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.files import stored

#: Rows of a range of the order, about: there are as many ranges as that takes, so a task's share doesn't grow with the table.
RANGE_ROWS = 1 << 18


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] = [], range_rows: int = RANGE_ROWS) -> DataFrame:  # noqa: B006
    """``rows`` with ``name``, the place from 0 in ``order`` (within ``by``).

    Spark samples the order, splits it into ranges and sorts them; the ranges are stored, counted, and a row's place is its place in the
    range behind the ranges before. Rows that ``order`` doesn't tell apart are ordered by a hash of all their columns (but maps), so only
    rows alike in everything share a range whatever their number; those are ordered at will."""
    told = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = rows.withColumn("tie_", F.xxhash64(*[F.col(f"`{c}`") for c in told]))
    key = [*(F.col(f"`{c}`") for c in (*by, *order)), F.col("tie_")]
    ranges = max(1, -(-rows.count() // range_rows))
    at = F.monotonically_increasing_id()
    laid = stored(keyed.repartitionByRange(ranges, *key).sortWithinPartitions(*key).drop("tie_").withColumn("range_", F.shiftright(at, 33)).withColumn("at_", at.bitwiseAND((1 << 33) - 1)))
    counts = laid.groupBy(*by, "range_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))  # a range of the order is one group, or the end of one and the next ones
    # of each group the rows in the ranges before; without ``by`` there are as many rows as ranges
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [f"by{i}_" for i in range(len(by))]
    starts = counts.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, named, strict=True)], F.col("range_").alias("of_"), (before - F.col("first_")).alias("shift_"))
    on = F.col("range_") == F.col("of_")
    for c, n in zip(by, named, strict=True):
        on &= F.col(f"`{c}`").eqNullSafe(F.col(n))
    return laid.join(starts, on).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("at_") + F.col("shift_")).alias(name))
