"""Digests of text files of any length, by a tree over their lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: Lines, or digests, that one digest is taken over; LEVELS of them hold any file.
FAN, LEVELS = 4_096, 5
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def line_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n, d: the place (from 0) and SHA-256 of each line. Files are read in splits; a line's place is its place in the split behind the
    lines of the splits before, so it doesn't depend on how files are split."""
    read = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.sha2(F.col("value").cast("binary"), 256).alias("d")
    )
    splits = read.groupBy("path", "start").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # the splits of a file
    shifts = splits.select("path", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return read.join(shifts, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("n"), "d")


def _collected(rows: DataFrame) -> DataFrame:
    """path, n, d of the nodes ``up``, whose digests a task holds at once."""
    rows = rows.groupBy("path", "up").agg(F.sort_array(F.collect_list(F.struct("n", "d"))).alias("part"))
    return rows.select("path", F.col("up").alias("n"), F.sha2(F.array_join(F.transform("part", lambda p: p["d"]), "").cast("binary"), 256).alias("d"))


def _in_turn(rows: DataFrame) -> DataFrame:
    """``_collected`` for nodes of any number of digests: a task goes through them sorted, and holds the state of one SHA-256."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done = lambda: pa.RecordBatch.from_pydict({"path": pa.array([at[0]]), "n": pa.array([at[1]]), "d": pa.array([state.hexdigest()])})
        for batch in batches:
            for path, up, d in zip(*(batch.column(c).to_pylist() for c in ("path", "up", "d")), strict=True):
                if (path, up) != at:
                    if at:
                        yield done()
                    at, state = (path, up), hashlib.sha256()
                state.update(d.encode())
        if at:
            yield done()

    return rows.repartition("path", "up").sortWithinPartitions("path", "up", "n").select("path", "up", "d").mapInArrow(hashed, "path string, n long, d string")


def tree_digests(spark: SparkSession, paths: list[str], fan: int = FAN) -> DataFrame:
    """path (with scheme and host, but for local ones), digest: for each of these files a SHA-256 over its lines in order; line ends and one at the end don't count. ``fan`` lines
    make a leaf and ``fan`` digests a node, always LEVELS deep, so a task never holds more than FAN digests, however long the file is: nodes of more are hashed digest by digest."""
    rows = line_digests(spark, paths)
    for _ in range(LEVELS):
        rows = (_collected if fan <= FAN else _in_turn)(rows.select("path", F.floor(F.col("n") / fan).alias("up"), "n", "d"))
    there = spark.createDataFrame([(files.plain_path(files.qualified(spark, p)),) for p in paths], "path string")
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "d")
    return there.join(rows, "path", "left").select("path", F.coalesce("d", F.lit(_EMPTY)).alias("digest"))
