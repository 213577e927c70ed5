"""The last outcomes of each problem as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class LastOutcomes(StatefulProcessor):
    """Keeps the ``length`` last of a problem's outcomes in order of (step, place), in whatever order they come: a late one takes its
    place among them, and one that comes again replaces itself. ``ttl_ms``: state of a problem that no outcome came for is dropped."""

    def __init__(self, length: int, ttl_ms: int | None = None):
        self.length, self.ttl_ms = length, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "steps array<bigint>, places array<bigint>, right array<boolean>, turn bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps, places, right, turn = self.kept.get() or ([], [], [], 0)  # one value: each call goes to the JVM and back
        held = dict(zip(zip(steps, places, strict=True), right, strict=True))
        for row in rows:
            held[row["step"], row["place"]] = row["correct"]
            if len(held) > 2 * self.length:
                held = dict(sorted(held.items())[-self.length :])
        held = dict(sorted(held.items())[-self.length :])
        right = [bool(c) for c in held.values()]
        self.kept.update(([s for s, _ in held], [p for _, p in held], right, turn + 1))
        yield Row(problem_id=key[0], n=len(held), right=sum(right), turn=turn + 1)

    def close(self) -> None:
        pass


def _last_of_batches(length: int):
    """Of each Arrow batch the rows that can be among a problem's last; so a problem that a third of the log is about sends few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["step", "place"], kind="stable").groupby("problem_id", sort=False).tail(length)

    return run


def pass_history(outcomes: DataFrame, length: int = 32, place: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """problem_id, n, right, turn: how many outcomes are among each problem's last ``length`` and how many of those are right, in update
    mode, a row whenever outcomes came; the largest ``turn`` of a problem is its newest row.

    ``outcomes``: problem_id, step, correct, and ``place``, which tells a step's outcomes apart; without one a step has one outcome. Rows
    without problem or step are left out, and a null outcome counts as wrong. Needs the RocksDB state store (``state_store``)."""
    key = outcomes.schema["problem_id"].dataType.simpleString()
    rows = outcomes.where("problem_id is not null and step is not null").select(
        "problem_id", F.col("step").cast("long").alias("step"), (F.coalesce(F.col(place).cast("long"), F.lit(0)) if place else F.lit(0).cast("long")).alias("place"), F.coalesce("correct", F.lit(False)).alias("correct")
    )
    rows = rows.mapInPandas(_last_of_batches(length), rows.schema)
    return rows.groupBy("problem_id").transformWithState(LastOutcomes(length, ttl_ms), f"problem_id {key}, n long, right long, turn long", "Update", "ProcessingTime" if ttl_ms else "None")


def newest(updates: DataFrame) -> DataFrame:
    """Of the rows of ``pass_history`` the newest of each problem: problem_id, n, right."""
    return updates.groupBy("problem_id").agg(F.max_by(F.struct("n", "right"), "turn").alias("last")).select("problem_id", "last.*")


def active(histories: DataFrame) -> DataFrame:
    """Problems whose last outcomes are mixed, as ``operators.dynamics.active_prompts`` has them."""
    return histories.where((F.col("right") > 0) & (F.col("right") < F.col("n"))).select("problem_id", "n", F.col("right").alias("s"))
