"""Logs of runs that are restarted: which attempt's rows of a step count, and sums of steps kept in a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.ledger import Ledger


def fences(rows: DataFrame, run: list[str], attempt: str = "attempt", start: str = "resumed_from") -> DataFrame:
    """``run``, fences: array of (attempt, resumed_from). Rows say in ``start`` the last step that their attempt took over, and -1 or null
    if it began anew."""
    known = rows.groupBy(*run, attempt).agg(F.max(F.coalesce(F.col(start), F.lit(-1))).cast("long").alias("from_"))
    return known.groupBy(*run).agg(F.collect_list(F.struct(F.col(attempt).cast("long").alias("attempt"), F.col("from_").alias("start"))).alias("fences"))


def newest_attempts(rows: DataFrame, run: list[str], step: str = "step", attempt: str = "attempt", start: str = "resumed_from") -> DataFrame:
    """``rows`` that count: a step's rows are those of the last attempt that began before it, however late they were written. What an
    earlier attempt wrote behind the place where a later one resumed is stale, also as long as the later one hasn't come that far.
    Rows without a step (records of a start) fence, and don't count. Runs are few beside rows, and so are their attempts."""
    fenced = rows.join(fences(rows, run, attempt, start), run)
    owner = F.array_max(F.transform(F.filter("fences", lambda f: f["start"] < F.col(step)), lambda f: f["attempt"]))
    return fenced.where(F.col(step).isNotNull() & (F.col(attempt) == owner)).select(*rows.columns)


#: What a log is cut down to, batch by batch: sums that add up.
_SUMS = ("n", "reward_sum", "n_correct")


def step_sums(rewards: DataFrame, run: list[str]) -> DataFrame:
    """Of a batch of reward rows (run, attempt, resumed_from, step, reward, correct) a row for each run, attempt and step."""
    by = rewards.groupBy(*run, "attempt", "resumed_from", "step")
    return by.agg(F.count("*").alias("n"), F.coalesce(F.sum("reward"), F.lit(0.0)).alias("reward_sum"), F.count_if("correct").alias("n_correct"))


def merged_sums(rows: DataFrame, run: list[str]) -> DataFrame:
    return rows.groupBy(*run, "attempt", "resumed_from", "step").agg(*[F.sum(c).alias(c) for c in _SUMS])


def step_ledger(spark: SparkSession, folder: str, run: list[str]) -> Ledger:
    """A ledger of step sums: of a log of any length it keeps a row for each run, attempt and step, and batch."""
    return Ledger(spark, folder, lambda rows: merged_sums(rows, run))


def step_stats(ledger: Ledger, run: list[str]) -> DataFrame:
    """``run``, step, n, reward_mean, n_correct: each step counted once, from the attempt that owns it."""
    sums = newest_attempts(ledger.read(), run).groupBy(*run, "step").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return sums.select(*run, "step", "n", (F.col("reward_sum") / F.col("n")).alias("reward_mean"), "n_correct")
