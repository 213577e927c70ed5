"""Tiers by pass rate, selection of verified answers, and leak-free splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashrng import sha_int

from .ordering import numbered

TIERS = ("easy", "medium", "hard")


def tier_of(pass8: Column, k: int = 8) -> Column:
    """6 of 8 and more: easy; 2 to 5: medium; fewer: hard. Outside 0..k it is an error."""
    bad = F.raise_error(F.concat(F.lit("pass count out of range: "), pass8.cast("string")))
    return F.when((pass8 < 0) | (pass8 > k), bad).when(pass8 >= 6, "easy").when(pass8 >= 2, "medium").when(pass8.isNotNull(), "hard")


def pass8(samples: DataFrame, k: int = 8) -> DataFrame:
    """Right answers among the first ``k`` in generation order."""
    first = samples.where(F.col("sample_idx") < k)
    return first.groupBy("problem_id").agg(F.count_if("correct").alias("pass8"), F.count("*").alias("n"))


def tiered(problems: DataFrame, counts: DataFrame, k: int | None = None) -> DataFrame:
    """Problems with pass8 (0 where unknown) and tier; with ``k`` given, fewer or more answers than that are an error."""
    joined = problems.join(counts, "problem_id", "left")
    passed = F.coalesce("pass8", F.lit(0))
    if k is not None:
        passed = F.when(F.coalesce("n", F.lit(0)) == k, passed).otherwise(F.raise_error(F.concat(F.lit("not exactly k answers: "), F.col("problem_id").cast("string"))).cast("bigint"))
    return joined.withColumn("pass8", passed).withColumn("tier", tier_of(F.col("pass8"))).drop("n")


def histogram(counts: DataFrame, k: int = 8) -> DataFrame:
    """pass8 0..k with the number of problems, zeros included."""
    bins = counts.sparkSession.range(k + 1).select(F.col("id").alias("pass8"))
    return bins.join(counts.groupBy("pass8").agg(F.count("*").alias("n_problems")), "pass8", "left").na.fill({"n_problems": 0})


def curated(samples: DataFrame, low: int = 1, high: int = 7, k: int = 8) -> DataFrame:
    """Problems that are neither always nor never solved among the first ``k``."""
    return pass8(samples, k).where(F.col("pass8").between(low, high)).select("problem_id", "pass8")


def rejection_select(samples: DataFrame, only_curated: bool = False, cap: int | None = None) -> DataFrame:
    """Right answers, the first of each text for a problem, at most ``cap`` for a problem (in generation order)."""
    right = samples.where("correct")
    if only_curated:
        right = right.join(curated(samples).select("problem_id"), "problem_id", "left_semi")
    same = Window.partitionBy("problem_id", "completion").orderBy("sample_idx")
    kept = right.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    if cap is not None:
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("problem_id").orderBy("sample_idx"))).where(F.col("nth") <= cap).drop("nth")
    return kept


def selection_budget(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """prompts, answers available, right before dedup, kept."""
    a = samples.agg(F.count_distinct("problem_id").alias("prompts"), F.count("*").alias("available"), F.count_if("correct").alias("correct"))
    return a.crossJoin(selected.agg(F.count("*").alias("kept"), F.count_distinct("problem_id").alias("kept_prompts")))


def interleave(rows: DataFrame, order: str) -> DataFrame:
    """position: easy, medium, hard in turn, each in its own order, for as long as they last; other tiers come last."""
    rank = F.when(F.col("tier") == "easy", 0).when(F.col("tier") == "medium", 1).when(F.col("tier") == "hard", 2).otherwise(3)
    keyed = rows.withColumns({"rank_": rank, "named_": F.when(rank == 3, F.col("tier"))})
    turned = numbered(keyed, ["named_", order], "turn_", by=["rank_"])
    # a row's position is counted from the sizes of the tiers (four numbers) and its place in its own
    sizes = {r["rank_"]: r["n"] for r in turned.groupBy("rank_").agg(F.count("*").alias("n")).collect()}
    earlier = [F.least(F.lit(sizes.get(other, 0)), F.col("turn_") + F.when(F.lit(other) < F.col("rank_"), 1).otherwise(0)) for other in range(3)]
    last = F.lit(sum(n for k, n in sizes.items() if k < 3)) + F.col("turn_")
    return turned.select(*rows.columns, F.when(F.col("rank_") == 3, last).otherwise(sum(earlier, F.lit(0))).cast("bigint").alias("position"))


def build_splits(problems: DataFrame, wanted: list[tuple[str, dict[str, int]]], seed: int = 0) -> DataFrame:
    """problem_id, split, tier, structure_id: for each split in turn and each tier, so many problems of unused structures.

    Within a tier problems come by a seeded hash; of a structure the first counts. ``problems``: problem_id, structure_id, tier.
    A handful of small plans, each on what the ones before it left; too few problems are an error."""
    pool = problems.select("problem_id", "structure_id", "tier", sha_int(seed, F.col("problem_id")).alias("o"))
    out = None
    for split, counts in wanted:
        for tier, n in counts.items():
            free = pool.where(F.col("tier") == tier)
            if out is not None:
                free = free.join(out.select("structure_id").distinct(), "structure_id", "left_anti")
            first = free.withColumn("k", F.row_number().over(Window.partitionBy("structure_id").orderBy("o", "problem_id"))).where("k = 1")
            part = first.orderBy("o", "problem_id").limit(n).select("problem_id", F.lit(split).alias("split"), "tier", "structure_id")
            out = part if out is None else out.union(part)
    return out


def short_splits(splits: DataFrame, wanted: list[tuple[str, dict[str, int]]]) -> DataFrame:
    """Splits that came out short; a build is good if there are none."""
    need = splits.sparkSession.createDataFrame([(s, t, n) for s, c in wanted for t, n in c.items()], "split string, tier string, wanted long")
    have = splits.groupBy("split", "tier").agg(F.count("*").alias("have"))
    return need.join(have, ["split", "tier"], "left").na.fill({"have": 0}).where("have < wanted")


def overlaps(splits: DataFrame, key: str = "problem_id") -> DataFrame:
    """Keys that two splits share, counted by pair of splits."""
    a = splits.select(F.col("split").alias("split_a"), key).distinct()
    b = splits.select(F.col("split").alias("split_b"), key).distinct()
    return a.join(b, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def not_subset(derived: DataFrame, parent: DataFrame, key: str = "problem_id") -> DataFrame:
    return derived.join(parent.select(key).distinct(), key, "left_anti")


def spread_counts(total: int, cells: int) -> list[int]:
    """``total`` dealt evenly over cells, the remainder to the first."""
    return [total // cells + (i < total % cells) for i in range(cells)]


def wanted_attempts(target: int) -> int:
    return max(20_000, 1000 * target)


def round_up(x: float, step: int) -> int:
    return math.ceil(x / step) * step
