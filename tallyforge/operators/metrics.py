"""Metrics of graded answers: columns problem_id, tier, correct, truncated, extraction_failed, n_tokens, sample_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.passk import pass_at_k


def share(flag: str | Column) -> Column:
    """Mean of a flag; 0 for an empty group, as the rates of empty groups are."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def per_problem(samples: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, c, score, truncated rate of each problem; its tier is that of its first answer."""
    tier = [F.min_by("tier", "sample_idx").alias("tier")] if "tier" in samples.columns else []
    return samples.groupBy(*by, "problem_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("c"), F.avg(F.col("correct").cast("double")).alias("score"), F.avg(F.col("truncated").cast("double")).alias("truncated_rate"),
        F.sum("n_tokens").alias("tokens"), F.count_if("truncated").alias("n_truncated"), *tier,
    )


def metrics(samples: DataFrame, by: list[str] = [], ks: tuple[int, ...] = (1, 8)) -> DataFrame:  # noqa: B006
    """Accuracy is the mean over problems of their scores; truncation, token and failure rates are over answers. pass@k is null
    unless all problems have equally many answers."""
    problems = per_problem(samples, by)
    same = F.min("n") == F.max("n")
    out = problems.groupBy(*by).agg(
        F.count("*").alias("n_problems"), F.sum("n").alias("n_samples"), F.avg("score").alias("accuracy"), (F.sum("n_truncated") / F.sum("n")).alias("truncation_rate"), (F.sum("tokens") / F.sum("n")).alias("mean_tokens"),
        *[F.when(same, F.avg(pass_at_k("n", "c", k))).alias(f"pass_at_{k}") for k in ks],
    )
    return out.withColumn("over_5pct_truncated", F.col("truncation_rate") > 0.05)


def per_tier(samples: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Accuracy by tier, and overall (tier null), in one pass."""
    problems = per_problem(samples, by)
    return problems.groupingSets([[*by, "tier"], by], *by, "tier").agg(F.count("*").alias("n_problems"), F.avg("score").alias("accuracy"), (F.sum("n_truncated") / F.sum("n")).alias("truncation_rate"))


def pass_curve(samples: DataFrame, ks: DataFrame) -> DataFrame:
    """pass@k of a unit for each k of a (small) table."""
    return per_problem(samples).crossJoin(F.broadcast(ks)).groupBy("k").agg(F.avg(pass_at_k("n", "c", F.col("k"))).alias("pass_at_k"))


def unit_audit(samples: DataFrame, by: list[str]) -> DataFrame:
    """Checks of a unit's own rows: values that must be single, cut answers that count as right, right ones over 2,048 tokens."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.count_if(F.col("truncated") & F.col("correct")).alias("truncated_correct"),
        (F.count_if(F.col("correct") & (F.col("n_tokens") > 2048)) / F.nullif(F.count_if("correct"), F.lit(0))).alias("correct_over_2048"),
    )
