"""Seed aggregation, paired contrasts, bootstrap intervals, ratios and bounds. Scores are long: arm, seed, problem_id, score."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import mixed

#: Resamples of a group that a task takes at a time, and numbers that it draws at a time.
TRIALS, DRAWS = 256, 1 << 21


def sample_std(x: str | Column) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    return F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x))


def seed_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm", "seed").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def summarize(scores: DataFrame) -> DataFrame:
    """Mean, spread and range over seeds of each arm's mean score."""
    return seed_means(scores).groupBy("arm").agg(F.count("*").alias("n_seeds"), F.avg("mean").alias("mean"), sample_std("mean").alias("std"), F.min("mean").alias("low"), F.max("mean").alias("high"))


def seed_averaged(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm", "problem_id").agg(F.avg("score").alias("score"))


def paired_contrast(scores: DataFrame, a: object, b: object, single_baseline: bool = False) -> DataFrame:
    """Seed i of arm ``a`` minus seed i of ``b`` (or minus the one baseline), over problems that both have."""
    left = scores.where(F.col("arm") == a).select("seed", "problem_id", F.col("score").alias("a"))
    right = scores.where(F.col("arm") == b).select("seed", "problem_id", F.col("score").alias("b"))
    joined = left.join(right.drop("seed"), "problem_id") if single_baseline else left.join(right, ["seed", "problem_id"])
    seeds = joined.groupBy("seed").agg(F.avg(F.col("a") - F.col("b")).alias("delta"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    out = seeds.agg(
        F.count("*").alias("n_seeds"), F.avg("delta").alias("delta"), sample_std("delta").alias("delta_std"),
        F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2).alias("pooled_std"), F.min("a").alias("a_low"), F.max("a").alias("a_high"), F.min("b").alias("b_low"), F.max("b").alias("b_high"),
    )
    return out.withColumn("ranges_overlap", F.greatest("a_low", "b_low") <= F.least("a_high", "b_high"))


def criterion(delta: Column, pooled: Column, other: Column) -> Column:
    """The difference is over twice the pooled spread, and has the same sign (not 0) on the other set; null without a spread."""
    same = (F.signum(delta) == F.signum(other)) & (delta != 0)
    return F.when(pooled.isNotNull(), (F.abs(delta) > 2 * pooled) & same)


def bootstrap(scores: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean and percentile interval of each group's scores by resampling problems.

    A resample draws by numbers hashed from (seed, resample, draw), so it is the same for any partitioning. Groups are gathered
    as arrays (a score for each problem of a unit), and go to tasks with TRIALS resamples each. For groups of any size, and for
    very many, see ``resample``."""
    order = F.array_sort(F.collect_list(F.struct("problem_id", "score")))
    arrays = scores.groupBy(*by).agg(order.alias("s")).withColumn("s", F.col("s.score"))
    trials = scores.sparkSession.range(resamples).groupBy(F.floor(F.col("id") / TRIALS).alias("block")).agg(F.min("id").alias("first_"), F.max("id").alias("last_")).drop("block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                s, first, last = np.asarray(row[-3], float), int(row[-2]), int(row[-1])
                places, step = np.arange(len(s), dtype=np.uint64), max(1, DRAWS // max(1, len(s)))
                for at in range(first, last + 1, step):
                    turns = mixed(np.arange(at, min(at + step, last + 1), dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    drawn = mixed(turns[:, None] ^ mixed(places + np.uint64(1))[None, :]) % np.uint64(len(s))
                    means = s[drawn].mean(1)
                    yield pd.DataFrame({c: [v] * len(means) for c, v in zip(by, row[: len(by)], strict=True)} | {"full": s.mean(), "m": means})

    types = "".join(f"`{c}` {scores.schema[c].dataType.simpleString()}, " for c in by)
    means = arrays.crossJoin(trials).mapInPandas(run, f"{types}full double, m double")
    return means.groupBy(*by).agg(F.first("full").alias("mean"), F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_sql(scores: DataFrame, resamples: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The same over one group, long, with SHA-256 draws that other engines can repeat."""
    from tallyforge.functions.hashrng import sha_int

    from .ordering import numbered

    placed = numbered(scores, ["problem_id"], "i")
    n = scores.count()
    draws = scores.sparkSession.range(resamples).withColumnRenamed("id", "trial").crossJoin(scores.sparkSession.range(n).withColumnRenamed("id", "draw"))
    draws = draws.withColumn("i", F.pmod(sha_int(seed, F.col("trial"), F.col("draw")), F.lit(n)).cast("int"))
    means = draws.join(placed, "i").groupBy("trial").agg(F.avg("score").alias("m"))
    return means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"), F.count("*").alias("resamples"))


def bootstrap_numpy(scores: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The interval that a plain numpy loop with default_rng(seed) over scores in order of problem_id gives."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("problem_id")["score"].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return part[by].head(1).assign(mean=values.mean(), low=low, high=high)

    schema = "".join(f"`{c}` {scores.schema[c].dataType.simpleString()}, " for c in by)
    return scores.groupBy(*by).applyInPandas(one, f"{schema}mean double, low double, high double")


def ratio(scores: DataFrame, top: tuple, bottom: tuple) -> DataFrame:
    """Ratio of two contrasts of arms, over all and by seed."""
    arms = {"ta": top[0], "tb": top[1], "ba": bottom[0], "bb": bottom[1]}
    means = seed_means(scores)
    wide = means.groupBy("seed").agg(*[F.max(F.when(F.col("arm") == v, F.col("mean"))).alias(k) for k, v in arms.items()])
    out = wide.select("seed", (F.col("ta") - F.col("tb")).alias("top"), (F.col("ba") - F.col("bb")).alias("bottom"))
    return out.agg(F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), (F.avg("top") / F.nullif(F.avg("bottom"), F.lit(0))).alias("ratio"), F.array_sort(F.collect_list(F.struct("seed", (F.col("top") / F.nullif("bottom", F.lit(0))).alias("ratio")))).alias("by_seed"))


def ratio_interval(numerator: Iterable[float], denominator: Iterable[float], resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> dict:
    """Joint bootstrap over problems of a ratio of mean differences (two short vectors, on the driver). Unbounded unless fewer than
    alpha/2 of the resamples put the denominator on one side of 0."""
    a, b = np.asarray(list(numerator), float), np.asarray(list(denominator), float)
    at = np.random.default_rng(seed).integers(0, len(a), (resamples, len(a)))
    x, y = a[at].mean(1), b[at].mean(1)
    below, above = float((y <= 0).mean()), float((y >= 0).mean())
    bounded = below < alpha / 2 or above < alpha / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        r = x / y
    r = r[np.isfinite(r)]
    low, high = np.quantile(r, [alpha / 2, 1 - alpha / 2]) if len(r) else (None, None)
    return {"ratio": float(a.mean() / b.mean()) if b.mean() else None, "low": low, "high": high, "bounded": bounded, "share_below": below}


def truncation_bounds(scores: DataFrame, a: object, b: object) -> DataFrame:
    """The contrast if none, all, or either arm's cut answers had been right: scenario, delta. ``scores`` has truncated (0..1)."""
    grid = scores.sparkSession.createDataFrame([("as_scored", 0, 0), ("a_up", 1, 0), ("b_up", 0, 1), ("both_up", 1, 1)], "scenario string, up_a int, up_b int")
    means = scores.groupBy("arm").agg(F.avg("score").alias("score"), F.avg("truncated").alias("truncated"))
    x = means.where(F.col("arm") == a).select(F.col("score").alias("sa"), F.col("truncated").alias("xa"))
    y = means.where(F.col("arm") == b).select(F.col("score").alias("sb"), F.col("truncated").alias("xb"))
    return F.broadcast(grid).crossJoin(x).crossJoin(y).select("scenario", (F.col("sa") + F.col("up_a") * F.col("xa") - F.col("sb") - F.col("up_b") * F.col("xb")).alias("delta"))


def rerun_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """How answers changed between two runs on the same (problem_id, sample_idx)."""
    a = before.select("problem_id", "sample_idx", F.col("correct").alias("c0"), F.col("truncated").alias("t0"), F.col("completion").alias("x0"))
    b = after.select("problem_id", "sample_idx", F.col("correct").alias("c1"), F.col("truncated").alias("t1"), F.col("completion").alias("x1"))
    j = a.join(b, ["problem_id", "sample_idx"])
    return j.agg(
        F.count("*").alias("n"), F.count_if(F.col("t0") & F.col("c1")).alias("cut_to_right"), F.count_if(F.col("t0") & F.col("t1")).alias("still_cut"), F.count_if(F.col("x0") == F.col("x1")).alias("same_text"),
        F.count_if(~F.col("c0") & F.col("c1")).alias("to_right"), F.count_if(F.col("c0") & ~F.col("c1")).alias("to_wrong"),
    )
