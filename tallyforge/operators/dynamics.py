"""Training-log windows, group advantages and pass histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

EPS = 1e-6


def advantages(rewards: DataFrame, group: str, reward: str = "reward", scale: bool = True) -> DataFrame:
    """(r - mean) / (sample std + eps) within a group; a constant group has 0 throughout."""
    w = Window.partitionBy(group)
    std = F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0))
    centred = F.col(reward) - F.avg(reward).over(w)
    divisor = F.when(std < EPS, F.lit(1.0)).otherwise(std) + EPS
    value = centred / divisor if scale else centred
    return rewards.withColumn("advantage", F.when(F.max(reward).over(w) == F.min(reward).over(w), 0.0).otherwise(value))


def zero_std_groups(samples: DataFrame, by: str, order: list[str], size: int, reward: str = "reward") -> DataFrame:
    """By ``by``: rewards' mean and number, and the share of groups of ``size`` in order whose rewards are equal; a last partial
    group doesn't count."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    chunks = samples.withColumn("chunk", F.floor(rn / size)).groupBy(by, "chunk").agg(F.count("*").alias("n"), F.sum(reward).alias("total"), (F.max(reward) - F.min(reward) < 1e-12).alias("flat"))
    full = F.col("n") == size
    return chunks.groupBy(by).agg((F.sum("total") / F.sum("n")).alias("reward_mean"), F.sum("n").alias("n"), F.coalesce(F.avg(F.when(full, F.col("flat").cast("double"))), F.lit(0.0)).alias("zero_std_share"))


def trailing_mean(log: DataFrame, step: str, value: str, weight: str | None = None, width: int = 25, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted mean of the last ``width`` rows in order of step; nulls count for nothing, and all of them for null."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(-(width - 1), 0)
    weight_of = F.when(F.col(value).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    return log.withColumn("trailing", F.sum(F.col(value) * weight_of).over(w) / F.nullif(F.sum(weight_of).over(w), F.lit(0.0)))


def step_window(log: DataFrame, step: str, value: str, width: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean over the steps s-width+1..s; at step 0 over steps 1..width."""
    w = Window.partitionBy(*by).orderBy(step)
    usual, first = F.avg(value).over(w.rangeBetween(-(width - 1), 0)), F.avg(F.when(F.col(step) > 0, F.col(value))).over(w.rangeBetween(0, width))
    return log.withColumn("windowed", F.when(F.col(step) == 0, first).otherwise(usual))


def lowest_window(log: DataFrame, step: str, value: str, width: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    return step_window(log, step, value, width, by).where(F.col(step) >= width).groupBy(*by).agg(F.min("windowed").alias("lowest"))


def grid(log: DataFrame, step: str, value: str, steps: list[int], width: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The windowed mean at chosen steps, a column for each."""
    at = step_window(log, step, value, width, by).where(F.col(step).isin(steps))
    return at.groupBy(*by).agg(*[F.max(F.when(F.col(step) == s, F.col("windowed"))).alias(f"step_{s}") for s in steps])


def active_prompts(outcomes: DataFrame, order: list[str], length: int = 32) -> DataFrame:
    """Problems whose last ``length`` outcomes are mixed."""
    last = outcomes.withColumn("back", F.row_number().over(Window.partitionBy("problem_id").orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= length)
    counts = last.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("s"))
    return counts.where((F.col("s") > 0) & (F.col("s") < F.col("n")))


def cumulative(log: DataFrame, step: str, values: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Running totals with each step counted once (its first row by the values)."""
    once = log.groupBy(*by, step).agg(*[F.max(v).alias(v) for v in values])
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return once.withColumns({f"cumulative_{v}": F.sum(v).over(w) for v in values})


def restarts(log: DataFrame, step: str, clock: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Repeated steps, and rows whose clock is behind the row before (in order of arrival ``row``)."""
    w = Window.partitionBy(*by).orderBy("row")
    marked = log.withColumn("back", F.col(clock) < F.lag(clock).over(w))
    return marked.groupBy(*by).agg((F.count("*") - F.count_distinct(step)).alias("repeated_steps"), F.count_if("back").alias("clock_back"))


def resume_trim(log: DataFrame, step: str, last: int) -> DataFrame:
    """What a restart from step ``last`` keeps: no summary rows, no later steps."""
    return log.where((F.col(step) <= last) & ~F.coalesce(F.col("summary"), F.lit(False)))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """A seeded permutation in batches: place and batch of each row."""
    from tallyforge.functions.hashrng import sha_int

    drawn = numbered(rows.withColumn("drawn_", sha_int(seed, epoch, F.col(key))), ["drawn_", key], "place").drop("drawn_")
    return drawn.withColumn("batch", F.floor(F.col("place") / batch))


def curve_rises(curve: DataFrame, step: str, value: str) -> DataFrame:
    """Whether the last quarter's mean is above the first's; null under four points."""
    known = curve.where(F.col(value).isNotNull()).select(F.col(step).alias("at"), F.col(value).alias("v"))
    ranked = numbered(known, ["at", "v"], "r").withColumn("r", F.col("r") + 1).crossJoin(F.broadcast(known.agg(F.count("*").alias("n"))))
    q = F.floor(F.col("n") / 4)
    out = ranked.agg(F.max("n").alias("n"), F.avg(F.when(F.col("r") <= q, F.col("v"))).alias("first"), F.avg(F.when(F.col("r") > F.col("n") - q, F.col("v"))).alias("last"))
    return out.select(F.when(F.col("n") >= 4, F.col("last") > F.col("first")).alias("rises"))


def non_finite(log: DataFrame, columns: list[str]) -> DataFrame:
    return log.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in columns])


def policy_loss(tokens: DataFrame, clip: float = 0.2, beta: float = 0.0) -> DataFrame:
    """Clipped policy loss over a batch in long form (sequence, new, old, ref log-probabilities, advantage, mask)."""
    r = F.exp(F.col("new") - F.col("old"))
    gain = F.least(r * F.col("advantage"), F.greatest(F.least(r, F.lit(1 + clip)), F.lit(1 - clip)) * F.col("advantage"))
    kl = F.exp(F.col("ref") - F.col("new")) - (F.col("ref") - F.col("new")) - 1
    n = F.greatest(F.sum("mask"), F.lit(1.0))
    mean = lambda x: F.sum(x * F.col("mask")) / n
    return tokens.agg((-mean(gain - beta * kl)).alias("loss"), mean(r).alias("mean_ratio"), mean((F.abs(r - 1) > clip).cast("double")).alias("clip_fraction"), mean(kl).alias("mean_kl"), n.alias("n_tokens"))


def supervised_loss(tokens: DataFrame) -> DataFrame:
    """Mean negative log-probability of the masked tokens; none is an error."""
    total = F.sum("mask")
    return tokens.agg(F.when(total > 0, -F.sum(F.col("logp") * F.col("mask")) / total).otherwise(F.raise_error("no token is masked in").cast("double")).alias("loss"))
