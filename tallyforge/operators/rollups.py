"""Summaries of rounds, draws, rules and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import extract

from .tiering import tier_of


def rounds_rollup(rounds: DataFrame, sums: Sequence[str], most: Sequence[str], by: Sequence[str] = ("seed",)) -> DataFrame:
    """A run's budgets over its rounds: sums of some, the largest of others."""
    return rounds.groupBy(*by).agg(F.count("*").alias("rounds"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(f"most_{c}") for c in most])


def kept_of_round(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """A round's answers that were kept, told by problem and text."""
    return samples.join(selected.select("problem_id", "completion").distinct(), ["problem_id", "completion"], "left_semi")


def with_steps(scores: DataFrame, problems: DataFrame) -> DataFrame:
    """Scores with their problem's total_steps; -1 where it isn't known."""
    return scores.join(problems.select("problem_id", "total_steps"), "problem_id", "left").withColumn("total_steps", F.coalesce("total_steps", F.lit(-1)))


def owned_draws(draw: DataFrame, split: DataFrame) -> DataFrame:
    """Answers of a draw that belong to a split's problems: how many, and of how many problems."""
    mine = draw.join(split.select("problem_id").distinct(), "problem_id", "left_semi")
    return mine.agg(F.count("*").alias("answers"), F.count_distinct("problem_id").alias("problems"))


def common_reasons(rows: DataFrame, n: int, column: str = "reason") -> DataFrame:
    """The ``n`` most common reasons; of equally common ones the first in the alphabet."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def reasons_rollup(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rejections by cell and reason, by cell, and overall."""
    return rows.where("reason is not null").rollup(*cell, "reason").agg(F.count("*").alias("n")).where(F.col(cell[0]).isNull() | F.col(cell[-1]).isNotNull())


def first_examples(rows: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def pass_histogram(samples: DataFrame, k: int = 8) -> DataFrame:
    """How many problems have so many right answers among their first ``k``, 0 to ``k``."""
    right = samples.where(F.col("sample_idx") < k).groupBy("problem_id").agg(F.count_if("correct").alias("right"))
    every = samples.sparkSession.range(k + 1).withColumnRenamed("id", "right")
    return every.join(right.groupBy("right").agg(F.count("*").alias("problems")), "right", "left").na.fill({"problems": 0})


def selection_counters(samples: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """By tier and overall (null): problems, answers available (``k`` each), consumed, right before and kept after selection."""
    sets = [["tier"], []]
    have = samples.groupingSets(sets, "tier").agg(F.count_distinct("problem_id").alias("prompts"), F.count("*").alias("consumed"), F.count_if("correct").alias("correct"))
    kept = selected.groupingSets(sets, "tier").agg(F.count("*").alias("kept"))
    return have.join(kept, have["tier"].eqNullSafe(kept["tier"]), "left").select(have["tier"], "prompts", (F.col("prompts") * k).alias("available"), "consumed", "correct", F.coalesce("kept", F.lit(0)).alias("kept"))


def pass8_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Problems by their number of right answers before and after, and how many lost or changed their tier."""
    a, b = (x.groupBy("problem_id").agg(F.count_if("correct").alias(n)) for x, n in ((before, "a"), (after, "b")))
    j = a.join(b, "problem_id", "full_outer")
    return j.agg(F.count("*").alias("problems"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("on_one_side"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(tier_of(F.col("a")) != tier_of(F.col("b"))).alias("changed_tier"))


def bucket_shares(texts: DataFrame, text: str = "completion", truncated: str = "truncated") -> DataFrame:
    """How many texts are in each failure bucket, and its share of all and of those that failed."""
    counts = texts.groupBy(extract.failure_bucket(F.col(text), F.col(truncated)).alias("bucket")).agg(F.count("*").alias("n"))
    parsed = F.col("bucket") == "parsed_by_current_rule"
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(~parsed, F.col("n"))).alias("failed"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", (F.col("n") / F.col("total")).alias("share"), F.when(~parsed, F.col("n") / F.col("failed")).alias("share_of_failures"))


def preview_rules(texts: DataFrame, rules: Sequence[str], pool: int, k: int = 8) -> DataFrame:
    """What tiering would be under other extraction rules: by rule the share extracted, the mean score, how many problems have 0..k right
    answers, each tier's count, and that brought up to a pool of ``pool`` problems. ``texts``: problem_id, sample_idx, completion, answer."""
    read = texts.where(F.col("sample_idx") < k).select("problem_id", "answer", *[extract.extract_by_rule(F.col("completion"), r).alias(f"got{i}") for i, r in enumerate(rules)])
    counts = [(F.count(f"got{i}").alias(f"extracted{i}"), F.count_if(F.col(f"got{i}") == F.col("answer")).alias(f"right{i}")) for i in range(len(rules))]
    each = [F.struct(F.lit(r).alias("rule"), F.col(f"extracted{i}").alias("extracted"), F.col(f"right{i}").alias("right")) for i, r in enumerate(rules)]
    by = read.groupBy("problem_id").agg(F.count("*").alias("n"), *[c for pair in counts for c in pair]).select("n", F.explode(F.array(*each)).alias("x")).select("n", "x.*")
    tiers = [F.count_if(tier_of(F.col("right")) == t).alias(t) for t in ("easy", "medium", "hard")]
    out = by.groupBy("rule").agg(F.count("*").alias("problems"), (F.sum("extracted") / F.sum("n")).alias("extraction_rate"), F.avg(F.col("right") / F.col("n")).alias("mean"), F.array(*[F.count_if(F.col("right") == i) for i in range(k + 1)]).alias("histogram"), *tiers)
    return out.select("*", *[F.round(F.col(t) * pool / F.col("problems")).cast("long").alias(f"{t}_of_pool") for t in ("easy", "medium", "hard")])


def compute_log(records: DataFrame, hours: str = "gpu_hours") -> DataFrame:
    """Metered hours and records by (group, column), by group, and overall."""
    metered = records.where(F.col(hours).isNotNull())
    return metered.rollup("group", "column").agg(F.sum(hours).alias("hours"), F.count("*").alias("n"))


def unmetered(records: DataFrame, hours: str = "gpu_hours") -> DataFrame:
    """Records without hours, listed."""
    return records.where(F.col(hours).isNull()).select("group", "column", "path")


def weighted_window(log: DataFrame, step: str, value: str, weight: str, width: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The windowed mean of ``dynamics.step_window``, each step weighted: over s-width+1..s, and at step 0 over 1..width."""
    w = Window.partitionBy(*by).orderBy(step)
    known = F.when(F.col(value).isNotNull(), F.col(weight))

    def mean(over, where: Column):
        return F.sum(F.when(where, F.col(value) * known)).over(over) / F.nullif(F.sum(F.when(where, known)).over(over), F.lit(0.0))

    usual, first = mean(w.rangeBetween(-(width - 1), 0), F.lit(True)), mean(w.rangeBetween(0, width), F.col(step) > 0)
    return log.withColumn("windowed", F.when(F.col(step) == 0, first).otherwise(usual))


def grid_over_seeds(windowed: DataFrame, step: str, steps: Sequence[int], first_seed: int = 1) -> DataFrame:
    """At chosen steps, the value of one seed and the mean over seeds, by arm."""
    at = windowed.where(F.col(step).isin(*steps))
    return at.groupBy("arm", step).agg(F.max(F.when(F.col("seed") == first_seed, F.col("windowed"))).alias("first_seed"), F.avg("windowed").alias("mean"))


def invariants(traced: DataFrame, least: int = 3) -> DataFrame:
    """Problems whose steps break a promise of the generator: an empty step, a step that changes nothing, too few values at the last."""
    sizes = F.transform("trace", F.size)
    same = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("trace") - 1)), lambda i: F.array_sort(F.get("trace", i)) == F.array_sort(F.get("trace", i - 1)))
    found = F.array_compact(F.array(
        F.when(F.exists(sizes, lambda n: n == 0), "empty step"), F.when((F.size("trace") > 1) & same, "step without effect"), F.when(F.element_at(sizes, -1) < least, "too few values at the last step"),
    ))
    return traced.where("trace is not null").select("problem_id", F.explode(found).alias("broken"))


def longest_prompt(prompts: DataFrame, most: int, column: str = "prompt") -> DataFrame:
    """Prompts of more than ``most`` characters: a limit in tokens can't be reached by fewer characters."""
    return prompts.where(F.length(column) > most).select("problem_id", F.length(column).alias("characters"))
