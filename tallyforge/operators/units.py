"""A unit's answers (one run on one split in one decoding) brought down to a row for each problem, and to its metrics.

Answers have problem_id, sample_idx, tier, correct, truncated, extraction_failed, answer_line, n_tokens, prompt and completion, and
the columns ``by`` that tell units apart. All units are brought down in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.passk import pass_at_k

#: Right answers longer than this are counted apart.
LONG_TOKENS = 2048
#: A unit of a higher share of cut answers is flagged.
MOST_TRUNCATED = 0.05
RATES = ("truncation_rate", "extraction_failure_rate", "answer_line_rate")


def derive(samples: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """A row for each unit and problem: counts, score, rates, the first answer's tier, prompt and digest of its text."""
    total = lambda flag, name: F.count_if(flag).alias(name)
    at_cap = F.col("n_tokens") >= cap if cap is not None else F.lit(False)
    first = F.min_by(F.struct("tier", "prompt", F.sha2(F.col("completion").cast("binary"), 256).alias("sha")), "sample_idx")
    out = samples.groupBy(*by, "problem_id").agg(
        F.count("*").alias("n"), total("correct", "c"), total("truncated", "n_truncated"), total("extraction_failed", "n_failed"), total("answer_line", "n_answer_line"), total(at_cap, "n_at_cap"),
        total(F.col("truncated") & F.col("correct"), "n_truncated_correct"), total(F.col("correct") & (F.col("n_tokens") > LONG_TOKENS), "n_long_correct"), F.sum("n_tokens").alias("tokens"), first.alias("first"),
    )
    return out.select("*", (F.col("c") / F.col("n")).alias("score"), (F.col("n_truncated") / F.col("n")).alias("truncated_share"), "first.tier", "first.prompt", F.col("first.sha").alias("completion_sha")).drop("first")


def _share(count: str, of: Column | None = None) -> Column:
    """A share of all answers; 0 of none."""
    return F.coalesce(F.sum(count) / F.nullif(F.sum("n") if of is None else of, F.lit(0)), F.lit(0.0))


def unit_metrics(problems: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 8)) -> DataFrame:
    """A unit's metrics from ``derive``. samples_per_problem and pass@k are null unless all problems have equally many answers."""
    same = F.min("n") == F.max("n")
    out = problems.groupBy(*by).agg(
        F.count("*").alias("n_problems"), F.sum("n").alias("n_samples"), F.when(same, F.max("n")).alias("samples_per_problem"), F.avg("score").alias("accuracy"),
        _share("n_truncated").alias("truncation_rate"), _share("n_failed").alias("extraction_failure_rate"), _share("n_answer_line").alias("answer_line_rate"), _share("n_at_cap").alias("at_cap_rate"),
        _share("tokens").alias("mean_tokens"), (F.sum("n_long_correct") / F.nullif(F.sum("c"), F.lit(0))).alias("long_correct_share"), F.sum("n_truncated_correct").alias("truncated_correct"),
        *[F.when(same, F.avg(pass_at_k("n", "c", k))).alias(f"pass_at_{k}") for k in ks],
    )
    return out.withColumn("flagged", F.col("truncation_rate") > MOST_TRUNCATED)


def tier_metrics(problems: DataFrame, by: list[str]) -> DataFrame:
    """The same by tier, long: accuracy, truncation, failures and cap hits of each unit and tier."""
    return problems.groupBy(*by, "tier").agg(
        F.count("*").alias("n_problems"), F.avg("score").alias("accuracy"), _share("n_truncated").alias("truncation_rate"), _share("n_failed").alias("extraction_failure_rate"), _share("n_at_cap").alias("at_cap_rate"),
    )


def metric_scores(problems: DataFrame, by: list[str], ks: tuple[int, ...] = ()) -> DataFrame:
    """A row for each unit, problem and metric: ``score`` and, for each k, ``pass_at_k`` (null where a problem has fewer answers)."""
    values = [F.struct(F.lit("score").alias("metric"), F.col("score").alias("value"))]
    values += [F.struct(F.lit(f"pass_at_{k}").alias("metric"), pass_at_k("n", "c", k).alias("value")) for k in ks]
    return problems.select(*by, "problem_id", "tier", F.explode(F.array(*values)).alias("m")).select(*by, "problem_id", "tier", "m.metric", F.col("m.value").alias("score"))


def summary_table(metrics: DataFrame, by: list[str], decodings: list[str]) -> DataFrame:
    """A row for each model and split, a column for each decoding's accuracy; pass@8 from the decoding of several answers, else from
    the one of many."""
    wide = metrics.groupBy(*by).pivot("decoding", decodings).agg(F.first("accuracy").alias("accuracy"), F.first("pass_at_8").alias("pass_at_8"))
    eight = [F.col(f"{d}_pass_at_8") for d in decodings]
    return wide.select(*by, *[F.col(f"{d}_accuracy").alias(d) for d in decodings], F.coalesce(*eight).alias("pass_at_8"))


def prompt_digests(problems: DataFrame, by: list[str]) -> DataFrame:
    """A digest of each unit's problems and prompts in order of id. A unit is one split's problems, so they fit in a row."""
    one = F.concat(F.col("problem_id").cast("string"), F.lit("\0"), F.coalesce("prompt", F.lit("")), F.lit("\1"))
    parts = F.array_sort(F.collect_list(F.struct("problem_id", one.alias("x"))))
    return problems.groupBy(*by).agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["x"]), "").cast("binary"), 256).alias("prompt_digest"))
