"""Token caps: measured caps by cell, violations, histograms, and rescoring under a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, MARGIN = 256, 1.25


def measured_cap(p99: Column) -> Column:
    """1.25 times the 99th percentile, rounded up to a multiple of 256."""
    return (F.ceil(p99 * MARGIN / STEP) * STEP).cast("bigint")


def cells(correct: DataFrame, cell: str, anchor: int, cap: int, floor: int = 2048) -> DataFrame:
    """Lengths of right answers by cell (exact percentiles, linear between ranks)."""
    n = F.col("n_tokens")
    out = correct.groupBy(cell).agg(
        F.count("*").alias("n"), F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.99)).alias("p99"),
        F.avg((n > anchor).cast("double")).alias("over_anchor"), F.avg((n > cap).cast("double")).alias("over_cap"),
    )
    return out.withColumn("measured_cap", F.greatest(F.lit(floor).cast("bigint"), measured_cap(F.col("p99"))))


def driving_cell(found: DataFrame, cell: str) -> DataFrame:
    """The cell of the highest 99th percentile; ties go to the smaller name."""
    return found.orderBy(F.desc("p99"), cell).limit(1)


def violations(found: DataFrame, limit: float = 0.01) -> DataFrame:
    return found.where(F.col("over_cap") >= limit)


def length_histogram(samples: DataFrame, width: int, bins: int) -> DataFrame:
    """Right and wrong answers in bins of ``width`` tokens, zeros included; the last bin holds all that is longer."""
    b = F.least(F.floor(F.col("n_tokens") / width), F.lit(bins - 1))
    counts = samples.groupBy(b.alias("bin")).agg(F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct")).alias("n_incorrect"))
    return samples.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0, ["n_correct", "n_incorrect"])


def under_cap(samples: DataFrame, cap: int) -> DataFrame:
    """Answers as if cut at ``cap`` tokens: longer ones are cut and unscored. The length before is kept. An answer that was cut
    below the cap is an error: what it would have been isn't known."""
    over = F.col("n_tokens") > cap
    known = F.when(F.col("truncated") & (F.col("n_tokens") < cap), F.raise_error("an answer was cut below the cap")).otherwise(F.least(F.col("n_tokens"), F.lit(cap)))
    return samples.withColumns({"original_n_tokens": F.col("n_tokens"), "original_correct": F.col("correct"), "n_tokens": known, "truncated": F.col("truncated") | over, "correct": F.col("correct") & ~over})


def rescored(samples: DataFrame, answers: DataFrame, pools: list[DataFrame] = [], strict: bool = False) -> DataFrame:  # noqa: B006
    """Verdicts from the texts anew: the answer of the pool (of several, the last that has the problem), else the stored one. ``strict``: an
    answer whose problem no pool has, and that stores none, is an error; else it is wrong."""
    from tallyforge.functions.extract import verdict

    all_answers = answers.select("problem_id", F.col("answer").alias("pool_answer"), F.lit(0).alias("turn"))
    for k, pool in enumerate(pools, 1):
        all_answers = all_answers.unionByName(pool.select("problem_id", F.col("answer").alias("pool_answer"), F.lit(k).alias("turn")))
    last = all_answers.groupBy("problem_id").agg(F.max_by("pool_answer", "turn").alias("pool_answer"))
    joined = samples.join(last, "problem_id", "left").withColumn("answer", F.coalesce("pool_answer", "answer"))
    if strict:
        missing = F.raise_error(F.concat(F.lit("no answer is known of "), F.col("problem_id").cast("string"))).cast("bigint")
        joined = joined.withColumn("answer", F.coalesce("answer", missing))
    v = joined.withColumn("v", verdict(F.col("completion"), F.col("answer"), F.col("truncated")))
    return v.withColumns({"reward": F.col("v.reward"), "correct": F.col("v.reward") == 1.0, "extracted_answer": F.col("v.extracted"), "extraction_failed": F.col("v.extraction_failed")}).drop("v", "pool_answer")


def rescored_run(spark, folder: str, out: str, pools: list[DataFrame], cap: int | None = None, schema: str | None = None) -> DataFrame:
    """Rescores the answers of a run's folder (samples.jsonl, a file or a folder of parts) into ``out``, which must not exist: samples.jsonl, in order of
    problem and number, by the last of ``pools`` that has the problem, and cut at ``cap`` tokens if one is given. Returns the summary, one row,
    which is written beside it as rescore.json."""
    from tallyforge.sources import files, schemas

    samples = files.read_jsonl(spark, f"{folder}/samples.jsonl", schema or schemas.SAMPLES)
    if "answer" not in samples.columns:
        samples = samples.withColumn("answer", F.col("extra.answer"))
    samples = samples.withColumn("was_", F.col("correct"))
    scored = rescored(samples, pools[0], pools[1:], strict=True)
    scored = under_cap(scored, cap) if cap else scored.withColumns({"original_n_tokens": F.col("n_tokens"), "original_correct": F.col("correct")})
    scored = files.stored(scored.withColumn("original_correct", F.col("was_")).drop("was_", "answer"))
    files.write_jsonl_once(scored.drop("original_n_tokens", "original_correct"), f"{out}/samples.jsonl", ["problem_id", "extra.sample_idx"])
    summary = rescore_summary(scored)
    files.write_new(spark, f"{out}/rescore.json", summary.toJSON().first())
    return summary


def rescore_summary(capped: DataFrame) -> DataFrame:
    """Before and after of ``under_cap``."""
    return capped.agg(
        F.count("*").alias("n"), F.avg(F.col("original_correct").cast("double")).alias("accuracy_before"), F.avg(F.col("correct").cast("double")).alias("accuracy_after"),
        F.count_if(F.col("original_correct") != F.col("correct")).alias("changed"), (F.count_if(F.col("original_n_tokens") > F.col("n_tokens")) / F.greatest(F.lit(1), F.count("*"))).alias("cut_share"),
    )
