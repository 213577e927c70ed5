"""Draws, rounds, run records and result blocks: joins of answers with what is known of their problems and runs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .checks import _rows, _say
from .metrics import share


def resolve_split(name: str, splits: dict[str, DataFrame], pool: DataFrame, transfer: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """``pool``, a split, ``<split>_first<N>`` (by index), the part of the pool for ``ood`` if there is no such split, or a transfer set."""
    if name == "pool":
        return pool
    if m := re.fullmatch(r"(.+)_first(\d+)", name):
        return resolve_split(m[1], splits, pool, transfer).where(F.col("split_idx") < int(m[2]))
    if name in splits:
        return splits[name]
    if name == "ood":
        return pool.where(F.col("range_scale") == "L")
    if name in transfer:
        return transfer[name]
    raise ValueError(f"no split {name}")


def chosen_runs(chosen: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of the chosen setting of each arm, one for each seed."""
    return runs.join(F.broadcast(chosen.select("arm", "learning_rate", "epochs")), ["arm", "learning_rate", "epochs"])


def selection_record(sweep: DataFrame, meta: DataFrame, chosen: DataFrame) -> DataFrame:
    """By arm: settings tried, and GPU-hours of those that weren't chosen."""
    keys = ["arm", "learning_rate", "epochs"]
    marked = sweep.join(meta, keys, "left").join(chosen.select(*keys, F.lit(True).alias("won")), keys, "left")
    return marked.groupBy("arm").agg(F.count("*").alias("tried"), F.sum(F.when(F.col("won").isNull(), F.coalesce("gpu_hours_actual", F.lit(0.0))).otherwise(0.0)).alias("other_gpu_hours"))


def draw_integrity(draw: DataFrame, n: int) -> DataFrame:
    """Problems that don't have exactly ``n`` answers numbered 0..n-1."""
    g = draw.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_distinct("sample_idx").alias("k"), F.min("sample_idx").alias("low"), F.max("sample_idx").alias("high"))
    bad = g.where((F.col("n") != n) | (F.col("k") != n) | (F.col("low") != 0) | (F.col("high") != n - 1))
    return _rows(bad, "draw_integrity", _say(F.col("problem_id"), ": ", F.col("n"), " answers"))


def exactly_k(samples: DataFrame, split: DataFrame, k: int) -> DataFrame:
    """Answers of a split's problems; problems of it without exactly ``k`` are an error."""
    mine = samples.join(split.select("problem_id"), "problem_id", "left_semi")
    counts = split.select("problem_id").join(mine.groupBy("problem_id").agg(F.count("*").alias("n")), "problem_id", "left")
    if bad := counts.where(F.coalesce("n", F.lit(0)) != k).limit(5).collect():
        raise ValueError(f"not exactly {k} answers: {[r['problem_id'] for r in bad]}")
    return mine


def tiering_violations(samples: DataFrame, split: DataFrame, k: int) -> DataFrame:
    """Why a split's tiering answers may not be used, a row each: problems that don't have exactly the answers 0..k-1, answers whose stored verdict
    (correct) isn't that of their text, and problems whose right answers aren't as many as their pass8 says (null: not recorded). ``samples``:
    problem_id, sample_idx, completion, truncated, correct; ``split``: problem_id, answer, pass8."""
    from tallyforge.functions.extract import verdict

    known = split.select("problem_id", "answer", "pass8")
    mine = samples.join(known.select("problem_id", "answer"), "problem_id")
    at, words = F.col("sample_idx").cast("long"), range(0, k, 63)
    seen = [F.bit_or(F.when(at.between(w, min(k, w + 63) - 1), F.expr(f"shiftleft(1L, cast(sample_idx - {w} as int))"))).alias(f"seen{w}") for w in words]  # places 0..k-1 that are there, as bits
    counts = mine.groupBy("problem_id").agg(F.count("*").alias("n"), *seen, F.count_if("correct").alias("right"))
    whole = reduce(lambda x, y: x & y, [F.col(f"seen{w}") == (1 << (min(k, w + 63) - w)) - 1 for w in words], F.col("n") == k)
    again = verdict(F.col("completion"), F.col("answer"), F.col("truncated"))["reward"] == 1.0
    name, who = "tiering_samples", F.col("problem_id")
    both = F.array(
        F.when(~F.coalesce(whole, F.lit(False)), _say(who, ": ", F.coalesce("n", F.lit(0)), f" answers, not those of 0 to {k - 1}")),
        F.when(F.col("right") != F.col("pass8"), _say(who, ": ", F.col("right"), " right, pass8 is ", F.col("pass8"))),
    )
    each = known.join(counts, "problem_id", "left").select(F.explode(F.array_compact(both)).alias("message"))
    return _rows(each, name, F.col("message")).unionByName(_rows(mine.where(~again.eqNullSafe(F.col("correct"))), name, _say(who, ": answer ", F.col("sample_idx"), " isn't as stored")))


def tiering_samples(samples: DataFrame, split: DataFrame, k: int = 8) -> DataFrame:
    """A split's tiering answers; any of ``tiering_violations`` is an error."""
    if bad := tiering_violations(samples, split, k).limit(5).collect():
        raise ValueError(f"these answers don't fit the split: {[r['message'] for r in bad]}")
    return samples.join(split.select("problem_id"), "problem_id", "left_semi")


def with_cells(samples: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers with their pool cell, counts of answers without a problem and of those whose own cell disagrees)."""
    j = samples.join(pool.select("problem_id", F.col("cell").alias("pool_cell")), "problem_id", "left")
    counts = j.agg(F.count_if(F.col("pool_cell").isNull()).alias("missing"), F.count_if(F.col("cell") != F.col("pool_cell")).alias("disagree"))
    return j.where("pool_cell is not null").drop("cell").withColumnRenamed("pool_cell", "cell"), counts


def id_sets_differ(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    x, y = a.select(key, F.lit(1).alias("x")).distinct(), b.select(key, F.lit(1).alias("y")).distinct()
    return x.join(y, key, "full_outer").where("x is null or y is null").select(key, F.when(F.col("x").isNull(), "only_b").otherwise("only_a").alias("side"))


def locked_values(configs: DataFrame, locked: dict[str, object], unit: str) -> DataFrame:
    """A row for each run and field that isn't as locked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(v).cast("string").alias("locked")) for f, v in locked.items()])).alias("x")
    return configs.select(unit, pairs).select(unit, "x.*").where(~F.col("value").eqNullSafe(F.col("locked")))


def draw_summary(samples: DataFrame) -> DataFrame:
    """By tier and overall: answers, problems, pass rate and truncation over answers."""
    return samples.groupingSets([["tier"], []], "tier").agg(F.count("*").alias("n"), F.count_distinct("problem_id").alias("problems"), share("correct").alias("pass_rate"), share("truncated").alias("truncation_rate"))


def round_diagnostics(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """Pass rate (mean over problems), problems always and never right, share of right answers lost to deduplication, different
    texts, longest percentile."""
    p = samples.groupBy("problem_id").agg(F.avg(F.col("correct").cast("double")).alias("rate"))
    problems = p.agg(F.avg("rate").alias("pass_rate"), F.count_if(F.col("rate") == 1).alias("all_right"), F.count_if(F.col("rate") == 0).alias("none_right"))
    rows = samples.agg(F.count_if("correct").alias("right"), (F.count_distinct("problem_id", "completion") / F.count("*")).alias("unique_share"), F.percentile("n_tokens", F.lit(0.99)).alias("p99"))
    kept = selected.agg(F.count("*").alias("kept"))
    return problems.crossJoin(rows).crossJoin(kept).withColumn("dedup_rate", F.when(F.col("right") > 0, 1 - F.col("kept") / F.col("right")).otherwise(0.0))


def inside_each_other(a: Column, a_low: Column, a_high: Column, b: Column, b_low: Column, b_high: Column) -> Column:
    """Each point lies in the other's interval."""
    return a.between(b_low, b_high) & b.between(a_low, a_high)


def last_checkpoint(paths: DataFrame, by: str, column: str = "path") -> DataFrame:
    """The path of the highest numeric suffix of each run."""
    n = F.regexp_extract(column, r"-(\d+)/?$", 1).try_cast("bigint")
    return paths.withColumn("n", n).where("n is not null").groupBy(by).agg(F.max_by(column, "n").alias(column), F.max("n").alias("step"))


def bounds_identified(bounds: DataFrame, by: list[str]) -> DataFrame:
    """Whether a contrast's sign is the same at both ends of its bounds, and how wide they are."""
    g = bounds.groupBy(*by).agg(F.min("delta").alias("low"), F.max("delta").alias("high"))
    return g.select(*by, "low", "high", (F.col("high") - F.col("low")).alias("width"), (F.signum("low") == F.signum("high")).alias("identified"))


def reproducibility(pairs: DataFrame) -> DataFrame:
    """By same or different host: pairs of runs, share of identical answers, range of changed verdicts."""
    return pairs.groupBy("same_host").agg(F.count("*").alias("n"), (F.sum("identical") / F.sum("total")).alias("identical_share"), F.min("flips").alias("flips_low"), F.max("flips").alias("flips_high"))


def masked_summary(scores: DataFrame, mask: Column) -> DataFrame:
    return stats.summarize(scores.where(mask))


def unit_cells(scores: DataFrame, rates: DataFrame, by: list[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """A row for each unit: value, interval, rates and whether more than 5 % were cut."""
    out = stats.bootstrap(scores, by, resamples, seed).join(rates, by)
    return out.withColumn("flagged", F.col("truncation_rate") > 0.05)


def arm_cells(unit: DataFrame, n_seeds: int) -> DataFrame:
    """Mean, spread and range over an arm's seeds; null where a seed is missing."""
    whole = F.count("value") == n_seeds
    return unit.groupBy("arm").agg(F.when(whole, F.avg("value")).alias("mean"), F.when(whole, stats.sample_std("value")).alias("std"), F.count_if("flagged").alias("flagged_seeds"))


def exploratory_ok(config: DataFrame, locked_cap: int, multiple: int = 2) -> DataFrame:
    """Units that may not be read as exploratory: without the stamp, or with another cap than the multiple of the locked one."""
    bad = config.where(~F.coalesce(F.col("exploratory"), F.lit(False)) | (F.col("max_completion_tokens") != locked_cap * multiple))
    return _rows(bad, "exploratory_stamp", _say(F.col("run"), ": cap ", F.col("max_completion_tokens")))


def cap_run_valid(config: DataFrame, wanted: dict[str, object]) -> DataFrame:
    return locked_values(config, wanted, "run")


def enforce_cap(cap: int, locked: int, exploratory: bool = False) -> int:
    """The locked cap, or twice it for exploratory runs; anything else is an error."""
    if cap not in ({locked, 2 * locked} if exploratory else {locked}):
        raise ValueError(f"cap {cap} isn't the locked {locked}")
    return cap


def expected_units(models: DataFrame, splits: DataFrame, decodings: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of the plan that haven't finished."""
    return models.crossJoin(splits).crossJoin(decodings).join(done.select(*keys).distinct(), keys, "left_anti")


def first_rounds(draw: DataFrame, n: int) -> DataFrame:
    """The first ``n`` answers of each problem; a problem whose prompts differ is an error."""
    same = F.count_distinct("prompt")
    bad = draw.groupBy("problem_id").agg(same.alias("k")).where("k > 1")
    guard = draw.join(bad, "problem_id", "left")
    ok = F.when(F.col("k").isNull(), F.col("prompt")).otherwise(F.raise_error(F.concat(F.lit("prompts differ: "), F.col("problem_id").cast("string"))))
    return guard.withColumn("prompt", ok).where(F.col("sample_idx") < n).drop("k")


def last_value_wins(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of look-up tables; of a repeated key the value of the last table."""
    out = None
    for k, t in enumerate(tables):
        part = t.select(key, value, F.lit(k).alias("turn"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.max_by(value, "turn").alias(value))


def seed_table(units: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each seed, a column for each metric."""
    return units.groupBy("arm", "seed").pivot("metric", metrics).agg(F.first("value"))


def ordered_ids(rows: DataFrame, key: str = "problem_id") -> DataFrame:
    """Positions in order of id within each unit."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("unit").orderBy(key)) - 1)


def configured(plan: DataFrame, models: list[str] | None = None, n_problems: int | None = None) -> DataFrame:
    """A plan's rows of some models and of the first problems of each split (by split_idx)."""
    out = plan if models is None else plan.where(F.col("model").isin(*models))
    return out if n_problems is None else out.where(F.col("split_idx") < n_problems)


def keyed_samples(samples: DataFrame) -> DataFrame:
    """Tiering answers by condition, problem and number; a repeated key is an error."""
    keys = ["condition", "problem_id", "sample_idx"]
    if bad := samples.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise ValueError(f"repeated answers: {[tuple(r)[:3] for r in bad]}")
    return samples.select(*keys, *[c for c in samples.columns if c not in keys])


def prompt_hashes(prompts: DataFrame, stored: DataFrame, key: str = "problem_id") -> DataFrame:
    """Prompts whose digest isn't the stored one (key, sha256), or that have none."""
    j = prompts.select(key, F.sha2(F.col("prompt").cast("binary"), 256).alias("now")).join(stored.select(key, F.col("sha256").alias("was")), key, "left")
    return _rows(j.where("was is null"), "prompt_hash", _say(F.col(key), ": no stored hash")).unionByName(_rows(j.where("was <> now"), "prompt_hash", _say(F.col(key), ": another prompt")))
