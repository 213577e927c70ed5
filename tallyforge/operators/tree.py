"""All results of a study built by one call: cells of runs and arms, whole and by tier, contrasts, every arm against the base, and the
tables and report sections made of them.

``scores``: arm, seed, problem_id, tier, metric, score. ``units``, a row for each evaluated unit: arm, seed, metric, and of UNIT_FIELDS what is
known. Results are as many as arms, seeds, metrics and tiers, however many problems are behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.passk import pass_at_k
from tallyforge.sources.files import stored

from . import results, stats
from .dynamics import trailing_mean
from .resample import intervals
from .results import MISSING, Spec, number
from .units import MOST_TRUNCATED

#: What a unit may carry, by type.
UNIT_FIELDS = {
    "label": "string", "kind": "string", "method": "string", "data_condition": "string", "split": "string", "decoding": "string", "unit": "string", "config_hash": "string", "git_dirty": "boolean", "samples_per_problem": "long",
    "truncation_rate": "double", "extraction_failure_rate": "double", "answer_line_rate": "double", "long_correct_share": "double", "mean_tokens": "double",
}
RATES = ("truncation_rate", "extraction_failure_rate", "answer_line_rate", "mean_tokens")
LEVELS = ("run", "run_tier", "arm", "arm_tier")


def whole_units(units: DataFrame) -> DataFrame:
    """``units`` with all of UNIT_FIELDS, null where they aren't known."""
    return units.select("arm", "seed", "metric", *[F.col(c) if c in units.columns else F.lit(None).cast(t).alias(c) for c, t in UNIT_FIELDS.items()])


def cells(scores: DataFrame, n_seeds: int | None = None, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """level (of LEVELS), arm, seed, metric, tier, value, n_problems, low, high, n_seeds, std, seed_min, seed_max, per_seed: one pass over scores.

    Scores are grouped by problem and run and, in the same pass, by problem over an arm's runs; both are cells of their own, whole and by
    tier, and all cells get their intervals together. An arm's value is the mean of its runs', its interval is over problems of the
    seed-averaged score. With ``n_seeds`` arms of another number of runs have no cell. A null tier belongs to no tier."""
    run, arm = [F.col(c) for c in ("arm", "metric", "tier", "problem_id", "seed")], [F.col(c) for c in ("arm", "metric", "tier", "problem_id")]
    per = scores.groupingSets([run, arm], *run).agg(F.avg("score").alias("score"), F.grouping("seed").alias("pooled"))
    by_tier = F.explode(F.array(F.lit(False), F.lit(True))).alias("by_tier")
    per = per.select("*", by_tier).where(~F.col("by_tier") | F.col("tier").isNotNull())
    level = F.concat(F.when(F.col("pooled") == 1, "arm").otherwise("run"), F.when(F.col("by_tier"), "_tier").otherwise(""))
    per = per.select(level.alias("level"), "arm", "seed", "metric", F.when(F.col("by_tier"), F.col("tier")).alias("tier"), "problem_id", "score")
    found = stored(intervals(per, ["level", "arm", "seed", "metric", "tier"], resamples=resamples, seed=seed).withColumnRenamed("mean", "value"))
    runs = found.where(F.col("level").startswith("run"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"])
    spread = runs.groupBy(F.replace("level", F.lit("run"), F.lit("arm")).alias("level"), "arm", "metric", "tier").agg(
        F.avg("value").alias("mean"), F.count("*").alias("n_seeds"), stats.sample_std("value").alias("std"), F.min("value").alias("seed_min"), F.max("value").alias("seed_max"), ordered.alias("per_seed")
    )
    if n_seeds is not None:
        spread = spread.where(F.col("n_seeds") == n_seeds)
    names = ["n_seeds", "std", "seed_min", "seed_max", "per_seed"]
    a, s = found.where(F.col("level").startswith("arm")).alias("a"), spread.alias("s")
    same = (F.col("a.level") == F.col("s.level")) & (F.col("a.arm") == F.col("s.arm")) & (F.col("a.metric") == F.col("s.metric")) & F.col("a.tier").eqNullSafe(F.col("s.tier"))
    arms = a.join(s, same).select("a.level", "a.arm", "a.seed", "a.metric", "a.tier", F.col("s.mean").alias("value"), "a.n_problems", "a.low", "a.high", *[f"s.{c}" for c in names])
    return runs.select(*arms.columns[:9], *[F.lit(None).cast(arms.schema[c].dataType).alias(c) for c in names]).unionByName(arms)


def base_specs(arms: Sequence[str], base: str = "base") -> list[Spec]:
    """Every arm against the base's one run."""
    return [Spec(f"{a}_vs_{base}", a, base, True) for a in sorted(arms) if a != base]


def dirty_units(units: DataFrame, specs: DataFrame) -> DataFrame:
    """key, metric, dirty_units: names of either arm's units that were made with uncommitted changes, in order."""
    sides = specs.select("key", F.explode(F.array("a", "b")).alias("arm"))
    dirty = units.where("git_dirty").join(F.broadcast(sides), "arm")
    return dirty.groupBy("key", "metric").agg(F.array_sort(F.collect_set("unit")).alias("dirty_units"))


def contrast_blocks(scores: DataFrame, units: DataFrame, specs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """``results.contrasts`` with the seeds whose runs are flagged on either side, and dirty_units."""
    rates = units.select("arm", "seed", "metric", *RATES)
    found = results.contrasts(scores, rates, specs, resamples, seed)
    flagged = units.where(F.col("truncation_rate") > MOST_TRUNCATED)
    for side in "ab":
        of = flagged.join(F.broadcast(specs.select("key", F.col(side).alias("arm"))), "arm").groupBy("key", "metric").agg(F.array_sort(F.collect_set("seed")).alias(f"flagged_seeds_{side}"))
        found = found.join(of, ["key", "metric"], "left")
    return found.join(dirty_units(units, specs), ["key", "metric"], "left").join(F.broadcast(specs), "key")


def build(scores: DataFrame, units: DataFrame, budgets: DataFrame, specs: Sequence[Spec], secondary: Sequence[Spec] = (), base: str = "base", test: str = "test_greedy", other: str = "ood_greedy", n_seeds: int | None = None, ratio: tuple[str, str, str] | None = None, resamples: int = 10_000, seed: int = 0) -> dict[str, DataFrame]:
    """Everything that tables and reports show: units, cells, contrasts, criteria, vs_base, budgets, and ratio (top, bottom and common arm) if one is
    asked for. ``budgets``: arm, seed and whatever a run used. Cells and contrasts are stored."""
    units, spark = whole_units(units), scores.sparkSession
    arms = [r["arm"] for r in units.select("arm").distinct().collect()]
    table = results.spec_table(spark, results.active(specs, secondary, arms))
    found = stored(contrast_blocks(scores, units, table, resamples, seed))
    out = {"units": units, "cells": stored(cells(scores, n_seeds, resamples, seed)), "contrasts": found, "criteria": results.criteria(found, test, other), "budgets": budgets}
    out["vs_base"] = contrast_blocks(scores.where(F.col("metric") == test), units, results.spec_table(spark, base_specs(arms, base)), resamples, seed)
    if ratio:
        out["ratio"] = results.ratios(scores, *ratio, resamples=resamples, seed=seed)
    return out


def _joined(values: str, sort: bool = False) -> Column:
    return F.array_join(F.transform(F.array_sort(values) if sort else F.col(values), lambda v: v.cast("string")), " ")


def tables(built: Mapping[str, DataFrame], test: str = "test_greedy", tier_rates: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six result tables: units, arms, per_tier, budgets, truncation, contrasts, for ``store.write_tables``. ``tier_rates``: arm, seed, tier,
    truncation_rate, extraction_failure_rate on ``test``. A unit without scores stays, its numbers null."""
    units, all_, ends = built["units"], built["cells"], [F.col("low").alias("ci_low"), F.col("high").alias("ci_high")]
    at = lambda level: all_.where(F.col("level") == level)
    flag = (F.col("truncation_rate") > MOST_TRUNCATED).alias("truncation_flag")
    runs = at("run").select("arm", "seed", "metric", "value", *ends, "n_problems")
    whole = units.join(runs, ["arm", "seed", "metric"], "left")
    out = {"units": whole.select("arm", "label", "kind", "method", "data_condition", "seed", "metric", "split", "decoding", "value", "ci_low", "ci_high", "n_problems", "samples_per_problem", "truncation_rate", "extraction_failure_rate", "answer_line_rate", "long_correct_share", "mean_tokens", flag, "config_hash", "git_dirty", "unit")}
    seeds = F.array_sort(F.collect_list(F.struct("seed", "truncation_rate")))
    means = units.groupBy("arm", "metric").agg(F.max("label").alias("label"), *[F.avg(c).alias(f"{c}_mean") for c in RATES], F.transform(seeds, lambda x: x["seed"]).alias("of"), F.transform(seeds, lambda x: x["truncation_rate"]).alias("cut"))
    flagged = F.filter(F.transform("of", lambda s, i: F.when(F.get("cut", i) > MOST_TRUNCATED, s)), lambda s: s.isNotNull())
    arms = at("arm").join(means.withColumn("flagged", flagged), ["arm", "metric"], "left")
    out["arms"] = arms.select("arm", "label", "metric", "n_seeds", _joined("of").alias("seeds"), _joined("per_seed").alias("per_seed"), F.col("value").alias("mean"), "std", *ends, "n_problems", "seed_min", "seed_max", *[f"{c}_mean" for c in RATES], _joined("cut").alias("truncation_per_seed"), _joined("flagged").alias("flagged_seeds"))
    tiers = at("run_tier").where(F.col("metric") == test).select("arm", "seed", "tier", "metric", "value", *ends, "n_problems")
    out["per_tier"] = tiers if tier_rates is None else tiers.join(tier_rates, ["arm", "seed", "tier"], "left")
    out["budgets"] = built["budgets"]
    out["truncation"] = whole.where("value is not null").select("arm", "seed", "metric", "split", "decoding", "n_problems", "truncation_rate", "extraction_failure_rate", flag)
    criteria = built["criteria"].select("key", F.lit(test).alias("metric"), "threshold", "magnitude_ok", "same_sign", "met")
    out["contrasts"] = built["contrasts"].join(criteria, ["key", "metric"], "left").select(
        "key", "a", "b", "metric", _joined("deltas").alias("delta_per_seed"), F.col("delta").alias("mean_delta"), F.col("delta_std").alias("std_delta"), F.col("pooled_std").alias("pooled_seed_std"), *ends, "n_problems", F.col("ranges_overlap").alias("seed_ranges_overlap"),
        *[f"{c}_gap" for c in RATES], _joined("flagged_seeds_a").alias("flagged_seeds_a"), _joined("flagged_seeds_b").alias("flagged_seeds_b"), F.array_join("dirty_units", " ").alias("dirty_units"), "threshold", "magnitude_ok", "same_sign", "met",
    )
    return out


def flat(built: Mapping[str, DataFrame]) -> DataFrame:
    """arm, seed, metric, split, decoding, field, value: a row for each number of each run's unit, for one flat CSV."""
    units = tables(built)["units"]
    names = [f.name for f in units.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != "seed"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")
    return units.select("arm", "seed", "metric", "split", "decoding", pairs).select("arm", "seed", "metric", "split", "decoding", "x.*").where("value is not null")


def _cell(c: Column) -> Column:
    """A run's value with its interval and share of cut answers, or an arm's mean with its spread."""
    ends = F.concat(F.lit(" ["), number(c["low"]), F.lit(", "), number(c["high"]), F.lit("]"))
    spread = F.when(c["n_seeds"] > 1, F.concat(F.lit(" ± "), number(c["std"]))).otherwise(F.lit(""))
    return F.concat(number(c["value"]), spread, ends)


def _table(rows: DataFrame, keys: Sequence[str], column: str, wanted: Sequence[str], shown: Column) -> str:
    """Rows by ``keys``, a column for each of ``wanted``, as Markdown; what isn't there is missing."""
    wide = rows.withColumn("shown", shown).groupBy(*keys).pivot(column, list(wanted)).agg(F.first("shown")).orderBy(*keys).collect()
    lines = [[*(MISSING if r[k] is None else str(r[k]) for k in keys), *(r[w] or MISSING for w in wanted)] for r in wide]
    return results._markdown("", [*keys, *wanted], lines).split("\n", 2)[2]


def sections(built: Mapping[str, DataFrame], metrics: Sequence[str], test: str = "test_greedy", tiers: Sequence[str] = ("easy", "medium", "hard")) -> dict[str, str]:
    """The six sections of the results report as Markdown by title: all arms, each arm's runs with its mean, models of one evaluation, tiers,
    cut answers, budgets."""
    units, all_ = built["units"], built["cells"]
    kinds = units.groupBy("arm").agg(F.max("kind").alias("kind"), F.count_distinct("seed").alias("runs"))
    found = all_.join(F.broadcast(kinds), "arm", "left").withColumn("c", F.struct("value", "std", "n_seeds", "low", "high"))  # a row for each arm
    run, arm = (found.where(F.col("level") == level) for level in ("run", "arm"))
    seeds = F.when(F.col("level").startswith("arm"), F.lit("mean")).otherwise(F.col("seed").cast("string"))
    both = run.unionByName(arm.where("runs > 1")).withColumn("run", seeds)
    by_tier = found.where(F.col("level").isin("run_tier", "arm_tier") & (F.col("metric") == test) & (F.col("level").startswith("run") | (F.col("runs") > 1))).withColumn("run", seeds)
    cut = units.groupBy("arm", "metric").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", "truncation_rate"))), lambda x: F.concat(number(100 * x["truncation_rate"], 1), F.lit(" %"))), ", ").alias("cut"))
    used = built["budgets"]
    rows = used.orderBy("arm", "seed").collect()  # a row for each run
    return {
        "All arms": _table(arm, ["arm"], "metric", metrics, _cell(F.col("c"))),
        "Each arm's runs": _table(both.where("kind in ('arm', 'control') or kind is null"), ["arm", "run"], "metric", metrics, _cell(F.col("c"))),
        "Base and reference models": _table(run.where("kind in ('base', 'reference')"), ["arm"], "metric", metrics, _cell(F.col("c"))),
        f"Tiers on {test}": _table(by_tier, ["arm", "run"], "tier", tiers, _cell(F.col("c"))),
        "Cut answers by run": _table(cut, ["arm"], "metric", metrics, F.col("cut")),
        "Budgets": results._markdown("", used.columns, [[MISSING if v is None else str(v) for v in r] for r in rows]).split("\n", 2)[2],
    }


# -- what figures are drawn of


def pass_curve(problems: DataFrame, ks: Sequence[int] = (1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """arm, k, mean, low, high: pass@k over problems (arm, seed, problem_id, n, c), averaged over an arm's seeds, and the least and greatest of them.
    A k that some unit has too few answers for is left out of that arm."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") >= k, pass_at_k("n", "c", k)).alias("p")) for k in ks])).alias("x")
    units = problems.select("arm", "seed", each).select("arm", "seed", "x.*").groupBy("arm", "seed", "k").agg(F.avg("p").alias("p"), F.count_if(F.col("p").isNull()).alias("short"))
    return units.groupBy("arm", "k").agg(F.avg("p").alias("mean"), F.min("p").alias("low"), F.max("p").alias("high"), F.sum("short").alias("short")).where("short = 0").drop("short")


def training_curves(log: DataFrame, values: Sequence[str], width: int = 25) -> DataFrame:
    """arm, step, field, mean, low, high: of each of ``values`` the trailing mean of a run's last ``width`` steps, averaged over the arm's runs, with the
    least and greatest run. ``log``: arm, seed, step, n (what a step's value is a mean over) and the values."""
    out = None
    for v in values:
        one = trailing_mean(log, "step", v, "n", width, ["arm", "seed"]).groupBy("arm", "step")
        one = one.agg(F.avg("trailing").alias("mean"), F.min("trailing").alias("low"), F.max("trailing").alias("high")).select("arm", "step", F.lit(v).alias("field"), "mean", "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def length_shares(answers: DataFrame, width: int = 256, bins: int = 17) -> DataFrame:
    """arm, bin, correct, n, share: how many of an arm's answers have a length in each bin of ``width`` tokens, right and wrong; the last bin holds all
    longer ones. Bins without an answer have no row."""
    at = F.least(F.floor(F.col("n_tokens") / width), F.lit(bins - 1)).cast("int")
    counts = answers.groupBy("arm", at.alias("bin"), "correct").agg(F.count("*").alias("n"))
    totals = answers.groupBy("arm").agg(F.count("*").alias("all"))
    return counts.join(totals, "arm").select("arm", "bin", "correct", "n", (F.col("n") / F.col("all")).alias("share"))


def figures(built: Mapping[str, DataFrame], problems: DataFrame, log: DataFrame, answers: DataFrame, test: str = "test_greedy", val: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables behind the eight figures, all computed here: accuracy by arm and run, tiers on ``test``, pass@k, reward over training (with ``val``: arm,
    step, value, as a field of its own), groups without spread, gains against the base by what was used, lengths over training, lengths of answers.
    ``log``: arm, seed, step, n, reward_mean, zero_std_share, length, cut_share."""
    all_ = built["cells"]
    shown = ["arm", "seed", "metric", "tier", "value", "std", "low", "high"]
    reward = training_curves(log, ["reward_mean"])
    if val is not None:
        reward = reward.unionByName(val.select("arm", "step", F.lit("val").alias("field"), F.col("value").alias("mean"), F.col("value").alias("low"), F.col("value").alias("high")))
    used = built["budgets"].groupBy("arm").agg(*[F.avg(f.name).alias(f.name) for f in built["budgets"].schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != "seed"])
    gains = built["vs_base"].select(F.col("a").alias("arm"), "delta", "low", "high")
    return {
        "accuracy": all_.where(F.col("level").isin("run", "arm")).select(*shown),
        "tiers": all_.where(F.col("level").isin("run_tier", "arm_tier") & (F.col("metric") == test)).select(*shown),
        "pass_at_k": pass_curve(problems),
        "reward": reward,
        "zero_std": training_curves(log, ["zero_std_share"]),
        "budget": gains.join(used, "arm", "left"),
        "training_length": training_curves(log, ["length", "cut_share"]),
        "answer_length": length_shares(answers),
    }


# -- the packet and the acceptance of training runs


def run_facts(runs: DataFrame, rewards: DataFrame, log: DataFrame, adapters: DataFrame, jobs: DataFrame, rate: float = 0.0, width: int = 25) -> DataFrame:
    """A row for each training run (``runs``: arm, seed, status, config_hash, gpu_hours): records and mean reward of its reward log (arm, seed, reward,
    truncated), its last trailing mean of the training log (arm, seed, step, n, reward_mean) and at which step, adapters saved (arm, seed, path),
    hours and cost of its evaluation (``jobs``: name, exit_code, wall_s; jobs named ``eval_<arm>_s<seed>`` that ended well, the longest), and cost at
    ``rate`` an hour. What a run lacks is null, counts are 0."""
    by = ["arm", "seed"]
    counted = rewards.groupBy(*by).agg(F.count("*").alias("records"), F.avg("reward").alias("reward_mean"), F.avg(F.col("truncated").cast("double")).alias("truncation_rate"))
    smooth = trailing_mean(log, "step", "reward_mean", "n", width, by).groupBy(*by).agg(F.max("step").alias("last_step"), F.max_by("trailing", "step").alias("last_reward"))
    saved = adapters.groupBy(*by).agg(F.count("*").alias("adapters"))
    done = jobs.where("exit_code = 0").groupBy("job").agg((F.max("wall_s") / 3600).alias("eval_hours"))
    out = runs.withColumn("job", F.concat(F.lit("eval_"), F.col("arm"), F.lit("_s"), F.col("seed").cast("string")))
    for part in (counted, smooth, saved):
        out = out.join(part, by, "left")
    out = out.join(done, "job", "left").drop("job").fillna(0, ["records", "adapters"])
    return out.withColumns({"train_cost": F.col("gpu_hours") * rate, "eval_cost": F.col("eval_hours") * rate})


def acceptance(checks: DataFrame, facts: DataFrame) -> str:
    """Whether training runs are accepted, their checks, and their figures with the total of hours and cost."""
    rows = facts.orderBy("arm", "seed").collect()  # a row for each run
    names = [c for c in facts.columns]
    shown = [[MISSING if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in names] for r in rows]
    sums = {c: sum(r[c] or 0.0 for r in rows) for c in ("gpu_hours", "eval_hours", "train_cost", "eval_cost")}
    total = ["total", *(f"{sums[c]:.3f}" if c in sums else "" for c in names[1:])]
    return results.acceptance_report(checks) + "\n" + results._markdown("Runs", names, [*shown, total])


def packet(built: Mapping[str, DataFrame], checks: DataFrame, facts: DataFrame, provenance: Mapping[str, str], metrics: Sequence[str], test: str = "test_greedy", sweep: DataFrame | None = None, steps: DataFrame | None = None, dynamics: DataFrame | None = None, notes: Sequence[str] = ()) -> str:
    """Everything a reader judges by, as numbered sections from 0 to 12: provenance, checks, manifest, base and reference models, main table, contrasts,
    tiers and step counts, budgets, sweep, training dynamics, doubts, the grading sheet, anomalies. If a check failed it says so at its head, and all
    sections behind the checks are marked. ``sweep``: arm, setting, cell; ``steps``: arm, total_steps, mean; ``dynamics``: arm, field and a column a step."""
    part = sections(built, metrics, test)
    failed = not checks.where("severity = 'FAIL'").isEmpty()
    listed = lambda df, order: results._markdown("", df.columns, [[MISSING if v is None else str(v) for v in r] for r in df.orderBy(*order).collect()]).split("\n", 2)[2]
    none = "none\n"
    doubt = results.doubts(built["contrasts"], test)
    bodies = [
        ("Provenance", results._markdown("", ["item", "value"], [[k, str(v)] for k, v in sorted(provenance.items())]).split("\n", 2)[2]),
        ("Checks", listed(checks.select("check", "severity", "message"), ["severity", "check", "message"])),
        ("Manifest", listed(facts, ["arm", "seed"])),
        ("Base and reference models", part["Base and reference models"]),
        ("Main table", part["All arms"]),
        ("Contrasts", results.contrasts_table(built["contrasts"]).split("\n", 2)[2]),
        ("Tiers and step counts", part[f"Tiers on {test}"] + ("\n" + listed(steps, ["arm", "total_steps"]) if steps is not None else "")),
        ("Budgets", part["Budgets"]),
        ("Sweep", listed(sweep, ["arm"]) if sweep is not None else none),
        ("Training dynamics", listed(dynamics, ["arm", "field"]) if dynamics is not None else none),
        ("How this could be wrong", listed(doubt, ["key", "doubt"])),
        ("Grading sheet", results.grading_sheet(built["contrasts"], test) + "\n"),
        ("Anomalies", "\n".join(f"- {n}" for n in notes) + "\n" if notes else none),
    ]
    marked = {f"{title}: DEPENDS ON A FAILED CHECK" if failed and k >= 2 else title: text for k, (title, text) in enumerate(bodies)}
    return ("CHECKS FAILED\n\n" if failed else "") + results.packet(marked)
