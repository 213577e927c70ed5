"""The tree of results as long tables: cells of runs, arms and tiers, contrasts with intervals, ratios, budgets, and their reports.

``scores`` has arm, seed, problem_id, metric, score (and tier); ``rates`` has arm, seed, metric and the rates of that unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .resample import intervals, ratio_interval
from .units import MOST_TRUNCATED

MISSING = "missing"
#: Result metrics by name, with their split, decoding and k of pass@k.
METRICS = {
    "val_greedy": ("val_mixed_100", "greedy", None),
    "test_greedy": ("test_300", "greedy", None),
    "ood_greedy": ("ood_hard_200", "greedy", None),
    "test_mean8": ("test_300", "mean_at_k", None),
    "ood_mean8": ("ood_hard_200", "mean_at_k", None),
    "test_pass8": ("test_300", "pass_at_k", 8),
    "test_pass64": ("test_300", "pass_at_k", 64),
    "gsm8k_greedy": ("gsm8k_500", "greedy", None),
    "gsm8k_mean8": ("gsm8k_500", "mean_at_k", None),
}


@dataclass(frozen=True)
class Spec:
    """A contrast of arm ``a`` minus arm ``b``; ``single``: ``b`` has one run, which every seed of ``a`` is paired with."""

    key: str
    a: str
    b: str
    single: bool = False


#: The contrasts, and those that count only where their arms are there.
CONTRASTS = (
    Spec("H1_rft", "rft_mixed", "rft_easy"),
    Spec("H1_grpo", "grpo_mixed", "grpo_easy"),
    Spec("H2_num", "rft_curated", "rft_mixed"),
    Spec("H2_den", "grpo_curated", "rft_mixed"),
    Spec("H3", "grpo_curated", "rft_curated"),
    Spec("C1", "c1_random_reward", "base", True),
    Spec("C2", "c2_format_only", "base", True),
    Spec("aux_grpo_curation", "grpo_curated", "grpo_mixed"),
)
SECONDARY = (Spec("S1_iter_vs_rft", "iter_rft_curated", "rft_curated"), Spec("S2_grpo_vs_iter", "grpo_curated", "iter_rft_curated"))


def named_scores(problems: DataFrame, metrics: Mapping[str, tuple[str, str, int | None]] = METRICS) -> DataFrame:
    """arm, seed, problem_id, tier, metric, score of the named metrics, from derived units with split and decoding."""
    from tallyforge.functions.passk import pass_at_k

    names = [
        F.when((F.col("split") == split) & (F.col("decoding") == decoding), F.struct(F.lit(name).alias("metric"), (F.col("score") if k is None else pass_at_k("n", "c", k)).alias("score")))
        for name, (split, decoding, k) in metrics.items()
    ]
    return problems.select("arm", "seed", "problem_id", "tier", F.explode(F.array_compact(F.array(*names))).alias("m")).select("arm", "seed", "problem_id", "tier", "m.*").where("score is not null")


def active(specs: Sequence[Spec], secondary: Sequence[Spec], arms: Sequence[str]) -> list[Spec]:
    """All of ``specs``, and of the secondary ones those whose arms are there."""
    return [*specs, *(s for s in secondary if {s.a, s.b} <= set(arms))]


def spec_table(spark, specs: Sequence[Spec]) -> DataFrame:
    return spark.createDataFrame([(s.key, s.a, s.b, s.single) for s in specs], "key string, a string, b string, single boolean")


def run_cells(scores: DataFrame, rates: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each run and metric: value and interval, and the rates it must be read with."""
    by = ["arm", "seed", "metric"]
    return intervals(scores, by, resamples=resamples, seed=seed).withColumnRenamed("mean", "value").join(rates, by, "left").withColumn("flagged", F.col("truncation_rate") > MOST_TRUNCATED)


def arm_cells(scores: DataFrame, rates: DataFrame, n_seeds: int, by: Sequence[str] = (), resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each arm and metric (and ``by``, such as tier): every seed's value, mean and spread, the interval over problems of the
    seed-averaged score, mean rates and flagged seeds. Arms that lack a seed have none."""
    keys = ["arm", "metric", *by]
    runs = scores.groupBy(*keys, "seed").agg(F.avg("score").alias("value"))
    if rates is not None:
        runs = runs.join(rates, ["arm", "metric", "seed"], "left")
        extra = [F.avg(c).alias(f"{c}_mean") for c in rates.columns if c not in ("arm", "metric", "seed")]
        extra.append(F.array_sort(F.collect_list(F.when(F.col("truncation_rate") > MOST_TRUNCATED, F.col("seed")))).alias("flagged_seeds"))
    else:
        extra = []
    values = F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"])
    cells = runs.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.avg("value").alias("mean"), stats.sample_std("value").alias("std"), F.min("value").alias("seed_min"), F.max("value").alias("seed_max"), values.alias("per_seed"), *extra)
    averaged = scores.groupBy(*keys, "problem_id").agg(F.avg("score").alias("score"))
    return cells.where(F.col("n_seeds") == n_seeds).join(intervals(averaged, keys, resamples=resamples, seed=seed).drop("mean"), keys)


def _paired(scores: DataFrame, specs: DataFrame) -> DataFrame:
    """key, metric, seed, problem_id, a, b: the two sides of every contrast; a single baseline goes with each seed."""
    known = F.broadcast(specs)  # a row for each contrast
    left = scores.join(known, scores["arm"] == known["a"]).select("key", "single", "metric", "seed", "problem_id", F.col("score").alias("a"))
    right = scores.join(known, scores["arm"] == known["b"]).select("key", "single", "metric", F.when(~F.col("single"), F.col("seed")).alias("seed"), "problem_id", F.col("score").alias("b"))
    on = (left["key"] == right["key"]) & (left["metric"] == right["metric"]) & (left["problem_id"] == right["problem_id"])
    same = F.when(left["single"], F.lit(None)).otherwise(left["seed"]).eqNullSafe(right["seed"])
    return left.join(right, on & same).select(left["key"], left["metric"], left["seed"], left["problem_id"], "a", "b")


def contrasts(scores: DataFrame, rates: DataFrame, specs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each contrast and metric: seed-wise differences (mean, spread, each), pooled spread, whether the seeds' ranges overlap,
    the paired interval over problems of the seed-averaged difference, and the gaps in rates."""
    by = ["key", "metric"]
    pairs = _paired(scores, specs)
    seeds = pairs.groupBy(*by, "seed").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg(F.col("a") - F.col("b")).alias("delta"))
    pooled = F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2)
    out = seeds.join(F.broadcast(specs.select("key", "single")), "key").groupBy(*by, "single").agg(
        F.count("*").alias("n_seeds"), F.avg("delta").alias("delta"), stats.sample_std("delta").alias("delta_std"), F.when(~F.col("single") & (F.count("*") > 1), pooled).alias("pooled_std"),
        (F.greatest(F.min("a"), F.min("b")) <= F.least(F.max("a"), F.max("b"))).alias("ranges_overlap"), F.transform(F.array_sort(F.collect_list(F.struct("seed", "delta"))), lambda x: x["delta"]).alias("deltas"),
    )
    spread = intervals(pairs.groupBy(*by, "problem_id").agg(F.avg(F.col("a") - F.col("b")).alias("score")), by, resamples=resamples, seed=seed)
    return out.drop("single").join(spread.drop("mean"), by).join(rate_gaps(rates, specs), by, "left")


def rate_gaps(rates: DataFrame, specs: DataFrame) -> DataFrame:
    """Mean rates of a contrast's first arm minus those of its second, and how many runs of each are flagged."""
    names = [c for c in rates.columns if c not in ("arm", "seed", "metric")]
    sides = [
        rates.join(F.broadcast(specs.select("key", F.col(side).alias("arm"))), "arm").groupBy("key", "metric").agg(*[F.avg(c).alias(f"{c}_{side}") for c in names], F.count_if(F.col("truncation_rate") > MOST_TRUNCATED).alias(f"flagged_{side}"))
        for side in "ab"
    ]
    both = sides[0].join(sides[1], ["key", "metric"])
    return both.select("key", "metric", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_gap") for c in names], "flagged_a", "flagged_b")


def criteria(found: DataFrame, test: str, other: str) -> DataFrame:
    """Whether each contrast holds: on ``test`` over twice the pooled spread, and of the same sign on ``other``."""
    y = found.where(F.col("metric") == other).select("key", F.col("delta").alias("other"))
    x = found.where(F.col("metric") == test).join(y, "key")
    same = (F.signum("delta") == F.signum("other")) & (F.col("delta") != 0)
    return x.select("key", (2 * F.col("pooled_std")).alias("threshold"), F.when(F.col("pooled_std").isNotNull(), F.abs("delta") > 2 * F.col("pooled_std")).alias("magnitude_ok"), same.alias("same_sign"), stats.criterion(F.col("delta"), F.col("pooled_std"), F.col("other")).alias("met"))


def ratios(scores: DataFrame, top: str, bottom: str, common: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """By metric: (top - common) / (bottom - common), by seed and over all, with the joint interval over problems."""
    arm = lambda name: F.avg(F.when(F.col("arm") == name, F.col("score")))
    sides = [(arm(top) - arm(common)).alias("top"), (arm(bottom) - arm(common)).alias("bottom")]
    rows = scores.where(F.col("arm").isin(top, bottom, common))
    each = rows.groupBy("metric", "seed").agg(*sides).groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", (F.col("top") / F.nullif("bottom", F.lit(0))).alias("r")))), lambda x: x["r"]).alias("per_seed"))
    return ratio_interval(rows.groupBy("metric", "problem_id").agg(*sides), ["metric"], resamples, seed).join(each, "metric")


def bound_contrasts(scores: DataFrame, specs: DataFrame) -> DataFrame:
    """Every contrast and metric in four scenarios: cut answers as scored, or all right in the first arm, the second, both. ``scores`` has
    truncated (share of each problem's answers); a cut answer that counts as right is an error."""
    upper = F.when(F.col("score") + F.col("truncated") > 1 + 1e-9, F.raise_error(F.concat(F.lit("a cut answer counts as right: "), F.col("problem_id").cast("string"))).cast("double")).otherwise(F.col("score") + F.col("truncated"))
    low = _paired(scores, specs).groupBy("key", "metric", "seed").agg(F.avg("a").alias("a0"), F.avg("b").alias("b0"))
    high = _paired(scores.withColumn("score", upper), specs).groupBy("key", "metric", "seed").agg(F.avg("a").alias("a1"), F.avg("b").alias("b1"))
    scenarios = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col(a) - F.col(b)).alias("delta")) for n, a, b in (("as_scored", "a0", "b0"), ("a_up", "a1", "b0"), ("b_up", "a0", "b1"), ("both_up", "a1", "b1"))]))
    long = low.join(high, ["key", "metric", "seed"]).select("key", "metric", scenarios.alias("x")).select("key", "metric", "x.*")
    return long.groupBy("key", "metric", "scenario").agg(F.avg("delta").alias("delta"))


def exploratory(scores: DataFrame, rates: DataFrame, specs: DataFrame, test: str, other: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Contrasts with their criterion and the ends of their bounds on ``test``."""
    bounds = bound_contrasts(scores, specs).where(F.col("metric") == test).groupBy("key").agg(F.min("delta").alias("bound_low"), F.max("delta").alias("bound_high"))
    found = contrasts(scores.drop("truncated"), rates, specs, resamples, seed)
    return found.where(F.col("metric") == test).join(criteria(found, test, other), "key").join(bounds, "key", "left")


def budget_section(budgets: DataFrame, gains: DataFrame) -> DataFrame:
    """By arm: totals of its runs, and the gain for each 100 prompts and each 1,000 completions (null without any). ``gains``: arm, gain."""
    sums = budgets.groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("completions", "tokens", "gpu_hours")], F.avg("prompts").alias("prompts"), F.count("*").alias("runs"))
    per = lambda unit, of: F.col("gain") * unit / F.nullif(of, F.lit(0))
    return sums.join(gains, "arm", "left").select("*", per(100, F.col("prompts")).alias("gain_per_100_prompts"), per(1000, F.col("completions") / F.col("runs")).alias("gain_per_1000_completions"))


def long_results(cells: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """One table of all results: section, key, field, value (numbers as doubles). Arrays, such as each seed's value, are left out."""
    out = None
    for section, df in cells.items():
        own = list(keys[section])
        fields = [f.name for f in df.schema.fields if f.name not in own and f.dataType.typeName() in ("double", "long", "integer", "boolean", "bigint", "int")]
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")
        part = df.select(F.lit(section).alias("section"), F.concat_ws("/", *own).alias("key"), pairs).select("section", "key", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


# -- reports


def number(x: Column, digits: int = 3, signed: bool = False) -> Column:
    """A number as text; ``missing`` for none."""
    text = F.format_number(x, digits)
    text = F.replace(text, F.lit(","), F.lit(""))
    return F.coalesce(F.when(x > 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text, F.lit(MISSING))


def _markdown(title: str, head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"## {title}", "", line(head), line(["---"] * len(head)), *map(line, rows), ""])


def cell_rows(cells: DataFrame) -> DataFrame:
    """Arm, metric and a text for its cell: mean, spread over seeds, interval, and a mark where a seed is flagged."""
    mark = F.when(F.size("flagged_seeds") > 0, F.lit(" (cut answers over 5 %)")).otherwise("")
    shown = F.concat(number(F.col("mean")), F.lit(" ± "), number(F.col("std")), F.lit(" ["), number(F.col("low")), F.lit(", "), number(F.col("high")), F.lit("]"), mark)
    return cells.select("arm", "metric", shown.alias("cell"))


def results_table(cells: DataFrame, metrics: Sequence[str]) -> str:
    """Arms by metrics as a Markdown table; a cell that isn't there is ``missing``. Arms and metrics are few."""
    wide = cell_rows(cells).groupBy("arm").pivot("metric", list(metrics)).agg(F.first("cell")).orderBy("arm").collect()
    return _markdown("Results", ["arm", *metrics], [[str(r["arm"]), *(r[m] or MISSING for m in metrics)] for r in wide])


def contrast_rows(found: DataFrame) -> DataFrame:
    shown = F.concat(number(F.col("delta"), signed=True), F.lit(" ["), number(F.col("low"), signed=True), F.lit(", "), number(F.col("high"), signed=True), F.lit("]"))
    return found.select("key", "metric", shown.alias("delta"), number(F.col("pooled_std")).alias("pooled"), F.when(F.col("ranges_overlap"), "overlap").otherwise("apart").alias("seeds"))


def contrasts_table(found: DataFrame, ratio: DataFrame | None = None) -> str:
    """Contrasts (and the ratio, if given) as Markdown."""
    rows = [[*map(str, r)] for r in contrast_rows(found).orderBy("key", "metric").collect()]
    out = _markdown("Contrasts", ["contrast", "metric", "difference", "pooled spread", "seeds"], rows)
    if ratio is None:
        return out
    shown = ratio.select("metric", number(F.col("ratio")).alias("r"), number(F.col("low")).alias("l"), number(F.col("high")).alias("h"), F.when(F.col("bounded"), "bounded").otherwise("unbounded").alias("b")).orderBy("metric").collect()
    return out + "\n" + _markdown("Ratio", ["metric", "ratio", "interval", "denominator"], [[r["metric"], r["r"], f"[{r['l']}, {r['h']}]", r["b"]] for r in shown])


def doubts(found: DataFrame, metric: str) -> DataFrame:
    """What speaks against reading a contrast as it stands, a row each: flagged runs, gaps in cut answers as large as the difference,
    overlapping seeds, an interval that holds 0."""
    reasons = F.array_compact(F.array(
        F.when(F.col("flagged_a") + F.col("flagged_b") > 0, F.concat((F.col("flagged_a") + F.col("flagged_b")).cast("string"), F.lit(" runs have over 5 % cut answers"))),
        F.when(F.abs("truncation_rate_gap") >= F.abs("delta"), F.lit("the arms differ in cut answers by as much as in score")),
        F.when(F.col("ranges_overlap"), F.lit("the seeds' ranges overlap")),
        F.when((F.col("low") <= 0) & (F.col("high") >= 0), F.lit("the interval holds 0")),
    ))
    return found.where(F.col("metric") == metric).select("key", F.explode(reasons).alias("doubt"))


def grading_sheet(found: DataFrame, metric: str) -> str:
    """Contrasts to be judged, each with its figures and an empty line for the verdict."""
    rows = contrast_rows(found.where(F.col("metric") == metric)).orderBy("key").collect()
    return "\n".join(f"### {r['key']}\n\n{r['delta']}, pooled spread {r['pooled']}, seeds {r['seeds']}\n\nVerdict:\n" for r in rows)


def arm_report(arm: str, cells: DataFrame, budgets: DataFrame, metrics: Sequence[str]) -> str:
    """One arm's results and budgets."""
    sums = budgets.where(F.col("arm") == arm).select("seed", *[c for c in budgets.columns if c not in ("arm", "seed")]).orderBy("seed").collect()
    names = list(sums[0].asDict()) if sums else ["seed"]
    table = _markdown("Budgets", names, [[MISSING if v is None else str(v) for v in r] for r in sums])
    return f"# {arm}\n\n" + results_table(cells.where(F.col("arm") == arm), metrics) + "\n" + table


def acceptance_report(checks: DataFrame) -> str:
    """Checks of a training run, failures first, and whether it is accepted."""
    rows = checks.orderBy(F.col("severity") != "FAIL", "check", "message").collect()
    verdict = "not accepted" if any(r["severity"] == "FAIL" for r in rows) else "accepted"
    return _markdown(f"Run {verdict}", ["check", "severity", "message"], [[r["check"], r["severity"], r["message"]] for r in rows])


def bounds_table(bounds: DataFrame) -> str:
    """Contrasts in their four scenarios, and whether the sign is the same in all."""
    names = ["as_scored", "a_up", "b_up", "both_up"]
    wide = bounds.groupBy("key", "metric").pivot("scenario", names).agg(F.first("delta"))
    same = (F.signum(F.greatest(*names)) == F.signum(F.least(*names))).alias("same")
    rows = wide.select("key", "metric", *[number(F.col(n), signed=True).alias(n) for n in names], same).orderBy("key", "metric").collect()
    return _markdown("Bounds", ["contrast", "metric", *names, "identified"], [[*map(str, r[:6]), "yes" if r["same"] else "no"] for r in rows])


def packet(sections: Mapping[str, str]) -> str:
    """Reports as numbered sections of one document, from 0."""
    return "\n".join(f"# {k}. {title}\n\n{text.rstrip()}\n" for k, (title, text) in enumerate(sections.items()))


def figure_frames(scores: DataFrame, cells: DataFrame, found: DataFrame, log: DataFrame, bounds: DataFrame, budgets: DataFrame, curve: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the figures: accuracy by arm, by tier, contrasts, training curves, pass@k, bounds, budgets, lengths."""
    from .dynamics import trailing_mean

    return {
        "accuracy": cells.select("arm", "metric", "mean", "std", "low", "high"),
        "tiers": scores.groupBy("arm", "tier", "metric").agg(F.avg("score").alias("mean")),
        "contrasts": found.select("key", "metric", "delta", "low", "high"),
        "training": trailing_mean(log, "step", "reward_mean", by=["arm", "seed"]),
        "pass_at_k": curve,
        "bounds": bounds,
        "budgets": budgets.groupBy("arm").agg(F.sum("completions").alias("completions"), F.sum("tokens").alias("tokens")),
        "lengths": lengths,
    }
