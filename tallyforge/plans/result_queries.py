"""Unit metrics, result cells, contrasts and integrity checks over the events table read as two arms of three seeds."""

from pyspark.sql import functions as F

from tallyforge.operators import integrity as g
from tallyforge.operators import resample
from tallyforge.operators import results as res
from tallyforge.operators import tree
from tallyforge.operators import units as u
from tallyforge.sources.adapters import V_SAMPLES, samples
from tallyforge.sources.files import stored

from .catalogue import query
from .metrics_queries import r, tiered_samples

SPECS = [res.Spec("one_vs_zero", "1", "0"), res.Spec("zero_vs_one", "0", "1")]
UNIT = ["arm", "seed", "split"]


def answers(spark, d):
    """Answers with arm as text, the split a problem belongs to, its tier, and the flags that a grader adds."""
    s = tiered_samples(spark, d)
    return s.select(
        "problem_id", "sample_idx", "tier", "correct", "truncated", "n_tokens", "completion", "seed", F.col("arm").cast("string").alias("arm"), F.when(F.col("problem_id") % 3 == 0, "ood").otherwise("test").alias("split"),
        (F.col("truncated") | (F.col("n_tokens") % 11 == 0)).alias("extraction_failed"), (F.col("n_tokens") % 4 > 0).alias("answer_line"), F.concat(F.lit("p"), F.col("problem_id").cast("string")).alias("prompt"),
    )


TIERED = f"""s0 AS ({V_SAMPLES}), p8 AS (SELECT problem_id, sum((correct AND sample_idx < 8)::INT) AS pass8 FROM s0 GROUP BY 1),
    a AS (SELECT s0.* EXCLUDE (arm), arm::VARCHAR AS arm, CASE WHEN problem_id % 3 = 0 THEN 'ood' ELSE 'test' END AS split, truncated OR n_tokens % 11 = 0 AS failed, n_tokens % 4 > 0 AS line,
        CASE WHEN pass8 >= 6 THEN 'easy' WHEN pass8 >= 2 THEN 'medium' ELSE 'hard' END AS tier FROM s0 JOIN p8 USING (problem_id)),
    p AS (SELECT arm, seed, split, problem_id, any_value(tier) AS tier, count(*) AS n, sum(correct::INT) AS c, avg(correct::INT) AS score, sum(truncated::INT) AS cut, avg(truncated::INT) AS cut_share, sum(failed::INT) AS failed, sum(line::INT) AS line,
        sum((n_tokens >= 1900)::INT) AS at_cap, sum((correct AND n_tokens > 2048)::INT) AS long, sum(n_tokens) AS tokens FROM a GROUP BY arm, seed, split, problem_id)"""


@query("unit_metrics", f"""WITH {TIERED} SELECT arm, seed, split, count(*) AS n_problems, sum(n)::BIGINT AS n_samples, CASE WHEN min(n) = max(n) THEN max(n) END AS samples_per_problem, round(avg(score), 9) AS accuracy, round(sum(cut) / sum(n), 9) AS truncation_rate,
    round(sum(failed) / sum(n), 9) AS extraction_failure_rate, round(sum(line) / sum(n), 9) AS answer_line_rate, round(sum(at_cap) / sum(n), 9) AS at_cap_rate, round(sum(tokens) / sum(n), 9) AS mean_tokens, round(sum(long) / nullif(sum(c), 0), 9) AS long_correct_share,
    sum(cut) / sum(n) > 0.05 AS flagged FROM p GROUP BY arm, seed, split""")
def unit_metrics(spark, d):
    out = u.unit_metrics(u.derive(answers(spark, d), UNIT, cap=1900), UNIT)
    rounded = ("accuracy", "truncation_rate", "extraction_failure_rate", "answer_line_rate", "at_cap_rate", "mean_tokens", "long_correct_share")
    return out.select(*UNIT, "n_problems", "n_samples", "samples_per_problem", *[r(c).alias(c) for c in rounded], "flagged")


@query("unit_tier_metrics", f"""WITH {TIERED} SELECT arm, seed, split, tier, count(*) AS n_problems, round(avg(score), 9) AS accuracy, round(sum(cut) / sum(n), 9) AS truncation_rate, round(sum(failed) / sum(n), 9) AS extraction_failure_rate,
    round(sum(at_cap) / sum(n), 9) AS at_cap_rate FROM p GROUP BY ALL""")
def unit_tier_metrics(spark, d):
    out = u.tier_metrics(u.derive(answers(spark, d), UNIT, cap=1900), UNIT)
    return out.withColumns({c: r(c) for c in ("accuracy", "truncation_rate", "extraction_failure_rate", "at_cap_rate")})


@query("decoding_summary", f"WITH {TIERED} SELECT arm, split, round(max(m) FILTER (seed = 1), 9) AS greedy, round(max(m) FILTER (seed = 2), 9) AS mean_at_k, round(max(m) FILTER (seed = 3), 9) AS pass_at_k FROM (SELECT arm, split, seed, avg(score) AS m FROM p GROUP BY ALL) GROUP BY arm, split")
def decoding_summary(spark, d):
    """Seeds stand for decodings."""
    m = u.unit_metrics(u.derive(answers(spark, d), UNIT), UNIT)
    named = m.withColumn("decoding", F.element_at(F.array(*map(F.lit, ("greedy", "mean_at_k", "pass_at_k"))), F.col("seed").cast("int")))
    return u.summary_table(named, ["arm", "split"], ["greedy", "mean_at_k", "pass_at_k"]).select("arm", "split", *[r(c).alias(c) for c in ("greedy", "mean_at_k", "pass_at_k")])


def scores(spark, d):
    """arm, seed, problem_id, tier, metric (the split), score, truncated."""
    p = u.derive(answers(spark, d), UNIT)
    return p.select("arm", "seed", "problem_id", "tier", F.col("split").alias("metric"), "score", F.col("truncated_share").alias("truncated"))


def rates(spark, d):
    m = u.unit_metrics(u.derive(answers(spark, d), UNIT), UNIT)
    return m.select("arm", "seed", F.col("split").alias("metric"), "truncation_rate", "extraction_failure_rate", "answer_line_rate", "mean_tokens")


def common(spark, d):
    """Problems that all arms and seeds have, as a contrast needs."""
    s = scores(spark, d)
    whole = s.groupBy("problem_id").agg(F.count_distinct("arm", "seed").alias("k")).where("k = 6")
    return s.join(whole.select("problem_id"), "problem_id", "left_semi")


SIDES = f"""{TIERED}, whole AS (SELECT problem_id FROM p GROUP BY 1 HAVING count(DISTINCT (arm, seed)) = 6), q AS (SELECT * FROM p SEMI JOIN whole USING (problem_id)),
    spec(key, a, b) AS (VALUES ('one_vs_zero', '1', '0'), ('zero_vs_one', '0', '1')),
    j AS (SELECT key, x.split AS metric, x.seed, x.problem_id, x.score AS a, y.score AS b, x.cut_share AS ta, y.cut_share AS tb FROM spec JOIN q x ON x.arm = a JOIN q y ON y.arm = spec.b AND y.seed = x.seed AND y.problem_id = x.problem_id),
    w AS (SELECT key, metric, seed, avg(a) AS a, avg(b) AS b, avg(ta) AS ta, avg(tb) AS tb, avg(a - b) AS delta FROM j GROUP BY ALL),
    c AS (SELECT key, metric, count(*) AS n_seeds, avg(delta) AS delta, stddev_samp(delta) AS delta_std, sqrt((var_samp(a) + var_samp(b)) / 2) AS pooled_std, greatest(min(a), min(b)) <= least(max(a), max(b)) AS ranges_overlap FROM w GROUP BY ALL)"""
GAP = "u AS (SELECT arm, seed, split AS metric, sum(cut) / sum(n) AS t, sum(failed) / sum(n) AS f FROM p GROUP BY ALL), gaps AS (SELECT key, u.metric, avg(t) FILTER (arm = a) - avg(t) FILTER (arm = b) AS tg, avg(f) FILTER (arm = a) - avg(f) FILTER (arm = b) AS fg, count(*) FILTER (arm = a AND t > 0.05) AS fa, count(*) FILTER (arm = b AND t > 0.05) AS fb FROM spec, u GROUP BY ALL)"


@query("contrast_block", f"""WITH {SIDES}, {GAP} SELECT key, metric, n_seeds, round(delta, 9) AS delta, round(delta_std, 9) AS delta_std, round(pooled_std, 9) AS pooled_std, ranges_overlap,
    round(tg, 9) AS truncation_rate_gap, round(fg, 9) AS extraction_failure_rate_gap, fa AS flagged_a, fb AS flagged_b FROM c JOIN gaps USING (key, metric)""")
def contrast_block(spark, d):
    out = res.contrasts(common(spark, d), rates(spark, d), res.spec_table(spark, SPECS), resamples=100)
    return out.select("key", "metric", "n_seeds", *[r(c).alias(c) for c in ("delta", "delta_std", "pooled_std")], "ranges_overlap", *[r(c).alias(c) for c in ("truncation_rate_gap", "extraction_failure_rate_gap")], "flagged_a", "flagged_b")


@query("criteria", f"WITH {SIDES} SELECT x.key, round(2 * x.pooled_std, 9) AS threshold, abs(x.delta) > 2 * x.pooled_std AS magnitude_ok, sign(x.delta) = sign(y.delta) AND x.delta <> 0 AS same_sign, abs(x.delta) > 2 * x.pooled_std AND sign(x.delta) = sign(y.delta) AND x.delta <> 0 AS met FROM c x JOIN c y ON x.key = y.key AND x.metric = 'test' AND y.metric = 'ood'")
def criteria(spark, d):
    found = res.contrasts(common(spark, d), rates(spark, d), res.spec_table(spark, SPECS), resamples=100)
    return res.criteria(found, "test", "ood").withColumn("threshold", r("threshold"))


@query("bounds_grid", f"""WITH {SIDES}, g AS (SELECT key, metric, a, b, ta, tb FROM w) SELECT key, metric, scenario, round(avg(a + ua * ta - b - ub * tb), 9) AS delta FROM g, (VALUES ('as_scored', 0, 0), ('a_up', 1, 0), ('b_up', 0, 1), ('both_up', 1, 1)) s(scenario, ua, ub) GROUP BY key, metric, scenario""")
def bounds_grid(spark, d):
    return res.bound_contrasts(common(spark, d), res.spec_table(spark, SPECS)).withColumn("delta", r("delta"))


@query("arm_tier_cells", f"WITH {SIDES}, v AS (SELECT arm, split AS metric, tier, seed, avg(score) AS v FROM q GROUP BY ALL) SELECT arm, metric, tier, count(*) AS n_seeds, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round(min(v), 9) AS seed_min, round(max(v), 9) AS seed_max FROM v GROUP BY ALL HAVING count(*) = 3")
def arm_tier_cells(spark, d):
    out = res.arm_cells(common(spark, d), None, 3, by=["tier"], resamples=100)
    return out.select("arm", "metric", "tier", "n_seeds", *[r(c).alias(c) for c in ("mean", "std", "seed_min", "seed_max")])


@query("budget_section", f"""WITH {TIERED}, b AS (SELECT arm, sum(n)::BIGINT AS completions, sum(tokens)::BIGINT AS tokens, count(DISTINCT seed) AS runs, count(*) / count(DISTINCT seed) AS prompts, avg(score) AS gain FROM p GROUP BY arm)
    SELECT arm, completions, tokens, runs, round(prompts, 9) AS prompts, round(gain * 100 / prompts, 9) AS gain_per_100_prompts, round(gain * 1000 / (completions / runs), 9) AS gain_per_1000_completions FROM b""")
def budget_section(spark, d):
    p = u.derive(answers(spark, d), UNIT)
    budgets = p.groupBy("arm", "seed").agg(F.sum("n").alias("completions"), F.sum("tokens").alias("tokens"), F.lit(0.0).alias("gpu_hours"), F.count("*").alias("prompts"))
    out = res.budget_section(budgets, p.groupBy("arm").agg(F.avg("score").alias("gain")))
    return out.select("arm", "completions", "tokens", "runs", *[r(c).alias(c) for c in ("prompts", "gain_per_100_prompts", "gain_per_1000_completions")])


@query("number_texts", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE (CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END) || printf('%.2f', c_acctbal) END AS shown FROM customer")
def number_texts(spark, d):
    from tallyforge.sources.adapters import table

    x = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", res.number(x, 2, signed=True).alias("shown"))


@query("result_tree")
def result_tree(spark, d):
    """All results as one long table, with intervals of 10,000 resamples. Scores, rates and contrasts are used several times and computed once."""
    s, rt, specs = stored(common(spark, d).drop("truncated")), stored(rates(spark, d)), res.spec_table(spark, SPECS)
    found = stored(res.contrasts(s, rt, specs))
    return res.long_results(
        {"run": res.run_cells(s, rt), "arm": res.arm_cells(s, rt, 3), "arm_tier": res.arm_cells(s, None, 3, by=["tier"]), "contrast": found, "criterion": res.criteria(found, "test", "ood")},
        {"run": ["arm", "seed", "metric"], "arm": ["arm", "metric"], "arm_tier": ["arm", "tier", "metric"], "contrast": ["key", "metric"], "criterion": ["key"]},
    )


@query("exploratory_contrasts")
def exploratory_contrasts(spark, d):
    return res.exploratory(common(spark, d), rates(spark, d), res.spec_table(spark, SPECS), "test", "ood")


def interval_sql(scores: str, by: str) -> str:
    """Of a table ``scores`` (``by``, problem_id, score): n_problems, mean, low, high by weights of 10,000 resamples."""
    return f"""problems AS (SELECT DISTINCT problem_id FROM {scores}), drawn AS ({resample.weights_sql(10_000)}),
    means AS (SELECT {by}, trial, sum(w * score) / nullif(sum(w), 0) AS m FROM {scores} JOIN drawn USING (problem_id) GROUP BY {by}, trial),
    ends AS (SELECT {by}, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means WHERE m IS NOT NULL GROUP BY {by}),
    found AS (SELECT {by}, count(*) AS n_problems, round(avg(score), 9) AS mean FROM {scores} GROUP BY {by})"""


BOUNDS = ("mean", "low", "high")


@query("weighted_bootstrap", f"""WITH {SIDES}, sc AS (SELECT arm, seed, split AS metric, problem_id, score FROM q), {interval_sql('sc', 'arm, seed, metric')} SELECT * FROM found JOIN ends USING (arm, seed, metric)""")
def weighted_bootstrap(spark, d):
    return resample.intervals(common(spark, d), ["arm", "seed", "metric"]).withColumns({c: r(c) for c in BOUNDS})


RATIO = f"""WITH {SIDES}, sc AS (SELECT split AS metric, problem_id, avg(score) FILTER (arm = '1') AS top, avg(score) FILTER (arm = '0') AS bottom FROM q GROUP BY split, problem_id),
    problems AS (SELECT DISTINCT problem_id FROM sc), drawn AS ({resample.weights_sql(10_000)}),
    sums AS (SELECT metric, trial, sum(w * top) AS x, sum(w * bottom) AS y FROM sc JOIN drawn USING (problem_id) GROUP BY metric, trial),
    ends AS (SELECT metric, round(quantile_cont(x / nullif(y, 0), 0.025), 9) AS low, round(quantile_cont(x / nullif(y, 0), 0.975), 9) AS high, round(avg((y <= 0)::INT), 9) AS share_below, avg((y <= 0)::INT) < 0.025 OR avg((y >= 0)::INT) < 0.025 AS bounded FROM sums GROUP BY metric),
    means AS (SELECT metric, avg(top) AS top, avg(bottom) AS bottom, count(*) AS n_problems FROM sc GROUP BY metric),
    seeds AS (SELECT metric, list(round(x / y, 9) ORDER BY seed) AS per_seed FROM (SELECT split AS metric, seed, avg(score) FILTER (arm = '1') AS x, avg(score) FILTER (arm = '0') AS y FROM q GROUP BY ALL) GROUP BY metric)
    SELECT metric, round(top, 9) AS top, round(bottom, 9) AS bottom, n_problems, round(top / bottom, 9) AS ratio, low, high, share_below, bounded, per_seed FROM means JOIN ends USING (metric) JOIN seeds USING (metric)"""


@query("ratio_interval", RATIO)
def ratio_interval(spark, d):
    """Of differences to a scripted third arm that is never right."""
    s = common(spark, d).drop("truncated", "tier")
    zero = s.where("arm = '0'").withColumn("arm", F.lit("none")).withColumn("score", F.lit(0.0))
    out = res.ratios(s.unionByName(zero), "1", "0", "none")
    return out.withColumns({c: r(c) for c in ("top", "bottom", "ratio", "low", "high", "share_below")} | {"per_seed": F.transform("per_seed", lambda x: F.round(x, 9))})


@query("contrast_intervals", f"""WITH {SIDES}, sc AS (SELECT key, metric, problem_id, avg(a - b) AS score FROM j GROUP BY ALL), {interval_sql('sc', 'key, metric')} SELECT key, metric, n_problems, low, high FROM found JOIN ends USING (key, metric)""")
def contrast_intervals(spark, d):
    """The paired intervals of contrasts, by all resamples."""
    out = res.contrasts(common(spark, d), rates(spark, d), res.spec_table(spark, SPECS))
    return out.select("key", "metric", "n_problems", r("low").alias("low"), r("high").alias("high"))


ALL = "coalesce({0}::VARCHAR, 'all')"


@query("result_cells", f"""WITH {SIDES}, r AS (SELECT arm, split AS metric, tier, seed, problem_id, avg(score) AS score FROM q GROUP BY GROUPING SETS ((arm, split, tier, problem_id, seed), (arm, split, tier, problem_id))),
    sc AS (SELECT CASE WHEN seed IS NULL THEN 'arm' ELSE 'run' END || CASE WHEN by_tier THEN '_tier' ELSE '' END AS level, arm, {ALL.format('seed')} AS seed, metric, CASE WHEN by_tier THEN tier ELSE 'all' END AS tier, problem_id, score FROM r, (VALUES (true), (false)) b(by_tier)),
    {interval_sql('sc', 'level, arm, seed, metric, tier')},
    spread AS (SELECT 'arm' || substr(level, 4) AS level, arm, 'all' AS seed, metric, tier, round(stddev_samp(m), 9) AS std, count(*) AS n_seeds FROM (SELECT level, arm, seed, metric, tier, avg(score) AS m FROM sc WHERE seed <> 'all' GROUP BY ALL) GROUP BY ALL)
    SELECT level, arm, seed, metric, tier, n_problems, mean, low, high, std, n_seeds FROM found JOIN ends USING (level, arm, seed, metric, tier) LEFT JOIN spread USING (level, arm, seed, metric, tier)""")
def result_cells(spark, d):
    """Runs and arms, whole and by tier, with intervals. An arm's mean is rounded to where the order of its sums can't be seen."""
    out = tree.cells(common(spark, d))
    return out.select("level", "arm", F.coalesce(F.col("seed").cast("string"), F.lit("all")).alias("seed"), "metric", F.coalesce("tier", F.lit("all")).alias("tier"), "n_problems", r("value").alias("mean"), r("low").alias("low"), r("high").alias("high"), r("std").alias("std"), "n_seeds")


def _units(spark, d):
    """Units of the two arms and of a base, which is run 1 of arm 0; every third is dirty."""
    rt = rates(spark, d)
    rt = rt.unionByName(rt.where("arm = '0' and seed = 1").withColumn("arm", F.lit("base")))
    name = F.concat_ws("/", "arm", "seed", "metric")
    return rt.withColumns({"unit": name, "git_dirty": F.col("seed") == 3, "kind": F.when(F.col("arm") == "base", "base").otherwise("arm"), "split": F.col("metric")})


def _with_base(spark, d):
    s = common(spark, d).drop("truncated")
    return s.unionByName(s.where("arm = '0' and seed = 1").withColumn("arm", F.lit("base")))


@query("arms_against_base", f"""WITH {SIDES}, b AS (SELECT problem_id, score FROM q WHERE arm = '0' AND seed = 1 AND split = 'test'),
    e AS (SELECT arm || '_vs_base' AS key, seed, problem_id, q.score - b.score AS score FROM q JOIN b USING (problem_id) WHERE split = 'test'), sc AS (SELECT key, problem_id, avg(score) AS score FROM e GROUP BY ALL),
    {interval_sql('sc', 'key')}, runs AS (SELECT key, seed, avg(score) AS s FROM e GROUP BY ALL), z AS (SELECT key, round(avg(s), 9) AS delta, count(*) AS n_seeds FROM runs GROUP BY key)
    SELECT key, delta, n_seeds, n_problems, low, high, replace(key, '_vs_base', '/3/test') AS dirty_units FROM z JOIN found USING (key) JOIN ends USING (key)""")
def arms_against_base(spark, d):
    scores = _with_base(spark, d).where("metric = 'test'")
    found = tree.contrast_blocks(scores, tree.whole_units(_units(spark, d)), res.spec_table(spark, tree.base_specs(["0", "1", "base"])))
    return found.select("key", r("delta").alias("delta"), "n_seeds", "n_problems", r("low").alias("low"), r("high").alias("high"), F.array_join("dirty_units", " ").alias("dirty_units"))


@query("figure_pass_at_k", f"""WITH {TIERED}, x AS (SELECT arm, seed, k, n, CASE WHEN n - c < k THEN 1.0 ELSE 1 - list_reduce(list_transform(range(0, k), lambda i: (n - c - i) / (n - i)), lambda a, b: a * b, 1.0::DOUBLE) END AS one FROM p, (VALUES (1), (2), (4), (8)) v(k)),
    y AS (SELECT arm, seed, k, avg(one) AS pk, min(n) AS least FROM x GROUP BY arm, seed, k)
    SELECT arm, k::INT AS k, round(avg(pk), 9) AS mean, round(min(pk), 9) AS low, round(max(pk), 9) AS high FROM y GROUP BY arm, k HAVING min(least) >= k""")
def figure_pass_at_k(spark, d):
    p = u.derive(answers(spark, d), UNIT)
    return tree.pass_curve(p, (1, 2, 4, 8)).withColumns({c: r(c) for c in BOUNDS})


RUN_LOG = f"SELECT arm, seed, sample_idx % 40 AS step, count(*) AS n, avg(correct::INT) AS reward_mean, avg(n_tokens) AS length FROM ({V_SAMPLES}) GROUP BY ALL"


@query("figure_training", f"""WITH g AS ({RUN_LOG}), w AS (SELECT arm, step, unnest(['reward_mean', 'length']) AS field, unnest([sum(reward_mean * n) OVER t / sum(n) OVER t, sum(length * n) OVER t / sum(n) OVER t]) AS x FROM g WINDOW t AS (PARTITION BY arm, seed ORDER BY step ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
    SELECT arm, step, field, round(avg(x), 7) AS mean, round(min(x), 7) AS low, round(max(x), 7) AS high FROM w GROUP BY ALL""")
def figure_training(spark, d):
    g = samples(spark, d).groupBy("arm", "seed", (F.col("sample_idx") % 40).alias("step")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("reward_mean"), F.avg("n_tokens").alias("length"))
    return tree.training_curves(g, ["reward_mean", "length"]).withColumns({c: r(c, 7) for c in BOUNDS})


@query("figure_lengths", f"WITH s AS ({V_SAMPLES}), c AS (SELECT arm, least(n_tokens // 256, 9)::INT AS bin, correct, count(*) AS n FROM s GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY arm), 9) AS share FROM c")
def figure_lengths(spark, d):
    return tree.length_shares(samples(spark, d), bins=10).withColumn("share", r("share"))


# -- integrity checks with planted faults: the store's units are arms and seeds of the split


def _store(spark, d):
    a = answers(spark, d).withColumn("unit", F.concat_ws("/", "arm", "seed", "split")).withColumn("config_hash", F.concat(F.lit("h"), F.col("seed").cast("string")))
    a = a.withColumn("truncated", F.col("truncated") | (F.col("correct") & (F.col("problem_id") % 50 == 1)))
    p = u.derive(a, ["unit"])
    m = u.unit_metrics(p, ["unit"])
    bad = F.col("unit") == "1/2/test"
    units = m.select("unit", F.split("unit", "/")[0].alias("arm"), F.split("unit", "/")[1].cast("long").alias("seed"), F.split("unit", "/")[2].alias("split"), F.when(bad, "running").otherwise("finished").alias("status"), "n_samples", (F.col("n_samples") + F.when(F.col("unit") == "0/1/ood", 1).otherwise(0)).alias("n_samples_planned"),
        F.lit("vllm").alias("sampler"), F.lit(False).alias("thinking"), (F.col("accuracy") + F.when(F.col("unit") == "0/3/test", 0.25).otherwise(0)).alias("stored_accuracy"), F.lit(None).cast("int").alias("first_n"))
    return a, units.withColumn("config_hash", F.concat(F.lit("h"), F.col("seed").cast("string"))), m


@query("unit_integrity", f"""WITH {TIERED}, x AS (SELECT arm || '/' || seed || '/' || split AS unit, count(*) AS n, sum((correct AND (truncated OR problem_id % 50 = 1))::INT) AS cut FROM a GROUP BY 1),
    m AS (SELECT unit, 'status running' AS what FROM x WHERE unit = '1/2/test' UNION ALL SELECT unit, 'recorded ' || n || ', planned ' || (n + 1) || ', found ' || n FROM x WHERE unit = '0/1/ood'
    UNION ALL SELECT unit, cut || ' cut answers count as right' FROM x WHERE cut > 0 UNION ALL SELECT unit, 'stored accuracy isn''t the one computed' FROM x WHERE unit = '0/3/test')
    SELECT 'unit_integrity' AS "check", 'FAIL' AS severity, unit || ': ' || what AS message FROM m""")
def unit_integrity(spark, d):
    a, units, m = _store(spark, d)
    return g.unit_integrity(units, a, m, ["accuracy"])


@query("committed_splits", f"""WITH {TIERED}, x AS (SELECT DISTINCT arm || '/' || seed || '/' || split AS unit, split, problem_id FROM a), want AS (SELECT DISTINCT unit, y.problem_id FROM (SELECT DISTINCT unit, split FROM x) JOIN (SELECT DISTINCT split, problem_id FROM a WHERE problem_id % 40 <> 7) y USING (split)),
    apart AS (SELECT unit, count(*) AS n FROM (SELECT unit, problem_id, 1 AS h FROM x) FULL JOIN (SELECT *, 1 AS w FROM want) USING (unit, problem_id) WHERE h IS NULL OR w IS NULL GROUP BY unit),
    dg AS (SELECT unit, sha256(string_agg(problem_id || chr(10), '' ORDER BY problem_id::VARCHAR)) AS digest FROM want GROUP BY unit), hv AS (SELECT unit, sha256(string_agg(problem_id || chr(10), '' ORDER BY problem_id::VARCHAR)) AS digest FROM x GROUP BY unit)
    SELECT 'committed_splits' AS "check", 'FAIL' AS severity, unit || ': ' || n || ' problems aren''t those of the committed split' AS message FROM apart UNION ALL SELECT 'committed_splits', 'FAIL', unit || ': digest isn''t that of the committed split' FROM dg JOIN hv USING (unit) WHERE dg.digest <> hv.digest""")
def committed_splits(spark, d):
    a, units, _ = _store(spark, d)
    committed = a.where("problem_id % 40 <> 7").select("split", "problem_id", F.lit(0).alias("split_idx")).distinct()
    own = g.id_digest_of(a.select("unit", "problem_id").distinct(), ["unit"]).select("unit", F.col("digest").alias("problem_ids_sha256"))
    return g.committed_splits(units.join(own, "unit"), a, committed)


@query("selection_rederived", """WITH s AS (SELECT p_brand AS arm, p_retailprice AS acc, p_size % 5 + 1 AS epochs, round(p_partkey % 11 / 100.0, 4)::DOUBLE AS lr, p_partkey % 97 = 0 AS off FROM part),
    b AS (SELECT arm, arg_min((lr, epochs), (-acc, epochs, lr)) AS best, min(lr) AS low FROM s GROUP BY arm)
    SELECT 'selection' AS "check", 'FAIL' AS severity, arm || ': ' || n || ' settings scored elsewhere' AS message FROM (SELECT arm, count(*) AS n FROM s WHERE off GROUP BY arm) UNION ALL
    SELECT 'selection', 'FAIL', arm || ': not the best setting' FROM b WHERE best[1] <> low OR best[2] <> 1""")
def selection_rederived(spark, d):
    from tallyforge.sources.adapters import table

    sweep = table(spark, d, "part").select(F.col("p_brand").alias("arm"), F.col("p_retailprice").alias("val_accuracy"), (F.col("p_size") % 5 + 1).alias("epochs"), F.round(F.col("p_partkey") % 11 / 100.0, 4).alias("learning_rate"), F.when(F.col("p_partkey") % 97 == 0, "test").otherwise("val").alias("selection_split"))
    chosen = sweep.groupBy("arm").agg(F.min("learning_rate").alias("learning_rate"), F.lit(1).alias("epochs"), F.lit("val").alias("selected_on"))
    found = g.selection_rederived(sweep, chosen, "val")
    return found.withColumn("message", F.regexp_replace("message", "the best setting is .*", "not the best setting"))
