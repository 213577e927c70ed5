"""Intervals against plain numpy, result cells and reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import resample, results
from tallyforge.plans import catalogue, result_queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(4)
    rows = [("x" if k % 2 else "y", k, float(rng.normal(0.3 if k % 2 else 0.0)), float(rng.normal(1.0 if k % 2 else 0.0))) for k in range(160)]
    return rows, spark.createDataFrame(rows, "arm string, problem_id long, top double, bottom double")


def test_weighted_sums_are_plain_sums(spark, pairs):
    rows, df = pairs
    got = resample.weighted_sums(df.repartition(3), ["arm"], ["top"], 50, seed=2).toPandas().sort_values(["arm", "trial"])
    keys = {r["problem_id"]: r["k"] for r in df.select("problem_id", resample.problem_key(F.col("problem_id")).alias("k")).collect()}
    for arm in "xy":
        mine = [(keys[k], t) for a, k, t, _ in rows if a == arm]
        w = resample.weights(np.array([k for k, _ in mine]), 50, 2)
        part = got[got.arm == arm]
        assert np.allclose(part.weight, w.sum(0)) and np.allclose(part.top, np.array([t for _, t in mine]) @ w)


def test_many_groups_and_groups_in_parts(spark, monkeypatch):
    """Groups of one and of many problems, null among the keys; a group dealt in parts has the same sums."""
    rows = spark.range(3000).select((F.when(F.col("id") % 7 > 0, F.col("id") % 500)).alias("g"), F.lit("x").alias("h"), F.col("id").alias("problem_id"), (F.col("id") % 11 / 10).alias("score"))
    rows = rows.union(spark.createDataFrame([(1, None, 1, 0.5), (1, None, 2, None), (2, None, 3, None)], "g long, h string, problem_id long, score double"))
    plain = {(r["g"], r["h"]): r for r in resample.intervals(rows, ["g", "h"], resamples=200).collect()}
    assert len(plain) == 502 and plain[1, None]["n_problems"] == 1 and plain[1, None]["low"] == plain[1, None]["high"] == 0.5
    finish = lambda sums: {"n": sums[0, :1], "a": sums[1, 1:2], "b": sums[1, 200:]}
    sums = [resample.by_group(rows, ["g", "h"], ["score"], finish, "n double, a double, b double", 200, large=n).collect() for n in (1 << 16, 4)]
    one, other = ({(r["g"], r["h"]): (r["n"], round(r["a"], 9), round(r["b"], 9)) for r in part} for part in sums)
    assert one == other and len(one) == 502 and one[None, "x"][0] == 429
    assert resample.intervals(rows, [], resamples=50).first()["n_problems"] == 3001


def test_weights_are_poisson():
    w = resample.weights(np.arange(1000, dtype=np.int64) * 7919, 400, 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_intervals_are_near_those_of_numpy(spark, pairs):
    rows, df = pairs
    got = {r["arm"]: r for r in resample.intervals(df, ["arm"], "top").collect()}
    ratio = {r["arm"]: r for r in resample.ratio_interval(df, ["arm"]).collect()}
    rng = np.random.default_rng(0)
    for arm in "xy":
        x, y = (np.array([r[c] for r in rows if r[0] == arm]) for c in (2, 3))
        at = rng.integers(0, len(x), (10_000, len(x)))
        low, high = np.quantile(x[at].mean(1), [0.025, 0.975])
        width = high - low
        assert abs(got[arm]["mean"] - x.mean()) < 1e-12 and abs(got[arm]["low"] - low) < 0.06 * width and abs(got[arm]["high"] - high) < 0.06 * width
        assert abs(ratio[arm]["ratio"] - x.mean() / y.mean()) < 1e-9 and abs(ratio[arm]["share_below"] - (y[at].mean(1) <= 0).mean()) < 0.03
    assert ratio["x"]["bounded"] and not ratio["y"]["bounded"]
    assert resample.intervals(df.where("false"), ["arm"], "top").count() == 0


def test_contrasts_pair_seeds_and_hold_their_interval(spark):
    s, rates = result_queries.common(spark, D), result_queries.rates(spark, D)
    found = results.contrasts(s, rates, results.spec_table(spark, result_queries.SPECS), resamples=2000).collect()
    assert len(found) == 4 and all(r["low"] <= r["delta"] <= r["high"] and len(r["deltas"]) == r["n_seeds"] == 3 for r in found)
    by = {(r["key"], r["metric"]): r for r in found}
    assert all(abs(by["one_vs_zero", m]["delta"] + by["zero_vs_one", m]["delta"]) < 1e-12 for m in ("test", "ood"))
    single = results.contrasts(s.where("arm = '1' or seed = 1"), rates, results.spec_table(spark, [results.Spec("base", "1", "0", True)]), resamples=200)
    p = s.toPandas()
    base = p[(p.arm == "0") & (p.seed == 1)].set_index("problem_id").score
    for r in single.collect():
        mine = p[(p.arm == "1") & (p.metric == r["metric"])]
        want = (mine.score - base.loc[mine.problem_id].to_numpy()).groupby(mine.seed).mean().mean()
        assert abs(r["delta"] - want) < 1e-12 and r["pooled_std"] is None and r["n_seeds"] == 3


def test_result_tree(spark):
    tree = catalogue.QUERIES["result_tree"](spark, D).toPandas()
    assert set(tree.section) == {"run", "arm", "arm_tier", "contrast", "criterion"} and not tree.duplicated(["section", "key", "field"]).any()
    wide = tree[tree.section == "run"].pivot(index="key", columns="field", values="value")
    assert len(wide) == 12 and (wide.low <= wide.value).all() and (wide.value <= wide.high).all()
    r = catalogue.QUERIES["ratio_interval"](spark, D).collect()
    assert {x["metric"] for x in r} == {"test", "ood"} and all(x["low"] <= x["ratio"] <= x["high"] and x["bounded"] and len(x["per_seed"]) == 3 for x in r)
    e = catalogue.QUERIES["exploratory_contrasts"](spark, D).collect()
    assert len(e) == 2 and all(x["bound_low"] <= x["delta"] <= x["bound_high"] for x in e)


def test_result_tree_computes_scores_once(spark):
    plan = catalogue.QUERIES["result_tree"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "LogicalRDD" in plan and plan.count("MapInArrow") == 3  # intervals of runs, arms, arms by tier


def test_a_cut_answer_that_is_right_is_an_error(spark):
    bad = spark.createDataFrame([("1", 1, 5, "test", 1.0, 0.5), ("0", 1, 5, "test", 0.5, 0.0)], "arm string, seed int, problem_id long, metric string, score double, truncated double")
    with pytest.raises(Exception, match="cut answer counts as right"):
        results.bound_contrasts(bad, results.spec_table(spark, [results.Spec("k", "1", "0")])).collect()


def test_reports(spark):
    s, rates = result_queries.common(spark, D).drop("truncated"), result_queries.rates(spark, D)
    cells = results.arm_cells(s, rates, 3, resamples=100).cache()
    table = results.results_table(cells, ["test", "gone"])
    lines = table.splitlines()
    assert lines[2] == "| arm | test | gone |" and len(lines) == 6 and all(line.endswith("| missing |") for line in lines[4:])
    found = results.contrasts(s, rates, results.spec_table(spark, result_queries.SPECS), resamples=100).cache()
    text = results.contrasts_table(found, results.ratios(s.unionByName(s.where("arm = '0'").withColumns({"arm": F.lit("n"), "score": F.lit(0.0)})), "1", "0", "n", resamples=100))
    assert "## Contrasts" in text and "## Ratio" in text and text.count("one_vs_zero") == 2
    assert results.grading_sheet(found, "test").count("Verdict:\n") == 2
    assert {r["key"] for r in results.doubts(found, "test").collect()} <= {"one_vs_zero", "zero_vs_one"}
    budgets = spark.createDataFrame([("0", 1, 5), ("0", 2, None)], "arm string, seed int, prompts int")
    assert "| 2 | missing |" in results.arm_report("0", cells, budgets, ["test"])
    checks = spark.createDataFrame([("a", "note", "m"), ("b", "FAIL", "n")], "check string, severity string, message string")
    assert results.acceptance_report(checks).splitlines()[0] == "## Run not accepted" and results.acceptance_report(checks.where("severity = 'note'")).startswith("## Run accepted")
    specs = [results.Spec("p", "a", "b")]
    assert [x.key for x in results.active(specs, [results.Spec("s", "a", "c"), results.Spec("t", "a", "b")], ["a", "b"])] == ["p", "t"]


def test_named_metrics_and_frames(spark):
    rows = [("a", 1, split, decoding, p, "easy", 8, c) for split, decoding, _ in results.METRICS.values() for p, c in ((1, 8), (2, 2))]
    problems = spark.createDataFrame(rows, "arm string, seed int, split string, decoding string, problem_id long, tier string, n int, c int").distinct().withColumn("score", F.col("c") / F.col("n"))
    got = {(r["metric"], r["problem_id"]): r["score"] for r in results.named_scores(problems).collect()}
    assert {m for m, _ in got} == set(results.METRICS) - {"test_pass64"} and got["test_pass8", 2] == 1.0 and got["test_greedy", 2] == 0.25
    assert [x.key for x in results.active(results.CONTRASTS, results.SECONDARY, ["rft_curated"])] == [x.key for x in results.CONTRASTS]
    bounds = spark.createDataFrame([("k", "m", s, d) for s, d in (("as_scored", 0.1), ("a_up", 0.2), ("b_up", -0.1), ("both_up", 0.1))], "key string, metric string, scenario string, delta double")
    assert results.bounds_table(bounds).splitlines()[-1] == "| k | m | +0.100 | +0.200 | -0.100 | +0.100 | no |"
    assert results.packet({"A": "x\n", "B": "y"}) == "# 0. A\n\nx\n\n# 1. B\n\ny\n"


def test_small_pieces(spark):
    from tallyforge.operators import generate, runs

    plan = spark.createDataFrame([(m, i) for m in "xyz" for i in range(5)], "model string, split_idx int")
    assert runs.configured(plan, ["x", "y"], 2).count() == 4 and runs.configured(plan).count() == 15
    samples = spark.createDataFrame([("c", 1, 0, "t"), ("c", 1, 1, "t")], "condition string, problem_id long, sample_idx int, completion string")
    assert runs.keyed_samples(samples).columns[:3] == ["condition", "problem_id", "sample_idx"]
    with pytest.raises(ValueError, match="repeated"):
        runs.keyed_samples(samples.union(samples))
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "problem_id long, prompt string")
    stored = prompts.where("problem_id < 3").select("problem_id", F.sha2(F.when(F.col("problem_id") == 2, "x").otherwise(F.col("prompt")).cast("binary"), 256).alias("sha256"))
    assert sorted(r["message"] for r in runs.prompt_hashes(prompts, stored).collect()) == ["2: another prompt", "3: no stored hash"]
    assert spark.range(1).select(generate.chat(F.lit("hi"), "<s>{system}</s><u>{user}</u>", "be brief").alias("c")).first()["c"] == "<s>be brief</s><u>hi</u>"
    pool = generate.pool_uniform(spark, 40).collect()
    assert len({r["problem_id"] for r in pool}) == 40 and {r["total_steps"] for r in pool} <= {2, 3, 4, 5} and len({(r["range_scale"], r["total_steps"]) for r in pool}) >= 4


def test_everything_by_one_call(spark, tmp_path):
    from tallyforge.operators import tree
    from tallyforge.sources import store

    scores, units = result_queries._with_base(spark, D), result_queries._units(spark, D).withColumn("label", F.upper("arm"))
    budgets = units.groupBy("arm", "seed").agg(F.lit(5).alias("prompts"))
    built = tree.build(scores, units, budgets, result_queries.SPECS, [results.Spec("gone", "1", "nobody")], test="test", other="ood", ratio=("1", "0", "base"), resamples=50)
    assert {r["key"] for r in built["contrasts"].collect()} == {"one_vs_zero", "zero_vs_one"} and {r["key"] for r in built["vs_base"].collect()} == {"0_vs_base", "1_vs_base"}
    dirty = {(r["key"], r["metric"]): r["dirty_units"] for r in built["contrasts"].collect()}
    assert dirty["one_vs_zero", "test"] == ["0/3/test", "1/3/test"]
    tables = tree.tables(built, test="test")
    assert set(tables) == set(store.TABLES)
    store.write_tables(tables, str(tmp_path))
    read = {n: spark.read.option("header", True).csv(str(tmp_path / n)) for n in store.TABLES}
    assert read["units"].count() == 14 and read["arms"].count() == 6 and read["contrasts"].count() == 4 and read["budgets"].count() == 7 and read["per_tier"].where("tier is null").count() == 0
    cells = {(r["level"], r["arm"], r["seed"], r["metric"], r["tier"]): r for r in built["cells"].collect()}
    p = scores.toPandas()
    for (level, arm, seed, metric, tier), r in cells.items():
        mine = p[(p.arm == arm) & (p.metric == metric)]
        mine = mine if seed is None else mine[mine.seed == seed]
        mine = mine if tier is None else mine[mine.tier == tier]
        assert abs(r["value"] - mine.groupby("seed").score.mean().mean()) < 1e-9 and r["n_problems"] == mine.problem_id.nunique() and (level.startswith("arm")) == (seed is None) and level.endswith("_tier") == (tier is not None)
    one = next(r for r in tables["contrasts"].collect() if (r["key"], r["metric"]) == ("one_vs_zero", "test"))
    assert len(one["delta_per_seed"].split()) == 3 and one["dirty_units"] == "0/3/test 1/3/test" and one["met"] is not None
    problems = units.select("arm", "seed", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("problem_id")).withColumns({"n": F.lit(8), "c": F.col("problem_id") * 2})
    log = units.select("arm", "seed", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("step")).withColumns({"n": F.lit(2), "reward_mean": F.col("step") / 30, "zero_std_share": F.lit(0.5), "length": F.lit(100.0), "cut_share": F.lit(0.0)}).distinct()
    answers = units.select("arm", F.explode(F.array(F.lit(10), F.lit(300), F.lit(99_999))).alias("n_tokens")).withColumn("correct", F.col("n_tokens") < 400)
    drawn = tree.figures(built, problems, log, answers, test="test", val=spark.createDataFrame([("1", 30, 0.5)], "arm string, step int, value double"))
    assert set(drawn) == {"accuracy", "tiers", "pass_at_k", "reward", "zero_std", "budget", "training_length", "answer_length"} and all(f.count() for f in drawn.values())
    assert {r["k"] for r in drawn["pass_at_k"].collect()} == {1, 2, 4, 8} and drawn["pass_at_k"].where("k = 8 and mean <> 1").count() == 0
    assert drawn["reward"].where("field = 'val'").count() == 1 and abs(drawn["reward"].where("arm = '0' and step = 30 and field = 'reward_mean'").first()["mean"] - sum(range(6, 31)) / 25 / 30) < 1e-12
    assert {(r["bin"], round(r["share"], 3)) for r in drawn["answer_length"].collect()} == {(0, 0.333), (1, 0.333), (16, 0.333)}
    assert {r["arm"]: r["prompts"] for r in drawn["budget"].collect()} == {"0": 5.0, "1": 5.0}
    flat = tree.flat(built)
    assert flat.where("field = 'value'").count() == 14 and flat.groupBy("arm", "seed", "metric", "field").count().where("count > 1").count() == 0
    text = tree.sections(built, ["test", "ood", "unknown"], test="test")
    assert list(text) == ["All arms", "Each arm's runs", "Base and reference models", "Tiers on test", "Cut answers by run", "Budgets"]
    assert text["All arms"].count("±") == 4 and text["Each arm's runs"].count("| mean |") == 2 and text["Base and reference models"].count("base") == 1 and "missing" in text["All arms"]
    assert text["Budgets"].count("| 5 |") == 7 and text["Cut answers by run"].count("%") == 14
    assert {r["arm"] for r in tree.cells(scores, n_seeds=3, resamples=20).where("level = 'arm'").collect()} == {"0", "1"}
    # the packet and the acceptance of the runs
    runs = spark.createDataFrame([("1", 1, "finished", "h1", 2.0), ("1", 2, "failed", "h2", None)], "arm string, seed long, status string, config_hash string, gpu_hours double")
    rewards = spark.createDataFrame([("1", 1, 1.0, False), ("1", 1, 0.0, True)], "arm string, seed long, reward double, truncated boolean")
    jobs = spark.createDataFrame([("eval_1_s1", 0, 3600.0), ("eval_1_s1", 1, 9000.0), ("eval_1_s2", 1, 60.0)], "job string, exit_code int, wall_s double")
    facts = tree.run_facts(runs, rewards, log.where("arm = '1' and seed = 1"), spark.createDataFrame([("1", 1, "p")], "arm string, seed long, path string"), jobs, rate=2.5)
    one, two = facts.orderBy("seed").collect()
    assert (one["records"], one["reward_mean"], one["truncation_rate"], one["last_step"], one["adapters"], one["eval_hours"], one["train_cost"], one["eval_cost"]) == (2, 0.5, 0.5, 30, 1, 1.0, 5.0, 2.5)
    assert abs(one["last_reward"] - sum(range(6, 31)) / 25 / 30) < 1e-12 and (two["records"], two["adapters"], two["eval_hours"], two["last_step"]) == (0, 0, None, None)
    checks = spark.createDataFrame([("a", "note", "m")], "check string, severity string, message string")
    text = tree.acceptance(checks, facts)
    assert text.startswith("## Run accepted") and "| total |" in text and "7.500" not in text and "| 5.000 |" in text
    whole = tree.packet(built, checks, facts, {"date": "today"}, ["test", "ood"], test="test", notes=["nothing"])
    heads = [line for line in whole.splitlines() if line.startswith("# ")]
    assert [h.split(".")[0] for h in heads] == [f"# {k}" for k in range(13)] and "FAILED" not in whole and whole.count("Verdict:") == 2
    broken = tree.packet(built, checks.withColumn("severity", F.lit("FAIL")), facts, {}, ["test"], test="test")
    assert broken.startswith("CHECKS FAILED") and broken.count("DEPENDS ON A FAILED CHECK") == 11
