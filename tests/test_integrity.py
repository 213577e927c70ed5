"""A clean store passes every check, and each spoiled one fails the check that is about it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import integrity as g
from tallyforge.operators import units as u

BY = ["unit"]
FIELDS = ["accuracy", "truncation_rate", "mean_tokens"]
ARMS = {"picked": "rft", "paid": "grpo", "random": "grpo"}


def digest(ids):
    return hashlib.sha256("".join(f"{i}\n" for i in sorted(map(str, ids))).encode()).hexdigest()


@pytest.fixture(scope="module")
def store(spark):
    """Three arms of two seeds, a split each of 6 and 8 problems, one transfer set."""
    sets = {"val": range(6), "test": range(10, 18), "other": range(30, 33)}
    splits = spark.createDataFrame([(s, i, k) for s in ("val", "test") for k, i in enumerate(sets[s])], "split string, problem_id long, split_idx int")
    units, rows, runs, rewards = [], [], [], []
    for arm, method in ARMS.items():
        for seed in (1, 2):
            path = f"{arm}/s{seed}"
            runs.append((arm, seed, method, path, "finished", f"{path}/final", 300 if method == "grpo" else None, 300, True, 1e-4, 2, 5, 40, True, "random_bernoulli" if arm == "random" else "verify", False))
            rewards += [(arm, seed, float(k % 2)) for k in range(40 if method == "grpo" else 0)]
            for split, ids in sets.items():
                first = 4 if split == "test" else None
                ids = list(ids)[:first] if first else list(ids)
                unit = f"{path}/{split}"
                for i in ids:
                    for k in range(2):
                        rows.append((unit, arm, seed, split, i, k, "easy", (i + k + seed) % 3 > 0, False, False, True, 10 + i, f"prompt {i}", f"{arm} {seed} {i} {k}", f"h{unit}"))
                units.append((unit, arm, seed, split, first, "base", "finished", 2 * len(ids), 2 * len(ids), "vllm", False, f"h{unit}", digest(ids), f"{path}/final", "final", f"runs/{path}", "ok", False, "abcdef0123", 2.5))
    samples = spark.createDataFrame(rows, "unit string, arm string, seed int, split string, problem_id long, sample_idx int, tier string, correct boolean, truncated boolean, extraction_failed boolean, answer_line boolean, n_tokens int, prompt string, completion string, config_hash string").cache()
    problems = u.derive(samples, BY)
    made = u.unit_metrics(problems, BY)
    units = spark.createDataFrame(units, "unit string, arm string, seed int, split string, first_n int, kind string, status string, n_samples long, n_samples_planned long, sampler string, thinking boolean, config_hash string, problem_ids_sha256 string, adapter string, eval_set string, train_run_dir string, protocol_vs_base string, git_dirty boolean, git_sha string, gpu_rate double")
    units = units.join(made.select("unit", *[F.col(f).alias(f"stored_{f}") for f in FIELDS]), "unit").join(u.prompt_digests(problems, BY), "unit").cache()
    texts = problems.join(units.where("split = 'val'").select("unit", "arm", "seed"), "unit").select("arm", "seed", "problem_id", "completion_sha")
    return {
        "units": units, "samples": samples, "splits": splits,
        "runs": spark.createDataFrame(runs, "arm string, seed int, method string, path string, status string, final_adapter string, max_steps int, global_step int, append_eos boolean, learning_rate double, epochs int, prompts int, tokens int, result_bearing boolean, reward string, git_dirty boolean"),
        "rewards": spark.createDataFrame(rewards, "arm string, seed int, reward double"),
        "adapters": spark.createDataFrame([(a, s, f"{a}/s{s}/final", f"{a}{s}") for a in ARMS for s in (1, 2)], "arm string, seed int, path string, sha256 string"),
        "listing": spark.createDataFrame([(f"{a}/s{s}/final", f"{a}{s}") for a in ARMS for s in (1, 2)], "path string, digest string"),
        "texts": texts, "base": spark.createDataFrame([(i, f"base {i}") for i in range(6)], "problem_id long, completion_sha string"),
        "chosen": spark.createDataFrame([("picked", "val", 1e-4, 2)], "arm string, selected_on string, learning_rate double, epochs int"),
        "sweep": spark.createDataFrame([("picked", 1e-4, 2, 0.8, "val"), ("picked", 2e-4, 2, 0.8, "val"), ("picked", 1e-4, 3, 0.8, "val"), ("picked", 1e-5, 1, 0.7, "val")], "arm string, learning_rate double, epochs int, val_accuracy double, selection_split string"),
    }


CHECKS = {
    "unit_integrity": lambda s: g.unit_integrity(s["units"], s["samples"], u.unit_metrics(u.derive(s["samples"], BY), BY), FIELDS),
    "committed_splits": lambda s: g.committed_splits(s["units"], s["samples"], s["splits"], ["other"]),
    "prompt_bytes": lambda s: g.prompt_drift(s["units"]),
    "final_checkpoints": lambda s: g.final_checkpoints(s["runs"], s["units"], s["chosen"]),
    "seeds_differ": lambda s: g.seeds_differ(s["adapters"], s["texts"], s["base"], s["listing"]),
    "budgets": lambda s: g.budgets_present(s["runs"], s["rewards"], ["prompts", "tokens"], 40),
    "selection": lambda s: g.selection_rederived(s["sweep"], s["chosen"], "val"),
    "provenance": lambda s: g.provenance(s["units"], s["runs"]),
}


def at(where, column, value):
    return lambda df: df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))


ONE = "unit = 'paid/s1/val'"
SPOILED = [
    ("unit_integrity", "units", at(ONE, "status", "running")), ("unit_integrity", "units", at(ONE, "n_samples_planned", 99)), ("unit_integrity", "units", at(ONE, "sampler", "hf")),
    ("unit_integrity", "units", at(ONE, "thinking", True)), ("unit_integrity", "units", at(ONE, "config_hash", "x")), ("unit_integrity", "samples", at(f"{ONE} and problem_id = 1", "seed", 9)),
    ("unit_integrity", "units", at(ONE, "stored_accuracy", 0.123)), ("unit_integrity", "units", lambda d: d.withColumn("stored_mean_tokens", F.when(F.expr(ONE), F.lit(None)).otherwise(F.col("stored_mean_tokens")))),
    ("unit_integrity", "samples", lambda d: d.withColumn("truncated", F.expr(f"{ONE} and correct"))),
    ("committed_splits", "units", at(ONE, "problem_ids_sha256", "0")), ("committed_splits", "units", at(ONE, "split", "gone")), ("committed_splits", "splits", lambda d: d.where("problem_id <> 3")),
    ("committed_splits", "units", at("unit = 'paid/s1/other'", "problem_ids_sha256", "1")), ("committed_splits", "samples", at(f"{ONE} and problem_id = 1", "problem_id", 77)),
    ("prompt_bytes", "units", at(ONE, "prompt_digest", "d")),
    ("final_checkpoints", "runs", at("arm = 'paid' and seed = 2", "status", "failed")), ("final_checkpoints", "units", at(ONE, "adapter", "paid/s1/step_100")), ("final_checkpoints", "units", at(ONE, "eval_set", "val")),
    ("final_checkpoints", "units", at(ONE, "train_run_dir", "runs/paid/s2")), ("final_checkpoints", "units", at(ONE, "protocol_vs_base", "differs")), ("final_checkpoints", "runs", at("arm = 'random'", "global_step", 250)),
    ("final_checkpoints", "runs", at("arm = 'picked'", "append_eos", False)), ("final_checkpoints", "runs", at("arm = 'picked' and seed = 1", "epochs", 3)),
    ("seeds_differ", "adapters", at("seed = 2", "sha256", "paid1")), ("seeds_differ", "adapters", lambda d: d.withColumn("sha256", F.when(F.expr("arm = 'paid'"), F.lit(None)).otherwise(F.col("sha256")))),
    ("seeds_differ", "listing", at("path = 'paid/s1/final'", "digest", "no")), ("seeds_differ", "texts", lambda d: d.withColumn("completion_sha", F.when(F.expr("arm = 'random'"), F.col("problem_id").cast("string")).otherwise(F.col("completion_sha")))),
    ("seeds_differ", "base", lambda d: d.withColumn("completion_sha", F.sha2(F.concat(F.lit("paid 1 "), F.col("problem_id").cast("string"), F.lit(" 0")).cast("binary"), 256))),
    ("budgets", "runs", lambda d: d.withColumn("tokens", F.expr("if(arm = 'picked', null, tokens)"))), ("budgets", "rewards", lambda d: d.where("not (arm = 'paid' and seed = 1)")), ("budgets", "runs", at("arm = 'paid'", "result_bearing", False)),
    ("budgets", "rewards", at("arm = 'random'", "reward", 1.0)), ("selection", "chosen", at("true", "selected_on", "test")), ("selection", "chosen", at("true", "epochs", 1)),
    ("selection", "sweep", at("epochs = 3", "selection_split", "test")), ("selection", "sweep", lambda d: d.where("false")),
]


def test_a_clean_store_passes(store):
    found = g.all_checks([check(store) for check in CHECKS.values()]).collect()
    assert [r for r in found if r["severity"] == "FAIL"] == [] and {r["check"] for r in found} == {"provenance"}


@pytest.mark.parametrize("k", range(len(SPOILED)))
def test_each_fault_fails_its_check(store, k):
    name, table, spoil = SPOILED[k]
    found = CHECKS[name](store | {table: spoil(store[table])}).where("severity = 'FAIL'").collect()
    assert found and {r["check"] for r in found} == {name}


def test_notes(store):
    dirty = store | {"units": at(ONE, "git_dirty", True)(store["units"]), "runs": at("arm = 'paid' and seed = 1", "git_dirty", True)(store["runs"])}
    messages = {r["message"] for r in CHECKS["provenance"](dirty).collect()}
    assert messages == {"paid/s1/val: uncommitted changes at abcdef0", "paid/1: uncommitted changes", "hourly rate 2.5"}
    wrapped = store | {"units": at("arm = 'paid'", "kind", "instruct")(store["units"])}
    assert [tuple(r) for r in CHECKS["prompt_bytes"](wrapped).collect()] == [("prompt_bytes", "note", "6 units wrap the prompt")]


RUNS = "arm string, seed int, final_adapter string, present boolean, source string, epochs int, max_steps int, eval_step int, eval_set string"
TRAINED = [("e", 1, "e/1/final", True, "copied from e/1/epoch_3", 3, None, None, "final"), ("s", 1, "s/1/step_300", True, None, None, 300, None, "final"), ("s", 2, "s/2/step_200", True, None, None, 300, 200, "val")]
SAVED = [("e", 1, "epoch", k, f"e/1/epoch_{k}") for k in (1, 2, 3)] + [("s", seed, "step", k, f"s/{seed}/step_{k}") for seed in (1, 2) for k in (100, 200, 300)]
#: What is spoiled in a run, or which adapter is lost, and what the message then says.
FAULTS = [
    (0, "final_adapter", None, "isn't there"), (0, "present", False, "isn't there"), (0, "present", None, "isn't there"), (0, "epochs", 4, "3 epochs saved, 4 planned"), (0, "epochs", None, "none planned"), (0, "source", "copied from e/1/epoch_2", "no copy of epoch_3"),
    (1, "final_adapter", "s/2/step_300", "didn't save"), (1, "final_adapter", "s/1/step_200", "held-out sets"), (1, "eval_step", 200, "isn't that of step 200"), (2, "eval_set", "final", "held-out sets"), (2, "eval_step", 250, "isn't that of step 250"),
    ("lost", 2, None, "2 epochs saved, 3 planned"), ("lost", 5, None, "held-out sets"),
]


def test_saved_adapters(spark):
    adapters = spark.createDataFrame(SAVED, "arm string, seed int, kind string, at int, path string")
    names = [c.split()[0] for c in RUNS.split(", ")]
    assert g.saved_adapters(spark.createDataFrame(TRAINED, RUNS), adapters).collect() == []
    for which, what, value, message in FAULTS:
        if which == "lost":
            found = g.saved_adapters(spark.createDataFrame(TRAINED, RUNS), spark.createDataFrame([a for k, a in enumerate(SAVED) if k != what], adapters.schema))
        else:
            run = dict(zip(names, TRAINED[which], strict=True)) | {what: value}
            found = g.saved_adapters(spark.createDataFrame([tuple(run.values())], RUNS), adapters)
        rows = found.collect()
        assert rows and all(r["severity"] == "FAIL" for r in rows) and any(message in r["message"] for r in rows), (which, what, rows)


def test_adapter_at_each_step(spark):
    adapters = spark.createDataFrame(SAVED, "arm string, seed int, kind string, at int, path string").where("kind = 'step'")
    steps = spark.createDataFrame([("s", 1, k) for k in (1, 99, 100, 101, 250, 300, 999)] + [("x", 1, 5)], "arm string, seed int, step int")
    got = {(r["arm"], r["step"]): r["adapter"] for r in g.adapter_at(steps, adapters).collect()}
    assert got == {("s", 1): None, ("s", 99): None, ("s", 100): "s/1/step_100", ("s", 101): "s/1/step_100", ("s", 250): "s/1/step_200", ("s", 300): "s/1/step_300", ("s", 999): "s/1/step_300", ("x", 5): None}
