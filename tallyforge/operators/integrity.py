"""Checks of a store of runs: rows (check, severity, message), like those of ``checks``.

Tables: ``units`` (unit, arm, seed, split, decoding and what its records say), ``samples`` (unit, problem_id, sample_idx, ...),
``runs`` (arm, seed, method and what its records say). Keys that a table lacks are an error, values that it lacks are violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .checks import _rows, _say

TOLERANCE = 1e-12


def _where(table: DataFrame, name: str, bad: Column, *message: str | Column, severity: str = "FAIL") -> DataFrame:
    return _rows(table.where(F.coalesce(bad, F.lit(True))), name, _say(*message), severity)


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _run(*columns: str) -> Column:
    return F.concat_ws("/", *columns)


def close(a: Column, b: Column) -> Column:
    """Both null, or equal to within TOLERANCE."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))


def unit_integrity(units: DataFrame, samples: DataFrame, computed: DataFrame, fields: Sequence[str], sampler: str = "vllm") -> DataFrame:
    """Every unit finished, has as many answers as planned and recorded, from the one sampler, without thinking; its answers carry its
    hash and seed; no cut answer counts as right; its stored metrics ``stored_<field>`` are those computed anew (unit and ``fields``)."""
    name, unit = "unit_integrity", F.col("unit")
    facts = samples.groupBy("unit").agg(
        F.count("*").alias("n_rows"), F.array_sort(F.collect_set("config_hash")).alias("hashes"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.count_if(F.col("truncated") & F.col("correct")).alias("cut_right")
    )
    u = units.join(facts, "unit", "left").join(computed.select("unit", *fields), "unit", "left")
    n = F.coalesce("n_rows", F.lit(0))
    parts = [
        _where(u, name, ~F.col("status").eqNullSafe(F.lit("finished")), unit, ": status ", F.col("status")),
        _where(u, name, ~(F.col("n_samples").eqNullSafe(F.col("n_samples_planned")) & F.col("n_samples").eqNullSafe(n)), unit, ": recorded ", F.col("n_samples"), ", planned ", F.col("n_samples_planned"), ", found ", n),
        _where(u, name, ~F.col("sampler").eqNullSafe(F.lit(sampler)), unit, ": sampler ", F.col("sampler")),
        _where(u, name, ~F.col("thinking").eqNullSafe(F.lit(False)), unit, ": thinking ", F.col("thinking")),
        _where(u, name, ~F.col("hashes").eqNullSafe(F.array("config_hash")), unit, ": answers carry hashes ", F.array_join("hashes", ", ")),
        _where(u, name, ~F.col("seeds").eqNullSafe(F.array("seed")), unit, ": answers carry seeds ", F.array_join(F.col("seeds").cast("array<string>"), ", ")),
        _where(u, name, F.col("cut_right") > 0, unit, ": ", F.col("cut_right"), " cut answers count as right"),
    ]
    return _all(parts + [_where(u, name, ~close(F.col(f"stored_{f}"), F.col(f)), unit, f": stored {f} isn't the one computed") for f in fields])


def id_digest_of(problems: DataFrame, by: Sequence[str]) -> DataFrame:
    """SHA-256 of a set's ids in order, a line each. A set is one split, so its ids fit in a row."""
    ids = F.array_sort(F.collect_set(F.col("problem_id").cast("string")))
    return problems.groupBy(*by).agg(F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")).cast("binary"), 256).alias("digest"))


def committed_splits(units: DataFrame, samples: DataFrame, splits: DataFrame, transfer: Sequence[str] = ()) -> DataFrame:
    """Every unit's recorded digest and its answers' problems are those of the committed split, or of its first ``first_n`` problems
    (null: all); the splits of ``transfer``, which aren't committed, have one digest over all units."""
    name, unit = "committed_splits", F.col("unit")
    own = units.where(~F.col("split").isin(*transfer)) if transfer else units
    wanted = own.join(splits, "split").where(F.col("first_n").isNull() | (F.col("split_idx") < F.col("first_n"))).select("unit", "problem_id")
    digests = own.join(id_digest_of(wanted, ["unit"]), "unit", "left")
    have = samples.join(own.select("unit"), "unit", "left_semi").select("unit", "problem_id").distinct()
    apart = wanted.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), ["unit", "problem_id"], "full_outer").where("w is null or h is null").groupBy("unit").agg(F.count("*").alias("n"))
    parts = [
        _where(digests, name, F.col("digest").isNull(), unit, ": no split ", F.col("split")),
        _where(digests.where("digest is not null"), name, ~F.col("problem_ids_sha256").eqNullSafe(F.col("digest")), unit, ": digest isn't that of the committed split"),
        _where(apart, name, F.lit(True), unit, ": ", F.col("n"), " problems aren't those of the committed split"),
    ]
    if transfer:
        sets = units.where(F.col("split").isin(*transfer)).groupBy("split").agg(F.count_distinct("problem_ids_sha256").alias("k"))
        parts.append(_where(sets, name, F.col("k") > 1, F.col("split"), ": ", F.col("k"), " different sets of problems"))
    return _all(parts)


def prompt_drift(units: DataFrame) -> DataFrame:
    """Units of base models on one split and subset have one digest of their prompts; others wrap the prompt and are counted as a note."""
    base = units.where("kind = 'base'").groupBy("split", "first_n").agg(F.count_distinct("prompt_digest").alias("k"), F.count("*").alias("n"))
    others = units.where("kind <> 'base'").agg(F.count("*").alias("n"))
    return _where(base, "prompt_bytes", F.col("k") > 1, F.col("split"), ": ", F.col("k"), " sets of prompts in ", F.col("n"), " units").unionByName(
        _where(others, "prompt_bytes", F.col("n") > 0, F.col("n"), " units wrap the prompt", severity="note")
    )


def final_checkpoints(runs: DataFrame, units: DataFrame, chosen: DataFrame, root: str = "runs") -> DataFrame:
    """Training finished; every unit names its run's final adapter, folder and set, under the base's protocol; a run of max_steps
    stopped there; a run whose setting was chosen (arm, learning_rate, epochs) has that one, and ends its texts."""
    name, run = "final_checkpoints", _run("arm", "seed")
    u = units.join(runs.select("arm", "seed", "final_adapter", "path"), ["arm", "seed"])
    of = F.concat(F.col("unit"), F.lit(": "))
    stepped = runs.where("max_steps is not null")
    picked = runs.join(F.broadcast(chosen.select("arm", F.col("learning_rate").alias("lr"), F.col("epochs").alias("ep"))), "arm")
    return _all([
        _where(runs, name, ~F.col("status").eqNullSafe(F.lit("finished")), run, ": training ", F.col("status")),
        _where(u, name, ~F.col("adapter").eqNullSafe(F.col("final_adapter")), of, "adapter ", F.col("adapter"), ", the final one is ", F.col("final_adapter")),
        _where(u, name, ~F.col("eval_set").eqNullSafe(F.lit("final")), of, "set ", F.col("eval_set")),
        _where(u, name, ~F.col("train_run_dir").eqNullSafe(F.concat(F.lit(root + "/"), F.col("path"))), of, "run folder ", F.col("train_run_dir")),
        _where(u, name, ~F.col("protocol_vs_base").eqNullSafe(F.lit("ok")), of, "protocol ", F.col("protocol_vs_base")),
        _where(stepped, name, ~F.col("global_step").eqNullSafe(F.col("max_steps")), run, ": at step ", F.col("global_step"), " of ", F.col("max_steps")),
        _where(picked, name, ~F.col("append_eos").eqNullSafe(F.lit(True)), run, ": append_eos ", F.col("append_eos")),
        _where(picked, name, ~(close(F.col("learning_rate"), F.col("lr")) & F.col("epochs").eqNullSafe(F.col("ep"))), run, ": not the chosen setting"),
    ])


def adapter_at(steps: DataFrame, adapters: DataFrame, by: tuple[str, ...] = ("arm", "seed")) -> DataFrame:
    """``steps`` (``by``, step) with adapter: the path of the last adapter (``by``, at, path) that the run had saved at that step, null before its first.
    A run's few adapters go to its rows as one sorted array, so rows of a long run needn't meet in a task."""
    saved = adapters.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("saved"))
    last = F.try_element_at(F.filter("saved", lambda a: a["at"] <= F.col("step")), F.lit(-1))["path"]
    return steps.join(saved, list(by), "left").select(*steps.columns, last.alias("adapter"))


def saved_adapters(runs: DataFrame, adapters: DataFrame) -> DataFrame:
    """What a run says it saved and what is there. ``runs``: arm, seed, final_adapter, present (whether its folder is there), source (the text that names
    what the final adapter was copied from), epochs (planned) or max_steps, eval_step, eval_set. ``adapters``: arm, seed, kind (epoch or step), at, path.

    The final adapter is there. A run by epochs saved as many as planned, and its final one is a copy of the last. A run by steps evaluates an
    adapter that it saved: that of eval_step if one is named, and for the set ``final`` that of its last step."""
    name, run = "saved_adapters", _run("arm", "seed")
    kinds = adapters.groupBy("arm", "seed").agg(
        F.count_if(F.col("kind") == "epoch").alias("n_epochs"), F.max_by("path", F.when(F.col("kind") == "epoch", F.col("at"))).alias("last_epoch"), F.map_from_entries(F.collect_list(F.when(F.col("kind") == "step", F.struct("at", "path")))).alias("by_step")
    )
    known = runs.join(kinds, ["arm", "seed"], "left").withColumns({"n_epochs": F.coalesce("n_epochs", F.lit(0)), "by_step": F.coalesce("by_step", F.create_map().cast("map<int,string>"))})
    final, last = F.col("final_adapter"), F.regexp_extract("last_epoch", r"([^/]+)/?$", 1)
    epochs, stepped = known.where("epochs is not null or n_epochs > 0"), known.where("epochs is null and n_epochs = 0 and max_steps is not null")
    at = lambda step: F.try_element_at("by_step", F.col(step))
    named = F.col("eval_step").isNotNull()
    held_out = (F.col("eval_set") == "final") & (~at("max_steps").eqNullSafe(final) | (named & (F.col("eval_step") != F.col("max_steps"))))
    return _all([
        _where(known, name, final.isNull() | ~F.coalesce("present", F.lit(False)), run, ": the final adapter ", F.coalesce(final, F.lit("")), " isn't there"),
        _where(epochs, name, ~F.col("epochs").eqNullSafe(F.col("n_epochs")), run, ": ", F.col("n_epochs"), " epochs saved, ", F.coalesce(F.col("epochs").cast("string"), F.lit("none")), " planned"),
        _where(epochs, name, (F.col("n_epochs") > 0) & F.col("source").isNotNull() & ~F.contains("source", last), run, ": the final adapter is no copy of ", last),
        _where(stepped, name, ~named & ~F.array_contains(F.map_values("by_step"), final), run, ": the run didn't save ", F.coalesce(final, F.lit(""))),
        _where(stepped, name, named & ~at("eval_step").eqNullSafe(final), run, ": the final adapter isn't that of step ", F.col("eval_step")),
        _where(stepped, name, held_out, run, ": held-out sets take the adapter of step ", F.col("max_steps"), " alone"),
    ])


def seeds_differ(adapters: DataFrame, texts: DataFrame, base: DataFrame, listing: DataFrame | None = None, least: float = 0.1) -> DataFrame:
    """Adapters (arm, seed, path, sha256) are there and pairwise different, and are those of a checksum ``listing`` (path, digest) if given; no two
    seeds of an arm have all texts (arm, seed, problem_id, completion_sha) alike; a share of ``least`` differs from the ``base`` model's."""
    name, run = "seeds_differ", _run("arm", "seed")
    same = adapters.where("sha256 is not null").groupBy("sha256").agg(F.array_sort(F.collect_list(run)).alias("who")).where(F.size("who") > 1)
    # texts of one arm: an order-free sum tells sets that are wholly alike, without pairs of seeds
    sums = texts.groupBy("arm", "seed").agg(F.sum(F.xxhash64("problem_id", "completion_sha").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    alike = sums.groupBy("arm", "s", "n").agg(F.array_sort(F.collect_list("seed")).alias("seeds")).where(F.size("seeds") > 1)
    against = texts.join(base.select("problem_id", F.col("completion_sha").alias("b")), "problem_id").groupBy("arm", "seed").agg(F.avg((F.col("completion_sha") != F.col("b")).cast("double")).alias("share"))
    parts = [
        _where(adapters, name, F.col("sha256").isNull(), run, ": no adapter"),
        _where(same, name, F.lit(True), F.array_join("who", " and "), " have the same adapter"),
        _where(alike, name, F.lit(True), F.col("arm"), ": seeds ", F.array_join(F.col("seeds").cast("array<string>"), ", "), " give the same texts"),
        _where(against, name, F.col("share") < least, run, ": share of texts that differ from the base's ", F.round("share", 4)),
    ]
    if listing is not None:
        listed = adapters.where("sha256 is not null").join(listing.select("path", "digest"), "path", "left")
        parts.append(_where(listed.where("digest is not null"), name, F.col("digest") != F.col("sha256"), run, ": not the listed checksum"))
        parts.append(_where(listed, name, F.col("digest").isNull(), run, ": not in the listing", severity="note"))
    return _all(parts)


def budgets_present(runs: DataFrame, rewards: DataFrame, required: Sequence[str], records: int, rewarded: str = "grpo", random: str = "random_bernoulli") -> DataFrame:
    """Every run has the ``required`` budgets and finished; a ``rewarded`` run has exactly so many reward ``records`` and bears results; under
    the ``random`` reward its mean is near one half."""
    name, run = "budgets", _run("arm", "seed")
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    counts = rewards.groupBy("arm", "seed").agg(F.count("*").alias("records"), F.avg("reward").alias("mean"))
    paid = runs.where(F.col("method") == rewarded).join(counts, ["arm", "seed"], "left")
    return _all([
        _where(runs.withColumn("lacking", lacking), name, F.size("lacking") > 0, run, ": lacks ", F.array_join("lacking", ", ")),
        _where(runs, name, ~F.col("status").eqNullSafe(F.lit("finished")), run, ": training ", F.col("status")),
        _where(paid, name, ~F.col("records").eqNullSafe(F.lit(records).cast("long")), run, ": ", F.coalesce("records", F.lit(0)), f" reward records, not {records}"),
        _where(paid, name, ~F.col("result_bearing").eqNullSafe(F.lit(True)), run, ": result_bearing ", F.col("result_bearing")),
        _where(paid.where(F.col("reward") == random), name, ~F.col("mean").between(0.4, 0.6), run, ": mean reward ", F.round("mean", 4)),
    ])


def best_setting(sweep: DataFrame) -> DataFrame:
    """By arm the setting of the highest accuracy; of equal ones that of fewer epochs, then of the lower learning rate."""
    order = F.struct(-F.col("val_accuracy"), F.col("epochs"), F.col("learning_rate"))
    return sweep.groupBy("arm").agg(F.min_by(F.struct("learning_rate", "epochs"), order).alias("best"), F.count("*").alias("tried")).select("arm", "tried", "best.*")


def selection_rederived(sweep: DataFrame, chosen: DataFrame, split: str) -> DataFrame:
    """The chosen setting (arm, selected_on, learning_rate, epochs) was selected on ``split``, as all of its sweep was scored, and is the best one."""
    name, arm = "selection", F.col("arm")
    best = best_setting(sweep).select("arm", F.col("learning_rate").alias("lr"), F.col("epochs").alias("ep"), "tried")
    j = chosen.join(best, "arm", "left")
    other = sweep.where(~F.col("selection_split").eqNullSafe(F.lit(split))).groupBy("arm").agg(F.count("*").alias("n"))
    return _all([
        _where(chosen, name, ~F.col("selected_on").eqNullSafe(F.lit(split)), arm, ": selected on ", F.col("selected_on")),
        _where(j, name, F.col("tried").isNull(), arm, ": no sweep"),
        _where(other, name, F.lit(True), arm, ": ", F.col("n"), " settings scored elsewhere"),
        _where(j.where("tried is not null"), name, ~(close(F.col("learning_rate"), F.col("lr")) & F.col("epochs").eqNullSafe(F.col("ep"))), arm, ": the best setting is ", F.col("lr"), ", ", F.col("ep")),
    ])


def provenance(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Notes: units and runs recorded with uncommitted changes, and the hourly rates that records used."""
    name = "provenance"
    rates = units.select("gpu_rate").where("gpu_rate > 0").distinct()
    return _all([
        _where(units, name, F.coalesce("git_dirty", F.lit(False)), F.col("unit"), ": uncommitted changes at ", F.substring("git_sha", 1, 7), severity="note"),
        _where(runs, name, F.coalesce("git_dirty", F.lit(False)), _run("arm", "seed"), ": uncommitted changes", severity="note"),
        _where(rates, name, F.lit(True), "hourly rate ", F.col("gpu_rate"), severity="note"),
    ])


def extremes(rates: DataFrame, who: Sequence[str], column: str = "truncation_rate") -> DataFrame:
    """The highest rate and whose it is (the first of equal ones); 0 and null of none."""
    return rates.agg(F.coalesce(F.max(column), F.lit(0.0)).alias(column), F.min_by(F.concat_ws("/", *who), F.struct(-F.col(column), F.concat_ws("/", *who))).alias("who"))


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return _all(list(parts))


