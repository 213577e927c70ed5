"""Guards and look-ups that aren't queries."""

import pytest

from tallyforge.operators import dynamics, generate, runs


def test_resolve_split(spark):
    pool = spark.createDataFrame([(1, "S"), (2, "L")], "problem_id long, range_scale string")
    splits = {"val": spark.createDataFrame([(5, 0), (6, 1), (7, 2)], "problem_id long, split_idx int")}
    assert [r["problem_id"] for r in runs.resolve_split("val_first2", splits, pool).collect()] == [5, 6]
    assert [r["problem_id"] for r in runs.resolve_split("ood", splits, pool).collect()] == [2] and runs.resolve_split("pool", splits, pool).count() == 2
    with pytest.raises(ValueError, match="no split"):
        runs.resolve_split("nope", splits, pool)


def test_exact_counts_and_caps(spark):
    s = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "problem_id long, sample_idx int")
    assert runs.exactly_k(s, spark.createDataFrame([(1,)], "problem_id long"), 2).count() == 2
    with pytest.raises(ValueError, match="not exactly"):
        runs.exactly_k(s, s.select("problem_id").distinct(), 2)
    assert runs.enforce_cap(10, 10) == 10 and runs.enforce_cap(20, 10, exploratory=True) == 20
    with pytest.raises(ValueError, match="locked"):
        runs.enforce_cap(20, 10)


def test_first_rounds(spark):
    rows = spark.createDataFrame([(1, 0, "p"), (1, 1, "p"), (1, 2, "p")], "problem_id long, sample_idx int, prompt string")
    assert runs.first_rounds(rows, 2).count() == 2
    with pytest.raises(Exception, match="prompts differ"):
        runs.first_rounds(rows.union(spark.createDataFrame([(1, 3, "q")], rows.schema)), 2).collect()


def test_pool_config_guards():
    generate.check_phrases()
    with pytest.raises(ValueError, match="overlap"):
        generate.PoolConfig(bands=(("S", 10, 60), ("M", 51, 200)))
    with pytest.raises(ValueError, match="unknown"):
        generate.PoolConfig(excluded=("nope",))
    with pytest.raises(ValueError, match="steps"):
        generate.PoolConfig(steps=(2, 12))


def test_advantages_of_constant_groups(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0), (3, 1.0)], "g long, reward double")
    got = {(r["g"], r["reward"]): round(r["advantage"], 4) for r in dynamics.advantages(rows, "g").collect()}
    assert got == {(1, 1.0): 0.0, (2, 0.0): -0.7071, (2, 1.0): 0.7071, (3, 1.0): 0.0}


def test_places_over_many_ranges(spark):
    from tallyforge.operators.ordering import numbered
    from tallyforge.operators.tiering import interleave

    rows = [(k % 3 if k % 10 else None, k * 7919 % 601, f"r{k}") for k in range(1200)] + [(1, 5, "same")] * 3
    df = spark.createDataFrame(rows, "g long, o long, id string").repartition(5)
    got = numbered(df, ["o"], "place", range_rows=50).collect()
    assert sorted(r["place"] for r in got) == list(range(1203)) and [r["o"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r[1] for r in rows)
    within = numbered(df, ["o"], "place", by=["g"], range_rows=50).collect()
    for g in (None, 0, 1, 2):
        mine = sorted((r["place"], r["o"]) for r in within if r["g"] == g)
        assert mine == list(enumerate(sorted(o for h, o, _ in rows if h == g)))
    assert numbered(df.limit(0), ["o"], "place").count() == 0
    tiers = spark.createDataFrame([(t, k) for k, t in enumerate(["easy"] * 5 + ["hard"] * 3 + ["odd", "medium", None, "an"])], "tier string, k int")
    order = [r["tier"] for r in sorted(interleave(tiers, "k").collect(), key=lambda r: r["position"])]
    assert order == ["easy", "medium", "hard", "easy", "hard", "easy", "hard", "easy", "easy", None, "an", "odd"]


def test_tiering_samples_fit_their_split(spark):
    rows = [(p, k, "Answer: 5" if k < p else "Answer: 6", False, k < p) for p in (2, 3) for k in range(4)]
    shape = "problem_id long, sample_idx int, completion string, truncated boolean, correct boolean"
    split = spark.createDataFrame([(2, 5, 2), (3, 5, None)], "problem_id long, answer long, pass8 int")
    samples = spark.createDataFrame([*rows, (9, 0, "x", False, True)], shape)
    assert runs.tiering_samples(samples, split, 4).count() == 8
    for bad, message in [(rows[1:], "3 answers"), ([*rows[:-1], (3, 3, "Answer: 5", False, False)], "isn't as stored"), ([(2, 0, "Answer: 5", True, True), *rows[1:]], "isn't as stored"), ([(2, 0, "no 6", False, False), *rows[1:]], "pass8 is 2"), ([*rows[:-1], (3, 7, "Answer: 6", False, False)], "4 answers")]:
        with pytest.raises(ValueError, match=message):
            runs.tiering_samples(spark.createDataFrame(bad, shape), split, 4)


def test_rescoring_a_run(spark, tmp_path):
    import json

    from tallyforge.operators import caps

    rows = [{"problem_id": p, "completion": "Answer: 5", "correct": p == "a", "truncated": False, "n_tokens": 10 * k + 5, "extra": {"sample_idx": k, "answer": 6}} for p in "ab" for k in range(3)]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "samples.jsonl").write_text("".join(json.dumps(r) + "\n" for r in reversed(rows)))
    pools = [spark.createDataFrame([("a", 5), ("b", 4)], "problem_id string, answer long"), spark.createDataFrame([("b", 5)], "problem_id string, answer long")]
    found = caps.rescored_run(spark, str(tmp_path / "run"), str(tmp_path / "out"), pools, cap=20).first()
    assert (found["n"], found["accuracy_before"], found["changed"]) == (6, 0.5, 3)  # b's two short ones are right now, a's long one is cut
    out = [r for r in spark.read.json(str(tmp_path / "out" / "samples.jsonl")).collect()]
    assert sorted((r["problem_id"], r["extra"]["sample_idx"], r["correct"], r["truncated"]) for r in out) == [(p, k, k < 2, k == 2) for p in "ab" for k in range(3)]
    assert json.loads((tmp_path / "out" / "rescore.json").read_text())["n"] == 6
    with pytest.raises(FileExistsError):
        caps.rescored_run(spark, str(tmp_path / "run"), str(tmp_path / "out"), pools)
    samples = spark.createDataFrame([("z", "Answer: 5", False, None)], "problem_id string, completion string, truncated boolean, answer long")
    with pytest.raises(Exception, match="no answer is known of z"):
        caps.rescored(samples, pools[0], strict=True).collect()
    assert caps.rescored(samples, pools[0]).first()["correct"] is not True


def test_pool_configurations_and_regeneration(spark):
    config = generate.config_of({"seed": 5, "bands": {"S": [5, 9], "M": [10, 20]}, "filters": [1, 2], "transforms": [0, 1], "steps": [2, 3], "excluded": ["prime"]})
    assert config.bands == (("S", 5, 9), ("M", 10, 20)) and config.filters == (1, 2) and config.excluded == ("prime",) and config.lo_min == 1
    for bad in ({"colour": 1}, {"bands": {"S": [5, 12], "M": [10, 20]}}, {"excluded": ["odd one"]}):
        with pytest.raises(ValueError):
            generate.config_of(bad)
    made = generate.pool(spark, 12, config)[0].cache()
    assert generate.regenerated_diff(made, 12, config).count() == 0
    sides = {r["side"] for r in generate.regenerated_diff(made.where("answer <> 0 or true").limit(11), 12, config).collect()}
    assert sides == {"new"}


def test_tiering_violations_keep_bits_and_no_sets(spark):
    """Which answers are there is kept as bits, for more than 63 of them too, and problems are counted once."""
    split = spark.createDataFrame([(p, 7, 70) for p in range(5)], "problem_id long, answer long, pass8 int")
    rows = [(p, i, "Answer: 7", False, True) for p in range(4) for i in range(70)]
    rows = [r for r in rows if r[:2] != (1, 69)] + [(1, 68, "Answer: 7", False, True)]  # 1: one twice, one missing
    rows = [(2, None, *r[2:]) if r[:2] == (2, 5) else (3, 70, *r[2:]) if r[:2] == (3, 3) else r for r in rows]
    samples = spark.createDataFrame(rows, "problem_id long, sample_idx long, completion string, truncated boolean, correct boolean")
    found = runs.tiering_violations(samples, split, 70)
    assert sorted(r["message"] for r in found.collect()) == [*(f"{p}: 70 answers, not those of 0 to 69" for p in (1, 2, 3)), "4: 0 answers, not those of 0 to 69"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and plan.count("bit_or") == 2
