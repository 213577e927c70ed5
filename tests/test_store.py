"""A store on disk: plan, guard, derived units kept by content, records, draws, transfer sets and tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import units as u
from tallyforge.sources import files, store


def answer(problem, k, right, tokens=10):
    return {"problem_id": problem, "tier": "easy", "prompt": f"q {problem}", "completion": f"Answer: {5 if right else 6}", "correct": right, "truncated": False, "extraction_failed": False, "n_tokens": tokens, "seed": 1, "config_hash": "h", "extra": {"sample_idx": k}}


SCHEMA = "problem_id string, tier string, prompt string, completion string, correct boolean, truncated boolean, extraction_failed boolean, n_tokens int, config_hash string, extra struct<sample_idx: int>"


@pytest.fixture()
def runs(tmp_path):
    root = tmp_path / "runs"
    for arm in ("a", "b"):
        for seed in (1, 2):
            for split in ("val", "test"):
                d = root / arm / f"s{seed}" / "eval" / split / "greedy"
                d.mkdir(parents=True)
                if (arm, seed, split) != ("b", 2, "test"):
                    (d / "samples.jsonl").write_text("".join(json.dumps(answer(p, k, (k + seed) % 2 == 0)) + "\n" for p in "xyz" for k in range(2)))
                    (d / "config.json").write_text(json.dumps({"split": split}))
    (root / "stray").mkdir()
    (root / "stray" / "samples.jsonl").write_text("not json")
    config = {"run_root": str(root), "seeds": [1, 2], "units": [["val", "greedy"], ["test", "greedy"]], "arms": {k: {"dir": f"{k}/s{{seed}}", "method": "rft"} for k in "ab"}, "never_results": [{"fragment": "/smoke/", "why": "a trial"}]}
    (tmp_path / "c.yaml").write_text("seeds: [1, 2]\nrun_root: elsewhere\nn_boot: 10\n")
    return tmp_path, config


def test_config(spark, runs):
    path, _ = runs
    pytest.importorskip("yaml")
    c = store.load_config(spark, str(path / "c.yaml"), run_root="here", out_dir=None)
    assert c == {"seeds": [1, 2], "run_root": "here", "n_boot": 10}
    assert store.config_hash(c) == store.config_hash(c | {"run_root": "there"}) != store.config_hash(c | {"n_boot": 11})
    assert store.slug("x/y-z") == "x__y-z" and store.subset_name("test_first100") == ("test", 100) and store.subset_name("val") == ("val", None)


def test_plan_and_guard(spark, runs):
    _, config = runs
    plan = store.unit_plan(spark, config)
    assert plan.count() == 8 and [tuple(r)[:4] for r in store.missing_units(plan).collect()] == [("b", 2, "test", "greedy")]
    bad = config | {"arms": {"t": {"dir": "smoke/s{seed}"}}}
    with pytest.raises(store.ExcludedPath, match="a trial"):
        store.unit_plan(spark, bad)


def test_units_are_derived_once(spark, runs, monkeypatch):
    path, config = runs
    plan = store.unit_plan(spark, config)
    flat = lambda s, p, schema=None: store_read(s, p, SCHEMA).withColumn("sample_idx", F.col("extra.sample_idx"))
    store_read = store.read_answers
    read = []
    monkeypatch.setattr(store, "read_answers", lambda s, p: read.append(p.count()) or flat(s, p))
    plain = store.derived_units(spark, plan)
    kept = str(path / "kept")
    columns = ["path", "problem_id", "n", "c", "score", "completion_sha"]
    want = sorted(map(tuple, plain.select(*columns).collect()))
    assert len(want) == 21 and sorted(map(tuple, store.derived_units(spark, plan, kept).select(*columns).collect())) == want
    assert sorted(map(tuple, store.derived_units(spark, plan, kept).select(*columns).collect())) == want and read == [8, 4]
    changed = path / "runs" / "a" / "s1" / "eval" / "val" / "greedy" / "samples.jsonl"
    changed.write_text(changed.read_text().replace('"correct": true', '"correct": false'))
    now = store.derived_units(spark, plan, kept)
    assert read == [8, 4, 1] and now.where(F.col("path").endswith("a/s1/eval/val/greedy")).agg(F.sum("c")).first()[0] == 0 and now.count() == 21
    assert u.unit_metrics(now, ["path"]).count() == 7


def test_records_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "run")
    digest = store.write_provenance(spark, folder, {"a": 1}, {"status": "finished"}, "as planned")
    assert json.loads(store.read_text(spark, f"{folder}/meta.json")) == {"status": "finished", "config_hash": digest} and store.parse(store.read_text(spark, f"{folder}/config.json")) == {"a": 1}
    with pytest.raises(Exception, match="exists"):
        store.write_provenance(spark, folder, {"a": 1}, {})


def test_draws(spark, tmp_path):
    draw = spark.createDataFrame([(p, k) for p in "ab" for k in range(3)], "problem_id string, sample_idx int")
    path = str(tmp_path / "draw")
    store.write_draw(draw, path, 3)
    assert sorted(map(tuple, store.read_draw(spark, path, 3, draw.schema).collect())) == sorted(map(tuple, draw.collect()))
    assert [r["sample_idx"] for r in spark.read.json(path).coalesce(1).collect()] == [0, 1, 2] * 2
    with pytest.raises(FileExistsError):
        store.write_draw(draw, path, 3)
    with pytest.raises(ValueError, match="whole draw"):
        store.write_draw(draw.where("not (problem_id = 'a' and sample_idx = 1)"), str(tmp_path / "other"), 3)


def test_transfer_sets(spark):
    rows = spark.createDataFrame([(k, f"q{k}", f"so\n#### {k},000") for k in range(5)], "idx int, question string, answer string")
    got = store.transfer_problems(rows, 3, "gsm").collect()
    assert [(r["problem_id"], r["answer"]) for r in sorted(got)] == [("gsm_00000", 0), ("gsm_00001", 1000), ("gsm_00002", 2000)]
    with pytest.raises(ValueError, match="9 are needed"):
        store.transfer_problems(rows, 9, "gsm")
    made = spark.createDataFrame([(1, "q", "12"), (2, "q", "x"), (3, "q", "-7")], "idx int, question string, answer string")
    assert sorted(r["answer"] for r in store.instance_problems(made, "gym").collect()) == [-7, 12]


def test_tables(spark, tmp_path):
    cells = spark.createDataFrame([("b", "m", [0.5, 1.0]), ("a", "m", [0.25])], "arm string, metric string, per_seed array<double>")
    store.write_tables({"arms": cells}, str(tmp_path))
    (f,) = (tmp_path / "arms").glob("part-*.csv")
    assert f.read_text() == 'arm,metric,per_seed\na,m,[0.25]\nb,m,"[0.5,1.0]"\n'
    with pytest.raises(ValueError, match="unknown"):
        store.write_tables({"x": cells}, str(tmp_path))
    files.write_jsonl_once(cells.select("arm"), str(tmp_path / "j"), ["arm"])
