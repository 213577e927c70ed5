"""Readers, writers and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import catalogue
from tallyforge.sources import digests, files, ledger
from tallyforge.streaming import attempts, history, logs


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"problem_id": "a", "answer": 3}\n\n{"problem_id": "b", "answer": 4}\n')
    assert files.read_problems(spark, str(path)).select("problem_id", "answer").collect() == [("a", 3), ("b", 4)]
    path.write_text('{"problem_id": "a", "colour": 3}\n')
    with pytest.raises(Exception, match="unknown fields: colour"):
        files.read_problems(spark, str(path)).collect()
    path.write_text('{"problem_id": "a", "answer": 3}\n{"problem_id": "a", "answer": "three"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot be parsed|parse"):
        files.read_problems(spark, str(path)).collect()
    path.write_text('{"problem_id": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot be parsed|parse"):
        files.read_problems(spark, str(path)).collect()
    plan = files.read_problems(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert files.read_rewards(spark, str(tmp_path / "missing.jsonl")).count() == 0


def test_splits_and_write_once(spark, tmp_path):
    for name in ("val", "test", "pool_tiered"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"problem_id": name}) + "\n")
    assert sorted(r["split"] for r in files.read_splits(spark, str(tmp_path)).collect()) == ["test", "val"]
    out = str(tmp_path / "once")
    files.write_once(spark.range(3), out)
    with pytest.raises(Exception, match="already exists"):
        files.write_once(spark.range(3), out)
    files.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_digests_and_logs(spark, tmp_path):
    (tmp_path / "sums").write_text("abc  x/y\n\ndef z w\n")
    assert [tuple(r) for r in files.read_checksums(spark, str(tmp_path / "sums")).collect()] == [("abc", "x/y"), ("def", "z w")]
    import hashlib

    assert files.file_digests(spark, str(tmp_path / "sums")).first()["sha256"] == hashlib.sha256((tmp_path / "sums").read_bytes()).hexdigest()
    (tmp_path / "log").write_text("t0 job a1 done exit=0 wall=12.5\nnoise\n")
    assert tuple(files.read_queue_log(spark, str(tmp_path / "log")).first()) == ("a1", 0, 12.5)


def test_pass_history_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, s, s % 3 == 0) for s in range(40)] + [(2, 0, True)], "problem_id long, step int, correct boolean")
    rows.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    out = {r["problem_id"]: (r["n"], r["right"]) for r in logs.run_to_memory(logs.pass_history(stream), "history", "update").collect()}
    assert out == {1: (32, sum(s % 3 == 0 for s in range(8, 40))), 2: (1, 1)}


def test_windowed_stream(spark, tmp_path):
    rows = spark.range(48).select((F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert logs.run_to_memory(logs.windowed_values(stream), "windows", "complete").agg(F.sum("n")).first()[0] == 48


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_history_puts_late_steps_in_place_and_lasts_over_a_restart(spark, tmp_path):
    rows = [{"problem_id": p, "step": s, "place": k, "correct": (s * 5 + k * 3 + p) % 4 > 1} for p in (1, 2) for s in range(30) for k in range(2)]
    late = [r for r in rows if r["step"] % 5 == 3]
    rest = [r for r in rows if r["step"] % 5 != 3]
    stream = lambda: spark.readStream.schema("problem_id long, step int, place int, correct boolean").json(str(tmp_path / "in"))
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    parts = [rest[40:], [*late, {"problem_id": 3, "step": 1, "place": 0, "correct": None}, {"problem_id": None, "step": 1}], [*rest[:40], *late[:4]]]
    for k, part in enumerate(parts):  # each a restart from the checkpoint; the last one repeats rows
        put(tmp_path / "in", f"{k}.json", part)
        with logs.state_store(spark):
            book.follow(history.pass_history(stream(), place="place"), str(tmp_path / "checkpoint"), "update")
    last = {p: [r["correct"] for r in rows if r["problem_id"] == p][-32:] for p in (1, 2)}
    found = history.newest(book.read())
    assert {r["problem_id"]: (r["n"], r["right"]) for r in found.collect()} == {1: (32, sum(last[1])), 2: (32, sum(last[2])), 3: (1, 0)}
    assert {r["problem_id"] for r in history.active(found).collect()} == {1, 2}


def test_batches_of_a_stream_have_many_files(spark, tmp_path):
    from tallyforge.plans import report_queries

    rows = spark.range(0, 1000, numPartitions=3).where("id % 3 < 2 or id < 600")
    stream, folder = report_queries._in_batches(spark, rows, F.col("id") % 3, file_rows=50)
    assert len([n for n in files.names(spark, folder) if n.startswith("part-")]) == 3 * 4
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    book.follow(stream, str(tmp_path / "c"), each=lambda b: b.groupBy((F.col("id") % 3).alias("batch")).agg(F.count("*").alias("n"), F.sum("id").alias("s")))
    want = [(k, len(ids), sum(ids)) for k in range(3) for ids in [[i for i in range(1000) if i % 3 == k and (k < 2 or i < 600)]]]
    assert sorted(map(tuple, book.read().collect())) == want and book.last() == 2


def test_ledger_counts_each_batch_once(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), most_folders=3)
    with pytest.raises(FileNotFoundError):
        book.read()
    for k in [0, 1, 1, 0, 2, 3, 4, 4, 5, 6, 3]:
        book.append(spark.range(k * 10, k * 10 + 10), k)
    assert sorted(r["id"] for r in book.read().collect()) == list(range(70)) and book.last() == 6
    # what a killed writer left isn't read, and goes by vacuum
    spark.range(5).write.parquet(str(tmp_path / "l" / "rows" / "left"))
    assert book.read().count() == 70
    assert book.vacuum(keep=1) > 0 and book.read().count() == 70 and book.vacuum(keep=1) == 0
    # of two writers of one number one fails
    with pytest.raises(FileExistsError):
        files.write_new(spark, book._manifest(6), "{}")
    assert book.read().count() == 70


def test_replayed_records_add_nothing(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"x": k} for k in range(5)])
    stream = lambda: spark.readStream.schema("x long").json(str(tmp_path / "in"))
    logs.append_records(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    put(tmp_path / "in", "b.json", [{"x": k} for k in range(5, 8)])
    book = logs.append_records(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r["x"] for r in book.read().collect()) == list(range(8))
    # the commit of the second batch is lost with the driver: it is run again from its offsets
    gone = list((tmp_path / "c" / "commits").glob("*1*"))
    assert gone
    for f in gone:
        f.unlink()
    book = logs.append_records(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "commits" / "1").exists()
    assert sorted(r["x"] for r in book.read().collect()) == list(range(8))


def test_steps_of_restarted_attempts(spark):
    rows = [(r, a, s, start, f"{r}{a}{s}") for r, a, start, steps in [("x", 0, -1, range(1, 8)), ("x", 2, 4, range(5, 7)), ("x", 1, 2, range(3, 6)), ("y", 0, None, range(1, 3)), ("y", 5, 0, [])] for s in steps]
    rows += [("y", 5, None, 0, "start"), ("z", 0, 0, -1, "z00")]
    log = spark.createDataFrame(rows, "run string, attempt int, step int, resumed_from int, what string")
    # y's fifth attempt began anew and has written nothing: nothing of y counts
    assert sorted(r["what"] for r in attempts.newest_attempts(log, ["run"]).collect()) == ["x01", "x02", "x13", "x14", "x25", "x26", "z00"]


def test_step_sums_are_merged(spark, tmp_path):
    book = attempts.step_ledger(spark, str(tmp_path / "l"), ["run"])
    book.most_folders = 2
    rows = [("x", 0, -1, s, 1.0, True) for s in range(4)]
    for k in range(4):
        more = [("x", 1, 1, s, 0.0, False) for s in (2, 3)] if k == 3 else []
        book.append(attempts.step_sums(spark.createDataFrame(rows + more, "run string, attempt int, resumed_from int, step int, reward double, correct boolean"), ["run"]), k)
    found = {r["step"]: (r["n"], r["reward_mean"], r["n_correct"]) for r in attempts.step_stats(book, ["run"]).collect()}
    assert found == {0: (4, 1.0, 4), 1: (4, 1.0, 4), 2: (1, 0.0, 0), 3: (1, 0.0, 0)}
    assert book.read().where("step = 0").count() < 4


def test_a_leaf_may_hold_any_number_of_lines(spark, tmp_path):
    """tree_digest's SQL has one leaf of all suppliers, more than FAN of them too."""
    n = digests.FAN + 900
    data = spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier "), (F.col("id") * 7 % n).cast("string")).alias("s_name"))
    data.repartition(5).write.parquet(str(tmp_path / "supplier.parquet"))
    want = "".join(hashlib.sha256(f"Supplier {k * 7 % n}".encode()).hexdigest() for k in range(n))
    for _ in range(digests.LEVELS):
        want = hashlib.sha256(want.encode()).hexdigest()
    assert [r["digest"] for r in catalogue.QUERIES["tree_digest"](spark, str(tmp_path)).collect()] == [want]
    (tmp_path / "ten.txt").write_text("\n".join("abcdefghij"))
    of = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    level = [of([c]) for c in "abcdefghij"]
    for _ in range(digests.LEVELS):
        level = [of(level[k : k + 3]) for k in range(0, len(level), 3)]
    assert [r["digest"] for r in digests.tree_digests(spark, [str(tmp_path / "ten.txt")], 3).collect()] == level
    rows = digests.line_digests(spark, [str(tmp_path / "ten.txt")]).select("path", F.floor(F.col("n") / 3).alias("up"), "n", "d")
    assert sorted(digests._in_turn(rows).collect()) == sorted(digests._collected(rows).collect())


def test_tree_digests_depend_on_the_lines_alone(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 37)}" for k in range(9000)]
    files_ = {"a": lines, "same": lines, "swapped": [lines[1], lines[0], *lines[2:]], "shorter": lines[:-1], "changed": [*lines[:4500], "line", *lines[4501:]], "blank": [*lines[:10], "", *lines[10:]], "empty": [], "one": ["line 0 "]}
    for name, text in files_.items():
        (tmp_path / name).write_text("".join(t + "\n" for t in text))
    paths = [str(tmp_path / n) for n in files_]
    by = lambda found: {r["path"].rsplit("/", 1)[1]: r["digest"] for r in found.collect()}
    first = by(digests.tree_digests(spark, paths))
    assert len(first) == len(files_) and first["a"] == first["same"] and len(set(first.values())) == len(files_) - 1
    # whatever the splits, and whatever else is read
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        assert by(digests.tree_digests(spark, paths)) == first
        assert by(digests.tree_digests(spark, paths[-1:])) == {"one": first["one"]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ledger_add_takes_the_next_free_number(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    assert book.is_empty() and book.add(spark.range(3)) == 0
    late = ledger.Ledger(spark, str(tmp_path / "l"))
    known, seen = late.last, iter([-1])
    late.last = lambda: next(seen, known())  # at first it hasn't seen the other's batch
    assert late.add(spark.range(3, 5)) == 1
    assert sorted(r["id"] for r in book.read().collect()) == list(range(5))
