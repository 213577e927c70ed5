"""Table diffs, sweeps, budgets, long and wide results, and streams."""

import uuid

from pyspark.sql import functions as F

from tallyforge.operators import metrics as m
from tallyforge.operators import reports as p
from tallyforge.sources.adapters import V_SAMPLES, samples, table
from tallyforge.sources.files import names, shared_folder, stored
from tallyforge.sources.ledger import Ledger
from tallyforge.streaming import attempts, history, logs

from .catalogue import query
from .metrics_queries import S, r

CHANGED = "CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"


@query("table_diff", f"WITH a AS (SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT o_orderkey, {CHANGED} AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0) SELECT *, 'old' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def table_diff(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = a.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", F.expr(CHANGED))
    return p.row_diff(a, b)


TEXTS = "a AS (SELECT o_orderkey AS id, o_orderpriority AS t FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '!' WHEN o_orderkey % 3 = 1 THEN 'x' || o_orderpriority ELSE o_orderpriority END AS t FROM orders)"


@query("sample_diff", f"WITH {TEXTS} SELECT CASE WHEN b.t IS NULL THEN 'only_a' WHEN a.t IS NULL THEN 'only_b' WHEN a.t = b.t THEN 'identical' WHEN starts_with(a.t, b.t) OR starts_with(b.t, a.t) THEN 'prefix' ELSE 'different' END AS kind, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1")
def sample_diff(spark, d):
    o = table(spark, d, "orders")
    k, t = F.col("o_orderkey"), F.col("o_orderpriority")
    b = o.select((k + F.when(k % 17 == 0, 10000000).otherwise(0)).alias("id"), F.when(k % 3 == 0, F.concat(t, F.lit("!"))).when(k % 3 == 1, F.concat(F.lit("x"), t)).otherwise(t).alias("completion"))
    return p.sample_diff(o.select(k.alias("id"), t.alias("completion")), b, ["id"])


ARMS = f"WITH s AS ({V_SAMPLES}) SELECT arm, seed, avg(correct::INT) AS accuracy, avg(truncated::INT) AS truncation, avg(n_tokens) AS tokens FROM s GROUP BY ALL"


def _arms(spark, d):
    return samples(spark, d).groupBy("arm", "seed").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("truncated").cast("double")).alias("truncation"), F.avg("n_tokens").alias("tokens"))


@query("flat_rows", f"SELECT arm, seed, metric, round(value, 9) AS value FROM (UNPIVOT ({ARMS}) ON accuracy, truncation, tokens INTO NAME metric VALUE value)")
def flat_rows(spark, d):
    return p.flat(_arms(spark, d), ["arm", "seed"], ["accuracy", "truncation", "tokens"]).withColumn("value", r("value"))


@query("summary_pivot", f"SELECT arm, round(max(accuracy) FILTER (seed = 1), 9) AS \"1\", round(max(accuracy) FILTER (seed = 2), 9) AS \"2\", round(max(accuracy) FILTER (seed = 3), 9) AS \"3\" FROM ({ARMS}) GROUP BY arm")
def summary_pivot(spark, d):
    rows = _arms(spark, d).select("arm", F.col("seed").cast("string").alias("seed"), r("accuracy").alias("accuracy"))
    return p.pivoted(rows, ["arm"], "seed", "accuracy", ["1", "2", "3"])


@query("budget_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def budget_rollup(spark, d):
    return p.budget_rollup(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("total", r("total", 2))


BUDGET = f"WITH s AS ({V_SAMPLES}), b AS (SELECT arm, count(DISTINCT problem_id) AS prompts, count(*) AS consumed, sum(n_tokens)::BIGINT AS tokens FROM s GROUP BY arm), l AS (UNPIVOT b ON prompts, consumed, tokens INTO NAME metric VALUE value)"


@query("budget_match", f"{BUDGET} SELECT x.arm AS arm_a, y.arm AS arm_b, metric, x.value::DOUBLE AS a, y.value::DOUBLE AS b, x.value = y.value AS equal, round(greatest(x.value, y.value) / nullif(least(x.value, y.value), 0), 9) AS ratio FROM l x JOIN l y USING (metric) WHERE x.arm < y.arm")
def budget_match(spark, d):
    b = samples(spark, d).groupBy("arm").agg(F.count_distinct("problem_id").alias("prompts"), F.count("*").alias("consumed"), F.sum("n_tokens").alias("tokens"))
    return p.budget_match(b, "arm", ["prompts", "consumed", "tokens"]).select("arm_a", "arm_b", "metric", "a", "b", "equal", r("ratio").alias("ratio"))


SWEEP = "SELECT p_brand AS arm, (p_size % 5 + 1) / 100000.0 AS learning_rate, p_size % 3 + 1 AS epochs, p_retailprice AS val_accuracy FROM part"


@query("sweep_choose", f"""WITH w AS ({SWEEP}), m AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY val_accuracy DESC, epochs, learning_rate) AS place, lead(val_accuracy) OVER (PARTITION BY arm ORDER BY val_accuracy DESC, epochs, learning_rate) AS runner_up,
    min(val_accuracy) OVER p AS worst, learning_rate IN (min(learning_rate) OVER p, max(learning_rate) OVER p) AS rate_at_edge, epochs IN (min(epochs) OVER p, max(epochs) OVER p) AS epochs_at_edge FROM w WINDOW p AS (PARTITION BY arm))
    SELECT arm, val_accuracy, runner_up, worst, rate_at_edge, epochs_at_edge FROM m WHERE place = 1""")
def sweep_choose(spark, d):
    size = F.col("p_size")
    w = table(spark, d, "part").select(F.col("p_brand").alias("arm"), ((size % 5 + 1) / 100000.0).alias("learning_rate"), (size % 3 + 1).alias("epochs"), F.col("p_retailprice").alias("val_accuracy"))
    return p.best_of_sweep(w).select("arm", "val_accuracy", "runner_up", "worst", "rate_at_edge", "epochs_at_edge")


@query("bottom_rates", f"WITH {S} SELECT problem_id, round(score, 9) AS score FROM pp ORDER BY score, problem_id LIMIT 3")
def bottom_rates(spark, d):
    return p.bottom(m.per_problem(samples(spark, d)).select("problem_id", r("score").alias("score")), "score", 3, "problem_id")


@query("hashed_sample", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(sha256('5:' || event_id), 1, 12))::BIGINT, event_id) AS k FROM events) WHERE k <= 5")
def hashed_sample(spark, d):
    return p.hashed_sample(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 5, seed=5)


@query("compute_log", "SELECT 'r' || (p_partkey % 5) AS \"group\", CASE p_partkey % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'eval' ELSE 'other' END AS \"column\", sum(p_size)::BIGINT AS hours, count(*) AS n FROM part GROUP BY 1, 2")
def compute_log(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("r"), (k % 5).cast("string"), F.when(k % 3 == 0, "/sweep/a").when(k % 3 == 1, "/eval/b").otherwise("/c"))
    rows = table(spark, d, "part").select(path.alias("path"), "p_size").withColumn("at", p.classify_path())
    return rows.groupBy(F.col("at.group").alias("group"), F.col("at.column").alias("column")).agg(F.sum("p_size").alias("hours"), F.count("*").alias("n"))


@query("eval_plan", "SELECT n_name AS model, r_name AS split, d AS decoding FROM nation, region, (VALUES ('greedy'), ('mean8')) v(d) WHERE NOT (d = 'mean8' AND n_nationkey % 2 = 0)")
def eval_plan(spark, d):
    n, g = table(spark, d, "nation").select(F.col("n_name").alias("model"), "n_nationkey"), table(spark, d, "region").select(F.col("r_name").alias("split"))
    grid = p.expected_grid(n, g, spark.sql("SELECT explode(array('greedy', 'mean8')) AS decoding"))
    return grid.where("not (decoding = 'mean8' and n_nationkey % 2 = 0)").select("model", "split", "decoding")


@query("set_differences", "SELECT 'only_a' AS side, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) AS n UNION ALL SELECT 'only_b', (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0))")
def set_differences(spark, d):
    o = table(spark, d, "orders")
    return p.symmetric_difference(o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 2 = 1").select("o_custkey"))


@query("curves_by_step", "SELECT day AS step, max(c) FILTER (k = 0) AS a, max(c) FILTER (k = 1) AS b FROM (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS day, event_id % 2 AS k, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY day")
def curves_by_step(spark, d):
    days = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("step"), (F.col("event_id") % 2).alias("k")).agg(F.count("*").alias("c"))
    return p.outer_on_step({"a": days.where("k = 0"), "b": days.where("k = 1")}, "step", "c")


def _reward_files(spark, d):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = samples(spark, d).select((F.col("sample_idx") % 20).cast("int").alias("step"), F.col("problem_id").cast("string").alias("problem_id"), F.col("correct").cast("double").alias("reward"), "correct", F.col("n_tokens").cast("int").alias("n_tokens"), "truncated")
    rows.write.mode("overwrite").json(folder)
    return folder


@query("stream_step_stats", f"WITH s AS ({V_SAMPLES}) SELECT (sample_idx % 20)::INT AS step, count(*) AS n, round(avg(correct::INT), 9) AS reward_mean, sum(correct::INT)::BIGINT AS n_correct FROM s GROUP BY 1")
def stream_step_stats(spark, d):
    stream = logs.step_stats(logs.reward_stream(spark, _reward_files(spark, d)))
    return logs.run_to_memory(stream, "tallyforge_step_stats", "complete").withColumn("reward_mean", r("reward_mean"))


HISTORY = f"""WITH s AS ({V_SAMPLES}), l AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx DESC) AS back FROM s), c AS (SELECT problem_id, count(*) AS n, sum(correct::INT)::BIGINT AS s FROM l WHERE back <= 32 GROUP BY problem_id)
    SELECT problem_id, n, s FROM c WHERE s > 0 AND s < n"""


def _in_batches(spark, rows, batch, file_rows=100_000):
    """``rows`` as a stream that gives the files of one value of ``batch`` at a time, in order. ``rows`` are computed once; batches have equally many
    files, about one for each ``file_rows`` of the smallest, so a larger table is written by more tasks."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stored(rows.withColumn("batch", batch))
    sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}
    each = max(1, min(sizes.get(k, 0) for k in range(3)) // file_rows)  # rows are dealt in turn, so none of these files is empty
    for k in range(3):
        rows.where(F.col("batch") == k).drop("batch").repartition(each).write.mode("append").json(folder)
        if (n := sum(f.startswith("part-") for f in names(spark, folder))) != each * (k + 1):
            raise RuntimeError(f"{n} files, not {each} for each of {k + 1} batches")
    return spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", each).json(folder), folder


@query("stream_active_prompts", HISTORY)
def stream_active_prompts(spark, d):
    """Outcomes come in three batches out of order, so that late ones must find their places among the last 32."""
    outcomes = samples(spark, d).select("problem_id", F.col("sample_idx").cast("long").alias("step"), "correct")
    stream, folder = _in_batches(spark, outcomes, (F.col("step") * 7 + F.col("problem_id")) % 3)
    book = Ledger(spark, f"{folder}-ledger")
    with logs.state_store(spark):
        book.follow(history.pass_history(stream), f"{folder}-checkpoint", "update")
    return history.active(history.newest(book.read()))


@query("restarted_steps", f"""WITH s AS (SELECT arm, (sample_idx % 20)::INT AS step, correct, event_id % 3 AS b FROM (SELECT *, sample_id AS event_id FROM ({V_SAMPLES})))
    SELECT arm, step, count(*) AS n, round(avg(correct::INT), 9) AS reward_mean, sum(correct::INT)::BIGINT AS n_correct
    FROM s WHERE (step <= 4 AND b = 0) OR (step BETWEEN 5 AND 11 AND b = 1) OR (step > 11 AND b = 2) GROUP BY arm, step""")
def restarted_steps(spark, d):
    """Three attempts of each run write all steps; the second resumed from step 4, the third from step 11. All batches come twice."""
    attempt = F.col("sample_id") % 3
    rows = samples(spark, d).select("arm", (F.col("sample_idx") % 20).cast("int").alias("step"), attempt.alias("attempt"), F.when(attempt == 1, 4).when(attempt == 2, 11).otherwise(-1).alias("resumed_from"), F.col("correct").cast("double").alias("reward"), "correct")
    stream, folder = _in_batches(spark, rows, F.col("attempt"))
    book = attempts.step_ledger(spark, f"{folder}-ledger", ["arm"])
    for checkpoint in ("first", "again"):  # without its checkpoint a stream begins anew, at batch 0
        book.follow(stream, f"{folder}-{checkpoint}", each=lambda batch: attempts.step_sums(batch, ["arm"]))
    return attempts.step_stats(book, ["arm"]).withColumn("reward_mean", r("reward_mean"))
