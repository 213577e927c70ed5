"""Draws, rounds and run records over the events table and grids."""

from pyspark.sql import functions as F

from tallyforge.operators import runs, stats
from tallyforge.operators import tiering as t
from tallyforge.sources.adapters import V_SAMPLES, samples, table

from .catalogue import query
from .metrics_queries import RFT, S, r, tiered_samples
from .stats_queries import SC, scores


@query("draw_integrity", f"WITH s AS ({V_SAMPLES}), d AS (SELECT * FROM s WHERE sample_idx < 8 AND NOT (problem_id % 9 = 0 AND sample_idx = 3)) SELECT 'draw_integrity' AS \"check\", 'FAIL' AS severity, problem_id || ': ' || count(*) || ' answers' AS message FROM d GROUP BY problem_id HAVING count(*) <> 8 OR max(sample_idx) <> 7")
def draw_integrity(spark, d):
    return runs.draw_integrity(samples(spark, d).where("sample_idx < 8 and not (problem_id % 9 = 0 and sample_idx = 3)"), 8)


@query("draw_summary", f"WITH {S} SELECT tier, count(*) AS n, count(DISTINCT problem_id) AS problems, round(avg(correct::INT), 9) AS pass_rate, round(avg(truncated::INT), 9) AS truncation_rate FROM s JOIN tiers USING (problem_id) WHERE sample_idx < 8 GROUP BY GROUPING SETS ((tier), ())")
def draw_summary(spark, d):
    out = runs.draw_summary(tiered_samples(spark, d).where("sample_idx < 8"))
    return out.withColumns({c: r(c) for c in ("pass_rate", "truncation_rate")})


@query("round_diagnostics", f"""WITH {S}, kept AS ({RFT}), p AS (SELECT avg(score) AS pass_rate, sum((c = n)::INT)::BIGINT AS all_right, sum((c = 0)::INT)::BIGINT AS none_right FROM pp)
    SELECT round(pass_rate, 9) AS pass_rate, all_right, none_right, (SELECT sum(correct::INT)::BIGINT FROM s) AS "right", (SELECT round(count(DISTINCT (problem_id, completion)) / count(*), 9) FROM s) AS unique_share,
    (SELECT round(quantile_cont(n_tokens, 0.99), 6) FROM s) AS p99, (SELECT count(*) FROM kept) AS kept, round(1 - (SELECT count(*) FROM kept) / (SELECT sum(correct::INT) FROM s), 9) AS dedup_rate FROM p""")
def round_diagnostics(spark, d):
    s = samples(spark, d)
    out = runs.round_diagnostics(s, t.rejection_select(s))
    return out.withColumns({"pass_rate": r("pass_rate"), "unique_share": r("unique_share"), "p99": r("p99", 6), "dedup_rate": r("dedup_rate")})


@query("pool_cells", f"WITH s AS ({V_SAMPLES}), j AS (SELECT problem_id % 3 AS own, CASE WHEN problem_id % 7 <> 0 THEN problem_id % 3 + (problem_id % 5 = 0)::INT END AS cell FROM s) SELECT sum((cell IS NULL)::INT)::BIGINT AS missing, sum((own <> cell)::INT)::BIGINT AS disagree FROM j")
def pool_cells(spark, d):
    s = samples(spark, d).withColumn("cell", F.col("problem_id") % 3)
    pool = s.select("problem_id").distinct().where("problem_id % 7 <> 0").withColumn("cell", F.expr("problem_id % 3 + cast(problem_id % 5 = 0 as int)"))
    return runs.with_cells(s, pool)[1]


@query("id_sets_differ", "SELECT o_custkey AS problem_id, CASE WHEN a IS NULL THEN 'only_b' ELSE 'only_a' END AS side FROM (SELECT DISTINCT o_custkey, 1 AS a FROM orders WHERE o_orderkey % 2 = 0) x FULL JOIN (SELECT DISTINCT o_custkey, 1 AS b FROM orders WHERE o_orderkey % 2 = 1) y USING (o_custkey) WHERE a IS NULL OR b IS NULL")
def id_sets_differ(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("problem_id"))
    return runs.id_sets_differ(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


@query("locked_values", "SELECT n_name AS run, field, value, locked FROM (SELECT n_name, 'region' AS field, n_regionkey::VARCHAR AS value, '1' AS locked FROM nation UNION ALL SELECT n_name, 'size', length(n_name)::VARCHAR, '8' FROM nation) WHERE value <> locked")
def locked_values(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("run"), F.col("n_regionkey").alias("region"), F.length("n_name").alias("size"))
    return runs.locked_values(n, {"region": 1, "size": 8}, "run")


@query("last_checkpoint", "SELECT p_brand AS run, arg_max('c/' || p_brand || '/step-' || p_partkey, p_partkey) AS path, max(p_partkey) AS step FROM part GROUP BY p_brand")
def last_checkpoint(spark, d):
    paths = table(spark, d, "part").select(F.col("p_brand").alias("run"), F.concat(F.lit("c/"), F.col("p_brand"), F.lit("/step-"), F.col("p_partkey").cast("string")).alias("path"))
    return runs.last_checkpoint(paths, "run")


@query("bounds_identified", f"""WITH {SC}, m AS (SELECT seed, arm, avg(score) AS s, avg(truncated) AS t FROM sc GROUP BY ALL), w AS (SELECT x.seed, x.s AS sa, x.t AS ta, y.s AS sb, y.t AS tb FROM m x JOIN m y ON x.seed = y.seed AND x.arm = 1 AND y.arm = 0)
    SELECT seed, round(sa - sb - tb, 9) AS low, round(sa + ta - sb, 9) AS high, round(ta + tb, 9) AS width, sign(sa - sb - tb) = sign(sa + ta - sb) AS identified FROM w""")
def bounds_identified(spark, d):
    parts = [stats.truncation_bounds(scores(spark, d).where(F.col("seed") == s), 1, 0).withColumn("seed", F.lit(s).cast("bigint")) for s in (1, 2, 3)]
    out = runs.bounds_identified(parts[0].union(parts[1]).union(parts[2]), ["seed"])
    return out.withColumns({c: r(c) for c in ("low", "high", "width")})


@query("masked_summary", f"WITH {SC}, k AS (SELECT arm, seed, avg(score) AS mean FROM sc WHERE problem_id % 3 = 0 GROUP BY ALL) SELECT arm, count(*) AS n_seeds, round(avg(mean), 9) AS mean, round(stddev_samp(mean), 9) AS std, round(min(mean), 9) AS low, round(max(mean), 9) AS high FROM k GROUP BY arm")
def masked_summary(spark, d):
    out = runs.masked_summary(scores(spark, d), F.col("problem_id") % 3 == 0)
    return out.withColumns({c: r(c) for c in ("mean", "std", "low", "high")})


@query("selection_record", "WITH w AS (SELECT p_brand AS arm, p_size, p_retailprice AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS won FROM part) SELECT arm, count(*) AS tried, round(sum(CASE WHEN won THEN 0 ELSE h END), 4) AS other_gpu_hours FROM w GROUP BY arm")
def selection_record(spark, d):
    from pyspark.sql import Window

    w = table(spark, d, "part").select(F.col("p_brand").alias("arm"), F.col("p_partkey").alias("learning_rate"), F.lit(1).alias("epochs"), F.col("p_retailprice").alias("gpu_hours_actual"))
    best = w.withColumn("k", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("gpu_hours_actual"), "learning_rate"))).where("k = 1")
    return runs.selection_record(w.drop("gpu_hours_actual"), w, best).withColumn("other_gpu_hours", r("other_gpu_hours", 4))


@query("last_value_wins", "WITH u AS (SELECT n_regionkey AS k, n_nationkey AS v, 0 AS t FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey, r_regionkey + 100, 1 FROM region WHERE r_regionkey % 2 = 0) SELECT k, arg_max(v, t) AS v FROM (SELECT k, t, max(v) AS v FROM u GROUP BY k, t) GROUP BY k")
def last_value_wins(spark, d):
    a = table(spark, d, "nation").where("n_nationkey < 5").groupBy(F.col("n_regionkey").alias("k")).agg(F.max("n_nationkey").alias("v"))
    b = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") + 100).alias("v"))
    return runs.last_value_wins([a, b], "k", "v")


@query("unfinished_units", "SELECT n_name AS model, r_name AS split, 'greedy' AS decoding FROM nation, region WHERE NOT (n_nationkey % 3 = 0)")
def unfinished_units(spark, d):
    n, g = table(spark, d, "nation").select(F.col("n_name").alias("model"), "n_nationkey"), table(spark, d, "region").select(F.col("r_name").alias("split"))
    one = spark.sql("SELECT 'greedy' AS decoding")
    done = n.where("n_nationkey % 3 = 0").crossJoin(g).crossJoin(one)
    return runs.expected_units(n.select("model"), g, one, done, ["model", "split", "decoding"])
