"""Mechanical checks over grids and splits made of the driver's tables."""

from pyspark.sql import functions as F

from tallyforge.operators import checks as c
from tallyforge.operators import metrics as m
from tallyforge.sources.adapters import V_SAMPLES, samples, table

from .catalogue import query
from .metrics_queries import _built, _splits_sql


@query("protocol_identity", "SELECT 'one_protocol' AS \"check\", 'FAIL' AS severity, n_regionkey || '/nation_size: ' || string_agg(DISTINCT v, ', ' ORDER BY v) AS message FROM (SELECT n_regionkey, length(n_name)::VARCHAR AS v FROM nation) GROUP BY n_regionkey HAVING count(DISTINCT v) > 1")
def protocol_identity(spark, d):
    units = table(spark, d, "nation").select("n_regionkey", F.length("n_name").alias("nation_size"), F.lit(1).alias("version"))
    return c.single_valued(units, ["nation_size", "version"], by=["n_regionkey"])


@query("value_holders", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS holders FROM nation GROUP BY 1")
def value_holders(spark, d):
    return c.holders(table(spark, d, "nation"), "n_regionkey", "n_name").withColumn("holders", F.array_join("holders", ","))


@query("duplicate_keys", "SELECT 'duplicate_keys' AS \"check\", 'FAIL' AS severity, l_orderkey || '/' || l_linenumber || ': ' || count(*) || ' rows' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return c.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


GRID = "e AS (SELECT n_nationkey AS a, s AS b FROM nation, (SELECT unnest(range(3)) AS s)), p AS (SELECT * FROM e WHERE (a + b) % 7 <> 0), k AS (SELECT * FROM e WHERE a % 2 = 0)"


@query("missing_units", f"WITH {GRID}, gone AS (SELECT * FROM e EXCEPT SELECT * FROM p) SELECT 'units_present' AS \"check\", CASE WHEN a % 2 = 0 THEN 'note' ELSE 'FAIL' END AS severity, 'missing: ' || a || '/' || b AS message FROM gone")
def missing_units(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("a")).crossJoin(spark.range(3).withColumnRenamed("id", "b"))
    return c.units_present(e, e.where("(a + b) % 7 <> 0"), ["a", "b"], e.where("a % 2 = 0"))


@query("never_results", "SELECT 'never_results' AS \"check\", 'FAIL' AS severity, 'loaded: ' || p_name AS message FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'hot g')")
def never_results(spark, d):
    return c.paths_without(table(spark, d, "part"), ["ring", "hot g"], "p_name")


@query("excluded_topmost", "WITH p AS (SELECT DISTINCT 'r/' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/' || (p_partkey % 7) END AS path FROM part) SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))")
def excluded_topmost(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("r/"), (k % 40).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/"), (k % 7).cast("string"))))
    return c.topmost(table(spark, d, "part").select(path.alias("path")))


@query("stored_metrics", f"WITH s AS ({V_SAMPLES}), p AS (SELECT problem_id, avg(correct::INT) AS x FROM s GROUP BY problem_id) SELECT 'stored_equals_recomputed' AS \"check\", 'FAIL' AS severity, problem_id || ': ' || (x + 0.5) || ' is not ' || x AS message FROM p WHERE problem_id % 10 = 3")
def stored_metrics(spark, d):
    now = m.per_problem(samples(spark, d)).select("problem_id", "score")
    stored = now.withColumn("score", F.col("score") + F.when(F.col("problem_id") % 10 == 3, 0.5).otherwise(0.0))
    return c.equal_values(stored, now, ["problem_id"], "score")


@query("splits_disjoint", f"WITH b AS ({_splits_sql()}) SELECT 'splits_disjoint' AS \"check\", 'FAIL' AS severity, x.split || ' and ' || y.split || ' share ' || count(DISTINCT x.problem_id) || ' of problem_id' AS message FROM (SELECT * FROM b UNION ALL SELECT problem_id, 'extra', tier, structure_id FROM b WHERE split = 'val') x JOIN (SELECT * FROM b UNION ALL SELECT problem_id, 'extra', tier, structure_id FROM b WHERE split = 'val') y ON x.problem_id = y.problem_id AND x.split < y.split GROUP BY x.split, y.split")
def splits_disjoint(spark, d):
    b = _built(spark, d)
    return c.disjoint(b.union(b.where("split = 'val'").withColumn("split", F.lit("extra")).select(*b.columns)), "problem_id")


@query("rate_limits", f"WITH s AS ({V_SAMPLES}), r AS (SELECT problem_id, avg(truncated::INT) AS rate FROM s GROUP BY 1) SELECT 'truncation' AS \"check\", 'note' AS severity, problem_id || ': rate ' || round(rate, 4) AS message FROM r WHERE rate > 0.25 AND problem_id % 2 = 0")
def rate_limits(spark, d):
    rates = m.per_problem(samples(spark, d)).select("problem_id", F.col("truncated_rate").alias("rate"))
    return c.rate_limits(rates, "problem_id", "rate", 0.25, "truncation", "note", excuse=F.col("problem_id") % 2 == 1)


@query("bernoulli_mean", "SELECT 'random_reward_mean' AS \"check\", 'FAIL' AS severity, k || ': ' || round(avg(x), 4) AS message FROM (SELECT l_linenumber AS k, (l_discount > CASE WHEN l_linenumber < 4 THEN 0.045 ELSE 0.025 END)::INT::DOUBLE AS x FROM lineitem) GROUP BY k HAVING NOT avg(x) BETWEEN 0.4 AND 0.6")
def bernoulli_mean(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") > F.when(F.col("l_linenumber") < 4, 0.045).otherwise(0.025)).cast("double").alias("reward"))
    return c.bernoulli_mean(rows, "l_linenumber")


@query("outputs_differ", f"WITH s AS ({V_SAMPLES}), j AS (SELECT arm, (problem_id % (CASE WHEN arm = 1 THEN 23 ELSE 2 END) = 0)::INT AS x FROM s) SELECT 'outputs_differ' AS \"check\", 'FAIL' AS severity, 'share that differs: ' || round(avg(x), 4) AS message FROM j GROUP BY arm HAVING avg(x) < 0.1")
def outputs_differ(spark, d):
    """The adapter of arm 1 changes hardly any text, that of arm 0 half of them."""
    s = samples(spark, d).select("arm", "problem_id", "sample_idx", "completion")
    changed = s.withColumn("completion", F.when(F.col("problem_id") % F.when(F.col("arm") == 1, 23).otherwise(2) == 0, F.concat("completion", F.lit("!"))).otherwise(F.col("completion")))
    found = [c.outputs_differ(s.where(F.col("arm") == arm), changed.where(F.col("arm") == arm), ["problem_id", "sample_idx"]) for arm in (0, 1)]
    return found[0].unionByName(found[1])


@query("required_fields", "SELECT 'required_fields' AS \"check\", 'FAIL' AS severity, c_custkey || ': balance' AS message FROM customer WHERE c_acctbal < 0")
def required_fields(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return c.required(rows, "c_custkey", ["c_name", "balance"])


@query("selection_on_val", "SELECT 'selection_on_val_only' AS \"check\", 'FAIL' AS severity, p_brand || ': chosen on test' AS message FROM part WHERE p_partkey % 50 = 0")
def selection_on_val(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("arm"), F.when(F.col("p_partkey") % 50 == 0, "test").otherwise("val").alias("selection_split"))
    return c.chosen_on(rows)


@query("prompt_digests", "SELECT n_regionkey, sha256(string_agg(n_nationkey || chr(0) || n_name || chr(1), '' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def prompt_digests(spark, d):
    from tallyforge.operators.reports import prompt_digest

    return prompt_digest(table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("problem_id"), F.col("n_name").alias("prompt")), ["n_regionkey"])


@query("id_digests", "SELECT n_regionkey, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def id_digests(spark, d):
    from tallyforge.operators.reports import id_digest

    return id_digest(table(spark, d, "nation"), ["n_regionkey"], "n_name", "n_nationkey")
