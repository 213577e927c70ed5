"""Rewards, and summaries of rounds, draws, rules and logs."""

from pyspark.sql import functions as F

from tallyforge.functions import intpipe, rewards
from tallyforge.operators import rollups as o
from tallyforge.operators import tiering as t
from tallyforge.sources.adapters import V_SAMPLES, samples, table

from .catalogue import query
from .metrics_queries import S, r, tiered_samples
from .text_queries import KNOWN, completions


@query("rewards", f"""SELECT l_linenumber, sum((l_linenumber <> 7 AND l_suppkey % 4 <> 0)::INT)::DOUBLE AS binary, sum((l_linenumber NOT IN (6, 7))::INT)::DOUBLE AS formatted,
    sum((('0x' || substr(sha256('5:' || l_orderkey || ':' || l_partkey), 1, 12))::BIGINT % 2 = 1)::INT)::DOUBLE AS random, sum((l_quantity >= 40)::INT)::BIGINT AS cut FROM lineitem GROUP BY 1""")
def reward_sums(spark, d):
    c = completions(spark, d).withColumn("answer", F.col("known") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0))
    text, cut = F.col("completion"), F.col("truncated")
    out = c.groupBy("l_linenumber").agg(F.sum(rewards.binary(text, F.col("answer"), cut)).alias("binary"), F.sum(rewards.formatted(text, cut)).alias("formatted"), F.sum(rewards.random(5, F.col("l_orderkey"), F.col("l_partkey"))).alias("random"))
    over = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(rewards.was_cut(F.col("l_quantity"), 40)).alias("cut"))
    return out.join(over, "l_linenumber")


@query("rounds_rollup", f"WITH s AS ({V_SAMPLES}), k AS (SELECT seed, sample_idx % 4 AS rnd, count(*) AS completions, sum(n_tokens) AS tokens FROM s GROUP BY ALL) SELECT seed, count(*) AS rounds, sum(completions)::BIGINT AS completions, sum(tokens)::BIGINT AS tokens, max(tokens)::BIGINT AS most_tokens FROM k GROUP BY seed")
def rounds_rollup(spark, d):
    rounds = samples(spark, d).groupBy("seed", (F.col("sample_idx") % 4).alias("round")).agg(F.count("*").alias("completions"), F.sum("n_tokens").alias("tokens"))
    return o.rounds_rollup(rounds, ["completions", "tokens"], ["tokens"])


@query("kept_of_round", f"WITH s AS ({V_SAMPLES}), k AS (SELECT DISTINCT problem_id, completion FROM s WHERE sample_idx < 2 AND correct) SELECT arm, count(*) AS n FROM s JOIN k USING (problem_id, completion) WHERE sample_idx >= 2 GROUP BY arm")
def kept_of_round(spark, d):
    s = samples(spark, d)
    return o.kept_of_round(s.where("sample_idx >= 2"), s.where("sample_idx < 2 and correct")).groupBy("arm").agg(F.count("*").alias("n"))


@query("steps_of_scores", "SELECT total_steps, count(*) AS n FROM (SELECT coalesce(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 5)::INT END, -1) AS total_steps FROM customer) GROUP BY 1")
def steps_of_scores(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("problem_id"), F.col("c_acctbal").alias("score"))
    known = c.where("problem_id % 3 > 0").select("problem_id", (F.col("problem_id") % 5).cast("int").alias("total_steps"))
    return o.with_steps(c, known).groupBy("total_steps").agg(F.count("*").alias("n"))


@query("owned_draws", f"WITH s AS ({V_SAMPLES}) SELECT count(*) AS answers, count(DISTINCT problem_id) AS problems FROM s WHERE problem_id % 7 = 2 AND sample_idx < 32")
def owned_draws(spark, d):
    s = samples(spark, d)
    return o.owned_draws(s.where("sample_idx < 32"), s.where("problem_id % 7 = 2"))


REASONS = "SELECT l_shipmode AS cell, reason FROM (SELECT l_returnflag AS l_shipmode, CASE WHEN l_linenumber < 6 THEN 'r' || (l_suppkey % 9) END AS reason FROM lineitem)"


def _reasons(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.when(F.col("l_linenumber") < 6, F.concat(F.lit("r"), (F.col("l_suppkey") % 9).cast("string"))).alias("reason"))


@query("common_reasons", f"WITH x AS ({REASONS}) SELECT reason, count(*) AS count FROM x WHERE reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def common_reasons(spark, d):
    return o.common_reasons(_reasons(spark, d), 4)


@query("reasons_rollup", f"WITH x AS ({REASONS}) SELECT cell, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ROLLUP (cell, reason)")
def reasons_rollup(spark, d):
    return o.reasons_rollup(_reasons(spark, d), ["cell"])


@query("first_examples", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS place FROM events) WHERE place <= 10")
def first_examples(spark, d):
    return o.first_examples(table(spark, d, "events"), "event_type", ["ts", "event_id"], 10).select("event_type", "event_id", "place")


@query("pass_histogram", f'WITH {S} SELECT k.r AS "right", count(p8.problem_id) AS problems FROM (SELECT unnest(range(9)) AS r) k LEFT JOIN p8 ON pass8 = k.r GROUP BY 1')
def pass_histogram(spark, d):
    return o.pass_histogram(samples(spark, d))


@query("selection_counters", f"""WITH {S}, a AS (SELECT s.*, tier FROM s JOIN tiers USING (problem_id)), k AS (SELECT tier, count(*) AS kept FROM (SELECT DISTINCT problem_id, completion, tier FROM a WHERE correct) GROUP BY ROLLUP (tier)),
    h AS (SELECT tier, count(DISTINCT problem_id) AS prompts, count(*) AS consumed, sum(correct::INT)::BIGINT AS correct FROM a GROUP BY ROLLUP (tier)) SELECT h.tier, prompts, prompts * 8 AS available, consumed, correct, coalesce(kept, 0) AS kept FROM h LEFT JOIN k ON h.tier IS NOT DISTINCT FROM k.tier""")
def selection_counters(spark, d):
    s = tiered_samples(spark, d)
    return o.selection_counters(s, s.where("correct").dropDuplicates(["problem_id", "completion"]), 8)


@query("pass8_changes", f"""WITH s AS ({V_SAMPLES}), a AS (SELECT problem_id, sum(correct::INT) AS a FROM s WHERE sample_idx < 8 AND problem_id % 10 <> 1 GROUP BY 1), b AS (SELECT problem_id, sum(correct::INT) AS b FROM s WHERE sample_idx BETWEEN 8 AND 15 GROUP BY 1),
    j AS (SELECT a, b, CASE WHEN a >= 6 THEN 2 WHEN a >= 2 THEN 1 ELSE 0 END AS x, CASE WHEN b >= 6 THEN 2 WHEN b >= 2 THEN 1 ELSE 0 END AS y FROM a FULL JOIN b USING (problem_id))
    SELECT count(*) AS problems, sum((a IS NULL OR b IS NULL)::INT)::BIGINT AS on_one_side, sum((a <> b)::INT)::BIGINT AS changed, sum((a IS NOT NULL AND b IS NOT NULL AND x <> y)::INT)::BIGINT AS changed_tier FROM j""")
def pass8_changes(spark, d):
    s = samples(spark, d)
    return o.pass8_changes(s.where("sample_idx < 8 and problem_id % 10 <> 1"), s.where("sample_idx between 8 and 15"))


@query("bucket_shares", """WITH b(k, bucket) AS (VALUES (0, 'answer_non_integer'), (1, 'truncated'), (2, 'answer_in_prose'), (3, 'no_answer_mention'), (4, 'parsed_by_current_rule')), c AS (SELECT bucket, count(*) AS n FROM lineitem JOIN b ON l_suppkey % 5 = k GROUP BY 1)
    SELECT bucket, n, round(n / sum(n) OVER (), 9) AS share, round(CASE WHEN bucket <> 'parsed_by_current_rule' THEN n / sum(n) FILTER (bucket <> 'parsed_by_current_rule') OVER () END, 9) AS share_of_failures FROM c""")
def bucket_shares(spark, d):
    k = (F.col("l_suppkey") % 5).cast("int")
    text = F.get(F.array(*map(F.lit, ("Answer: many", "cut off", "so the final answer is unclear", "hm", "it is 4"))), k)
    out = o.bucket_shares(table(spark, d, "lineitem").select(text.alias("completion"), (k == 1).alias("truncated")))
    return out.withColumns({"share": r("share"), "share_of_failures": r("share_of_failures")})


PREVIEWED = f"""x AS (SELECT l_orderkey AS problem_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_idx, {KNOWN} AS known, l_suppkey % 3 > 0 AS hit FROM lineitem)"""


@query("preview_rules", f"""WITH {PREVIEWED}, v AS (SELECT rule, problem_id, count(*) AS n, sum(list_contains(forms, l_linenumber)::INT) AS got, sum((list_contains(forms, l_linenumber) AND hit)::INT) AS ok FROM x, (VALUES ('strict', [1, 7]), ('boxed', [1, 3, 7]), ('prose', [1, 2, 3, 7])) f(rule, forms)
    WHERE sample_idx < 8 GROUP BY ALL) SELECT rule, count(*) AS problems, round(sum(got) / sum(n), 9) AS extraction_rate, round(avg(ok / n), 9) AS mean, sum((ok >= 6)::INT)::BIGINT AS easy, sum((ok BETWEEN 2 AND 5)::INT)::BIGINT AS medium, sum((ok < 2)::INT)::BIGINT AS hard,
    round(sum((ok BETWEEN 2 AND 5)::INT) * 6000 / count(*))::BIGINT AS medium_of_pool FROM v GROUP BY rule""")
def preview_rules(spark, d):
    """Texts in forms that each rule takes or leaves: an exact line, a sentence, a box, words without an integer."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a = F.expr(KNOWN)
    s, n = a.cast("string"), F.col("l_linenumber")
    text = F.when(n.isin(1, 7), F.concat(F.lit("so\nAnswer: "), s)).when(n == 2, F.concat(F.lit("Hence the answer is "), s, F.lit(" I think"))).when(n == 3, F.concat(F.lit("\\boxed{"), s, F.lit("}"))).otherwise("nothing found")
    placed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(order) - 1).alias("sample_idx"))
    rows = placed.select(F.col("l_orderkey").alias("problem_id"), "sample_idx", text.alias("completion"), (a + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)).alias("answer"))
    out = o.preview_rules(rows, ["strict", "boxed", "prose"], 6000)
    return out.select("rule", "problems", r("extraction_rate").alias("extraction_rate"), r("mean").alias("mean"), "easy", "medium", "hard", "medium_of_pool")


@query("compute_totals", """WITH x AS (SELECT 'r' || (p_partkey % 5) AS "group", CASE p_partkey % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'eval' ELSE 'other' END AS "column", CASE WHEN p_partkey % 11 > 0 THEN p_size END AS h FROM part)
    SELECT "group", "column", sum(h)::BIGINT AS hours, count(*) AS n FROM x WHERE h IS NOT NULL GROUP BY ROLLUP ("group", "column")""")
def compute_totals(spark, d):
    return o.compute_log(_records(spark, d))


@query("unmetered", "SELECT 'r' || (p_partkey % 5) AS \"group\", count(*) AS n FROM part WHERE p_partkey % 11 = 0 GROUP BY 1")
def unmetered(spark, d):
    return o.unmetered(_records(spark, d)).groupBy("group").agg(F.count("*").alias("n"))


def _records(spark, d):
    from tallyforge.operators.reports import classify_path

    k = F.col("p_partkey")
    path = F.concat(F.lit("r"), (k % 5).cast("string"), F.when(k % 3 == 0, "/sweep/a").when(k % 3 == 1, "/eval/b").otherwise("/c"))
    rows = table(spark, d, "part").select(path.alias("path"), F.when(k % 11 > 0, F.col("p_size")).alias("gpu_hours"))
    return rows.withColumn("at", classify_path()).select("path", "gpu_hours", "at.*")


LOGGED = f"l AS (SELECT arm, seed, extract(day FROM ts)::INT - 1 AS step, count(*)::DOUBLE AS n, avg(correct::INT) AS v FROM ({V_SAMPLES}) GROUP BY ALL)"
WEIGHTED = f"""{LOGGED}, w AS (SELECT arm, seed, step, CASE WHEN step = 0 THEN sum(CASE WHEN step > 0 THEN v * n END) OVER f / sum(CASE WHEN step > 0 THEN n END) OVER f ELSE sum(v * n) OVER b / sum(n) OVER b END AS windowed FROM l
    WINDOW b AS (PARTITION BY arm, seed ORDER BY step RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), f AS (PARTITION BY arm, seed ORDER BY step RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING))"""


def _logged(spark, d):
    return samples(spark, d).groupBy("arm", "seed", (F.dayofmonth("ts") - 1).alias("step")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col("correct").cast("double")).alias("v"))


@query("weighted_window", f"WITH {WEIGHTED} SELECT arm, seed, step, round(windowed, 9) AS windowed FROM w")
def weighted_window(spark, d):
    return o.weighted_window(_logged(spark, d), "step", "v", "n", by=["arm", "seed"]).select("arm", "seed", "step", r("windowed").alias("windowed"))


@query("grid_over_seeds", f"WITH {WEIGHTED} SELECT arm, step, round(max(windowed) FILTER (seed = 1), 9) AS first_seed, round(avg(windowed), 9) AS mean FROM w WHERE step IN (0, 10, 20) GROUP BY arm, step")
def grid_over_seeds(spark, d):
    w = o.weighted_window(_logged(spark, d), "step", "v", "n", by=["arm", "seed"])
    return o.grid_over_seeds(w, "step", [0, 10, 20]).withColumns({"first_seed": r("first_seed"), "mean": r("mean")})


@query("extremes", f"WITH s AS ({V_SAMPLES}), u AS (SELECT arm, seed, problem_id, avg(truncated::INT) AS rate FROM s WHERE problem_id % 3 = 0 GROUP BY ALL) SELECT round(max(rate), 9) AS truncation_rate FROM u")
def extremes(spark, d):
    from tallyforge.operators.integrity import extremes as found

    u = samples(spark, d).where("problem_id % 3 = 0").groupBy("arm", "seed", "problem_id").agg(F.avg(F.col("truncated").cast("double")).alias("truncation_rate"))
    return found(u, ["arm", "seed", "problem_id"]).select(r("truncation_rate").alias("truncation_rate"))


@query("pool_invariants")
def pool_invariants(spark, d):
    """Broken promises of a generated pool: none."""
    from tallyforge.operators import generate

    problems, _ = generate.pool(spark, 64)
    return o.invariants(intpipe.solved(problems.drop("answer")))


@query("tail_positions", "SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_partkey) - 1 AS position FROM part")
def tail_positions(spark, d):
    """Problems of other tiers alone, in order."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("x"), F.col("p_type")).alias("tier"))
    return t.interleave(rows, "p_partkey").select("p_partkey", "position")
