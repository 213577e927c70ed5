"""Training-log windows, advantages and losses."""

from pyspark.sql import functions as F

from tallyforge.operators import dynamics as y
from tallyforge.sources.adapters import V_SAMPLES, samples, table

from .catalogue import query
from .metrics_queries import r

V_LOG = f"log AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS day, avg(correct::INT) AS reward_mean, avg(n_tokens) AS length, count(*) AS n FROM ({V_SAMPLES}) GROUP BY 1), st AS (SELECT day - min(day) OVER () AS step, reward_mean, length, n FROM log)"


def log(spark, d):
    days = samples(spark, d).groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.avg(F.col("correct").cast("double")).alias("reward_mean"), F.avg("n_tokens").alias("length"), F.count("*").alias("n"))
    first = days.agg(F.min("day").alias("first"))
    return days.crossJoin(F.broadcast(first)).select((F.col("day") - F.col("first")).cast("bigint").alias("step"), "reward_mean", "length", "n")


GROUPS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_discount >= 0.05)::INT::DOUBLE AS reward FROM lineitem"


def groups(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_discount") >= 0.05).cast("double").alias("reward"))


@query("group_advantages", f"""WITH g AS ({GROUPS}), w AS (SELECT *, avg(reward) OVER p AS m, coalesce(stddev_samp(reward) OVER p, 0) AS s, max(reward) OVER p = min(reward) OVER p AS flat FROM g WINDOW p AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN flat THEN 0 ELSE (reward - m) / (CASE WHEN s < 1e-6 THEN 1 ELSE s END + 1e-6) END, 8) AS advantage FROM w""")
def group_advantages(spark, d):
    return y.advantages(groups(spark, d), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", r("advantage", 8).alias("advantage"))


@query("zero_std_groups", f"""WITH s AS ({V_SAMPLES}), c AS (SELECT arm, (row_number() OVER (PARTITION BY arm ORDER BY ts, sample_id) - 1) // 8 AS chunk, correct::INT::DOUBLE AS reward FROM s),
    k AS (SELECT arm, chunk, count(*) AS n, sum(reward) AS total, max(reward) = min(reward) AS flat FROM c GROUP BY ALL)
    SELECT arm, round(sum(total) / sum(n), 9) AS reward_mean, sum(n)::BIGINT AS n, round(coalesce(avg(flat::INT) FILTER (n = 8), 0), 9) AS zero_std_share FROM k GROUP BY arm""")
def zero_std_groups(spark, d):
    s = samples(spark, d).withColumn("reward", F.col("correct").cast("double"))
    return y.zero_std_groups(s, "arm", ["ts", "sample_id"], 8).select("arm", r("reward_mean").alias("reward_mean"), "n", r("zero_std_share").alias("zero_std_share"))


@query("rolling_25", f"WITH {V_LOG} SELECT step, round(sum(reward_mean * n) OVER w / nullif(sum(n) OVER w, 0), 9) AS trailing FROM st WINDOW w AS (ORDER BY step ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)")
def rolling_25(spark, d):
    return y.trailing_mean(log(spark, d), "step", "reward_mean", "n").select("step", r("trailing").alias("trailing"))


WIN10 = f"WITH {V_LOG} SELECT step, round(CASE WHEN step = 0 THEN avg(reward_mean) FILTER (step > 0) OVER (ORDER BY step RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING) ELSE avg(reward_mean) OVER (ORDER BY step RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) END, 9) AS windowed FROM st"


@query("window_10", WIN10)
def window_10(spark, d):
    return y.step_window(log(spark, d), "step", "reward_mean").select("step", r("windowed").alias("windowed"))


@query("lowest_window", f"SELECT min(windowed) AS lowest FROM ({WIN10}) WHERE step >= 10")
def lowest_window(spark, d):
    return y.lowest_window(log(spark, d), "step", "reward_mean").select(r("lowest").alias("lowest"))


@query("dynamics_grid", f"SELECT max(windowed) FILTER (step = 0) AS step_0, max(windowed) FILTER (step = 10) AS step_10, max(windowed) FILTER (step = 20) AS step_20 FROM ({WIN10})")
def dynamics_grid(spark, d):
    return y.grid(log(spark, d), "step", "reward_mean", [0, 10, 20]).select(*[r(f"step_{s}").alias(f"step_{s}") for s in (0, 10, 20)])


@query("active_prompts", f"""WITH s AS ({V_SAMPLES}), l AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx DESC) AS back FROM s), c AS (SELECT problem_id, count(*) AS n, sum(correct::INT)::BIGINT AS s FROM l WHERE back <= 32 GROUP BY problem_id)
    SELECT problem_id, n, s FROM c WHERE s > 0 AND s < n""")
def active_prompts(spark, d):
    return y.active_prompts(samples(spark, d), ["sample_idx"])


@query("cumulative_steps", f"WITH {V_LOG} SELECT step, n, sum(n) OVER (ORDER BY step)::BIGINT AS cumulative_n FROM st")
def cumulative_steps(spark, d):
    return y.cumulative(log(spark, d), "step", ["n"])


@query("restart_flags", f"""WITH {V_LOG}, t AS (SELECT *, row_number() OVER (ORDER BY step) AS row FROM st), u AS (SELECT row, step, length FROM t UNION ALL SELECT row + 1000, step, length FROM t WHERE step >= 20),
    b AS (SELECT *, length < lag(length) OVER (ORDER BY row) AS back FROM u) SELECT count(*) - count(DISTINCT step) AS repeated_steps, sum(coalesce(back, false)::INT)::BIGINT AS clock_back FROM b""")
def restart_flags(spark, d):
    base = log(spark, d).withColumn("row", F.col("step") + 1)
    again = base.where("step >= 20").withColumn("row", F.col("row") + 1000)
    return y.restarts(base.unionByName(again), "step", "length")


@query("epoch_batches", "WITH o AS (SELECT n_nationkey, ('0x' || substr(sha256('3:1:' || n_nationkey), 1, 12))::BIGINT AS h FROM nation) SELECT n_nationkey, row_number() OVER (ORDER BY h, n_nationkey) - 1 AS place, (row_number() OVER (ORDER BY h, n_nationkey) - 1) // 4 AS batch FROM o")
def epoch_batches(spark, d):
    return y.epoch_order(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 3, 1, 4)


@query("curve_rises", f"WITH {V_LOG}, q AS (SELECT *, row_number() OVER (ORDER BY step) AS k, count(*) OVER () AS c FROM st) SELECT CASE WHEN max(c) >= 4 THEN avg(reward_mean) FILTER (k > c - c // 4) > avg(reward_mean) FILTER (k <= c // 4) END AS rises FROM q")
def curve_rises(spark, d):
    return y.curve_rises(log(spark, d), "step", "reward_mean")


@query("non_finite", "SELECT sum((NOT isfinite(x))::INT)::BIGINT AS x FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN 'inf'::DOUBLE ELSE l_tax END AS x FROM lineitem)")
def non_finite(spark, d):
    x = F.when(F.col("l_linenumber") == 7, float("nan")).when(F.col("l_linenumber") == 6, float("inf")).otherwise(F.col("l_tax"))
    return y.non_finite(table(spark, d, "lineitem").select(x.alias("x")), ["x"])


TOKENS = "SELECT l_orderkey AS sequence, -l_tax AS new, -l_discount AS old, -l_tax / 2 AS ref, l_discount - 0.05 AS advantage, (l_quantity::BIGINT % 2)::DOUBLE AS mask FROM lineitem"


@query("policy_loss", f"""WITH t AS ({TOKENS}), x AS (SELECT *, exp(new - old) AS q, exp(ref - new) - (ref - new) - 1 AS kl FROM t), y AS (SELECT *, least(q * advantage, greatest(least(q, 1.2), 0.8) * advantage) - 0.04 * kl AS gain FROM x)
    SELECT round(-sum(gain * mask) / greatest(sum(mask), 1), 8) AS loss, round(sum(q * mask) / greatest(sum(mask), 1), 8) AS mean_ratio, round(sum((abs(q - 1) > 0.2)::INT * mask) / greatest(sum(mask), 1), 8) AS clip_fraction,
           round(sum(kl * mask) / greatest(sum(mask), 1), 8) AS mean_kl, greatest(sum(mask), 1) AS n_tokens FROM y""")
def policy_loss(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence"), (-F.col("l_tax")).alias("new"), (-F.col("l_discount")).alias("old"), (-F.col("l_tax") / 2).alias("ref"), (F.col("l_discount") - 0.05).alias("advantage"), (F.col("l_quantity").cast("bigint") % 2).cast("double").alias("mask"))
    out = y.policy_loss(t, beta=0.04)
    return out.withColumns({c: r(c, 8) for c in ("loss", "mean_ratio", "clip_fraction", "mean_kl")})


@query("supervised_loss", f"WITH t AS ({TOKENS}) SELECT round(-sum(new * mask) / sum(mask), 8) AS loss FROM t")
def supervised_loss(spark, d):
    t = table(spark, d, "lineitem").select((-F.col("l_tax")).alias("logp"), (F.col("l_quantity").cast("bigint") % 2).cast("double").alias("mask"))
    return y.supervised_loss(t).select(r("loss", 8).alias("loss"))
