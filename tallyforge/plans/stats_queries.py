"""Seed summaries, contrasts, bounds, bootstrap, caps and rescoring."""

from pyspark.sql import functions as F

from tallyforge.operators import caps, stats
from tallyforge.sources.adapters import V_SAMPLES, samples, table

from .catalogue import query
from .metrics_queries import r

SC = f"s AS ({V_SAMPLES}), sc AS (SELECT arm, seed, problem_id, avg(correct::INT) AS score, avg(truncated::INT) AS truncated FROM s GROUP BY ALL), sm AS (SELECT arm, seed, avg(score) AS mean, count(*) AS n FROM sc GROUP BY ALL)"


def scores(spark, d):
    return samples(spark, d).groupBy("arm", "seed", "problem_id").agg(F.avg(F.col("correct").cast("double")).alias("score"), F.avg(F.col("truncated").cast("double")).alias("truncated"))


def rounded(df, *columns):
    return df.withColumns({c: r(c) for c in columns})


@query("seed_summary", f"WITH {SC} SELECT arm, count(*) AS n_seeds, round(avg(mean), 9) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(mean) END, 9) AS std, round(min(mean), 9) AS low, round(max(mean), 9) AS high FROM sm GROUP BY arm")
def seed_summary(spark, d):
    return rounded(stats.summarize(scores(spark, d)), "mean", "std", "low", "high")


CONTRAST = f"""WITH {SC}, j AS (SELECT x.seed, x.score AS a, y.score AS b FROM sc x JOIN sc y ON x.seed = y.seed AND x.problem_id = y.problem_id AND x.arm = 1 AND y.arm = 0),
    w AS (SELECT seed, avg(a - b) AS delta, avg(a) AS a, avg(b) AS b FROM j GROUP BY seed)
    SELECT count(*) AS n_seeds, round(avg(delta), 9) AS delta, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(delta) END, 9) AS delta_std, round(sqrt((var_samp(a) + var_samp(b)) / 2), 9) AS pooled_std,
           round(min(a), 9) AS a_low, round(max(a), 9) AS a_high, round(min(b), 9) AS b_low, round(max(b), 9) AS b_high, greatest(min(a), min(b)) <= least(max(a), max(b)) AS ranges_overlap FROM w"""


@query("paired_contrast", CONTRAST)
def paired_contrast(spark, d):
    return rounded(stats.paired_contrast(scores(spark, d), 1, 0), "delta", "delta_std", "pooled_std", "a_low", "a_high", "b_low", "b_high")


@query("single_baseline_contrast", f"""WITH {SC}, y AS (SELECT problem_id, score FROM sc WHERE arm = 0 AND seed = 1), w AS (SELECT x.seed, avg(x.score - y.score) AS delta FROM sc x JOIN y USING (problem_id) WHERE x.arm = 1 GROUP BY x.seed)
    SELECT count(*) AS n_seeds, round(avg(delta), 9) AS delta, round(stddev_samp(delta), 9) AS delta_std FROM w""")
def single_baseline_contrast(spark, d):
    one = scores(spark, d).where("arm = 1 or seed = 1")
    return rounded(stats.paired_contrast(one, 1, 0, single_baseline=True), "delta", "delta_std").select("n_seeds", "delta", "delta_std")


@query("criterion", f"WITH c AS ({CONTRAST}), o AS (SELECT avg(CASE WHEN arm = 1 THEN score ELSE -score END) AS other FROM (WITH {SC} SELECT * FROM sc WHERE problem_id % 2 = 0)) SELECT CASE WHEN pooled_std IS NOT NULL THEN abs(delta) > 2 * pooled_std AND sign(delta) = sign(other) AND delta <> 0 END AS met FROM c, o")
def criterion(spark, d):
    c = rounded(stats.paired_contrast(scores(spark, d), 1, 0), "delta", "pooled_std")
    other = scores(spark, d).where("problem_id % 2 = 0").agg(F.avg(F.when(F.col("arm") == 1, F.col("score")).otherwise(-F.col("score"))).alias("other"))
    return c.crossJoin(F.broadcast(other)).select(stats.criterion(F.col("delta"), F.col("pooled_std"), F.col("other")).alias("met"))


@query("ratio", f"""WITH {SC}, w AS (SELECT seed, max(mean) FILTER (arm = 1) - max(mean) FILTER (arm = 0) AS top, max(mean) FILTER (arm = 1) AS bottom FROM sm GROUP BY seed)
    SELECT round(avg(top), 9) AS top, round(avg(bottom), 9) AS bottom, round(avg(top) / nullif(avg(bottom), 0), 9) AS ratio FROM w""")
def ratio(spark, d):
    zero = scores(spark, d).where("arm = 0").select(F.lit(2).cast("bigint").alias("arm"), "seed", "problem_id", F.lit(0.0).alias("score"), "truncated")
    return rounded(stats.ratio(scores(spark, d).unionByName(zero), (1, 0), (1, 2)), "top", "bottom", "ratio").select("top", "bottom", "ratio")


@query("truncation_bounds", f"""WITH {SC}, m AS (SELECT arm, avg(score) AS s, avg(truncated) AS t FROM sc GROUP BY arm), x AS (SELECT s AS sa, t AS ta FROM m WHERE arm = 1), y AS (SELECT s AS sb, t AS tb FROM m WHERE arm = 0)
    SELECT scenario, round(sa + ua * ta - sb - ub * tb, 9) AS delta FROM (VALUES ('as_scored', 0, 0), ('a_up', 1, 0), ('b_up', 0, 1), ('both_up', 1, 1)) g(scenario, ua, ub), x, y""")
def truncation_bounds(spark, d):
    return rounded(stats.truncation_bounds(scores(spark, d), 1, 0), "delta")


@query("rerun_compare", f"""WITH s AS ({V_SAMPLES}), a AS (SELECT * FROM s WHERE sample_idx % 2 = 0), b AS (SELECT problem_id, sample_idx - 1 AS sample_idx, correct, truncated, completion FROM s WHERE sample_idx % 2 = 1)
    SELECT count(*) AS n, sum((a.truncated AND b.correct)::INT)::BIGINT AS cut_to_right, sum((a.truncated AND b.truncated)::INT)::BIGINT AS still_cut, sum((a.completion = b.completion)::INT)::BIGINT AS same_text,
           sum((NOT a.correct AND b.correct)::INT)::BIGINT AS to_right, sum((a.correct AND NOT b.correct)::INT)::BIGINT AS to_wrong FROM a JOIN b USING (problem_id, sample_idx)""")
def rerun_compare(spark, d):
    s = samples(spark, d)
    return stats.rerun_comparison(s.where("sample_idx % 2 = 0"), s.where("sample_idx % 2 = 1").withColumn("sample_idx", F.col("sample_idx") - 1))


@query("bootstrap_native", f"""WITH {SC}, p AS (SELECT problem_id, avg(score) AS score FROM sc WHERE arm = 0 GROUP BY problem_id), v AS (SELECT row_number() OVER (ORDER BY problem_id) - 1 AS i, score FROM p), n AS (SELECT count(*) AS n FROM p),
    draws AS (SELECT t.b, ('0x' || substr(sha256('0:' || t.b || ':' || u.i), 1, 12))::BIGINT % n AS i FROM (SELECT unnest(range(200)) AS b) t, n, (SELECT i FROM v) u),
    m AS (SELECT b, avg(score) AS m FROM draws JOIN v USING (i) GROUP BY b)
    SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, count(*) AS resamples FROM m""")
def bootstrap_native(spark, d):
    one = stats.seed_averaged(scores(spark, d)).where("arm = 0").select("problem_id", "score")
    return rounded(stats.bootstrap_sql(one, 200), "low", "high")


@query("bootstrap_hashed")
def bootstrap_hashed(spark, d):
    return stats.bootstrap(stats.seed_averaged(scores(spark, d)), ["arm"])


@query("bootstrap_compat")
def bootstrap_compat(spark, d):
    return stats.bootstrap_numpy(stats.seed_averaged(scores(spark, d)), ["arm"])


LENGTHS = "SELECT l_returnflag || l_linestatus AS cell, floor(l_quantity * 60)::BIGINT AS n_tokens, l_discount >= 0.05 AS correct FROM lineitem"


def lengths(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cell"), F.floor(F.col("l_quantity") * 60).alias("n_tokens"), (F.col("l_discount") >= 0.05).alias("correct"))


CELLS = f"""WITH l AS ({LENGTHS}) SELECT cell, count(*) AS n, round(quantile_cont(n_tokens, 0.5), 6) AS p50, round(quantile_cont(n_tokens, 0.99), 6) AS p99, round(avg((n_tokens > 2048)::INT), 9) AS over_anchor,
    round(avg((n_tokens > 2900)::INT), 9) AS over_cap, greatest(2048, ceil(quantile_cont(n_tokens, 0.99) * 1.25 / 256)::BIGINT * 256)::BIGINT AS measured_cap FROM l WHERE correct GROUP BY cell"""


def _cells(spark, d):
    found = caps.cells(lengths(spark, d).where("correct"), "cell", 2048, 2900)
    return found.withColumns({"p50": r("p50", 6), "p99": r("p99", 6), "over_anchor": r("over_anchor"), "over_cap": r("over_cap")})


@query("cap_cells", CELLS)
def cap_cells(spark, d):
    return _cells(spark, d)


@query("cap_driving_cell", f"SELECT * FROM ({CELLS}) ORDER BY p99 DESC, cell LIMIT 1")
def cap_driving_cell(spark, d):
    return caps.driving_cell(_cells(spark, d), "cell")


@query("cap_violations", f"SELECT cell, over_cap FROM ({CELLS}) WHERE over_cap >= 0.01")
def cap_violations(spark, d):
    return caps.violations(_cells(spark, d)).select("cell", "over_cap")


@query("length_hist", f"""WITH l AS ({LENGTHS}) SELECT b.bin, coalesce(sum(correct::INT), 0)::BIGINT AS n_correct, coalesce(sum((NOT correct)::INT), 0)::BIGINT AS n_incorrect
    FROM (SELECT unnest(range(16)) AS bin) b LEFT JOIN l ON least(n_tokens // 256, 15) = b.bin GROUP BY b.bin""")
def length_hist(spark, d):
    return caps.length_histogram(lengths(spark, d), 256, 16)


CAPPED = f"WITH s AS ({V_SAMPLES}), c AS (SELECT *, n_tokens AS n0, correct AS c0 FROM s WHERE NOT (truncated AND n_tokens < 600))"


@query("rescore_cap", CAPPED + " SELECT sample_id, least(n_tokens, 600) AS n_tokens, truncated OR n_tokens > 600 AS truncated, correct AND n_tokens <= 600 AS correct, n0 AS original_n_tokens FROM c")
def rescore_cap(spark, d):
    s = samples(spark, d).where("not (truncated and n_tokens < 600)")
    return caps.under_cap(s, 600).select("sample_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), "truncated", "correct", "original_n_tokens")


@query("rescore_summary", CAPPED + """ SELECT count(*) AS n, round(avg(c0::INT), 9) AS accuracy_before, round(avg((correct AND n_tokens <= 600)::INT), 9) AS accuracy_after,
    sum((correct AND n_tokens > 600)::INT)::BIGINT AS changed, round(sum((n_tokens > 600)::INT) / count(*), 9) AS cut_share FROM c""")
def rescore_summary(spark, d):
    s = samples(spark, d).where("not (truncated and n_tokens < 600)")
    return rounded(caps.rescore_summary(caps.under_cap(s, 600)), "accuracy_before", "accuracy_after", "cut_share")
