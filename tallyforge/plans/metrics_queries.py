"""Metrics, tiers, selection and splits over the events table read as graded answers."""

from pyspark.sql import functions as F

from tallyforge.functions.passk import pass_at_k
from tallyforge.operators import metrics as m
from tallyforge.operators import tiering as t
from tallyforge.sources.adapters import V_SAMPLES, samples

from .catalogue import query

TIER_SQL = "CASE WHEN pass8 >= 6 THEN 'easy' WHEN pass8 >= 2 THEN 'medium' ELSE 'hard' END"
S = f"""s AS ({V_SAMPLES}),
    p8 AS (SELECT problem_id, sum((correct AND sample_idx < 8)::INT)::BIGINT AS pass8 FROM s GROUP BY problem_id),
    tiers AS (SELECT problem_id, pass8, {TIER_SQL} AS tier FROM p8),
    pp AS (SELECT problem_id, count(*) AS n, sum(correct::INT)::BIGINT AS c, avg(correct::INT) AS score, sum(truncated::INT)::BIGINT AS cut, sum(n_tokens) AS tokens FROM s GROUP BY problem_id)"""
PASS = lambda n, c, k: f"CASE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1 - list_product(list_transform(range({k}), lambda i: ({n} - {c} - i)::DOUBLE / ({n} - i))) END"


def r(column, digits=9):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def tiered_samples(spark, d):
    s = samples(spark, d)
    return s.join(t.pass8(s).select("problem_id", t.tier_of(F.col("pass8")).alias("tier")), "problem_id")


@query("passk_by_group", f"WITH {S} SELECT problem_id, n, c, round(c / n, 9) AS pass_at_1, round({PASS('n', 'c', 8)}, 9) AS pass_at_8 FROM pp")
def passk_by_group(spark, d):
    counts = samples(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    return counts.select("problem_id", "n", "c", r(pass_at_k("n", "c", 1)).alias("pass_at_1"), r(pass_at_k("n", "c", 8)).alias("pass_at_8"))


@query("passk_curve", f"WITH {S}, k AS (SELECT unnest([1, 2, 4, 8, 16])::BIGINT AS k) SELECT k, round(avg({PASS('n', 'c', 'k')}), 9) AS pass_at_k FROM pp, k GROUP BY k")
def passk_curve(spark, d):
    ks = spark.sql("SELECT explode(array(1L, 2L, 4L, 8L, 16L)) AS k")
    return m.pass_curve(samples(spark, d), ks).select("k", r("pass_at_k").alias("pass_at_k"))


@query(
    "metrics_overall",
    f"""WITH {S} SELECT count(*) AS n_problems, sum(n)::BIGINT AS n_samples, round(avg(score), 9) AS accuracy, round(sum(cut) / sum(n), 9) AS truncation_rate,
    round(sum(tokens) / sum(n), 9) AS mean_tokens, CASE WHEN min(n) = max(n) THEN avg(score) END AS pass_at_1, CASE WHEN min(n) = max(n) THEN avg(score) END AS pass_at_8, sum(cut) / sum(n) > 0.05 AS over_5pct_truncated FROM pp""",
)
def metrics_overall(spark, d):
    out = m.metrics(samples(spark, d))
    return out.withColumns({c: r(c) for c in ("accuracy", "truncation_rate", "mean_tokens")})


@query(
    "metrics_arm_seed",
    f"""WITH s AS ({V_SAMPLES}), pp AS (SELECT arm, seed, problem_id, count(*) AS n, avg(correct::INT) AS score, sum(truncated::INT)::BIGINT AS cut, sum(n_tokens) AS tokens FROM s GROUP BY ALL)
    SELECT arm, seed, count(*) AS n_problems, sum(n)::BIGINT AS n_samples, round(avg(score), 9) AS accuracy, round(sum(cut) / sum(n), 9) AS truncation_rate, round(sum(tokens) / sum(n), 9) AS mean_tokens FROM pp GROUP BY arm, seed""",
)
def metrics_arm_seed(spark, d):
    out = m.metrics(samples(spark, d), ["arm", "seed"])
    return out.select("arm", "seed", "n_problems", "n_samples", *[r(c).alias(c) for c in ("accuracy", "truncation_rate", "mean_tokens")])


@query(
    "metrics_per_tier",
    f"""WITH {S} SELECT tier, count(*) AS n_problems, round(avg(score), 9) AS accuracy, round(sum(cut) / sum(n), 9) AS truncation_rate
    FROM pp JOIN tiers USING (problem_id) GROUP BY GROUPING SETS ((tier), ())""",
)
def metrics_per_tier(spark, d):
    return m.per_tier(tiered_samples(spark, d)).select("tier", "n_problems", r("accuracy").alias("accuracy"), r("truncation_rate").alias("truncation_rate"))


@query(
    "unit_audit",
    f"""WITH s AS ({V_SAMPLES}) SELECT arm, count(*) AS n_samples, array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds, sum((truncated AND correct)::INT)::BIGINT AS truncated_correct,
    round(sum((correct AND n_tokens > 2048)::INT) / nullif(sum(correct::INT), 0), 9) AS correct_over_2048 FROM s GROUP BY arm""",
)
def unit_audit(spark, d):
    return m.unit_audit(samples(spark, d), ["arm"]).withColumns({"correct_over_2048": r("correct_over_2048"), "seeds": F.array_join(F.col("seeds").cast("array<string>"), ",")})


@query("pass8_hist", f"WITH {S} SELECT b.k AS pass8, count(p8.problem_id) AS n_problems FROM (SELECT unnest(range(9)) AS k) b LEFT JOIN p8 ON pass8 = k GROUP BY k")
def pass8_hist(spark, d):
    return t.histogram(t.pass8(samples(spark, d)))


@query("tier_counts", f"WITH {S} SELECT tier, count(*) AS n_problems FROM tiers GROUP BY tier")
def tier_counts(spark, d):
    counts = t.pass8(samples(spark, d))
    problems = samples(spark, d).select("problem_id").distinct()
    return t.tiered(problems, counts, k=8).groupBy("tier").agg(F.count("*").alias("n_problems"))


@query("curated_problems", f"WITH {S} SELECT problem_id, pass8 FROM p8 WHERE pass8 BETWEEN 1 AND 7")
def curated_problems(spark, d):
    return t.curated(samples(spark, d))


RFT = "SELECT problem_id, sample_idx, completion FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, completion ORDER BY sample_idx) AS k FROM s WHERE correct) WHERE k = 1"


@query("rft_select_all", f"WITH {S} {RFT}")
def rft_select_all(spark, d):
    return t.rejection_select(samples(spark, d)).select("problem_id", "sample_idx", "completion")


@query(
    "rft_select_curated_cap",
    f"""WITH {S}, kept AS ({RFT}) SELECT problem_id, sample_idx, completion FROM (
        SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) AS nth FROM kept WHERE problem_id IN (SELECT problem_id FROM p8 WHERE pass8 BETWEEN 1 AND 7)) WHERE nth <= 4""",
)
def rft_select_curated_cap(spark, d):
    return t.rejection_select(samples(spark, d), only_curated=True, cap=4).select("problem_id", "sample_idx", "completion")


@query(
    "selection_budget",
    f"""WITH {S}, kept AS ({RFT}) SELECT count(DISTINCT problem_id) AS prompts, count(*) AS available, sum(correct::INT)::BIGINT AS correct,
    (SELECT count(*) FROM kept) AS kept, (SELECT count(DISTINCT problem_id) FROM kept) AS kept_prompts FROM s""",
)
def selection_budget(spark, d):
    s = samples(spark, d)
    return t.selection_budget(s, t.rejection_select(s))


@query(
    "interleave_splits",
    f"""WITH {S}, k AS (SELECT problem_id, tier, row_number() OVER (PARTITION BY tier ORDER BY problem_id) AS turn, CASE tier WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM tiers)
    SELECT problem_id, tier, row_number() OVER (ORDER BY turn, rank) - 1 AS position FROM k""",
)
def interleave_splits(spark, d):
    problems = t.tiered(samples(spark, d).select("problem_id").distinct(), t.pass8(samples(spark, d)))
    return t.interleave(problems.select("problem_id", "tier"), "problem_id")


WANTED = [("test", {"easy": 4, "medium": 8}), ("val", {"easy": 3, "medium": 6}), ("mixed", {"easy": 3, "medium": 6})]


def _splits_sql() -> str:
    ctes, used = [], []
    for i, (split, tier, n) in enumerate((s, x, n) for s, c in WANTED for x, n in c.items()):
        anti = " AND ".join(f"structure_id NOT IN (SELECT structure_id FROM u{j})" for j in used) or "true"
        ctes.append(f"u{i} AS (SELECT problem_id, '{split}' AS split, tier, structure_id FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY o, problem_id) AS k FROM pool WHERE tier = '{tier}' AND {anti}) WHERE k = 1 ORDER BY o, problem_id LIMIT {n})")
        used.append(i)
    pool = "pool AS (SELECT problem_id, problem_id // 2 AS structure_id, tier, ('0x' || substr(sha256('7:' || problem_id), 1, 12))::BIGINT AS o FROM tiers)"
    return f"WITH {S}, {pool}, {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT * FROM u{j}" for j in used)


def _built(spark, d):
    s = samples(spark, d)
    problems = t.tiered(s.select("problem_id", "structure_id").distinct(), t.pass8(s)).select("problem_id", "structure_id", "tier")
    return t.build_splits(problems, WANTED, seed=7)


@query("build_splits", _splits_sql())
def build_splits(spark, d):
    return _built(spark, d)


@query("split_overlap", f"WITH b0 AS ({_splits_sql()}), b AS (SELECT split, structure_id FROM b0 UNION ALL SELECT 'extra', structure_id FROM b0 WHERE structure_id % 3 = 0) SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.structure_id) AS shared FROM b a JOIN b ON a.structure_id = b.structure_id AND a.split < b.split GROUP BY ALL")
def split_overlap(spark, d):
    """Splits that share nothing, and one that takes structures of all of them."""
    b = _built(spark, d).select("split", "structure_id")
    return t.overlaps(b.union(b.where("structure_id % 3 = 0").select(F.lit("extra"), "structure_id")), "structure_id")


@query("split_subset", f"WITH {S}, cur AS (SELECT problem_id FROM p8 WHERE pass8 BETWEEN 1 AND 7) SELECT problem_id, pass8 FROM p8 WHERE problem_id NOT IN (SELECT problem_id FROM cur)")
def split_subset(spark, d):
    s = samples(spark, d)
    return t.not_subset(t.pass8(s).select("problem_id", "pass8"), t.curated(s))


@query("draw_merge", f"""WITH {S}, a AS (SELECT problem_id, sample_idx, completion FROM s WHERE arm = 0 AND sample_idx < 8), b AS (SELECT problem_id, sample_idx + 8 AS sample_idx, completion FROM s WHERE arm = 1 AND sample_idx < 8)
    SELECT u.problem_id, sample_idx, completion, tier, pass8 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u JOIN tiers USING (problem_id)""")
def draw_merge(spark, d):
    from tallyforge.operators.reports import draw_merge as merge

    s = samples(spark, d).where("sample_idx < 8")
    labels = t.pass8(samples(spark, d)).select("problem_id", "pass8", t.tier_of(F.col("pass8")).alias("tier"))
    part = lambda arm: s.where(F.col("arm") == arm).select("problem_id", "sample_idx", "completion", F.lit("").alias("tier"), F.lit(0).alias("pass8"))
    return merge(part(0), part(1), labels, 8).select("problem_id", "sample_idx", "completion", "tier", "pass8")
