"""Every query with SQL agrees with DuckDB at the smallest scale."""

import pytest
from conftest import duck_rows, rows_of

from tallyforge.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_duckdb(spark, duck, name):
    assert rows_of(catalogue.QUERIES[name](spark, D)) == duck_rows(duck, catalogue.ORACLES[name])


def test_bootstrap_agrees_with_numpy(spark):
    import numpy as np

    from tallyforge.operators.stats import bootstrap_numpy

    values = [0.0, 0.25, 1.0, 0.5, 0.75]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "arm string, problem_id long, score double")
    got = bootstrap_numpy(df, ["arm"], resamples=200).first()
    rng = np.random.default_rng(0)
    means = [np.array(values)[rng.integers(0, 5, 5)].mean() for _ in range(200)]
    assert (got["low"], got["high"]) == tuple(np.quantile(means, [0.025, 0.975]))


def test_hashed_bootstrap_covers_the_mean(spark):
    out = catalogue.QUERIES["bootstrap_hashed"](spark, D).collect()
    assert len(out) == 2 and all(r["low"] <= r["mean"] <= r["high"] for r in out)


def test_pool_fills_every_cell(spark):
    problems = catalogue.QUERIES["problem_pool"](spark, D).collect()
    assert len(problems) == len({r["problem_id"] for r in problems}) == 64
    assert {(r["range_scale"], r["total_steps"]) for r in problems} == {(s, n) for s in "SM" for n in (2, 3, 4, 5)}
    assert all("{" not in r["text"] and "First, " in r["text"] for r in problems)
    account = catalogue.QUERIES["pool_account"](spark, D).collect()
    assert all(r["accepted"] == 8 <= r["attempts"] for r in account)


def test_whole_pool(spark):
    problems = catalogue.QUERIES["problem_pool_whole"](spark, D).select("problem_id", "range_scale", "total_steps").collect()
    assert len(problems) == len({r["problem_id"] for r in problems}) == 6000
    account = catalogue.QUERIES["pool_account_whole"](spark, D).collect()
    assert len(account) == 8 and all(r["accepted"] == 750 <= r["attempts"] for r in account)


def test_registered_bootstraps_take_all_resamples(spark):
    import numpy as np

    from tallyforge.operators import stats
    from tallyforge.plans import stats_queries

    scores = stats.seed_averaged(stats_queries.scores(spark, D)).toPandas().sort_values("problem_id")
    got = {r["arm"]: r for r in catalogue.QUERIES["bootstrap_compat"](spark, D).collect()}
    assert set(got) == set(scores.arm)
    for arm, part in scores.groupby("arm"):
        values, rng = part.score.to_numpy(float), np.random.default_rng(0)
        means = [values[rng.integers(0, len(values), len(values))].mean() for _ in range(10_000)]
        assert (got[arm]["low"], got[arm]["high"]) == tuple(np.quantile(means, [0.025, 0.975]))
    plan = catalogue.QUERIES["bootstrap_hashed"](spark, D)._jdf.queryExecution().logical().toString()
    assert "Range (0, 10000" in plan
