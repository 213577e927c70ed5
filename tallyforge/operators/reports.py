"""Table comparison, sweeps, budgets and result shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_of_sweep(sweep: DataFrame, by: list[str] = ["arm"]) -> DataFrame:  # noqa: B006
    """Highest validation accuracy, then fewer epochs, then the lower learning rate; runner-up, worst, and grid-edge marks."""
    w = Window.partitionBy(*by).orderBy(F.desc("val_accuracy"), "epochs", "learning_rate")
    everything = Window.partitionBy(*by)
    marked = sweep.select(
        "*", F.row_number().over(w).alias("place"), F.lead("val_accuracy").over(w).alias("runner_up"), F.min("val_accuracy").over(everything).alias("worst"),
        ((F.col("learning_rate") == F.min("learning_rate").over(everything)) | (F.col("learning_rate") == F.max("learning_rate").over(everything))).alias("rate_at_edge"),
        ((F.col("epochs") == F.min("epochs").over(everything)) | (F.col("epochs") == F.max("epochs").over(everything))).alias("epochs_at_edge"),
    )
    return marked.where("place = 1").drop("place")


def row_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks (as sets), marked by side. Differing columns are an error."""
    if old.columns != new.columns:
        raise ValueError(f"headers differ: {old.columns} and {new.columns}")
    return old.subtract(new).withColumn("side", F.lit("old")).union(new.subtract(old).withColumn("side", F.lit("new")))


def sample_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs' texts by key: identical, one beginning with the other, different, or on one side alone."""
    j = a.select(*keys, F.col("completion").alias("a")).join(b.select(*keys, F.col("completion").alias("b")), keys, "full_outer")
    kind = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "identical").when(F.startswith("a", "b") | F.startswith("b", "a"), "prefix").otherwise("different")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def flat(table: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """A row for each id and metric."""
    return table.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, "metric", "value")


def pivoted(long: DataFrame, ids: list[str], key: str, value: str, columns: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot(key, columns).agg(F.first(value))


def budget_rollup(runs: DataFrame, group: str, column: str, value: str) -> DataFrame:
    """Totals by (group, column), by group and overall."""
    return runs.rollup(group, column).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def budget_match(budgets: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """For each pair of units and field: equal or not, and the larger over the smaller."""
    long = flat(budgets, [unit], fields)
    a, b = (long.select(F.col(unit).alias(f"{unit}_{s}"), "metric", F.col("value").alias(s)) for s in "ab")
    j = a.join(b, "metric").where(F.col(f"{unit}_a") < F.col(f"{unit}_b"))
    return j.withColumn("equal", F.col("a") == F.col("b")).withColumn("ratio", F.greatest("a", "b") / F.nullif(F.least("a", "b"), F.lit(0)))


def bottom(table: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return table.orderBy(column, tie).limit(n)


def hashed_sample(table: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, by a seeded hash of the key."""
    from tallyforge.functions.hashrng import sha_int

    w = Window.partitionBy(by).orderBy(sha_int(seed, F.col(key)), key)
    return table.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def classify_path(path: str = "path"):
    """(group, column) of a run directory by its parts."""
    parts = F.split(F.col(path), "/")
    kind = F.when(F.array_contains(parts, "sweep"), "sweep").when(F.array_contains(parts, "eval"), "eval").when(F.array_contains(parts, "train"), "train").otherwise("other")
    return F.struct(F.get(parts, F.lit(0)).alias("group"), kind.alias("column"))


def expected_grid(*axes: DataFrame) -> DataFrame:
    """The plan of all combinations of small axes."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def outer_on_step(curves: dict[str, DataFrame], step: str, value: str) -> DataFrame:
    """Curves side by side, a column each."""
    tagged = [df.select(step, F.lit(name).alias("curve"), F.col(value).alias("v")) for name, df in curves.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(step).pivot("curve", list(curves)).agg(F.first("v"))


def id_digest(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """SHA-256 of the ordered ids, each followed by a line end."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(key).cast("string").alias("id")))), lambda x: F.concat(x["id"], F.lit("\n")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(ids, ""), 256).alias("digest"))


def prompt_digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over (id, NUL, prompt, 0x01) in order of id."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("problem_id", "prompt"))), lambda x: F.concat(x["problem_id"].cast("string"), F.lit("\x00"), x["prompt"], F.lit("\x01")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(parts, ""), 256).alias("digest"))


def draw_merge(first: DataFrame, more: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """A problem's tiering answers, then new ones numbered on from ``k``; tier and pass8 come from the split's labels."""
    both = first.unionByName(more.withColumn("sample_idx", F.col("sample_idx") + k))
    return both.drop("tier", "pass8").join(labels.select("problem_id", "tier", "pass8"), "problem_id")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that one table has over the other: side, n."""
    return a.exceptAll(b).agg(F.lit("only_a").alias("side"), F.count("*").alias("n")).union(b.exceptAll(a).agg(F.lit("only_b").alias("side"), F.count("*").alias("n")))
