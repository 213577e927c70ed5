"""Canonical tables derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each answer: events read as graded answers of problem ``user_id``."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("event_id").alias("sample_id"),
        F.col("user_id").alias("problem_id"),
        (F.row_number().over(order) - 1).alias("sample_idx"),
        (F.col("event_type") == "error").alias("truncated"),
        ((F.col("event_type") != "error") & (F.col("value") > F.when(F.col("user_id") % 2 == 0, 10).otherwise(45))).alias("correct"),
        F.floor(F.col("value") * 40).alias("n_tokens"),
        F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10).cast("string")).alias("completion"),
        (F.col("event_id") % 2).alias("arm"),
        (1 + F.floor(F.col("event_id") / 2) % 3).alias("seed"),
        F.floor(F.col("user_id") / 2).alias("structure_id"),
        "ts",
    )


V_SAMPLES = """
    SELECT event_id AS sample_id, user_id AS problem_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
           event_type = 'error' AS truncated,
           event_type <> 'error' AND value > CASE WHEN user_id % 2 = 0 THEN 10 ELSE 45 END AS correct,
           floor(value * 40)::BIGINT AS n_tokens, event_type || ':' || floor(value / 10)::BIGINT AS completion,
           event_id % 2 AS arm, 1 + (event_id // 2) % 3 AS seed, user_id // 2 AS structure_id, ts
    FROM events
"""
