"""Streams over append-only logs: step statistics, windows, sinks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import schemas
from tallyforge.sources.ledger import Ledger

from .history import pass_history  # noqa: F401


def reward_stream(spark: SparkSession, folder: str, schema: str = schemas.REWARDS, most_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).json(folder)


def step_stats(rewards: DataFrame) -> DataFrame:
    """Number, mean reward and right answers of each step so far (complete or update mode)."""
    return rewards.groupBy("step").agg(F.count("*").alias("n"), F.avg("reward").alias("reward_mean"), F.count_if("correct").alias("n_correct"))


def windowed_values(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event-time windows with a watermark (append mode): an addition for event streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def once_per_step(rewards: DataFrame, clock: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows that come again within ``late`` count once. What a restarted run rewrites later than that is told by its attempt
    (``attempts.newest_attempts``)."""
    return rewards.withWatermark(clock, late).dropDuplicatesWithinWatermark(keys)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as keyed list and value states need; a running query keeps its own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_to_memory(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drive a bounded stream to its end into a memory table."""
    with state_store(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.table(name)


def append_records(df: DataFrame, folder: str, checkpoint: str) -> Ledger:
    """Appends a stream's records to a ledger in ``folder``, each batch once, until what is there has been read; ``read`` of the ledger
    gives them back."""
    ledger = Ledger(df.sparkSession, folder)
    ledger.follow(df, checkpoint)
    return ledger
