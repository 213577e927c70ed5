"""Readers and writers: JSON lines, JSON, CSV, text and binary files, on any file system that Spark reads."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder with all that is in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, by name; nothing if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def listing(spark: SparkSession, paths: str | list[str], name: str = "*") -> list[str]:
    """Paths of the files of a name (a glob) below some folders, empty ones too, in plain form (``/x`` for ``file:///x``). Spark lists many folders
    in tasks; what comes back is as long as the list of files. Folders that aren't there have none."""
    folders = [p for p in ([paths] if isinstance(paths, str) else paths) if isinstance(paths, list) or exists(spark, p)]
    if not folders:
        return []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folders).inputFiles()
    return sorted(plain_path(unquote(f)) for f in found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme and host."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def plain_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, from any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not exist yet, there whole or not at all: written beside its place and renamed to it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    draft = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = target.getFileSystem(conf).create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(target.getFileSystem(conf).makeQualified(draft), target.getFileSystem(conf).makeQualified(target), no_options)
    except Exception as e:
        target.getFileSystem(conf).delete(draft, False)
        if exists(spark, path):
            raise FileExistsError(f"{path} already exists") from e
        raise


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for intermediate data, which driver and executors share. Where it names none, a temporary one
    on a single machine; on a cluster that is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tallyforge-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder's checkpoints and read from there: it is computed once, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Records of a fixed schema; blank lines are skipped and malformed ones are an error. ``strict``: a field that the schema
    doesn't have is an error too (Spark's reader alone would ignore it). Each line is read once: its keys are checked in the same scan
    that parses it, so errors come when rows are asked for."""
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = F.array(*[F.lit(c) for c in spark.createDataFrame([], schema).columns])
    unknown = F.array_except(F.json_object_keys("value"), known)
    line = F.when(F.coalesce(F.size(unknown), F.lit(0)) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))).cast("string")).otherwise(F.col("value"))
    rows = spark.read.text(path).where("trim(value) != ''").select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("row"))
    return rows.select("row.*")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that may not have been written yet."""
    return read_jsonl(spark, path, schema, strict=False) if exists(spark, path) else spark.createDataFrame([], schema)


def read_problems(spark, path):
    return read_jsonl(spark, path, schemas.PROBLEMS)


def read_samples(spark, path):
    return read_jsonl(spark, path, schemas.SAMPLES)


def read_rewards(spark, path):
    return read_or_empty(spark, path, schemas.REWARDS)


def read_train_log(spark, path):
    return read_or_empty(spark, path, schemas.TRAIN_LOG)


def read_splits(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("pool_tiered",)) -> DataFrame:
    """Every ``*.jsonl`` of a folder but those of ``skip``; the file's stem names the split."""
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1)
    rows = spark.read.schema(schemas.PROBLEMS).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.withColumn("split", stem).where(~F.col("split").isin(*skip))


def read_metrics(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON document a file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """Every ``meta.json`` below a root, with its path."""
    rows = spark.read.schema(schemas.RUN_META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(root)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def read_units(spark: SparkSession, plan: DataFrame, schema: str = schemas.SAMPLES, most: int = 100_000) -> DataFrame:
    """The units of a plan (run, split, decoding, path), and no others: one scan over the planned paths, joined to the plan. A plan is a
    configuration's; one of more than ``most`` rows is an error."""
    rows = plan.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a plan of more than {most} units")
    paths = sorted({r["path"] for r in rows})
    answers = spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"))
    return answers.join(F.broadcast(plan), "path")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``digest  path`` lines."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) != ''").select(F.get(parts, F.lit(0)).alias("digest"), F.get(parts, F.lit(1)).alias("path"))


def read_queue_log(spark: SparkSession, path: str) -> DataFrame:
    """Jobs with exit code and wall seconds from lines ``job <name> ... exit=<n> ... wall=<s>``."""
    pattern = r"job[ =](\S+).*?exit[ =](-?\d+).*?wall[ =]([\d.]+)"
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).alias("job"), F.regexp_extract("value", pattern, 2).cast("int").alias("exit_code"), F.regexp_extract("value", pattern, 3).cast("double").alias("wall_s")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def answered_rows(rows: DataFrame, n: int, order: str, answer: Column) -> DataFrame:
    """The first ``n`` question rows by index, with integer answers; fewer is an error."""
    picked = rows.orderBy(order).limit(n)
    if (have := picked.count()) < n:
        raise ValueError(f"{have} rows, {n} are needed")
    return picked.withColumn("answer", F.coalesce(answer, F.raise_error(F.concat(F.lit("no integer answer at "), F.col(order).cast("string"))).cast("bigint")))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Columns in alphabetical order; with ``order``, the rows in it (range-partitioned, so the files follow one another)."""
    rows = df.select(*sorted(df.columns))
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.json(path)


def write_jsonl_once(df: DataFrame, path: str, order: list[str]) -> None:
    """``write_jsonl`` that refuses to overwrite."""
    if exists(df.sparkSession, path):
        raise FileExistsError(f"{path} already exists")
    write_jsonl(df, path, order)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table, one file with a header."""
    df.coalesce(1).write.option("header", True).option("lineSep", "\n").csv(path)


def synthetic_completions(spark: SparkSession, problems: DataFrame, k: int, seed: int = 0, right: float = 0.6, cut: float = 0.05) -> DataFrame:
    """Scripted answers with a chosen mix of outcomes, for fixtures: k for each problem, by hashed numbers."""
    from tallyforge.functions.hashrng import sha_int

    rows = problems.crossJoin(spark.range(k).withColumnRenamed("id", "sample_idx"))
    u = sha_int(seed, F.col("problem_id"), F.col("sample_idx")) / float(2**48)
    value = F.when(u < right, F.col("answer")).otherwise(F.col("answer") + 1)
    text = F.when(u >= 1 - cut, "Let me think").otherwise(F.concat(F.lit("So it is.\nAnswer: "), value.cast("string")))
    return rows.withColumn("completion", text).withColumn("truncated", u >= 1 - cut).withColumn("n_tokens", (F.length(text) / 4).cast("int") + 1)
