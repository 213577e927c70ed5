"""A store of runs on disk: its configuration, the plan of units that may be read, guarded reads, derived units kept by content,
and the records that a run leaves."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import units

from . import digests, files, schemas
from .files import read_text
from .ledger import Ledger

#: Goes into the key of kept units; another one whenever ``units.derive`` gives other columns.
KEPT_VERSION = 2
#: Settings that only say where things are.
PLACES = ("run_root", "out_dir", "splits_dir", "store_checksums")


class ExcludedPath(ValueError):
    """A path that must never become a result."""


def parse(text: str, name: str = "") -> dict:
    """A JSON document, or a YAML one where a YAML parser is installed."""
    if name.endswith(".json") or text.lstrip().startswith("{"):
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"no YAML parser is installed; give {name or 'the document'} as JSON") from e
    return yaml.safe_load(text) or {}


def load_config(spark: SparkSession, path: str, **places: str | None) -> dict:
    """A configuration; ``places`` that aren't None replace its own."""
    return parse(read_text(spark, path), path) | {k: v for k, v in places.items() if v is not None}


def config_hash(config: Mapping) -> str:
    """A digest of everything that can change a number."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k not in PLACES}, sort_keys=True).encode()).hexdigest()


def slug(name: str) -> str:
    """A model's name as a folder's."""
    return name.replace("/", "__")


def excluded_reason(path: str, root: str, never: Sequence[Mapping[str, str]]) -> str | None:
    """Why a path below ``root`` is no result, or None."""
    probe = "/" + path.removeprefix(root.rstrip("/") + "/").strip("/") + "/"
    return next((item["why"] for item in never if item["fragment"] in probe), None)


def guard(path: str, root: str, never: Sequence[Mapping[str, str]]) -> str:
    if why := excluded_reason(path, root, never):
        raise ExcludedPath(f"{path} is no result: {why}")
    return path


def unit_plan(spark: SparkSession, config: Mapping) -> DataFrame:
    """Every unit that the configuration names, none found by looking: arm, kind, method, seed, split, decoding, path, present.

    ``config``: run_root, seeds, units (pairs of split and decoding), base ({dir}), arms and controls (name: {dir, method, seeds}), the
    dir with ``{seed}`` in it; never_results (fragment, why). A path that may not be a result is an error. It is as large as the
    configuration, not as the store."""
    root, never, rows = config["run_root"].rstrip("/"), config.get("never_results") or [], []
    groups = [("base", {"base": {"dir": config["base"]["dir"], "seeds": [1]}} if config.get("base") else {}), ("arm", config.get("arms") or {}), ("control", config.get("controls") or {})]
    for kind, group in groups:
        for arm, spec in group.items():
            for seed in spec.get("seeds") or config["seeds"]:
                run = guard(f"{root}/{spec['dir'].format(seed=seed)}", root, never)
                for split, decoding in config["units"]:
                    path = guard(f"{run}/eval/{split}/{decoding}", root, never)
                    rows.append((arm, kind, spec.get("method"), int(seed), split, decoding, path))
    there = {p.rsplit("/", 1)[0] for p in files.listing(spark, root, "samples.jsonl")}
    whole = files.plain_path(files.qualified(spark, root))
    rows = [(*r, whole + r[-1].removeprefix(root) in there) for r in rows]
    return spark.createDataFrame(rows, "arm string, kind string, method string, seed int, split string, decoding string, path string, present boolean")


def missing_units(plan: DataFrame) -> DataFrame:
    return plan.where("not present").select("arm", "seed", "split", "decoding", "path")


def chosen_setting(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """A plan's runs of the setting that was chosen for each arm; arms without one stay."""
    return plan.join(F.broadcast(chosen.select("arm", F.col("learning_rate").alias("lr"), F.col("epochs").alias("ep"))), "arm", "left")


def _folder(column: str = "_metadata.file_path"):
    return F.regexp_replace(F.regexp_replace(F.col(column), "^file:/+", "/"), "/[^/]+$", "")


def read_answers(spark: SparkSession, plan: DataFrame, schema: str = schemas.SAMPLES) -> DataFrame:
    """The answers of the present units of a plan, in one scan, with the plan's columns. Files go to the scan as folders of the
    configuration; what other files lie below the root isn't read."""
    known = plan.where("present").drop("present")
    paths = [f"{r['path']}/samples.jsonl" for r in known.select("path").distinct().collect()]  # as many as the configuration names
    if not paths:
        raise FileNotFoundError("no unit of the plan is there")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("path", _folder())
    keep = [c for c in rows.columns if c == "path" or c not in known.columns]
    return rows.select(*keep).join(F.broadcast(known), "path")


def unit_digests(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """path, key: a digest over the version, a unit's answers and its configuration, which tells whether it has been derived before."""
    paths = [r["path"] for r in plan.where("present").select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "path string, key string")
    known = set(map(files.plain_path, paths))
    found = [f for f in files.listing(spark, paths, "{samples.jsonl,config.yaml,config.json}") if f.rsplit("/", 1)[0] in known]
    one = digests.tree_digests(spark, found).select(_folder("path").alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "digest")
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest")))
    return one.groupBy(F.col("folder").alias("path")).agg(F.sha2(F.concat(F.lit(f"v{KEPT_VERSION}\n"), F.array_join(parts, "\n")).cast("binary"), 256).alias("key"))


def derived_units(spark: SparkSession, plan: DataFrame, kept: str | None = None, cap: int | None = None) -> DataFrame:
    """``units.derive`` of every present unit. With a folder ``kept``, units whose content was derived before are read from there, and the
    others are derived in one pass and added to it, all at once or, where the run is killed, not at all."""
    by = ["path"]
    if kept is None:
        return _derived(read_answers(spark, plan), by, cap)
    found = unit_digests(spark, plan).select("path", F.sha2(F.concat_ws("\n", "key", F.lit(str(cap))), 256).alias("key")).collect()  # a row for each unit of the plan
    keys = spark.createDataFrame(found, "path string, key string")
    book = Ledger(spark, f"{kept.rstrip('/')}/units")
    done = spark.createDataFrame([], "key string") if book.is_empty() else book.read().select("key").distinct()
    new = keys.join(done, "key", "left_anti").groupBy("key").agg(F.min("path").alias("path"))  # units of one content are derived once
    todo = plan.join(F.broadcast(new), "path", "left_semi")
    if not todo.isEmpty():
        book.add(_derived(read_answers(spark, todo), by, cap).join(F.broadcast(new), "path"))
    return book.read().dropDuplicates(["key", "problem_id"]).drop("path").join(F.broadcast(keys), "key").drop("key")


def _derived(answers: DataFrame, by: Sequence[str], cap: int | None) -> DataFrame:
    from tallyforge.functions import extract

    a = answers if "answer_line" in answers.columns else answers.withColumn("answer_line", extract.has_answer_line(F.col("completion"), F.col("truncated")))
    return units.derive(a, list(by), cap)


def read_records(spark: SparkSession, plan: DataFrame, name: str, schema: str) -> DataFrame:
    """One small JSON record of each present unit (such as meta.json or metrics.json), with its path."""
    folders = [r["path"] for r in plan.where("present").select("path").distinct().collect()]
    there = files.listing(spark, folders, name) if folders else []
    if not there:
        return spark.createDataFrame([], f"{schema}, path string")
    return spark.read.schema(schema).option("multiLine", True).json(there).withColumn("path", _folder())


def write_provenance(spark: SparkSession, folder: str, config: Mapping, meta: Mapping, notes: str = "") -> str:
    """A run's resolved configuration, its hash, meta and notes; each is written once. Returns the hash."""
    digest = config_hash(config)
    files.write_new(spark, f"{folder}/config.json", json.dumps(config, sort_keys=True, indent=1))
    files.write_new(spark, f"{folder}/config_hash.txt", digest + "\n")
    files.write_new(spark, f"{folder}/meta.json", json.dumps(dict(meta) | {"config_hash": digest}, sort_keys=True))
    if notes:
        files.write_new(spark, f"{folder}/notes.md", notes)
    return digest


def write_draw(draw: DataFrame, path: str, n: int) -> None:
    """A draw of exactly ``n`` answers for each problem, numbered 0..n-1; written once."""
    from tallyforge.operators.runs import draw_integrity

    if bad := draw_integrity(draw, n).limit(5).collect():
        raise ValueError(f"not a whole draw: {[r['message'] for r in bad]}")
    files.write_jsonl_once(draw, path, ["problem_id", "sample_idx"])


def read_draw(spark: SparkSession, path: str, n: int, schema: str = schemas.SAMPLES) -> DataFrame:
    from tallyforge.operators.runs import draw_integrity

    draw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if bad := draw_integrity(draw, n).limit(5).collect():
        raise ValueError(f"not a whole draw: {[r['message'] for r in bad]}")
    return draw


def transfer_problems(rows: DataFrame, n: int, source: str, index: str = "idx") -> DataFrame:
    """The first ``n`` questions by index as problems; the answer stands behind the last ``####``. Fewer rows, or an answer that is no
    integer, are an error."""
    from tallyforge.functions.extract import hashed_answer

    picked = files.answered_rows(rows, n, index, hashed_answer(F.col("answer")))
    return picked.select(F.concat(F.lit(f"{source}_"), F.lpad(F.col(index).cast("string"), 5, "0")).alias("problem_id"), F.col("question").alias("text"), "answer", F.lit("untiered").alias("tier"), F.lit(source).alias("split"))


def instance_problems(rows: DataFrame, source: str, index: str = "idx") -> DataFrame:
    """Generated instances (question, answer as text) as problems; those whose answer is no integer are left out."""
    from tallyforge.functions.extract import strict_integer

    kept = rows.withColumn("answer", strict_integer(F.col("answer"))).where("answer is not null")
    return kept.select(F.concat(F.lit(f"{source}_"), F.col(index).cast("string")).alias("problem_id"), F.col("question").alias("text"), "answer", F.lit("untiered").alias("tier"), F.lit(source).alias("split"))


def subset_name(name: str) -> tuple[str, int | None]:
    """``<split>_first<n>`` as split and n; other names as they are."""
    m = re.fullmatch(r"(.+)_first(\d+)", name)
    return (m[1], int(m[2])) if m else (name, None)


#: The six result tables that are written as CSV, and their key columns.
TABLES = {"units": ["arm", "seed", "metric"], "arms": ["arm", "metric"], "per_tier": ["arm", "tier", "metric"], "budgets": ["arm", "seed"], "truncation": ["arm", "seed", "metric"], "contrasts": ["key", "metric"]}


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """The result tables as CSV, one file each, in order of their keys; arrays as JSON."""
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if "<" in t else F.col(c) for c, t in df.dtypes])
        files.write_csv(flat.orderBy(*TABLES[name]), f"{folder}/{name}")
