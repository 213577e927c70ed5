"""Mechanical checks: each returns rows (check, severity, message); a FAIL blocks what is built on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, name: str, message: Column, severity: str = "FAIL") -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("missing")) for p in parts])


def units_present(expected: DataFrame, present: DataFrame, keys: list[str], known_missing: DataFrame | None = None) -> DataFrame:
    """Expected units that aren't there; those known to be missing are notes."""
    gone = expected.join(present.select(*keys).distinct(), keys, "left_anti")
    named = _say("missing: ", F.concat_ws("/", *keys))
    if known_missing is None:
        return _rows(gone, "units_present", named)
    known = known_missing.select(*keys).distinct()
    return _rows(gone.join(known, keys, "left_anti"), "units_present", named).union(_rows(gone.join(known, keys, "left_semi"), "units_present", named, "note"))


def paths_without(paths: DataFrame, fragments: list[str], column: str = "path") -> DataFrame:
    hit = [F.contains(F.col(column), F.lit(f)) for f in fragments]
    found = paths.where(F.array_contains(F.array(*hit), True)) if hit else paths.where("false")
    return _rows(found, "never_results", _say("loaded: ", F.col(column)))


def topmost(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths that lie in no other path of the table: each path's proper ancestors are looked up, so no pairs are made."""
    own = paths.select(column).distinct()
    parts = F.split(F.col(column), "/")
    up = own.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above")).where(F.col("above") != F.col(column))
    covered = up.join(own.select(F.col(column).alias("above")), "above", "left_semi").select(column).distinct()
    return own.join(covered, column, "left_anti")


def single_valued(units: DataFrame, fields: list[str], name: str = "one_protocol", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Fields that should have one value over all units (or in each group of ``by``)."""
    long = units.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*by, "x.field", "x.value")
    counts = long.groupBy(*by, "field").agg(F.array_sort(F.collect_set(F.coalesce("value", F.lit("missing")))).alias("values")).where(F.size("values") > 1)
    return _rows(counts, name, _say(*[x for c in by for x in (F.col(c), "/")], F.col("field"), ": ", F.array_join("values", ", ")))


def holders(units: DataFrame, value: str, unit: str) -> DataFrame:
    """Which units hold which value."""
    return units.groupBy(value).agg(F.array_sort(F.collect_list(unit)).alias("holders"))


def equal_values(stored: DataFrame, computed: DataFrame, keys: list[str], field: str, tolerance: float = 1e-12) -> DataFrame:
    j = stored.select(*keys, F.col(field).alias("a")).join(computed.select(*keys, F.col(field).alias("b")), keys, "full_outer")
    bad = j.where(F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, ~F.col("a").eqNullSafe(F.col("b"))))
    return _rows(bad, "stored_equals_recomputed", _say(F.concat_ws("/", *keys), ": ", F.col("a"), " is not ", F.col("b")))


def disjoint(splits: DataFrame, key: str, allowed: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """Pairs of splits that share keys, but for pairs of a split and one derived from it."""
    from .tiering import overlaps

    pairs = overlaps(splits, key)
    for a, b in allowed:
        x, y = sorted((a, b))
        pairs = pairs.where(~((F.col("split_a") == x) & (F.col("split_b") == y)))
    return _rows(pairs, "splits_disjoint", _say(F.col("split_a"), " and ", F.col("split_b"), " share ", F.col("shared"), f" of {key}"))


def duplicates(table: DataFrame, keys: list[str], name: str = "duplicate_keys") -> DataFrame:
    found = table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _rows(found, name, _say(F.concat_ws("/", *keys), ": ", F.col("n"), " rows"))


def rate_limits(rates: DataFrame, unit: str, column: str, limit: float, name: str, severity: str = "FAIL", excuse: Column | None = None) -> DataFrame:
    found = rates.where((F.col(column) > limit) & ~(excuse if excuse is not None else F.lit(False)))
    return _rows(found, name, _say(F.col(unit), f": {column} ", F.round(column, 4)), severity)


def bernoulli_mean(rewards: DataFrame, by: str, column: str = "reward", low: float = 0.4, high: float = 0.6) -> DataFrame:
    found = rewards.groupBy(by).agg(F.avg(column).alias("m")).where(~F.col("m").between(low, high))
    return _rows(found, "random_reward_mean", _say(F.col(by), ": ", F.round("m", 4)))


def outputs_differ(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """Two models whose texts agree on nearly all of their common keys are the same model."""
    j = a.select(*keys, F.col("completion").alias("a")).join(b.select(*keys, F.col("completion").alias("b")), keys)
    return _rows(j.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("d")).where(F.col("d") < least), "outputs_differ", _say("share that differs: ", F.round("d", 4)))


def required(table: DataFrame, unit: str, columns: list[str], name: str = "required_fields") -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return _rows(table.withColumn("m", missing).where(F.size("m") > 0), name, _say(F.col(unit), ": ", F.array_join("m", ", ")))


def expected_value(table: DataFrame, unit: str, column: str, value: object, name: str) -> DataFrame:
    return _rows(table.where(~F.col(column).eqNullSafe(F.lit(value))), name, _say(F.col(unit), f": {column} is ", F.col(column)))


def chosen_on(selection: DataFrame, split: str = "val") -> DataFrame:
    """Sweep rows scored on another split than the one that may be used for choosing."""
    return _rows(selection.where(~F.col("selection_split").eqNullSafe(F.lit(split))), "selection_on_val_only", _say(F.col("arm"), ": chosen on ", F.col("selection_split")))


def blocking(results: DataFrame) -> DataFrame:
    return results.where("severity = 'FAIL'")
