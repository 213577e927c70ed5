"""Bootstrap intervals by weighted sums, for any number of groups and problems.

A resample weighs each problem by a Poisson number of mean 1, drawn from the SHA-256 of the problem and scrambled with (seed, resample),
so it is the same for any partitioning and can be repeated in SQL. Groups are dealt to tasks, and a task holds the sums of one group
at a time: it reads the group's problems one after another and puts out a row when the group ends. A group of more than LARGE
problems is dealt in parts, whose sums are added by other tasks. No row is made for a problem and a resample."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHANCES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
#: Problems of a group that one task sums, at most about.
LARGE = 1 << 16
#: Problems weighed at a time, and problems whose weights a task remembers: groups often share them.
STEP, KNOWN = 64, 1024


def problem_key(problem: Column) -> Column:
    """64 bits of the SHA-256 of a problem's id as text."""
    return F.conv(F.substring(F.sha2(problem.cast("string").cast("binary"), 256), 1, 16), 16, -10).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """[key, resample] Poisson numbers."""
    turn = mixed(np.arange(resamples, dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    u = (mixed(keys.view(np.uint64)[:, None] ^ turn[None, :]) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_CHANCES, u, "right").astype(float)


def weights_sql(resamples: int, seed: int = 0) -> str:
    """DuckDB SQL of (key, trial, w): the same numbers for the distinct problem_id of a table ``problems``."""
    full = "18446744073709551616::UHUGEINT"

    def mixed(x: str) -> str:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = f"SELECT * REPLACE (((xor(x, x >> 33))::UHUGEINT * {factor}::UHUGEINT % {full})::UBIGINT AS x) FROM ({x})"
        return f"SELECT * REPLACE (xor(x, x >> 33) AS x) FROM ({x})"

    start = (seed + 1) * 0x9E3779B97F4A7C15 % 2**64
    turns = mixed(f"SELECT t AS trial, ((t::UHUGEINT + {start}::UHUGEINT) % {full})::UBIGINT AS x FROM range({resamples}) r(t)")
    keys = "SELECT DISTINCT problem_id, ('0x' || substr(sha256(problem_id::VARCHAR), 1, 16))::UBIGINT AS k FROM problems"
    drawn = mixed(f"SELECT problem_id, trial, xor(k, x) AS x FROM ({keys}), ({turns})")
    u = f"SELECT problem_id, trial, (x >> 11)::DOUBLE / 9007199254740992 AS u FROM ({drawn})"
    return f"SELECT problem_id, trial, {' + '.join(f'(u >= {c!r})::INT' for c in _CHANCES.tolist())} AS w FROM ({u})"


class _Sums:
    """Sums over problems of 1 and of each value, plain (first) and by resample."""

    def __init__(self, values: int, resamples: int, seed: int):
        self.values, self.resamples, self.seed, self.known = values, resamples, seed, {}

    def none(self) -> np.ndarray:
        return np.zeros((self.values + 1, self.resamples + 1))

    def of(self, keys: np.ndarray, v: np.ndarray) -> np.ndarray:
        total = self.none()
        for at in range(0, len(keys), STEP):
            some = keys[at : at + STEP]
            if new := [k for k in dict.fromkeys(some.tolist()) if k not in self.known]:
                if len(self.known) + len(new) > KNOWN:
                    self.known = {k: self.known[k] for k in some.tolist() if k in self.known}
                drawn = weights(np.array(new, np.int64), self.resamples, self.seed).astype(np.uint8)
                self.known |= dict(zip(new, drawn, strict=True))
            w = np.ones((len(some), self.resamples + 1))
            w[:, 1:] = [self.known[k] for k in some.tolist()]
            total += v[:, at : at + STEP] @ w
        return total


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of batches whose rows agree in ``by``, and whether a run of such rows begins with the slice."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            yield batch.slice(a, b - a), keys[a] != before
            before = keys[a]


def by_group(rows: DataFrame, by: list[str], values: list[str], finish: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, resamples: int, seed: int = 0, large: int = LARGE) -> DataFrame:
    """``by`` and the columns of ``schema``: of each group what ``finish`` makes (columns of some equal length) of its sums [1 and values, 0: plain,
    then resamples]. Rows have problem_id, each of a group's problems once; rows with a null value are left out. Null in ``by`` is a
    value of its own. No rows: none."""
    own = [f"b{i}" for i in range(len(by))]
    known = " and ".join(f"v{i} is not null" for i in range(len(values))) or "true"
    keyed = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(by, own, strict=True)], problem_key(F.col("problem_id")).alias("k"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).where(known)
    keyed = keyed.withColumn("g", F.to_json(F.struct(*own)) if own else F.lit(""))
    types = "".join(f"{o} {keyed.schema[o].dataType.simpleString()}, " for o in own)
    names = [c.split()[0] for c in schema.split(",")]

    def put(first: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch | None:
        found = finish(sums)
        n = len(next(iter(found.values())))
        return pa.RecordBatch.from_pydict({o: first.column(o).take(pa.array([0] * n, pa.int64())) for o in own} | {c: pa.array(found[c]) for c in names})

    def summed(batches: Iterator[pa.RecordBatch], by_: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        adder, first, total = _Sums(len(values), resamples, seed), None, None
        for part, new in _runs(batches, by_):
            if new:
                if first is not None:
                    yield first, total
                first, total = part.slice(0, 1), adder.none()
            v = np.stack([np.ones(part.num_rows), *(part.column(f"v{i}").to_numpy() for i in range(len(values)))])
            total += adder.of(part.column("k").to_numpy(), v)
        if first is not None:
            yield first, total

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, total in summed(batches, ("g",)):
            yield put(first, total)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, total in summed(batches, ("g", "part")):
            yield pa.RecordBatch.from_pydict({o: first.column(o) for o in (*own, "g")} | {"sums": pa.array([total.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for part, new in _runs(batches, ("g",)):
            if new:
                if first is not None:
                    yield put(first, total)
                first, total = part.slice(0, 1), np.zeros((len(values) + 1, resamples + 1))
            for one in part.column("sums").to_pylist():
                total += np.frombuffer(one).reshape(total.shape)
        if first is not None:
            yield put(first, total)

    sizes = keyed.groupBy("g").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    dealt = keyed
    if most > large:
        parted = sizes.select("g", F.ceil(F.col("n") / large).alias("parts")).where("parts > 1")
        dealt = keyed.join(parted, "g", "left").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
    out = (dealt if most <= large else dealt.where("parts is null")).repartition("g").sortWithinPartitions("g").mapInArrow(whole, types + schema)
    if most > large:
        sums = dealt.where("parts is not null").repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(parts, f"{types}g string, sums binary")
        out = out.union(sums.repartition("g").sortWithinPartitions("g").mapInArrow(added, types + schema))
    return out.select(*[F.col(o).alias(c) for c, o in zip(by, own, strict=True)], *names)


def weighted_sums(rows: DataFrame, by: list[str], values: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """``by``, trial, weight and the weighted sum of each of ``values``, all resamples of each group."""
    names = [f"s{i}" for i in range(len(values))]

    def finish(sums: np.ndarray) -> dict[str, np.ndarray]:
        return {"trial": np.arange(resamples, dtype=np.int32), "weight": sums[0, 1:]} | {c: sums[i + 1, 1:] for i, c in enumerate(names)}

    found = by_group(rows, by, values, finish, "trial int, weight double" + "".join(f", {c} double" for c in names), resamples, seed)
    return found.select(*by, "trial", "weight", *[F.col(c).alias(v) for c, v in zip(names, values, strict=True)])


def _ends(x: np.ndarray, alpha: float) -> dict[str, list]:
    low, high = np.quantile(x, [alpha / 2, 1 - alpha / 2]).tolist() if len(x) else (None, None)
    return {"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())}


def intervals(scores: DataFrame, by: list[str], value: str = "score", resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """``by``, mean, n_problems, low, high: the mean of each group's problems and its percentile interval over the resamples that drew any.
    Problems without a value are left out. No problems: no row."""

    def finish(sums: np.ndarray) -> dict[str, np.ndarray]:
        n, total = sums[0], sums[1]
        some = n[1:] > 0
        return {"mean": total[:1] / n[:1], "n_problems": n[:1].astype(np.int64)} | _ends(total[1:][some] / n[1:][some], alpha)

    return by_group(scores, by, [value], finish, "mean double, n_problems long, low double, high double", resamples, seed)


def ratio_interval(pairs: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Of ``by``, problem_id, top and bottom (differences of each problem): ratio of the means, its joint interval over the resamples
    that have one, the share of those whose bottom is 0 or below, and whether the interval is bounded: less than alpha/2 of them on one
    side of 0. Problems that lack one of the two are left out."""

    def finish(sums: np.ndarray) -> dict[str, np.ndarray]:
        n, top, bottom = sums
        x, y = top[1:], bottom[1:]
        below, above = np.mean(y <= 0), np.mean(y >= 0)
        ratio = [top[0] / bottom[0] if bottom[0] else None]
        means = {"top": top[:1] / n[:1], "bottom": bottom[:1] / n[:1], "n_problems": n[:1].astype(np.int64), "ratio": pa.array(ratio, pa.float64())}
        return means | _ends(x[y != 0] / y[y != 0], alpha) | {"share_below": [below], "bounded": [bool(below < alpha / 2 or above < alpha / 2)]}

    return by_group(pairs, by, ["top", "bottom"], finish, "top double, bottom double, n_problems long, ratio double, low double, high double, share_below double, bounded boolean", resamples, seed)
