"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import lru_cache, wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.joins import join_counted  # noqa: F401
from tallyforge.sources.files import shared_folder

#: Stands for a null id inside packed arrays; sorts before every real id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder all executors share and read it from there, so a lost executor costs no
    recomputation. The folder is the session's (``spark.cleaner.referenceTracking.cleanCheckpoints`` has Spark remove what isn't needed)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remainder_of_id(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; the fold rule of the classifiers. A null id counts as text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back(collect: bool = True) -> None:
    """Freed memory of a Python worker goes back to the system: workers outlive their tasks. ``collect``: cycles are looked for first."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run):
    """``run``, an iterator over a task's batches, after whose end the worker gives its memory back."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def trimmed(run):
    """``run``, a function of one group (or of two that belong together), after which the worker gives memory back."""

    def one(group):
        try:
            return run(group)
        finally:
            give_back(collect=False)

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back(collect=False)

    return one if run.__code__.co_argcount == 1 else two


#: Bytes (or symbols) whose prefix sums are taken at a time.
SPAN = 1 << 18
#: Odd multipliers of two independent polynomial hashes.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def _powers(multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, up to SPAN."""
    out = []
    for m in (multiplier, pow(multiplier, -1, 1 << 64)):
        p = np.full(SPAN + 1, m, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def run_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, multiplier: int = FIRST) -> np.ndarray:
    """64-bit hashes of the runs values[begins:ends], which come one after another; equal runs get equal hashes wherever they are.
    A polynomial in the multiplier, read off prefix sums; a run longer than SPAN is hashed part by part."""
    power, inverse = _powers(multiplier)
    out, at = np.zeros(len(begins), np.uint64), 0
    while at < len(begins):
        base = int(begins[at])
        to = int(np.searchsorted(ends, base + SPAN, "right"))
        if to <= at:
            h, last = np.zeros(1, np.uint64), int(ends[at])
            for k in range(base, last, SPAN):
                part = values[k : min(k + SPAN, last)].astype(np.uint64) + np.uint64(1)
                h = mix64(h + (part * power[: len(part)]).sum(dtype=np.uint64))
            out[at] = h[0]
            at += 1
            continue
        part = values[base : ends[to - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        b, e = begins[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[b]) * inverse[b]
        at = to
    return mix64(out)


class Words:
    r"""The words ``[^\x20\x09-\x0D]+`` of some texts (UTF-8; None: no words), end to end: where they begin and end in ``data``,
    and the number of each text's first (and, at the end, of all). Texts are set apart by one space."""

    def __init__(self, texts: list[bytes | None]):
        self.data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
        sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.at = np.cumsum(np.concatenate([[0], sizes + 1]))
        white = _WHITE[self.data]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.concatenate([[0], edges])
        self.begins, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.begins, self.at)

    def hashes(self, multiplier: int = FIRST) -> np.ndarray:
        return run_hashes(self.data, self.begins, self.ends, multiplier)
