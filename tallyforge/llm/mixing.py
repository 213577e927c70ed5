"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, are cut into blocks of equal text. A source of weight w (of
weights that sum to 1) is due one block in each 1/w slots: its j-th block is released at floor((j-1)/w) and must be done by
ceil(j/w). Of the released blocks, the one of the earliest deadline gets the slot. So at every slot each source has had its
weight's share to within less than one block. Where a source runs dry, the others' weights are scaled up and their times
start anew from that slot (a phase); no document is left out or repeated.

Weights are whole numbers: given targets in their ratio exactly, if it is one of whole numbers up to SHARES in sum (as 0.3 to 0.7 is),
else, and by default, in SHARES parts of all, which are the targets that the bound holds for. So after as many slots as they sum to, each source has had its weight's number of blocks and a
phase's schedule starts over. Only one such period of each phase is scheduled, in a task; a block's slot follows from its period and its
number within it, however many blocks there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released

#: Characters of a block.
BLOCK_CHARS = 1 << 16
#: Without given weights, a source's weight is its characters to this power.
FLATTEN = 0.5
#: Documents of a bucket within which running sums are taken.
BUCKET_DOCS = 256
#: Up to so many sources their sizes (some 50 bytes each) are broadcast; beyond, they are joined in SALTS parts each.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: What weights sum to, but that each is 1 at least: the slots of a period.
SHARES = 1 << 16


def period(weights: list[int], most: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(source, block, release, deadline) for each slot of a period of whole weights above 0. Deadlines are slots that the block
    comes before; release <= slot < deadline. Ties go to the earlier source. ``most``: ends once a source has had so many blocks."""
    total = sum(weights)
    waiting = [(0, i, 0) for i in range(len(weights))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        out.append((i, k, release, deadline))
        if k + 1 < weights[i]:
            heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))
        if most and k + 1 == most[i]:
            break
    return out


@dataclass
class Phase:
    """From ``start`` on, ``length`` slots in which ``sources`` have their period, again and again; ``first``: the number of each one's first
    block; ``most``: their blocks, if the phase ends within its first period."""

    start: int
    length: int
    sources: list[int]
    weights: list[int]
    first: list[int]
    most: list[int] | None

    def slots(self) -> list[tuple[int, int, int, int]]:
        return period(self.weights, self.most)


def phases(blocks: list[int], weights: list[int]) -> list[Phase]:
    """The phases of sources with so many blocks and whole weights above 0."""
    out, left, start = [], list(blocks), 0
    while active := [i for i, n in enumerate(left) if n]:
        w = [weights[i] for i in active]
        whole = min((left[i] - 1) // weights[i] for i in active)  # periods after which all have a block left
        most = None if whole else [left[i] for i in active]
        slots = period(w, most)
        dry = next(t for t, (i, k, *_) in enumerate(slots) if whole * w[i] + k + 1 == left[active[i]])
        out.append(Phase(start, whole * sum(w) + dry + 1, active, w, [blocks[i] - left[i] for i in active], most))
        for i, n in enumerate(w):
            left[active[i]] -= whole * n
        for i, *_ in slots[: dry + 1]:
            left[active[i]] -= 1
        start += out[-1].length
    return out


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, phase) of all blocks, written out."""
    out = []
    for number, p in enumerate(phases(blocks, weights)):
        slots = p.slots()
        for t in range(p.length):
            turn, (i, k, release, deadline) = t // sum(p.weights), slots[t % sum(p.weights)]
            begin = p.start + turn * sum(p.weights)
            out.append((p.sources[i], p.first[i] + turn * p.weights[i] + k, p.start + t, begin + release, begin + deadline, number))
    return out


def _with_sizes(rows: DataFrame, about: DataFrame, sources: int) -> DataFrame:
    """Rows with what is known of their source, without bringing a source's rows into one task."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(about), "s")
    every = about.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(every, ["s", "part"]).drop("part")


def _shares(sizes: list[int], names: list[str | None], weights: Mapping | None) -> list[list[int]]:
    """Whole weights in turns: of the sources that have a target, and for the others by size once those are through. Targets whose ratio is
    that of whole numbers up to SHARES in sum are kept exactly; others are rounded to SHARES parts, one at least."""
    if weights is None:
        turns = [[max(n, 1) ** FLATTEN for n in sizes]]
    else:
        given = [max(weights.get(n) or 0, 0) for n in names]
        turns = [given, [0 if w else max(n, 1) for n, w in zip(sizes, given, strict=True)]]
    return [_whole(t) or [max(1, round(float(x) / float(sum(t)) * SHARES)) if x else 0 for x in t] for t in turns if any(t)]


def _whole(given: list) -> list[int] | None:
    """Given weights as the smallest whole numbers in their ratio, if those sum to SHARES or less; a float counts as the decimal it prints as."""
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in given]
    scale = lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    whole = [w // gcd(*whole) for w in whole]
    return whole if sum(whole) <= SHARES else None


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, block, slot, place, release, deadline, phase: a row for each row of ``docs``; (slot, place) is the mixed order.

    ``weights``: target weights by source (default: the square root of a source's text). Sources without a positive weight come
    after the others, mixed by size. Null is a source of its own. A null or empty text counts as one character. A document
    longer than a block stands in the block where it begins. Repeated rows are placed each. No rows: none.
    A key that is no number fails, or is null where the session's ANSI mode is off. Documents are in the order of a hash of their
    ids; those without one in that of their texts. The driver holds a row for each source and the weights of each phase (there are as many
    as sources), and goes through one period of SHARES slots at a time, or a phase if that is shorter; the slots are made in tasks."""
    placed = _placed(docs, weights, key, text, source)
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "block", "slot", "place", "release", "deadline", "phase")


def _periods(phases_: DataFrame) -> DataFrame:
    """s, phase, within, t, release, deadline: a row for each slot of a period of each phase (phase, s, weights, most), made in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, names, weights, most in batch.itertuples(index=False):
                slots = np.array(period(list(map(int, weights)), None if most is None else list(map(int, most))))
                yield pd.DataFrame({"s": np.asarray(names, object)[slots[:, 0]], "phase": number, "within": slots[:, 1], "t": np.arange(len(slots)), "release": slots[:, 2], "deadline": slots[:, 3]})

    spread = int(phases_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return phases_.repartition(spread, "phase").mapInPandas(released(run), "s string, phase int, within long, t long, release long, deadline long")


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, key: str, text: str, source: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long").alias("chars"), F.xxhash64(text).alias("tag"))
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # null is a source too
    found = sorted(rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect())
    names, counts, sizes = ([r[c] for r in found] for c in ("s", "n", "chars"))
    blocks = [-(-n // BLOCK_CHARS) for n in sizes]
    plan: list[tuple[int, Phase]] = []
    slot = 0
    for turn in _shares(sizes, [n[1:] if n else None for n in names], weights):
        made = phases([b if w else 0 for b, w in zip(blocks, turn, strict=True)], turn)
        plan += [(slot, p) for p in made]
        slot += sum(p.length for p in made)
    # of each source, where its blocks of each phase begin, and that phase's weight, number of slots and first slot
    parts: list[list[tuple[int, int, int, int, int]]] = [[] for _ in names]
    todo = []
    for number, (offset, p) in enumerate(plan):
        for i, w, first in zip(p.sources, p.weights, p.first, strict=True):
            parts[i].append((first, number, w, sum(p.weights), offset + p.start))
        todo.append((number, [names[i] for i in p.sources], p.weights, p.most))
    slots = _periods(spark.createDataFrame(todo, "phase int, s array<string>, weights array<long>, most array<long>"))

    buckets = [max(1, -(-n // BUCKET_DOCS)) for n in counts]
    about = pd.DataFrame({"s": names, "buckets": buckets, "span": [max(1, round(b**0.5)) for b in buckets], "total": sizes, "blocks": blocks, "parts": parts})
    about = spark.createDataFrame(about.astype({"s": str}), "s string, buckets long, span long, total long, blocks long, parts array<struct<first: long, phase: int, weight: long, slots: long, start: long>>")
    spot = F.pmod(F.when(F.col("key").isNull(), F.col("tag")).otherwise(F.xxhash64("key")), F.lit(1 << 40))
    rows = _with_sizes(rows, about, len(names)).withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") / (1 << 40) * F.col("buckets")))
    # text before a bucket: that of the spans before its span, and of the buckets before it there
    sums = rows.groupBy("s", "span", "bucket").agg(F.sum("chars").alias("chars")).withColumn("group", F.floor(F.col("bucket") / F.col("span")))
    up_to = (Window.unboundedPreceding, -1)
    grouped = sums.groupBy("s", "group").agg(F.sum("chars").alias("chars"))
    grouped = grouped.select("s", "group", F.coalesce(F.sum("chars").over(Window.partitionBy("s").orderBy("group").rowsBetween(*up_to)), F.lit(0)).alias("before"))
    sums = sums.withColumn("within", F.coalesce(F.sum("chars").over(Window.partitionBy("s", "group").orderBy("bucket").rowsBetween(*up_to)), F.lit(0)))
    starts = sums.join(grouped, ["s", "group"]).select("s", "bucket", (F.col("before") + F.col("within")).alias("before"))
    own = Window.partitionBy("s", "bucket").orderBy("spot", "key", "chars", "tag")
    placed = rows.join(starts, ["s", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("chars").over(own.rowsBetween(*up_to)), F.lit(0)))
    number = F.expr("cast(at as decimal(38, 0)) * blocks div total")
    placed = placed.withColumn("block", F.least(number, F.col("blocks") - 1))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("s", "block").orderBy("at", "spot", "key", "tag")) - 1)
    # the phase is the last one that begins at the block or before
    placed = placed.withColumn("part", F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("block")), -1)).drop("parts")
    placed = placed.select("*", "part.phase", F.expr("block - part.first").alias("since")).select(
        "*", F.expr("since % part.weight").alias("within"), F.expr("part.start + (since div part.weight) * part.slots").alias("begin")
    )
    joined = placed.join(slots, ["s", "phase", "within"])
    times = [(F.col("begin") + F.col(c)).alias(name) for c, name in (("t", "slot"), ("release", "release"), ("deadline", "deadline"))]
    return joined.select("key", "tag", "source", "block", "place", *times, "phase")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``docs`` in the mixed order: its rows, all columns, in partitions that follow one another and are sorted. Rows of a repeated
    id and text stand together, at the first of their places."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)])
    at, text, source = (own[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    first = _placed(named, weights, at, text, source).groupBy("key", "tag").agg(F.min(F.struct("slot", "place")).alias("o"))
    joined = named.join(first, F.col(at).cast("long").eqNullSafe(F.col("key")) & (F.xxhash64(text) == F.col("tag")))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = joined.repartitionByRange(spread, "o.slot", "o.place").sortWithinPartitions("o.slot", "o.place")
    return laid.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def mixing_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op3``."""
    return mix(docs)


def deviation(plan: list[tuple[int, int, int, int, int, int]], weights: list[int]) -> float:
    """The largest distance, in blocks, between what a source has had and its share, over all slots and phases."""
    plan, worst = np.array(plan), 0.0
    for phase in np.unique(plan[:, 5]) if len(plan) else []:
        rows = plan[plan[:, 5] == phase]
        sources = np.unique(plan[plan[:, 5] >= phase][:, 0])
        share = np.array([weights[i] for i in sources]) / sum(weights[i] for i in sources)
        had = np.cumsum(rows[:, :1] == sources[None, :], axis=0)
        worst = max(worst, np.abs(had - np.arange(1, len(rows) + 1)[:, None] * share).max())
    return float(worst)
