"""Exact dedup by deterministic block naming.

A text's bytes are cut into blocks of BLOCK. The distinct blocks are sorted and numbered: a block's number is its name. Then
adjacent names are taken in pairs, the distinct pairs sorted and numbered in turn, and so on until one name is left of each
document. Two documents have the same last name at the same level just if their texts are equal.

Blocks are sorted by a digest of 128 bits, so that a block's row is small, and all distinct blocks are compared by content
under their digests: if one digest had two contents, all would be digested anew with another key. So names never collide.
Naming needs a row for each block and pair; texts are read twice and never gathered. A block, pair or text that many rows
share is counted before it is shuffled, and its name comes back by broadcast (``common.join_counted``).
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, join_counted, released

#: Bytes of a block.
BLOCK = 1024
#: Documents, and blocks, that a Python worker puts out at a time.
BATCH = 1024
#: Stands for the missing half of a text's last pair.
NONE = -1


def normal(text: bytes | None) -> bytes:
    """A to Z in lower case, whatever else is left as it is; None: empty."""
    return (text or b"").lower()


def digest(block: bytes, seed: int) -> tuple[int, int]:
    h = hashlib.blake2b(block, digest_size=16, key=seed.to_bytes(4, "big")).digest()
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def blocks_of(text: bytes, size: int) -> Iterator[bytes]:
    """At least one: the empty text is an empty block."""
    return (text[at : at + size] for at in range(0, max(len(text), 1), size))


def _digested(docs: DataFrame, size: int, seed: int, hashed) -> DataFrame:
    """``docs`` (row, doc_key, text): row, doc_key, sha256 of the normal text, and its blocks' digests in two arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                sha, first, second = [], [], []
                for t in batch.column("text").cast(pa.large_binary()):
                    text = normal(t.as_py())
                    found = [hashed(b, seed) for b in blocks_of(text, size)]
                    sha.append(hashlib.sha256(text).hexdigest())
                    first.append([a for a, _ in found])
                    second.append([b for _, b in found])
                longs = pa.list_(pa.int64())
                columns = [batch.column("row"), batch.column("doc_key"), pa.array(sha), pa.array(first, longs), pa.array(second, longs)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_key", "sha", "a", "b"])

    return docs.mapInArrow(released(run), "row long, doc_key long, sha string, a array<long>, b array<long>")


def _collide(docs: DataFrame, size: int, seed: int, hashed) -> bool:
    """Whether two blocks of different content have one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[int, int]] = {}
            for t in batch.column("text").cast(pa.large_binary()):
                for block in blocks_of(normal(t.as_py()), size):
                    if block not in found:
                        found[block] = hashed(block, seed)
                if len(found) >= 16 * BATCH:
                    yield rows(found)
                    found = {}
            if found:
                yield rows(found)

    def rows(found: dict[bytes, tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(found), pa.binary())], ["a", "b", "block"])

    distinct = docs.select("text").mapInArrow(released(run), "a long, b long, block binary").distinct()
    return bool(distinct.groupBy("a", "b").count().where("count > 1").limit(1).collect())


def _named(parts: DataFrame) -> DataFrame:
    """``parts`` (row, places, place, a, b) with name in place of a and b: the number of (a, b) among the distinct ones in their
    order, with gaps."""
    names = parts.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy("a", "b").withColumn("name", F.monotonically_increasing_id())
    return join_counted(parts, cut(names), ["a", "b"]).select("row", "places", "place", "name")


def identities(parts: DataFrame) -> DataFrame:
    """Of ``parts`` (row, places: how many the row has, place, a, b), stored: row, level, name. Rows of equal sequences of (a, b)
    have equal level and name, others don't."""
    found, level = None, 0
    while not parts.isEmpty():
        named = cut(_named(parts))
        done = named.where("places = 1").select("row", F.lit(level).alias("level"), "name")
        found = done if found is None else found.union(done)
        half = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        pairs = named.where("places > 1").groupBy("row", "places", F.floor(F.col("place") / 2).cast("int").alias("place"))
        pairs = pairs.agg(half(0).alias("a"), F.coalesce(half(1), F.lit(NONE)).alias("b"))
        parts = cut(pairs.withColumn("places", F.ceil(F.col("places") / 2).cast("int")))
        level += 1
    return parts.selectExpr("row", "0 level", "a name") if found is None else found


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK, hashed=digest) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``; other columns are left out.

    Texts are equal if they are identical after A to Z are put in lower case; a null text counts as empty, and the empty text is
    equal to itself alone. Of equal texts the row with the largest id is kept; a null id is smaller than all others, and of rows that
    repeat the largest id one is kept. keep_id is the kept row's id (null if all have none), group_size the number of rows, and
    text_sha256 the digest in lower-case hex of the normalised text in UTF-8. An id that is no number fails, or is null where the
    session's ANSI mode is off. No rows: none. ``hashed`` gives a block's two numbers, by a seed."""
    doc_key = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias("doc_key")
    named = docs.select(F.monotonically_increasing_id().alias("row"), doc_key, F.col(f"`{text}`").cast("string").alias("text"))
    seed = 0
    while _collide(named, size, seed, hashed):
        seed += 1
    rows = cut(_digested(named, size, seed, hashed))
    parts = rows.select("row", F.size("a").alias("places"), F.posexplode(F.arrays_zip("a", "b")).alias("place", "pair")).select("row", "places", "place", "pair.a", "pair.b")
    told = cut(rows.select("row", "doc_key", "sha").join(identities(parts), "row"))
    last = F.max(F.struct("doc_key", "row")).alias("last")
    groups = cut(told.groupBy("level", "name").agg(F.count("*").alias("n"), last))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return join_counted(told, groups, ["level", "name"]).select(
        back("doc_key").alias(key), back("last.doc_key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of equal texts, that of the largest doc_id, all columns kept; of rows that repeat it one, whichever. A
    column may have any name."""
    marks = mark_copies(docs).where("kept")
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)])
    at, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    named = named.withColumn("key", F.coalesce(F.col(at).cast("long"), F.lit(NULL_ID))).withColumn("sha", F.sha2(lowered(text).cast("binary"), 256))
    keep = marks.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.col("text_sha256").alias("sha"))
    kept = named.join(keep, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"])
    return kept.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def lowered(text: str):
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def dedup_report(docs: DataFrame) -> DataFrame:
    """The columns of ``op12``."""
    return mark_copies(docs)


def oracle() -> str:
    return f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """
