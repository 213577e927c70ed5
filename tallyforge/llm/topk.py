"""Exact top-k search by inner product, block at a time.

Components are integers, floor(64 x). Vectors are ordered by cluster and id and cut into blocks, each a forward index of its
vectors with the maximum and minimum of every component (term). A query's bound for a block is the sum of its terms' best
contributions. Blocks of the highest bounds are scored first, the square root of their number; the kth result among
these prunes every block whose bound falls below, and the rest is scored. Ties go to the smaller id, so a block whose bound only equals the kth score is pruned too if all its
ids are larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

SCALE, TOP, EVERY = 64, 20, 20
#: Vectors of a block, blocks of a chunk of summaries, queries of a pack.
BLOCK, CHUNK, PACK = 512, 2048, 512
#: The clusters that order the vectors are fitted on about so many of them (by hash of the id), in so many rounds.
SAMPLE, ROUNDS, MOST_CLUSTERS = 4096, 6, 256


def _packed(v: np.ndarray) -> bytes:
    """int16 if it fits (marked by an odd length), else int64."""
    small = v.astype(np.int16)
    return small.tobytes() + b"\x00" if np.array_equal(small, v) else v.astype(np.int64).tobytes()


def _unpacked(raw: bytes, dim: int, n: int) -> np.ndarray:
    v = np.frombuffer(raw, np.int16, n * dim) if len(raw) % 2 else np.frombuffer(raw, np.int64, n * dim)
    return v.reshape(n, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, [row of a, row of b]: in doubles where none can reach 2**53, else in integers; beyond 64 bits the largest or
    smallest 64-bit number."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def whole(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, dim, v: vectors as integers; rows without an id, a vector, or with a null or non-finite component are left out."""
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("x")).where("key is not null and x is not null")
    rows = rows.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return rows.select("key", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By number of components, the centres of a few rounds of k-means on a bounded sample; they order the vectors, nothing else."""
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in counts.items():
        share = min(1 << 20, -(-SAMPLE * (1 << 20) // n))
        rows = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share)).select("v").limit(2 * SAMPLE).collect()
        x = np.array(sorted(r["v"] for r in rows), dtype=np.float64).reshape(len(rows), dim)
        x = np.unique(x, axis=0)
        k = min(max(1, n // (2 * BLOCK)), MOST_CLUSTERS, len(x))
        c = x[np.random.default_rng(3).permutation(len(x))[:k]] if k else x
        for _ in range(ROUNDS if k > 1 else 0):
            nearest = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            sizes = np.bincount(nearest, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        out[dim] = c
    return out


def index(vectors: DataFrame) -> DataFrame:
    """block_id, dim, n, least (id), ids, vectors, high, low: every vector, in blocks."""
    centres = _centres(vectors)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, packed = np.zeros(len(batch), np.int64), [b""] * len(batch)
            for dim, rows in batch.groupby("dim").indices.items():
                v = np.array([batch["v"].iloc[r] for r in rows], dtype=np.int64).reshape(len(rows), dim)
                c = centres.get(dim)
                if c is not None and len(c) > 1:
                    cluster[rows] = ((c**2).sum(1) - 2 * v @ c.T).argmin(1)
                for r, one in zip(rows, v, strict=True):
                    packed[r] = _packed(one)
            yield pd.DataFrame({"dim": batch["dim"].array, "cluster": cluster, "key": batch["key"].array, "v": packed})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 33, None

        def made(part: pd.DataFrame):
            nonlocal number
            dim, n = int(part["dim"].iloc[0]), len(part)
            v = np.concatenate([_unpacked(raw, dim, 1) for raw in part["v"]])
            number += 1
            ids = part["key"].to_numpy(np.int64)
            return (number - 1, dim, n, int(ids.min()), ids.tobytes(), _packed(v), _packed(v.max(0)), _packed(v.min(0)))

        def emit(part: pd.DataFrame, last: bool):
            """Blocks of one cluster each; but for the last call, what may go on is kept."""
            out, keys = [], part[["dim", "cluster"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(part)]])
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                final = last or k < len(cuts) - 2
                while b - a >= BLOCK or (final and b > a):
                    out.append(made(part.iloc[a : min(b, a + BLOCK)]))
                    a = min(b, a + BLOCK)
                if not final:
                    return out, part.iloc[a:b]
            return out, None

        columns = ["block_id", "dim", "n", "least", "ids", "vectors", "high", "low"]
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(part):
                out, rest = emit(part, False)
                if out:
                    yield pd.DataFrame(out, columns=columns)
        if rest is not None and len(rest):
            yield pd.DataFrame(emit(rest, True)[0], columns=columns)

    ordered = vectors.mapInPandas(assign, "dim int, cluster long, key long, v binary")
    ordered = cut(ordered).repartitionByRange(shuffle_partitions(vectors.sparkSession), "dim", "cluster", "key").sortWithinPartitions("dim", "cluster", "key")
    return cut(ordered.mapInPandas(blocks, "block_id long, dim int, n int, least long, ids binary, vectors binary, high binary, low binary"))


def _pruned(pairs: DataFrame, best_only: bool) -> DataFrame:
    """For packs of queries against chunks of block summaries: block_id and the queries (ids, vectors, kth score and id) to be
    scored in it: those whose bound reaches their kth result; or, at first, of a chunk's n blocks the sqrt(n) of highest bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, queries, blocks in zip(batch["dim"], batch["queries"], batch["blocks"], strict=True):
                q = np.concatenate([_unpacked(x["v"], dim, 1) for x in queries]) if dim else np.zeros((len(queries), 0), np.int64)
                high, low = (np.concatenate([_unpacked(x[c], dim, 1) for x in blocks]) if dim else np.zeros((len(blocks), 0), np.int64) for c in ("high", "low"))
                bound = products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)
                if best_only:
                    m = math.isqrt(len(blocks) - 1) + 1
                    wanted = np.zeros(bound.shape, bool)
                    np.put_along_axis(wanted, np.argpartition(-bound, m - 1, axis=1)[:, :m], True, axis=1)
                else:
                    kth, kth_id = (np.array([x[c] for x in queries], dtype=np.int64) for c in ("kth", "kth_id"))
                    least = np.array([x["least"] for x in blocks], dtype=np.int64)
                    wanted = (bound > kth[:, None]) | ((bound == kth[:, None]) & (least[None, :] <= kth_id[:, None]))
                rows = []
                for b in np.flatnonzero(wanted.any(0)):
                    k = np.flatnonzero(wanted[:, b])
                    rows.append((blocks[b]["block_id"], *(np.array([queries[i][c] for i in k], dtype=np.int64).tobytes() for c in ("key", "kth", "kth_id")), _packed(q[k])))
                if rows:
                    yield pd.DataFrame(rows, columns=["block_id", "query_ids", "kth", "kth_id", "queries"])

    return pairs.mapInPandas(run, "block_id long, query_ids binary, kth binary, kth_id binary, queries binary")


def _scored(wanted: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of each block, each query's best results that reach its kth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, query_ids, kth, kth_id = (np.frombuffer(x, np.int64) for x in (r.ids, r.query_ids, r.kth, r.kth_id))
                v, q = _unpacked(r.vectors, r.dim, len(ids)), _unpacked(r.queries, r.dim, len(query_ids))
                order = np.argsort(ids, kind="stable")  # so that ties come out by id
                ids, score = ids[order], products(q, v[order])
                good = (score > kth[:, None]) | ((score == kth[:, None]) & (ids[None, :] <= kth_id[:, None]))
                good &= ids[None, :] != query_ids[:, None]
                rows, columns = np.nonzero(good)
                values = score[rows, columns]
                best = np.lexsort((ids[columns], -values, rows))
                rows, columns, values = rows[best], columns[best], values[best]
                first = np.searchsorted(rows, np.arange(len(query_ids)))
                top = np.arange(len(rows)) - first[rows] < k
                yield pd.DataFrame({"query_id": query_ids[rows[top]], "vec_id": ids[columns[top]], "score": values[top]})

    joined = wanted.join(blocks.select("block_id", "dim", "ids", "vectors"), "block_id")
    return joined.mapInPandas(run, "query_id long, vec_id long, score long")


def search(table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products with the rows of ``table``, ties to the smaller id.

    A row of the query's own id is no candidate. Rows without an id or a vector, or with a null or non-finite component, take
    no part, nor do candidates of another number of components. A repeated row is a candidate each time; a query of a repeated
    id is asked once, with the smallest of its vectors. Components
    and products beyond 64 bits are the largest (or smallest) 64-bit number. No queries or no candidates: no rows."""
    spark = table.sparkSession
    blocks = index(whole(table, key, vector))
    asked = cut(whole(queries, key, vector).groupBy("key", "dim").agg(F.min("v").alias("v")))
    one = asked.groupBy("key").agg(F.min("dim").alias("dim"))
    asked = asked.join(one, ["key", "dim"])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[_packed(np.asarray(v, dtype=np.int64)) for v in batch["v"]])

    asked = cut(asked.select("key", "dim", "v").mapInPandas(packed, "key long, dim int, v binary"))
    n_blocks, n_queries = blocks.count(), asked.count()
    chunks, packs = max(1, -(-n_blocks // CHUNK)), max(1, -(-n_queries // PACK), min(n_queries // 32, 2 * shuffle_partitions(spark)))
    summaries = blocks.groupBy("dim", F.pmod(F.xxhash64("block_id"), F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("block_id", "least", "high", "low"))).alias("blocks"))

    def paired(known: DataFrame) -> DataFrame:
        pack = F.pmod(F.xxhash64("key"), F.lit(packs)).alias("pack")
        grouped = known.groupBy("dim", pack).agg(F.collect_list(F.struct("key", "v", "kth", "kth_id")).alias("queries"))
        sent = grouped.select("dim", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
        return sent.join(summaries, ["dim", "chunk"]).repartition(shuffle_partitions(spark))

    lowest, highest = -(2**63), 2**63 - 1
    first = _scored(_pruned(paired(asked.withColumn("kth", F.lit(lowest)).withColumn("kth_id", F.lit(highest))), True), blocks, k)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("key"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    known = cut(asked.join(kth, "key", "left").na.fill({"kth": lowest, "kth_id": highest}))
    found = _scored(_pruned(paired(known), False), blocks, k)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(table: DataFrame) -> DataFrame:
    """The rows of ``op8``: every vector whose id is divisible by 20 against all others."""
    vectors = table.select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def oracle() -> str:
    return f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT::DOUBLE) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
    """
