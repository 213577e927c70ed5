"""Prefix trie of conversations.

Turns become digests, and equal conversations one sequence with the number and ends of its members. Sequences are dealt by the digest
of their first turn; a Python function builds a pointer trie (a dictionary of children for each node) of each dealt group and sums its
subtrees by an iterative postorder. A subtree of more than MOST sequences isn't built by one function: its top, and whatever all of
its sequences share behind it, are nodes of the spine, and its sequences are dealt anew by their next turn, and so on. The spine's sums
are those of the subtrees below it, level by level.

The root is the first node of the spine. Only digests are moved (40 bytes a turn), in one row a conversation; so a single conversation
must fit into a task, and a built group holds at most MOST of them. Members that end at a node are hashed in ascending order in one
pass over packed pieces of the list, so that a conversation that a third of all repeat is neither a row each nor held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, released, shuffle_partitions

#: Sequences of a subtree that is built whole.
MOST = 256
#: Turns of a bucket, which one call of the building function gets; a bucket holds whole groups.
BUCKET_TURNS = 4_096
#: Ids of a piece of a member list.
PIECE = 4_096
#: Modulus of shared heads, and of their length.
FAMILY, HEAD = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, bytes), one row for each conv_id that isn't null. Turns are ordered by ``turn``, null first, and
    turns of one number by digest; repeated rows are turns of their own. A null role or text counts as empty. Turns are told apart by 128
    bits of a SHA-256 over the length of the role, the role and the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256), 1, 32)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), told.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 5, all if it has fewer and none if it isn't there, then its own
    behind its first h; h is crc32(c as text) % 9. The remainder has the sign of c, as in SQL."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEAD - 1).alias("head"))
    own = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "turns", h.alias("h"))
    none = F.slice("turns", 1, F.lit(0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    rebuilt = F.concat(F.when(F.col("head").isNull(), none).otherwise(F.slice("head", 1, F.col("h"))), rest)
    return own.join(heads, "family", "left").select("conv_id", rebuilt.alias("turns"))


def hashed_lists(members: DataFrame) -> DataFrame:
    """key, ends: of ``members`` (key, conv_id) the SHA-256 in hex of each key's ids, ascending and joined by commas. Ids are sorted over all
    partitions and packed into pieces of PIECE; a task reads a key's pieces one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, int, list[int]] | None = None
        for batch in batches:
            out = []
            for key, one in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held is None or held[0] != key or len(held[2]) >= PIECE:
                    out += [held] if held else []
                    held = (key, one, [])
                held[2].append(one)
            if out:
                yield packed(out)
        if held:
            yield packed([held])

    def packed(some: list[tuple[str, int, list[int]]]) -> pa.RecordBatch:
        columns = [pa.array([k for k, _, _ in some]), pa.array([a for _, a, _ in some], pa.int64()), pa.array([",".join(map(str, ids)) for _, _, ids in some])]
        return pa.RecordBatch.from_arrays(columns, ["key", "first", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    out += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.array([h for _, h in out])], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])

    spread = shuffle_partitions(members.sparkSession)
    pieces = members.repartitionByRange(spread, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(released(pack), "key string, first long, ids string")
    return pieces.repartition(spread, "key").sortWithinPartitions("key", "first").mapInArrow(released(run), "key string, ends string")


def sequences(rebuilt: DataFrame) -> DataFrame:
    """Of ``rebuilt`` (conv_id, turns), stored: key (a digest of the sequence of turns), n (its members), conv_id (the smallest), ends (the
    digest of their ids), turns: a row for each distinct sequence."""
    told = F.sha2(F.array_join(F.transform("turns", lambda t: t["d"]), "").cast("binary"), 256)
    rebuilt = cut(rebuilt.withColumn("key", told))
    counted = rebuilt.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return cut(rebuilt.drop("key").join(counted, "conv_id").join(hashed_lists(rebuilt.select("key", "conv_id")), "key"))


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """The tries of some groups of sequences (up, depth, parent, n, conv_id, ends, turns). A group's top has the depth ``depth``."""
    depth, parent, first, members, size, ends, children, up = [], [], [], [], [], [], [], []
    tops: dict[tuple, int] = {}
    for u, d, p, n, c, e, turns in zip(*(group[k] for k in ("up", "depth", "parent", "n", "conv_id", "ends", "turns")), strict=True):
        at = -1
        for k in range(d - 1, len(turns)):
            # dictionaries of pointers: tops of the groups, then each node's own
            at, told, names = (-1, (u, turns[k]["d"]), tops) if k == d - 1 else (at, turns[k]["d"], children[at])
            node = names.get(told)
            if node is None:
                node = names[told] = len(depth)
                depth.append(k + 1)
                parent.append(at)
                first.append(c)
                members.append(0)
                size.append(turns[k]["n"])
                ends.append(_EMPTY)
                children.append({})
                up.append((u, p) if k == d - 1 else (None, None))
            members[node] += n
            first[node] = min(first[node], c)
            at = node
        ends[at] = e
    leaves, saved = [0] * len(depth), [0] * len(depth)
    # postorder without recursion: a node's number is larger than its parent's
    for node in range(len(depth) - 1, -1, -1):
        leaves[node] += not children[node]
        saved[node] += (members[node] - 1) * size[node]
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    above = [first[p] if p >= 0 else u[1] for p, u in zip(parent, up, strict=True)]
    found = {"conv_id": first, "depth": depth, "parent_conv_id": above, "n_convs": members, "n_children": list(map(len, children)), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends}
    return pd.DataFrame(found | {"up": [u for u, _ in up]})


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _spine(open_: DataFrame) -> DataFrame:
    """Of groups (up, depth, parent, path, size, and of each sequence key, n, conv_id, ends, turns): a row for each, with the turns from depth
    to the last that all of its sequences share, and the digest of those that end there."""
    digests = F.transform("turns", lambda t: t["d"])
    # the first and the last sequence in order share no more than all do
    groups = open_.groupBy("path", "up", "depth", "parent").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct(digests.alias("d"), "turns", "ends")).alias("low"), F.max(F.struct(digests.alias("d"))).alias("high")
    )
    low, high = F.col("low.d"), F.col("high.d")
    least = F.least(F.size(low), F.size(high))
    places = F.sequence(F.lit(0), least)
    differs = F.filter(places, lambda i: (i < least) & ~F.get(low, i).eqNullSafe(F.get(high, i)))
    shared = F.least(F.coalesce(F.get(differs, F.lit(0)), least), least)
    groups = groups.withColumn("last", shared)
    return groups.select(
        "path", "up", "depth", "parent", "n_convs", "conv_id", "last", F.transform(F.slice("low.turns", 1, F.col("last")), lambda t: t["n"]).alias("bytes"),
        F.when(F.size(low) == F.col("last"), F.col("low.ends")).otherwise(F.lit(_EMPTY)).alias("ends"),
    )


def trie(turns: DataFrame, most: int = MOST, bucket_turns: int = BUCKET_TURNS, rebuild=with_shared_heads) -> DataFrame:
    """A row for each node of the prefix trie of the conversations in ``turns`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first ``depth`` turns (role and text); conv_id is its smallest member. The root, of depth 0, has
    every conversation, its parent is null. n_leaves: nodes without children in its subtree, itself included; saved_tokens: over its
    subtree, (n_convs - 1) times the bytes of the last text; ends_sha256: of the ids, ascending and joined by commas, of the members
    that have no further turn (none: of ''). Turns without a conv_id belong to no conversation and are left out; ties, nulls and repeated
    rows are as in ``conversations``. A conversation is rebuilt first (``rebuild``: any function of conv_id and turns). No conversation:
    no rows. Other columns are left out."""
    spark = turns.sparkSession
    all_ = sequences(rebuild(conversations(turns)))
    # the root is open from the start: an open group's sequences go on by their next turn
    path = lambda last: F.sha2(F.concat(F.col("path"), F.get("turns", last)["d"]).cast("binary"), 256)
    open_ = cut(all_.select("*", F.lit("").alias("path"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    spines, closed = [], []
    while not open_.isEmpty():
        spine = cut(_spine(open_))
        spines.append(spine)
        sizes = open_.groupBy("path").agg(F.count("*").alias("size"))
        on = spine.select("path", "last", F.col("conv_id").alias("above")).join(sizes, "path")
        dealt = join_counted(open_, cut(on), ["path"], "size").where(F.size("turns") > F.col("last"))
        dealt = dealt.select("key", "n", "conv_id", "ends", "turns", path(F.col("last")).alias("path"), F.col("path").alias("up"), (F.col("last") + 1).alias("depth"), F.col("above").alias("parent"))
        dealt = cut(dealt)
        counts = cut(dealt.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.size("turns")).alias("turns_")))
        sized = join_counted(dealt, counts, ["path"], "size")
        closed.append(sized.where(F.col("size") <= most).drop("size", "turns_"))
        open_ = cut(sized.where(F.col("size") > most).drop("size", "turns_"))
    if not spines:
        return spark.createDataFrame([], _NODE)
    groups = reduce(DataFrame.union, closed)
    total = groups.agg(F.sum(F.size("turns")).alias("n")).first()["n"] or 0
    buckets = max(shuffle_partitions(spark), -(-total // bucket_turns))
    below = groups.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).groupBy("bucket").applyInPandas(_build, f"{_NODE}, up string")
    below = cut(below)
    nodes = [below.drop("up")]
    tops = below.where("up is not null").select("up", "n_leaves", "saved_tokens")
    for spine in reversed(spines):
        sums = tops.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        chain = spine.join(sums.withColumnRenamed("up", "path"), "path", "left").fillna(0, ["n_children", "n_leaves", "below"])
        at = F.explode(F.sequence("depth", "last")).alias("at")
        # the bytes of the turns at .. last, of which the root's is none
        mine = F.aggregate(F.slice("bytes", F.greatest("at", F.lit(1)), F.col("last") - F.greatest("at", F.lit(1)) + 1), F.lit(0).cast("long"), lambda a, b: a + b)
        chain = chain.select("*", at).withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * mine)
        end = F.col("at") == F.col("last")
        chain = cut(chain.select(
            "conv_id", F.col("at").cast("long").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(end, F.col("n_children")).otherwise(1).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
            F.when(end, F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"), F.when(F.col("at") == F.col("depth"), F.col("up")).alias("up"),
        ))
        nodes.append(chain.drop("up"))
        tops = tops.union(chain.where("up is not null").select("up", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, nodes)


def trie_report(turns: DataFrame) -> DataFrame:
    """The columns of ``op13``."""
    return trie(turns)


def oracle() -> str:
    """Every prefix of every rebuilt conversation, in DuckDB. crc32 goes by half bytes: a digit d is the byte 0x30 + d."""
    table = ", ".join(str(_half(k)) for k in range(16))
    return f"""
    WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY k) AS t FROM turns GROUP BY conv_id),
    sums AS (
        SELECT *, xor(list_reduce(
            list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [(ascii(d) & 15)::BIGINT, (ascii(d) >> 4)::BIGINT]))),
            lambda crc, half: xor([{table}][(xor(crc, half) & 15) + 1]::BIGINT, crc >> 4)), 4294967295::BIGINT) % {HEAD} AS h
        FROM own
    ),
    rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM sums a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
    prefixes AS (
        SELECT conv_id, d, len(t) AS len, md5(to_json(t[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(t[1:d - 1])::VARCHAR) END AS parent, CASE WHEN d > 0 THEN strlen(t[d].t) ELSE 0 END AS bytes
        FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
    ),
    nodes AS (
        SELECT node, d, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256
        FROM prefixes GROUP BY node, d
    ),
    children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
    -- each node counts at all prefixes of its smallest member up to itself
    above AS (
        SELECT p.node, p.d, sum((w.n_children = 0)::INT)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.bytes)::BIGINT AS saved_tokens
        FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.node, p.d
    )
    SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
    FROM whole w JOIN above USING (node, d) LEFT JOIN nodes p ON p.node = w.parent AND p.d = w.d - 1
    """


def _half(k: int) -> int:
    """What half a byte adds to a crc32, by the reversed polynomial."""
    for _ in range(4):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k
