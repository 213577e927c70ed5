"""Substring dedup with difference-cover anchors.

A word is removed if it lies in a window of 20 words whose sequence also starts earlier in the corpus. {0, 1, 3, 9} is a
difference cover modulo 13: for any two places there is an offset below 13 that brings both onto cover positions. So two
equal windows share an aligned anchor: 8 words that begin, in both, at cover positions within the first 13 places. Only
anchors are hashed and shuffled at first; where one recurs, the windows around it are taken (the extension), and these
alone are compared.

Documents are dealt into cells of about CELL_BYTES, by id and text; a Python function holds one cell. A cell sends a row for
each distinct anchor, and later window, however often it holds it. So a passage that a third of all documents share costs one
row for each cell (16 bytes an anchor, 28 a window). The rows of a hash come to a task sorted, and it goes through them holding
one row at a time: whether a neighbour has the same hash, and which row came first, is all that is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, NULL_ID, SECOND, SPAN, Words, _powers, mix64, released, shuffle_partitions, trimmed

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of an anchor's hash: anchors that collide only bring windows that are then told apart.
ANCHOR_BITS = 48
#: Text of a cell; a longer document is a cell of its own or shares one. There are at least CELLS for each shuffle partition.
CELL_BYTES, CELLS = 1 << 21, 4
#: A shorter text can't hold a window: one byte for each word and between two.
LEAST_BYTES = 2 * WINDOW - 1
WORD = r"[^\x20\x09-\x0D]+"


def rolled(words: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """A hash for every run of ``width`` words (of whatever documents), by prefix sums of their hashes."""
    power, inverse = _powers(multiplier)
    n = max(0, len(words) - width + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, SPAN // 2):
        size = min(SPAN // 2, n - at)
        sums = np.zeros(size + width, np.uint64)
        part = words[at : at + size + width - 1]
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[at : at + size] = (sums[width:] - sums[:size]) * inverse[:size]
    return mix64(out)


class Cell:
    """A cell's documents in order of id and text, and their words end to end."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.sort_by([("doc_key", "ascending"), ("tag", "ascending")])
        self.words = Words(self.docs.column("text").cast(pa.large_binary()).to_pylist())
        self.first = self.words.first
        self.sizes = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(self.first[-1]) - self.first[self.owner]
        self.left = self.sizes[self.owner] - self.place
        self.hashes = self.words.hashes(FIRST)

    def column(self, name: str) -> np.ndarray:
        return self.docs.column(name).to_numpy()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and their hashes of ANCHOR_BITS."""
        at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[self.place % PERIOD] & (self.left >= ANCHOR) & (self.sizes[self.owner] >= WINDOW))
        return at, (rolled(self.hashes, ANCHOR, FIRST)[at] >> np.uint64(64 - ANCHOR_BITS)).view(np.int64)

    def windows(self, around: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors within their first PERIOD places."""
        n = len(self.hashes)
        first = np.maximum(around - PERIOD + 1, self.first[self.owner[around]])
        change = np.bincount(first, minlength=n + 1) - np.bincount(around + 1, minlength=n + 1)
        return np.flatnonzero((np.cumsum(change)[:n] > 0) & (self.left >= WINDOW))

    def grouped(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows: the hashes (64 and 32 bits) of each distinct one, the number of the first that is alike, and each one's group."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        h = rolled(self.hashes, WINDOW, FIRST)[at].view(np.int64)
        g = (rolled(self.words.hashes(SECOND), WINDOW, SECOND)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if (same & (g[order][1:] != g[order][:-1])).any():
            order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        return h[order][new], g[order][new], order[new], group


def _send_anchors(docs: pa.Table) -> pa.Table:
    """Each distinct anchor of a cell, twice if it has it more than once."""
    hashes, count = np.unique(Cell(docs).anchors()[1], return_counts=True)
    hashes = np.repeat(hashes, np.minimum(count, 2))
    return pa.table({"cell": pa.repeat(docs.column("cell")[0], len(hashes)), "h": hashes})


def _send_windows(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """Each distinct window around a cell's recurring anchors, with the first document that has it."""
    cell = Cell(docs)
    at, hashes = cell.anchors()
    at = cell.windows(at[np.isin(hashes, hits.column("h").to_numpy())])
    h, g, first, _ = cell.grouped(at)
    order = np.argsort(first)  # rows of a document together, which makes the shuffle's blocks smaller
    h, g, owner = h[order], g[order], cell.owner[at[first[order]]]
    ids = {c: cell.column(c)[owner] for c in ("doc_key", "tag")}
    return pa.table({"cell": pa.repeat(docs.column("cell")[0], len(h)), "h": h, "g": g, **ids})


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, h) in order of h those that share it with another. The last row of a batch waits for the next batch."""
    cell, h, shared = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        cell, h = np.concatenate([cell, batch.column("cell").to_numpy()]), np.concatenate([h, batch.column("h").to_numpy()])
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        before = np.concatenate([[shared], same])
        keep = np.flatnonzero(before[:-1] | same)
        yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(h[keep])], ["cell", "h"])
        cell, h, shared = cell[-1:], h[-1:], before[-1]
    if shared:
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(h)], ["cell", "h"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, h, g, doc_key, tag), in order of all but the cell, those whose document isn't the first with their h and g."""
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, doc, tag = (batch.column(c).to_numpy() for c in ("h", "g", "doc_key", "tag"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        goes_on = first is not None and (h[0], g[0]) == first[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        late = (doc != doc[at]) | (tag != tag[at])
        if goes_on:
            end = len(h) if new[1:].sum() == 0 else 1 + int(np.argmax(new[1:]))
            late[:end] = (doc[:end] != first[2]) | (tag[:end] != first[3])
        keep = np.flatnonzero(late)
        yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(keep)), pa.array(h[keep])], ["cell", "h"])
        if not (goes_on and at[-1] == 0):
            first = (h[-1], g[-1], doc[at[-1]], tag[at[-1]])


def _finish(docs: pa.Table, later: pa.Table, columns: list[str]) -> pa.Table:
    """A cell's documents without the windows that an earlier cell has, and those that the cell has earlier itself."""
    cell = Cell(docs)
    n = len(cell.hashes)
    at = np.flatnonzero(cell.left >= WINDOW)
    h, _, first, group = cell.grouped(at)
    # within a cell 64 bits tell windows apart
    lost = np.isin(h, later.column("h").to_numpy(), assume_unique=False, kind="sort")
    # the first of its sequence stays, and so do its likes in rows that repeat the document
    doc, tag, f = cell.column("doc_key")[cell.owner[at]], cell.column("tag")[cell.owner[at]], first[group]
    gone = at[lost[group] | (doc != doc[f]) | (tag != tag[f]) | (cell.place[at] != cell.place[at[f]])]
    change = np.zeros(n + 1, np.int32)
    change[gone] += 1
    change[gone + WINDOW] -= 1
    removed = np.cumsum(change)[:n] > 0
    sums = np.concatenate([[0], np.cumsum(removed)])
    n_removed = sums[cell.first[1:]] - sums[cell.first[:-1]]
    # kept words with the one byte behind each, but for a text's last
    kept = np.flatnonzero(~removed)
    begins, ends = cell.words.begins[kept], cell.words.ends[kept] + 1
    last = np.ones(len(kept), bool)
    last[:-1] = cell.owner[kept][1:] != cell.owner[kept][:-1]
    ends = ends - last
    change = np.zeros(len(cell.words.data) + 1, np.int8)
    change[begins] += 1
    change[ends] -= 1
    data = cell.words.data[np.cumsum(change[:-1], dtype=np.int8) > 0]
    data = np.where((data >= 9) & (data <= 13), 32, data).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])[np.searchsorted(kept, cell.first)]
    texts = pa.LargeStringArray.from_buffers(len(cell.sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    out = [cell.docs.column(c) for c in columns]
    return pa.table([*out, pa.array(cell.sizes), pa.array(n_removed), texts], [*columns, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with n_words, n_removed and kept_text (columns of these names are replaced).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word is removed if a window of 20 words of its document covers it whose sequence also
    starts earlier: in a document of a smaller id, or before it in the same one; all windows are judged on the input. A null text
    has no words; kept_text is then ''. A null id comes before all others; one that is no number fails, or is null where the
    session's ANSI mode is off. Rows that repeat an id and its text are one document; of different texts under one id that with the
    smaller hash counts as earlier. A very long text is a cell of its own and is held whole. Rows alike in all columns share a cell.
    No rows: none. Words are compared by hashes of 96 bits of a window."""
    spark = docs.sparkSession
    new = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in new]
    partitions = shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")).alias("n")).first()["n"] or 0
    cells = max(CELLS * partitions, -(-size // CELL_BYTES))
    doc_key = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], doc_key.alias("doc_key"))
    named = named.withColumnRenamed(f"c{kept.index(text)}", "text").withColumn("tag", F.xxhash64("text"))
    own = [f.name for f in named.schema.fields if f.name not in ("doc_key", "tag")]
    by = [f.name for f in named.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    has_windows = F.coalesce(F.octet_length("text"), F.lit(0)) >= LEAST_BYTES
    dealt = named.where(has_windows).withColumn("cell", F.pmod(F.xxhash64(*by), F.lit(cells))).repartition(partitions, "cell")

    anchors = dealt.groupBy("cell").applyInArrow(trimmed(_send_anchors), "cell long, h long")
    recurring = anchors.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(released(_recurring), "cell long, h long")
    windows = dealt.groupBy("cell").cogroup(recurring.groupBy("cell")).applyInArrow(trimmed(_send_windows), "cell long, h long, g int, doc_key long, tag long")
    ordered = windows.repartition(partitions, "h", "g").sortWithinPartitions("h", "g", "doc_key", "tag")
    later = ordered.mapInArrow(released(_later), "cell long, h long")
    schema = "".join(f"`{c}` {named.schema[c].dataType.simpleString()}, " for c in own)
    finish = trimmed(lambda left, right: _finish(left, right, own))
    long = dealt.groupBy("cell").cogroup(later.groupBy("cell")).applyInArrow(finish, f"{schema}n_words long, n_removed long, kept_text string")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1)
    short = named.where(~has_windows).select(*own, F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("kept_text"))
    out = long.unionByName(short)
    return out.select(*[F.col("text" if c == text else f"c{i}").alias(c) for i, c in enumerate(kept)], *new)


def dedup_report(docs: DataFrame) -> DataFrame:
    """The columns of ``op4``."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out: a text that lost words is its kept words, joined by one space, and n_chars, if
    there, its new length; documents that lost all their words go."""
    found = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    found = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """All windows of all documents, in DuckDB."""
    return rf"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM words WHERE len(w) >= {WINDOW}),
    windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h FROM starts),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows),
    gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS i FROM ranked WHERE k > 1) GROUP BY doc_id),
    marked AS (SELECT words.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, w, g FROM words LEFT JOIN gone USING (doc_id)),
    kept AS (
        SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS t
        FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) words
        LEFT JOIN (SELECT doc_id, unnest(g) AS i, true AS removed FROM gone) USING (doc_id, i) WHERE removed IS NULL GROUP BY words.doc_id
    )
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM marked LEFT JOIN kept USING (doc_id)
    """
