"""Filter interaction audit by execution of the permutation trie.

Which rows a filter removes depends on what ran before it. Every order of the filters is a path in a trie; two prefixes that hold
the same filters leave the same survivors, so each unordered prefix is one state, met once. States are visited depth first: a
state's survivors are a persisted DataFrame, one pass over which counts, for each filter not yet applied, what it would remove
here (the edge out of this state); each child's survivors are then filtered from it. At most as many states are held at a time as
there are filters. n filters have 2**n states and n * 2**(n-1) edges in place of n! * n steps.

Rows carry what filters look at (counts of words and characters, the first id of the same text), taken from whole texts once.
Labels that a third of the rows share aren't a key here, counts are partially aggregated, and the counts of all states stay in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, join_counted, released

#: Filters of an audit: its result has a row for each step of each order of them.
MOST_FILTERS = 8
#: Bytes whose words are held at a time.
SPAN = 1 << 20
_WHITE, _UPPER, _SYMBOL = re.compile(rb"[\x20\x09-\x0D]"), bytes(range(ord("A"), ord("Z") + 1)), re.compile(rb"[#$%&*|]")


def count_words(text: bytes, span: int = SPAN) -> tuple[int, int]:
    r"""Words ``[^\x20\x09-\x0D]+`` and distinct ones."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        edge = _WHITE.search(text, at + span) if at + span < len(text) else None
        end = edge.start() if edge else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = batch.column("text").cast(pa.large_string())
            words, upper, symbol = [], [], []
            for t in texts.cast(pa.large_binary()):
                text = t.as_py()
                words.append(count_words(text))
                upper.append(len(text) - len(text.translate(None, _UPPER)))
                symbol.append(_SYMBOL.search(text) is not None)
            counted = [pa.array([n for n, _ in words], pa.int64()), pa.array([d for _, d in words], pa.int64()), pa.array(upper, pa.int64()), pc.utf8_length(texts).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OWN), *counted, pa.array(symbol)], [*_OWN, *_MEASURES])


_OWN, _MEASURES = ("row", "doc_key", "part", "copy"), ("n_words", "n_distinct", "n_upper", "n_chars", "symbol")
_SCHEMA = "row long, doc_key long, part string, copy binary, n_words long, n_distinct long, n_upper long, n_chars long, symbol boolean"

#: When a row of ``measured`` fails, by filter.
FAILS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_upper > 3 * n_chars", "D": "symbol", "E": "doc_key > first_key"}


def measured(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A stored row for each row of ``docs`` (doc_id, text, ``part``): part (null: ''), doc_key, first_key (the smallest id of the same
    text), n_words, n_distinct, n_upper ([A-Z]), n_chars (code points), symbol (whether the text has one of #$%&*|), good, toxic.

    A null text counts as empty. A null id is smaller than all others and has no labels; rows that repeat an id and its text don't
    count as copies of each other. Where ``labels`` (doc_id, quality, toxic) repeats an id, one mark of 1 is enough. Texts are told apart
    by SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_key"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("copy"), text.alias("text"),
    )
    rows = cut(named.mapInArrow(released(_measure), _SCHEMA))
    firsts = cut(rows.groupBy("copy").agg(F.count("*").alias("n"), F.min("doc_key").alias("first_key")))
    rows = join_counted(rows, firsts, ["copy"]).drop("copy", "n")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_key"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    # rows without an id meet no label: they are dealt by their number
    rows = rows.withColumn("salt", F.when(F.col("doc_key") == NULL_ID, F.col("row")).otherwise(0)).join(marks, ["doc_key", "salt"], "left")
    no = F.lit(False)
    return cut(rows.select("part", "doc_key", "first_key", *_MEASURES, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))


def edges(rows: DataFrame, fails: dict[str, str], part: str, losses: dict[str, str]) -> DataFrame:
    """state (bits of the filters applied before, in the order of ``fails``), filter, part, before (rows that reach it), removed, and of
    the removed those that each of ``losses`` holds for: a stored row for each edge of the trie and each part that reaches the edge's
    state."""
    letters, false = list(fails), F.lit(False)
    fails = {f: F.coalesce(F.expr(c), false) for f, c in fails.items()}
    found: dict[int, DataFrame] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        open_ = [(k, f) for k, f in enumerate(letters) if not state >> k & 1]
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            out = [
                F.struct(F.lit(f).alias("filter"), F.count_if(fails[f]).alias("removed"), *[F.count_if(fails[f] & F.coalesce(F.expr(c), false)).alias(name) for name, c in losses.items()])
                for _, f in open_
            ]
            counts = survivors.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("before"), F.array(*out).alias("out"))
            found[state] = cut(counts.select(F.lit(state).alias("state"), "part", "before", F.explode("out").alias("out")).select("state", "part", "before", "out.*"))
            for k, f in open_:
                child = state | 1 << k
                if child not in found and child != (1 << len(letters)) - 1:
                    visit(child, survivors.where(~fails[f]))
        finally:
            survivors.unpersist()

    visit(0, rows)
    return reduce(DataFrame.unionByName, found.values())


def audit(rows: DataFrame, fails: dict[str, str], part: str = "part", losses: dict[str, str] | None = None) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, a column for each of ``losses``, shapley: a row for each
    part, order of the filters and step, zeros included.

    ``fails``: by filter (named by one letter) the condition, in SQL, of a row that fails; null holds for no row. kept: rows left after the step; removed: here; redundant: rows that fail
    this filter and were removed before; unique_fails: rows that fail this filter alone; shapley: what this filter removes, summed over
    all orders. Up to MOST_FILTERS filters. No rows: none."""
    letters, losses = list(fails), losses or {}
    if not 0 < len(letters) <= MOST_FILTERS or any(len(f) != 1 for f in letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one letter")
    taken = edges(rows, fails, part, losses)
    bit = {f: 1 << k for k, f in enumerate(letters)}
    every, n = sum(bit.values()), len(letters)
    orders = [
        ("".join(order), k + 1, f, sum(bit[g] for g in order[:k])) for order in permutations(letters) for k, f in enumerate(order)
    ]
    orders = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, state int")
    size = F.bit_count("state")
    weight = reduce(lambda c, k: c.when(size == k, factorial(k) * factorial(n - 1 - k)), range(1, n), F.when(size == 0, factorial(n - 1)))
    alone = reduce(lambda c, f: c | ((F.col("filter") == f) & (F.col("state") == every ^ bit[f])), letters, F.lit(False))
    total = taken.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("failing"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = zero(F.col("removed"))
    return total.join(F.broadcast(orders), "filter").join(taken, ["part", "filter", "state"], "left").select(
        "part", "filter_order", "step", "filter", (zero(F.col("before")) - removed).alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"),
        F.col("unique_fails").cast("long").alias("unique_fails"), *[zero(F.col(c)).alias(c) for c in losses], F.col("shapley").cast("long").alias("shapley"),
    )


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op11``."""
    return audit(measured(docs, labels), FAILS, losses={"good_lost": "good", "toxic_lost": "toxic"}).drop("filter")


def oracle() -> str:
    """Every order, step and document, in DuckDB."""
    return r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
    firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
    marked AS (
        SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
            + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first_id)::INT AS m,
            coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
        FROM w JOIN firsts USING (t) LEFT JOIN labels USING (doc_id)
    ),
    f AS (SELECT part, m, good, toxic, count(*) AS n FROM marked GROUP BY ALL),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
        WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
    ),
    bits AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
    steps AS (
        SELECT filter_order, step::INT AS step, filter_order[step] AS l, (1 << (ascii(filter_order[step]) - 65)) AS b,
            list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS before
        FROM bits
    ),
    counted AS (
        SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (m & (coalesce(before, 0) | b) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (m & b <> 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (m & b <> 0 AND m & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (m = b), 0)::BIGINT AS unique_fails,
            coalesce(sum(n) FILTER (good AND m & b <> 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
            coalesce(sum(n) FILTER (toxic AND m & b <> 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
        FROM f, steps GROUP BY part, filter_order, step, l
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM counted
    """
