"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over single features, then over the pairs of features that explain most of what is left.
Each tree only moves a lookup table over a feature's (or a pair's) bins; the trees themselves aren't kept. A document's
score is the sum of its bins' entries, put through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, remainder_of_id

FOLD, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: The model is fitted on about so many labelled documents at most (a documented bound; by hash of the id).
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 64, 16, 8
ROUNDS, RATE, SHRINK, LEAST = 150, 0.1, 1.0, 20

FEATURES = (
    "log_words", "word_chars", "distinct_words", "repeated_next", "upper", "lower", "digits", "marks", "symbols", "bars", "wide",
    "sentence_ends", "words_a_sentence", "capitalised", "log_lines", "line_chars", "repeated_lines", "marked_words", "top_word", "spaces",
)
_CLASSES = np.zeros((9, 256))
for _row, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!\"'(),-.:;?", b"#$%&*+/<=>@[\\]^_`{}~", b"|", range(128, 256), b".!?", b" ")):
    _CLASSES[_row, list(_set)] = 1


def describe(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for null or empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    upper, lower, digits, marks, symbols, bars, wide, ends, spaces = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    last = [w[-1] for w in words]
    return [
        np.log1p(n), sum(map(len, words)) / n, len(counts) / n, sum(map(eq, words, words[1:])) / n, upper / size, lower / size, digits / size,
        marks / size, symbols / size, bars / size, wide / size, ends / n, n / (1 + ends), sum(65 <= w[0] <= 90 for w in words) / n,
        np.log1p(len(lines)), np.log1p(size / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(not (c > 127 or 97 <= c <= 122 or 65 <= c <= 90 or c in b".,") for c in last) / n, max(counts.values()) / n, spaces / size,
    ]


@dataclass
class Model:
    """Bin edges of each feature, lookup tables of features and of pairs, intercept."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def coarse(self, b: np.ndarray, k: int) -> np.ndarray:
        return b[:, k] * PAIR_BINS // (len(self.edges[k]) + 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse(b, i), self.coarse(b, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _gain(g, h):
    return g * g / (h + SHRINK)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0: none."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_n < LEAST) | (n.sum() - left_n < LEAST)] = 0
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step for each bin: the leaves of a tree of two levels."""
    out, cuts = np.zeros(len(g)), {0, len(g)}
    _, k = _split(g, h, n)
    if k:
        cuts |= {k}
        for a, b in ((0, k), (k, len(g))):
            _, inner = _split(g[a:b], h[a:b], n[a:b])
            if inner:
                cuts.add(a + inner)
    cuts = sorted(cuts)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and a step for each cell: a cut along one feature, then on each side a cut along the other; the better order."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        out, total = np.zeros_like(a), 0.0
        _, k = _split(a.sum(1), b.sum(1), c.sum(1))
        for p, q in ((0, k), (k, len(a))) if k else ((0, len(a)),):
            _, m = _split(a[p:q].sum(0), b[p:q].sum(0), c[p:q].sum(0))
            for r, s in ((0, m), (m, a.shape[1])) if m else ((0, a.shape[1]),):
                gs, hs = a[p:q, r:s].sum(), b[p:q, r:s].sum()
                out[p:q, r:s] = gs / (hs + SHRINK)
                total += _gain(gs, hs)
        total -= _gain(g.sum(), h.sum())
        if total > best[0]:
            best = (total, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of label 1's log odds. No rows: 0 throughout; one label only: its smoothed share throughout."""
    model = Model()
    if not len(x):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
    b = model.bins(x)
    f = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    sums = lambda at, size, v: np.bincount(at, v, minlength=size)
    sizes = [np.bincount(b[:, k], minlength=len(t)) for k, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(sums(b[:, k], len(t), g), sums(b[:, k], len(t), h), sizes[k])
            t += step
            f += step[b[:, k]]
    cells = {}
    g, h = slopes()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            at = model.coarse(b, i) * PAIR_BINS + model.coarse(b, j)
            grid = [sums(at, PAIR_BINS**2, v).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)] + [np.bincount(at, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)]
            gains.append((_pair_tree(*grid)[0], (i, j)))
    model.pairs = [p for gain, p in sorted(gains, key=lambda v: (-v[0], v[1]))[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for i, j in model.pairs:
        cells[i, j] = model.coarse(b, i) * PAIR_BINS + model.coarse(b, j)
    counts = {p: np.bincount(at, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for p, at in cells.items()}
    for _ in range(ROUNDS // 3):
        for p, t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            grid = (sums(cells[p], PAIR_BINS**2, v).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            step = RATE * _pair_tree(*grid, counts[p])[1]
            t += step
            f += step.ravel()[cells[p]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that aren't held out, about ``sample`` of them at most (rows of an id go or stay together).

    Labels without an id, or other than 0 and 1, are left out; so are documents without an id. An id with several labels or
    documents counts once for each pair of them. Rows are sorted before the fit, so that their order and partitions don't matter."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("y")).where("label_id is not null and y in (0, 1)")
    marked = marked.where(remainder_of_id("label_id", FOLD) != HELD_OUT)
    n = marked.count()
    if not n:
        return Model()
    marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < min(1 << 20, -(-sample * (1 << 20) // n)))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"].array, "y": batch["y"].array, "x": [describe(t) for t in batch["text"]]})

    found = sorted(rows.mapInPandas(released(run), "id long, y double, x array<double>").collect())  # the bounded sample
    return fit(np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found], dtype=float))


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1, higher: label 1 likelier), predicted (1 from THRESHOLD up) for each row of ``docs``.

    Null and empty texts have all features 0 and are scored as such. Very long texts count whole; equal texts get equal scores;
    repeated rows stay. No labels: 0.5 throughout. No rows: none. Other columns are left out."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([describe(t if isinstance(t, str) else None) for t in batch], dtype=float).reshape(len(batch), len(FEATURES))
            score = model.score(x)
            yield pd.DataFrame({"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    found = F.pandas_udf(released(run), "score double, predicted int").asNondeterministic()  # evaluated once; keys don't pass through Python
    rows = docs.select(F.col(f"`{key}`").alias("key"), found(F.col(f"`{text}`")).alias("found"))
    return rows.select(F.col("key").alias(key), "found.score", "found.predicted")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op2``."""
    found = classify(docs, train(docs, labels))
    return found.select("doc_id", (remainder_of_id("doc_id", FOLD) == HELD_OUT).alias("held_out"), "score", "predicted")
