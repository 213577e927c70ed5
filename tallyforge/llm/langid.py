"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter's vector is permuted (rotated) by its place in the n-gram, and the
three are bound by multiplication into the n-gram's vector. A document bundles (adds) the vectors of its n-grams, a
language's prototype bundles those of its training documents, and the document gets the language of the closest prototype
by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, remainder_of_id

#: Components of a vector; symbols that letters are mapped to (0: between words); letters of an n-gram.
SIZE, SYMBOLS, GRAM = 1024, 128, 3
#: At most about so many training documents are read for each language (a documented bound; by hash of the id).
TRAINING_DOCS = 2000
#: How steeply a cosine's lead over the others turns into a score.
SHARPNESS = 24.0
#: n-grams whose vectors are at hand at once.
MOST_GRAMS = 4096
UNKNOWN = "und"


def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(20260101).choice(np.array([-1, 1], np.int8), (SYMBOLS, SIZE))


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 65,536: a to z are 1 to 26, other letters share 27 to 127 by code point (so the letters
    of an alphabet of up to 101 differ), the rest 0."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            out[cp] = cp - 96 if "a" <= c <= "z" else 27 + cp % (SYMBOLS - 27)
    return out


class Encoder:
    """Counts of n-grams and their bundles for a batch of texts."""

    def __init__(self):
        self.table = _symbol_table()
        letters = _letter_vectors()
        self.letters = [np.roll(letters, k, axis=1) for k in range(GRAM)]
        self.place = np.full(SYMBOLS**GRAM, -1, np.int32)
        self.items = np.empty((0, SIZE), np.float32)

    def _items(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the item memory for n-gram codes; vectors not yet made are made and kept."""
        new = grams[self.place[grams] < 0]
        if len(self.items) + len(new) > 8192:  # few vectors fit in memory: keep those of this batch
            self.place[:] = -1
            self.items = np.empty((0, SIZE), np.float32)
            new = grams
        if len(new):
            made = self.letters[2][new % SYMBOLS] * self.letters[1][new // SYMBOLS % SYMBOLS] * self.letters[0][new // SYMBOLS**2]
            self.place[new] = len(self.items) + np.arange(len(new))
            self.items = np.concatenate([self.items, made.astype(np.float32)])
        return self.items[self.place[grams]]

    def symbols(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.table[np.minimum(codes, 0xFFFF)]
        for k in np.flatnonzero(codes > 0xFFFF):
            found[k] = 27 + int(codes[k]) % (SYMBOLS - 27) if chr(codes[k]).isalpha() else 0
        return found

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[text, component] bundles, and which texts have a letter. Between words there is one boundary symbol."""
        parts, has = [], np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            s = self.symbols(t)
            has[k] = s.any()
            keep = s > 0
            keep[1:] |= s[:-1] > 0
            parts.append(np.concatenate([[0], s[keep], [0]]).astype(np.int32))
        out = np.zeros((len(texts), SIZE), np.float32)
        at = 0
        while at < len(texts):  # so many texts at a time that their counts take little memory
            end, total = at, 0
            while end < len(texts) and (end == at or (end - at < 256 and total + len(parts[end]) <= 1 << 20)):
                total += len(parts[end])
                end += 1
            coded = [p[:-2] * SYMBOLS**2 + p[1:-1] * SYMBOLS + p[2:] for p in parts[at:end]]
            rows = np.repeat(np.arange(end - at), [len(c) for c in coded])
            codes = np.concatenate(coded)
            seen = np.zeros(SYMBOLS**GRAM, bool)
            seen[codes] = True
            grams = np.flatnonzero(seen)
            for first in range(0, len(grams), MOST_GRAMS):  # one turn but for very mixed texts
                here = grams[first : first + MOST_GRAMS]
                where = np.full(SYMBOLS**GRAM, -1, np.int32)
                where[here] = np.arange(len(here))
                cell = where[codes]
                cells = rows * len(here) + cell
                counts = np.bincount(cells if len(here) == len(grams) else cells[cell >= 0], minlength=(end - at) * len(here))
                out[at:end] += counts.reshape(end - at, len(here)).astype(np.float32) @ self._items(here)
            at = end
        return out, has


@dataclass
class Profiles:
    """Unit-length prototypes, by language in alphabetical order."""

    langs: list[str]
    vectors: np.ndarray

    def predict(self, bundles: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs or not len(bundles):
            return [UNKNOWN] * len(bundles), np.zeros(len(bundles))
        length = np.linalg.norm(bundles, axis=1, keepdims=True)
        cosine = (bundles / np.maximum(length, 1e-9)) @ self.vectors.T
        best = cosine.argmax(1)
        weight = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
        score = np.where(has, weight.max(1) / weight.sum(1), 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score.astype(float)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fold: int = 5, per_lang: int = TRAINING_DOCS) -> Profiles:
    """Profiles from rows with a language whose crc32(id) mod ``fold`` isn't 0. A language with over ``per_lang`` such rows is
    learned from about ``per_lang`` of them, chosen by a hash of the id. A null id counts as text '' in the fold, rows of one id (or of
    none) are chosen or left together, and null texts aren't learned from. No such rows, as in an empty table: no profiles."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    rows = rows.where(remainder_of_id("k", fold) != 0)
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, SIZE)))
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1 << 20, -(-per_lang * (1 << 20) // n)))])
    picked = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share[F.col("l")])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, total = Encoder(), {}
        for batch in batches:
            vectors, has = encoder.bundles(list(batch["t"]))
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for l in batch["l"].unique():
                total[l] = total.get(l, 0) + vectors[(batch["l"] == l).to_numpy() & has].sum(0, dtype=np.float64)
        if total:
            yield pd.DataFrame({"l": list(total), "v": [np.asarray(v, dtype=np.float64).tobytes() for v in total.values()]})

    found: dict[str, np.ndarray] = {}
    for r in picked.mapInPandas(released(sums), "l string, v binary").collect():  # a vector for each language and task
        found[r["l"]] = found.get(r["l"], 0) + np.frombuffer(r["v"])
    langs = sorted(l for l, v in found.items() if np.linalg.norm(v) > 0)
    vectors = np.array([found[l] / np.linalg.norm(found[l]) for l in langs]).reshape(len(langs), SIZE)
    return Profiles(langs, vectors.round(9))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (a row each, all columns kept; columns of these names are replaced).

    A null text and one without letters: ``und`` and 0. Very long texts count whole. Ties go to the alphabetically first
    language. Equal texts get equal results. No rows: none. No profiles (no training rows): all ``und``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if text not in kept:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for batch in batches:
            parts = [(np.empty(0, object), np.empty(0))]
            for at in range(0, len(batch), 512):
                parts.append(profiles.predict(*encoder.bundles([t if isinstance(t, str) else None for t in batch.iloc[at : at + 512]])))
            yield pd.DataFrame({"lang_pred": np.concatenate([p[0] for p in parts]), "score": np.concatenate([p[1] for p in parts])})

    # only texts go to Python, once (an expression that can't be repeated isn't); other columns stay as they are
    found = F.pandas_udf(released(run), "lang_pred string, score double").asNondeterministic()
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], found(F.col(f"`{text}`")).alias("found"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "found.lang_pred", "found.score")


def language_report(docs: DataFrame) -> DataFrame:
    """The columns of ``op10``: every document's language, learned from the rows that aren't held out."""
    profiles = train(docs)
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (remainder_of_id("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
