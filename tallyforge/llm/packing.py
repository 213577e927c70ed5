"""Best-fit packing (best-two-fit) of tokenised documents into sequences.

Lengths are integers up to the room of a sequence, so their histogram is all that packing needs: it is planned over counts
by length, the same for any number of partitions. A sequence is filled greedily with the longest pieces that fit; then its
smallest piece is replaced by two unpacked ones if these fill the gap and its place more tightly. One plan entry stands for
all the sequences of one make. Each piece finds its sequence and offset from its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FIRST, SECOND, cut, released, run_hashes, shuffle_partitions

ROOM = 2048
END_ID = 0
#: Bits of a row's number within its partition.
PART = 44
VOCABULARY = "word_bpe_49k.json"
#: Most distinct parts of words that a task remembers, and characters that it takes at a time.
KEPT, CHARS = 1 << 18, 500_000
#: Characters: white space to the tokenizer (U+001C to U+001F aren't), letters of a head, marks of a tail (no apostrophe).
_WHITE, _MARK, _OTHER = 0, 1, 2
_TABLE = np.full((1 << 16) + 1, _OTHER, np.uint8)
_TABLE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WHITE
_TABLE[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _MARK
#: A letter is 3 or more, small and large ones alike.
_LETTERS = [*range(97, 123), *(c for c in range(0xDF, 0x100) if c != 0xF7)]
_TABLE[_LETTERS] = np.arange(3, 3 + len(_LETTERS))
_TABLE[[c - 32 for c in _LETTERS if c not in (0xDF, 0xFF)]] = _TABLE[[c for c in _LETTERS if c not in (0xDF, 0xFF)]]
_LONGEST = 1 << 10


@lru_cache(maxsize=2)
def loaded(path: str):
    """The tokenizer of a file, and which ids end a word."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text, as the vocabulary's description has it
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
    return tokenizer, ends_word


class Parts:
    """Numbers of parts by two 64-bit hashes: an open-addressing table in arrays, looked up for many at once."""

    def __init__(self, most: int):
        self.bits = max(8, int(most).bit_length() + 1)
        self.keys = np.zeros((1 << self.bits, 2), np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)  # 0: free

    def _slots(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each, 0 for those not known."""
        out = np.zeros(len(first), np.int32)
        slots, rest = self._slots(first), None
        while len(slots):
            a, b = (first, second) if rest is None else (first[rest], second[rest])
            numbers, keys = self.numbers[slots], self.keys[slots]
            same = (keys[:, 0] == a) & (keys[:, 1] == b) & (numbers > 0)
            if rest is None:
                out[same] = numbers[same]
            else:
                out[rest[same]] = numbers[same]
            on = np.flatnonzero(~same & (numbers > 0))
            rest = on if rest is None else rest[on]
            slots = (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        """New parts, each once."""
        slots, rest = self._slots(first), np.arange(len(first))
        while len(rest):
            free = np.flatnonzero(self.numbers[slots] == 0)
            self.numbers[slots[free]] = numbers[rest[free]]  # of several for one slot the last stays
            won = np.zeros(len(rest), bool)
            won[free] = self.numbers[slots[free]] == numbers[rest[free]]
            self.keys[slots[won], 0], self.keys[slots[won], 1] = first[rest[won]], second[rest[won]]
            slots, rest = (slots[~won] + 1) & ((1 << self.bits) - 1), rest[~won]


class WordTokenizer:
    """Ids of whole texts, word by word: the tokenizer drops white space and never joins words, so a text's ids are those of
    its words in order. A word of Latin letters and trailing marks is two parts, letters in lower case and marks; each distinct
    part is tokenised once and found again by 128 bits of hash. Other words are looked up as they are."""

    def __init__(self, path: str, most: int = KEPT):
        self.tokenizer, self.ends_word = loaded(path)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.parts, self.count = Parts(self.most), 2  # part 0 has no ids, part 1 ends a document
        self.others: dict[str, int] = {}
        self.ids, self.used = np.full(1 << 16, END_ID, np.uint32), 1
        self.begins, self.ends = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ends[1] = 1

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new parts, their ids end to end."""
        first, n = self.count, len(ends)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while first + n > len(self.begins):
            self.begins, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.ends))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[first : first + n] = self.used + ends
        self.begins[first : first + n] = self.used + np.concatenate([[0], ends[:-1]])
        self.used += len(ids)
        self.count += n
        return np.arange(first, first + n, dtype=np.int32)

    def _numbers(self, text: str, values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the parts text[begins:ends]; those not known are tokenised."""
        first, second = run_hashes(values, begins, ends, FIRST), run_hashes(values, begins, ends, SECOND)
        out = self.parts.find(first, second)
        while len(missing := np.flatnonzero(out == 0)):
            _, new = np.unique(first[missing], return_index=True)
            new = missing[new]
            for at in range(0, len(new), 1024):
                some = new[at : at + 1024]
                names = " ".join([text[b:e] for b, e in zip(begins[some].tolist(), ends[some].tolist(), strict=True)])
                ids = np.array(self.tokenizer.encode_batch_fast([names], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.ends_word[ids]) + 1
                if len(cuts) != len(some):
                    raise RuntimeError("the vocabulary doesn't mark the ends of words")
                while 2 * (self.count + len(some)) > len(self.parts.numbers):  # many parts at once: a table twice the size
                    old, self.parts = self.parts, Parts(len(self.parts.numbers))
                    used = np.flatnonzero(old.numbers)
                    self.parts.add(old.keys[used, 0], old.keys[used, 1], old.numbers[used])
                self.parts.add(first[some], second[some], self._store(ids, cuts))
            out[missing] = self.parts.find(first[missing], second[missing])
        return out

    def _other(self, words: list[str]) -> list[int]:
        known = self.others
        new = list(dict.fromkeys(w for w in words if w not in known))
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            known.update(zip(some, self._store(np.array([i for ids in found for i in ids], np.uint32), np.cumsum([len(ids) for ids in found])).tolist(), strict=True))
        return [known[w] for w in words]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, END_ID after each, and where each begins (and the last ends). Null: END_ID alone."""
        if self.count > self.most or len(self.others) > self.most // 8:
            self._forget()
        text = "\n".join([t or "" for t in texts]) + "\n"
        at = np.cumsum(np.concatenate([[0], [len(t or "") + 1 for t in texts]]))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _TABLE[np.minimum(codes, 1 << 16)]
        white = kind == _WHITE
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.concatenate([[0], edges])
        begins, ends = edges[::2], edges[1::2]
        letter = kind > _OTHER
        odd = kind == _OTHER
        odd[1:] |= letter[1:] & (kind[:-1] == _MARK)  # letters behind marks
        count = lambda x: (lambda s: s[ends] - s[begins])(np.concatenate([[0], np.cumsum(x, dtype=np.int32)]))
        heads = count(letter)
        simple = (count(odd) == 0) & letter[begins] & (ends - begins <= _LONGEST)
        values = np.where(kind == _MARK, codes + 128, kind).astype(np.uint8)  # letters and marks differ
        part = np.zeros((len(begins), 2), np.int32)
        own = np.flatnonzero(simple)
        part[own, 0] = self._numbers(text, values, begins[own], begins[own] + heads[own])
        own = own[heads[own] < (ends - begins)[own]]
        part[own, 1] = self._numbers(text, values, begins[own] + heads[own], ends[own])
        own = np.flatnonzero(~simple)
        part[own, 0] = self._other([text[b:e] for b, e in zip(begins[own].tolist(), ends[own].tolist(), strict=True)])
        # a part that ends each document
        first = np.searchsorted(begins, at)
        part = np.insert(part.ravel(), 2 * first[1:], 1)
        n = (self.ends - self.begins)[part]
        stops = np.cumsum(n)
        step = np.ones(int(stops[-1]) if len(n) else 0, np.int64)  # from id to id of the store: on by one, or to the next part
        full = np.flatnonzero(n)
        starts = self.begins[part[full]]
        jump = starts[1:] - self.ends[part[full[:-1]]] + 1
        step[stops[full[:-1]]] = jump
        step[:1] = starts[:1]
        ids = self.ids[np.cumsum(step)]
        return ids, np.concatenate([[0], stops])[2 * first + np.arange(len(first))]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def written_order(docs: DataFrame):
    """A row's place as one number, partition << PART | row: in files that Spark wrote, those of the files; else the DataFrame's own."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from Parquet
        row = F.monotonically_increasing_id()
        return F.shiftleft(F.shiftright(row, 33), PART) + row.bitwiseAND(F.lit((1 << 33) - 1))
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"^part-(\d+)"), PART) + F.shiftleft(number(r"-c(\d+)[.]"), 33) + F.col("_metadata.row_index")


def pieces(docs: DataFrame, key: str, text: str, room: int, path: str | None, with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids, place): each document's ids and END_ID, cut every ``room`` ids."""
    schema = "key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", place long" * in_order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path or tokenizer_path())
        for batch in batches:
            at, texts = 0, batch.column("text").to_pylist()
            while at < len(texts):  # texts of some megabytes at a time
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end] or "") <= CHARS):
                    total += len(texts[end] or "")
                    end += 1
                ids, cuts = tokenizer(texts[at:end])
                each = -(-np.diff(cuts) // room)
                row = np.repeat(np.arange(end - at), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                begins = cuts[row] + piece * room
                ends = np.minimum(begins + room, cuts[row + 1])
                ids = ids.astype("<u4")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                source = pa.array(at + row)
                found = [batch.column("key").take(source), pa.array(piece, pa.int32()), pa.array(begins - cuts[row]), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    found.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                if in_order:
                    found.append(batch.column("place").take(source))
                yield pa.RecordBatch.from_arrays(found, [f.split()[0] for f in schema.split(", ")])
                at = end

    own = [written_order(docs).alias("place")] if in_order else []
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *own).mapInArrow(released(run), schema)


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces of that length in a sequence, offset of the first of them): from that rank on,
    a sequence gets so many pieces of the length, until the next entry of the length begins."""
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} doesn't fit")
        left[length] += n
    sizes = np.arange(room + 1)
    ranks = np.zeros(room + 1, np.int64)
    out, sequence = [], 0
    while left.any():
        free, gap, bin_ = left.copy(), room, {}
        while True:
            fit = np.flatnonzero(free[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            n = int(min(free[length], gap // length))
            bin_[length] = bin_.get(length, 0) + n
            free[length] -= n
            gap -= n * length
        smallest = min(bin_)
        wide = gap + smallest
        if gap:
            # the largest unpacked length at or below each size; a second piece of the same length needs two of it
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = np.flatnonzero(free[: wide + 1])
            b = below[np.minimum(wide - a, a)]
            short = (b == a) & (free[a] < 2)
            b[short] = below[a[short] - 1]
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                bin_[smallest] -= 1
                for x in (int(a[k]), int(b[k])):
                    bin_[x] = bin_.get(x, 0) + 1
        bin_ = {length: n for length, n in sorted(bin_.items(), reverse=True) if n}
        times = min(int(left[length]) // n for length, n in bin_.items())
        offset = 0
        for length, n in bin_.items():
            out.append((length, int(ranks[length]), sequence, n, offset))
            ranks[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
    return out


def _numbered(placed: DataFrame) -> DataFrame:
    """``placed`` with its sequences numbered in the order of their first pieces' places."""
    spark = placed.sparkSession
    placed = cut(placed)
    heads = placed.where("offset = 0").select(F.col("sequence_id").alias("made"), "piece", "place", F.shiftright("place", PART).cast("int").alias("part"))
    parts = sorted(heads.groupBy("part").agg(F.count("*").alias("n")).collect())  # one for each partition that was written
    before = pd.DataFrame({"part": [p for p, _ in parts], "before": np.cumsum([0, *[n for _, n in parts]])[:-1]})
    firsts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("place", "piece")) - 1
    new = heads.join(firsts, "part").select(F.col("made").alias("sequence_id"), number.alias("number"))
    return placed.join(new, "sequence_id").select("key", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset")


def place(found: DataFrame, room: int = ROOM) -> DataFrame:
    """``found`` (key, piece, start, length, ids_crc32, and what else it has) with sequence_id and offset. The driver gets the histogram, ``room`` rows at
    most; tasks get the plan, an entry for each length of each make of sequence. With a column place, the pieces of a length are
    dealt to sequences in its order, and the sequences follow that of their first pieces."""
    buckets = shuffle_partitions(found.sparkSession)
    in_order = "place" in found.columns
    bucket = F.shiftright("place", PART) if in_order else F.pmod(F.xxhash64("key", "piece"), F.lit(buckets))
    found = cut(found.withColumn("bucket", bucket.cast("int")))
    counts = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    entries = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    entries = np.array(sorted(entries), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(*["place"] * in_order, "key", "piece")
    ranked = found.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (entries[:, 0] << 48) + entries[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            e = entries[np.searchsorted(key, (length << 48) + rank, "right") - 1] if len(length) else entries[:0]
            k = rank - e[:, 1]
            made = [pa.array(e[:, 2] + k // np.maximum(e[:, 3], 1)), pa.array(e[:, 4] + k % np.maximum(e[:, 3], 1) * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + made, [*columns, "sequence_id", "offset"])

    columns = [c for c in found.columns if c != "bucket"]
    schema = "".join(f"{c} {found.schema[c].dataType.simpleString()}, " for c in columns) + "sequence_id long, offset long"
    placed = ranked.select(*columns, "rank").mapInArrow(run, schema)
    return _numbered(placed) if in_order else placed


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROOM, path: str | None = None, in_order: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes.

    A document is its ids, then END_ID; only one longer than ``room`` is cut. A null or empty text is END_ID alone. Repeated rows and
    equal texts are packed each; a null key stays null. No rows: none. ``path``: the tokenizer file (default: word_bpe_49k.json).
    ``in_order``: documents of a length are packed in the order of the rows, and sequences are numbered by it (by their first
    pieces'). ``key`` is taken as a long; one that is no number fails, or is null where the session's ANSI mode is off."""
    return place(pieces(docs, key, text, room, path, in_order=in_order), room).withColumnRenamed("key", key)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROOM, path: str | None = None) -> DataFrame:
    """sequence_id, ids (array of int), docs (array of key, piece and offset): the packed sequences themselves."""
    joined = place(pieces(docs, key, text, room, path, with_ids=True), room)
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "key", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["key"].alias(key), x["piece"], x["offset"])).alias("docs"))


def packing_report(docs: DataFrame) -> DataFrame:
    """The columns of ``op6``."""
    return pack(docs)
