"""Media columns: baseline JPEG files written from payloads, and read back in numpy.

A payload byte is one 8x8 block of constant luminance: with a DC quantiser of 8 the quantised DC coefficient is the byte
minus 128, so every decoder gives back the byte itself, and the DC-only luminance thumbnail of the file is the payload.

The reader parses the markers of any baseline (SOF0) Huffman JPEG, decodes the scans of many files in lockstep (one lane
for each restart interval) and reconstructs DC-only luminance thumbnails: one pixel for each luminance block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: A payload is filled up with bytes 255 to a positive multiple of this.
UNIT = 576
#: Blocks in a restart interval and in a row of a small picture.
LANE = 24
#: Blocks in a row of a large picture, and the most block rows that a picture of 65,535 lines has.
WIDE, MOST_ROWS = 576, 8191
#: Payload bytes that are coded or decoded at once.
SLICE = 1 << 18

#: Fixed values of the file format: counts of Huffman codes by length 1 to 16, then the symbols. The DC table is the
#: standard's luminance table; the AC table holds the end-of-block symbol alone, as these files have no AC coefficients.
DC_TABLE = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
AC_TABLE = bytes([1] + [0] * 15) + b"\x00"


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _codes(table: bytes) -> dict[int, tuple[int, int]]:
    """Symbol: (code, length) of a table given as counts and symbols."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[table[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(table: bytes) -> np.ndarray:
    """For each 16-bit window of the scan, length << 8 | symbol of the code it starts with; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(table).items():
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = length << 8 | symbol
    return out


def _header(blocks_wide: int, blocks_high: int) -> bytes:
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xDB, b"\x00" + bytes([8]) + bytes([1] * 63))
        + part(0xC0, struct.pack(">BHHB", 8, blocks_high * 8, blocks_wide * 8, 1) + bytes([1, 0x11, 0]))
        + part(0xC4, b"\x00" + DC_TABLE)
        + part(0xC4, b"\x10" + AC_TABLE)
        + part(0xDD, struct.pack(">H", LANE))
        + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


class _Coder:
    """For each difference of -255..255: the bits of its DC symbol, its extra bits and the end-of-block code."""

    def __init__(self):
        dc, (eob, eob_length) = _codes(DC_TABLE), _codes(AC_TABLE)[0]
        d = np.arange(-255, 256)
        size = np.array([int(abs(x)).bit_length() for x in d])
        code = np.array([dc[s][0] for s in size])
        extra = np.where(d < 0, d + (1 << size) - 1, d)
        self.bits = ((code << size | extra) << eob_length | eob).astype(np.int32)
        self.length = (np.array([dc[s][1] for s in size]) + size + eob_length).astype(np.int32)


_CODER = _Coder()


def _scan(values: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of lanes of LANE values each, stuffed, with RSTn after each lane whose ``markers`` is n (none: -1),
    and the number of bytes that each lane came to."""
    lanes = len(values)
    d = np.diff(values.astype(np.int32), axis=1, prepend=128) + 255
    bits, length = _CODER.bits[d], _CODER.length[d]
    ends = np.cumsum(length, axis=1)
    starts = ends - length
    room = int(ends[:, -1].max()) // 8 + 6
    out = np.zeros(lanes * room, np.uint8)
    base = np.arange(lanes) * room
    for k in range(LANE):
        byte, bit = base + (starts[:, k] >> 3), starts[:, k] & 7
        word = bits[:, k] << (24 - bit - length[:, k])
        out[byte] |= (word >> 16).astype(np.uint8)
        out[byte + 1] |= (word >> 8 & 255).astype(np.uint8)
        out[byte + 2] |= (word & 255).astype(np.uint8)
    total = ends[:, -1]
    count = (total + 7) >> 3
    out[base + count - 1] |= ((1 << (count * 8 - total)) - 1).astype(np.uint8)
    out = out.reshape(lanes, room)
    rows = np.arange(lanes)
    has = markers >= 0
    out[rows[has], count[has]] = 255
    out[rows[has], count[has] + 1] = 0xD0 + markers[has]
    used = np.arange(room) < (count + 2 * has)[:, None]
    flat, data = out[used], (np.arange(room) < count[:, None])[used]
    stuffed = np.flatnonzero((flat == 255) & data)
    lane_of = np.repeat(rows, count + 2 * has)
    return np.insert(flat, stuffed + 1, 0), count + 2 * has + np.bincount(lane_of[stuffed], minlength=lanes)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload (a multiple of UNIT bytes): one JPEG, or several on end where a payload is over 4.7 MB."""
    pictures: list[tuple[int, int, bytes]] = []  # payload's place, blocks in a row, bytes
    for k, raw in enumerate(payloads):
        wide = LANE if len(raw) <= LANE * MOST_ROWS else WIDE
        for at in range(0, len(raw), wide * MOST_ROWS):
            pictures.append((k, wide, raw[at : at + wide * MOST_ROWS]))
    files: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(pictures):
        group, size = [], 0
        while at < len(pictures) and (not group or size + len(pictures[at][2]) <= SLICE):
            group.append(pictures[at])
            size += len(pictures[at][2])
            at += 1
        lanes = np.array([len(x[2]) // LANE for x in group])
        ends = np.cumsum(lanes)
        within = np.arange(ends[-1]) - np.repeat(ends - lanes, lanes)
        markers = within % 8
        markers[ends - 1] = -1
        coded, sizes = _scan(np.frombuffer(b"".join(x[2] for x in group), np.uint8).reshape(-1, LANE), markers)
        cuts = np.cumsum(np.add.reduceat(sizes, ends - lanes))
        coded = coded.tobytes()
        for (k, wide, raw), first, last in zip(group, [0, *cuts[:-1]], cuts, strict=True):
            files[k] += [_header(wide, len(raw) // wide), coded[first:last], b"\xff\xd9"]
    return [b"".join(x) for x in files]


class Picture:
    """What the markers of one baseline JPEG say."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quant: dict[int, int] = {}
        huffman: dict[int, bytes] = {}
        self.interval, parts = 0, []
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if len(data) < at + 4 or data[at] != 255:
                raise ValueError("a marker is missing")
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    huffman[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
                if depth != 8 or not self.height or not self.width or not parts:
                    raise ValueError("not an 8-bit baseline picture")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline picture")
            elif marker == 0xDA:
                break
        if body[0] != len(parts) or not parts:
            raise ValueError("scans of single components aren't read")
        single = len(parts) == 1
        self.h, self.v = (1, 1) if single else (parts[0][1] >> 4, parts[0][1] & 15)
        most_h, most_v = (1, 1) if single else (max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts))
        self.mcus_wide, self.mcus_high = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.blocks_wide = -(-(-(-self.width * self.h // most_h)) // 8)
        self.blocks_high = -(-(-(-self.height * self.v // most_v)) // 8)
        tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        #: For each block of an MCU: component, DC table, AC table. Pictures with equal plans are decoded together.
        self.plan = tuple(
            (i, huffman[tables[p[0]] >> 4], huffman[0x10 | tables[p[0]] & 15]) for i, p in enumerate(parts) for _ in range(1 if single else (p[1] >> 4) * (p[1] & 15))
        )
        self.dc_quant = self.quant[parts[0][2]]
        self.per_lane = self.interval or self.mcus_wide * self.mcus_high
        self.start = at
        end = data.find(b"\xff\xd9", at)
        self.end = len(data) if end < 0 else end


def pictures(data: bytes) -> list[Picture]:
    out, at = [], 0
    while at < len(data):
        out.append(Picture(data, at))
        at = out[-1].end + 2
    if not out:
        raise ValueError("no picture")
    return out


def _decode(coded: np.ndarray, starts: np.ndarray, mcus: np.ndarray, plan: tuple) -> np.ndarray:
    """DC coefficients of component 0, [lane, block]: lanes begin at byte ``starts`` of the unstuffed scan bytes."""
    wide = np.zeros(len(coded) + 8, np.int32)
    wide[: len(coded)] = coded
    wide[len(coded) :] = 255
    words = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    last = len(words) - 1
    tables = {t: _lookup(t) for _, *pair in plan for t in pair}
    luma = sum(c == 0 for c, *_ in plan)
    out = np.zeros((len(starts), int(mcus.max()) * luma), np.int32)
    at = starts.astype(np.int64) * 8
    order = np.argsort(-mcus, kind="stable")
    pred = np.zeros((1 + max(c for c, *_ in plan), len(starts)), np.int32)
    left = mcus[order]

    def window(pos):
        return (words[np.minimum(pos >> 3, last)] >> (8 - (pos & 7))) & 0xFFFF

    for mcu in range(int(mcus.max())):
        live = order[: np.searchsorted(-left, -mcu, "left")]
        whole = len(live) == len(starts) and np.array_equal(live[:1], [0]) and mcus.min() == mcus.max()
        block = 0
        for component, dc, ac in plan:
            pos = at if whole else at[live]
            found = tables[dc][window(pos)]
            if not found.all():
                raise ValueError("a code isn't in the Huffman table")
            size, pos = found & 255, pos + (found >> 8)
            extra = np.where(size > 0, window(pos) >> (16 - size), 0)
            diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            pos = pos + size
            if whole:
                pred[component] += diff
            else:
                pred[component, live] += diff
            if component == 0:
                if whole:
                    out[:, mcu * luma + block] = pred[0]
                else:
                    out[live, mcu * luma + block] = pred[0, live]
                block += 1
            rest, k = np.arange(len(pos)), np.ones(len(pos), np.int64)
            while len(rest):
                found = tables[ac][window(pos[rest] if len(rest) < len(pos) else pos)]
                if not found.all():
                    raise ValueError("a code isn't in the Huffman table")
                symbol = found & 255
                run, size = symbol >> 4, symbol & 15
                if len(rest) == len(pos):
                    pos = pos + (found >> 8) + size
                    k = k + run + 1
                else:
                    pos[rest] += (found >> 8) + size
                    k[rest] += run + 1
                rest = rest[(symbol != 0) & (k[rest] < 64)]
            if whole:
                at = pos
            else:
                at[live] = pos
    return out


def thumbnails(files: list[bytes]) -> list[list[np.ndarray] | str]:
    """For each file the DC-only luminance thumbnails (uint8, one pixel a block) of its pictures, or why it can't be read."""
    found: list[list | str] = []
    jobs: dict[tuple, list] = {}
    for k, data in enumerate(files):
        try:
            seen = pictures(data)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            found.append(f"unreadable: {e}")
            continue
        found.append([None] * len(seen))
        for i, p in enumerate(seen):
            jobs.setdefault((p.plan, p.per_lane), []).append((k, i, p))
    for (plan, per_lane), group in jobs.items():
        at = 0
        while at < len(group):
            part, size = [], 0
            while at < len(group) and (not part or size + group[at][2].end - group[at][2].start <= SLICE):
                part.append(group[at])
                size += part[-1][2].end - part[-1][2].start
                at += 1
            try:
                _decode_group(files, part, plan, per_lane, found)
            except ValueError:
                for one in part:
                    try:
                        _decode_group(files, [one], plan, per_lane, found)
                    except ValueError as e:
                        found[one[0]] = f"unreadable: {e}"
    return found


def _decode_group(files, part, plan, per_lane, found) -> None:
    spans = [files[k][p.start : p.end] for k, _, p in part]
    raw = np.frombuffer(b"".join(spans), np.uint8)
    first = np.cumsum([0, *map(len, spans)])[:-1]
    before = np.zeros(len(raw), bool)
    before[1:] = raw[:-1] == 255
    before[first[first < len(raw)]] = False
    stuffing = before & (raw == 0)
    restart = before & (raw >= 0xD0) & (raw <= 0xD7)
    gone = stuffing | restart
    gone[np.flatnonzero(restart) - 1] = True
    new_place = np.cumsum(~gone)
    firsts = np.sort(np.concatenate([first, np.flatnonzero(restart) + 1]))
    starts = np.where(firsts > 0, new_place[np.minimum(firsts, len(raw)) - 1], 0)
    lanes = [-(-p.mcus_wide * p.mcus_high // per_lane) for _, _, p in part]
    if sum(lanes) != len(starts):
        raise ValueError("restart markers are missing")
    mcus = np.concatenate([np.minimum(per_lane, p.mcus_wide * p.mcus_high - per_lane * np.arange(n)) for (_, _, p), n in zip(part, lanes, strict=True)])
    dc = _decode(raw[~gone], starts, mcus, plan)
    at = 0
    for (k, i, p), n in zip(part, lanes, strict=True):
        per = p.h * p.v
        blocks = dc[at : at + n].reshape(-1)[: p.mcus_wide * p.mcus_high * per]
        at += n
        grid = blocks.reshape(p.mcus_high, p.mcus_wide, p.v, p.h).swapaxes(1, 2).reshape(p.mcus_high * p.v, p.mcus_wide * p.h)
        grid = grid[: p.blocks_high, : p.blocks_wide]
        if isinstance(found[k], list):
            found[k][i] = np.clip((grid * p.dc_quant + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _shrunk(thumb: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over a grid of ``high`` x ``wide`` near-equal cells; a small picture is enlarged first."""
    if thumb.shape[0] < high or thumb.shape[1] < wide:
        thumb = np.repeat(np.repeat(thumb, -(-high // thumb.shape[0]), 0), -(-wide // thumb.shape[1]), 1)
    thumb = thumb.astype(np.int64)
    rows, cols = (np.arange(high) * thumb.shape[0]) // high, (np.arange(wide) * thumb.shape[1]) // wide
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, 0), cols, 1)
    area = np.diff(rows, append=thumb.shape[0])[:, None] * np.diff(cols, append=thumb.shape[1])
    return sums / area


def stacked(pictures: list[np.ndarray]) -> np.ndarray:
    """A file's pictures one below the other; narrower ones are filled up on the right with their last column."""
    wide = max(p.shape[1] for p in pictures)
    return np.concatenate([p if p.shape[1] == wide else np.pad(p, ((0, 0), (0, wide - p.shape[1])), "edge") for p in pictures])


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Of a grid of 8 x 9 cells: which are above their mean (18 hexadecimal digits), and which are brighter than their left
    neighbour (16)."""
    cells = _shrunk(thumb, 8, 9)
    return tuple(np.packbits(x).tobytes().hex() for x in (cells > cells.mean(), cells[:, 1:] > cells[:, :-1]))


def store(texts: list[str | None]) -> tuple[list[int], list[bytes], list[bytes]]:
    """Of whole texts: their bytes, padded payloads, and JPEG files that hold these."""
    raw = [b"" if not isinstance(t, str) else t.encode("utf-8", "surrogatepass") for t in texts]
    payloads = [padded(x) for x in raw]
    return [len(x) for x in raw], payloads, encode(payloads)


READ = "width int, height int, n_pictures int, payload binary, mean_hash string, gradient_hash string, problem string"


def read(files: list[bytes | None]) -> list[tuple]:
    """The fields of READ for each file."""
    out = []
    for x in thumbnails([b"" if f is None else bytes(f) for f in files]):
        if isinstance(x, str):
            out.append((None, None, None, None, None, None, x))
            continue
        whole = stacked(x)
        out.append((whole.shape[1] * 8, whole.shape[0] * 8, len(x), b"".join(t.tobytes() for t in x), *thumbnail_hashes(whole), None))
    return out


def _by_column(source, schema: str, make):
    """A column of structs: ``make`` turns lists of values into lists of rows, a few at a time. Evaluated once for each row."""
    names = [f.split()[0] for f in schema.split(", ")]
    whole = [f.split()[0] for f in schema.split(", ") if f.split()[1] in ("int", "long")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for at in range(0, len(batch), 256) for r in make(list(batch.iloc[at : at + 256]))]
            found = pd.DataFrame(rows, columns=names)
            found[whole] = found[whole].astype("Int64")
            yield found

    return F.pandas_udf(released(run), schema).asNondeterministic()(source)


STORED = "n_bytes long, payload_bytes long, media binary"


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One JPEG column from whole texts: key, n_bytes (unpadded), payload_bytes, media. A null or empty text gives one unit
    of bytes 255; equal texts give equal files; repeated rows stay; other columns are left out. No rows: none."""
    make = lambda texts: [(n, len(p), m) for n, p, m in zip(*store(texts), strict=True)]
    rows = docs.select(F.col(f"`{key}`").alias("key"), _by_column(F.col(f"`{text}`"), STORED, make).alias("made"))
    return rows.select(F.col("key").alias(key), "made.*")


def read_media(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and the media column, and from its bytes: number of pictures, pixel dimensions of them all stacked,
    the DC-only luminance thumbnails' samples (for files of store_texts: the payload), two thumbnail hashes of the stacked
    pictures. A null media column or bytes that are no baseline JPEG: nulls, and the reason in ``problem``."""
    rows = stored.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{media}`").alias("media"), _by_column(F.col(f"`{media}`"), READ, read).alias("made"))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("media").alias(media), "made.*")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, n_pictures int"


def digests(texts: list[str | None]) -> list[tuple]:
    """The fields of DIGEST: texts are stored as JPEG files, and all but n_bytes is told from the files' bytes alone."""
    sizes, _, files = store(texts)
    out = []
    for n, file, (width, height, pictures, payload, mean, gradient, problem) in zip(sizes, files, read(files), strict=True):
        if problem:
            raise ValueError(f"a stored file can't be read: {problem}")
        feature = f"{width}x{height}:{mean}:{gradient}"
        out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, width, height, pictures))
    return out


def media_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``op1``. Files of a few rows are stored and read back in one Python function, so that they don't
    pass through the JVM; store_texts and read_media are the same in two steps, with the files themselves."""
    return docs.select("doc_id", _by_column(F.col("text"), DIGEST, digests).alias("made")).select("doc_id", "made.*")
