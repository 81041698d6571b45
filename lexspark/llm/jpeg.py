"""Baseline JPEG: a marker parser, a Huffman scan decoder and DC-only luminance thumbnails, in numpy.

**Decoder.**  Any baseline (SOF0) file with 8-bit samples is read: markers, quantisation and Huffman tables,
restart intervals, sampling factors, byte stuffing.  Entropy-coded segments between restart markers don't
depend on one another, so all segments of all images of a batch are decoded in lockstep: one numpy step takes
the next symbol of every segment through a 16-bit lookup table.  A file without restart markers is one
segment.  The DC coefficients of the luminance blocks make a thumbnail of an eighth of the size.

**Lossless payload.**  Pixels would be lossy, the quantised coefficients are not: they are the unit of the
format.  A payload is stored as coefficients, 192 bytes to a minimum coded unit (an 8 x 8 block of each of
three components).  Byte b becomes b-128, or b-127 from 128 on, so that no coefficient is zero, and the DC
coefficients are coded as differences as the format asks.  A restart marker follows each unit; a comment
segment holds the length of the payload, since the last row of units may be filled up.

Cases: null text counts as empty (192 blanks); equal texts give equal files; repeated rows repeat; other
columns are ignored; an empty table gives no rows; a file that isn't baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
#: Coded units that a lockstep pass takes at once: bounds memory.
PASS_UNITS = 24_000

# The zigzag order of the format follows from walking the anti-diagonals of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))

FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), from the numbers of codes of lengths 1 to 16 and the symbols in order."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


# Tables of the encoder: a coefficient of s magnitude bits has a code of 9-s bits (AC) or 10-s bits (DC).
DC_COUNTS, DC_SYMBOLS = [1] * 10 + [0] * 6, [*range(9, -1, -1)]
AC_COUNTS, AC_SYMBOLS = [1] * 8 + [0] * 8, [*range(8, 0, -1)]
DC_BITS, AC_BITS = 10, 9


def _coded(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """Huffman code and magnitude bits of each value, as one integer."""
    size = np.zeros(values.shape, np.int32)
    a = np.abs(values)
    for s in range(1, 11):
        size += a >= 1 << (s - 1)
    code = np.zeros(12, np.int32)
    for s, (c, _) in codes.items():
        code[s] = c
    magnitude = np.where(values < 0, values + (1 << size) - 1, values)
    return (code[size] << size) | magnitude


_DC_CODES, _AC_CODES = huffman_codes(DC_COUNTS, DC_SYMBOLS), huffman_codes(AC_COUNTS, AC_SYMBOLS)
_AC_OF_BYTE = _coded(np.r_[-128:0, 1:129].astype(np.int32), _AC_CODES).astype(np.uint16)
_COEFFICIENT = np.r_[-128:0, 1:129].astype(np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(payload: np.ndarray) -> bytes:
    """Entropy-coded units of a payload of whole units, with stuffing and a restart marker after each but the last."""
    units = payload.reshape(-1, 3, 64)
    bits = np.empty((len(units), 3, DC_BITS + 63 * AC_BITS), np.uint8)
    dc = _coded(_COEFFICIENT[units[:, :, 0]], _DC_CODES)  # prediction starts from 0 in each unit
    bits[:, :, :DC_BITS] = (dc[..., None] >> np.arange(DC_BITS - 1, -1, -1)) & 1
    ac = bits[:, :, DC_BITS:].reshape(len(units), 3, 63, AC_BITS)
    codes = _AC_OF_BYTE[units[:, :, 1:]]
    for i in range(AC_BITS):
        ac[..., i] = (codes >> (AC_BITS - 1 - i)) & 1
    bits[:, :, DC_BITS:] = ac.reshape(len(units), 3, -1)
    flat = bits.reshape(len(units), -1)
    pad = -flat.shape[1] % 8
    body = np.packbits(np.concatenate([flat, np.ones((len(units), pad), np.uint8)], axis=1), axis=1)
    n, width = body.shape
    stuffed = (body == 0xFF).ravel()
    place = np.arange(n * width) + np.r_[0, np.cumsum(stuffed)[:-1]] + 2 * np.repeat(np.arange(n), width)
    out = np.zeros(n * width + int(stuffed.sum()) + 2 * n, np.uint8)
    out[place] = body.ravel()
    ends = place[width - 1 :: width] + 1 + stuffed[width - 1 :: width]
    out[ends], out[ends + 1] = 0xFF, 0xD0 + np.arange(n) % 8
    return out[:-2].tobytes()


def grid(units: int) -> tuple[int, int]:
    """Units in a row and rows, nearly square."""
    across = max(1, int(np.ceil(np.sqrt(units))))
    return across, -(-units // across)


def write_payload(payload: bytes) -> bytes:
    """A baseline JPEG file whose coefficients are the payload, a positive multiple of 192 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    across, down = grid(len(payload) // UNIT)
    if max(across, down) > 8191:
        raise ValueError("a payload is over the size of one image")
    data = np.frombuffer(payload + b" " * (across * down * UNIT - len(payload)), np.uint8)
    head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
    head += _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    step = PASS_UNITS * UNIT - PASS_UNITS * UNIT % (8 * UNIT)  # a multiple of 8 units keeps the markers' numbers
    scan = [_scan(data[i : i + step]) for i in range(0, len(data), step)]
    return head + b"\xff\xd7".join(scan) + b"\xff\xd9"


@dataclass
class Image:
    """What the markers of one file say, and its entropy-coded bytes without stuffing."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of component, DC table, AC table
    interval: int = 0
    data: np.ndarray | None = None
    starts: np.ndarray | None = None

    @property
    def mcus(self) -> tuple[int, int]:
        if len(self.scan) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of each block of a coded unit."""
        if len(self.scan) == 1:
            return [self.scan[0]]
        return [s for s in self.scan for _ in range(self.components[s[0]][1] * self.components[s[0]][2])]


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup_table(body: bytes) -> np.ndarray:
    """For each 16 bits: length of the code there << 8 | its symbol; 0 where no code fits."""
    if body not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        counts, symbols = body[:16], body[16:]
        table = np.zeros(1 << 16, np.int32)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[body] = table
    return _LOOKUPS[body]


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG with one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    img, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            img.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                img.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 16 + sum(body[1:17])
                img.huffman[body[0] >> 4, body[0] & 15] = lookup_table(body[1 : 1 + n])
                body = body[1 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            img.height, img.width = struct.unpack_from(">HH", body, 1)
            img.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDD:
            (img.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            order = {c[0]: i for i, c in enumerate(img.components)}
            img.scan = [(order[body[i]], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    after = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[after + 1]
    end = after[(following != 0) & ((following < 0xD0) | (following > 0xD7)) & (following != 0xFF)]
    stop = int(end[0]) if len(end) else len(raw)
    inside = after < stop
    after, following = after[inside], following[inside]
    keep = np.ones(stop, bool)
    keep[after[following == 0] + 1] = False  # stuffing
    marks = after[following != 0]
    keep[marks] = False
    keep[marks[marks + 1 < stop] + 1] = False
    img.data = raw[:stop][keep]
    img.starts = np.r_[0, np.cumsum(keep)[marks] if len(marks) else np.zeros(0, np.int64)].astype(np.int64)
    return img


def decode_coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients, in zigzag order, of each image: an array (units, blocks of a unit, 64).

    The segments of all images advance together, one symbol a step.
    """
    out: list[np.ndarray] = [None] * len(images)  # type: ignore[list-item]
    alike: dict[tuple, list[int]] = {}
    for i, img in enumerate(images):
        key = (tuple(img.blocks()), tuple((k, id(v)) for k, v in sorted(img.huffman.items())))
        alike.setdefault(key, []).append(i)
    for (blocks, _), members in alike.items():
        tables = images[members[0]].huffman
        pad = np.zeros(8, np.uint8)
        data = np.concatenate([x for i in members for x in (images[i].data, pad)])
        sizes = [len(images[i].data) + len(pad) for i in members]
        offsets = np.r_[0, np.cumsum(sizes)[:-1]]
        units, bit, stop, place, first = [], [], [], [], 0
        for i, offset in zip(members, offsets):
            img = images[i]
            total = img.mcus[0] * img.mcus[1]
            each = img.interval or total
            n = -(-total // each)
            if len(img.starts) < n:
                raise ValueError("the scan ends early")
            units.append(np.minimum(each, total - each * np.arange(n)))
            bit.append((img.starts[:n] + offset) * 8)
            stop.append((np.r_[img.starts[1:], len(img.data)][:n] + offset) * 8)
            place.append(first + each * np.arange(n))
            first += total
        coefficients = np.zeros((first, len(blocks), 64), np.int16)
        bit = np.concatenate(bit)
        _lockstep(data, bit, np.concatenate(units), np.concatenate(place), blocks, tables, coefficients)
        if (bit > np.concatenate(stop)).any():
            raise ValueError("the scan ends early")
        at = 0
        for i in members:
            n = images[i].mcus[0] * images[i].mcus[1]
            out[i] = coefficients[at : at + n]
            at += n
    return out


def _lockstep(data, bit, units, place, blocks, tables, out) -> None:
    # 32 bits from each byte on, so that one gather gives the code and another the magnitude
    window = data.astype(np.uint32)
    words = (window << 24) | (np.r_[window[1:], np.zeros(1, np.uint32)] << 16) | (np.r_[window[2:], np.zeros(2, np.uint32)] << 8) | np.r_[window[3:], np.zeros(3, np.uint32)]
    last = len(words) - 1
    components = max(b[0] for b in blocks) + 1
    predicted = np.zeros((len(bit), components), np.int32)

    def take(at, table):
        entry = table[(words[np.minimum(at >> 3, last)] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF]
        if not entry.all():
            raise ValueError("a code is not in its table")
        at = at + (entry >> 8)
        symbol = entry & 0xFF
        return at, symbol

    def magnitude(at, size):
        value = ((words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int32) >> (16 - size)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        return at + size, np.where(size > 0, value, 0)

    for unit in range(int(units.max(initial=0))):
        on = np.flatnonzero(units > unit)
        for b, (component, dc, ac) in enumerate(blocks):
            at, size = take(bit[on], tables[0, dc])
            at, value = magnitude(at, size)
            predicted[on, component] += value
            block = out[:, b]
            rows = place[on] + unit
            block[rows, 0] = predicted[on, component]
            k = np.ones(len(on), np.int64)
            live = np.arange(len(on))
            table = tables[1, ac]
            while len(live):
                whole = len(live) == len(on)
                now, symbol = take(at if whole else at[live], table)
                run, size = symbol >> 4, symbol & 15
                now, value = magnitude(now, size)
                to = (k if whole else k[live]) + run
                put = size > 0
                if to[put].max(initial=0) > 63:
                    raise ValueError("a block is too long")
                if put.all():
                    block[rows if whole else rows[live], to] = value
                else:
                    block[(rows if whole else rows[live])[put], to[put]] = value[put]
                ended = (size == 0) & (run != 15)
                if whole:
                    at, k = now, np.where(ended, 64, to + 1)
                else:
                    at[live], k[live] = now, np.where(ended, 64, to + 1)
                if k.max() > 63 or not whole:
                    live = np.flatnonzero(k < 64)
            bit[on] = at


def thumbnail(img: Image, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance: one 8-bit sample for each block of the first component."""
    across, down = img.mcus
    component = img.scan[0][0]
    _, h, v, q = img.components[component]
    if len(img.scan) == 1:
        h = v = 1
    dc = coefficients[:, : h * v, 0].astype(np.int32) * int(img.quant[q][0])
    plane = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = (1, 1) if len(img.scan) == 1 else (max(c[1] for c in img.components), max(c[2] for c in img.components))
    plane = plane[: -(-img.height * v // (8 * most_v)), : -(-img.width * h // (8 * most_h))]
    return np.clip((plane + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: in an 8 x 8 mean-sampled grid, whether a cell is over the mean of all."""
    rows = np.linspace(0, thumb.shape[0], 9)
    cols = np.linspace(0, thumb.shape[1], 9)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, c0 = np.minimum(rows[:-1].astype(int), thumb.shape[0] - 1), np.minimum(cols[:-1].astype(int), thumb.shape[1] - 1)
    r1, c1 = np.maximum(np.ceil(rows[1:]).astype(int), r0 + 1), np.maximum(np.ceil(cols[1:]).astype(int), c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    cells = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area
    return np.packbits(cells > thumb.mean()).tobytes().hex()


def read_payload(img: Image, coefficients: np.ndarray) -> bytes:
    """The payload that :func:`write_payload` stored."""
    values = coefficients.reshape(-1)
    data = (values + np.where(values < 0, 128, 127)).astype(np.uint8).tobytes()
    return data[: int(img.comment.split()[1])]


def pad_text(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _features(group: list[tuple[int, int, bytes]]) -> list[tuple]:
    images = [parse(media) for _, _, media in group]
    out = []
    for (doc_id, n_bytes, media), img, coefficients in zip(group, images, decode_coefficients(images)):
        payload = read_payload(img, coefficients)
        thumb = thumbnail(img, coefficients)
        feature = f"{img.width}x{img.height}:{thumbnail_hash(thumb)}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}"
        out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    return out


def store_and_describe(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]

    def rows(group):
        done = _features(group)
        columns = list(zip(*done)) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    group, units = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            n_bytes, payload = pad_text(text.as_py())
            if group and units + len(payload) // UNIT > PASS_UNITS:
                yield rows(group)
                group, units = [], 0
            group.append((doc_id, n_bytes, write_payload(payload)))
            units += len(payload) // UNIT
    yield rows(group)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores each text as a JPEG file, reads that file back and describes it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(store_and_describe, FEATURE_SCHEMA)


def media_files(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: the stored files themselves."""

    def run(batches):
        for batch in batches:
            media = [write_payload(pad_text(t.as_py())[1]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, media binary")


def describe_files(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions and thumbnail hash of any baseline JPEG files; nulls where a file can't be read."""

    def run(batches):
        for batch in batches:
            ids, w, h, t = batch.column(0), [], [], []
            for media in batch.column(1):
                try:
                    img = parse(media.as_py() or b"")
                    thumb = thumbnail(img, decode_coefficients([img])[0])
                    w.append(img.width), h.append(img.height), t.append(thumbnail_hash(thumb))
                except (ValueError, KeyError, IndexError, struct.error):
                    w.append(None), h.append(None), t.append(None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.string())], names=["id", "width", "height", "thumbnail_hash"])

    return files.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "id long, width int, height int, thumbnail_hash string")
