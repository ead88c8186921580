"""Media columns: TIFF.

``pages`` walks the directories of a classic TIFF (either byte order), decodes uncompressed,
PackBits, LZW and deflate strips or tiles, undoes horizontal prediction and yields one page at a
time.  ``build`` writes such files.  Grey 8-bit samples are written; 1 to 4 samples a pixel of 8 or
16 bits are read.  A damaged file raises ``ValueError``; ``page_rows`` then gives one row with the
message and no samples, so one bad row never ends a job.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows

# Fixed values of the TIFF 6.0 specification: tags, field sizes and compression numbers.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_L, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258

#: Bytes that one stored byte becomes at most: an LZW code of 12 bits stands for fewer than 4096 bytes, deflate reaches 1032, PackBits 64.
EXPANSION = 4096

UNIT = 64
PAGE_ROWS = 1024
STRIP = 128
#: The layouts that pages of a payload take in turn: compression, predictor, tiled.
SCHEMES = ((DEFLATE, 2, False), (LZW, 1, True), (PACKBITS, 1, False), (DEFLATE, 1, True), (LZW, 2, False), (PACKBITS, 2, True))


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


# -- PackBits ---------------------------------------------------------------------------------
def packbits(data: bytes, row: int) -> bytes:
    """Each row of ``row`` bytes on its own, as the specification asks."""
    out = bytearray()
    for at in range(0, len(data), row):
        line = data[at : at + row]
        i, n = 0, len(line)
        while i < n:
            j = i + 1
            while j < n and j - i < 128 and line[j] == line[i]:
                j += 1
            if j - i >= 3 or j == n and j - i > 1:
                out += bytes((257 - (j - i), line[i]))
                i = j
                continue
            j = i
            while j < n and j - i < 128 and not (j + 2 < n and line[j] == line[j + 1] == line[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += line[i:j]
            i = j
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while len(out) < size and i < n:
        h = data[i]
        if h < 128:
            out += data[i + 1 : i + 2 + h]
            i += h + 2
        elif h > 128:
            out += data[i + 1 : i + 2] * (257 - h)
            i += 2
        else:
            i += 1
    return bytes(out)


# -- LZW --------------------------------------------------------------------------------------
# Code k after a clear (from 0) has this many bits: the table grows by one a code, early change.
_BITS = np.array([9 if k < 254 else 10 if k < 766 else 11 if k < 1790 else 12 for k in range(3838)], np.int64)
_STARTS = np.concatenate([[0], np.cumsum(_BITS)])
_BYTES = [bytes((i,)) for i in range(256)]


def lzw(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    nxt, k, prefix = FIRST, 0, -1

    def emit(code):
        nonlocal k
        codes.append(code)
        widths.append(int(_BITS[k]))
        k += 1

    get = table.get
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        table[key] = nxt
        nxt += 1
        prefix = b
        if nxt == 4094:
            emit(CLEAR)
            table.clear()
            nxt, k = FIRST, 0
    if prefix >= 0:
        emit(prefix)
    emit(END)
    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    bits = (c[:, None] >> np.maximum(w[:, None] - 1 - np.arange(12), 0)) & 1
    return np.packbits(bits[np.arange(12) < w[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, bit, out, got = len(data) * 8, 0, [], 0
    while bit + 9 <= total and got < size:
        at = bit + _STARTS[:-1]
        n = int(np.searchsorted(at + _BITS, total, side="right"))
        at, w = at[:n], _BITS[:n]
        p = at >> 3
        codes = ((raw[p] << 16 | raw[p + 1] << 8 | raw[p + 2]) >> (24 - (at & 7) - w)) & ((1 << w) - 1)
        codes = codes.tolist()
        table = [*_BYTES, b"", b""]
        add, last, used = table.append, None, 0
        for code in codes:
            used += 1
            if code == CLEAR:
                break
            if code == END:
                return b"".join(out)[:size]
            if last is None:
                word = table[code]
            elif code < len(table):
                word = table[code]
                add(last + word[:1])
            elif code == len(table):
                word = last + last[:1]
                add(word)
            else:
                raise ValueError("LZW code out of range")
            out.append(word)
            got += len(word)
            last = word
        if used == 0:
            break
        bit += int(_STARTS[used])
    return b"".join(out)[:size]


# -- writing ----------------------------------------------------------------------------------
def _squeeze(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(np.uint8)
    raw = block.tobytes()
    if compression == DEFLATE:
        return zlib.compress(raw, 1)
    if compression == LZW:
        return lzw(raw)
    if compression == PACKBITS:
        return packbits(raw, block.shape[1])
    return raw


def build(payload: bytes, schemes=SCHEMES, first: int = 0, order: str = "<") -> bytes:
    """A TIFF whose pages hold the payload, UNIT samples a row and at most PAGE_ROWS rows a page.

    The payload's length must be a positive multiple of UNIT.  Page p takes scheme
    ``schemes[(first + p) % len(schemes)]``.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8))
    pages = [pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)]
    link = 4
    for n, page in enumerate(pages):
        compression, predictor, tiled = schemes[(first + n) % len(schemes)]
        if len(out) % 2:
            out.append(0)
        step = UNIT if tiled else STRIP
        blocks = []
        for i in range(0, len(page), step):
            block = page[i : i + step]
            if tiled and len(block) < step:
                block = np.concatenate([block, np.zeros((step - len(block), UNIT), np.uint8)])
            blocks.append(_squeeze(block, compression, predictor))
        at = []
        for b in blocks:
            at.append(len(out))
            out += b
        if len(out) % 2:
            out.append(0)
        sizes = [len(b) for b in blocks]

        def longs(values):
            if len(values) == 1:
                return values[0]
            where = len(out)
            out.extend(struct.pack(f"{order}{len(values)}I", *values))
            return where

        fields = [(WIDTH, 4, 1, UNIT), (LENGTH, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tiled:
            fields += [(TILE_W, 3, 1, UNIT), (TILE_L, 3, 1, UNIT), (TILE_AT, 4, len(at), longs(at)), (TILE_BYTES, 4, len(at), longs(sizes))]
        else:
            fields += [(STRIP_AT, 4, len(at), longs(at)), (STRIP_ROWS, 3, 1, STRIP), (STRIP_BYTES, 4, len(at), longs(sizes))]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, kind, count, value in sorted(fields):
            out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- reading ----------------------------------------------------------------------------------
def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        p = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, p)
        if kind not in FIELD:
            continue
        size, code = FIELD[kind]
        where = p + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        found[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _expand(block: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return block[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(block, size)
    if compression == LZW:
        return unlzw(block, size)
    if compression == PACKBITS:
        return unpackbits(block, size)
    raise ValueError(f"compression {compression} is not supported")


def _whole(values: tuple) -> tuple[int, ...]:
    """The values of a tag that counts something."""
    if not values or not all(isinstance(v, int) for v in values):
        raise ValueError("a tag isn't a whole number")
    return values


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in directory order.  Whatever is damaged or unsupported raises ValueError, before memory is taken for it."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, number = set(), 0
    try:
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            d, nxt = _directory(data, order, at)
            one = lambda tag, default=None: _whole(d.get(tag, (default,)))[0]  # noqa: B023, E731
            width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
            compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
            if bits not in (8, 16) or one(PLANAR, 1) != 1 or predictor not in (1, 2) or not width or not height or not samples:
                raise ValueError("unsupported page layout")
            kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
            tiled = TILE_AT in d
            bw, bh = (one(TILE_W), one(TILE_L)) if tiled else (width, min(one(STRIP_ROWS, height), height))
            starts, sizes = map(_whole, (d[TILE_AT], d[TILE_BYTES]) if tiled else (d[STRIP_AT], d[STRIP_BYTES]))
            if not bw or not bh:
                raise ValueError("blocks without extent")
            across = -(-width // bw)
            if len(starts) != across * -(-height // bh):
                raise ValueError("another number of blocks than the page's size asks for")
            held = sum(max(0, min(n, len(data) - s)) for s, n in zip(starts, sizes, strict=True))
            if max(width * height, len(starts) * bw * bh if tiled else 0) * samples * kind.itemsize > EXPANSION * held:
                raise ValueError("blocks can't hold what the page's size asks for")
            image = np.zeros((height, width, samples), kind)
            for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
                y, x = k // across * bh, k % across * bw
                rows = bh if tiled else min(bh, height - y)
                want = rows * bw * samples * kind.itemsize
                raw = _expand(data[s : s + n], compression, want)
                if len(raw) < want:
                    raise ValueError("a block is too short")
                block = np.frombuffer(raw, kind).reshape(rows, bw, samples)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
                image[y : y + rows, x : x + bw] = block[: height - y, : width - x]
            yield Page(number, width, height, samples, bits, compression, predictor, tiled, image.tobytes())
            number, at = number + 1, nxt
    except (struct.error, zlib.error, KeyError, IndexError, TypeError, OverflowError, MemoryError) as e:
        raise ValueError(f"damaged TIFF: {e}") from e


def page_rows(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, predictor, tiled, data, error.

    A null or damaged file gives one row whose ``error`` says why and whose other columns are null.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ("page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "data", "error")

    def make():
        def f(cols):
            out = {n: [] for n in (id_col, *names)}

            def put(i, *values):
                for n, v in zip((id_col, *names), (i, *values), strict=True):
                    out[n].append(v)

            for i, data in zip(*cols, strict=True):
                try:
                    for p in pages(bytes(data or b"")):
                        put(i, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None)
                except ValueError as e:
                    put(i, *[None] * 9, str(e))
            return out

        return f

    return arrow_rows(media, make, f"`{id_col}` {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string", id_col, data_col)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text and these with zero bytes up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a TIFF: id, n_bytes, media."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(cols):
            got = [payload_of(t) for t in cols[1]]
            return {id_col: cols[0], "n_bytes": [n for n, _ in got], "media": [build(p, first=zlib.crc32(p)) for _, p in got]}

        return f

    return arrow_rows(docs, make, f"`{id_col}` {kind}, n_bytes long, media binary", id_col, text_col)


def features(counts: np.ndarray, n_pages: int) -> str:
    """Pages, mean, deviation and entropy of the samples, rounded."""
    n, v = int(counts.sum()), np.arange(256)
    mean = float((counts * v).sum() / n)
    dev = math.sqrt(max(0.0, float((counts * v * v).sum() / n) - mean * mean))
    p = counts[counts > 0] / n
    return f"pages={n_pages};mean={mean:.4f};dev={dev:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


def digest(docs: DataFrame) -> DataFrame:
    """Per document: what comes back from its stored TIFF, hashed and described.

    Null text counts as empty, which is stored as one unit of zero bytes.  Texts are stored whole, however long;
    equal texts have equal values; rows with one id get a row each; other columns aren't read and may have
    any name; an empty table gives an empty result.
    """

    def make():
        def f(cols):
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out = {"doc_id": cols[0]} | {n: [] for n in names}
            for text in cols[1]:
                n, payload = payload_of(text)
                media = build(payload, first=zlib.crc32(payload))
                sha, counts, size, tail, count = hashlib.sha256(), np.zeros(256, np.int64), 0, b"", 0
                for p in pages(media):
                    sha.update(p.data)
                    counts += np.bincount(np.frombuffer(p.data, np.uint8), minlength=256)
                    size, tail, count = size + len(p.data), (tail + p.data)[-UNIT:], count + 1
                for k, v in zip(names, (n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), features(counts, count)), strict=True):
                    out[k].append(v)
            return out

        return f

    return arrow_rows(docs, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "doc_id", "text")
