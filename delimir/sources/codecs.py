"""Compressed sources: gzip, deflate, raw deflate, Brotli, Zstandard and one ZIP entry."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from ..plans.errors import DelimitedError
from ..plans.limits import DEFAULT_CHUNK, ZIP_OUTPUT_BYTES, ZIP_RATIO
from .storage import chunks_of, open_bytes

FORMATS = ("auto", "gzip", "deflate", "deflate-raw", "brotli", "zstd")
# File name endings and the formats they name.
ENDINGS = {".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd", ".deflate": "deflate", ".zlib": "deflate", ".zz": "deflate", ".br": "brotli", ".deflate-raw": "deflate-raw"}
SIGNED = (".gz", ".gzip", ".zst", ".zstd", ".deflate", ".zlib", ".zz")


@dataclass(frozen=True)
class Zip:
    """One entry of an archive: its exact name, or ``*`` if it holds exactly one file."""

    entry: str
    max_decompressed_bytes: int = ZIP_OUTPUT_BYTES
    max_compression_ratio: int = ZIP_RATIO


def ending(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return next((e for e in sorted(ENDINGS, key=len, reverse=True) if name.endswith(e)), None)


def _zlib_header(p: bytes) -> bool:
    return len(p) >= 2 and p[0] & 15 == 8 and p[0] >> 4 <= 7 and (p[0] << 8 | p[1]) % 31 == 0


def detect(path: str, prefix: bytes) -> str:
    """The format by a file's first four bytes and its ending."""
    strong = None
    if prefix[:2] == b"\x1f\x8b":
        strong = "gzip"
    elif prefix[:4] == b"\x28\xb5\x2f\xfd" or len(prefix) >= 4 and 0x50 <= prefix[0] <= 0x5F and prefix[1:4] == b"\x2a\x4d\x18":
        strong = "zstd"
    end = ending(path)
    if strong:
        if end and ENDINGS[end] != strong:
            raise DelimitedError(f"compression auto-detection mismatch: extension {end} indicates {ENDINGS[end]}, but the file signature indicates {strong}")
        return strong
    if end in SIGNED:
        if ENDINGS[end] == "deflate":
            if _zlib_header(prefix):
                return "deflate"
            if end == ".deflate":
                raise DelimitedError("compression auto-detection is ambiguous for .deflate input; specify compression: 'deflate-raw' when the stream has no zlib wrapper")
        raise DelimitedError(f"compression auto-detection failed: extension {end} does not match the file signature")
    if end:
        return ENDINGS[end]
    if _zlib_header(prefix):
        return "deflate"
    raise DelimitedError("compression auto-detection failed: no supported signature or extension; specify compression as 'brotli' or 'deflate-raw' when applicable")


def normalize(compression) -> str | Zip | None:
    if compression in (None, "none"):
        return None
    if isinstance(compression, dict):
        if compression.get("format") != "zip" or not isinstance(compression.get("entry"), str) or not compression["entry"]:
            raise DelimitedError(f"unsupported compression format: {compression.get('format')}")
        compression = Zip(compression["entry"], compression.get("maxDecompressedBytes", ZIP_OUTPUT_BYTES), compression.get("maxCompressionRatio", ZIP_RATIO))
    if isinstance(compression, Zip):
        for v, label in ((compression.max_decompressed_bytes, "maxDecompressedBytes"), (compression.max_compression_ratio, "maxCompressionRatio")):
            if isinstance(v, bool) or not isinstance(v, int) or v < 1:
                raise DelimitedError(f"{label} must be a positive safe integer")
        return compression
    if compression not in FORMATS:
        raise DelimitedError(f"unsupported compression format: {compression}")
    return compression


def open_chunks(path: str, compression=None, chunk: int = DEFAULT_CHUNK, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Decompressed bytes of a file; a range only of plain files."""
    how = normalize(compression)
    if how is None:
        return chunks_of(open_bytes(path), chunk, start, end)
    if isinstance(how, Zip):
        return _zip(path, how, chunk)
    if how == "auto":
        with open_bytes(path) as f:
            how = detect(path, f.read(4))
    raw = chunks_of(open_bytes(path), chunk)
    if how in ("brotli", "zstd"):
        return _arrow(path, how, chunk)
    return _inflate(raw, {"gzip": 31, "deflate": 15, "deflate-raw": -15}[how], how)


def _inflate(raw: Iterator[bytes], bits: int, how: str) -> Iterator[bytes]:
    d, begun = zlib.decompressobj(bits), False
    try:
        for c in raw:
            begun = True
            while c:
                got = d.decompress(c, DEFAULT_CHUNK)
                if got:
                    yield got
                c = d.unconsumed_tail
                if d.eof:  # gzip members may follow one another
                    c = d.unused_data
                    if not c.strip(b"\0") or how != "gzip":
                        c = b""
                    else:
                        d = zlib.decompressobj(bits)
        while not d.eof and (got := d.decompress(d.unconsumed_tail, DEFAULT_CHUNK)):
            yield got
    except zlib.error as e:
        raise DelimitedError(f"{how} input is damaged: {e}") from e
    if begun and not d.eof:
        raise DelimitedError(f"{how} input ends early")


def _arrow(path: str, how: str, chunk: int) -> Iterator[bytes]:
    import pyarrow as pa

    with open_bytes(path) as f, pa.CompressedInputStream(pa.PythonFile(f, "r"), how) as s:
        try:
            while got := s.read(chunk):
                yield got
        except (OSError, pa.ArrowException) as e:
            raise DelimitedError(f"{how} input is damaged: {e}") from e


def _zip_fail(what: str) -> DelimitedError:
    return DelimitedError(f"native ZIP reader failed: {what}")


def zip_entry(archive: zipfile.ZipFile, z: Zip) -> zipfile.ZipInfo:
    """The chosen entry, checked before anything is read."""
    infos = archive.infolist()
    names = [i.filename for i in infos]
    if len(set(names)) != len(names):
        raise _zip_fail("duplicate entry names")
    if z.entry == "*":
        files = [i for i in infos if not i.is_dir()]
        if len(files) != 1:
            raise _zip_fail(f"archive must contain exactly one file, found {len(files)}")
        info = files[0]
    else:
        info = next((i for i in infos if i.filename == z.entry), None)
        if info is None:
            raise _zip_fail(f"entry not found: {z.entry}")
    if info.is_dir():
        raise _zip_fail("selected entry is a directory")
    if info.flag_bits & 0x2041:
        raise _zip_fail("encrypted entries are not supported")
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise _zip_fail(f"unsupported compression method: {info.compress_type}")
    if info.file_size > z.max_decompressed_bytes:
        raise _zip_fail("decompressed size limit exceeded")
    if info.file_size > z.max_compression_ratio * max(1, info.compress_size):
        raise _zip_fail("compression ratio limit exceeded")
    return info


def _zip(path: str, z: Zip, chunk: int) -> Iterator[bytes]:
    with open_bytes(path) as f:
        try:
            with zipfile.ZipFile(f) as archive:
                info, total = zip_entry(archive, z), 0
                with archive.open(info) as entry:  # checks the local header, and the CRC at the end
                    while got := entry.read(chunk):
                        total += len(got)
                        if total > z.max_decompressed_bytes:
                            raise _zip_fail("decompressed size limit exceeded")
                        yield got
                if total != info.file_size:
                    raise _zip_fail("size mismatch")
        except (zipfile.BadZipFile, NotImplementedError, zlib.error, EOFError) as e:
            raise _zip_fail(str(e)) from e
