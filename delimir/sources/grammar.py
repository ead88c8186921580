"""The record grammar.

A quote opens a quoted field only at a field's start; inside it two quotes are one, and delimiter
and line ends are data; what follows a closing quote is kept as it is.  LF, CR and CRLF end a
record; a blank line is a record of one empty field; a last line without an end is a record if it
has anything.  Nothing is trimmed, and a byte-order mark is data.  Strict reading rejects quotes
elsewhere and unclosed ones.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import sys
from collections.abc import Iterable, Iterator

from ..plans.errors import DelimitedError

csv.field_size_limit(sys.maxsize)

# Encoding names, in lower case, and Python's names for them.
ENCODINGS = {"utf8": "utf-8", "latin1": "iso-8859-1", "iso88591": "iso-8859-1", "iso-8859-1": "iso-8859-1"}
# Messages that users match on.
QUOTED = "strict CSV quote syntax error: unescaped quote in quoted field"
UNQUOTED = "strict CSV quote syntax error: unescaped quote in unquoted field"
UNTERMINATED = "strict CSV quote syntax error: unterminated quoted field"
RAGGED = "strict CSV row column count mismatch"
FIXED = "fixed row column count mismatch"


def encoding_of(name: str) -> str:
    try:
        return ENCODINGS[name.lower()]
    except (KeyError, AttributeError):
        raise DelimitedError(f"unsupported encoding: {name}") from None


def delimiter_of(value: str) -> str:
    """One ASCII character other than NUL, line ends and the quote."""
    if not isinstance(value, str) or len(value) != 1 or not value.isascii() or value in '\0\n\r"':
        raise DelimitedError(f"delimiter must be one safe ASCII character or auto: {json.dumps(value)}")
    return value


class _Chunks(io.RawIOBase):
    """A raw stream over an iterator of byte strings."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.rest = iter(chunks), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            got = next(self.chunks, None)
            if got is None:
                return 0
            self.rest = got
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def records(chunks: Iterable[bytes], delimiter: str = ",", encoding: str = "utf8") -> Iterator[list[str]]:
    """Records of a byte stream by the permissive grammar, whatever its chunks."""
    raw = io.BufferedReader(_Chunks(chunks), 1 << 20)
    text = io.TextIOWrapper(raw, encoding=encoding_of(encoding), errors="replace", newline="")
    for row in csv.reader(text, delimiter=delimiter, quotechar='"', doublequote=True, strict=False):
        yield row or [""]


class ChunkParser:
    """A push parser: write chunks, get whole records back, then end().

    Chunks may be cut anywhere.  ``strict`` checks quotes and that all records are as wide as the
    first; ``fixed_columns`` instead asks for that width.
    """

    def __init__(self, delimiter: str = ",", encoding: str = "utf8", strict: bool = False, fixed_columns: int | None = None):
        self.delimiter, self.encoding = delimiter_of(delimiter), encoding_of(encoding)
        self.strict, self.fixed = strict, fixed_columns
        self.special = re.compile(f'["\r\n{re.escape(self.delimiter)}]')
        self.stop = re.compile(f"[\r\n{re.escape(self.delimiter)}]") if not strict else self.special
        self.reset()

    def reset(self) -> None:
        self.decoder = codecs.getincrementaldecoder(self.encoding)("replace")
        self.row: list[str] = []
        self.field: list[str] = []
        self.state = "start"  # start of a field, plain, quoted, quote (one seen inside)
        self.begun = self.after_cr = self.closed = False
        self.width: int | None = None

    def _record(self, out: list[list[str]]) -> None:
        self.row.append("".join(self.field))
        row, self.row, self.field = self.row, [], []
        self.state, self.begun = "start", False
        if self.fixed is not None:
            if len(row) != self.fixed:
                raise DelimitedError(FIXED)
        elif self.strict:
            if self.width is None:
                self.width = len(row)
            elif len(row) != self.width:
                raise DelimitedError(RAGGED)
        out.append(row)

    def write(self, chunk: bytes) -> list[list[str]]:
        if self.closed:
            raise DelimitedError("parser is closed")
        return self._take(self.decoder.decode(chunk))

    def end(self) -> list[list[str]]:
        out = self._take(self.decoder.decode(b"", True))
        if self.state == "quoted" and self.strict:
            raise DelimitedError(UNTERMINATED)
        if self.begun:
            self._record(out)
        self.closed = True
        return out

    def _take(self, s: str) -> list[list[str]]:
        out: list[list[str]] = []
        i, n, d = 0, len(s), self.delimiter
        while i < n:
            c = s[i]
            if self.after_cr:
                self.after_cr = False
                if c == "\n":
                    i += 1
                    continue
            if self.state == "quoted":
                j = s.find('"', i)
                self.field.append(s[i:] if j < 0 else s[i:j])
                i = n if j < 0 else j + 1
                if j >= 0:
                    self.state = "quote"
                continue
            if self.state == "quote":
                if c == '"':
                    self.field.append('"')
                    self.state = "quoted"
                    i += 1
                    continue
                if self.strict and c not in (d, "\r", "\n"):
                    raise DelimitedError(QUOTED)
                self.state = "plain"
            if c == '"' and self.state == "start":
                self.state, self.begun = "quoted", True
                i += 1
                continue
            m = self.stop.search(s, i)
            j = m.start() if m else n
            if j > i:
                self.field.append(s[i:j])
                self.state, self.begun = "plain", True
            i = j
            if i >= n:
                break
            c = s[i]
            i += 1
            if c == d:
                self.row.append("".join(self.field))
                self.field, self.state, self.begun = [], "start", True
            elif c == '"':
                if self.strict:
                    raise DelimitedError(UNQUOTED)
                self.field.append(c)
            else:
                self.after_cr = c == "\r"
                self._record(out)
        return out


def strict_records(chunks: Iterable[bytes], delimiter: str, encoding: str, fixed_columns: int | None = None, quotes: bool = True) -> Iterator[list[str]]:
    """Records with their quotes and widths checked (``quotes`` False: only a fixed width)."""
    p = ChunkParser(delimiter, encoding, quotes, fixed_columns)
    for c in chunks:
        yield from p.write(c)
    yield from p.end()


def parse(data: bytes, delimiter: str = ",", encoding: str = "utf8") -> list[list[str]]:
    return list(records([bytes(data)], delimiter_of(delimiter), encoding))


def trusted_newline_rows(data: bytes) -> int:
    """Line feeds, and one more if the last byte ends no line; quotes aren't looked at."""
    return data.count(b"\n") + (bool(data) and data[-1:] not in (b"\n", b"\r"))


def record_count(chunks: Iterable[bytes], delimiter: str) -> int:
    """How many records; chunks without quotes are only searched for line ends."""
    n, p, filled, after_cr, field_start = 0, None, False, False, True
    d = delimiter.encode()
    for c in chunks:
        if p is None and b'"' not in c:
            if after_cr and c[:1] == b"\n":
                c = c[1:]
            if c:
                n += c.count(b"\n") + c.count(b"\r") - c.count(b"\r\n")
                last = c[-1:]
                filled, after_cr, field_start = last not in b"\r\n", last == b"\r", last in b"\r\n" + d
            else:
                after_cr = False
            continue
        if p is None:
            p = ChunkParser(delimiter, "latin1")
            p.begun, p.after_cr, p.state = filled, after_cr, "start" if field_start else "plain"
        n += len(p.write(c))
        if p.state == "start" and not p.begun:
            filled, after_cr, field_start, p = False, p.after_cr, True, None
    return n + (len(p.end()) if p else filled)


class HeaderCheck:
    """Expected headers and least number of data rows, record by record."""

    def __init__(self, expected: list[str] | None = None, required: bool = False, least: int | None = None):
        self.expected, self.required, self.least, self.seen = expected, required, least, 0

    def row(self, row: list[str]) -> list[str]:
        self.seen += 1
        if self.seen == 1 and self.expected is not None:
            if len(row) != len(self.expected):
                raise DelimitedError(f"strict CSV schema error: expected {len(self.expected)} header field(s), got {len(row)}")
            for i, (want, got) in enumerate(zip(self.expected, row, strict=True)):
                if want != got:
                    raise DelimitedError(f"strict CSV schema error: header mismatch at column {i}: expected {json.dumps(want, ensure_ascii=False)}, got {json.dumps(got, ensure_ascii=False)}")
        return row

    def finish(self) -> None:
        if not self.seen and (self.required or self.expected is not None):
            raise DelimitedError("strict CSV schema error: missing header row")
        if self.least is not None and (got := max(0, self.seen - 1)) < self.least:
            raise DelimitedError(f"strict CSV schema error: expected at least {self.least} data row(s), got {got}")
