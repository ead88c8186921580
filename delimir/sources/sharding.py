"""Splitting a plain file at record boundaries.

One pass over the mapped file: whole records are skipped by one regular expression match per
target, so quotes are honoured at the speed of the matcher and nothing is built per record.
"""

from __future__ import annotations

import mmap
import re

from ..plans.errors import DelimitedError
from .grammar import delimiter_of
from .storage import local_path, size_of


def record_pattern(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """(whole records, one record) with their line ends; nothing is matched twice."""
    d = re.escape(delimiter)
    plain = f"[^{d}\r\n]*+"
    field = f'(?:"[^"]*+(?:""[^"]*+)*+"{plain}|(?!"){plain})'
    record = f"(?:{field}(?:{d}{field})*+(?:\r\n|\r|\n))"
    return re.compile(f"{record}*+".encode()), re.compile(record.encode())


def check_splittable(operation: str, compression, delimiter: str) -> None:
    if compression not in (None, "none"):
        raise DelimitedError(f"{operation} does not support compressed input because compressed byte offsets cannot be sharded")
    if delimiter == "auto":
        raise DelimitedError(f"{operation} does not support automatic delimiter detection because byte offsets are resolved first")


def safe_split_offsets(path: str, count: int, delimiter: str = ",", compression=None, operation: str = "csv.findCsvSafeSplitOffsets") -> list[int]:
    """Offsets where the file can be cut into up to ``count`` shards: 0, the first record end at or past each equal share, the size."""
    check_splittable(operation, compression, delimiter)
    if isinstance(count, bool) or not isinstance(count, int) or count < 1:
        raise DelimitedError(f"invalid shard count: {count}")
    delimiter_of(delimiter)
    size = size_of(path)
    if not size:
        return [0]
    local = local_path(path)
    if count == 1 or local is None:  # a store's file is one shard: its bytes would have to pass through the driver
        return [0, size]
    many, one = record_pattern(delimiter)
    out = [0]
    with open(local, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        at = 0
        for i in range(1, count):
            target = size * i // count
            if out[-1] >= target and out[-1] > 0:
                continue
            at = many.match(data, at, target).end() if target > at else at
            if at and data[at - 1 : at + 1] == b"\r\n":
                at += 1
            if at < target:
                m = one.match(data, at)
                if not m:
                    break
                at = m.end()
            if at >= size:
                break
            if at > out[-1]:
                out.append(at)
    return [*out, size]


def safe_shards(path: str, count: int, delimiter: str = ",", compression=None) -> list[tuple[int, int]]:
    """Inclusive byte ranges between the offsets; there may be fewer than ``count``."""
    at = safe_split_offsets(path, count, delimiter, compression, "csv.findCsvSafeShards")
    return [(a, b - 1) for a, b in zip(at[:-1], at[1:], strict=True)]


# -- the same, block by block -------------------------------------------------------------------
# What a byte may find: a record's start, a field's start within a record, a plain field, a quoted
# one, a quote inside it, a record's start after CR.
RECORD, FIELD, PLAIN, QUOTED, QUOTE, AFTER_CR = range(6)


class BlockScanner:
    """Where records end in a block, for every state in which the block may begin.

    Blocks can so be scanned in parallel; putting them together takes one step a block.
    """

    def __init__(self, delimiter: str):
        self.d = delimiter.encode()
        self.many, _ = record_pattern(delimiter)
        self.stop = re.compile(b"[\r\n" + re.escape(self.d) + b"]")

    def advance(self, data: bytes, at: int, state: int) -> tuple[int, int]:
        """(position after the first record end or -1, state there or at the block's end)."""
        n = len(data)
        while at < n:
            if state == QUOTED:
                q = data.find(b'"', at)
                if q < 0:
                    return -1, QUOTED
                at, state = q + 1, QUOTE
                continue
            if state == QUOTE and data[at : at + 1] == b'"':
                at, state = at + 1, QUOTED
                continue
            if state in (RECORD, FIELD) and data[at : at + 1] == b'"':
                at, state = at + 1, QUOTED
                continue
            m = self.stop.search(data, at)
            if not m:
                return -1, PLAIN
            at = m.end()
            if m[0] == self.d:
                state = FIELD
            elif m[0] == b"\r":
                if at == n:
                    return at, AFTER_CR
                return at + (data[at : at + 1] == b"\n"), RECORD
            else:
                return at, RECORD
        return -1, state

    def scan(self, data: bytes) -> list[tuple[int, int]]:
        """Per starting state: the first place at which a record begins (-1: none) and the state after the block."""
        ends: dict[int, int] = {}

        def end_from(at: int) -> int:
            if at not in ends:
                last = self.many.match(data, at).end()
                if last == len(data):
                    ends[at] = (AFTER_CR if data[-1:] == b"\r" else RECORD) if last > at else RECORD
                else:
                    ends[at] = self.advance(data, last, RECORD)[1]
            return ends[at]

        out = []
        for state in range(6):
            if not data:
                out.append((0, state) if state in (RECORD, AFTER_CR) else (-1, state))
            elif state == RECORD or state == AFTER_CR:
                at = int(state == AFTER_CR and data[:1] == b"\n")
                out.append((at, end_from(at)))
            else:
                at, after = self.advance(data, 0, state)
                # after a CR at the very end the next block says where the record begins
                out.append((-1, after) if at < 0 or after == AFTER_CR else (at, end_from(at)))
        return out


def offsets_from_blocks(starts: list[int], scans: list[list[tuple[int, int]]], size: int) -> list[int]:
    """Shard offsets from each block's place and scan, in order."""
    out, state = [0], RECORD
    for start, scan in zip(starts, scans, strict=True):
        at, state = scan[state]
        if at >= 0 and out[-1] < start + at < size:
            out.append(start + at)
    return [*out, size] if size else [0]


def split_files(spark, sizes: dict[str, int], per: int, delimiter: str = ",", tasks: int = 10_000) -> dict[str, list[int]]:
    """Shard offsets of many files by one Spark job, in stores too: blocks of about ``per`` bytes are scanned for all
    states in tasks, a file's scans are put together in a task, and only the offsets reach the driver."""
    import pyarrow as pa

    delimiter_of(delimiter)
    blocks = []
    for path, size in sizes.items():
        if not size:
            continue
        n = max(1, -(-size // per))
        cut = sorted({size * i // n for i in range(n)})
        blocks += [(path, a, b) for a, b in zip(cut, [*cut[1:], size], strict=True)]
    out = {path: [0] for path, size in sizes.items() if not size}
    if not blocks:
        return out

    def scanned(batches):
        from .storage import open_bytes

        scanner = BlockScanner(delimiter)
        for batch in batches:
            found = []
            for path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_bytes(path) as f:
                    f.seek(a)
                    found.append([x for pair in scanner.scan(f.read(b - a)) for x in pair])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["path", "a", "b", "scan"])

    def joined(batches):
        now, starts, scans, size = None, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([offsets_from_blocks(starts, scans, size)], pa.list_(pa.int64()))], names=["path", "offsets"])

        for batch in batches:
            for path, a, b, scan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    if now is not None:
                        yield done()
                    now, starts, scans = path, [], []
                starts.append(a)
                scans.append(list(zip(scan[::2], scan[1::2], strict=True)))
                size = b
        if now is not None:
            yield done()

    rows = spark.createDataFrame(blocks, "path string, a long, b long").repartition(min(tasks, len(blocks)))
    by_file = rows.mapInArrow(scanned, "path string, a long, b long, scan array<long>").repartition("path").sortWithinPartitions("path", "a")
    return out | {r.path: r.offsets for r in by_file.mapInArrow(joined, "path string, offsets array<long>").collect()}


def parallel_split_offsets(spark, path: str, count: int, delimiter: str = ",") -> list[int]:
    """``safe_split_offsets`` of one file by a Spark job."""
    size = size_of(path)
    return split_files(spark, {path: size}, max(1, -(-size // count)), delimiter)[path]
