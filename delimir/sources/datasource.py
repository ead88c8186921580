"""The Spark data source ``delimited``: exact records of delimited files as ``fields array<string>``.

Plain files are cut into record-safe shards of about ``shardbytes``; compressed and strict input is one
partition a file.  ``columns`` and ``where`` let a scan drop fields and rows while reading; the plan
above still applies them, so they only save work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

from ..functions.filters import Filter, from_json, to_predicate
from ..plans.limits import DEFAULT_CHUNK
from . import codecs, grammar
from .sharding import record_pattern, safe_split_offsets
from .sniff import detect_delimiter, hint_of
from .storage import files_of, local_path, size_of

SCHEMA = "_file string, _shard long, _pos long, fields array<string>"
ARROW = pa.schema([("_file", pa.string()), ("_shard", pa.int64()), ("_pos", pa.int64()), ("fields", pa.list_(pa.string()))])
BATCH = 8192
#: Shards of plain files are about this large.
SHARD_BYTES = 64 << 20


def empty_records(n: int, path: str, shard: int, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """n records of which nothing but their place is asked for."""
    for at in range(0, n, size):
        k = min(size, n - at)
        zeros = pa.array(np.zeros(k + 1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(zeros[:k]), pa.array(np.full(k, shard)), pa.array(np.arange(at, at + k)), pa.ListArray.from_arrays(zeros, pa.array([], pa.string()))], schema=ARROW)


def whole_blocks(chunks: Iterator[bytes], delimiter: str) -> Iterator[bytes]:
    """The same bytes, cut where records end; the last block may lack its end."""
    many, _ = record_pattern(delimiter)
    rest, grown = [], 0
    for c in chunks:
        rest.append(c)
        grown += len(c)
        if grown < rest_limit(len(rest[0])):
            continue
        data = b"".join(rest)
        # without quotes the last line feed ends a record; a CR may still have its LF to come
        cut = data.rfind(b"\n") + 1 if b'"' not in data and b"\r" not in data else many.match(data).end()
        if cut and data[cut - 1 : cut] == b"\r" and cut == len(data):
            cut = many.match(data, 0, cut - 1).end()
        if cut:
            yield data[:cut]
        rest = [data[cut:]] if cut < len(data) else []
        grown = 0
    if rest:
        yield b"".join(rest)


def rest_limit(held: int) -> int:
    """A long unfinished record is joined anew only when as much again has come."""
    return held // 2


def cut_fields(block: bytes, delimiter: str, encoding: str) -> pa.ListArray | None:
    """Fields of whole records without quotes, cut by Arrow; None if the block has a quote."""
    if b'"' in block:
        return None
    if b"\r" in block:
        block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if block.endswith(b"\n"):
        block = block[:-1]
    text = pa.array([block.decode(grammar.encoding_of(encoding), "replace")], pa.string())
    return pc.split_pattern(pc.split_pattern(text, "\n").flatten(), delimiter)


def field_of(fields: pa.ListArray, i: int) -> pa.Array:
    """Field i of each record, null where there is none."""
    at = fields.offsets.to_numpy()
    place = np.where(at[1:] - at[:-1] > i, at[:-1] + i, -1)
    return fields.values.take(pa.array(place, pa.int64(), mask=place < 0))


def mask_of(f: Filter, fields: pa.ListArray) -> pa.Array:
    """A filter without patterns on many records, with its three values."""
    if f.kind == "not":
        return pc.invert(mask_of(f.parts[0], fields))
    if f.kind in ("all", "any"):
        join = pc.and_kleene if f.kind == "all" else pc.or_kleene
        return reduce(join, (mask_of(p, fields) for p in f.parts))
    x = field_of(fields, f.column)
    if f.kind == "startsWith":
        return pc.starts_with(x, f.values[0])
    found = pc.if_else(pc.is_valid(x), pc.is_in(x, pa.array(list(f.values), pa.string())), pa.scalar(None, pa.bool_()))
    return found if f.kind in ("equals", "in") else pc.invert(found)


def pruned(fields: pa.ListArray, columns: list[int]) -> pa.ListArray:
    """The records with only these columns' values, in place: what comes after the last is cut off, others are empty."""
    at = fields.offsets.to_numpy().astype(np.int64)
    width = np.minimum(np.diff(at), max(columns, default=-1) + 1)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    column = np.arange(offsets[-1]) - np.repeat(offsets[:-1], width)
    want = np.zeros(max(columns, default=0) + 1, bool)
    want[columns] = True
    place = np.repeat(at[:-1], width) + column
    asked = pa.array(want[column]) if len(column) else pa.array([], pa.bool_())
    values = pc.if_else(asked, fields.values.take(pa.array(place)), pa.scalar("", pa.string()))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def block_batches(chunks: Iterator[bytes], delimiter: str, encoding: str, path: str, shard: int, where: Filter | None, columns: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of all records that pass, with the values of ``columns`` (None: all); blocks with quotes go through the tokenizer."""
    pos = 0
    keep = to_predicate(where) if where else None
    for block in whole_blocks(chunks, delimiter):
        fields = cut_fields(block, delimiter, encoding)
        if fields is None:
            n = 0

            def counted(block=block):
                nonlocal n
                for r in grammar.records([block], delimiter, encoding):
                    n += 1
                    yield r

            for b in batches(counted(), path, shard, columns, keep, columns != [], pos=pos):
                yield b
            pos += n
            continue
        at = np.arange(pos, pos + len(fields))
        pos += len(fields)
        if where is not None:
            hit = np.flatnonzero(mask_of(where, fields).fill_null(False).to_numpy(zero_copy_only=False))
            fields, at = fields.take(pa.array(hit)), at[hit]
        if columns is not None:
            fields = pruned(fields, columns)
        for lo in range(0, len(fields), BATCH):
            part = fields.slice(lo, BATCH)
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(pa.array(np.zeros(len(part), np.int32))), pa.array(np.full(len(part), shard)), pa.array(at[lo : lo + BATCH]), part], schema=ARROW)


@dataclass
class Shard(InputPartition):
    path: str
    start: int
    end: int | None
    delimiter: str


def compression_from(options: dict):
    text = options.get("compression", "none")
    return codecs.normalize(json.loads(text) if text.startswith("{") else text)


def resolve_delimiter(path: str, delimiter: str, compression, part: bool = False) -> str:
    """The delimiter given, or the one the file's first rows show.  An empty ``part`` of a folder has nothing to cut, so any will do."""
    if delimiter != "auto":
        return grammar.delimiter_of(delimiter)
    chunks = codecs.open_chunks(path, compression)
    if part:
        first = next(filter(None, chunks), None)
        if first is None:
            return ","
        chunks = chain([first], chunks)
    return detect_delimiter(chunks, hint_of(path, compression))


def batches(rows: Iterator[list[str]], path: str, shard: int, columns: list[int] | None, keep, fields: bool = True, pos: int = 0) -> Iterator[pa.RecordBatch]:
    """Arrow batches of records; ``columns`` keeps only these fields' values in place, others become empty."""
    held, at = [], []
    want = None if columns is None else frozenset(columns)

    def out():
        lengths = np.fromiter(map(len, held), np.int32, len(held))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = pa.array(list(chain.from_iterable(held)), pa.string())
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, shard)), pa.array(at, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], schema=ARROW)

    for row in rows:
        if keep is None or keep(row) is True:
            held.append(row if want is None else [x if i in want else "" for i, x in enumerate(row)] if fields else [])
            at.append(pos)
            if len(held) == BATCH:
                yield out()
                held, at = [], []
        pos += 1
    if held:
        yield out()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.compression = compression_from(options)
        self.strict = options.get("strict", "false") == "true"
        self.fixed = int(options["fixedcolumns"]) if "fixedcolumns" in options else None
        self.chunk = int(options.get("chunksize", DEFAULT_CHUNK))
        self.encoding = options.get("encoding", "utf8")
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        self.where = options.get("where")
        self.known = json.loads(options.get("offsets", "{}"))

    def whole(self) -> bool:
        return self.strict or self.compression is not None or self.fixed is not None

    def partitions(self) -> list[Shard]:
        out = []
        asked = int(self.o.get("shards", 0))
        per = int(self.o.get("shardbytes", SHARD_BYTES))
        files = files_of(self.o["path"])
        part = files != [local_path(self.o["path"]) or self.o["path"]]
        for path in files:
            delimiter = resolve_delimiter(path, self.o.get("delimiter", ","), self.compression, part)
            if self.whole() or local_path(path) is None and path not in self.known:
                out.append(Shard(path, 0, None, delimiter))
                continue
            n = asked or max(1, -(-size_of(path) // per))
            at = self.known.get(path) or safe_split_offsets(path, n, delimiter)
            out += [Shard(path, a, b, delimiter) for a, b in zip(at[:-1], at[1:], strict=True)]
        return out or [Shard("", 0, 0, ",")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        chunks = codecs.open_chunks(partition.path, self.compression, self.chunk, partition.start, partition.end)
        if self.columns == [] and not self.where and not self.strict and self.fixed is None:
            yield from empty_records(grammar.record_count(chunks, partition.delimiter), partition.path, partition.start)
            return
        where = from_json(json.loads(self.where)) if self.where else None
        if not self.strict and self.fixed is None:
            yield from block_batches(chunks, partition.delimiter, self.encoding, partition.path, partition.start, where, self.columns)
            return
        keep = to_predicate(where) if where else None
        rows = grammar.strict_records(chunks, partition.delimiter, self.encoding, self.fixed, self.strict)
        if self.strict:
            rows = self.checked(rows)
        yield from batches(rows, partition.path, partition.start, self.columns, keep, self.columns != [])

    def checked(self, rows):
        headers = json.loads(self.o["expectedheaders"]) if "expectedheaders" in self.o else None
        c = grammar.HeaderCheck(headers, self.o.get("requireheader") == "true", int(self.o["mindatarows"]) if "mindatarows" in self.o else None)
        for r in rows:
            yield c.row(r)
        c.finish()


class StreamReader(DataSourceStreamReader):
    """Files of a folder as they come, in name order: each batch takes those after the last one's name, a task each."""

    def __init__(self, options: dict):
        self.o, self.inner = options, Reader(options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(files_of(self.o["path"]), default="")}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        c = self.inner.compression
        return [Shard(p, 0, None, resolve_delimiter(p, self.o.get("delimiter", ","), c, part=True)) for p in files_of(self.o["path"]) if start["after"] < p <= end["after"]]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)

    def commit(self, end: dict) -> None:
        pass


class DelimitedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(DelimitedSource)
