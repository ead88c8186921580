"""Batches of records, in tasks or on the driver: views over Arrow memory, without a string per field."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.errors import DelimitedError


class Batch:
    """Records in order, as one array of bytes with offsets of rows and fields.  Closed batches can't be read."""

    def __init__(self, fields: pa.ListArray):
        self._fields = fields
        rows = fields.offsets.to_numpy().astype(np.uint64)
        self._rows = rows - rows[0]
        values = fields.flatten()
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        _, offsets, data = values.buffers()
        at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if offsets else np.zeros(1, np.int32)
        raw = memoryview(data)[int(at[0]) : int(at[-1])] if data is not None else memoryview(b"")
        self._at, self._data = (at - at[0]).astype(np.uint64), raw
        self._open = True

    def _check(self) -> None:
        if not self._open:
            raise DelimitedError("batch is closed")

    @property
    def closed(self) -> bool:
        return not self._open

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def row_count(self) -> int:
        self._check()
        return len(self._rows) - 1

    @property
    def total_fields(self) -> int:
        self._check()
        return len(self._at) - 1

    @property
    def data_length(self) -> int:
        self._check()
        return len(self._data)

    def data(self) -> bytes:
        return bytes(self.data_view())

    def data_view(self) -> memoryview:
        self._check()
        return self._data

    def row_offsets(self) -> np.ndarray:
        self._check()
        return self._rows.copy()

    def field_offsets(self) -> np.ndarray:
        self._check()
        return self._at.copy()

    def _row(self, row: int) -> int:
        self._check()
        if isinstance(row, bool) or not isinstance(row, int) or not 0 <= row < len(self._rows) - 1:
            raise DelimitedError(f"row index out of range: {row}")
        return row

    def row_field_count(self, row: int) -> int:
        r = self._row(row)
        return int(self._rows[r + 1] - self._rows[r])

    def field_range(self, row: int, column: int) -> tuple[int, int] | None:
        """Byte range of a field; None if the record lacks it."""
        if not 0 <= column < self.row_field_count(row):
            return None
        k = int(self._rows[row]) + column
        return int(self._at[k]), int(self._at[k + 1])

    def field_bytes(self, row: int, column: int) -> memoryview | None:
        r = self.field_range(row, column)
        return None if r is None else self._data[r[0] : r[1]]

    def field_buffer(self, row: int, column: int) -> bytes | None:
        got = self.field_bytes(row, column)
        return None if got is None else bytes(got)

    def field_string(self, row: int, column: int) -> str | None:
        got = self.field_bytes(row, column)
        return None if got is None else str(got, "utf-8", "replace")

    def _span(self, start: int, end: int | None) -> range:
        n = self.row_count
        end = n if end is None else end
        for v in (start, end):
            if not 0 <= v <= n or start > end:
                raise DelimitedError(f"row index out of range: {v}")
        return range(start, end)

    def rows(self) -> list[list[str]]:
        self._check()
        return self._fields.to_pylist()

    def rows_into(self, target: list, columns: list[int] | None = None) -> list:
        """Fill ``target``, reusing its lists; with ``columns`` missing values are empty."""
        n = self.row_count
        del target[n:]
        for r in range(n):
            if r == len(target):
                target.append([])
            width = range(self.row_field_count(r)) if columns is None else columns
            target[r][:] = [self.field_string(r, c) if columns is None else self.field_string(r, c) or "" for c in width]
        return target

    def for_each_row(self, callback: Callable[[list[str], int], None]) -> None:
        for i, row in enumerate(self.rows()):
            callback(row, i)

    def column_ranges(self, column: int, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the records that have the column, and its byte ranges in them."""
        span = self._span(start, end)
        first, after = self._rows[span.start : span.stop].astype(np.int64), self._rows[span.start + 1 : span.stop + 1].astype(np.int64)
        have = np.flatnonzero(first + column < after) if column >= 0 else np.zeros(0, np.int64)
        k = first[have] + column
        return have + span.start, self._at[k], self._at[k + 1]

    def for_each_column_range(self, column: int, callback: Callable[[int, int, int], None], start: int = 0, end: int | None = None) -> None:
        """callback(row, first byte, end) where the record has the column."""
        for r, a, b in zip(*(x.tolist() for x in self.column_ranges(column, start, end)), strict=True):
            callback(r, a, b)

    def for_each_column_bytes(self, column: int, callback: Callable[[memoryview, int], None], start: int = 0, end: int | None = None) -> None:
        for r, a, b in zip(*(x.tolist() for x in self.column_ranges(column, start, end)), strict=True):
            callback(self._data[a:b], r)

    def scan_columns(self, columns: list[int], callback: Callable[[int, list[tuple[int, int]]], None], start: int = 0, end: int | None = None) -> None:
        """callback(row, ranges); a missing field's range is (-1, -1)."""
        span = self._span(start, end)
        table = np.full((len(span), len(columns), 2), -1, np.int64)
        for k, c in enumerate(columns):
            rows, a, b = self.column_ranges(c, start, end)
            table[rows - span.start, k, 0], table[rows - span.start, k, 1] = a, b
        for r, ranges in zip(span, table.tolist(), strict=True):
            callback(r, list(map(tuple, ranges)))

    def count_where_equals(self, column: int, value: str | bytes) -> int:
        """Records whose field is the value, byte by byte, over the batch's memory."""
        self._check()
        want = value.encode() if isinstance(value, str) else bytes(value)
        _, a, b = (x.astype(np.int64) for x in self.column_ranges(column))
        a = a[b - a == len(want)]
        data = np.frombuffer(self._data, np.uint8)
        for k, byte in enumerate(want):
            if not len(a):
                break
            a = a[data[a + k] == byte]
        return len(a)


class RowView:
    """One record of a batch while a callback runs; indexes are always physical columns."""

    __slots__ = ("_batch", "_columns", "row")

    def __init__(self, batch: Batch, columns: tuple[int, ...] | None):
        self._batch, self._columns, self.row = batch, columns, 0

    @property
    def field_count(self) -> int:
        return self._batch.row_field_count(self.row)

    def get(self, column: int) -> str | None:
        return self._batch.field_string(self.row, column)

    get_physical = field_string = get

    def bytes(self, column: int):
        return self._batch.field_bytes(self.row, column)

    def buffer(self, column: int):
        return self._batch.field_buffer(self.row, column)

    def range(self, column: int):
        return self._batch.field_range(self.row, column)

    def pick(self, columns: list[int]) -> list[str]:
        return [self.get(c) or "" for c in columns]

    pick_physical = pick

    def values(self) -> list[str]:
        return [self.get(c) or "" for c in (self._columns if self._columns is not None else range(self.field_count))]


def local_batches(df: DataFrame, rows: int = 8192) -> Iterator[Batch]:
    """Batches on the driver, a Spark partition at a time."""
    held: list[list[str]] = []
    for r in df.select("fields").toLocalIterator(prefetchPartitions=True):
        held.append(r[0])
        if len(held) == rows:
            yield Batch(pa.array(held, pa.list_(pa.string())))
            held = []
    if held:
        yield Batch(pa.array(held, pa.list_(pa.string())))


def in_tasks(df: DataFrame, f: Callable[[Batch], Iterator[tuple]], schema: str) -> DataFrame:
    """f(batch) over batches of a scan's records, in its tasks; what f yields are rows of ``schema``.  A batch is closed after its call."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(arrow):
        for b in arrow:
            with Batch(b.column(0)) as batch:
                rows = list(f(batch))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return df.select("fields").mapInArrow(run, schema)


def views_in_tasks(df: DataFrame, f: Callable[[RowView], tuple | None], schema: str, columns: tuple[int, ...] | None = None) -> DataFrame:
    """f(view) for each record of a scan, in its tasks; what isn't None is a row of ``schema``."""

    def each(batch: Batch) -> Iterator[tuple]:
        view = RowView(batch, columns)
        for view.row in range(batch.row_count):
            if (got := f(view)) is not None:
                yield got

    return in_tasks(df, each, schema)
