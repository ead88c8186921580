"""Options of the calls, checked before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from ..functions.filters import Filter, check, column_index, from_list
from ..sources.codecs import normalize
from ..sources.grammar import delimiter_of, encoding_of
from .errors import DelimitedError
from .limits import DEFAULT_CHUNK, MAX_FIXED_COLUMNS, MAX_PROJECTION


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    encoding: str = "utf8"
    chunk_size: int = DEFAULT_CHUNK
    compression: Any = None
    columns: tuple[int, ...] | None = None
    selected_columns: tuple[int, ...] | None = None
    where: Filter | None = None
    filters: tuple[dict, ...] | None = None
    strict: bool = False
    fixed_columns: int | None = None
    expected_headers: tuple[str, ...] | None = None
    require_header: bool = False
    min_data_rows: int | None = None
    worker_count: int = 1
    #: False promises that no file holds a quote, which saves looking.
    quotes: bool | None = None

    @property
    def has_schema(self) -> bool:
        return self.expected_headers is not None or self.require_header or self.min_data_rows is not None

    @property
    def projection(self) -> tuple[int, ...] | None:
        return self.columns


class RowsOptions(Options):
    """Options of ``rows``."""


class CountOptions(Options):
    """Options of ``count``."""


class ColumnarOptions(Options):
    """Options of ``columnar``."""


class RowViewOptions(Options):
    """Options of ``row_views``."""


def projection(columns) -> tuple[int, ...]:
    if len(columns) > MAX_PROJECTION:
        raise DelimitedError(f"selected column count out of range: {len(columns)}")
    seen = set()
    for c in columns:
        column_index(c, "selected column")
        if c in seen:
            raise DelimitedError(f"selected column repeated: {c}")
        seen.add(c)
    return tuple(columns)


def options(given: Options | None = None, /, **more) -> Options:
    """Checked and normalised options."""
    known = {f.name for f in fields(Options)}
    if bad := next((k for k in more if k not in known), None):
        raise DelimitedError(f"options contains unknown property: {bad}")
    o = replace(given or Options(), **more)
    if o.columns is not None and o.selected_columns is not None:
        raise DelimitedError("columns and selectedColumns cannot be used together")
    if o.where is not None and o.filters is not None:
        raise DelimitedError("where and filters cannot be used together")
    columns = o.columns if o.columns is not None else o.selected_columns
    columns = projection(columns) if columns is not None else None
    if o.delimiter != "auto":
        delimiter_of(o.delimiter)
    encoding_of(o.encoding)
    if isinstance(o.chunk_size, bool) or not isinstance(o.chunk_size, int) or o.chunk_size < 1:
        raise DelimitedError("chunk size must be a positive safe integer")
    if o.fixed_columns is not None and (isinstance(o.fixed_columns, bool) or not isinstance(o.fixed_columns, int) or not 1 <= o.fixed_columns <= MAX_FIXED_COLUMNS):
        raise DelimitedError(f"fixedColumns must be an integer from 1 through {MAX_FIXED_COLUMNS}: {o.fixed_columns}")
    if o.min_data_rows is not None and (isinstance(o.min_data_rows, bool) or not isinstance(o.min_data_rows, int) or o.min_data_rows < 0):
        raise DelimitedError(f"minDataRows must be a non-negative integer: {o.min_data_rows}")
    if isinstance(o.worker_count, bool) or not isinstance(o.worker_count, int) or o.worker_count < 1:
        raise DelimitedError("workerCount must be a positive safe integer")
    where = check(o.where) if o.filters is None else from_list(list(o.filters))
    return replace(o, columns=columns, selected_columns=None, where=where, filters=None, compression=normalize(o.compression))


def refuse(o: Options, operation: str, *, strict: bool = False, schema: bool = False, compression: bool = False, auto: bool = False) -> None:
    """Combinations that an operation doesn't offer."""
    if strict and o.strict:
        raise DelimitedError(f"strict CSV validation is not supported for {operation}")
    if schema and o.has_schema:
        raise DelimitedError(f"strict CSV schema validation is not supported for {operation}")
    if compression and o.compression is not None:
        raise DelimitedError(f"{operation} does not support compressed input because compressed byte offsets cannot be sharded")
    if auto and o.delimiter == "auto":
        raise DelimitedError(f"{operation} does not support automatic delimiter detection because byte offsets are resolved first")


def parallel(o: Options, operation: str) -> None:
    refuse(o, operation, strict=True, compression=True, auto=True)
