"""A parser that the caller feeds: chunks in, records, batches or counts of the records they complete out."""

from __future__ import annotations

import pyarrow as pa

from ..functions.filters import Filter, check, column
from ..operators.batches import Batch
from ..sources.grammar import ChunkParser
from .api import evaluate
from .errors import DelimitedError
from .options import projection


def _batch(rows: list[list[str]]) -> Batch:
    return Batch(pa.array(rows, pa.list_(pa.string())))


class PushParser:
    """State goes on from chunk to chunk; each ``write_*`` has an ``end_*`` that gives what the last line completes."""

    def __init__(self, delimiter: str = ",", encoding: str = "utf8", strict: bool = False, fixed_columns: int | None = None):
        self._p, self._open = ChunkParser(delimiter, encoding, strict, fixed_columns), True

    def _refuse_strict(self, operation: str) -> None:
        if self._p.strict:
            raise DelimitedError(f"strict CSV validation is not supported for {operation}")

    def _take(self, chunk: bytes | None) -> list[list[str]]:
        if not self._open:
            raise DelimitedError("parser is closed")
        return self._p.end() if chunk is None else self._p.write(bytes(chunk))

    def _passing(self, chunk: bytes | None, where: Filter | None, operation: str) -> list[list[str]]:
        self._refuse_strict(operation)
        rows = self._take(chunk)
        return rows if check(where) is None else [r for r in rows if evaluate(where, r) is True]

    # -- records ---------------------------------------------------------------------------------
    def write(self, chunk: bytes) -> list[list[str]]:
        return self._take(chunk)

    def end(self) -> list[list[str]]:
        return self._take(None)

    def write_batch(self, chunk: bytes) -> Batch:
        return _batch(self._take(chunk))

    def end_batch(self) -> Batch:
        return _batch(self._take(None))

    # -- projected, filtered records ---------------------------------------------------------------
    def _projected(self, chunk: bytes | None, columns, where: Filter | None) -> Batch:
        picked = projection(columns)
        return _batch([[r[c] if c < len(r) else "" for c in picked] for r in self._passing(chunk, where, "projected batches")])

    def write_projected_batch(self, chunk: bytes, columns, where: Filter | None = None) -> Batch:
        return self._projected(chunk, columns, where)

    def end_projected_batch(self, columns, where: Filter | None = None) -> Batch:
        return self._projected(None, columns, where)

    # -- counts ------------------------------------------------------------------------------------
    def write_count(self, chunk: bytes) -> int:
        return len(self._passing(chunk, None, "count"))

    def end_count(self) -> int:
        return len(self._passing(None, None, "count"))

    def write_count_where(self, chunk: bytes, where: Filter) -> int:
        return len(self._passing(chunk, where, "count filters"))

    def end_count_where(self, where: Filter) -> int:
        return len(self._passing(None, where, "count filters"))

    def write_count_where_equals(self, chunk: bytes, index: int, value) -> int:
        return self.write_count_where(chunk, column(index).equals(value))

    def end_count_where_equals(self, index: int, value) -> int:
        return self.end_count_where(column(index).equals(value))

    def write_count_where_in(self, chunk: bytes, index: int, values) -> int:
        return self.write_count_where(chunk, column(index).is_one_of(values))

    def end_count_where_in(self, index: int, values) -> int:
        return self.end_count_where(column(index).is_one_of(values))

    def write_count_where_starts_with(self, chunk: bytes, index: int, prefix) -> int:
        return self.write_count_where(chunk, column(index).starts_with(prefix))

    def end_count_where_starts_with(self, index: int, prefix) -> int:
        return self.end_count_where(column(index).starts_with(prefix))

    # -- life --------------------------------------------------------------------------------------
    def reset(self) -> None:
        self._p.reset()

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> PushParser:
        return self

    def __exit__(self, *_) -> None:
        self.close()
