"""The public calls.  Each takes a session and a path and gives a DataFrame, a number or local batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..functions.filters import Filter, all_, any_, column, not_
from ..functions.regex import Regex, regex
from ..operators import batches as _batches
from ..operators import scan as _scan
from ..sources import grammar
from ..sources.sharding import safe_shards, safe_split_offsets
from .errors import DelimitedError
from .options import Options, options, parallel, refuse

__all__ = ["Filter", "Pool", "Regex", "all_", "any_", "batches", "column", "columnar_batches", "count", "count_file", "first_rows", "for_each_row_view", "header_objects", "map_batches", "map_row_views", "not_", "parallel_count", "parallel_rows", "parse", "parse_file", "parse_projected", "regex", "row_views", "rows", "safe_shards", "safe_split_offsets", "worker_pool"]


def _no_filtered_strict(o: Options) -> None:
    if o.where is not None and o.strict:
        refuse(o, "filtered rows", strict=True)


def parse(data: bytes, given: Options | None = None, /, **more) -> list[list[str]]:
    """All records of one buffer, on the driver; ``scan.parse_column`` does the same for a column of buffers."""
    o = options(given, **more)
    if o.compression is not None:
        raise DelimitedError("compression is not supported for in-memory parsing")
    if o.delimiter == "auto":
        raise DelimitedError("automatic delimiter detection is not supported for in-memory parsing")
    _no_filtered_strict(o)
    if o.strict or o.fixed_columns is not None and o.where is None and o.columns is None:
        found = list(grammar.strict_records([bytes(data)], o.delimiter, o.encoding, o.fixed_columns, o.strict))
        if o.strict:
            c = grammar.HeaderCheck(list(o.expected_headers) if o.expected_headers is not None else None, o.require_header, o.min_data_rows)
            found = [c.row(r) for r in found]
            c.finish()
    else:
        found = list(grammar.records([bytes(data)], o.delimiter, o.encoding))
    if o.where is not None:
        found = [r for r in found if evaluate(o.where, r) is True]
    return found if o.columns is None else [[r[c] if c < len(r) else "" for c in o.columns] for r in found]


def evaluate(f: Filter, row: list[str]) -> bool | None:
    """A filter on one local record, patterns included; None is unknown."""
    if f.kind in ("all", "any"):
        got = [evaluate(p, row) for p in f.parts]
        stop = f.kind == "any"
        return stop if stop in got else None if None in got else not stop
    if f.kind == "not":
        got = evaluate(f.parts[0], row)
        return None if got is None else not got
    if f.kind == "regex":
        if f.column >= len(row):
            return None
        return f.values[0].found_in(row[f.column])
    from ..functions.filters import to_predicate

    return to_predicate(f)(row)


def rows(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> DataFrame:
    """(_file, _shard, _pos, fields) of the records that pass.  With ``worker_count`` over 1 shards are read in parallel, in no order."""
    o = options(given, **more)
    _no_filtered_strict(o)
    if o.worker_count > 1:
        parallel(o, "parallel rows")
    return _scan.scan(spark, path, o)


def first_rows(spark: SparkSession, path: str, n: int, given: Options | None = None, /, **more) -> DataFrame:
    """The first n records that pass, in file order.  Shards are read in order, a few at a time, until there are n; what comes after isn't read."""
    from dataclasses import replace

    o = replace(options(given, **more), worker_count=1)
    _no_filtered_strict(o)
    df = _scan.project(_scan.keep(_scan.source(spark, path, o, None if o.strict else _scan.looked_at(o)), o.where), o.columns)
    return spark.createDataFrame(df.limit(n).collect(), df.schema)  # limits take partitions in the source's order


def parallel_rows(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> DataFrame:
    o = options(given, **more)
    if o.worker_count < 2:
        raise DelimitedError(f"parallel rows require workerCount > 1: {o.worker_count}")
    parallel(o, "parallel rows")
    return _scan.scan(spark, path, o)


def _counted(o: Options) -> Options:
    """For counts a projection only has to be valid, and a fixed width matters only in strict reading."""
    from dataclasses import replace

    return replace(o, columns=None if o.where is None else (), fixed_columns=o.fixed_columns if o.strict else None)


def count(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> int:
    """Records that pass, the header among them."""
    o = options(given, **more)
    _no_filtered_strict(o)
    if o.worker_count > 1:
        parallel(o, "parallel count")
    return counted(spark, path, o).count()


def counted(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """The records of a count; without a filter the source leaves their fields out."""
    o = _counted(o)
    if o.where is None and not o.strict:
        if _scan.can_be_fast(o) and (_scan.quote_free(spark, path) if o.quotes is None else not o.quotes):
            return spark.read.text(path)
        return _scan.source(spark, path, o, needed=[])
    return _scan.scan(spark, path, o)


def parallel_count(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> int:
    o = options(given, **more)
    if o.worker_count < 2:
        raise DelimitedError(f"parallel count require workerCount > 1: {o.worker_count}")
    parallel(o, "parallel count")
    return counted(spark, path, o).count()


def count_file(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> int:
    """The older count: no schema checks."""
    o = options(given, **more)
    refuse(o, "countCsvFile", schema=True)
    return count(spark, path, o)


def parse_file(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> DataFrame:
    return rows(spark, path, given, **more)


def parse_projected(spark: SparkSession, path: str, columns: list[int], given: Options | None = None, /, equals_filter: tuple[int, str] | None = None, filters: list[dict] | None = None, **more) -> DataFrame:
    """The older projected read: one equality or a list of filters, not both."""
    if equals_filter is not None and filters is not None:
        raise DelimitedError("equalsFilter and filters cannot be used together")
    where = column(equals_filter[0]).equals(equals_filter[1]) if equals_filter is not None else None
    o = options(given, columns=tuple(columns), where=where, filters=tuple(filters) if filters is not None else None, **more)
    refuse(o, "parseCsvFileProjected", strict=o.where is not None, schema=True)
    return _scan.scan(spark, path, o)


def batches(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> Iterator[_batches.Batch]:
    """Local batches in file order; each is closed when the next is asked for.

    As in the scans, a projection without a filter leaves physical records as they are.
    """
    o = options(given, **more)
    _no_filtered_strict(o)
    from dataclasses import replace

    df = _scan.scan(spark, path, o if o.where is not None else replace(o, columns=None))
    for b in _batches.local_batches(df.orderBy("_file", "_shard", "_pos")):
        with b:
            yield b


def map_batches(spark: SparkSession, path: str, f: Callable[[_batches.Batch], Iterator[tuple]], schema: str, given: Options | None = None, /, **more) -> DataFrame:
    """The batches' form for clusters: f runs in the scan's tasks and yields rows of ``schema``.  Records are projected as in ``rows``."""
    o = options(given, **more)
    _no_filtered_strict(o)
    return _batches.in_tasks(_scan.scan(spark, path, o), f, schema)


def map_row_views(spark: SparkSession, path: str, f: Callable[[_batches.RowView], tuple | None], schema: str, given: Options | None = None, /, **more) -> DataFrame:
    """The row views' form for clusters: f(view) runs in the scan's tasks; column indexes are physical."""
    o = options(given, **more)
    _no_filtered_strict(o)
    if o.worker_count > 1:
        raise DelimitedError("row views do not support workerCount")
    from dataclasses import replace

    return _batches.views_in_tasks(_scan.scan(spark, path, replace(o, columns=None)), f, schema, o.columns)


def for_each_row_view(spark: SparkSession, path: str, callback: Callable[[_batches.RowView], None], given: Options | None = None, /, **more) -> None:
    """callback(view) for each record on the driver; a view holds only during its call."""
    o = options(given, **more)
    _no_filtered_strict(o)
    if o.worker_count > 1:
        raise DelimitedError("row views do not support workerCount")
    from dataclasses import replace

    columns = o.columns
    df = _scan.scan(spark, path, replace(o, columns=None))
    for b in _batches.local_batches(df.orderBy("_file", "_shard", "_pos")):
        view = _batches.RowView(b, columns)
        for view.row in range(b.row_count):
            callback(view)
        b.close()


row_views = for_each_row_view


def columnar_batches(spark: SparkSession, path: str, callback: Callable[[_batches.Batch], None], given: Options | None = None, /, **more) -> None:
    """callback(batch) over projected records; column indexes are those of the projection."""
    o = options(given, **more)
    _no_filtered_strict(o)
    if o.columns is not None:
        refuse(o, "columnar projection", strict=True)
    for b in _batches.local_batches(_scan.scan(spark, path, o).orderBy("_file", "_shard", "_pos")):
        with b:
            callback(b)


def header_objects(spark: SparkSession, path: str, given: Options | None = None, /, header: bool = True, **more) -> DataFrame:
    """Data records as named columns: by the first record, or ``_col.1`` and on; missing values are empty, surplus ones dropped."""
    from pyspark.sql import functions as F

    df = rows(spark, path, given, **more)
    first = first_rows(spark, path, 1, given, **more).first()
    if first is None:
        return spark.createDataFrame([], "_pos long")
    names = first["fields"] if header else [f"_col.{i + 1}" for i in range(len(first["fields"]))]
    if header:  # of the same file only the first task's first record
        name = first["_file"].rsplit("/", 1)[-1]
        own = df.where(F.endswith("_file", F.lit(f"/{name}"))).agg(F.min(F.struct("_file", "_shard", "_pos")).alias("m")).first()["m"]
        df = df.where(~((F.col("_file") == own["_file"]) & (F.col("_shard") == own["_shard"]) & (F.col("_pos") == own["_pos"])))
    return df.select(*[F.coalesce(_scan.field(i), F.lit("")).alias(n) for i, n in enumerate(names)])


class Pool:
    """Repeated parallel reads of one path: shards are found once; one operation at a time; close() ends a running one."""

    def __init__(self, spark: SparkSession, path: str, o: Options):
        if o.worker_count < 2:
            raise DelimitedError(f"worker pool requires workerCount > 1: {o.worker_count}")
        parallel(o, "worker pool")
        self.spark, self.path, self.o = spark, path, o
        self._busy, self._closed, self._group = threading.Lock(), False, f"pool-{uuid.uuid4().hex}"
        self._frame = _scan.source(spark, path, o)

    def _run(self, action, more: dict):
        if self._closed:
            raise DelimitedError("worker pool is closed")
        if not self._busy.acquire(blocking=False):
            raise DelimitedError("worker pool is busy")
        try:
            o = options(self.o, **more)
            _no_filtered_strict(o)
            self.spark.sparkContext.setJobGroup(self._group, f"pool over {self.path}", True)
            return action(_scan.project(_scan.keep(self._frame, o.where), o.columns))
        finally:
            self._busy.release()

    def count(self, **more) -> int:
        return self._run(lambda df: df.count(), more)

    def rows(self, **more) -> list[list[str]]:
        return self._run(lambda df: [r[0] for r in df.select("fields").collect()], more)

    def frame(self, **more) -> DataFrame:
        return self._run(lambda df: df, more)

    def close(self) -> None:
        self._closed = True
        self.spark.sparkContext.cancelJobGroup(self._group)

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def worker_pool(spark: SparkSession, path: str, given: Options | None = None, /, **more) -> Pool:
    return Pool(spark, path, options(given, **more))
