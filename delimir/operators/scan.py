"""Scans as DataFrames: the source, the filter and the projection.

Three ways to the same records: files without quotes are physical lines, which Spark's text source
splits in the JVM and over byte ranges; a column of single records is cut by expressions alone;
everything else is read by the exact source.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import Filter, to_column
from ..plans.options import Options
from ..sources import datasource
from ..sources.codecs import Zip
from ..sources.grammar import encoding_of
from ..sources.sharding import split_files
from ..sources.storage import files_of, local_path, open_bytes, size_of

#: Plain files of more than one shard are split by a Spark job; local ones that are this large together at most, by a pass on the driver.
SPLIT_BY_DRIVER = 256 << 20
#: Up to so many files the driver looks at their first bytes itself.
FEW_FILES = 256
#: Up to so many values are searched for in a line before it is cut.
FEW_NEEDLES = 8
COLUMNS = ("_file", "_shard", "_pos", "fields")


def field(i: int) -> Column:
    """Field i of a record; null if it has none."""
    return F.get("fields", F.lit(i))


def filter_json(f: Filter) -> dict | None:
    """What the source can drop rows by, as JSON: the filter without its patterns; None if nothing is left.

    Of ``all`` the other parts still hold; ``any`` and ``not`` must go down whole or not at all.
    """
    if f.parts:
        parts = [filter_json(p) for p in f.parts]
        if f.kind == "all":
            some = [p for p in parts if p is not None]
            return {"all": some} if some else None
        if None in parts or not all(map(whole, f.parts)):
            return None
        return {"not": parts[0]} if f.kind == "not" else {f.kind: parts}
    if not whole(f):
        return None
    values = [v.decode() if isinstance(v, bytes) else v for v in f.values]
    return {"column": f.column, f.kind: values if f.kind in ("in", "notIn") else values[0]}


def whole(f: Filter) -> bool:
    """Whether a filter can go down as it is: no pattern, no bytes that aren't UTF-8."""

    def text(v) -> bool:
        try:
            return not isinstance(v, bytes) or v.decode() is not None
        except UnicodeDecodeError:
            return False

    return all(x.kind != "regex" and all(map(text, x.values)) for x in f.leaves())


def source(spark: SparkSession, path: str, o: Options, needed: list[int] | None = None) -> DataFrame:
    """The exact source; ``needed``: the physical columns that anything above looks at (None: all)."""
    datasource.register(spark)
    r = spark.read.format("delimited").option("delimiter", o.delimiter).option("encoding", o.encoding).option("chunksize", str(o.chunk_size))
    if isinstance(o.compression, Zip):
        z = asdict(o.compression)
        r = r.option("compression", json.dumps({"format": "zip", "entry": z["entry"], "maxDecompressedBytes": z["max_decompressed_bytes"], "maxCompressionRatio": z["max_compression_ratio"]}))
    elif o.compression:
        r = r.option("compression", o.compression)
    if o.worker_count > 1:
        r = r.option("shards", str(o.worker_count))
    if o.strict:
        r = r.option("strict", "true").option("requireheader", str(o.require_header).lower())
        if o.expected_headers is not None:
            r = r.option("expectedheaders", json.dumps(list(o.expected_headers)))
        if o.min_data_rows is not None:
            r = r.option("mindatarows", str(o.min_data_rows))
    if o.fixed_columns is not None and (o.strict or o.where is None and o.columns is None and needed is None):
        r = r.option("fixedcolumns", str(o.fixed_columns))
    if needed is not None:
        r = r.option("columns", json.dumps(needed))
    if o.where is not None and (pushed := filter_json(o.where)) is not None:
        r = r.option("where", json.dumps(pushed))
    plain = o.compression is None and o.delimiter != "auto" and not o.strict and o.fixed_columns is None and o.worker_count == 1
    if plain:
        large = {p: n for p in files_of(path) if (n := size_of(p)) > datasource.SHARD_BYTES}
        if sum(large.values()) <= SPLIT_BY_DRIVER:
            large = {p: n for p, n in large.items() if local_path(p) is None}
        if large:
            r = r.option("offsets", json.dumps(split_files(spark, large, datasource.SHARD_BYTES, o.delimiter)))
    return r.load(path)


def _utf8(encoding: str) -> bool:
    return encoding_of(encoding) == "utf-8"


def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value, _file, _shard): physical lines by Spark's text source."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_shard"))
    return df if _utf8(encoding) else df.withColumn("value", F.decode(F.col("value").cast("binary"), F.lit("ISO-8859-1")))


def quote_free(spark: SparkSession, path: str) -> bool:
    """Whether no file holds a quote or starts with a byte-order mark.  Reads the files once, in the JVM; stops at the first quote."""
    if not spark.read.text(path).where(F.contains("value", F.lit('"'))).isEmpty():
        return False
    files = files_of(path)
    if len(files) <= FEW_FILES:
        return not any(map(marked, files))
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([any(map(marked, b.column(0).to_pylist()))])], names=["marked"])

    many = spark.createDataFrame([(f,) for f in files], "file string").repartition(-(-len(files) // FEW_FILES))
    return many.mapInArrow(run, "marked boolean").where("marked").isEmpty()


def marked(path: str) -> bool:
    """Whether a file starts with a byte-order mark, which the text source would drop."""
    with open_bytes(path) as f:
        return f.read(3) == b"\xef\xbb\xbf"


def literal_pattern(delimiter: str) -> str:
    """A pattern for one character in the form that Java splits without its pattern engine."""
    return "\\" + delimiter if delimiter in ".$|()[{^?*+\\" else delimiter


def needle(f: Filter) -> Column | None:
    """What a line must hold for a record without quotes to pass, as a search in the whole line; None if that says nothing."""
    if f.kind in ("all", "any"):
        parts = [needle(p) for p in f.parts]
        some = [p for p in parts if p is not None]
        if not some or f.kind == "any" and len(some) < len(parts):
            return None
        return reduce(lambda a, b: a & b if f.kind == "all" else a | b, some)
    if f.kind not in ("equals", "in", "startsWith") or not whole(f) or len(f.values) > FEW_NEEDLES:
        return None
    values = [v.decode() if isinstance(v, bytes) else v for v in f.values]
    if "" in values:
        return None
    return reduce(lambda a, b: a | b, [F.contains("value", F.lit(v)) for v in values])


def fast_scan(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """Lines cut at the delimiter, no further than any column is asked for.

    With a filter, lines that can't pass are dropped uncut, and the cut fields are bound once: a filter
    above a plain projection would cut each line again for each of its parts.
    """
    df = lines(spark, path, o.encoding)
    needed = looked_at(o)
    cut = F.split("value", literal_pattern(o.delimiter), -1 if needed is None else max(needed, default=0) + 2)
    if o.where is not None:
        if (must := needle(o.where)) is not None:
            df = df.where(must)
        cut = F.explode(F.array(cut))
    return df.select("_file", "_shard", F.monotonically_increasing_id().alias("_pos"), cut.alias("fields"))


def looked_at(o: Options) -> list[int] | None:
    """The columns that the projection or the filter looks at; None: all."""
    return None if o.columns is None else sorted({*o.columns, *([x.column for x in o.where.leaves()] if o.where else [])})


def can_be_fast(o: Options) -> bool:
    return o.compression is None and o.delimiter != "auto" and not o.strict and o.fixed_columns is None


def scan(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """(_file, _shard, _pos, fields) of all records that pass; ordered within a file by (_shard, _pos)."""
    fast = can_be_fast(o) and (quote_free(spark, path) if o.quotes is None else not o.quotes)
    if fast:
        df = fast_scan(spark, path, o)
    else:
        df = source(spark, path, o, None if o.strict else looked_at(o))
    return project(keep(df, o.where), o.columns)


def keep(df: DataFrame, where: Filter | None) -> DataFrame:
    return df if where is None else df.where(to_column(where, field))


def project(df: DataFrame, columns) -> DataFrame:
    """Only these fields, in this order; a field that a record lacks is empty."""
    if columns is None:
        return df
    picked = F.array(*[F.coalesce(field(c), F.lit("")) for c in columns]) if columns else F.array().cast("array<string>")
    return df.withColumn("fields", picked)


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """Fields as columns; missing ones are null."""
    return df.select(*[field(i).alias(n) for i, n in enumerate(names)])


def record_fields(record: Column, delimiter: str = ",") -> Column:
    """The fields of one complete record held in a string, by expressions alone."""
    d = "\\" + delimiter if not delimiter.isalnum() else delimiter
    body = r'[^"]*+(?:""[^"]*+)*+'
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(f'{d}("{body}"?[^{d}]*|[^{d}]*)'), F.lit(1))

    def one(t):
        inner = F.replace(F.regexp_extract(t, f'(?s)^"({body})"?(.*)$', 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(t, F.lit('"')), F.concat(inner, F.regexp_extract(t, f'(?s)^"({body})"?(.*)$', 2))).otherwise(t)

    return F.transform(parts, one)


def parse_column(df: DataFrame, content: str, delimiter: str = ",", encoding: str = "utf8", key: str | None = None) -> DataFrame:
    """(key, _pos, fields) of all records in a binary or string column, each value a whole file (null: none)."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ..sources.grammar import delimiter_of, records

    delimiter_of(delimiter)
    encoding_of(encoding)
    # strings are UTF-8 already
    how = encoding if dict(df.dtypes)[content] == "binary" else "utf8"
    inner = df.select(*([F.col(key)] if key else []), F.col(content).cast("binary").alias("_content"))
    schema = (f"`{key}` {df.schema[key].dataType.simpleString()}, " if key else "") + "_pos long, fields array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = b.column(b.num_columns - 1)[k].as_py()
                if data is None:
                    continue
                rows, pos = [], 0
                for r in records([data], delimiter, how):
                    rows.append(r)
                    if len(rows) == datasource.BATCH:
                        yield out(b, k, rows, pos)
                        pos, rows = pos + len(rows), []
                if rows:
                    yield out(b, k, rows, pos)

    def out(b, k, rows, pos):
        cols = [pa.array(range(pos, pos + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))]
        names = ["_pos", "fields"]
        if key:
            cols, names = [b.column(0).take(pa.array([k] * len(rows))), *cols], [key, *names]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return inner.mapInArrow(run, schema)


def check_width(df: DataFrame, n: int) -> DataFrame:
    """Fail where a record has not n fields.  A filter, so that counts check it too."""
    bad = F.raise_error(F.lit("fixed row column count mismatch")).cast("boolean")
    return df.where(F.when(F.size("fields") == n, F.lit(True)).otherwise(bad))
