"""Normalised output: delimited text and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grammar import delimiter_of


def serialize(row: list[str], delimiter: str = ",") -> str:
    """A record as normalised text without its line end: quotes only where they are needed."""
    special = set('"\r\n' + delimiter)
    return delimiter.join('"' + x.replace('"', '""') + '"' if special & set(x) else x for x in row)


def to_json_line(row: list[str]) -> str:
    return json.dumps(row, ensure_ascii=False, separators=(",", ":"))


def record_text(fields: Column, delimiter: str = ",") -> Column:
    """``serialize`` as an expression."""
    delimiter_of(delimiter)
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = lambda x: F.contains(x, F.lit('"')) | F.contains(x, F.lit(delimiter)) | F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r"))
    return F.array_join(F.transform(fields, lambda x: F.when(needs(x), quoted(x)).otherwise(x)), delimiter)


def json_text(fields: Column) -> Column:
    """A record as a JSON array of strings."""
    return F.to_json(fields)


def as_fields(df: DataFrame) -> DataFrame:
    """Columns of any type as one ``fields`` column of text; null becomes empty."""
    return df.select(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("fields"))


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", line_end: str = "\n", compression: str = "none", mode: str = "overwrite") -> None:
    """Write ``fields`` as a folder of delimited files, in parallel."""
    w = df.select(record_text(F.col("fields"), delimiter).alias("value")).write.mode(mode).option("compression", compression)
    w.option("lineSep", line_end).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(json_text(F.col("fields")).alias("value")).write.mode(mode).text(path)


def first_records(df: DataFrame, n: int) -> DataFrame:
    """The first n records of any scan in file order; a top-n by position, never a whole sort, but the whole input is read."""
    return df.orderBy("_file", "_shard", "_pos").limit(n)
