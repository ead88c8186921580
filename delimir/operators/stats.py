"""Counts and measures over records; all of them partial aggregates, merged after one small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import field


def batch_metrics(df: DataFrame) -> DataFrame:
    """One row: records, fields and bytes of fields."""
    sizes = F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.size("fields")), F.lit(0)).cast("long").alias("total_fields"), F.coalesce(F.sum(sizes), F.lit(0)).alias("data_length"))


def checksum(df: DataFrame) -> DataFrame:
    """One row: records, cells and characters (code points)."""
    chars = F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("fields")), F.lit(0)).cast("long").alias("n_cells"), F.coalesce(F.sum(chars), F.lit(0)).alias("n_chars"))


def cardinality(df: DataFrame, columns: list[int]) -> DataFrame:
    """Per column: records, distinct values and the share of repeats; a missing value is empty."""
    cells = df.select(F.posexplode(F.array(*[F.coalesce(field(c), F.lit("")) for c in columns])).alias("k", "value"))
    number = F.get(F.array(*[F.lit(c) for c in columns]), F.col("k"))
    by_value = cells.groupBy("k", "value").agg(F.count("*").alias("n"))
    out = by_value.groupBy("k").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"))
    return out.select(number.alias("col"), "n_rows", "n_distinct", (1 - F.col("n_distinct") / F.col("n_rows")).alias("duplicate_ratio"))


def top_values(df: DataFrame, column: int, n: int) -> DataFrame:
    """The n most frequent values of a column; ties by value."""
    return df.groupBy(F.coalesce(field(column), F.lit("")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(n)


def field_ranges(df: DataFrame) -> DataFrame:
    """(_file, _shard, _pos, col, start, end): byte ranges of fields within their record's values."""
    ends = F.aggregate("fields", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.octet_length(x)))
    e = df.withColumn("_ends", ends).select("_file", "_shard", "_pos", F.posexplode("fields").alias("col", "_v"), "_ends")
    return e.select("_file", "_shard", "_pos", "col", F.get("_ends", F.col("col")).alias("start"), F.get("_ends", F.col("col") + 1).alias("end"))
