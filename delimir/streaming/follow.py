"""Records of files that keep arriving in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scan import keep, literal_pattern, project
from ..plans.options import Options, options
from ..sources import datasource


def follow(spark: SparkSession, folder: str, given: Options | None = None, /, **more) -> DataFrame:
    """A streaming DataFrame (_file, _shard, _pos, fields).  Files are taken in name order, so names must grow."""
    o = options(given, **more)
    datasource.register(spark)
    r = spark.readStream.format("delimited").option("path", folder).option("delimiter", o.delimiter).option("encoding", o.encoding)
    if isinstance(o.compression, str):
        r = r.option("compression", o.compression)
    return project(keep(r.load(), o.where), o.columns)


def follow_lines(spark: SparkSession, folder: str, delimiter: str = ",", where=None, columns=None) -> DataFrame:
    """The same for files without quotes, by Spark's own text stream: split over executors, in the JVM."""
    from pyspark.sql import functions as F

    o = options(delimiter=delimiter, where=where, columns=columns)
    df = spark.readStream.text(folder)
    df = df.select(F.col("_metadata.file_path").alias("_file"), F.split("value", literal_pattern(delimiter), -1).alias("fields"))
    return project(keep(df, o.where), o.columns)
