"""Shared plumbing of the training-data operators: shared folders, written tables, Arrow maps."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, that one Python step holds at a time; a single larger text is a step of its own.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent (single-machine tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="delimir-shared-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root if ":" in root.split("/")[0] else f"file://{root}"


def _hadoop_delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_hadoop_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of what is written already; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and ``most`` bytes of its string or binary ``column``, one row at least."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        n = max(1, min(rows, int(np.searchsorted(size, size[at] + most, side="right")) - 1 - at))
        yield batch.slice(at, n)
        at += n


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[list], list[dict] | dict]], schema: str, *inputs: str) -> DataFrame:
    """``mapInArrow`` in slices of the last input's text (see ``slices``).

    ``make()`` runs once per task and returns ``f(columns) -> dict of output columns``.
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out_schema)
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, len(names) - 1):
                got = f([part.column(i).to_pylist() for i in range(len(names))])
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in target], schema=target)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, out_schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)
