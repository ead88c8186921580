"""Folders that driver and executors share, for files made on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset, as in tests on one machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="delimir-"))
        root = _OWN[0]
    return root if ":" in root.split("/")[0] else f"file://{root}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give tasks this package where they can't import it: not on the path they inherit."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(f"{root}/delimir", f"{top}/tree/delimir", ignore=shutil.ignore_patterns("__pycache__"))
        target = tempfile.mkdtemp(prefix="delimir-ship-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{target}/delimir_package", "zip", f"{top}/tree"))
