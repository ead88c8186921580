"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from delimir import queries as q
    from delimir.functions.filters import all_, column
    from delimir.plans import api
    from delimir.sources.storage import files_of, size_of

    lines = q.text_of(spark, sf_dir, "lineitem", q.WHOLE_LINE)
    pages = q.text_of(spark, sf_dir, "pages", ("page_id", "url", "html"))
    size = sum(map(size_of, files_of(lines)))
    many = copies(files_of(lines), 20)
    where = all_(column(8).equals("R"), column(9).does_not_equal("O"))
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = {
        "count_all": lambda: api.count(spark, lines, quotes=False),
        "count_where": lambda: api.count(spark, lines, where=column(8).equals("R"), quotes=False),
        "project_filter": lambda: sink(api.rows(spark, lines, columns=(0, 8, 10), where=where, quotes=False).select("fields")),
        "materialize_all": lambda: sink(api.rows(spark, lines, quotes=False).select("fields")),
        "materialize_selected": lambda: sink(api.rows(spark, lines, columns=(0, 8, 10), quotes=False).select("fields")),
        "count_all_exact": lambda: api.count(spark, lines, quotes=True),
        "count_where_exact": lambda: api.count(spark, lines, where=column(8).equals("R"), quotes=True),
        "materialize_all_exact": lambda: sink(api.rows(spark, lines, quotes=True).select("fields")),
        "count_all_x20": lambda: api.count(spark, many, quotes=False),
        "project_filter_x20": lambda: sink(api.rows(spark, many, columns=(0, 8, 10), where=where, quotes=False).select("fields")),
        "materialize_all_x20": lambda: sink(api.rows(spark, many, quotes=False).select("fields")),
        "count_all_exact_x20": lambda: api.count(spark, many, quotes=True),
        "project_filter_exact_x20": lambda: sink(api.rows(spark, many, columns=(0, 8, 10), where=where, quotes=True).select("fields")),
        "count_where_x20": lambda: api.count(spark, many, where=column(8).equals("R"), quotes=False),
        "materialize_selected_x20": lambda: sink(api.rows(spark, many, columns=(0, 8, 10), quotes=False).select("fields")),
        "materialize_all_exact_x20": lambda: sink(api.rows(spark, many, quotes=True).select("fields")),
        "count_where_exact_x20": lambda: api.count(spark, many, where=column(8).equals("R"), quotes=True),
        "multiline_pages_exact": lambda: sink(api.rows(spark, pages).select("fields")),
    }
    times = {}
    for name, run in runs.items():
        run()  # compile, start workers
        best = min(timed(run) for _ in range(3))
        times[name] = round(best, 4)
    total = round(sum(times.values()), 4)
    print(json.dumps({"metric": "headline scan queries, best of 3, summed", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name, "input_bytes": size, "mib_per_s": {k: round(size * (20 if "x20" in k else 1) / 2**20 / v, 1) for k, v in times.items() if "pages" not in k}}))
    spark.stop()


def copies(files: list[str], n: int) -> str:
    """A folder that holds each file n times, so that throughput shows beside the fixed costs."""
    import shutil

    folder = tempfile.mkdtemp(prefix="bench-x-")
    for i in range(n):
        for f in files:
            shutil.copy(f.removeprefix("file://"), f"{folder}/{i:02d}-{os.path.basename(f)}")
    return folder


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


if __name__ == "__main__":
    main()
