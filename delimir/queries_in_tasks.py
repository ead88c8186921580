"""Registered queries whose work is done by the accessors themselves: batches, row views, the push parser, single buffers and the command line, all in tasks.

Each is registered beside the others; ``queries`` imports this module for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions.filters import all_, any_, column, from_list
from .operators import scan as S
from .plans import api
from .plans.errors import DelimitedError
from .plans.options import options
from .sources.storage import files_of

FOUR = "custkey string, name string, nationkey string, segment string"


def in_files(spark: SparkSession, path: str, f: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """f(file) for each file of a folder, a task each."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    files = files_of(path)
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                if rows := f(p):
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, len(files))).mapInArrow(run, schema)


# -- batches --------------------------------------------------------------------------------------
@Q.query(Q.CUSTOMER_SQL)
def batch_rows(spark, sf_dir):
    return api.map_batches(spark, Q.customer(spark, sf_dir), lambda b: map(tuple, b.rows()), FOUR)


@Q.query("SELECT c_mktsegment AS a, '' AS b, CAST(c_custkey AS VARCHAR) AS c FROM customer")
def batch_rows_into(spark, sf_dir):
    """One list, filled again for each batch of a task."""
    target: list = []

    def f(batch):
        return [tuple(r) for r in batch.rows_into(target, [3, 40, 0])]

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "a string, b string, c string")


@Q.query("SELECT c_name AS name, length(c_name) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def batch_for_each_row(spark, sf_dir):
    def f(batch):
        out = []
        batch.for_each_row(lambda row, i: out.append((row[1], len(row[1]))))
        return out

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "name string, n long", where=column(3).equals("BUILDING"))


@Q.query("SELECT count(*) AS records, 4 * count(*) AS cells, CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) + strlen(c_mktsegment)) AS BIGINT) AS n_bytes FROM customer")
def batch_offsets(spark, sf_dir):
    """Offsets of rows and fields say how much a batch holds."""

    def f(batch):
        rows, fields = batch.row_offsets(), batch.field_offsets()
        assert int(fields[-1]) == batch.data_length == len(batch.data()) and int(rows[-1]) == batch.total_fields
        yield len(rows) - 1, len(fields) - 1, int(fields[-1])

    df = api.map_batches(spark, Q.customer(spark, sf_dir), f, "records long, cells long, n_bytes long")
    return df.agg(*[F.sum(c).alias(c) for c in df.columns])


@Q.query("SELECT CASE WHEN text LIKE '%,%' THEN 3 ELSE 2 END AS width, count(*) AS n FROM (SELECT unnest(['a,b', 'c']) AS text FROM nation) GROUP BY 1")
def batch_field_counts(spark, sf_dir):
    """Records of two widths, counted by width."""
    two = Q.read(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("a,b,x\n"), F.lit("c,x\n"))).alias("content"))
    from .operators.batches import in_tasks
    from .operators.scan import parse_column

    df = in_tasks(parse_column(two, "content"), lambda b: [(b.row_field_count(r),) for r in range(b.row_count)], "width int")
    return df.groupBy("width").agg(F.count("*").alias("n"))


@Q.query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def batch_column_bytes(spark, sf_dir):
    def f(batch):
        out = []
        batch.for_each_column_bytes(3, lambda view, row: out.append((str(view, "utf-8"),)))
        return out

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "value string").groupBy("value").agg(F.count("*").alias("n"))


@Q.query("SELECT CAST(sum(strlen(c_name)) AS BIGINT) AS n_bytes, count(*) AS n FROM customer")
def batch_column_ranges(spark, sf_dir):
    def f(batch):
        sizes = []
        batch.for_each_column_range(1, lambda row, a, b: sizes.append(b - a))
        batch.for_each_column_range(70, lambda row, a, b: sizes.append(10**9))
        yield sum(sizes), len(sizes)

    df = api.map_batches(spark, Q.customer(spark, sf_dir), f, "n_bytes long, n long")
    return df.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))


@Q.query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment, -1 AS missing FROM customer")
def batch_scan_columns(spark, sf_dir):
    def f(batch):
        data, out = batch.data(), []
        batch.scan_columns([0, 3, 9], lambda row, r: out.append((data[slice(*r[0])].decode(), data[slice(*r[1])].decode(), r[2][0])))
        return out

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "custkey string, segment string, missing int")


@Q.query("SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS building, 0 AS none, 0 AS missing FROM customer")
def batch_count_where_equals(spark, sf_dir):
    def f(batch):
        yield batch.count_where_equals(3, "BUILDING"), batch.count_where_equals(3, b"BUILD"), batch.count_where_equals(33, "BUILDING")

    df = api.map_batches(spark, Q.customer(spark, sf_dir), f, "building long, none int, missing int")
    return df.agg(F.sum("building").alias("building"), F.sum("none").cast("int").alias("none"), F.sum("missing").cast("int").alias("missing"))


@Q.query("SELECT * FROM (VALUES ('row', 'row index out of range: -1'), ('span', 'row index out of range: 1000000'), ('closed', 'batch is closed'), ('state', 'True')) AS t(what, said)")
def batch_bounds(spark, sf_dir):
    """What batches refuse, and that a closed one knows it."""

    def f(batch):
        out = []

        def refused(what, call):
            try:
                call()
            except DelimitedError as e:
                out.append((what, str(e)))

        refused("row", lambda: batch.row_field_count(-1))
        refused("span", lambda: batch.for_each_column_range(0, print, 0, 1_000_000))
        batch.close()
        refused("closed", batch.rows)
        return [*out, ("state", str(batch.closed))]

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "what string, said string").distinct()


# -- row views and projected batches --------------------------------------------------------------
@Q.query("SELECT c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS custkey, '' AS missing, 4 AS width FROM customer WHERE c_mktsegment <> 'BUILDING'")
def row_views(spark, sf_dir):
    def f(view):
        return None if view.get(3) == "BUILDING" else (*view.pick([3, 0, 50]), view.field_count)

    return api.map_row_views(spark, Q.customer(spark, sf_dir), f, "segment string, custkey string, missing string, width int")


@Q.query("SELECT c_name AS name, strlen(CAST(c_custkey AS VARCHAR)) AS first, strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) AS last FROM customer")
def row_view_bytes(spark, sf_dir):
    """Bytes, and ranges relative to the record's first byte."""

    def f(view):
        base = view.range(0)[0]
        a, b = view.range(1)
        return (bytes(view.bytes(1)).decode(), a - base, b - base) if view.buffer(9) is None else None

    return api.map_row_views(spark, Q.customer(spark, sf_dir), f, "name string, first long, last long")


@Q.query("SELECT c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS b FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def columnar_batches(spark, sf_dir):
    """Batches of projected records: column 0 is the projection's first."""

    def f(batch):
        return [(batch.field_string(r, 0), batch.field_string(r, 1)) for r in range(batch.row_count)]

    return api.map_batches(spark, Q.customer(spark, sf_dir), f, "a string, b string", columns=(3, 0), where=column(3).is_one_of(["BUILDING", "MACHINERY"]))


# -- buffers and the older calls ------------------------------------------------------------------
@Q.query("SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def parse_buffers(spark, sf_dir):
    """One buffer parsed, filtered and projected in a task at a time."""
    import pyarrow as pa

    c = Q.read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("", F.lit('x,"'), "c_name", F.lit('",'), "c_mktsegment", F.lit("\r\n")).cast("binary").alias("content"))
    where = column(2).does_not_equal("BUILDING")

    def run(batches):
        for b in batches:
            got = [(k, *r) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in api.parse(x, where=where, columns=(1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["custkey", "name", "segment"])

    return c.mapInArrow(run, "custkey long, name string, segment string")


@Q.query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS custkey FROM customer WHERE c_nationkey = 7")
def parse_projected(spark, sf_dir):
    return S.named(api.parse_projected(spark, Q.customer(spark, sf_dir), [1, 0], equals_filter=(2, "7")), ["name", "custkey"])


@Q.query("SELECT CAST(c_custkey AS VARCHAR) AS custkey FROM customer WHERE c_nationkey <> 7 AND c_mktsegment IN ('BUILDING', 'FURNITURE')")
def parse_projected_list(spark, sf_dir):
    filters = [{"column": 2, "notEquals": "7"}, {"column": 3, "values": ["BUILDING", "FURNITURE"]}]
    return S.named(api.parse_projected(spark, Q.customer(spark, sf_dir), [0], filters=filters, quotes=True), ["custkey"])


@Q.query(Q.CUSTOMER_SQL)
def parse_file(spark, sf_dir):
    return S.named(api.parse_file(spark, Q.customer(spark, sf_dir, delimiter=";"), delimiter=";"), ["custkey", "name", "nationkey", "segment"])


@Q.query("SELECT count(*) AS n FROM customer")
def count_file(spark, sf_dir):
    return spark.createDataFrame([(api.count_file(spark, Q.customer(spark, sf_dir)),)], "n long")


@Q.query("SELECT c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS custkey FROM customer")
def strict_projection(spark, sf_dir):
    """Whole records are checked, then projected."""
    return S.named(api.rows(spark, Q.customer(spark, sf_dir), strict=True, fixed_columns=4, columns=(3, 0)), ["segment", "custkey"])


@Q.query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, '' AS name, c_mktsegment AS segment FROM customer WHERE c_nationkey <> 7")
def pruned_source(spark, sf_dir):
    """What the exact source itself hands over: columns that nobody asked for are empty, those after the last are gone."""
    o = options(where=column(2).does_not_equal("7"), columns=(0, 3))
    df = S.source(spark, Q.customer(spark, sf_dir), o, [0, 2, 3]).where(F.size("fields") == 4)
    return df.select(S.field(0).alias("custkey"), S.field(1).alias("name"), S.field(3).alias("segment"))


# -- the push parser ------------------------------------------------------------------------------
def _pushed(path: str, make, write, end) -> list:
    """What a parser gives for a file fed in odd chunks."""
    from .plans.push import PushParser
    from .sources.storage import chunks_of, open_bytes

    with PushParser(**make) as p:
        out = [write(p, c) for c in chunks_of(open_bytes(path), 997)]
        return [*out, end(p)]


@Q.query("SELECT page_id, url, html FROM pages")
def push_rows(spark, sf_dir):
    """Files with quoted line ends, in chunks that cut anywhere."""
    path = Q.text_of(spark, sf_dir, "pages", ("page_id", "url", "html"))
    f = lambda p: [tuple(r) for part in _pushed(p, {}, lambda q, c: q.write(c), lambda q: q.end()) for r in part]
    df = in_files(spark, path, f, "page_id string, url string, html string")
    return df.withColumn("page_id", F.col("page_id").cast("long"))


@Q.query("SELECT c_mktsegment AS segment, c_name AS name FROM customer WHERE c_nationkey = 7")
def push_projected_batches(spark, sf_dir):
    where = column(2).equals("7")
    f = lambda p: [tuple(r) for b in _pushed(p, {}, lambda q, c: q.write_projected_batch(c, [3, 1], where), lambda q: q.end_projected_batch([3, 1], where)) for r in b.rows()]
    return in_files(spark, Q.customer(spark, sf_dir), f, "segment string, name string")


@Q.query("SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS eq, count(*) FILTER (c_nationkey IN (1, 2)) AS isin, count(*) FILTER (starts_with(c_name, 'Customer#00000000')) AS prefix, count(*) FILTER (c_mktsegment = 'BUILDING' OR regexp_matches(c_name, '7$')) AS both FROM customer")
def push_counts(spark, sf_dir):
    either = any_(column(3).equals("BUILDING"), column(1).has_match("7$"))

    def f(p):
        forms = (
            (lambda q, c: q.write_count(c), lambda q: q.end_count()),
            (lambda q, c: q.write_count_where_equals(c, 3, "BUILDING"), lambda q: q.end_count_where_equals(3, "BUILDING")),
            (lambda q, c: q.write_count_where_in(c, 2, ["1", "2"]), lambda q: q.end_count_where_in(2, ["1", "2"])),
            (lambda q, c: q.write_count_where_starts_with(c, 1, "Customer#00000000"), lambda q: q.end_count_where_starts_with(1, "Customer#00000000")),
            (lambda q, c: q.write_count_where(c, either), lambda q: q.end_count_where(either)),
        )
        return [tuple(sum(_pushed(p, {}, w, e)) for w, e in forms)]

    names = ("n", "eq", "isin", "prefix", "both")
    df = in_files(spark, Q.customer(spark, sf_dir), f, ", ".join(f"{n} long" for n in names))
    return df.agg(*[F.sum(n).alias(n) for n in names])


# -- the command line -----------------------------------------------------------------------------
def command(*argv: str) -> tuple[int, str, str]:
    """Exit code and what a command writes."""
    import contextlib
    import io

    from .cli import main

    out, err = io.TextIOWrapper(io.BytesIO(), "utf-8", newline=""), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = main(list(argv))
    out.flush()
    return code, out.buffer.getvalue().decode(), err.getvalue()


@Q.query("SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS m FROM customer")
def cli_count(spark, sf_dir):
    f = lambda p: [tuple(int(command("count", p, *more)[1]) for more in ((), ("--where-eq", "3=BUILDING")))]
    df = in_files(spark, Q.customer(spark, sf_dir), f, "n long, m long")
    return df.agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


@Q.query("SELECT concat(c_mktsegment, '|', c_custkey) AS line FROM customer WHERE c_nationkey IN (3, 5) AND c_mktsegment <> 'BUILDING' AND starts_with(c_name, 'Customer#') AND regexp_matches(c_name, '[02468]$')")
def cli_filters(spark, sf_dir):
    """All friendly filter flags at once."""
    flags = ("--where-in", "2=3", "--where-in", "2=5", "--where-neq", "3=BUILDING", "--where-prefix", "1=Customer#", "--where-regex", "1=/[02468]$/", "--columns", "3,0", "--output-delimiter", "|")
    return in_files(spark, Q.customer(spark, sf_dir), lambda p: [(x,) for x in command("lines", p, *flags)[1].splitlines()], "line string")


@Q.query("SELECT to_json([CAST(c_custkey AS VARCHAR), c_mktsegment]) AS line FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 4")
def cli_json(spark, sf_dir):
    where = '{"any": [{"column": 3, "equals": "BUILDING"}, {"column": 2, "in": ["4"]}]}'
    return in_files(spark, Q.customer(spark, sf_dir), lambda p: [(x,) for x in command("lines", p, "--json", "--where", where, "--columns", "0,3")[1].splitlines()], "line string")


_CLI = (
    (("count", "--strict", "--where-eq", "0=x"), 2, "--strict cannot be used with filter options"),
    (("count", "--require-header"), 2, "--require-header requires --strict"),
    (("count", "--zip-entry", "a"), 2, "--zip-entry requires --compression zip"),
    (("count", "--compression", "zip"), 2, "--compression zip requires --zip-entry <path>"),
    (("lines", "--columns", "0", "--selected-columns", "1"), 2, "--columns and --selected-columns cannot be used together"),
    (("lines", "--json", "--output-delimiter", ";"), 2, "--json cannot be combined with --output-delimiter"),
    (("lines", "--columns", "a"), 2, "columns must be comma-separated integers"),
    (("count", "--strict", "--fixed-columns", "9"), 1, "fixed row column count mismatch"),
    (("lines", "--limit", "1"), 0, ""),
)


@Q.query("SELECT * FROM (VALUES " + ", ".join(f"('{' '.join(a)}', {c}, '{m}')" for a, c, m in _CLI) + ") AS t(flags, code, said)")
def cli_refusals(spark, sf_dir):
    """Exit codes and messages, on every file that holds something."""

    def f(p):
        got = []
        for a, _, _ in _CLI:
            code, _, err = command(a[0], p, *a[1:])
            got.append((" ".join(a), code, err.split("\n")[0].removeprefix("csv: ").split(":")[0].strip()))
        return got

    return in_files(spark, Q.customer(spark, sf_dir), f, "flags string, code int, said string").distinct()


# -- what calls refuse ----------------------------------------------------------------------------
def _calls(spark, path: str) -> dict[str, tuple[Callable, str]]:
    strict = "strict CSV validation is not supported for "
    return {
        "empty in": (lambda: column(0).is_one_of([]), ""),
        "empty not in": (lambda: column(0).is_none_of([]), ""),
        "too many parts": (lambda: options(where=all_(*[column(0).equals("x")] * 70_000)), ""),
        "two forms of a filter": (lambda: options(where=column(0).equals("x"), filters=({"column": 0, "value": "x"},)), "where and filters cannot be used together"),
        "filter list": (lambda: from_list([{"column": 0, "value": "a", "prefix": "b"}]), "filters[0] must contain equals, in, notEquals, notIn, startsWith, or regex"),
        "strict and filter": (lambda: api.rows(spark, path, strict=True, where=column(0).equals("x")), f"{strict}filtered rows"),
        "strict and workers": (lambda: api.rows(spark, path, strict=True, worker_count=2), f"{strict}parallel rows"),
        "strict and columnar": (lambda: api.columnar_batches(spark, path, print, strict=True, columns=(0,)), f"{strict}columnar projection"),
        "schema and older count": (lambda: api.count_file(spark, path, strict=True, require_header=True), "strict CSV schema validation is not supported for countCsvFile"),
        "unknown option": (lambda: api.rows(spark, path, delimeter=";"), "options contains unknown property: delimeter"),
        "two projections": (lambda: options(columns=(1,), selected_columns=(2,)), "columns and selectedColumns cannot be used together"),
        "repeated column": (lambda: options(columns=(1, 1)), "selected column repeated: 1"),
        "least rows": (lambda: options(min_data_rows=-1), "minDataRows must be a non-negative integer: -1"),
        "workers": (lambda: options(worker_count=0), "workerCount must be a positive safe integer"),
        "chunk size": (lambda: options(chunk_size=0), "chunk size must be a positive safe integer"),
        "views and workers": (lambda: api.for_each_row_view(spark, path, print, worker_count=2), "row views do not support workerCount"),
        "one worker": (lambda: api.parallel_count(spark, path, worker_count=1), "parallel count require workerCount > 1: 1"),
        "shards of compressed": (lambda: api.safe_shards(path, 2, compression="gzip"), "csv.findCsvSafeShards does not support compressed input because compressed byte offsets cannot be sharded"),
        "offsets of a guess": (lambda: api.safe_split_offsets(path, 2, "auto"), "csv.findCsvSafeSplitOffsets does not support automatic delimiter detection because byte offsets are resolved first"),
        "shard count": (lambda: api.safe_split_offsets(path, 0), "invalid shard count: 0"),
        "workers on compressed": (lambda: api.rows(spark, path, compression="gzip", worker_count=2), "parallel rows does not support compressed input because compressed byte offsets cannot be sharded"),
    }


_REFUSED = {k: m for k, (_, m) in _calls(None, "").items()}


@Q.query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, '{m}')" for k, m in _REFUSED.items()) + ") AS t(what, refused, said)")
def refusals(spark, sf_dir):
    """Calls that must fail before any job starts, and what they say (empty: not compared)."""
    path = files_of(Q.customer(spark, sf_dir))[0]
    rows = []
    for what, (call, said) in _calls(spark, path).items():
        try:
            call()
            rows.append((what, False, ""))
        except DelimitedError as e:
            rows.append((what, True, str(e) if said else ""))
    return spark.createDataFrame(rows, "what string, refused boolean, said string")
