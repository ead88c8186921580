"""The engine's registered queries and their SQL.

Inputs are Parquet tables, so a query first has its table written as delimited text -- once per
session, table and form, in parallel, into the shared folder -- and then reads that text back.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import all_, any_, column, from_json, from_list, not_
from .functions.regex import regex
from .operators import scan as S
from .operators import sinks, stats
from .plans import api
from .plans.options import options
from .sources.codecs import Zip
from .sources.sharding import safe_shards
from .sources.storage import files_of
from .sources.workspace import fresh

_WRITTEN: dict[tuple, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...], delimiter: str = ",", line_end: str = "\n", header: bool = False, ending: str = "", pack: str | None = None, latin1: bool = False, where: str | None = None, files: int | None = None) -> str:
    """The folder of a table's text form; made at its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name, columns, delimiter, line_end, header, ending, pack, latin1, where, files)
    if key not in _WRITTEN:
        df = read(spark, sf_dir, name)
        if where:
            df = df.where(where)
        df = df.select(*[F.expr(c) for c in columns])
        if files:
            df = df.coalesce(files)
        path = fresh(spark, name)
        fields = sinks.as_fields(df)
        if header:
            top = spark.range(1).select(F.array(*[F.lit(c.split(" as ")[-1]) for c in columns]).alias("fields"))
            fields = top.unionByName(fields)
        if pack or latin1 or ending:
            _packed(fields, path, delimiter, line_end, ending, pack, latin1)
        else:
            sinks.write_delimited(fields, path, delimiter, line_end)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _packed(fields: DataFrame, path: str, delimiter: str, line_end: str, ending: str, pack: str | None, latin1: bool) -> None:
    """One file a partition, compressed or encoded as asked, written by the tasks."""
    from .sources.storage import create_bytes, move

    def write(batches: Iterator):
        import io
        import zipfile

        import pyarrow as pa
        from pyspark import TaskContext

        raw = b"".join(x.encode(*(("iso-8859-1", "replace") if latin1 else ("utf-8",))) + line_end.encode() for b in batches for x in b.column(0).to_pylist())
        if pack == "gzip":
            import gzip

            raw = gzip.compress(raw)
        elif pack == "deflate":
            raw = zlib.compress(raw)
        elif pack == "deflate-raw":
            c = zlib.compressobj(wbits=-15)
            raw = c.compress(raw) + c.flush()
        elif pack in ("brotli", "zstd"):
            raw = pa.Codec(pack).compress(raw, asbytes=True)
        elif pack == "zip":
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("data/rows.csv", raw)
            raw = out.getvalue()
        name = f"{path}/part-{TaskContext.get().partitionId():05d}{ending}"
        tmp = f"{path}/_part-{TaskContext.get().taskAttemptId()}"
        with create_bytes(tmp) as f:
            f.write(raw)
        move(tmp, name)  # an attempt's file is whole or not there
        yield pa.RecordBatch.from_arrays([pa.array([len(raw)])], names=["n"])

    fields.select(sinks.record_text(F.col("fields"), delimiter).alias("v")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "date_format(l_shipdate, 'yyyy-MM-dd') as l_shipdate")
WHOLE_LINE = (*LINE[:4], "l_quantity", "l_extendedprice", "l_discount", "l_tax", *LINE[4:])
EVENT = ("event_id", "user_id", "event_type", "props")


def customer(spark, sf_dir, **more) -> str:
    return text_of(spark, sf_dir, "customer", CUSTOMER, **more)


def customers(spark, sf_dir, where=None, **more) -> DataFrame:
    """Customers that pass, as named columns."""
    return S.named(api.rows(spark, customer(spark, sf_dir), where=where, **more), ["custkey", "name", "nationkey", "segment"])


CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) nationkey, c_mktsegment AS segment FROM customer"


# -- scans --------------------------------------------------------------------------------------
@query("SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
def rows_nation(spark, sf_dir):
    df = S.named(api.rows(spark, text_of(spark, sf_dir, "nation", ("n_nationkey", "n_name", "n_regionkey"))), ["nationkey", "name", "regionkey"])
    return df.withColumns({c: F.col(c).cast("int") for c in ("nationkey", "regionkey")})


@query(CUSTOMER_SQL)
def rows_customer(spark, sf_dir):
    return customers(spark, sf_dir)


@query(CUSTOMER_SQL)
def rows_exact_source(spark, sf_dir):
    """The same by the exact source."""
    return customers(spark, sf_dir, quotes=True)


@query("SELECT count(*) + 1 AS n FROM lineitem")
def count_all_lineitem(spark, sf_dir):
    path = text_of(spark, sf_dir, "lineitem", LINE, header=True)
    return api.counted(spark, path, options(quotes=False)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def count_exact_lineitem(spark, sf_dir):
    return api.counted(spark, text_of(spark, sf_dir, "lineitem", LINE), options(quotes=True)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")
def filtered_count(spark, sf_dir):
    where = all_(column(4).equals("R"), column(5).does_not_equal("O"))
    return api.rows(spark, text_of(spark, sf_dir, "lineitem", LINE), where=where, quotes=False).agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey AS VARCHAR) orderkey, l_returnflag AS returnflag, strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")
def filtered_project(spark, sf_dir):
    where = all_(column(4).equals("R"), column(5).does_not_equal("O"))
    df = api.rows(spark, text_of(spark, sf_dir, "lineitem", LINE), columns=(0, 4, 6), where=where, quotes=False)
    return S.named(df, ["orderkey", "returnflag", "shipdate"])


# -- filters ------------------------------------------------------------------------------------
def _where(name: str, f, sql: str) -> None:
    def run(spark, sf_dir):
        return customers(spark, sf_dir, where=f() if callable(f) else f)

    run.__name__ = name
    query(f"{CUSTOMER_SQL} WHERE {sql}")(run)


_seg, _name, _nat = column(3), column(1), column(2)
_KEYS = [str(k) for k in range(0, 25, 2)]
_where("where_equals", _seg.equals("BUILDING"), "c_mktsegment = 'BUILDING'")
_where("where_not_equals", _seg.does_not_equal("BUILDING"), "c_mktsegment <> 'BUILDING'")
_where("where_one_of", _seg.is_one_of(["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_where("where_none_of", _seg.is_none_of(["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_where("where_one_of_large", _nat.is_one_of(_KEYS), "CAST(c_nationkey AS VARCHAR) IN (" + ", ".join(f"'{k}'" for k in _KEYS) + ")")
_where("where_bytes_operand", _seg.equals(b"BUILDING"), "c_mktsegment = 'BUILDING'")
_where("where_prefix", _name.starts_with("Customer#0000001"), "starts_with(c_name, 'Customer#0000001')")
_where("where_prefix_empty", _name.starts_with(""), "starts_with(c_name, '')")
_where("where_regex", _name.has_match(regex(r"#0+[1-4]\d?$")), "regexp_matches(c_name, '#0+[1-4]\\d?$')")
_where("where_regex_i", _seg.has_match(regex("^build|TURE$", "i")), "regexp_matches(c_mktsegment, '(?i:^build|TURE$)')")
_where("where_regex_class", _seg.has_match(regex("^[[:upper:]]*[LN]E?$")), "regexp_matches(c_mktsegment, '^[[:upper:]]*[LN]E?$')")
_where("where_regex_boundary", _name.has_match(regex(r"\b0*7\b")), "regexp_matches(c_name, '\\b0*7\\b')")
_where("where_all", all_(_seg.equals("BUILDING"), _nat.equals("7")), "c_mktsegment = 'BUILDING' AND c_nationkey = 7")
_where("where_any", any_(_seg.equals("BUILDING"), _nat.equals("7")), "c_mktsegment = 'BUILDING' OR c_nationkey = 7")
_where("where_not", not_(_seg.equals("BUILDING")), "NOT c_mktsegment = 'BUILDING'")
_where("where_nested", all_(any_(_seg.equals("BUILDING"), not_(_nat.is_one_of(["1", "2", "3"]))), not_(all_(_name.starts_with("Customer#00000000"), _nat.equals("5")))), "(c_mktsegment = 'BUILDING' OR NOT c_nationkey IN (1, 2, 3)) AND NOT (starts_with(c_name, 'Customer#00000000') AND c_nationkey = 5)")
_where("where_list", lambda: from_list([{"column": 3, "values": ["BUILDING", "FURNITURE"]}, {"column": 2, "notEquals": "4"}]), "c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey <> 4")
_where("where_json", lambda: from_json({"all": [{"column": 3, "in": ["BUILDING"]}, {"not": {"column": 2, "equals": "4"}}]}), "c_mktsegment = 'BUILDING' AND c_nationkey <> 4")
_where("where_missing_column", column(9).does_not_equal("x"), "NULL <> 'x'")
_where("where_missing_not", not_(column(9).equals("x")), "NOT (NULL = 'x')")
_where("where_missing_any", any_(column(9).equals("x"), _seg.equals("BUILDING")), "NULL = 'x' OR c_mktsegment = 'BUILDING'")
_where("where_empty_field", _seg.equals(""), "c_mktsegment = ''")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '(?s:^[A-Z].*\\n.*[.]$)')")
def where_regex_s(spark, sf_dir):
    where = column(1).has_match(regex(r"^[A-Z].*\n.*[.]$", "s"))
    return _documents(spark, sf_dir, where=where).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '(?m:^T[a-z]+ .*[.]$)')")
def where_regex_m(spark, sf_dir):
    where = column(1).has_match(regex(r"^T[a-z]+ .*[.]$", "m"))
    return _documents(spark, sf_dir, where=where).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '[.]$')")
def where_regex_dollar(spark, sf_dir):
    return _documents(spark, sf_dir, where=column(1).has_match(regex("[.]$"))).select("doc_id", F.length("text").cast("long").alias("n"))


# -- projection ---------------------------------------------------------------------------------
@query("SELECT c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS b FROM customer")
def project_reorder(spark, sf_dir):
    return S.named(api.rows(spark, customer(spark, sf_dir), columns=(3, 0)), ["a", "b"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS a, '' AS b FROM customer")
def project_missing(spark, sf_dir):
    return S.named(api.rows(spark, customer(spark, sf_dir), columns=(0, 2024)), ["a", "b"])


@query("SELECT c_name AS a FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_unprojected(spark, sf_dir):
    return S.named(api.rows(spark, customer(spark, sf_dir), columns=(1,), where=_seg.equals("BUILDING")), ["a"])


@query("SELECT count(*) AS n, 0 AS width FROM customer")
def project_none(spark, sf_dir):
    return api.rows(spark, customer(spark, sf_dir), columns=()).agg(F.count("*").alias("n"), F.max(F.size("fields")).alias("width"))


# -- parallel reading -----------------------------------------------------------------------------
@query(CUSTOMER_SQL)
def parallel_rows(spark, sf_dir):
    df = api.parallel_rows(spark, customer(spark, sf_dir, files=1), worker_count=5, quotes=True)
    return S.named(df, ["custkey", "name", "nationkey", "segment"])


@query("SELECT count(*) AS n FROM pages")
def parallel_count(spark, sf_dir):
    path = text_of(spark, sf_dir, "pages", ("page_id", "html"), files=1)
    return api.counted(spark, path, options(worker_count=7)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM pages")
def shard_counts_sum(spark, sf_dir):
    """Each file's record-safe shards, counted one by one in parallel and added up."""
    path = text_of(spark, sf_dir, "pages", ("page_id", "html"), files=1)
    parts = [(p, a, b) for p in files_of(path) for a, b in safe_shards(p, 6)]
    shards = spark.createDataFrame(parts or [("", 0, -1)], "path string, a long, b long").repartition(max(1, len(parts)))

    def run(batches):
        import pyarrow as pa

        from .sources.grammar import records
        from .sources.storage import chunks_of, open_bytes

        for batch in batches:
            n = [sum(1 for _ in records(chunks_of(open_bytes(p), 1 << 20, a, b + 1))) if p else 0 for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return shards.mapInArrow(run, "n long").agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS m FROM customer")
def pool_repeat(spark, sf_dir):
    with api.worker_pool(spark, customer(spark, sf_dir, files=1), worker_count=3) as pool:
        df = pool.frame()
    return df.agg(F.count("*").alias("n"), F.count_if(S.field(3) == "BUILDING").alias("m"))


# -- grammar ------------------------------------------------------------------------------------
def _documents(spark, sf_dir, where=None, **more) -> DataFrame:
    df = S.named(api.rows(spark, text_of(spark, sf_dir, "documents", ("doc_id", "text"), **more), where=where), ["doc_id", "text"])
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def multiline_documents(spark, sf_dir):
    return _documents(spark, sf_dir)


@query("SELECT page_id, url, html FROM pages")
def multiline_pages(spark, sf_dir):
    df = S.named(api.rows(spark, text_of(spark, sf_dir, "pages", ("page_id", "url", "html"))), ["page_id", "url", "html"])
    return df.withColumn("page_id", F.col("page_id").cast("long"))


@query("SELECT event_id, props FROM events WHERE contains(props, '\"')")
def escaped_quotes(spark, sf_dir):
    df = S.named(api.rows(spark, text_of(spark, sf_dir, "events", EVENT), where=column(3).has_match('"')), ["event_id", "u", "t", "props"])
    return df.select(F.col("event_id").cast("long").alias("event_id"), "props")


def _ended(line_end):
    def run(spark, sf_dir):
        return S.named(api.rows(spark, customer(spark, sf_dir, line_end=line_end, ending=".csv")), ["custkey", "name", "nationkey", "segment"])

    return run


for _n, _e in (("crlf_rows", "\r\n"), ("cr_rows", "\r")):
    _f = _ended(_e)
    _f.__name__ = _n
    query(CUSTOMER_SQL)(_f)


@query("SELECT 2 * count(*) AS n, count(*) AS blank FROM region")
def blank_records(spark, sf_dir):
    """A blank line after each record is a record of one empty field."""
    df = api.rows(spark, text_of(spark, sf_dir, "region", ("r_regionkey", "r_name"), line_end="\n\n", ending=".csv"))
    return df.agg(F.count("*").alias("n"), F.count_if((F.size("fields") == 1) & (S.field(0) == "")).alias("blank"))


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x{0}-\x{FF}]', '?', 'g') AS text FROM documents")
def latin1_rows(spark, sf_dir):
    """All texts in Latin-1; letters that it lacks are question marks."""
    path = text_of(spark, sf_dir, "documents", ("doc_id", "text"), latin1=True, ending=".csv")
    df = S.named(api.rows(spark, path, encoding="latin1"), ["doc_id", "text"])
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def _cut(delimiter, given):
    def run(spark, sf_dir):
        path = customer(spark, sf_dir, delimiter=delimiter)
        return S.named(api.rows(spark, path, delimiter=given), ["custkey", "name", "nationkey", "segment"])

    return run


for _n, _d, _g in (("semicolon_rows", ";", ";"), ("tab_rows", "\t", "\t"), ("pipe_rows", "|", "|"), ("auto_delimiter", "~", "auto")):
    _f = _cut(_d, _g)
    _f.__name__ = _n
    query(CUSTOMER_SQL)(_f)


# -- compression --------------------------------------------------------------------------------
def _unpacked(pack, ending, given):
    def run(spark, sf_dir):
        path = customer(spark, sf_dir, pack=pack, ending=ending)
        return S.named(api.rows(spark, path, compression=given), ["custkey", "name", "nationkey", "segment"])

    return run


for _n, _p, _e, _g in (
    ("gzip_rows", "gzip", ".csv.gz", "gzip"),
    ("deflate_rows", "deflate", ".csv.zz", "deflate"),
    ("deflate_raw_rows", "deflate-raw", ".csv.deflate-raw", "deflate-raw"),
    ("brotli_rows", "brotli", ".csv.br", "brotli"),
    ("zstd_rows", "zstd", ".csv.zst", "zstd"),
    ("zip_rows", "zip", ".zip", Zip("data/rows.csv")),
    ("zip_only_file", "zip", ".zip", {"format": "zip", "entry": "*"}),
    ("auto_compression", "zstd", ".csv.zst", "auto"),
):
    _f = _unpacked(_p, _e, _g)
    _f.__name__ = _n
    query(CUSTOMER_SQL)(_f)


# -- validation and counts ----------------------------------------------------------------------
@query("SELECT count(*) AS n FROM customer")
def trusted_newlines(spark, sf_dir):
    from .sources.grammar import trusted_newline_rows

    path = customer(spark, sf_dir)
    binary = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([trusted_newline_rows(x) for x in b.column(0).to_pylist()], pa.int64())], names=["n"])

    return binary.mapInArrow(run, "n long").agg(F.sum("n").alias("n"))


@query(CUSTOMER_SQL)
def strict_rows(spark, sf_dir):
    return customers(spark, sf_dir, strict=True)


@query("SELECT CAST(c_custkey AS VARCHAR) custkey, c_name AS name FROM customer")
def strict_headers(spark, sf_dir):
    path = text_of(spark, sf_dir, "customer", ("c_custkey", "c_name"), header=True, files=1)
    one = [p for p in files_of(path) if _size(p)]
    df = api.rows(spark, _whole(spark, path, one), strict=True, expected_headers=("c_custkey", "c_name"), require_header=True, min_data_rows=1)
    return S.named(df.where("not (_shard = 0 and _pos = 0)"), ["custkey", "name"])


def _size(path: str) -> int:
    from .sources.storage import size_of

    return size_of(path)


def _whole(spark: SparkSession, path: str, parts: list[str]) -> str:
    """One file made of a folder's parts, the header's first."""
    from .sources.storage import create_bytes, open_bytes

    target = f"{path}-whole.csv"
    with create_bytes(target) as out:
        for p in sorted(parts, key=lambda p: not open_bytes(p).read(9).startswith(b"c_custkey")):
            with open_bytes(p) as f:
                while got := f.read(1 << 20):
                    out.write(got)
    return target


@query(CUSTOMER_SQL)
def fixed_columns(spark, sf_dir):
    return customers(spark, sf_dir, fixed_columns=4)


@query(CUSTOMER_SQL)
def width_checked(spark, sf_dir):
    return S.named(S.check_width(api.rows(spark, customer(spark, sf_dir), quotes=False), 4), ["custkey", "name", "nationkey", "segment"])


@query("SELECT count(*) AS n FROM customer")
def strict_count(spark, sf_dir):
    return api.counted(spark, customer(spark, sf_dir), options(strict=True, min_data_rows=0)).agg(F.count("*").alias("n"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def header_objects(spark, sf_dir):
    path = text_of(spark, sf_dir, "region", ("r_regionkey", "r_name"), header=True, files=1)
    parts = [p for p in files_of(path) if _size(p)]
    if len(parts) > 1:
        return api.header_objects(spark, path).where("r_name <> 'r_name'")
    return api.header_objects(spark, path)


@query('SELECT CAST(r_regionkey AS VARCHAR) AS "_col.1", r_name AS "_col.2" FROM region')
def generated_columns(spark, sf_dir):
    return api.header_objects(spark, text_of(spark, sf_dir, "region", ("r_regionkey", "r_name")), header=False)


# -- sinks --------------------------------------------------------------------------------------
@query("SELECT concat(event_id, ';', user_id, ';', event_type, ';\"', replace(props, '\"', '\"\"'), '\"') AS line FROM events WHERE contains(props, '\"')")
def lines_csv(spark, sf_dir):
    df = api.rows(spark, text_of(spark, sf_dir, "events", EVENT), where=column(3).has_match('"'))
    return df.select(sinks.record_text(F.col("fields"), ";").alias("line"))


@query("SELECT to_json([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS line FROM customer")
def lines_ndjson(spark, sf_dir):
    return api.rows(spark, customer(spark, sf_dir)).select(sinks.json_text(F.col("fields")).alias("line"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation ORDER BY n_nationkey LIMIT 7")
def lines_limit(spark, sf_dir):
    return S.named(api.first_rows(spark, text_of(spark, sf_dir, "nation", ("n_nationkey", "n_name"), files=1), 7), ["a", "b"])


# -- batches and measures -----------------------------------------------------------------------
@query("SELECT count(*) AS row_count, 4 * count(*) AS total_fields, CAST(sum(length(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + length(CAST(c_nationkey AS VARCHAR)) + strlen(c_mktsegment)) AS BIGINT) AS data_length FROM customer")
def batch_metrics(spark, sf_dir):
    return stats.batch_metrics(api.rows(spark, customer(spark, sf_dir)))


@query("SELECT count(*) AS n_rows, 2 * count(*) AS n_cells, CAST(sum(length(CAST(doc_id AS VARCHAR)) + length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents")
def materialize_stats(spark, sf_dir):
    return stats.checksum(api.rows(spark, text_of(spark, sf_dir, "documents", ("doc_id", "text"))))


@query("SELECT col, count(*) AS n_rows, count(DISTINCT v) AS n_distinct, 1 - count(DISTINCT v) / count(*) AS duplicate_ratio FROM (SELECT 2 AS col, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 3, c_mktsegment FROM customer UNION ALL SELECT 9, '' FROM customer) GROUP BY col")
def field_cardinality(spark, sf_dir):
    return stats.cardinality(api.rows(spark, customer(spark, sf_dir)), [2, 3, 9])


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 5")
def field_cardinality_topn(spark, sf_dir):
    return stats.top_values(api.rows(spark, text_of(spark, sf_dir, "part", PART), quotes=False), 2, 5)


@query("WITH w AS (SELECT c_custkey, strlen(CAST(c_custkey AS VARCHAR)) a, strlen(c_name) b, strlen(CAST(c_nationkey AS VARCHAR)) c, strlen(c_mktsegment) d FROM customer), r AS (SELECT 0 AS col, 0 AS lo, a AS hi FROM w UNION ALL SELECT 1, a, a + b FROM w UNION ALL SELECT 2, a + b, a + b + c FROM w UNION ALL SELECT 3, a + b + c, a + b + c + d FROM w) SELECT col, CAST(sum(lo) AS BIGINT) AS starts, CAST(sum(hi) AS BIGINT) AS ends FROM r GROUP BY col")
def field_ranges(spark, sf_dir):
    df = stats.field_ranges(api.rows(spark, customer(spark, sf_dir)))
    return df.groupBy("col").agg(F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def column_scan(spark, sf_dir):
    df = api.rows(spark, customer(spark, sf_dir)).select(S.field(3).alias("value")).where("value is not null")
    return df.groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS a, '' AS b, CAST(c_custkey AS VARCHAR) AS c FROM customer")
def pick_columns(spark, sf_dir):
    return S.named(S.project(api.rows(spark, customer(spark, sf_dir)), [3, 40, 0]), ["a", "b", "c"])


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def row_view_count_equals(spark, sf_dir):
    return api.rows(spark, customer(spark, sf_dir)).where(S.field(3) == "BUILDING").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def parse_column(spark, sf_dir):
    """A whole file in each row of a column."""
    from .operators.scan import parse_column as parse

    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("", F.lit('"'), "c_name", F.lit('",'), "c_mktsegment", F.lit("\n")).alias("content"))
    df = parse(c, "content", key="c_custkey")
    return df.select(F.col("c_custkey").alias("custkey"), S.field(0).alias("name"), S.field(1).alias("segment"))


@query("SELECT event_id, event_type AS kind, props FROM events")
def record_column(spark, sf_dir):
    """One record in each row of a column, cut by expressions alone."""
    text = sinks.record_text(F.array(F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))))
    df = read(spark, sf_dir, "events").select(S.record_fields(text).alias("fields"))
    return df.select(S.field(0).cast("long").alias("event_id"), S.field(1).alias("kind"), S.field(2).alias("props"))


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name")
def join_after_scan(spark, sf_dir):
    """Scans are DataFrames: two files filtered, joined and counted."""
    c = S.named(api.rows(spark, customer(spark, sf_dir), where=_seg.equals("BUILDING")), ["k", "name", "nk", "s"])
    n = S.named(api.rows(spark, text_of(spark, sf_dir, "nation", ("n_nationkey", "n_name"))), ["nk", "nation"])
    return c.join(n, "nk").groupBy("nation").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer")
def stream_files(spark, sf_dir):
    """Files taken as a stream, until none is left."""
    from .streaming.follow import follow_lines

    out = fresh(spark, "stream")
    df = follow_lines(spark, customer(spark, sf_dir))
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("_file string, fields array<string>").parquet(f"{out}/rows").agg(F.count("*").alias("n"))


from . import queries_in_tasks  # noqa: E402, F401  registers its own


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical query: filter on two columns, project three."""
    return filtered_project(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
