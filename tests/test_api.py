import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from delimir.operators import scan as S
from delimir.operators.batches import RowView
from delimir.plans import api
from delimir.plans.errors import DelimitedError
from delimir.plans.options import options

PEOPLE = '"id";"name";"uf"\n"1";"Ana";"SP"\n"2";"Joao";"RJ"\n"3";"Bia";"S\nP"\n"4";"Caio";"SP"\n'
c = api.column


@pytest.fixture
def people(tmp_path):
    f = tmp_path / "people.csv"
    f.write_text(PEOPLE)
    return str(f)


def fields(df):
    return [r[0] for r in df.orderBy("_file", "_shard", "_pos").select("fields").collect()]


def test_rows(spark, people):
    assert fields(api.rows(spark, people, delimiter=";", columns=(0, 1), where=c(2).equals("SP"))) == [["1", "Ana"], ["4", "Caio"]]
    assert fields(api.rows(spark, people, delimiter=";", columns=(2, 2024)))[3] == ["S\nP", ""]
    assert fields(api.rows(spark, people, delimiter=";", columns=()))[0] == []


@pytest.mark.parametrize("workers", [1, 2, 4])
def test_counts(spark, people, workers):
    filters = [None, c(2).equals("SP"), c(2).is_one_of(["SP", "RJ"]), c(2).does_not_equal("SP"), c(2).is_none_of(["SP", "RJ"]), c(1).starts_with("A"), c(20).does_not_equal(""), c(1).has_match("^[AB]")]
    assert [api.count(spark, people, delimiter=";", worker_count=workers, where=f) for f in filters] == [5, 2, 3, 3, 2, 1, 0, 2]


def test_ragged_any(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("1;Ana;SP\n2;Joao;RJ\n3;Bia;SP\n4;Caio;MG\n5")
    got = fields(api.rows(spark, str(f), delimiter=";", where=api.any_(c(0).equals("5"), c(2).equals("SP"))))
    assert got == [["1", "Ana", "SP"], ["3", "Bia", "SP"], ["5"]]


@pytest.mark.parametrize("text", ["a,b\n\nc\r\nd,,\re", "", "\n", "x", "\r\n", "﻿a,b\n1,2\n"])
def test_fast_scan_equals_source(spark, tmp_path, text):
    f = tmp_path / "x.csv"
    f.write_bytes(text.encode())
    want = fields(S.source(spark, str(f), options()))
    assert fields(api.rows(spark, str(f))) == want == api.parse(text.encode())


@pytest.mark.parametrize("delimiter", list(",;\t|:^~.$()[{?*+\\/ -ax]}&"))
def test_fast_scan_takes_any_delimiter(spark, tmp_path, delimiter):
    f = tmp_path / "x.csv"
    f.write_text(f"1{delimiter}2{delimiter}\n{delimiter}{delimiter}3\n")
    assert fields(api.rows(spark, str(f), delimiter=delimiter, quotes=False)) == [["1", "2", ""], ["", "", "3"]]


def test_strict_errors_end_the_job(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('id,name\n1,"Ad"a\n')
    with pytest.raises(Exception, match="unescaped quote in quoted field"):
        fields(api.rows(spark, str(f), strict=True))
    assert len(fields(api.rows(spark, str(f)))) == 2


def test_large_files_are_split_by_a_job(spark, tmp_path, monkeypatch):
    f = tmp_path / "x.csv"
    f.write_text("".join(f'{i},"a\n""b",c\n' for i in range(500)))
    monkeypatch.setattr(S, "SPLIT_BY_DRIVER", 1000)
    monkeypatch.setattr(S.datasource, "SHARD_BYTES", 900)
    df = S.source(spark, str(f), options())
    assert df.rdd.getNumPartitions() > 3
    assert fields(df) == api.parse(f.read_bytes())


def test_marks_are_seen_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FEW_FILES", 2)
    for i in range(7):
        (tmp_path / f"{i}.csv").write_bytes(b"a,b\n")
    assert S.quote_free(spark, str(tmp_path))
    (tmp_path / "5.csv").write_bytes(b"\xef\xbb\xbfa,b\n")
    assert not S.quote_free(spark, str(tmp_path))


def test_conflicts(spark, people):
    for more, message in (
        ({"strict": True, "where": c(0).equals("1")}, "strict CSV validation is not supported"),
        ({"worker_count": 2, "compression": "gzip"}, "does not support compressed input"),
        ({"worker_count": 2, "delimiter": "auto"}, "does not support automatic delimiter"),
        ({"columns": (1, 1)}, "selected column repeated: 1"),
        ({"columns": (2025,)}, "selected column out of range: 2025"),
        ({"columns": (1,), "selected_columns": (1,)}, "cannot be used together"),
        ({"fixed_columns": 0}, "fixedColumns must be an integer"),
        ({"min_data_rows": -1}, "minDataRows must be a non-negative integer"),
        ({"compression": "lz4"}, "unsupported compression format: lz4"),
        ({"nope": 1}, "unknown property: nope"),
    ):
        with pytest.raises(DelimitedError, match=message):
            api.rows(spark, people, **more)
    with pytest.raises(DelimitedError, match="parallel count require workerCount > 1: 1"):
        api.parallel_count(spark, people)
    with pytest.raises(DelimitedError, match="not supported for countCsvFile"):
        api.count_file(spark, people, strict=True, require_header=True)


def test_pool(spark, people):
    with api.worker_pool(spark, people, delimiter=";", worker_count=3) as pool:
        assert pool.count() == 5
        assert sorted(pool.rows(columns=(0,), where=c(2).equals("SP"))) == [["1"], ["4"]]
        with pool._busy, pytest.raises(DelimitedError, match="worker pool is busy"):
            pool.count()
    with pytest.raises(DelimitedError, match="closed"):
        pool.count()


def test_batches(spark, people):
    (b,) = [RowSnapshot(x) for x in api.batches(spark, people, delimiter=";")]
    assert b.counts == (5, 15, 35)
    assert b.values == ["uf", "SP", "RJ", "S\nP", "SP"]
    assert b.missing == [None, [(-1, -1)] * 5]
    seen = []
    api.for_each_row_view(spark, people, lambda v: seen.append((v.get(0), v.pick([2, 9]), v.get(9))), delimiter=";")
    assert seen[3] == ("3", ["S\nP", ""], None)
    api.columnar_batches(spark, people, lambda x: seen.append(x.count_where_equals(0, "SP")), delimiter=";", columns=(2,))
    assert seen[-1] == 2


class RowSnapshot:
    def __init__(self, b):
        self.counts = (b.row_count, b.total_fields, b.data_length)
        self.values, self.missing = [], [b.field_range(0, 9), []]
        b.for_each_column_bytes(2, lambda x, _: self.values.append(str(x, "utf-8")))
        b.scan_columns([9], lambda _, r: self.missing[1].extend(r))
        view = RowView(b, (1,))
        view.row = 1
        assert view.values() == ["Ana"]
        assert b.rows_into([["old"]], [0, 40])[1] == ["1", ""]
        with pytest.raises(DelimitedError, match="row index out of range"):
            b.field_range(99, 0)
        b.close()
        with pytest.raises(DelimitedError, match="closed"):
            b.rows()


def test_parse_column(spark):
    df = spark.createDataFrame([(1, b'a,"x\ny"\n'), (2, None), (3, b"")], "k int, content binary")
    assert [(r.k, r.fields) for r in S.parse_column(df, "content", key="k").collect()] == [(1, ["a", "x\ny"])]


def test_record_expression(spark):
    records = ['a,"b ""c""",d', '"x"y,z', "", ",", '"a,b"', 'p"q,r']
    df = spark.createDataFrame([(r,) for r in records], "v string")
    assert [r[0] for r in df.select(S.record_fields(F.col("v"))).collect()] == [api.parse((r + "\n").encode())[0] for r in records]


def test_width(spark, people):
    with pytest.raises(Exception, match="fixed row column count mismatch"):
        S.check_width(api.rows(spark, people, delimiter=";"), 2).count()


def test_headers(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("id,name\n1\n2,b,c\n")
    assert [tuple(r) for r in api.header_objects(spark, str(f)).orderBy("id").collect()] == [("1", ""), ("2", "b")]
    assert api.header_objects(spark, str(f), header=False).columns == ["_col.1", "_col.2"]


def test_plan_prunes_and_filters(spark, people):
    plan = api.rows(spark, people, delimiter=";", quotes=False, columns=(0,), where=c(2).equals("SP"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Exchange" not in plan and "Python" not in plan


def test_stream(spark, tmp_path):
    from delimir.streaming.follow import follow

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('1,"x\ny"\n')
    (folder / "b.csv").write_text("2,z\n")
    q = follow(spark, str(folder), columns=(1,)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.fields[0] for r in spark.table("followed").collect()) == ["x\ny", "z"]


def cli(*args):
    p = subprocess.run([sys.executable, "-m", "delimir", *args], capture_output=True, text=True, encoding="utf-8", cwd=__file__.rsplit("/tests", 1)[0])
    return p.returncode, p.stdout, p.stderr


def test_cli(people):
    assert cli("count", people, "--delimiter", ";") == (0, "5\n", "")
    assert cli("lines", people, "--delimiter", ";", "--columns", "2,0", "--where-neq", "2=RJ", "--limit", "3")[1] == 'uf,id\nSP,1\n"S\nP",3\n'
    assert cli("lines", people, "--delimiter", "auto", "--json", "--where-regex", "1=/^j/i")[1] == '["2","Joao","RJ"]\n'
    assert cli("count", people, "--delimiter", ";", "--where-in", "2=SP", "--where-in", "2=RJ", "--where-noin", "0=1")[1] == "2\n"
    code, _, err = cli("count", people, "--strict")
    assert code == 1 or err == ""


@pytest.mark.parametrize(
    ("args", "message"),
    [
        (["nope", "x"], "unknown command: nope"),
        (["count", "x", "--chunk-size", "0"], "chunk size must be an integer from 1 through 67108864"),
        (["count", "x", "--encoding", "utf16"], "unsupported encoding: utf16"),
        (["count", "x", "--worker-count", "2"], "Unknown option '--worker-count'"),
        (["count", "x", "--compression", "zip"], "--compression zip requires --zip-entry <path>"),
        (["count", "x", "--fixed-columns", "0"], "fixed columns must be an integer greater than or equal to 1"),
        (["count", "x", "--where-eq", "2"], "--where-eq must use <column>=<value>"),
        (["count", "x", "--where-eq", "state=SP"], "--where-eq column must be an integer"),
        (["count", "x", "--where-regex", "1=^A"], "--where-regex must use <column>=/<pattern>/<flags>"),
        (["lines", "x", "--json", "--output-delimiter", ";"], "--json cannot be combined with --output-delimiter"),
        (["lines", "x", "--strict", "--where-eq", "1=a"], "--strict cannot be used with filter options"),
        (["count", "x", "--expected-header", "a"], "--expected-header requires --strict"),
    ],
)
def test_cli_usage_errors(args, message, capsys):
    from delimir.cli import main

    assert main(args) == 2
    err = capsys.readouterr().err
    assert err.startswith("csv: ") and message in err and "for usage." in err
