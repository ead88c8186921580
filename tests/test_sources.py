import gzip
import io
import zipfile
import zlib

import pyarrow as pa
import pytest

from delimir.functions.filters import all_, any_, column, not_
from delimir.operators.scan import scan
from delimir.plans import api
from delimir.plans.api import evaluate
from delimir.plans.options import options
from delimir.plans.errors import DelimitedError
from delimir.sources.codecs import Zip, detect, open_chunks
from delimir.sources.sniff import detect_delimiter

DATA = b'id;name;state\n1;"Ana\nA";SP\n2;Joao;RJ\n'


def raw_deflate(data):
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


PACKED = {
    "x.csv.gz": ("gzip", gzip.compress(DATA)),
    "two.csv.gz": ("gzip", gzip.compress(DATA[:9]) + gzip.compress(DATA[9:])),
    "x.csv.zz": ("deflate", zlib.compress(DATA)),
    "x.csv.deflate-raw": ("deflate-raw", raw_deflate(DATA)),
    "x.csv.br": ("brotli", pa.Codec("brotli").compress(DATA, asbytes=True)),
    "x.csv.zst": ("zstd", pa.Codec("zstd").compress(DATA, asbytes=True)),
}


@pytest.mark.parametrize("name", PACKED)
@pytest.mark.parametrize("auto", [False, True])
def test_codecs(tmp_path, name, auto):
    how, data = PACKED[name]
    f = tmp_path / name
    f.write_bytes(data)
    for chunk in (7, 1 << 16):
        assert b"".join(open_chunks(str(f), "auto" if auto else how, chunk)) == DATA


def test_truncated(tmp_path):
    f = tmp_path / "x.gz"
    f.write_bytes(gzip.compress(DATA)[:-9])
    with pytest.raises(DelimitedError, match="ends early"):
        b"".join(open_chunks(str(f), "gzip"))


@pytest.mark.parametrize(
    ("name", "prefix", "message"),
    [("a.zst", b"\x1f\x8b\0\0", "auto-detection mismatch"), ("a.gz", b"abcd", "does not match the file signature"), ("a.deflate", b"abcd", "ambiguous"), ("a.csv", b"abcd", "no supported signature")],
)
def test_detection_errors(name, prefix, message):
    with pytest.raises(DelimitedError, match=message):
        detect(name, prefix)


def test_detection():
    assert detect("a", b"\x1f\x8b\0\0") == "gzip"
    assert detect("a.br", b"abcd") == "brotli"
    assert detect("a", b"\x50\x2a\x4d\x18") == "zstd"
    assert detect("a", b"\x78\x9c\0\0") == "deflate"


def archive(tmp_path, entries, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **more) as z:
        for name, data in entries:
            z.writestr(name, data)
    f = tmp_path / "x.zip"
    f.write_bytes(out.getvalue())
    return f


def test_zip(tmp_path):
    f = archive(tmp_path, [("d/", b""), ("d/a.csv", DATA)], compression=zipfile.ZIP_DEFLATED)
    assert b"".join(open_chunks(str(f), Zip("d/a.csv"), 5)) == DATA
    assert b"".join(open_chunks(str(f), Zip("*"))) == DATA
    for z, message in ((Zip("no"), "entry not found"), (Zip("d/"), "is a directory"), (Zip("d/a.csv", 3), "size limit")):
        with pytest.raises(DelimitedError, match=message):
            b"".join(open_chunks(str(f), z))


def test_zip_refusals(tmp_path):
    with pytest.raises(DelimitedError, match="exactly one file"):
        list(open_chunks(str(archive(tmp_path, [("a", b"1"), ("b", b"2")])), Zip("*")))
    with pytest.raises(DelimitedError, match="compression method"):
        list(open_chunks(str(archive(tmp_path, [("a", b"1" * 99)], compression=zipfile.ZIP_BZIP2)), Zip("a")))
    with pytest.raises(DelimitedError, match="ratio limit"):
        list(open_chunks(str(archive(tmp_path, [("a", b"1" * 99999)], compression=zipfile.ZIP_DEFLATED)), Zip("a", max_compression_ratio=2)))
    with pytest.warns(UserWarning), pytest.raises(DelimitedError, match="duplicate"):
        list(open_chunks(str(archive(tmp_path, [("a", b"1"), ("a", b"2")])), Zip("a")))
    f = archive(tmp_path, [("a", b"hello,world\n")])
    raw = bytearray(f.read_bytes())
    raw[raw.index(b"hello")] = 88
    f.write_bytes(raw)
    with pytest.raises(DelimitedError, match="native ZIP reader failed"):
        list(open_chunks(str(f), Zip("a")))


@pytest.mark.parametrize(
    ("data", "hint", "want"),
    [(b"a,b\n1,2\n", None, ","), (b"a\tb\n1\t2\n", None, "\t"), (b'a;"x;y"\n1;2\n', None, ";"), (b"a|b:c\n1|2:3\n", "|", "|"), (b"a~b~c\n\n1~2~3", None, "~"), (b"a,b;c;d\n1,2;3;4\n", None, ";")],
)
def test_delimiters(data, hint, want):
    for k in (1, 99):
        assert detect_delimiter([data[i : i + k] for i in range(0, len(data), k)], hint) == want


@pytest.mark.parametrize(("data", "message"), [(b"", "no complete rows"), (b"abc\ndef\n", "stable positive count"), (b"a,b;c\n1,2;3\n", "ambiguous between")])
def test_delimiter_errors(data, message):
    with pytest.raises(DelimitedError, match=message):
        detect_delimiter([data])


def test_empty_parts_need_no_delimiter(spark, tmp_path):
    folder, bare, packed = (tmp_path / x for x in ("in", "bare", "packed"))
    for f in (folder, bare, packed):
        f.mkdir()
    (folder / "part-0").write_bytes(b"")
    (folder / "part-1").write_bytes(b'1~"a~b"\n2~\n')
    (folder / "part-2").write_bytes(b"3~c\n")
    (bare / "part-0").write_bytes(b"")
    (packed / "part-0.gz").write_bytes(gzip.compress(b""))
    (packed / "part-1.gz").write_bytes(gzip.compress(b"1~a\n"))

    def fields(path, **more):
        return sorted(r[0] for r in api.rows(spark, str(path), delimiter="auto", **more).select("fields").collect())

    assert fields(folder) == fields(f"file://{folder}") == [["1", "a~b"], ["2", ""], ["3", "c"]]
    assert fields(folder, where=column(1).equals("c")) == [["3", "c"]]
    assert api.count(spark, str(folder), delimiter="auto") == 3
    assert fields(bare) == []
    assert fields(packed, compression="gzip") == [["1", "a"]]
    with pytest.raises(Exception, match="no complete rows"):  # one file by its name: as the reference
        fields(folder / "part-0")


def test_empty_files_of_a_stream(spark, tmp_path):
    from delimir.streaming.follow import follow

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"")
    (folder / "b").write_bytes(b"1~x\n2~y\n")
    q = follow(spark, str(folder), delimiter="auto").writeStream.format("memory").queryName("with_empty").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.fields for r in spark.table("with_empty").collect()) == [["1", "x"], ["2", "y"]]


def test_columns_are_pruned_while_reading():
    from delimir.sources.datasource import block_batches, pruned

    rows = [["a", "b", "c", "d"], ["e"], [""], ["f", "g", "h"]]
    fields = pa.array(rows, pa.list_(pa.string())).slice(0)
    assert pruned(fields, [1, 2]).to_pylist() == [["", "b", "c"], [""], [""], ["", "g", "h"]]
    assert pruned(fields, [0]).to_pylist() == [["a"], ["e"], [""], ["f"]]
    assert pruned(fields, []).to_pylist() == [[], [], [], []]
    assert pruned(fields.slice(1, 2), [0, 3]).to_pylist() == [["e"], [""]]
    got = [r for b in block_batches(iter([b"a,b,c\n1,2,3\n", b'x,"y,z",w\n']), ",", "utf8", "p", 0, column(0).is_one_of(["1", "x"]), [0, 2]) for r in b.column(3).to_pylist()]
    assert got == [["1", "", "3"], ["x", "", "w"]]


def test_lines_are_searched_before_they_are_cut(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,1\nb,R\nR,2\nc,Rx\nd\n,\nRR,R\n")
    path = f"file://{tmp_path}"
    for f in (column(1).equals("R"), column(1).is_one_of(["R", "1"]), column(1).starts_with("R"), any_(column(0).equals("R"), column(1).equals("R")), all_(column(1).starts_with(""), not_(column(0).equals("b"))), column(1).does_not_equal("R"), column(1).equals(""), column(1).equals(b"R"), any_(column(0).equals("d"), column(1).has_match("x$"))):
        quick, exact = (sorted(r[0] for r in scan(spark, path, options(where=f, quotes=q)).select("fields").collect()) for q in (False, True))
        assert quick == exact == sorted(r for r in [["a", "1"], ["b", "R"], ["R", "2"], ["c", "Rx"], ["d"], ["", ""], ["RR", "R"]] if evaluate(f, r) is True)
        quick, exact = (sorted(r[0] for r in scan(spark, path, options(where=f, columns=(1,), quotes=q)).select("fields").collect()) for q in (False, True))
        assert quick == exact
        assert api.count(spark, path, where=f, quotes=False) == api.count(spark, path, where=f, quotes=True) == len(exact)


def test_many_files_are_split_by_one_job(spark, tmp_path, monkeypatch):
    from delimir.operators import scan as S
    from delimir.sources import datasource
    from delimir.sources.sharding import safe_split_offsets, split_files

    text = "".join(f'{k},"a""b\n{k}",x\r\n' if k % 7 else f"{k},plain,y\n" for k in range(900))
    for name, data in (("a.csv", text), ("b.csv", text * 3), ("c.csv", ""), ("d.csv", 'q,"' + "z\n" * 5000 + '",w\n' + text)):
        (tmp_path / name).write_bytes(data.encode())
    files = sorted(f"file://{p}" for p in tmp_path.iterdir())
    sizes = {f: (tmp_path / f.rsplit("/", 1)[1]).stat().st_size for f in files}
    got = split_files(spark, sizes, 2000)
    for f in files:
        data = (tmp_path / f.rsplit("/", 1)[1]).read_bytes()
        assert got[f][0] == 0 and got[f][-1] == len(data)
        ends = set(safe_split_offsets(f, max(1, len(data) // 3)))
        assert all(x in ends or data[x - 1 : x] == b"\n" for x in got[f][1:-1])
    want = sorted(tuple(r[0]) for r in scan(spark, f"file://{tmp_path}", options(quotes=True)).select("fields").collect())
    # as in a store: no pass on the driver, shards by the job all the same
    monkeypatch.setattr(datasource, "SHARD_BYTES", 3000)
    monkeypatch.setattr(S, "SPLIT_BY_DRIVER", 0)
    df = scan(spark, f"file://{tmp_path}", options(quotes=True))
    assert df.rdd.getNumPartitions() > 20
    assert sorted(tuple(r[0]) for r in df.select("fields").collect()) == want


def test_first_rows_stop_early(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("".join(f"{k},{i}\n" for i in range(50)))
    got = [r[0] for r in api.first_rows(spark, f"file://{tmp_path}", 53, where=not_(column(1).equals("1"))).select("fields").collect()]
    assert got == ([["0", str(i)] for i in range(50)] + [["1", str(i)] for i in range(50)] + [["2", "0"]])[:1] + [["0", str(i)] for i in range(2, 50)] + [["1", "0"], ["1", "2"], ["1", "3"], ["1", "4"]]
