import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from delimir.operators.sinks import serialize
from delimir.plans.errors import DelimitedError
from delimir.sources import grammar
from delimir.sources.datasource import block_batches
from delimir.sources.grammar import ChunkParser, parse
from delimir.sources.sharding import BlockScanner, offsets_from_blocks, safe_shards, safe_split_offsets

GOLDEN = [
    (b"\n\n", ",", [[""], [""]]),
    (b"", ",", []),
    (b"\n", ",", [[""]]),
    (b"id,name\n1,Ada\n", ",", [["id", "name"], ["1", "Ada"]]),
    (b"id,name,score\n7,,42", ",", [["id", "name", "score"], ["7", "", "42"]]),
    (b'id,label,value\n1,"he said ""go""",9', ",", [["id", "label", "value"], ["1", 'he said "go"', "9"]]),
    (b'a,b\n1,2\n"3\nx",4\n', ",", [["a", "b"], ["1", "2"], ["3\nx", "4"]]),
    (b'"h";"v"\r\n"1";"a""b\nc"\r\nplain"quote;z\r"tail";"x"', ";", [["h", "v"], ["1", 'a"b\nc'], ['plain"quote', "z"], ["tail", "x"]]),
    (b'"ab"cd"e,f', ",", [['abcd"e', "f"]]),
    (b'1,"Ada', ",", [["1", "Ada"]]),
    (b"\xef\xbb\xbf\"a\",b", ",", [['﻿"a"', "b"]]),
    (b" Homer , Simpson \n", ",", [[" Homer ", " Simpson "]]),
    (b"a\r\rb", ",", [["a"], [""], ["b"]]),
    (b"1,", ",", [["1", ""]]),
]


@pytest.mark.parametrize(("data", "delimiter", "want"), GOLDEN)
def test_golden(data, delimiter, want):
    assert parse(data, delimiter) == want
    for k in (1, 2, 3, 5, 64):
        p = ChunkParser(delimiter)
        got = [r for i in range(0, len(data), k) for r in p.write(data[i : i + k])] + p.end()
        assert got == want


def test_latin1_and_bad_utf8():
    assert parse(b"nome\nJo\xe3o\n", encoding="latin1") == [["nome"], ["João"]]
    assert parse(b"a\xff,b") == [["a�", "b"]]
    with pytest.raises(DelimitedError, match="unsupported encoding: utf16"):
        parse(b"", encoding="utf16")


@pytest.mark.parametrize("delimiter", ["", "||", "\n", '"', "\0", "é"])
def test_bad_delimiters(delimiter):
    with pytest.raises(DelimitedError, match="delimiter must be one safe ASCII character or auto"):
        parse(b"a", delimiter)


STRICT = [
    (b'id,name\n1,"Ad"a', grammar.QUOTED, None),
    (b'id,name\n1,Ad"a', grammar.UNQUOTED, None),
    (b'id,name\n1,"Ada', grammar.UNTERMINATED, None),
    (b"id,name,total\n1,Ada\n", grammar.RAGGED, None),
    (b"id,name\n1,Ada,extra\n", grammar.RAGGED, None),
    (b"1,2\n", grammar.FIXED, 3),
]


@pytest.mark.parametrize(("data", "message", "fixed"), STRICT)
def test_strict(data, message, fixed):
    parse(data)  # the permissive grammar takes it
    for k in (1, 3, 100):
        with pytest.raises(DelimitedError, match=message):
            list(grammar.strict_records([data[i : i + k] for i in range(0, len(data), k)], ",", "utf8", fixed))


def test_strict_accepts_quote_at_end():
    assert list(grammar.strict_records([b'id,name\n1,"Ada"'], ",", "utf8")) == [["id", "name"], ["1", "Ada"]]


def test_headers():
    c = grammar.HeaderCheck(["id", "name"], True, 1)
    with pytest.raises(DelimitedError, match="missing header row"):
        c.finish()
    with pytest.raises(DelimitedError, match=r"expected 2 header field\(s\), got 3"):
        c.row(["a", "b", "c"])
    with pytest.raises(DelimitedError, match='header mismatch at column 1: expected "name", got "full"'):
        grammar.HeaderCheck(["id", "name"]).row(["id", "full"])
    c = grammar.HeaderCheck(None, False, 2)
    c.row(["h"])
    c.row(["1"])
    with pytest.raises(DelimitedError, match=r"at least 2 data row\(s\), got 1"):
        c.finish()


def test_trusted_newlines():
    assert [grammar.trusted_newline_rows(x) for x in (b"a,b\n1,2\n3,4", b"a,b\r\n1,2\r\n", b"", b"x")] == [3, 2, 0, 1]


cells = st.text(alphabet='abc01 ",;\n\ré中', max_size=6)
tables = st.lists(st.lists(cells, min_size=1, max_size=5), max_size=12)


@settings(max_examples=200, deadline=None)
@given(tables, st.sampled_from(",;"), st.integers(1, 9))
def test_round_trip(rows, delimiter, chunk):
    data = "".join(serialize(r, delimiter) + "\n" for r in rows).encode()
    assert parse(data, delimiter) == rows
    p = ChunkParser(delimiter)
    assert [r for i in range(0, len(data), chunk) for r in p.write(data[i : i + chunk])] + p.end() == rows


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab,"\n\r', max_size=40), st.integers(1, 9))
def test_blocks_hold_the_same_records(text, chunk):
    data = text.encode()
    chunks = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    got = [r for b in block_batches(iter(chunks), ",", "utf8", "p", 0, None) for r in b.to_pylist()]
    assert [r["fields"] for r in got] == parse(data)
    assert [r["_pos"] for r in got] == list(range(len(got)))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab,"\n\r', max_size=30), st.integers(1, 6))
def test_record_count(text, chunk):
    data = text.encode()
    assert grammar.record_count([data[i : i + chunk] for i in range(0, len(data), chunk)], ",") == len(parse(data))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab,"\n\r', min_size=1, max_size=40), st.integers(1, 8))
def test_shards_hold_whole_records(tmp_path_factory, text, n):
    f = tmp_path_factory.mktemp("s") / "x.csv"
    data = text.encode()
    f.write_bytes(data)
    shards = safe_shards(str(f), n)
    assert [r for a, b in shards for r in parse(data[a : b + 1])] == parse(data)
    assert len(shards) <= n


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab,"\n\r', min_size=1, max_size=40), st.integers(1, 8))
def test_blocks_give_the_same_offsets(tmp_path_factory, text, n):
    f = tmp_path_factory.mktemp("b") / "x.csv"
    data = text.encode()
    f.write_bytes(data)
    starts = sorted({len(data) * i // n for i in range(n)})
    scans = [BlockScanner(",").scan(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert offsets_from_blocks(starts, scans, len(data)) == safe_split_offsets(str(f), n)


@pytest.mark.parametrize(
    ("data", "n", "want"),
    [(b'a;b\r\n1;"x\r\ny"\r\n2;z\r\n', 2, [0, 15, 20]), (b'a;b\r\n1;"x\r\ny"\r\n2;z\r\n', 4, [0, 5, 15, 20]), (b'a;"b""\nc";d\nx;y;z\n', 2, [0, 12, 18]), (b"", 3, [0]), (b"a\nb\n", 1, [0, 4])],
)
def test_split_offsets(tmp_path, data, n, want):
    f = tmp_path / "x.csv"
    f.write_bytes(data)
    assert safe_split_offsets(str(f), n, ";") == want


def test_split_guards(tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes(b"a")
    with pytest.raises(DelimitedError, match="invalid shard count: 0"):
        safe_split_offsets(str(f), 0)
    with pytest.raises(DelimitedError, match="does not support compressed input"):
        safe_split_offsets(str(f), 2, compression="gzip")
    with pytest.raises(DelimitedError, match="does not support automatic delimiter"):
        safe_split_offsets(str(f), 2, "auto")
