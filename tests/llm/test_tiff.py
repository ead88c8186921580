import hashlib
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from delimir.llm.tiff import SCHEMES, build, digest, lzw, media_rows, packbits, page_rows, pages, payload_of, unlzw, unpackbits


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_codes_round_trip(data):
    assert unlzw(lzw(data), len(data)) == data
    assert unpackbits(packbits(data, 64), len(data)) == data


def test_lzw_codes():
    # the specification's example: clear, 7, 258, 8, 8, 258, 6, 6, end, nine bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    want = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == want


def test_lzw_table_fills():
    data = os.urandom(60000) + b"ab" * 30000
    assert unlzw(lzw(data), len(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("first", range(len(SCHEMES)))
@pytest.mark.parametrize("size", [64, 128, 64 * 130, 64 * 1024, 64 * 1025, 64 * 3000])
def test_files_round_trip(order, first, size):
    data = (os.urandom(200) + b"some text, " * (size // 11 + 1))[:size]
    assert b"".join(p.data for p in pages(build(data, first=first, order=order))) == data


def test_damage(spark):
    good = build(b"x" * 640)
    bad = [None, b"", b"junk", good[:40], good[:-30], good[:4] + b"\xff\xff\xff\x7f" + good[8:], bytearray(good)]
    df = spark.createDataFrame([(i, bytes(b) if b is not None else None) for i, b in enumerate(bad)], "id int, data binary")
    got = page_rows(df, "id", "data").orderBy("id").collect()
    assert [r.error is None for r in got] == [False] * 6 + [True]
    assert (got[-1].width, got[-1].height, got[-1].page) == (64, 10, 0)


@pytest.mark.parametrize("first", range(len(SCHEMES)))
def test_flipped_bytes_raise_nothing_else(first):
    """Every byte of the directory set to telling values, and random ones anywhere: a page, or ValueError, and soon."""
    r = random.Random(first)
    good = build(bytes(r.choice(b"ab ") for _ in range(64 * 300)), first=first)
    at = int.from_bytes(good[4:8], "little")
    end = min(len(good), at + 2 + 12 * 12 + 4)
    cases = [(k, v) for k in [*range(8), *range(at, end)] for v in (0, 1, 2, 5, 127, 128, 255)]
    cases += [(r.randrange(len(good)), r.randrange(256)) for _ in range(600)]
    failed = 0
    for k, v in cases:
        bad = bytearray(good)
        bad[k] = v
        if r.random() < 0.3:
            bad[r.randrange(at, end)] = r.randrange(256)
        try:
            for _ in pages(bytes(bad)):
                pass
        except ValueError:
            failed += 1
    assert failed > 100


def test_small_file_that_claims_a_large_page(spark):
    data = bytearray(build(b"x" * 640, first=0))
    at = int.from_bytes(data[4:8], "little")
    for k in range(int.from_bytes(data[at : at + 2], "little")):
        p = at + 2 + 12 * k
        if int.from_bytes(data[p : p + 2], "little") in (257, 278):  # rows of the page and of a strip
            data[p + 2 : p + 12] = (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + (1 << 30).to_bytes(4, "little")
    with pytest.raises(ValueError, match="can't hold"):
        list(pages(bytes(data)))
    rows = page_rows(spark.createDataFrame([(1, bytes(data)), (2, bytes(build(b"x" * 64)))], "id int, data binary"), "id", "data").collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.id)] == [False, True]


def test_loop_is_found():
    data = bytearray(build(b"x" * 64))
    at = int.from_bytes(data[4:8], "little")
    n = int.from_bytes(data[at : at + 2], "little")
    data[at + 2 + 12 * n :] = at.to_bytes(4, "little")
    with pytest.raises(ValueError, match="loop"):
        list(pages(bytes(data)))


def test_query(spark):
    texts = {1: "", 2: None, 3: "abc", 4: "é" * 32, 5: "long text " * 20000, 6: "abc"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as feature")
    got = {r.doc_id: r for r in digest(df).collect()}
    for k, t in texts.items():
        n, payload = payload_of(t)
        assert (got[k].n_bytes, got[k].payload_bytes) == (n, len(payload))
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[k].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[4].payload_bytes == 64 and got[1].payload_bytes == 64
    assert tuple(got[3])[1:] == tuple(got[6])[1:]
    media = media_rows(df)
    assert sum(len(r.data) for r in page_rows(media, "doc_id", "media").where("doc_id = 5").collect()) == got[5].payload_bytes
    assert digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
