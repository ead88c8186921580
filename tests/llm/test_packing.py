import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from delimir.llm.packing import WordCodec, column_generation, pack, places, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
PARTS = ["a", "It's", "don't", "'S", " ", "\n", "é", "É", "ß", "中", "🙂", "12", "_", "<|endoftext|>", "<|", "\t", "²", "=", "end.", "Él,", "x..", "K̨", "İ,", "the", "  "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=5))
def test_codec_is_the_library(texts):
    ids, ends = codec().encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == REF.encode(t, add_special_tokens=False).ids


_CODEC = []


def codec():
    if not _CODEC:
        _CODEC.append(WordCodec(PATH))
    return _CODEC[0]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=12))
def test_plan_covers_and_fits(histogram):
    got, n = Counter(), 0
    patterns = plan(histogram, 32)
    for p, times in patterns:
        assert sum(k * a for k, a in p.items()) <= 32
        n += times
        for k, a in p.items():
            got[k] += a * times
    assert got == histogram
    bound = -(-sum(k * c for k, c in histogram.items()) // 32)
    assert n <= 1.75 * max(bound, sum(c for k, c in histogram.items() if k > 16)) + 2
    for k, (ends, first, *_) in places(patterns).items():
        assert ends[-1] >= histogram[k] and (first[1:] == ends[:-1]).all()


def test_column_generation_reaches_the_bound():
    weight, demand = np.array([3, 5, 7]), np.array([100.0, 50.0, 30.0])
    patterns, x = column_generation(weight, demand, 10)
    assert (patterns @ x >= demand - 1e-6).all() and (weight @ patterns <= 10).all()
    assert x.sum() == pytest.approx(25 + 12.5 + 30 - 0, rel=0.2)


def check(rows, texts, sequence):
    """Gapless sequences, each id once, right checksums."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    for doc, t in texts.items():
        ids = np.array([*REF.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)


def test_pack(spark):
    texts = {1: None, 2: "", 3: "word " * 300, 4: "a b c", 5: "x" * 9000, **{k: "some words here " * (k % 23) for k in range(6, 120)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as start", "'z' as sequence_id").repartition(3)
    check(pack(df, PATH, sequence=64, width=8).collect(), texts, 64)


def test_pack_empty_and_repeated(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(1, "same text")] * 50, "doc_id long, text string")
    rows = pack(df, PATH, sequence=64).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
    with pytest.raises(ValueError, match="multiple"):
        pack(df, PATH, sequence=63)


def test_padding_on_real_lengths(spark):
    from delimir.llm.queries import op1_packing

    rows = op1_packing(spark, "/root/testdata/sf0.01").collect()
    used, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert 1 - used / (n * 4096) < 0.01
