import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from delimir.llm.bpe_tree import TreeBPE, digest, encode_column

PATH = public_tokenizers.path("byte_bpe_50k.json")
REF = Tokenizer.from_file(PATH)
CODEC = TreeBPE(PATH, leaf=16)
PARTS = ["a", "b", "the", "in", " ", "\n", "é", "ß", "中", "🙂", "1", "_", "'s", "<|endoftext|>", "\t", "²", "=", "-", "  ", " ", "inter", "nation"]


def same(texts):
    for t, got in zip(texts, CODEC.encode_batch(texts), strict=True):
        ids = REF.encode(t, add_special_tokens=False).ids
        assert memoryview(got).cast("I").tolist() == ids
        assert CODEC.decode(got) == REF.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=80).map("".join), max_size=4))
def test_is_the_library(texts):
    same(texts)


def test_long_unsplit_pieces():
    r = random.Random(5)
    same([r.choice("a=-x") * 5000, "".join(r.choice("abeinth") for _ in range(4000)), "".join(r.choice(["inter", "nation", "al", "é"]) for _ in range(900)), "中文" * 700, ""])


def test_queries(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "a" * 70000)], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = {r.doc_id: r for r in digest(df, PATH).collect()}
    assert (got[2].n_tokens, got[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest()) == (got[3].n_tokens, got[3].ids_sha256)
    assert got[4].decoded_sha256 == hashlib.sha256(b"a" * 70000).hexdigest()
    assert [r.ids for r in encode_column(df.where("doc_id = 1"), PATH).collect()] == [REF.encode("hello world").ids] * 2
    assert digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
