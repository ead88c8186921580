import math
import zlib
from collections import Counter

import numpy as np
import pytest

from delimir.llm import factor_machine as fm
from delimir.llm import kneser_ney as kn
from delimir.llm import zstd_language as zl
from delimir.llm.queries import op5_factor_machine, op7_zstd_language

SF = "/root/testdata/sf0.1"


# -- language -----------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    got = op7_zstd_language(spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = got.join(docs, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) a", "avg(cast(rejected as double)) r").first()
    assert r.a > 0.98 and r.r < 0.02


def test_language_is_brute_force(spark):
    """Dictionaries by counting in Python, sizes by plain calls of the compressor."""
    import re

    import zstandard

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, texts = {}, Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            texts[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(w for w in re.findall(r"[^\W\d_]+", r.text.lower()) if len(w) <= 40)
    model = zl.fit(spark.createDataFrame(rows).repartition(3))
    assert {l: v.decode().split() for l, v in model.items()} == {l: [w for w, _ in sorted(counts[l].items(), key=lambda x: (-x[1], x[0]))[:2048]][::-1] for l in counts}
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False, **zl.SEARCH)
    got = {r.doc_id: r for r in op7_zstd_language(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        raw, sizes = r.text.lower().encode(), {}
        for l, v in model.items():
            d = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            sizes[l] = sum(len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(raw[k : k + zl.CHUNK])) for k in range(0, len(raw), zl.CHUNK))
        best = min(sizes.values())
        order = sorted(texts, key=lambda l: (-texts[l], l))
        assert got[r.doc_id].lang_pred == next(l for l in order if sizes[l] == best)


def test_language_of_long_and_repeated_texts(spark):
    de, en = "der die und das haus ", "the of and house "
    df = spark.createDataFrame([(1, de * 9, "de"), (4, en * 9, "en"), (5, en * 1_000_000, "en"), (5, en * 9, "en"), (7, None, "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as l", "2 as t", "3 as rejected")
    model = zl.fit(df)
    got = zl.identify(df, model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "de"), (4, "en"), (5, "en"), (5, "en"), (7, "und")]
    kept = zl.keep(df, model)
    assert kept.columns == df.columns and kept.count() == 4 and zl.keep(df.limit(0), model).count() == 0


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34!", "en"), (4, "the of and the house " * 9, "en"), (5, "der die und das haus " * 9, "de"), (6, "the of and " * 5000, None), (7, "x", None)], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    model = zl.fit(df)
    got = {r.doc_id: r for r in zl.identify(df, model).collect()}
    assert set(model) <= {"en", "de"}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert got[6].lang_pred in model
    assert zl.fit(df.limit(0)) == {} and zl.identify(df, {}).where("lang_pred <> 'und'").count() == 0
    assert zl.keep(df, model).columns == df.columns


# -- quality ------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op5_factor_machine(spark, SF).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.98
    assert np.mean([r.predicted for r in rows if r.quality]) > 0.95 and np.mean([r.predicted for r in rows if not r.quality]) < 0.1


def test_interactions_are_pairwise_sums():
    rng = np.random.default_rng(1)
    m = fm.Model(0.3, rng.normal(size=fm.SIZE), rng.normal(size=(fm.SIZE, fm.RANK)))
    rows = [fm.features("some words, some 12 WORDS!\nmore"), fm.features(None)]
    for row, got in zip(rows, m.logits(rows), strict=True):
        i, x, _ = fm.flat([row])
        want = m.bias + (m.linear[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(want)


def test_quality_of_long_repeated_and_clashing_rows(spark):
    good, bad = "Well, this is a fine sentence. It goes on, and ends. ", "buy!! $$$ NOW ||| click!! "
    texts = [good * 20, bad * 20, None, "", good * 60_000, good * 20]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, good * 20)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as h", "3 as i", "4 as y")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 1), (1, 0), (99, 1)], "doc_id long, quality int")
    m = fm.fit(docs, labels)
    rows = fm.score(docs, m).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[0]) == 1 and by[0] == by[5] and by[2] == by[3]
    kept = fm.keep(docs, m, at=0.0)
    assert kept.columns == docs.columns and kept.count() == 7 and fm.keep(docs, m, at=1.1).count() == 0


def test_quality_is_brute_force(spark):
    """The query's scores by the model's definition, term by term."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = fm.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op5_factor_machine(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
        i, x, _ = fm.flat([fm.features(texts[r.doc_id])])
        vx = m.factors[i].astype(float) * x[:, None]
        later = np.cumsum(vx[::-1], axis=0)[::-1]
        pairs = float((vx[:-1] * later[1:]).sum())  # each with all after it
        assert r.score == pytest.approx(1 / (1 + math.exp(-(m.bias + float((m.linear[i] * x).sum()) + pairs))), abs=1e-4)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    m = fm.fit(docs, labels)
    assert [r.score for r in fm.score(docs, m).collect()] == [0.5, 0.5]
    assert fm.score(docs.limit(0), m).count() == 0


# -- language model -----------------------------------------------------------------------------
def tokens(text):
    return [*(text or "").encode().lower().split(), "END"]


def reference(train, texts):
    """The model spelled out over dictionaries."""
    c, pairs = Counter(), Counter()
    for t in train:
        x = tokens(t)
        c.update(x)
        pairs.update(zip(["END", *x[:-1]], x, strict=True))
    n, v = sum(c.values()), len(c)
    a, follow = Counter(z for _, z in pairs), {}
    for (y, _), k in pairs.items():
        follow.setdefault(y, [0, 0, 0])[min(k, 3) - 1] += 1
    times = lambda q: [sum(x == k for x in q.values()) for k in (1, 2, 3, 4)]
    d, e = kn.discounts(times(pairs)), kn.discounts(times(a))
    off = lambda k, ds: ds[min(k, 3) - 1] if k else 0
    total = sum(a.values())
    left = sum(x * k for x, k in zip(e, [times(a)[0], times(a)[1], sum(x > 2 for x in a.values())], strict=True)) / total if total else 1

    def low(z):
        return ((a[z] - off(a[z], e)) / total if total else 0) + left / (v + 1)

    def high(y, z):
        if y not in c:
            return low(z)
        k = pairs[y, z]
        return (k - off(k, d)) / c[y] + sum(x * m for x, m in zip(d, follow[y], strict=True)) / c[y] * low(z)

    out = []
    for t in texts:
        x = tokens(t)
        out.append((len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), sum(math.log10(high(y, z)) for y, z in zip(["END", *x[:-1]], x, strict=True))))
    probability = sum(high(tokens(train[0])[0], z) for z in c) + high(tokens(train[0])[0], "never seen") if train else 1
    return out, probability


@pytest.mark.parametrize("sizes", [{}, {"word_size": 7, "pair_size": 9, "held_pairs": 20}, {"most": 3, "pair_size": 40}, {"most": 2, "pair_size": 5, "word_size": 3, "held_pairs": 7}])
def test_language_model(spark, sizes):
    train = ["the cat sat on the mat", "The dog sat on the cat", "a b c", None, "", "the the the the", "x\x1cy  z w\tq\x0br"] * 2 + ["new words here and the cat"] * 3
    texts = [*train, "unknown words the cat", "\n", "mat dog never"]
    want, probability = reference(train, texts)
    assert probability == pytest.approx(1)
    m = kn.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), **sizes)
    rows = kn.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as t"), m).collect()
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == (pytest.approx(w[3]), pytest.approx(w[4]))


def test_language_model_of_a_long_text(spark, monkeypatch):
    """Tens of MB in one text, few arrays kept open; repeated rows count each."""
    monkeypatch.setattr(kn, "MAPPED", 3)
    unit = "one two three two one four "
    train = [unit * 500_000, "x y", "x y", unit]
    m = kn.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(2), word_size=3, pair_size=400_000)
    want, _ = reference(train[1:], [])
    rows = kn.score(spark.createDataFrame([(1, train[0]), (2, "x y"), (2, "x y")], "doc_id long, text string"), m).orderBy("doc_id").collect()
    assert rows[0].n_tokens == rows[0].n_known == 3_000_001 and rows[0].train_tokens == 3_000_001 + 3 + 3 + 7
    counts = {"one": 1_000_002, "two": 1_000_002, "three": 500_001, "four": 500_001, "x": 2, "y": 2, "END": 4}
    base = sum(k * math.log10((counts[w] + 0.1) / (rows[0].train_tokens + 0.1 * 8)) for w, k in (("one", 1_000_000), ("two", 1_000_000), ("three", 500_000), ("four", 500_000), ("END", 1)))
    assert rows[0].base_score == pytest.approx(base) and rows[1] == rows[2]


def test_ids_beyond_32_bits():
    m = kn.Model("/nowhere", 10**13, (1 << 36) + 5, 1, [0], 1 << 22)
    first = np.array([0, 1, 1 << 35, (1 << 36) + 4, 123456789012 % (1 << 36)], np.int64)
    second = np.array([(1 << 36) + 4, 0, 7, 1 << 33, 5], np.int64)
    shard, key = m.pair_keys(first, second)
    for k in range(len(first)):
        a, b = m.pair_ids(int(shard[k]), key[k : k + 1])
        assert (a[0], b[0]) == (first[k], second[k])
    assert (0 <= shard).all() and (shard < 1 << 22).all()


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    m = kn.train(empty)
    assert kn.score(empty, m).count() == 0
    assert [r.score for r in kn.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), m).collect()] == [0.0]


def test_columns_round_trip():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 999, dtype=np.uint64))
    got = kn.expand(kn.squeeze(keys, np.arange(len(keys))))
    assert (got[0] == keys).all() and (got[1] == np.arange(len(keys))).all()
    assert zlib.crc32(b"") == 0 and len(kn.expand(kn.squeeze(np.zeros(0, np.uint64)))[0]) == 0
