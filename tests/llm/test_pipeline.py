import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from delimir.llm import chosen_path, factor_machine, zstd_language  # noqa: E402
from delimir.llm.queries import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
        if name == "language":
            clear = zstd_language.identify(before, zstd_language.fit(before)).where("not rejected")
            assert sorted(r.doc_id for r in clear.collect()) == sorted(r.doc_id for r in docs.collect())
        if name == "quality":
            scores = factor_machine.score(before, factor_machine.fit(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert sorted(r.doc_id for r in scores.where("score >= 0.7").collect()) == sorted(r.doc_id for r in docs.collect())
        if name == "near_duplicates":
            classes = chosen_path.join(before).select("class_id").distinct().count()
            assert docs.count() == classes == chosen_path.join(docs).select("class_id").distinct().count()
    assert sorted({r.doc_id for r in kept["packing"].collect()}) == sorted({r.doc_id for r in kept["personal_data"].collect()})
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, kept["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


WORDS = "the of and a to in is was it for on with as at by this had not are but from or have an they which one you were her all she there would their we him been has when who will no more if out so".split()


def odd_documents(spark):
    """Null, empty, very long, repeated and near-equal texts, rows of one id, columns with names used within."""
    import random

    r = random.Random(3)
    prose = lambda n: ". ".join(" ".join(r.choice(WORDS) for _ in range(12)).capitalize() for _ in range(n)) + "."
    one, two = prose(30), prose(30)
    texts = [one, one, two, None, None, "", "123 !", prose(20) + " mail a.b@example.org now", two + " Or so it is.", prose(40_000), prose(9), prose(14)]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 2}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [(0, one, "en", None, len(one)), (None, prose(25), "en", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.selectExpr("*", "1 as _row", "2 as fp", "3 as score", "4 as _text", "5 as h", "6 as id").repartition(3)


def test_stages_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    pq = str(tmp_path / "docs")
    docs.write.parquet(pq)
    docs = spark.read.parquet(pq)
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted(docs.collect(), key=str)
    clear = stages["language"](spark, docs, SF)
    assert clear.columns == docs.columns and clear.where("text is null or text in ('', '123 !')").count() == 0 and clear.count() == len(rows) - 4
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and set(map(tuple, good.collect())) <= set(map(tuple, rows))
    single = stages["near_duplicates"](spark, docs, SF)
    got = single.collect()
    assert single.columns == docs.columns and set(map(tuple, got)) <= set(map(tuple, rows))
    # one of the two pairs and of three equal ones, and one of the three without words
    assert len(got) == len(rows) - 2 - 1 - 2
    clean = stages["personal_data"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text is null and n_chars is null").count() == 2 and clean.where("text like '%mail [EMAIL] now'").count() == 1
    assert clean.where("text is not null and n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, docs, SF).collect()
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in rows})
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    pq = str(tmp_path / "none")
    odd_documents(spark).limit(0).write.parquet(pq)
    docs = spark.read.parquet(pq)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
