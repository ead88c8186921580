"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import digest

    return digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tag_paths import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import join

    return join(table(spark, sf_dir, "documents"))


def op5_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .factor_machine import KEEP_AT, fit, score

    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zstd_language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import held_in, score, train

    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(held_in(docs)))
    return got.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pruned_graph import EVERY, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
