"""The queries of this sub-package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldscale.llm.runtime import new_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.substring_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.language_id import document_rows, identify

    return identify(document_rows(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with markup attributes and addresses as evidence."""
    from foldscale.llm.language_id import identify, page_rows

    return identify(page_rows(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldscale.llm.token_store import read_tokens, write_tokens

    uri = new_path(spark, "token-store")
    manifest = write_tokens(table(spark, sf_dir, "documents"), uri, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, uri, manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scan,
            op2_substring_dedup,
            op3_jaccard_join,
            op4_token_count,
            op5_decontaminate,
            op6_embedding_dedup,
            op7_packing,
            op8_language_id,
            op9_quality,
            op10_token_store,
            pages_language_id,
        )
    }


def oracle_sql() -> dict[str, str]:
    """None of these can be stated in SQL in full: spans with checksums, tokenizers, sketches, trained models,
    packings and files. They are tested against brute force, round trips and held-out accuracy."""
    return {}
