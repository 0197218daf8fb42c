"""A training-corpus pipeline over ``documents``: language, near copies, benchmark leaks, secrets, packing.

Every stage works on all that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscale.llm.decontaminate import contained_items
from foldscale.llm.jaccard_join import jaccard_join
from foldscale.llm.language_id import document_rows, identify
from foldscale.llm.packing import pack
from foldscale.llm.queries import tokenizer_path
from foldscale.llm.runtime import fresh, importable, key_of, materialize, table
from foldscale.llm.secret_scan import redact


def keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """``docs`` with a row key from these columns, so that rows that share a doc_id are told apart; rows with the
    same key are alike in all that a stage decides by (but for collisions of 64 bits)."""
    key = fresh(docs, "_k")
    parts = [x for c in columns if c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumn(key, F.xxhash64(*parts)), key


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """The rows as the operators take them, with the row key as their id."""
    return docs.select(F.col(key).alias("doc_id"), *(c for c in docs.columns if c not in ("doc_id", key)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language stay; rows without letters (null and empty texts too) and rows of no known
    language go. Rows that are alike in id, text, language and source are decided alike; no rows give no rows."""
    importable(spark)
    rows, key = keyed(docs, "doc_id", "text", "lang", "source")
    gone = identify(document_rows(by_key(rows, key))).where(~F.col("accepted")).select(F.col("id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").drop(key)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (null before all); of rows
    that share doc_id and text one stays. Null, empty and wordless texts are copies of nothing; no rows give no rows."""
    importable(spark)
    rows, key = keyed(docs, "doc_id", "text")
    found = jaccard_join(by_key(rows, key)).where("n_links > 0").select(key_of("doc_id").alias(key), key_of("class_id").alias("_class"))
    found = found.join(rows.select(key, key_of("doc_id").alias("_id")), key).select(key, "_class", "_id").distinct()
    first = found.groupBy("_class").agg(F.min(F.struct("_id", key))[key].alias(key)).select(key)
    gone = found.select(key).join(first, key, "left_anti")
    return rows.join(gone, key, "left_anti").dropDuplicates([key, "doc_id"]).drop(key)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, decided by row: of rows that share a doc_id only those whose text
    holds one. Null and empty texts stay; without documents or items nothing goes."""
    rows, key = keyed(docs, "doc_id", "text")
    gone = contained_items(by_key(rows, key), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; all documents stay, repeated ones too, null and empty texts as they
    are, and ``n_chars`` follows the text."""
    importable(spark)
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences: a null or empty text is its end id, rows that share
    a doc_id are packed each, no rows give no rows."""
    importable(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontaminate", leaks),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: No stage but the last could be stated in SQL, so there is none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
