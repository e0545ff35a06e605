"""The registered query of each operator; each covers its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import (
    byte_bpe,
    decontaminate,
    ego_join,
    hard_negatives,
    html_text,
    language_id,
    licenses,
    line_dedup,
    packing,
    pii,
    simhash,
    spelling,
    warc,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return line_dedup.remove_shared_lines(docs)


SQL["op3_line_dedup"] = line_dedup.SQL


@_register
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


@_register
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@_register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items)


SQL["op6_decontamination"] = decontaminate.SQL


@_register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page in the deduplicated archives, read back from them."""
    _, records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_register
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return ego_join.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@_register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@_register
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@_register
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word, after a letter of one run in 31 is lost."""
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slip=31))


SQL["op11_spelling"] = spelling.SQL


@_register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after a seventh of the labels moved on by one."""
    whole = "transform(embedding, x -> if(isnan(x) OR abs(x) = double('infinity'), NULL, floor(256 * double(x))))"
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.expr(whole).alias("vector"),
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


SQL["op12_hard_negatives"] = hard_negatives.SQL


@_register
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
