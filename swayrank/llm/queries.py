"""The operators as registered queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swayrank.llm import oracle
from swayrank.llm.alignment import align_tokens
from swayrank.llm.ann import nearest
from swayrank.llm.covertree import near_vectors
from swayrank.llm.licenses import scan_licenses
from swayrank.llm.mixing import mix
from swayrank.llm.packing import pack_documents
from swayrank.llm.quality import line_first
from swayrank.llm.sharding import TABLE_SIZE, place
from swayrank.llm.simhash import near_duplicates
from swayrank.llm.spelling import spelling_forms
from swayrank.llm.substrings import remove_repeats
from swayrank.llm.tokens import count_tokens
from swayrank.llm.warc import archive_pages
from swayrank.llm.words import prepare_session

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(128)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_source_mix", oracle.mixing())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of 150 % of all words takes of every document, sources weighing 3, 1, 2 in turn."""
    return mix(table(spark, folder, "documents"))


@query("op3_line_quality", oracle.quality())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of line-first cleaning for every document."""
    return line_first(table(spark, folder, "documents").select("doc_id", "text")).drop("text", "cleaned")


@query("op4_shard_placement", oracle.placement(SHARDS, TABLE_SIZE))
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and shard of every document, for 128 shards in 65,537 slots."""
    return place(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", SHARDS)


@query("op6_substring_dedup", oracle.substrings())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words that repeat a document with a smaller id, removed from all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document, linked at 4 or fewer differing bits."""
    return near_duplicates(table(spark, folder, "documents"), shingle=4, max_bits=4)


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op1_collision_search")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of all vectors for every vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 100 = 0"), vectors)


@query("op8_license_templates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and wordings in every document."""
    return scan_licenses(table(spark, folder, "documents")).drop("matches")


@query("op10_arc_to_warc", oracle.warc())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to ARC, converted to WARC and read back."""
    return archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op11_spelling_forms", oracle.spelling())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling_forms(table(spark, folder, "documents"))


@query("op12_near_embeddings", oracle.near_vectors())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors with the same label and a cosine of at least 0.93."""
    return near_vectors(table(spark, folder, "embeddings"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return align_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))
