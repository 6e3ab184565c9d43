"""From raw documents to packed training sequences: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of `documents`, with `text` and `n_chars` as the stage leaves them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayrank.llm.mixing import mixed_documents
from swayrank.llm.packing import pack_documents
from swayrank.llm.quality import line_first
from swayrank.llm.simhash import drop_near_duplicates
from swayrank.llm.substrings import remove_repeats
from swayrank.llm.words import prepare_session
from swayrank.session import freeze

VOCABULARY = "byte_bpe_50k.json"


COUNTED = "n_chars"


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the other columns in one struct, so that no operator meets their names."""
    rest = [c for c in docs.columns if c not in ("text", COUNTED)]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"))


def _unboxed(made: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with a new text, and n_chars counted anew where there is one."""
    counted = lambda c: F.length(text).cast(docs.schema[c].dataType).alias(c)
    return made.select(*[
        F.col(text).alias(c) if c == "text" else counted(c) if c == COUNTED else F.col(f"_rest.`{c}`") for c in docs.columns
    ])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines.

    Null, empty and short texts are rejected, whatever their id; very long texts are judged whole; repeated rows are judged
    alike; all columns pass through; an empty table gives no rows.
    """
    prepare_session(spark)
    return _unboxed(line_first(_boxed(docs)).filter("kept"), "cleaned", docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null and wordless texts are one group; rows with a null id all stay; rows that share an id but are not near
    duplicates all stay, repeated rows come out once; very long texts count whole; all columns pass through; an empty table
    gives no rows.
    """
    prepare_session(spark)
    return drop_near_duplicates(docs, shingle=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document with a smaller id has.

    Null texts stay null, shorter ones stay as they are; rows with a null id lose nothing and take nothing from others; rows
    with equal ids lose nothing to each other; very long texts are searched whole; all columns pass through; an empty
    table gives no rows.
    """
    prepare_session(spark)
    made = remove_repeats(_boxed(docs))
    return _unboxed(made, "text", docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150 % of all words takes them; the one at a source's cut in part.

    Null sources are a source; null ids and repeated rows are mixed like others; null and wordless texts are never taken;
    very long texts are cut like others; all columns pass through; an empty table gives no rows.
    """
    prepare_session(spark)
    mixed = mixed_documents(docs)
    if COUNTED not in docs.columns:
        return mixed
    counted = F.length("text").cast(docs.schema[COUNTED].dataType).alias(COUNTED)
    return mixed.select(*[counted if c == COUNTED else F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    Null and empty texts are the end token alone; null ids, ties and repeated rows are packed like others; longer texts are
    cut; other columns are ignored; an empty table gives no rows.
    """
    prepare_session(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither XXH64 nor byte-pair merging; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents in `sf_dir`; each stage is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
