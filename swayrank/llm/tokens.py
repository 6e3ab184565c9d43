"""Token counts by byte-pair merging that only counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.llm.bpe import Vocabulary, load_vocabulary
from swayrank.llm.words import map_columns, utf8

LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, whole texts, in the scan's own stage.

    `vocabulary` is the path of a byte-level BPE file in the tokenizers library's format. Counts equal that
    library's without added begin or end tokens; special strings inside a text count as their one token.
    Null and empty texts have 0 bytes and 0 tokens. Null ids, ties and repeated rows are returned as they
    come; other columns are ignored; an empty table gives no rows. Memory per worker is one batch and a cache
    of fixed size; a pre-token of n bytes takes O(n log n) time.
    """
    shared = load_vocabulary(docs.sparkSession, vocabulary)

    def each(batch: pa.RecordBatch) -> dict:
        held, texts = Vocabulary.of(shared), batch.column("text").to_pylist()
        counts = [held.count(t) for t in texts]
        return {
            "doc_id": batch.column("doc_id"), "n_bytes": [len(utf8(t)) for t in texts], "n_tokens": counts,
            "over_limit": [c > limit for c in counts],
        }

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_columns(rows, each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
