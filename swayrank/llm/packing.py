"""Packing token sequences by bounded-space online best-fit.

Texts are tokenised where they are read; only lengths move. Pieces are dealt in hash order to tasks of about
`TASK_TOKENS` tokens; in a task a fixed number of bins is open at a time, found through a bitset keyed by free
space. At most that many bins a task end partly filled, a share that shrinks as tasks are made larger.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.llm.bpe import Vocabulary, load_vocabulary
from swayrank.llm.words import arrow_schema, map_columns, record_batch
from swayrank.session import freeze

MAX_TOKENS = 1024
END_ID = 2
OPEN_BINS = 1024
TASK_TOKENS = 256_000_000
LOCAL_BITS = 33  # sequence numbers of one task


class BestFit:
    """Online best-fit with at most `open_bins` open bins; when one more is needed, the fullest closes first."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0  # bit f is set if an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        chosen = self.bins[free].pop()
        if not self.bins[free]:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for the next piece."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            self.bins[left].append(chosen)
            self.free_bits |= 1 << left
            self.open += 1
        return chosen, self.capacity - free


def token_pieces(
    docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut only if longer than a sequence.

    Of a text that is cut, the first piece takes the remainder, so the others fill whole sequences. `ids` are
    the piece's ids as little-endian unsigned 32-bit numbers.
    """
    shared = load_vocabulary(docs.sparkSession, vocabulary)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def each(batch: pa.RecordBatch) -> dict:
        held, end, rows = Vocabulary.of(shared), end_id.to_bytes(4, "little"), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = held.ids(text) + end
            count = len(ids) // 4
            start, stop, piece = 0, (count - 1) % max_tokens + 1, 0
            while start < count:
                part = ids[4 * start : 4 * stop]
                rows.append((doc_id, piece, start, stop - start, zlib.crc32(part), *[part] * keep_ids))
                start, stop, piece = stop, stop + max_tokens, piece + 1
        return dict(zip(names, map(list, zip(*rows))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_columns(rows, each, schema)


def best_fit(
    pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS
) -> DataFrame:
    """`pieces` (with a `length` of 1 to `max_tokens`) and the sequence_id and offset of each.

    The order in which a task sees pieces is fixed by a hash of their columns, so a task that runs again after
    a lost executor makes the same sequences.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    order = F.xxhash64(*pieces.columns)
    dealt = pieces.withColumn("_order", order).repartition(tasks, "_order").sortWithinPartitions("_order")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema = f"{fields}, sequence_id long, offset long"
    target = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(max_tokens, open_bins)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        for batch in batches:
            placed = [bins.place(x) for x in batch.column("length").to_pylist()]
            made = {name: batch.column(name) for name in batch.schema.names}
            yield record_batch(made | {"sequence_id": [base + s for s, _ in placed], "offset": [o for _, o in placed]}, target)

    return dealt.mapInArrow(each, schema)


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, **options) -> DataFrame:
    """The pieces of all texts with their places in sequences of at most `max_tokens` tokens.

    A null or empty text is `end_id` alone. Null ids, ties and repeated rows are packed like any other row;
    columns other than doc_id and text are ignored; an empty table gives no pieces. Very long texts are cut
    into pieces of a whole sequence each, only the first may be shorter.
    """
    pieces = freeze(token_pieces(docs, vocabulary, max_tokens, end_id))
    return best_fit(pieces, max_tokens, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence, from packed pieces that kept theirs."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", "n_tokens", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("ids"))
        .withColumn("ids", F.unhex("ids"))
    )
