"""Words as bytes, 64-bit hashes of words and of runs of words, and maps over the rows of a table.

A word is a run of characters outside ``\\x20\\x09-\\x0D``. That is exactly what ``bytes.split()`` cuts at,
so texts are handled as UTF-8 bytes inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from swayrank.session import share_package

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 2_000  # of texts in one Arrow batch; Spark's default suits short rows
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
CACHED_WORDS = 150_000  # hashes kept per Python worker, about 30 MB


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; none for null."""
    return utf8(text).split()


class WordHashes(dict):
    """XXH64 by word, forgetting everything once `CACHED_WORDS` words are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A uint64 per word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A uint64 for each run of `length` consecutive words, by doubling; empty if there are fewer words.

    Two runs with the same words get the same value wherever they stand; other runs share one with a
    probability of 2^-64.
    """
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    level, size, done, out = hashes, 1, 0, None
    rest = length
    while rest:
        if rest & 1:
            part = level[done : done + count]
            out = _mix(part + np.uint64(size)) if out is None else _mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += size
        rest >>= 1
        if rest:
            level = _mix(level[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + level[size:])
            size *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    if size < width:
        step = width - size
        level = np.minimum(level[:-step], level[step:])
    return level


def prepare_session(spark: SparkSession) -> None:
    """Settings for work on texts: smaller Arrow batches, unless the session asks for less already.

    Python workers on this machine may also import the package from where the driver has it, if it is not installed.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    share_package(spark)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the given types. Whole numbers that may be missing stay exact, as they would not in a pandas column."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema
    )


def map_columns(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Apply `function` to batches of rows inside the scan's own tasks; nothing moves between tasks.

    It returns the new columns by name, as lists, arrays, or columns of the batch that pass through untouched.
    """
    target = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record_batch(function(batch), target)

    return df.mapInArrow(each, schema)


def map_frames(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Like `map_columns` over pandas frames, for columns without nulls only: with one, whole numbers become floats."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = function(frame)
            if made is not None and len(made):
                yield made

    return df.mapInPandas(each, schema)


HOT_SHARE = 1000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `facts`, which has each `key` once and in `n` the number of rows that have it.

    Keys with more than a `HOT_SHARE`-th of the `total` rows are `HOT_SHARE` at most, so their facts are broadcast; the rows
    of all other keys meet theirs in a shuffle in which no key is large.
    """
    hot = facts.filter(F.col("n") * HOT_SHARE > total).drop("n")
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key).eqNullSafe(F.col("_hot")), "left")
    rest = marked.filter("_hot is null").drop("_hot").join(facts.drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
