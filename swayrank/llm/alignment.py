"""Alignment of two tokenizers' tokens over the same bytes, by as-of merges of token starts.

Both tokenizers cover the same bytes, so a token of one overlaps a token of the other if and only if the later of
their starts lies in the other. `pandas.merge_asof` keyed by unit gives each token start the other side's token that
covers it; the pairs of both directions together are all overlaps. Offsets where tokens of both sides end cut the tokens
into groups.

A text is tokenised by units (see `bpe`) whose tokens do not depend on their surroundings, for either tokenizer. Tokens of
both sides end where a unit does, so links and groups lie within units: they are worked out once for a unit, many units at a
time, and a text puts those of its units together. Workers keep the answers for units seen last.

The number of links of a pair of ids is a sum over the corpus: distinct pairs of a document and their times go into a
table, are added up by pair, and meet their sums again. Pairs with the largest sums, `HOT_PAIRS` at most, are broadcast
for that; the others are joined, and none of those is frequent.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayrank.llm.bpe import _CUT, MAX_VOCABULARY_BYTES, byte_symbols, load_vocabulary
from swayrank.llm.words import arrow_schema, record_batch
from swayrank.session import freeze

SPACE = "▁"
ID_BITS = 20  # a token is one 32-bit number: its id, and above it its length in bytes
PAIR_BITS = 32  # a pair is one long: the first side's id, and below it the second's
HOT_PAIRS = 1 << 19
CACHED_UNITS = 200_000
KEPT_LENGTH = 40  # longer units are not kept
STEP_BYTES = 4 << 20  # of texts taken at a time; a longer text is taken alone

JOINED_UNITS = 128  # encoded as one text
HEAD = 3  # numbers before the pairs of a unit: its tokens on either side and its groups
NO_TOKENS = b"", b""

_UNEVEN = re.compile(r"\s(?: |(?<= )\s)")  # white space next to a space


def load_pieces(spark: SparkSession, path: str) -> Broadcast:
    """The piece model, read once on the driver and broadcast; its size is checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


class Units:
    """What is known of units, kept by the unit without its leading space in two generations.

    `answer` takes many units at a time: those of some texts that are not kept.
    """

    def __init__(self, answer: Callable[[list[str]], list], limit: int = CACHED_UNITS):
        self.answer, self.limit = answer, limit
        self.held: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    @staticmethod
    def cut(text: str | None) -> list[str]:
        """The units of a space and a text; none for null and empty."""
        if not text:
            return []
        if not (text[0].isspace() or text[-1].isspace() or _UNEVEN.search(text)):
            return text.split(" ")
        first, *rest = _CUT.split(" " + text)
        return [first[1:], *rest]

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """How many units each text has, the numbers of all, and the answers by number."""
        cut = [self.cut(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        total, places = int(sizes.sum()), {}
        seen_at = np.fromiter(map(places.setdefault, chain.from_iterable(cut), count()), np.int64, total)
        number = np.empty(total, np.int64)
        number[np.fromiter(places.values(), np.int64, len(places))] = np.arange(len(places))
        distinct = list(places)
        found = [*map(self.held.get, distinct)]
        missing = []
        for i, value in enumerate(found):
            if value is None:
                unit = distinct[i]
                value = found[i] = self.older.get(unit)
                if value is None:
                    missing.append(i)
                else:
                    self.held[unit] = value
        for i, value in zip(missing, self.answer([distinct[i] for i in missing])):
            found[i] = value
            if len(distinct[i]) <= KEPT_LENGTH:
                self.held[distinct[i]] = value
        if len(self.held) >= self.limit:
            self.older, self.held = self.held, {}
        return sizes, number[seen_at], found


class Sides:
    """Both tokenizers in one Python worker."""

    _held: dict[tuple, Sides] = {}

    def __init__(self, vocabulary: str, pieces: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(vocabulary)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        symbol_bytes = {symbol: byte for byte, symbol in byte_symbols().items()}
        self.first_bytes = [b""] * self.first.get_vocab_size(with_added_tokens=True)
        for token, i in self.first.get_vocab(with_added_tokens=False).items():
            self.first_bytes[i] = bytes(symbol_bytes.get(s, 0) for s in token)
        self.second = SentencePieceProcessor(model_proto=pieces)
        self.sizes = self.first.get_vocab_size(with_added_tokens=True), self.second.get_piece_size()
        self.second_bytes = [
            bytes([int(piece[3:-1], 16)]) if self.second.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in ((i, self.second.id_to_piece(i)) for i in range(self.sizes[1]))
        ]
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.first_bytes, self.second_bytes)]
        if max(self.sizes) > 1 << ID_BITS or max(x.max() for x in self.lengths) >= 1 << 32 - ID_BITS:
            raise ValueError("a vocabulary has too many or too long tokens")
        self.units = Units(self._aligned)
        numbers = [str(i) for i in range(max(self.sizes))]
        # A token's text in a group, by twice its id, plus one if it is its side's last in the group.
        self.texts = [np.array([(n + end).encode() for n in numbers for end in (",", last)], object) for last in "|;"]

    @classmethod
    def of(cls, vocabulary: Broadcast, pieces: Broadcast) -> Sides:
        key = (hash(vocabulary.value), hash(pieces.value))
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(vocabulary.value, pieces.value)
        return cls._held[key]

    def _tokens(self, texts: list[list[str]]) -> list[tuple[bytes, bytes] | None]:
        """Tokens on both sides of each unit of texts put together from units, each with a space before it.

        None stands for the units of a text that is not given back byte by byte, or whose tokens do not end where its units do.
        """
        joined = [" ".join(units) for units in texts]
        raw = [(" " + t).encode() for t in joined]
        size = np.fromiter((len(u.encode()) + 1 for units in texts for u in units), np.int64)
        units_of = np.fromiter(map(len, texts), np.int64, len(texts))
        wrong, sides = np.zeros(len(texts), bool), []
        first = (e.ids for e in self.first.encode_batch_fast([" " + t for t in joined], add_special_tokens=False))
        for rows, table, lengths in zip((first, self.second.encode(joined, num_threads=1)), (self.first_bytes, self.second_bytes), self.lengths):
            rows = list(rows)
            wrong |= np.fromiter((b"".join(map(table.__getitem__, r)) != t for r, t in zip(rows, raw)), bool, len(raw))
            ids = np.fromiter(chain.from_iterable(rows), np.int64)
            sides.append(((ids | lengths[ids] << ID_BITS).astype(np.uint32), np.fromiter(map(len, rows), np.int64, len(rows))))
        good = np.flatnonzero(~wrong)
        size = size[np.repeat(~wrong, units_of)]  # of texts that are right, tokens have the bytes of units
        unit_ends, text_of = np.cumsum(size), np.repeat(good, units_of[good])
        cut = []
        for packed, counts in sides:
            packed = packed[np.repeat(~wrong, counts)]
            ends = np.cumsum(packed >> np.uint32(ID_BITS), dtype=np.int64)
            at = np.searchsorted(ends, unit_ends)
            wrong[text_of[ends[at] != unit_ends]] = True
            stops = (4 * (at + 1)).tolist()
            packed = packed.tobytes()
            cut.append([packed[a:b] for a, b in zip([0, *stops], stops)])
        made, found = [], zip(*cut)
        right = np.zeros(len(texts), bool)
        right[good] = True
        for units, whole, bad in zip(texts, right, wrong):
            mine = list(islice(found, len(units))) if whole else []
            made += [None] * len(units) if bad else mine
        return made

    def _encode(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Tokens of units, each with a space before it, which the second side adds itself; None if a side does not give its bytes.

        Units are encoded `JOINED_UNITS` at a time, with single spaces between them: their tokens do not depend on their
        surroundings. Where that does not give the bytes, or a unit begins or ends with white space, they are encoded one by one.
        """
        even = [i for i, u in enumerate(units) if not (u[0].isspace() or u[-1].isspace())]
        texts = [even[i : i + JOINED_UNITS] for i in range(0, len(even), JOINED_UNITS)]
        made = dict(zip(even, self._tokens([[units[i] for i in t] for t in texts])))
        alone = [i for i in range(len(units)) if made.get(i) is None]
        made.update(zip(alone, self._tokens([[units[i]] for i in alone])))
        return [made[i] for i in range(len(units))]

    def _aligned(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """What `gather` needs of units: numbers of tokens, groups and linked pairs, and the groups' texts; empty if they have no tokens."""
        encoded = self._encode(units)
        good = [e for e in encoded if e is not None]
        if not good:
            return [NO_TOKENS] * len(units)
        batch = Aligned([list(t) for t in zip(*good)])
        first, second = batch.links()
        n_groups, groups = batch.groups(self.texts)
        unit = batch.docs[0][first]
        order = np.argsort(unit, kind="stable")
        pairs = (batch.ids[0][first] * self.sizes[1] + batch.ids[1][second])[order]
        stops = np.cumsum(np.bincount(unit, minlength=len(good)) + HEAD)
        heads = np.concatenate(([0], stops[:-1]))
        words = np.empty(stops[-1], np.int64)
        is_pair = np.ones(len(words), bool)
        for k, numbers in enumerate((batch.counts[0], batch.counts[1], n_groups)):
            words[heads + k], is_pair[heads + k] = numbers, False
        words[is_pair] = pairs
        words, stops = words.tobytes(), (8 * stops).tolist()
        made = iter([(words[a:b], g) for a, b, g in zip([0, *stops], stops, groups)])
        return [NO_TOKENS if e is None else next(made) for e in encoded]

    def gather(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
        """Numbers of tokens of either side and of groups by text, the groups, and text and pair of every link."""
        sizes, number, found = self.units.of_texts(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        words, groups = zip(*found) if found else ((), ())
        lengths = np.fromiter(map(len, words), np.int64, len(words)) // 8
        bad = np.zeros(len(texts), bool)
        bad[text[lengths[number] == 0]] = True
        number, text = number[~bad[text]], text[~bad[text]]
        starts = np.cumsum(lengths) - lengths
        words = np.frombuffer(b"".join(words), np.int64)
        counts = np.zeros((HEAD, len(texts)), np.int64)
        for k in range(HEAD):
            np.add.at(counts[k], text, words[starts[number] + k])
        links = lengths[number] - HEAD
        at = np.arange(links.sum()) + np.repeat(starts[number] + HEAD - (np.cumsum(links) - links), links)
        bounds, numbers = np.cumsum(np.bincount(text, minlength=len(texts))).tolist(), number.tolist()
        made = [b";".join(map(groups.__getitem__, numbers[a:b])) for a, b in zip([0, *bounds], bounds)]
        return list(counts), made, np.repeat(text, links), words[at]


class Aligned:
    """Links and groups of many units, from each side's tokens by unit."""

    def __init__(self, sides: list[list[bytes]]):
        self.counts = [np.array([len(t) // 4 for t in tokens], np.int64) for tokens in sides]
        packed = [np.frombuffer(b"".join(tokens), np.uint32) for tokens in sides]
        self.ids = [(p & np.uint32((1 << ID_BITS) - 1)).astype(np.int64) for p in packed]
        self.ends = [np.cumsum(p >> np.uint32(ID_BITS), dtype=np.int64) for p in packed]
        self.docs = [np.repeat(np.arange(len(c)), c) for c in self.counts]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of overlapping tokens on either side."""
        frames = [
            pd.DataFrame({"doc": docs, "start": np.concatenate(([0], ends[:-1])) if len(ends) else ends, "row": np.arange(len(ends))})
            for docs, ends in zip(self.docs, self.ends)
        ]
        covered = [
            pd.merge_asof(mine, other, on="start", by="doc", suffixes=("", "_other"), direction="backward")["row_other"].to_numpy(np.int64)
            for mine, other in (frames, frames[::-1])
        ]
        starts = [f["start"].to_numpy() for f in frames]
        later = np.flatnonzero(starts[1] != starts[0][covered[1]])  # equal starts are found in both directions
        return np.concatenate((np.arange(len(starts[0])), covered[1][later])), np.concatenate((covered[0], later))

    def groups(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
        """How many groups each unit has, and their texts."""
        common = self.ends[0][np.isin(self.ends[0], self.ends[1], assume_unique=True)]
        number = [np.searchsorted(common, ends) for ends in self.ends]
        last = [np.isin(ends, common, assume_unique=True) for ends in self.ends]
        in_group = [np.bincount(n, minlength=len(common) + 1) for n in number]
        before = [np.concatenate(([0], np.cumsum(c))) for c in in_group]
        parts = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        parts[np.arange(len(number[0])) + before[1][number[0]]] = texts[0][2 * self.ids[0] + last[0]]
        parts[np.arange(len(number[1])) + before[0][number[1] + 1]] = texts[1][2 * self.ids[1] + last[1]]
        bounds = np.concatenate(([0], np.cumsum(self.counts[0] + self.counts[1]))).tolist()
        parts = parts.tolist()
        made = [b"".join(parts[a:b])[:-1] for a, b in zip(bounds, bounds[1:])]
        return np.bincount(self.docs[0][last[0]], minlength=len(self.counts[0])), made


def _lists(values: np.ndarray, docs: np.ndarray, count: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=count))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def linked_tokens(
    docs: DataFrame, vocabulary: str, pieces: str, keep_groups: bool = False, doc_id: str = "doc_id", text: str = "text",
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256[, groups], pairs, times) per row, in the scan's own stage.

    `pairs` are the distinct pairs of ids that are linked, the first side's shifted left by `PAIR_BITS`; `times` how often.
    """
    shared = load_vocabulary(docs.sparkSession, vocabulary), load_pieces(docs.sparkSession, pieces)
    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        + "groups string, " * keep_groups + "pairs array<long>, times array<int>"
    )
    target = arrow_schema(schema)

    def aligned(ids: pa.Array, texts: list[str | None], sides: Sides) -> pa.RecordBatch:
        size, pairs_of_text = len(texts), sides.sizes[0] * sides.sizes[1]
        (n_a, n_b, n_groups), groups, text, pairs = sides.gather(texts)
        whole, times = np.unique(text * pairs_of_text + pairs, return_counts=True)
        pair_text, pair = np.divmod(whole, pairs_of_text)
        a, b = np.divmod(pair, sides.sizes[1])
        made = {
            "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(text, minlength=size),
            "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups],
            "pairs": _lists(a << PAIR_BITS | b, pair_text, size, pa.int64()), "times": _lists(times, pair_text, size, pa.int32()),
        }
        if keep_groups:
            made["groups"] = [g.decode() for g in groups]
        return record_batch(made, target)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, ids = Sides.of(*shared), batch.column("doc_id")
            texts, size, start = batch.column("text").to_pylist(), 0, 0
            for n, t in enumerate(texts):
                size += len(t or "")
                if size >= step_bytes or n + 1 == len(texts):
                    yield aligned(ids.slice(start, n + 1 - start), texts[start : n + 1], sides)
                    size, start = 0, n + 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, schema)


def _pairs_of(linked: DataFrame, *columns: str) -> DataFrame:
    return linked.select(*columns, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair of ids linked, and whether no pair with its second id has more."""
    counts = freeze(_pairs_of(linked).groupBy("pair").agg(F.sum("times").alias("n")))
    second = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("b")
    most = counts.groupBy(second).agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most
    return counts.select("*", second).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_from(counts: DataFrame, hot_pairs: int) -> tuple[int, bool]:
    """The least n of pairs to broadcast, a power of two, and whether others are left."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    levels = sorted(counts.groupBy(level).count().collect(), reverse=True)  # 64 rows at most
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > hot_pairs:
            return (1 << least if least is not None else 1 << 62), True
        least = row["level"]
    return 0, False


def align_tokens(
    docs: DataFrame, vocabulary: str, pieces: str, keep_groups: bool = False, hot_pairs: int = HOT_PAIRS,
    doc_id: str = "doc_id", text: str = "text", step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) per row.

    Side a is the byte-level BPE `vocabulary` over a space and the text, side b the `pieces` model over the text, which adds
    the space. Links are all pairs of tokens that share a byte; a pair of ids counts once for each link of the corpus
    that holds it. `n_best` are links whose pair no other pair of their b id exceeds, `count_sum` adds the counts over
    links. `groups` are the ids between offsets where both sides end, as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that a side does not give back byte by byte, have no tokens: zeros and ''. Names of
    special tokens in a text are plain text. Null ids, ties and repeated rows are rows like others, each counts; other
    columns are ignored; an empty table gives no rows. Very long texts are taken alone, whole.
    """
    made = linked_tokens(docs, vocabulary, pieces, keep_groups, doc_id, text, step_bytes)
    linked = freeze(made.withColumn("row", F.monotonically_increasing_id()))
    counts = freeze(pair_counts(linked))
    least, left = _hot_from(counts, hot_pairs)
    pairs = _pairs_of(linked, "row")
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    hot = F.broadcast(counts.filter(F.col("n") >= least))
    found = pairs.join(hot, "pair").groupBy("row").agg(*sums)
    if left:
        rest = pairs.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < least).hint("merge"), "pair")
        found = found.unionByName(rest.groupBy("row").agg(*sums)).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
        )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return linked.drop("pairs", "times").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * keep_groups
    )
