"""Removal of passages that repeat across documents, found by automata of confirmed phrases.

1. Signatures: every window of `window` consecutive words has an anchor, the smallest hash among the short
   phrases inside it. Equal windows have equal anchors. A document keeps its runs of windows with one anchor.
2. Anchors seen in two documents or more have an owner, the smallest such document. Only windows with
   such an anchor can repeat; their words are cut out as slices, keyed by owner.
3. Confirmation: window hashes of the slices are counted; a window found in two documents is confirmed and
   joined with its neighbours into a passage of the smallest document that has it.
4. Passages are dealt to shards by owner. Each shard compiles its passages, in blocks of half a window, into
   an Aho-Corasick automaton and streams the slices of that shard through it. Any window of a passage
   contains a whole block, so hits lead to every occurrence: a hit is followed to both sides as far as text and
   passage have the same words, and marks them if they make a window and the passage's document is smaller.
   Words decide, not hashes.
5. Marked words are removed.

Documents with the same words as one with a smaller id lose everything (if they have a window at all), so
only the smallest of them goes through 2 to 4. A shard with many passages or many slices becomes a grid of
parts x salts, so no task grows with an owner's popularity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swayrank.llm.words import map_frames, run_hashes, sliding_min, utf8, word_hashes, words_of
from swayrank.session import freeze

WINDOW = 50
PHRASE = 10  # words of the phrases that anchors are chosen from
SHARD_CHARS = 1_000_000  # passage text per automaton, about 60 MB compiled
STREAM_CHARS = 8_000_000  # slice text per task
LOC_BITS = 32
PAIRS = 1 << 15  # of hits and surroundings compared at a time


def _packed(texts: DataFrame) -> DataFrame:
    """`text` as compressed UTF-8 (null stays null), for joins that have to move whole texts; the rest is passed on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            packed = pa.array([None if t is None else pressed.compress(t) for t in texts], pa.binary())
            yield batch.set_column(at, "text", packed)

    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in texts.schema.fields]
    return texts.mapInArrow(each, T.StructType(fields))


def _unpacked(pressed: Iterable[bytes | None]) -> Iterator[bytes | None]:
    plain = zstandard.ZstdDecompressor()
    return (None if p is None else plain.decompress(p) for p in pressed)


def _runs(anchors: np.ndarray) -> np.ndarray:
    """Where each run of equal consecutive values begins."""
    return np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(anchors) else np.empty(0, int)


def _window_anchors(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    return sliding_min(run_hashes(hashes, phrase), window - phrase + 1)


def signatures(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per row with a window: doc_id, tag, a digest of all words, and its windows as runs of one anchor each."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, tag, text in zip(frame["doc_id"], frame["tag"], frame["text"]):
            words = words_of(text)
            if len(words) < window:
                continue
            anchors = _window_anchors(word_hashes(words), window, phrase)
            starts = _runs(anchors)
            rows.append((
                doc_id, tag, len(anchors), xxhash.xxh128_digest(b" ".join(words)), starts.astype(np.int64),
                anchors[starts].view(np.int64),
            ))
        return pd.DataFrame(rows, columns=["doc_id", "tag", "n_windows", "digest", "starts", "anchors"])

    return map_frames(
        docs, each, "doc_id long, tag long, n_windows long, digest binary, starts array<long>, anchors array<long>"
    )


def _slices(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of neighbouring windows with one owner: (owner, doc_id, tag, start, words)."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, tag, text, runs in zip(frame["doc_id"], frame["tag"], _unpacked(frame["text"]), frame["runs"]):
            words = text.split()
            last: list | None = None
            for start, stop, owner in sorted((r["start"], r["stop"], r["owner"]) for r in runs):
                if last is not None and last[2] == owner and last[1] == start:
                    last[1] = stop
                    continue
                if last is not None:
                    rows.append((last[2], doc_id, tag, last[0], b" ".join(words[last[0] : last[1] + window - 1])))
                last = [start, stop, owner]
            rows.append((last[2], doc_id, tag, last[0], b" ".join(words[last[0] : last[1] + window - 1])))
        return pd.DataFrame(rows, columns=["owner", "doc_id", "tag", "start", "words"])

    # Merged even if one side is small: without a shuffle between, a task would run two Python workers.
    joined = docs.join(wanted.hint("merge"), "doc_id")
    return map_frames(joined, each, "owner long, doc_id long, tag long, start long, words binary")


def _window_rows(slices: DataFrame, window: int) -> DataFrame:
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        made = [run_hashes(word_hashes(w.split()), window) for w in frame["words"]]
        counts = [len(m) for m in made]
        offsets = np.concatenate([np.arange(n) for n in counts])
        return pd.DataFrame({
            "owner": np.repeat(frame["owner"].to_numpy(), counts),
            "hash": np.concatenate(made).view(np.int64),
            "doc_id": np.repeat(frame["doc_id"].to_numpy(), counts),
            "loc": (np.repeat(frame["start"].to_numpy(), counts) << LOC_BITS) + offsets,
        })

    return map_frames(slices, each, "owner long, hash long, doc_id long, loc long")


def _confirmed(slices: DataFrame, window: int) -> DataFrame:
    """Windows of two documents or more, as sorted offsets in a slice of the smallest: (owner, doc_id, start, offsets)."""
    counted = _window_rows(slices, window).groupBy("owner", "hash").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.min_by("loc", "doc_id").alias("loc"),
    )
    return (
        counted.filter("first_id < last_id")
        .select(
            "owner", F.col("first_id").alias("doc_id"), F.shiftright("loc", LOC_BITS).alias("start"),
            F.col("loc").bitwiseAND(F.lit((1 << LOC_BITS) - 1)).alias("offset"),
        )
        .groupBy("owner", "doc_id", "start")
        .agg(F.collect_list("offset").alias("offsets"))
    )


def _passages(slices: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """Runs of confirmed windows as text: (owner, doc_id, words)."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for owner, doc_id, words, offsets in zip(frame["owner"], frame["doc_id"], frame["words"], frame["offsets"]):
            at, words = np.unique(np.asarray(offsets, np.int64)), words.split()
            for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                rows.append((owner, doc_id, b" ".join(words[run[0] : run[-1] + window])))
        return pd.DataFrame(rows, columns=["owner", "doc_id", "words"])

    joined = slices.join(confirmed, ["owner", "doc_id", "start"])
    return map_frames(joined, each, "owner long, doc_id long, words binary")


def _blocks(words: list[bytes], size: int) -> Iterator[str]:
    for at in range(0, len(words) - size + 1, size):
        yield _spell(b" ".join(words[at : at + size]))


def _spell(words: bytes) -> str:
    """One character per byte, with spaces around, so that a block can only match whole words."""
    return " " + words.decode("latin-1") + " "


class Contexts:
    """An automaton of the blocks of passages, and where each block stands: the words around it and the smallest document."""

    GAP = -2  # stands where a passage ends; -1 is a word that no passage has

    def __init__(self, passages: pd.DataFrame, window: int):
        self.window, self.block = window, window // 2
        self.side = window - self.block
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        phrases: dict[str, dict[bytes, int]] = {}
        gap = np.full(self.side, self.GAP, np.int32)
        for first, text in zip(passages["doc_id"], passages["words"]):
            words = text.split()
            ids = np.concatenate((gap, [self.number.setdefault(w, len(self.number)) for w in words], gap)).astype(np.int32)
            for n, phrase in enumerate(_blocks(words, self.block)):
                around = ids[n * self.block : (n + 1) * self.block + 2 * self.side].tobytes()
                found = phrases.setdefault(phrase, {})
                found[around] = min(int(first), found.get(around, int(first)))  # equal surroundings count once
        for k, phrase in enumerate(phrases):
            self.automaton.add_word(phrase, k)
        self.automaton.make_automaton()
        sizes = [len(f) for f in phrases.values()]
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.firsts = np.fromiter((first for f in phrases.values() for first in f.values()), np.int64)
        joined = b"".join(around for f in phrases.values() for around in f)
        self.words = np.frombuffer(joined, np.int32).reshape(-1, self.block + 2 * self.side)

    def covered(self, text: bytes, doc_id: int) -> Iterator[tuple[int, int]]:
        """(start, stop): words of `text` covered by a window that a smaller document has."""
        spelled = _spell(text)
        hits = np.array(list(self.automaton.iter(spelled)), np.int64).reshape(-1, 2)
        if not len(hits):
            return
        spaces = np.flatnonzero(np.frombuffer(spelled.encode("latin-1"), np.uint8) == 32)
        begins = np.searchsorted(spaces, hits[:, 0]) - self.block  # the word each block begins with
        pad = np.full(self.side, -1, np.int32)
        ids = np.concatenate((pad, np.fromiter((self.number.get(w, -1) for w in text.split()), np.int32), pad))
        change = np.zeros(len(spaces) + 1, np.int64)
        counts = np.diff(self.starts)[hits[:, 1]]
        ends = np.cumsum(counts)
        step = 0
        while step < len(hits):  # some hits at a time: each meets all surroundings of its block
            upto = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + PAIRS)))
            n = counts[step:upto]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[hits[step:upto, 1]], n)
            begin = np.repeat(begins[step:upto], n)
            smaller = self.firsts[place] < doc_id
            place, begin = place[smaller], begin[smaller]
            same = ids[begin[:, None] + np.arange(self.words.shape[1])] == self.words[place]
            left = np.logical_and.accumulate(same[:, : self.side][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, self.side + self.block :], axis=1).sum(axis=1)
            whole = left + self.block + right >= self.window
            np.add.at(change, (begin - left)[whole], 1)
            np.add.at(change, (begin + self.block + right)[whole], -1)
            step = upto
        inside = np.flatnonzero(np.cumsum(change) > 0)
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
            if len(run):
                yield int(run[0]), int(run[-1] + 1)


def _locate(passages: pd.DataFrame, slices: pd.DataFrame, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, tag, start, stop): words of `slices` covered by a window that a smaller document has."""
    contexts = Contexts(passages, window)
    for doc_id, tag, start, text in zip(slices["doc_id"], slices["tag"], slices["start"], slices["words"]):
        for a, b in contexts.covered(text, int(doc_id)):
            yield int(doc_id), int(tag), int(start + a), int(start + b)


def _grid(passages: DataFrame, slices: DataFrame, window: int, shard_chars: int, stream_chars: int) -> DataFrame:
    """Deal passages and slices to shards and locate every occurrence."""
    chars = F.sum(F.length("words"))
    total = passages.agg(chars).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")
    passages, slices = passages.select("*", shard), slices.select("*", shard)
    load = (
        passages.groupBy("shard").agg(F.ceil(chars / shard_chars).cast("int").alias("parts"))
        .join(slices.groupBy("shard").agg(F.ceil(chars / stream_chars).cast("int").alias("salts")), "shard")
    )
    load = freeze(load)  # one row per shard
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = passages.join(load, "shard").select(
        "shard", F.pmod(F.xxhash64("owner", "words"), "parts").cast("int").alias("part"),
        every("salts").alias("salt"), "doc_id", "words",
    )
    right = slices.join(load, "shard").select(
        "shard", every("parts").alias("part"), F.pmod(F.xxhash64("doc_id", "start"), "salts").cast("int").alias("salt"),
        "doc_id", "tag", "start", "words",
    )

    def each(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        rows = list(_locate(p, s, window)) if len(p) and len(s) else []
        return pd.DataFrame(rows, columns=["doc_id", "tag", "start", "stop"]).astype("int64")

    keys = ["shard", "part", "salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        each, "doc_id long, tag long, start long, stop long"
    )


def _kept_words(words: list[bytes], covered) -> list[bytes]:
    mask = np.ones(len(words), bool)
    for span in covered:
        mask[span["start"] : span["stop"]] = False
    return [words[i] for i in np.flatnonzero(mask)]


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE,
    shard_chars: int = SHARD_CHARS, stream_chars: int = STREAM_CHARS,
) -> DataFrame:
    """(doc_id, tag, covered, copy): the word spans that repeat a document with a smaller id, for documents with any.

    `docs` has doc_id (not null), tag (a hash of the text) and text. `covered` is an array of (start, stop)
    that may overlap; `copy` marks documents whose whole word sequence stands in a document with a smaller id,
    whose spans are not spelled out.
    """
    marks = freeze(signatures(docs, window, phrase))
    firsts = marks.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = freeze(
        marks.select("doc_id", "tag", "digest").join(firsts, ["digest", "doc_id"], "left_anti")
        .select("doc_id", "tag").distinct()
    )
    originals = marks.join(copies, ["doc_id", "tag"], "left_anti")
    stops = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n_windows"))
    runs = freeze(
        originals.select(
            "doc_id", F.explode(F.arrays_zip("anchors", "starts", stops.alias("stops"))).alias("run")
        ).select(
            "doc_id", F.col("run.anchors").alias("anchor"), F.col("run.starts").alias("start"),
            F.col("run.stops").alias("stop"),
        )
    )
    recurring = (
        runs.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_id"))
        .filter("owner < last_id").select("anchor", "owner")
    )
    wanted = runs.join(recurring, "anchor").groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "stop", "owner")).alias("runs")
    )
    slices = freeze(_slices(_packed(docs.select("doc_id", "tag", "text")), wanted, window))
    passages = freeze(_passages(slices, _confirmed(slices, window), window))
    found = _grid(passages, slices, window, shard_chars, stream_chars)
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("covered"))
    nothing = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    return freeze(
        spans.select("doc_id", "tag", "covered", F.lit(False).alias("copy"))
        .unionByName(copies.select("doc_id", "tag", nothing.alias("covered"), F.lit(True).alias("copy")))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """`docs` with a new text, and n_words, n_removed and kept_sha256 beside it.

    Each word covered by a window of `window` words whose sequence also starts in a document with a smaller
    doc_id is removed; windows are judged on the input. A text that loses nothing stays as it is, others become
    their kept words joined by one space. kept_sha256 is of the kept words joined by one space either way.

    A null text stays null and has no words; empty and short texts lose nothing. Rows with a null id take no part
    and lose nothing. Rows that share an id are not smaller than each other, so they lose nothing to one another;
    each of them is judged against smaller ids. Columns other than
    doc_id and text pass through; columns named like the new ones, in any case, are replaced. An empty table gives none.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_sha256")])
    tag = F.xxhash64("text")
    named = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text"
    )
    spans = repeated_spans(named, window, **options).select(
        F.col("doc_id").alias("_span_id"), F.col("tag").alias("_span_tag"), "covered", "copy"
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), tag.alias("tag"), "text")
    rows = _packed(rows)
    joined = rows.join(
        spans.hint("merge"), (rows["row.doc_id"] == spans["_span_id"]) & (rows["tag"] == spans["_span_tag"]), "left"
    ).select("row", "text", "covered", F.coalesce("copy", F.lit(False)).alias("copy"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, digests = [], [], [], []
            for t, spans, whole in zip(
                _unpacked(batch.column("text").to_pylist()), batch.column("covered").to_pylist(), batch.column("copy").to_pylist()
            ):
                words = (t or b"").split()
                kept = [] if whole else _kept_words(words, spans) if spans is not None else words
                joined = b" ".join(kept)
                texts.append(t if len(kept) == len(words) else joined)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
            columns = {
                "row": batch.column("row"), "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ])
    made = joined.mapInArrow(clean, schema)
    return made.select(
        *[F.col(f"row.`{c}`") if c != "text" else F.col("text") for c in docs.columns], "n_words", "n_removed", "kept_sha256"
    )
