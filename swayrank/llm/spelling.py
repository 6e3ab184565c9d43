"""Words one edit apart, found by walking word states through tries kept as an edge table.

Two words that differ by one edit agree on their first half or on their second, so there is a trie of the words and one of
the reversed words, each for every word length apart, and a walk starts below the half that agrees: at the node of a word's
own prefix, in the trie of its length (a replaced code point) and in that of the next length (an inserted one; a deleted one
is the same pair seen from the other word). A state is (word, what is left of it, node, edits). Level by level, states meet the
edges of their node: an edge that spells the next code points is taken as it is, one that does so after one edit is
taken by states that have none yet. States that end at a leaf with one edit are neighbours.

Edges lead from one branching to the next, so long words that share little have short paths. They come from aggregations: the
words below a node that go on with one code point agree as far as the smallest and the largest of them do. Nodes are named by
128-bit hashes of prefixes, so a word makes as many rows as it has code points, and no row holds more of it than it needs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.llm.words import arrow_schema, map_columns, record_batch
from swayrank.operators.order import ordered_index
from swayrank.session import freeze

MIN_LENGTH = 5
MIN_COUNT = 3
TYPO_EVERY = 97
FORM_RATIO = 2
HELD_WORDS = 200_000  # counted in a task before they are passed on
SEED = 20_029
_RUN = re.compile("[a-zÀ-ÿ]+")


def runs_of(text: str | None) -> list[str]:
    """Runs of letters, with A-Z lower-cased."""
    return _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


def thinned(run: str, start: int, every: int) -> str:
    """A run without one code point, if the checksum of its document's id (up to here: `start`) and itself says so."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def count_words(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n): words of at least `min_length` code points that occur at least `min_count` times."""
    schema = "word string, n long"
    target = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return record_batch({"word": list(held), "n": list(held.values())}, target)

        for batch in batches:
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(runs_of(t)).items():
                    if len(run) < min_length:
                        continue
                    word = run if doc is None else thinned(run, start, typo_every)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield made()
                    held.clear()
        if held:
            yield made()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(each, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


# ---- names of nodes ----

def start_depth(length, reverse):
    """How many code points of a word of `length` agree with what is searched before the walk starts."""
    return np.where(reverse, length // 2, (length - 1) // 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Hashes of all prefixes of words that have one length."""

    _rng = np.random.default_rng(SEED)
    LETTERS = _rng.integers(0, 1 << 63, (2, 1 << 16), np.uint64) * np.uint64(2) + np.uint64(1)
    BASES = LETTERS[:, 0]

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), self.length)
        self.codes = codes
        with np.errstate(over="ignore"):
            powers = [np.concatenate((np.ones(1, np.uint64), np.full(self.length - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in self.BASES]
            sums = [(table[codes & 0xFFFF] * p).cumsum(axis=1, dtype=np.uint64) for table, p in zip(self.LETTERS, powers)]
        self.sums = [np.concatenate((np.zeros((len(words), 1), np.uint64), s), axis=1) for s in sums]

    def names(self, rows, depths, trie_lengths, reverse: int) -> list[np.ndarray]:
        """Both halves of the names of the prefixes of `depths` code points, in the tries of `trie_lengths`."""
        place = (np.asarray(trie_lengths, np.uint64) << np.uint64(32)) + (np.asarray(depths, np.uint64) << np.uint64(1)) + np.uint64(reverse)
        with np.errstate(over="ignore"):
            return [_mixed(s[rows, depths] + _mixed(place + b)).view(np.int64) for s, b in zip(self.sums, self.BASES)]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, Prefixes]]:
    """Places and prefixes of the words of each length; long words one by one."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // length)
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, Prefixes([words[i] for i in part])


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _trie_rows(words: DataFrame) -> DataFrame:
    """(a, b, depth, reverse, root, letter, id): for each word and depth, the node there and how the word goes on.

    `id` is the word's place among all words, in the order of the trie.
    """

    def each(batch: pa.RecordBatch) -> dict:
        given, parts = batch.column("word").to_pylist(), []
        for reverse, column in enumerate(("forward", "backward")):
            ids = batch.column(column).to_numpy(zero_copy_only=False)
            for places, prefixes in _by_length([w[::-1] for w in given] if reverse else given):
                length, start = prefixes.length, int(start_depth(prefixes.length, reverse))
                rows = np.repeat(np.arange(len(places)), length - start)
                depths = np.tile(np.arange(start, length), len(places))
                a, b = prefixes.names(rows, depths, length, reverse)
                parts.append({
                    "a": a, "b": b, "depth": depths, "reverse": np.full(len(rows), reverse), "root": depths == start,
                    "letter": prefixes.codes[rows, depths], "id": ids[places][rows],
                })
        return _joined(parts)

    return map_columns(words, each, "a long, b long, depth int, reverse int, root boolean, letter int, id long")


def _edges(words: DataFrame) -> DataFrame:
    """(node, label, child, leaf, target): the edges of all tries; `target` is the word of a leaf, `child` the node elsewhere."""
    rows = _trie_rows(words)
    below = rows.groupBy("a", "b", "depth", "reverse", "root", "letter").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # A node has at most as many entries here as there are letters.
    nodes = below.groupBy("a", "b", "depth", "reverse", "root").agg(F.collect_list(F.struct("low", "high")).alias("ways"))
    kept = freeze(nodes.filter("root or size(ways) > 1").select("a", "b", "depth", "reverse", F.inline("ways")))
    spelled = freeze(
        words.select(F.lit(0).alias("reverse"), F.col("forward").alias("id"), F.col("word").alias("x"))
        .unionByName(words.select(F.lit(1).alias("reverse"), F.col("backward").alias("id"), F.reverse("word").alias("x")))
    )
    low = spelled.select("reverse", F.col("id").alias("low"), F.col("x").alias("low_x"))
    high = spelled.select("reverse", F.col("id").alias("high"), F.col("x").alias("high_x"))
    ends = kept.join(low, ["reverse", "low"])
    ends = ends.filter("low = high").withColumn("high_x", F.lit(None).cast("string")).unionByName(
        ends.filter("low <> high").join(high, ["reverse", "high"])
    )

    def each(batch: pa.RecordBatch) -> dict:
        low, high = batch.column("low_x").to_pylist(), batch.column("high_x").to_pylist()
        reverse = batch.column("reverse").to_numpy()
        upto = np.array([len(x) if y is None else len(commonprefix((x, y))) for x, y in zip(low, high)])
        child = np.zeros((2, len(low)), np.int64)
        for places, prefixes in _by_length(low):
            for side in (0, 1):
                mine = np.flatnonzero(reverse[places] == side)
                if len(mine):
                    child[:, places[mine]] = prefixes.names(mine, upto[places[mine]], prefixes.length, side)
        depths = batch.column("depth").to_pylist()
        leaf = [y is None for y in high]
        return {
            "a": batch.column("a"), "b": batch.column("b"), "label": [x[d:u] for x, d, u in zip(low, depths, upto.tolist())],
            "child_a": child[0], "child_b": child[1], "leaf": leaf,
            "target": [(x[::-1] if r else x) if end else None for x, r, end in zip(low, reverse.tolist(), leaf)],
        }

    made = map_columns(
        ends.select("a", "b", "depth", "reverse", "low_x", "high_x"), each,
        "a long, b long, label string, child_a long, child_b long, leaf boolean, target string",
    )
    return made.select(F.struct("a", "b").alias("node"), "label", F.struct(F.col("child_a").alias("a"), F.col("child_b").alias("b")).alias("child"), "leaf", "target")


def _starts(words: DataFrame) -> DataFrame:
    """(word, node, rest, longer, edits): the first states; `longer` ones walk among words one code point longer."""

    def each(batch: pa.RecordBatch) -> dict:
        given, parts = batch.column("word").to_pylist(), []
        for reverse in (0, 1):
            spelled = [w[::-1] for w in given] if reverse else given
            for places, prefixes in _by_length(spelled):
                for longer in (0, 1):
                    length = prefixes.length + longer
                    depth = int(start_depth(length, reverse))
                    a, b = prefixes.names(np.arange(len(places)), np.full(len(places), depth), length, reverse)
                    parts.append({
                        "word": np.array([given[i] for i in places], object), "a": a, "b": b,
                        "rest": np.array([spelled[i][depth:] for i in places], object), "longer": np.full(len(places), bool(longer)),
                    })
        return _joined(parts)

    made = map_columns(words.select("word"), each, "word string, a long, b long, rest string, longer boolean")
    return made.select("word", F.struct("a", "b").alias("node"), "rest", "longer", F.lit(0).alias("edits"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further, with `leaf` and `target` of the edge."""
    met = states.join(edges, "node").withColumn("width", F.char_length("label"))
    part = lambda start, length: F.substring(F.col("rest"), start, length)
    one: Column = F.lit(1)
    head, shorter = part(one, F.col("width")), part(one, F.col("width") - 1)
    equal = head == F.col("label")
    replaced = (F.char_length(head) == F.col("width")) & (F.levenshtein(head, "label", 1) == 1)
    inserted = (F.char_length(shorter) == F.col("width") - 1) & (F.levenshtein(shorter, "label", 1) == 1)
    edited = (F.col("edits") == 0) & ~equal & F.when(F.col("longer"), inserted).otherwise(replaced)
    taken = F.when(edited & F.col("longer"), F.col("width") - 1).otherwise(F.col("width"))
    return met.filter(equal | edited).select(
        "word", F.col("child").alias("node"), F.substring("rest", taken + 1, F.char_length("rest")).alias("rest"), "longer",
        (F.col("edits") + edited.cast("int")).alias("edits"), "leaf", "target",
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of different words, from a table with each `word` once, that are one edit apart."""
    spelled = ordered_index(words.select("word"), [F.col("word")], out="forward")
    spelled = freeze(ordered_index(spelled, [F.reverse("word")], out="backward"))
    edges = freeze(_edges(spelled))
    states, found = _starts(spelled), []
    while True:
        moved = freeze(_step(states, edges))
        found.append(moved.filter("leaf and edits = 1 and rest = ''").select("word", F.col("target").alias("near"), "longer"))
        states = moved.filter("not leaf").drop("leaf", "target")
        if not states.head(1):
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    both = every.select("word", "near").unionByName(every.filter("longer").select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms from each word of `forms` (word, form). Chains have no rings."""
    current = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = freeze(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if not moved.filter("moved").head(1):
            return current


def spelling_forms(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY, ratio: int = FORM_RATIO,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of at least `min_length` code points and `min_count` occurrences.

    Words are runs of Latin letters, A-Z lower-cased; a run whose checksum with its document's id is divisible by `typo_every`
    loses a code point. Words are near if one inserted, deleted or replaced code point apart. The form of a word is its most
    frequent near word (ties: the first in code point order) if that occurs at least `ratio` times as often, and the root
    is where following forms ends, the word itself without one.

    Null and empty texts have no words. In rows with a null id no run loses a code point. Repeated rows count again, very long
    texts and words are taken whole; other columns are ignored; an empty table gives no rows.
    """
    words = freeze(count_words(docs, min_length, min_count, typo_every, doc_id, text))
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    around = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(around, "word", "left").select("word", "n", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))
    clear = F.col("form_n") >= F.col("n") * ratio
    formed = freeze(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("form")).alias("form"),
        F.when(clear, F.col("form_n")).alias("form_n"),
    ))
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
