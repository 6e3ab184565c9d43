"""Byte-level BPE vocabularies in tasks: texts are cut into units whose tokens do not depend on their surroundings.

A space between two characters that are not white space always starts a new pre-token, so a text can be cut
there and each unit (with its leading space) handled on its own. Units repeat a lot; each Python worker keeps
the answers for those seen last, up to twice `CACHED_UNITS`.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import SparkSession

CACHED_UNITS = 200_000
KEPT_PIECES, PIECE_CHARS = 30_000, 64  # of units that are no plain words; some 5 MB
MARKS = ".,!?;:"
MAX_VOCABULARY_BYTES = 64 << 20

assert sys.byteorder == "little" and array("I").itemsize == 4  # ids are little-endian unsigned 32-bit numbers

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pre-tokens of Latin letters, digits or ASCII marks, and lone line breaks. Apostrophes are left out: they may start a contraction.
_PIECE = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n(?!\s)")


class Uneven(ValueError):
    """A unit that begins or ends with more white space than the one space before it."""


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read once on the driver and broadcast; its size is checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        content = file.read()
    model = json.loads(content)
    if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without normalisation")
    return spark.sparkContext.broadcast(content)


class Cache(dict):
    """Answers for units, by the unit without the space before it, in two generations.

    Once `CACHED_UNITS` are held they become the older generation, and the older one before them is forgotten.
    What is used again moves up. Uneven units are refused, never held.
    """

    def __init__(self, answer: Callable[[str], object]):
        super().__init__()
        self.answer = answer
        self.older: dict[str, object] = {}

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            if not unit or unit[0].isspace() or unit[-1].isspace():
                raise Uneven
            value = self.answer(" " + unit)
        if len(self) >= CACHED_UNITS:
            self.older = dict(self)
            self.clear()
        self[unit] = value
        return value

    def of_text(self, text: str) -> list:
        """The answers for a text's units. Most texts can be cut at every space."""
        first, *rest = text.split(" ")
        if first and not (rest and first[-1].isspace()):
            try:
                return [self.answer(first), *map(self.__getitem__, rest)]
            except Uneven:
                pass
        first, *rest = _CUT.split(text)
        made = [self.answer(first)]
        for unit in rest:
            try:
                made.append(self[unit])
            except Uneven:  # the last unit may end with white space
                made.append(self.answer(" " + unit))
        return made


SYMBOL_BITS, PLACE_BITS = 24, 40


class Merges:
    """The merge rules of a vocabulary, with symbols as small numbers."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.numbers: dict[str, int] = {}
        number = lambda symbol: self.numbers.setdefault(symbol, len(self.numbers))
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.ranks.setdefault(number(left) << SYMBOL_BITS | number(right), rank)
            self.merged.append(number(left + right))

    def count(self, symbols: str) -> int:
        """How many tokens byte-pair merging leaves of `symbols`.

        A heap holds the rank and place of adjacent pairs; a doubly linked list joins the symbols that are left.
        The lowest rank is popped again and again, the leftmost first; a place whose pair has changed since is
        skipped. The count is the number of initial symbols less the number of merges.
        """
        size, ranks, merged = len(symbols), self.ranks, self.merged
        symbol = [self.numbers.get(s, -1) for s in symbols]
        heap = []
        for i in range(size - 1):
            rank = ranks.get(symbol[i] << SYMBOL_BITS | symbol[i + 1])
            if rank is not None:
                heap.append(rank << PLACE_BITS | i)
        if not heap:
            return size
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        mask, merges = (1 << PLACE_BITS) - 1, 0
        while heap:
            lowest = heapq.heappop(heap)
            i, rank = lowest & mask, lowest >> PLACE_BITS
            j, left = after[i], symbol[i]
            if left < 0 or j >= size or ranks.get(left << SYMBOL_BITS | symbol[j]) != rank:
                continue
            merges += 1
            made = symbol[i] = merged[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                rank = ranks.get(made << SYMBOL_BITS | symbol[k])
                if rank is not None:
                    heapq.heappush(heap, rank << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbol[h] << SYMBOL_BITS | made)
                if rank is not None:
                    heapq.heappush(heap, rank << PLACE_BITS | h)
        return size - merges


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def is_plain_word(word: str) -> bool:
    """Whether a word is nothing but Latin letters, and so a single pre-token."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Pieces(dict):
    """The ids of pre-tokens of up to `PIECE_CHARS` characters, forgetting everything once `KEPT_PIECES` are held."""

    def __init__(self, answer: Callable[[str], bytes]):
        super().__init__()
        self.answer = answer

    def __missing__(self, piece: str) -> bytes:
        ids = self.answer(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """One vocabulary in one Python worker."""

    _held: dict[int, Vocabulary] = {}

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.content, self.model = content, self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.symbols = byte_symbols()
        self.pieces = Pieces(self._piece)
        self.marks = {mark: self._encode(mark) for mark in MARKS}
        self.counts, self.encoded = Cache(self._count), Cache(self._ids)

    @classmethod
    def of(cls, shared: Broadcast) -> Vocabulary:
        content = shared.value
        key = hash(content)
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(content)
        return cls._held[key]

    @cached_property
    def merges(self) -> Merges:
        rules = json.loads(self.content)["model"]["merges"]
        return Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in rules])

    def _count(self, unit: str) -> int:
        word = unit[1:] if unit[0] == " " else unit
        if is_plain_word(word):
            return self.merges.count(self._spell(unit))
        if unit[-1] in MARKS and is_plain_word(word[:-1]):
            return (self.counts[word[:-1]] if unit[0] == " " else self._count(unit[:-1])) + 1
        parts, total = [unit], 0
        if self.added is not None and self.added.search(unit):
            total, parts = len(self.added.findall(unit)), self.added.split(unit)
        for part in parts:
            if part:
                for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    total += self.merges.count(symbols)
        return total

    def _spell(self, unit: str) -> str:
        """The symbols of a unit that is a single pre-token."""
        if unit.isascii() and unit[1:].isalpha():  # letters stand for themselves
            return self.symbols[ord(unit[0])] + unit[1:]
        return unit.encode().decode("latin-1").translate(self.symbols)

    def _ids(self, unit: str) -> bytes:
        spaced = unit[0] == " "
        word = unit[1:] if spaced else unit
        if word.isalpha() and is_plain_word(word):
            return self._piece(unit)
        if spaced and unit[-1] in MARKS and is_plain_word(word[:-1]):
            return self.encoded[word[:-1]] + self.marks[unit[-1]]
        return self._encode(unit)

    def _piece(self, piece: str) -> bytes:
        """The ids of a single pre-token."""
        return array("I", [t.id for t in self.model.tokenize(self._spell(piece))]).tobytes()

    def _encode(self, text: str) -> bytes:
        """Pre-tokens that are told easily have their ids put together, words from those held; else the library decides."""
        pieces = _PIECE.findall(text)
        if sum(map(len, pieces)) != len(text) or self.added is not None and self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(pieces) > 1 and pieces[0][0] == " ":
            return self.encoded[pieces[0][1:]] + b"".join(map(self.pieces.__getitem__, pieces[1:]))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null and empty."""
        return sum(self.counts.of_text(text)) if text else 0

    def ids(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian 32-bit numbers."""
        return b"".join(self.encoded.of_text(text)) if text else b""
