"""Line-first cleaning: lines are judged one by one, failing ones go, and documents that lose too much are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.llm.words import utf8

SYMBOLS = b"#*$%&|<>"

# Phrases that mark a line as boilerplate or as navigation, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "we use cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter",
    "share this article", "follow us on", "powered by wordpress",
    "alle rechte vorbehalten", "datenschutzbestimmungen", "nutzungsbedingungen", "wir verwenden cookies", "newsletter abonnieren",
    "politique de cookies", "nous utilisons des cookies", "plan du site", "droits de reproduction",
    "todos los derechos reservados", "aviso legal", "utilizamos cookies", "politica de privacidad",
)
NAVIGATION = (
    "home", "menu", "next", "previous", "back", "back to top", "read more", "click here", "log in", "login", "sign in",
    "sign up", "register", "search", "contact us", "about us", "site map", "skip to content",
    "startseite", "weiter", "mehr lesen", "anmelden", "kontakt", "impressum", "suche",
    "accueil", "suivant", "retour", "lire la suite", "se connecter", "rechercher",
    "inicio", "siguiente", "anterior", "volver", "contacto", "buscar",
)


@dataclass(frozen=True)
class Rules:
    """Shares are of a line's words, or of a text's words for `max_lost`."""

    min_words: int = 50
    max_repeat_percent: int = 50
    noisy_percent: int = 30  # words with two or more symbols or exclamation or question marks in a row
    separator_percent: int = 20  # words that are nothing but a separator
    boilerplate_words: int = 20  # longest line that a boilerplate phrase can fail
    max_lost_percent: int = 30


_MARK = re.compile(r"[.!?:;…。！？؟।]")
_NOISE = re.compile(rb"[#*$%&|<>]{2}|[!?]{2}")
_SEPARATORS = {mark.encode() for mark in "|>/»•·"}
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I | re.A)
_NAVIGATION = re.compile("|".join(map(re.escape, NAVIGATION)), re.I | re.A)


def line_fails(line: str, rules: Rules) -> bool:
    """Whether a line breaks a rule. A line without words breaks none.

    Punctuation: no sentence mark at all, or too many noisy words. Navigation: too many separators, or a line that
    is nothing but a navigation phrase. Boilerplate: a short line with a boilerplate phrase.
    """
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return False
    count = len(words)
    if not _MARK.search(line):
        return True
    if _NOISE.search(raw) and 100 * sum(_NOISE.search(w) is not None for w in words) > rules.noisy_percent * count:
        return True
    if not _SEPARATORS.isdisjoint(words):
        if 100 * sum(w in _SEPARATORS for w in words) >= rules.separator_percent * count:
            return True
    if count <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return True
    return count <= 4 and _NAVIGATION.fullmatch(line.strip(" \t\n\r\x0b\x0c.!?:;")) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    for word in words:
        if word not in number:
            number[word] = len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(number) + ids[2:]
    _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """The measures of one text, the verdict, and the text without failing lines."""
    raw = utf8(text)
    words = raw.split()
    n_words = len(words)
    word_chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, duplicates, kept, lost, failed = set(), 0, [], 0, 0
    for line in (text or "").split("\n"):
        in_line = len(utf8(line).split())
        if in_line:
            duplicates += line in seen
            seen.add(line)
        if line_fails(line, rules):
            lost += in_line
            failed += 1
        else:
            kept.append(line)
    repeats = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words
    accepted = not base_failed and 100 * lost <= rules.max_lost_percent * n_words
    cleaned = text if text is None or not failed else "\n".join(kept)
    return n_words, word_chars, n_symbols, duplicates, repeats, base_failed, accepted, failed, lost, cleaned


NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines",
    "n_lost_words", "cleaned",
)
TYPES = dict(zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["long"] * 2 + ["string"]))


def line_first(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`docs` with measures, base_failed, kept, n_failed_lines, n_lost_words and the `cleaned` text.

    All is done in the scan's own stage, row by row, whatever the length. A null text has no words and stays
    null; it fails the base rule like an empty one. Ids are not looked at, so null ids and repeated rows come out
    as they are. Columns of `docs` pass through; ones named like the new ones, in any case, are replaced. An empty
    table gives no rows.
    """
    rest = [c for c in docs.columns if c.lower() not in TYPES]

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in TYPES.items()))
    def judged(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, rules) for t in text], columns=NAMES)

    # Declared nondeterministic, or a filter on the verdict would judge every text a second time.
    verdict = judged.asNondeterministic()("text")
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), verdict.alias("made"))
    return made.select(*[F.col(f"row.`{c}`") for c in rest], *[F.col(f"made.{n}") for n in NAMES])
