"""License scans by templates with markup, compiled into one automaton over words.

A template is wording with two kinds of markup: ``<<opt>> ... <<end>>`` may be missing, and ``<<var max=8>>`` stands
for up to so many words of any kind (``match=...`` restricts them). All other wording is mandatory. Templates
are compiled into a nondeterministic automaton over words; sets of its states are made deterministic as texts ask
for them, and kept. A place matches if the automaton accepts from there, that is if all mandatory words stand in
order with nothing between them but what the markup allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.llm.words import map_columns, utf8

MAX_CACHED_STEPS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased bytes: runs without other ASCII characters
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    markup: str
    base: bool = False


# The phrases whose places are counted as base, and licence wordings with their labels.
BASE = (
    Template("mit phrase", "mit", "under the mit license", True),
    Template("apache phrase", "apache-2", "apache license version 2", True),
    Template("cc by nc phrase", "cc-by-nc", "cc by nc", True),
)
MIT_GRANT = """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies
        or substantial portions of the software"""
ISC_GRANT = """
        permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies"""
BSD_GRANT = """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met"""
BSD_CONDITIONS = """
        <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list
        of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution"""
BSD_ENDORSEMENT = """
        <<opt>>3<<end>> neither the name <<opt>>s<<end>> of <<var max=12>> nor the names of <<var max=4>> contributors may be used to
        endorse or promote products derived from this software without specific prior written permission"""
BSD_DISCLAIMER = """
        this software is provided by <<var max=10>> as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
        <<var max=10>> be liable for any direct indirect incidental special exemplary or consequential damages including but
        not limited to procurement of substitute goods or services loss of use data or profits or business interruption
        however caused and on any theory of liability whether in contract strict liability or tort including negligence or
        otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
TEMPLATES = (
    Template("mit grant", "mit", "released under <<opt>>the<<end>> mit license"),
    Template("mit text", "mit", MIT_GRANT),
    Template("isc text", "isc", ISC_GRANT),
    Template("bsd text", "bsd", BSD_GRANT),
    Template("apache grant", "apache-2", "licensed under the apache license version 2 <<opt>>0<<end>> <<opt>>the license<<end>>"),
    Template("apache notice", "apache-2", """
        licensed under the apache license version 2 0 the license you may not use <<opt>>this file<<end>> <<var max=6>>
        except in compliance with the license"""),
    Template("gpl grant", "gpl-3", """
        <<opt>>this work is<<end>> licensed under <<opt>>the terms of<<end>> the gnu general public license
        <<opt>>gpl<<end>> <<opt>>version<<end>> <<opt>>v<<end>> 3"""),
    Template("gpl 2 grant", "gpl-2", """
        <<opt>>this work is<<end>> licensed under <<opt>>the terms of<<end>> the gnu general public license
        <<opt>>gpl<<end>> <<opt>>version<<end>> <<opt>>v<<end>> 2"""),
    Template("gpl notice", "gpl-3", """
        <<opt>>this program is free software<<end>> you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license"""),
    Template("lgpl grant", "lgpl", "licensed under <<opt>>the terms of<<end>> the gnu lesser general public license"),
    Template("agpl grant", "agpl-3", "licensed under <<opt>>the terms of<<end>> the gnu affero general public license"),
    Template("mpl notice", "mpl-2", """
        this source code form is subject to the terms of the mozilla public license v 2 0"""),
    Template("cc grant", "cc-by", """
        licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution <<var max=2 match=[0-9]|international>>
        license"""),
    Template("cc by", "cc-by", "licensed under cc by <<var max=1 match=[0-9]>> 0"),
    Template("cc by sa", "cc-by-sa", "licensed under cc by sa"),
    Template("cc by nc", "cc-by-nc", "licensed under cc by nc <<opt>>4 0<<end>>"),
    Template("cc by nc long", "cc-by-nc", "creative commons attribution non commercial"),
    Template("cc by nc one word", "cc-by-nc", "creative commons attribution noncommercial"),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    Template("mit whole", "mit", MIT_GRANT + """
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<opt>>the<<end>>
        <<var max=8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software"""),
    Template("isc whole", "isc", ISC_GRANT + """
        the software is provided as is and <<var max=8>> <<opt>>disclaims<<end>> <<opt>>disclaim<<end>> all warranties with regard to
        this software including all implied warranties of merchantability and fitness in no event shall <<var max=8>> be
        liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
        use data or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software"""),
    Template("bsd 2 whole", "bsd-2", BSD_GRANT + BSD_CONDITIONS + BSD_DISCLAIMER),
    Template("bsd 3 whole", "bsd-3", BSD_GRANT + BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_DISCLAIMER),
    Template("zlib whole", "zlib", """
        this software is provided as is without any express or implied warranty in no event will <<var max=8>> be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions <<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation
        would be appreciated but is not required <<opt>>2<<end>> altered source versions must be plainly marked as such
        and must not be misrepresented as being the original software <<opt>>3<<end>> this notice may not be removed or
        altered from any source distribution"""),
    Template("apache whole notice", "apache-2", """
        licensed under the apache license version 2 0 the license you may not use <<opt>>this file<<end>> <<var max=6>> except in
        compliance with the license you may obtain a copy of the license at <<opt>>http<<end>> <<opt>>https<<end>> www apache
        org licenses license 2 0 <<opt>>html<<end>> <<opt>>txt<<end>> unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied see the license for the specific language governing permissions and limitations
        under the license"""),
    Template("spdx mit", "mit", "spdx license identifier mit"),
    Template("spdx apache", "apache-2", "spdx license identifier apache 2 0"),
    Template("spdx gpl", "gpl-3", "spdx license identifier gpl 3 0 <<opt>>only<<end>> <<opt>>or later<<end>>"),
)


class Automaton:
    """All templates as one automaton. A state is (template, place, words taken by the region at that place)."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.programs = [self._compile(t) for t in templates]
        start = frozenset(s for t in range(len(templates)) for s in self._closure((t, 0, 0)))
        if any(self._accepts(s) for s in start):
            raise ValueError("a template must have mandatory wording")
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepted: list[tuple[int, ...]] = []
        self.steps: list[dict[bytes, int]] = []
        self.held = 0
        self._start_set = start
        self.start = self._number(start)
        self.first = set()
        for t, at, _ in start:
            kind, *rest = self.programs[t][at] if at < len(self.programs[t]) else ("end",)
            if kind == "var":
                raise ValueError(f"template {templates[t].name} must not begin with a replaceable region")
            if kind == "word":
                self.first.add(rest[0])

    @staticmethod
    def _compile(template: Template) -> list[tuple]:
        """Instructions: ("word", w), ("opt", place after its end), ("var", max, match)."""
        program, open_regions = [], []
        for i, piece in enumerate(_MARKUP.split(template.markup)):
            if i % 2 == 0:
                program += [("word", w) for w in _WORD.findall(piece.encode().lower())]
                continue
            kind, _, options = piece.strip().partition(" ")
            if kind == "opt":
                open_regions.append(len(program))
                program.append(("opt", None))
            elif kind == "end" and open_regions:
                program[open_regions.pop()] = ("opt", len(program))
            elif kind == "var":
                given = dict(o.split("=", 1) for o in options.split())
                match = re.compile(given["match"].encode()) if "match" in given else None
                program.append(("var", int(given["max"]), match))
            else:
                raise ValueError(f"template {template.name}: markup {piece!r}")
        if open_regions:
            raise ValueError(f"template {template.name}: a region is not ended")
        return program

    def _closure(self, state: tuple[int, int, int]):
        t, at, taken = state
        yield state
        if at < len(self.programs[t]):
            kind, *rest = self.programs[t][at]
            if kind == "opt":
                yield from self._closure((t, at + 1, 0))
                yield from self._closure((t, rest[0], 0))
            elif kind == "var":
                yield from self._closure((t, at + 1, 0))

    def _accepts(self, state: tuple[int, int, int]) -> bool:
        return state[1] == len(self.programs[state[0]])

    def _number(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.accepted.append(tuple(sorted({s[0] for s in states if self._accepts(s)})))
            self.steps.append({})
        return self.ids[states]

    def step(self, at: int, word: bytes) -> int:
        """The state set after one more word; -1 if nothing is left."""
        known = self.steps[at].get(word)
        if known is not None:
            return known
        moved = set()
        for t, place, taken in self.sets[at]:
            if place == len(self.programs[t]):
                continue
            kind, *rest = self.programs[t][place]
            if kind == "word" and rest[0] == word:
                moved.update(self._closure((t, place + 1, 0)))
            elif kind == "var" and taken < rest[0] and (rest[1] is None or rest[1].fullmatch(word)):
                moved.update(self._closure((t, place, taken + 1)))
        result = self._number(frozenset(moved)) if moved else -1
        if self.held < MAX_CACHED_STEPS:
            self.steps[at][word] = result
            self.held += 1
        return result

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, stop, template): for each place and template that matches there, the longest match."""
        found = []
        first, start, accepted = self.first, self.start, self.accepted
        for i in [i for i, w in enumerate(words) if w in first]:
            at, longest = start, {}
            for j in range(i, len(words)):
                at = self.step(at, words[j])
                if at < 0:
                    break
                for t in accepted[at]:
                    longest[t] = j + 1
            found += [(i, stop, t) for t, stop in longest.items()]
        return found


_held: dict[tuple[Template, ...], Automaton] = {}


def _automaton(templates: tuple[Template, ...]) -> Automaton:
    if templates not in _held:
        _held.clear()
        _held[templates] = Automaton(templates)
    return _held[templates]


def words_of_license(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    return _WORD.findall(utf8(text).lower())


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per row.

    Base columns concern the templates marked base: all their places, the smallest and largest start, the labels.
    `labels` has those of all templates that match. `score` is the share of words inside any match. `matches` lists
    (template, label, start, stop) in words. All is done row by row in the scan's own stage, over whole texts.
    Null and empty texts have no words: counts 0, places null, labels empty, score 0. Null ids and repeated rows come
    out as they are; other columns are ignored; an empty table gives no rows.
    """
    _automaton(templates)  # refuses bad templates before any task runs
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def each(batch: pa.RecordBatch) -> dict:
        automaton, rows = _automaton(templates), []
        for t in batch.column("text").to_pylist():
            words = words_of_license(t)
            found = sorted(automaton.matches(words))
            base = [m for m in found if templates[m[2]].base]
            covered = end = 0
            for start, stop, _ in found:
                covered += max(0, stop - max(start, end))
                end = max(end, stop)
            rows.append((
                len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted({templates[m[2]].label for m in base})),
                ",".join(sorted({templates[m[2]].label for m in found})),
                covered / len(words) if words else 0.0,
                [{"template": templates[n].name, "label": templates[n].label, "start": a, "stop": b} for a, b, n in found],
            ))
        return {"doc_id": batch.column("doc_id"), **dict(zip(columns, map(list, zip(*rows))))}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_columns(
        rows, each,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<template: string, label: string, start: bigint, stop: bigint>>",
    )
