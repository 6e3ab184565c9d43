import random
import re

import pytest

from swayrank.llm.licenses import BASE, TEMPLATES, Automaton, Template, scan_licenses, words_of_license

SCHEMA = "doc_id long, text string"


def plain_pattern(template):
    """The template as a regular expression over words that each end with a space."""
    out = []
    for i, piece in enumerate(re.split(r"<<(.*?)>>", template.markup, flags=re.S)):
        if i % 2 == 0:
            out += [re.escape(w) + " " for w in piece.split()]
        elif piece == "opt":
            out.append("(?:")
        elif piece == "end":
            out.append(")?")
        else:
            given = dict(x.split("=") for x in piece.split()[1:])
            out.append(f"(?:(?:{given.get('match', '[^ ]+')}) ){{0,{given['max']}}}")
    return re.compile("".join(out))


def plain_matches(words, templates):
    found = []
    for i in range(len(words)):
        rest = "".join(w + " " for w in words[i:])
        for n, t in enumerate(templates):
            ends = [
                j for j in range(i + 1, len(words) + 1)
                if plain_pattern(t).fullmatch("".join(w + " " for w in words[i:j]))
            ] if plain_pattern(t).match(rest) else []
            if ends:
                found.append((i, max(ends), n))
    return sorted(found)


SMALL = (
    Template("a", "a", "x <<opt>>y <<opt>>z<<end>> y<<end>> <<var max=2>> x"),
    Template("b", "b", "y <<var max=3 match=x|z>> y"),
    Template("c", "c", "<<opt>>x<<end>> z z"),
    Template("d", "d", "x x", True),
)


def test_automaton_equals_regular_expressions():
    rng = random.Random(2)
    automaton = Automaton(SMALL)
    for _ in range(400):
        words = rng.choices(["x", "y", "z", "w"], k=rng.randint(0, 12))
        assert sorted(automaton.matches([w.encode() for w in words])) == plain_matches(words, SMALL)


def test_real_templates_equal_regular_expressions():
    rng = random.Random(3)
    templates = BASE + TEMPLATES
    automaton = Automaton(templates)
    vocabulary = sorted({w for t in templates for w in re.sub(r"<<.*?>>", " ", t.markup).split()})
    for _ in range(60):
        words = []
        while len(words) < 60:
            t = rng.choice(templates)
            own = re.sub(r"<<.*?>>", " ", t.markup).split()[:40]
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            words += own + rng.choices(vocabulary, k=rng.randint(0, 3))
        words = words[:60]
        assert sorted(automaton.matches([w.encode() for w in words])) == plain_matches(words, templates)


@pytest.mark.parametrize("text,base,labels", [
    ("Released under the MIT License.", "mit", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc"),
    ("Licensed under CC BY 4.0.", "", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    ("GNU General Public License", "", ""),
    ("SPDX-License-Identifier: MIT", "", "mit"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License", "", "gpl-3"),
])
def test_known_wordings(spark, text, base, labels):
    row = scan_licenses(spark.createDataFrame([(1, "Én " + text + " Tail")], SCHEMA)).first()
    assert (row.base_labels, row.labels) == (base, labels)
    assert (row.score > 0) == bool(labels) and row.score <= 1


def test_counts_places_and_edge_cases(spark):
    twice = "under the MIT license, under-the mit LICENSE! cc by nc"
    rows = [(1, twice), (2, None), (3, ""), (None, twice), (1, twice), (4, "w " * 50_000 + "cc by nc"), (5, "\u212a Éa1 --")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_words", "2 as matches")
    found = scan_licenses(df)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1][1:7] == (11, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit") and got[1].score == 1.0
    assert got[None][1:] == got[1][1:]
    assert got[2][1:8] == got[3][1:8] == (0, 0, None, None, "", "", 0.0)
    assert got[4].first_word == 50_000 and got[4].n_words == 50_003
    assert words_of_license("\u212aK Éa1 --") == ["\u212ak".encode(), "Éa1".encode()]
    assert scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize("markup", ["<<opt>>x<<end>>", "<<var max=2>> x", "x <<opt>> y", "x <<end>>", "x <<what>>"])
def test_bad_markup_is_refused(markup):
    with pytest.raises(ValueError):
        Automaton((Template("bad", "bad", markup),))


BSD = """Copyright (c) 2020, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

{one}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{two}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """{three}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""


def test_whole_licences_are_told_apart(spark):
    """Two and three clauses, numbered or not; a changed word leaves only the grant."""
    two = BSD.format(one="1. ", two="2. ", third="", holder="OWNER")
    three = BSD.format(one="* ", two="* ", third=THIRD.format(three=""), holder="HOLDER")
    numbered = BSD.format(one="1. ", two="2. ", third=THIRD.format(three="3. "), holder="HOLDERS")
    changed = three.replace("EXEMPLARY", "EXPECTED")
    rows = list(enumerate([two, three, numbered, changed]))
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(4)] == ["bsd,bsd-2", "bsd,bsd-3", "bsd,bsd-3", "bsd"]
    assert min(found[i].score for i in range(3)) > 0.95 and found[3].score < 0.2
