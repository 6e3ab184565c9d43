import random

import pytest

from swayrank.llm.quality import Rules, judge, line_first, line_fails, repeated_words

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("line,fails", [
    ("", False), ("  \t", False), ("A clean line of prose.", False), ("no mark here", True),
    ("Home", True), ("Read more.", True), ("He went home.", False), ("Read more about the house.", False),
    ("Copyright 2020. All Rights Reserved.", True), ("a | b | c.", True), ("One / two words, and a slash in a long line.", False),
    ("WIN!! MORE!! NOW!!", True), ("x$$$ y### z&&& w.", True), ("Is it? Yes! It is 5% more, A&B.", False),
    ("All rights reserved " + "word " * 30 + ".", False), ("日本語です。", False),
])
def test_line_rules(line, fails):
    assert line_fails(line, Rules()) is fails


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_repeated_words_match_a_plain_count():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 30))]
        assert repeated_words(words) == plain_repeats(words)


def test_documents_that_lose_too_much_are_rejected(spark):
    good = "\n".join(f"Line{i} a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(10))
    junk = "\n".join(f"menu{i} | link{i} | other{i} | more{i} | x{i}" for i in range(12))
    little = good + "\nHome | News\nAll rights reserved."
    rows = [(1, good), (2, good + "\n" + junk), (3, little), (4, None), (5, ""), (6, "short text."), (None, good), (1, good), (7, "a b c. " * 9000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "9 as kept", "8 as row", "7 as made", "6 as `a.b`")
    out = line_first(df)
    assert [c for c in out.columns[:5]] == ["doc_id", "text", "row", "made", "a.b"]
    found = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert found[1].kept and found[None].kept and not found[2].kept and not found[2].base_failed
    assert found[3].kept and found[3].cleaned == good and found[3].n_failed_lines == 2
    assert found[4].cleaned is None and found[4].base_failed and found[4].n_words == 0
    assert found[5].cleaned == "" and found[6].base_failed
    assert found[7].base_failed and found[7].n_repeat_words == 27000
    assert line_first(df.limit(0)).collect() == []


def test_measures():
    n_words, chars, symbols, dup, repeats, *_ = judge("é a|b #\n \né a|b #\né a|b #", Rules())
    assert (n_words, chars, symbols, dup, repeats) == (9, 15, 6, 2, 9)
