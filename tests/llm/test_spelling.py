"""Spelling forms against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from swayrank.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{doc}:{run}".encode())
                if doc is not None and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def corpus(seed, letters, count):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(count)]
    for _ in range(count):
        w = list(rng.choice(words))
        kind, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(letters)]
        words.append("".join(w))
    return [(i, " ".join(rng.choices(words, weights=[1 + 300 // (k + 1) for k in range(len(words))], k=300))) for i in range(20)]


@pytest.mark.parametrize("seed,letters,count", [(1, "ab", 60), (2, "abcÀÿz", 150), (3, "thequicXYZé", 300)])
def test_forms_match_all_pairs(spark, seed, letters, count):
    rows = corpus(seed, letters, count)
    found = spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_every_kind_of_edit_at_every_place(spark):
    word = "abcdefghij"
    words = {word}
    for i in range(len(word) + 1):
        words |= {word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[:i] + "x" + word[i + 1 :], word[:i] + "xy" + word[i:]}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = {(r.word, r.near) for r in spelling.neighbours(df).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_long_words(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh", k=20_000))
    words = {base, base[:7] + "z" + base[8:], base[:15_000] + base[15_001:], base + "q", base[:10_000] + "zz" + base[10_000:], "a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = {(r.word, r.near) for r in spelling.neighbours(df).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_edge_cases(spark):
    big = (1 << 53) + 1
    rows = [(None, "hello hello hello hellos"), (1, None), (2, ""), (3, "Hello, HELLO; hellos hellos"), (big, "Ünder under under ünder ÜNDER"), (big, "under"), (big, "under")]
    rows += [(4, "same words again words")] * 3 + [(5, "\U0001F600 ×÷×÷× ×÷×÷× ×÷×÷×")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as `a.b`", "3 as N", "4 as node")
    assert sorted(map(tuple, spelling.spelling_forms(df).collect())) == plain(rows)
    assert spelling.spelling_forms(df.limit(0)).collect() == []
    assert spelling.spelling_forms(df.filter("doc_id = 2")).collect() == []


def test_chains_of_forms(spark):
    chain = ["words" + "abcdefghijklm"[:k] for k in range(13)]
    rows = [(None, " ".join([w] * (3 * 2**k))) for k, w in enumerate(chain)]
    found = spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.word, r.form, r.root) for r in found} == {(w, f, chain[-1]) for w, f in zip(chain, [*chain[1:], None])}
