import hashlib
import random
import re

import pytest

from swayrank.llm.substrings import Contexts, remove_repeats
from swayrank.llm.words import run_hashes, sliding_min

import numpy as np
import pandas as pd

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, window, **options):
    found = remove_repeats(df, window, **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, count=60, window=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)] + ["And", "x\x85y", "\xa0z"]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    passages = [fresh(rng.randint(window - 2, 4 * window)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(count), count):
        words = fresh(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            if kind < 0.5:
                words += rng.choice(passages)
            elif kind < 0.7 and rows:
                words += rng.choice(rows)[1].split()[rng.randint(0, 5) :]
            elif kind < 0.85:
                words += ["And"] * rng.randint(1, 4 * window)
            words += fresh(rng.randint(0, window))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + rows[:3]


@pytest.mark.parametrize("seed,options", [
    (1, {}), (2, {"shard_chars": 200, "stream_chars": 500}), (3, {"shard_chars": 10**6, "stream_chars": 300}),
])
def test_matches_all_windows(spark, seed, options):
    rows = corpus(seed)
    assert result(spark.createDataFrame(rows, SCHEMA), 12, phrase=3, **options) == plain(rows, 12)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (5, "a b"), (0, "b " + long[:5000]), (4, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, 50) == plain(rows, 50)
    wide = df.selectExpr("*", "1 as covered", "2 as copy", "3 as tag", "4 as _span_id", "5 as n_words", "doc_id as start")
    out = remove_repeats(wide, 50)
    assert set(out.columns) == {*wide.columns, "n_removed", "kept_sha256"}
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id != 4}
    assert texts[1] is None and texts[2] == "" and texts[5] == "a b" and texts[None] == long
    assert remove_repeats(df.limit(0), 50).collect() == []


def test_words_decide_where_hashes_would_agree():
    """Only the words of passages matter: a text with one word changed loses what is left of it, and no more."""
    words = [b"w%d" % (i % 17) for i in range(60)]
    contexts = Contexts(pd.DataFrame({"doc_id": [5], "words": [b" ".join(words)]}), 10)
    assert list(contexts.covered(b" ".join(words), 6)) == [(0, 60)]
    assert list(contexts.covered(b" ".join(words), 5)) == []
    other = words[:20] + [b"x"] + words[21:29] + [b"y"] + words[30:]
    assert list(contexts.covered(b" ".join([b"a", *other, b"b"]), 6)) == [(1, 21), (31, 61)]
    same = [b"the"] * 5000
    contexts = Contexts(pd.DataFrame({"doc_id": [5, 3], "words": [b" ".join(same), b" ".join(same[:30])]}), 10)
    assert len(contexts.firsts) < 10 and list(contexts.covered(b" ".join(same), 4)) == [(0, 5000)]


def test_run_hashes_depend_on_words_and_order():
    h = np.arange(100, dtype=np.uint64)
    twice = np.concatenate((h, h))
    for length in (1, 2, 3, 10, 50):
        made = run_hashes(twice, length)
        assert len(made) == 201 - length and (made[: 101 - length] == made[100 : 201 - length]).all()
        assert len(set(made[: 101 - length].tolist())) == 101 - length
    assert len(run_hashes(h[:3], 4)) == 0
    assert run_hashes(h[[1, 0]], 2)[0] != run_hashes(h[:2], 2)[0]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 41])
def test_sliding_min(width):
    values = np.random.default_rng(width).integers(0, 50, 100).astype(np.uint64)
    assert sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(101 - width)]
