import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swayrank.llm import bpe
from swayrank.llm.packing import BestFit, best_fit, pack_documents, sequences, token_pieces
from swayrank.llm.tokens import count_tokens

SCHEMA = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", " ", "  ", " a", "a ", "a  b", "\n\n", "a\n b", " \n a", "a \x1c b", "x\x85 y", "　 q  r", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|>", "it's we'LL don't", "a​b ﻿", "日本語 テキスト", "🙂🙂 🙂", "é ñ ß", "1234 5,678",
    "\x00\x01 \x7f", "a" * 3000, "ab" * 1500 + " " * 300, "\t\tx", "tail \n", "a᠎b c  d",
]


def random_text(rng):
    alphabet = "abcdeABC   \n\t'.,!12\x1c\x85\xa0 éßñ日🙂́"
    return "".join(rng.choices(alphabet, k=rng.randint(0, 120)))


def test_counts_equal_the_library(spark):
    rng = random.Random(5)
    rows = list(enumerate(ODD + [random_text(rng) for _ in range(400)] + [None]))
    found = {r.doc_id: r for r in count_tokens(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    for i, text in rows:
        n = len(library_ids(text))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 512), repr(text)


def test_cache_forgets_and_stays_right(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_UNITS", 3)
    with open(PATH, encoding="utf-8") as file:
        held = bpe.Vocabulary(file.read())
    text = "one two three four five one two\n three"
    assert held.count(text) == len(library_ids(text))
    assert np.frombuffer(held.ids(text), "<u4").tolist() == library_ids(text)
    assert len(held.counts) <= 3


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.load_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))


def test_count_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], SCHEMA).selectExpr("*", "7 as n_tokens", "'x' as n_bytes")
    assert sorted(map(tuple, count_tokens(df, PATH).collect()), key=str) == [(1, 3, 2, False)] * 2 + [(None, 0, 0, False)]
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_pieces_restore_the_ids(spark):
    rng = random.Random(6)
    rows = list(enumerate(ODD + [" ".join(random_text(rng) for _ in range(12)) for _ in range(30)] + [None]))
    pieces = token_pieces(spark.createDataFrame(rows, SCHEMA), PATH, 100, keep_ids=True)
    packed = best_fit(pieces, 100, task_tokens=2000).collect()
    for i, text in rows:
        mine = sorted((p for p in packed if p.doc_id == i), key=lambda p: p.piece)
        ids = library_ids(text) + [2]
        at = 0
        for n, p in enumerate(mine):
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert (p.piece, p.start, p.ids_crc32, bytes(p.ids)) == (n, at, zlib.crc32(part), part)
            assert p.length == 100 or n == 0
            at += p.length
        assert at == len(ids)


def test_sequences_are_gapless_and_full(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(600)]
    packed = pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, 256).collect()
    bins = {}
    for p in packed:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(p.length for p in packed)
    assert len(bins) <= 1.05 * total / 256 + 2


def plain_best_fit(lengths, capacity, open_bins):
    bins, placed, made = [], [], 0
    for x in lengths:
        fitting = [b for b in bins if b[1] >= x]
        if fitting:
            chosen = min(fitting, key=lambda b: b[1])
            free = chosen[1]
            bins.remove(chosen)
        else:
            chosen, free, made = (made, capacity), capacity, made + 1
        placed.append(capacity - free)
        if free > x:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
            bins.append((chosen[0], free - x))
    return placed, made


@pytest.mark.parametrize("open_bins", [1, 4, 1000])
def test_best_fit_chooses_the_tightest_open_bin(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    fit = BestFit(50, open_bins)
    placed = [fit.place(x)[1] for x in lengths]
    assert (placed, fit.made) == plain_best_fit(lengths, 50, open_bins)


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b")], SCHEMA)
    df = df.selectExpr("*", "'c' as offset", "3 as length", "4 as piece")
    packed = pack_documents(df, PATH)
    assert sorted((r.doc_id or 0, r.length) for r in packed.collect()) == [(0, 1), (1, 1), (2, 3), (2, 3)]
    assert packed.select("sequence_id").distinct().count() == 1
    assert pack_documents(df.limit(0), PATH).collect() == []
    whole = sequences(best_fit(token_pieces(df, PATH, keep_ids=True))).collect()
    assert len(whole) == 1 and whole[0].n_tokens == 8 and len(whole[0].ids) == 32


def held_vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def test_easy_pre_tokens_are_put_together_without_the_library():
    easy = ["One.\nTwo, three!!! 4th äpfer###.\nÜber (x) a.b", "...\nA 12.5% of <b>it</b>", "\nstart", "end.\n"]
    other = [
        "naïve×2.\nx", "it's we'll 'quoted'.\nx", "a \nb", "a\n\nb", "a\n b\t c.\r\nd", "日本.\nword", "<|endoftext|>.\nx", "x.<|endoftext|>",
        "ª.\nª", "ß١٢.\n½", "a" * 70 + ".\n" + "b" * 70, "e\u0301.\ne", "_a_ __b\n_",
    ]
    rng = random.Random(8)
    other += ["".join(rng.choices("abAé.,!_$\n 12'\xa0", k=60)) for _ in range(500)]
    held = held_vocabulary()
    for text in easy + other + easy:
        assert np.frombuffer(held.ids(text), "<u4").tolist() == library_ids(text), repr(text)
    held = held_vocabulary()
    held.tokenizer = None
    for text in easy:
        assert np.frombuffer(held.ids(text), "<u4").tolist() == library_ids(text), repr(text)


def test_pieces_are_forgotten_once_many_are_held(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    held = held_vocabulary()
    for text in ("One.\nTwo", "Three!!\nFour", "One.\nTwo"):
        assert np.frombuffer(held.ids(text), "<u4").tolist() == library_ids(text)
        assert len(held.pieces) <= 2
