"""Token alignment against all pairs of byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from swayrank.llm import alignment

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

TEXTS = [
    "The quick brown fox, jumping over Lazy dogs.", "", None, " ", "  two  spaces and\n\nlines \t tab ", "naïve café — 中文字符 🙂🙂", "a" * 300,
    "special <|endoftext|> and <s> </s> <unk> <0x41> in a text", "one ▁ block", "▁", "x\u0000y", " wide space ​", "x",
    "The quick brown fox, jumping over Lazy dogs.", "don't we'll THEY'RE 12345 67,890.12 $%^&*", "word " * 50, "ẛ̣ ﬁ é", "\x1c \x85 \r\n\r\n x",
]


def plain(texts):
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        made = []
        if t:
            encoded = first.encode(" " + t, add_special_tokens=False)
            made.append([(i, bytes(symbols[c] for c in s)) for i, s in zip(encoded.ids, encoded.tokens)])
            ids = second.encode(t)
            names = [second.id_to_piece(i) for i in ids]
            made.append([(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, names)])
        if not t or any(b"".join(b for _, b in side) != whole for side in made):
            made = [[], []]
        spans = []
        for side in made:
            at, out = 0, []
            for i, b in side:
                out.append((i, at, at + len(b)))
                at += len(b)
            spans.append(out)
        links = [(a[0], b[0]) for a in spans[0] for b in spans[1] if max(a[1], b[1]) < min(a[2], b[2])]
        ends = sorted({a[2] for a in spans[0]} & {b[2] for b in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if begin <= x[1] and x[2] <= end) for side in spans))
            begin = end
        docs.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
    total = Counter(link for d in docs for link in d[3])
    most = {}
    for (_, b), n in total.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (a, b, g, len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if links else "", groups)
        for a, b, g, links, groups in docs
    ]


@pytest.mark.parametrize("hot_pairs,step", [(alignment.HOT_PAIRS, alignment.STEP_BYTES), (20, 30), (0, 1)])
def test_alignment_matches_all_pairs(spark, hot_pairs, step):
    big = (1 << 53) + 1
    rows = [(None if n == 4 else big + n, t) for n, t in enumerate(TEXTS)] + [(big, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as pairs", "3 as `a.b`", "4 as N").repartition(3)
    found = alignment.align_tokens(docs, FIRST, SECOND, keep_groups=True, hot_pairs=hot_pairs, step_bytes=step).collect()
    expected = plain([t for _, t in rows])
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, *e)) for (i, _), e in zip(rows, expected))


def test_units_do_not_change_tokens(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    docs = spark.createDataFrame(rows)
    found = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokens(docs, FIRST, SECOND).collect()}
    assert found == {r.doc_id: e[:7] for r, e in zip(rows, plain([r.text for r in rows]))}


def test_no_documents(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND).collect() == []


def test_units_are_encoded_together():
    with open(FIRST, encoding="utf-8") as vocabulary, open(SECOND, "rb") as pieces:
        sides = alignment.Sides(vocabulary.read(), pieces.read())
    asked, library = [], sides.first

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    sides.first = Counting()
    units = [f"w{n}." for n in range(1000)] + ["▁", " x", "x ", "a\nb", "é", "<s>", "x\u0000y", "'s", "\u0301", "<|endoftext|>"]
    together = sides._encode(units)
    assert sum(asked) < len(units) / 3
    assert together == [sides._encode([u])[0] for u in units]
    assert None in together


def test_texts_without_tokens():
    with open(FIRST, encoding="utf-8") as vocabulary, open(SECOND, "rb") as pieces:
        sides = alignment.Sides(vocabulary.read(), pieces.read())
    for texts in ([], [None], ["", None, "▁"], ["▁", "x", None]):
        counts, groups, text, pairs = sides.gather(texts)
        assert [c.tolist() for c in counts] == [[int(t == "x") for t in texts]] * 3
        assert len(groups) == len(texts) and text.tolist() == [n for n, t in enumerate(texts) if t == "x"] and len(pairs) == len(text)
