"""Every stage and the whole pipeline against plain versions of the operators."""

import hashlib
import os
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from swayrank.llm.quality import Rules, judge
from test_mixing import plain_targets
from test_simhash import plain_components

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plain_quality(rows):
    judged = [(i, s, judge(t, Rules())) for i, s, t in rows]
    return [(i, s, j[9]) for i, s, j in judged if j[6]]


def plain_near_dedup(rows):
    kept = {c for _, _, c in plain_components([(i, t) for i, _, t in rows])}
    return [r for r in rows if r[0] in kept]


def plain_substrings(rows, window=50):
    first = {}
    words = {i: WORDS.findall(t or "") for i, _, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = []
    for i, source, text in rows:
        gone = set()
        for s in range(len(words[i]) - window + 1):
            if first[tuple(words[i][s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, source, " ".join(w for n, w in enumerate(words[i]) if n not in gone) if gone else text))
    return out


def plain_mix(rows):
    words = {i: WORDS.findall(t or "") for i, _, t in rows}
    sizes = {}
    for i, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words[i])
    out = []
    for source, target in plain_targets(sizes).items():
        left = int(target + 1e-9)
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: hashlib.md5(f"mix|{r[0]}".encode()).hexdigest())
        while left > 0:
            for i, _, text in mine:
                take = min(left, len(words[i]))
                if take:
                    out.append((i, source, text if take == len(words[i]) else " ".join(words[i][:take])))
                left -= take
    return out


PLAIN = [plain_quality, plain_near_dedup, plain_substrings, plain_mix]


def test_the_stages_are_the_given_ones():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "substring_dedup", "source_mix", "best_fit_packing"
    ]


@needs_tables
def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN):
        made = corpus_pipeline.freeze(stage(spark, docs, FOLDER))
        rows = plain(rows)
        assert made.dtypes == docs.dtypes, name
        assert sorted((r.doc_id, r.source, r.text) for r in made.collect()) == sorted(rows), name
        assert all(r.n_chars == len(r.text) for r in made.collect()), name
        docs = made
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    tokens = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, _, t in rows)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert sum(p.length for p in packed) == tokens
    full = {}
    for p in packed:
        full[p.sequence_id] = full.get(p.sequence_id, 0) + p.length
    assert max(full.values()) <= 1024 and len(full) <= 1.1 * tokens / 1024 + 1


def test_odd_documents_pass_through_every_stage(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}." for _ in range(n))
    long, other = text(30_000), text(80)
    rows = [(1, long, "a"), (1, long, "a"), (2, None, "a"), (3, "", None), (None, other, None), (4, other, "b"), (5, other, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as kept", "2 as size", "3 as owner")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").collect() == [], name
        docs_out = corpus_pipeline.freeze(stage(spark, docs, ""))
        assert docs_out.columns == docs.columns, name
        docs = docs_out
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {1, 4, None}
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() > 0
