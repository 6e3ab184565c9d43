import random

import pytest
import xxhash

from swayrank.llm import simhash as sh
from swayrank.llm.components import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, shingle=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    width = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, max_bits=4):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= max_bits:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, f"{fp:016x}", least[root(a)]) for a, (i, fp) in enumerate(fps))


def texts(count, seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "béta", "gamma", "δ", "eps", "ZETA", "eta", "theta", "iota", "kappa"]
    rows = []
    for i in range(count):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split(" ")
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 20, 200])))))
    return rows


@pytest.mark.parametrize("bucket", [sh.BUCKET, 2])
def test_components_match_all_pairs(spark, bucket):
    rows = texts(150, 3)
    found = sh.near_duplicates(spark.createDataFrame(rows, SCHEMA), bucket=bucket)
    assert sorted(map(tuple, found.collect())) == plain_components(rows)


@pytest.mark.parametrize("max_bits", [3, 4])
@pytest.mark.parametrize("bucket", [1024, 1])
def test_links_connect_close_fingerprints(spark, max_bits, bucket):
    rng = random.Random(max_bits)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for fp in list(fps):
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(sh._signed(f) for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = dict(map(tuple, components(sh.close_links(nodes, len(fps), max_bits, bucket)).collect()))
    group = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if group[a] is not group[b] and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    assert {f: roots.get(f, f) for f in fps} == {f: min(group[f]) for f in fps}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "A b\tC d")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as fp", "1 as node", "2 as root")
    found = {(r.doc_id, r.component_id) for r in sh.near_duplicates(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4), (None, None)}
    assert sh.near_duplicates(df).count() == 7
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4]
    assert sh.near_duplicates(df.limit(0)).collect() == []
    assert sh.drop_near_duplicates(df.limit(0)).collect() == []


def test_long_text_uses_all_words():
    words = [f"w{i}" for i in range(sh.CHUNK + 100)]
    assert sh.fingerprint(" ".join(words), 4) == plain_fingerprint(" ".join(words))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(1, 201)}
    assert components(links.limit(0)).collect() == []
