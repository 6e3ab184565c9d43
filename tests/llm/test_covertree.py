"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from swayrank.llm import covertree as ct

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, threshold=ct.THRESHOLD):
    def usable(i, v, g):
        return i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, v, g), (j, w, h) = rows[a], rows[b]
            if usable(i, v, g) and usable(j, w, h) and g == h and len(v) == len(w) and ct.cosine(np.array(v), np.array(w)) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, links[a], least.get(root(a)), i is not None and least[root(a)] == i) for a, (i, _, _) in enumerate(rows)), key=str)


def clustered(seed, count=260, dimension=8):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((6, dimension))
    for i in range(count):
        kind = rng.random()
        if kind < 0.3:
            v = centres[0] + rng.normal(0, 0.05, dimension)  # a third in one place
        elif kind < 0.7:
            v = centres[rng.integers(6)] + rng.normal(0, rng.choice([0.1, 0.3, 0.6]), dimension)
        else:
            v = rng.standard_normal(dimension)
        rows.append((int(i * 7919 % 1000), (v * rng.choice([1, 1e-200, 1e200])).tolist(), int(rng.integers(3)) if rng.random() < 0.5 else 1))
    rows += [(2000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # exact copies
    return rows


@pytest.mark.parametrize("seed,chunk,sample,depth", [(1, ct.CHUNK, ct.SAMPLE, ct.MAX_DEPTH), (2, 20, 16, 8), (3, 7, 5, 2), (4, 12, 1, 3)])
def test_links_match_all_pairs(spark, seed, chunk, sample, depth):
    rows = clustered(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = ct.near_vectors(df, chunk=chunk, sample=sample, max_depth=depth).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_edge_cases(spark):
    nan, inf, big = float("nan"), float("inf"), (1 << 53) + 1
    rows = [
        (5, [1.0, 0.0], 1), (big, [1.0, 0.1], 1), (big + 1, [2.0, 0.0], 1), (5, [0.0, 3.0], 1), (7, [0.0, 3.0], 1), (None, [1.0, 0.0], 1),
        (8, None, 1), (9, [], 1), (10, [0.0, 0.0], 1), (11, [1.0, nan], 1), (12, [inf, 1.0], 1), (13, [None, 1.0], 1), (14, [1.0, 0.0, 0.0], 1),
        (15, [1.0, 0.0], None), (16, [1.0, 0.0], 2), (3, [1.0, 0.0], 3), (3, [1.0, 0.0], 3), (-4, [1e308, 1e308], 1), (-5, [1e-308, 1e-308], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as `a.b`", "3 as Node", "4 as v").repartition(3)
    assert sorted(map(tuple, ct.near_vectors(df).collect()), key=str) == plain(rows)
    assert ct.near_vectors(df.limit(0)).collect() == []
    assert ct.near_vectors(df.filter("vec_id = 8")).collect() == [(8, 0, 8, True)]


def test_without_labels(spark):
    rows = [(i, v, None) for i, v, _ in clustered(5, 60)]
    found = ct.near_vectors(spark.createDataFrame(rows, SCHEMA), label=None, chunk=20, sample=8).collect()
    assert sorted(map(tuple, found), key=str) == plain([(i, v, 0) for i, v, _ in rows])


def test_far_and_copied_nodes_are_not_looked_into():
    """Most pairs are decided by the bounds of nodes."""
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    vectors = np.concatenate([c + rng.normal(0, 0.01, (64, 16)) for c in centres])
    tree = ct.Tree.of(np.arange(1024), vectors, ct.reach_of(0.93))
    asked, plain_dots = [], ct._dots
    try:
        ct._dots = lambda a, b, x, y: asked.append(len(x)) or plain_dots(a, b, x, y)
        kinds, x, y = ct.traverse(tree, tree, 0.93)
    finally:
        ct._dots = plain_dots
    assert sum(asked) < 5_000 and (y[kinds == 0] == 63).all() and (kinds == 1).sum() == 1024 - 16


def test_a_tree_keeps_its_bytes():
    rng = np.random.default_rng(1)
    tree = ct.Tree.of(np.arange(50), rng.standard_normal((50, 5)), 0.4)
    again = ct.Tree.from_bytes(tree.to_bytes())
    assert (again.vectors == tree.vectors).all() and len(again.levels) == len(tree.levels)
    for starts, ends, radii in tree.levels:
        for s, e, r in zip(starts, ends, radii):
            assert ct.distances(tree.units[s:e] @ tree.units[s]).max() <= r + 1e-7
