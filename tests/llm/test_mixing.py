import random

import pytest

from swayrank.llm.mixing import mix, mixed_documents, source_targets

SCHEMA = "doc_id long, source string, text string"


def corpus(seed, count=400):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "hot", "tiny"]
    return [
        (i, "hot" if rng.random() < 0.4 else rng.choice(names), " ".join(["w"] * rng.choice([0, 1, 5, 80])))
        for i in range(count)
    ]


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(target.values())
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("range_rows", [20_000, 10])
def test_targets_and_cuts(spark, seed, range_rows):
    rows = corpus(seed)
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    expected = plain_targets(sizes)
    found = mix(spark.createDataFrame(rows, SCHEMA), range_rows=range_rows).collect()
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source in sizes:
        assert expected[source] - 1.001 <= taken[source] <= expected[source] + 1e-6
    again = mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), range_rows=range_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_documents_come_as_often_as_taken(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mix(df).collect()}
    words = {}
    made = mixed_documents(df)
    assert made.columns == df.columns
    for r in made.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


def test_edge_cases(spark):
    rows = [(None, None, None), (1, "a", ""), (2, "a", "x y"), (2, "a", "x y"), (3, None, "z " * 20_000), (4, "b", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as slice", "3 as size", "4 as target", "5 as level")
    found = sorted(((r.doc_id, r.size, r.taken) for r in mix(df).collect()), key=str)
    assert [x[:2] for x in found] == [(1, 0), (2, 2), (2, 2), (3, 20_000), (4, 0), (None, 0)]
    assert sum(x[2] for x in found) in (30_005, 30_006)
    assert mix(df.limit(0)).collect() == [] and mixed_documents(df.limit(0)).collect() == []
    assert mixed_documents(df).columns == df.columns


def test_share_above_what_sources_hold(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    assert {r.source: r.target for r in source_targets(sizes, share=5.0).collect()} == {"a": 20.0, "b": 40.0}
