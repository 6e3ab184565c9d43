import hashlib
from collections import Counter

import pytest

from swayrank.llm.sharding import fill_table, place

NAMES = [f"s{i}" for i in range(7)]


def plain_table(names, size):
    number = lambda name, salt: int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)
    orders = [
        [(number(n, "offset") % size + i * (number(n, "step") % (size - 1) + 1)) % size for i in range(size)] for n in names
    ]
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = shard
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("shards,size", [(1, 101), (7, 1009), (10, 1009)])
def test_turns_follow_the_orders(shards, size):
    assert fill_table([f"s{i}" for i in range(shards)], size) == plain_table([f"s{i}" for i in range(shards)], size)


def test_shares_are_even_and_changes_small():
    before, after = fill_table(NAMES, 10007), fill_table(NAMES[:-1], 10007)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    stay = [a == b for a, b in zip(before, after) if b != 6 and a != 6]
    assert sum(stay) > 0.8 * len(stay)


@pytest.mark.parametrize("names,size", [([], 101), (["a", "a"], 1009), (["a"], 100), (["a"] * 1, 97), (["a"], 10**9 + 7)])
def test_bad_tables_are_refused(names, size):
    with pytest.raises(ValueError):
        fill_table(names, size)


def test_placement_matches_the_table(spark):
    rows = [(i, "x") for i in range(3000)] + [(None, "y"), (5, "z"), (5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, slot string").selectExpr("*", "1 as shard", "2 as `_slot`", "3 as names")
    table = plain_table(NAMES, 1009)
    found = place(df, "doc_id", NAMES, 1009)
    assert found.columns == ["doc_id", "_slot", "names", "slot", "shard"]
    for r in found.collect():
        slot = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, NAMES[table[slot]])
    assert found.count() == len(rows)
    assert place(df.limit(0), "doc_id", NAMES, 1009).collect() == []


def test_nothing_is_shuffled(spark):
    plan = place(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
