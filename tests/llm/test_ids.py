"""Ids of any size, beside null ids, come back as they are from every operator."""

import public_tokenizers
import pytest

from swayrank.llm import ann, licenses, mixing, packing, quality, sharding, simhash, substrings, tokens, warc

IDS = [(1 << 63) - 1, -(1 << 63), (1 << 53) + 1, (1 << 53) + 3, None]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "some words that are the same in every row of this small table " * 6


def documents(spark):
    return spark.createDataFrame([(i, TEXT, "s") for i in IDS], "doc_id long, text string, source string").coalesce(1)


OPERATORS = {
    "mixing": mixing.mix,
    "quality": quality.line_first,
    "sharding": lambda docs: sharding.place(docs, "doc_id", ["a", "b"]),
    "tokens": lambda docs: tokens.count_tokens(docs, VOCABULARY),
    "substrings": substrings.remove_repeats,
    "simhash": simhash.near_duplicates,
    "licenses": licenses.scan_licenses,
    "packing": lambda docs: packing.pack_documents(docs, VOCABULARY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back(spark, name):
    found = [r.doc_id for r in OPERATORS[name](documents(spark)).collect()]
    assert sorted(found, key=str) == sorted(IDS, key=str)


def test_components_are_exact(spark):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark)).collect()}
    assert found == {i: None if i is None else -(1 << 63) for i in IDS}
    docs = documents(spark).filter("doc_id > 0 or doc_id is null")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {(1 << 53) + 1, None}


def test_pages_and_what_they_refer_to(spark):
    pages = documents(spark).selectExpr("doc_id as page_id", "'u' as url", "text as html")
    found = {r.page_id: r.refers_to for r in warc.archive_pages(pages).collect()}
    least = -(1 << 63)
    assert found == {i: None if i == least else least for i in IDS}


def test_neighbours(spark):
    rows = [(i, [1.0, float(n)]) for n, i in enumerate(IDS)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(vectors, vectors).collect()}
    known = [i for i in IDS if i is not None]
    assert found == {(a, b) for a in known for b in known if a != b}


@pytest.mark.parametrize("name", ["mixing", "quality", "sharding", "tokens", "substrings", "licenses", "packing", "simhash"])
def test_clashing_names(spark, name, tmp_path):
    docs = documents(spark).selectExpr("*", "1 as `a.b`", "2 as Kept", "3 as Slot", "4 as row", "5 as tag", "6 as N_Words", "7 as fp")
    made = OPERATORS[name](docs)
    made.write.parquet(str(tmp_path / name))
    assert made.count() == len(IDS)


def test_near_duplicates_are_dropped_row_by_row(spark):
    other = " ".join(f"w{i}" for i in range(60))
    rows = [(1, TEXT, "a"), (1, other, "b"), (2, other, "c"), (3, TEXT, "d"), (1, TEXT, "e"), (None, TEXT, "f"), (4, None, "g"), (5, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept string").selectExpr("*", "1 as `a.b`")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, TEXT), (1, other), (None, TEXT), (4, None)], key=str)


def test_equal_rows_at_the_cut_of_a_mix(spark):
    rows = [(1, "x y z", "a", n) for n in range(40)] + [(2, "p q", "b", 0), (None, "r s t", "b", 1), (None, "r s u", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int").repartition(5)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    made = mixing.mixed_documents(docs).collect()
    words = {}
    for r in made:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == taken and all(docs.columns == list(r.asDict()) for r in made)
    times = {}
    for r in made:
        if r.source == "a":
            times[r["a.b"]] = times.get(r["a.b"], 0) + len(r.text.split())
    assert max(times.values()) <= 6 and len(times) == 40
