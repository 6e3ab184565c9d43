"""Scans that set bad lines aside, and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from swayrank.operators import sketches as skt
from swayrank.sources import tables as src
from swayrank.sources.checked import TooManyBadRows, read_checked

SCHEMA = src._schema(ID=src._LONG, name=src._STRING, value=src._DOUBLE)


def written(tmp_path, **files):
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_bad_lines_are_counted_and_kept_apart(spark, tmp_path):
    path = written(tmp_path, a=["name,ID,value,more", "x,1,2.5,q", "y,2,oops,q", "short,3", "z,4,,q"], b=["name,ID,value,more", "w,five,1.0,", "v,6,7.0,,extra"])
    checked = read_checked(spark, path, SCHEMA, origin=True)
    good = sorted((r.ID, r.name, r.value, r.origin_file[-5:]) for r in checked.good.collect())
    assert good == [(1, "x", 2.5, "a.csv"), (4, "z", None, "a.csv")]
    assert checked.good.columns == ["ID", "name", "value", "origin_file", "origin_modified"]
    bad = {(r.line, tuple(r.faults)) for r in checked.bad.collect()}
    assert bad == {
        ("y,2,oops,q", ("type of value",)), ("short,3", ("fields",)), ("w,five,1.0,", ("type of ID",)), ("v,6,7.0,,extra", ("fields",)),
    }
    counts = {(r.origin_file[-5:], r.fault): r.n for r in checked.counts().collect()}
    assert counts == {("a.csv", "type of value"): 1, ("a.csv", "fields"): 1, ("b.csv", "type of ID"): 1, ("b.csv", "fields"): 1}


def test_required_columns_and_limits(spark, tmp_path):
    path = written(tmp_path, a=["ID,name,value", "1,x,2.5", ",y,3.0"])
    assert read_checked(spark, path, SCHEMA).bad.count() == 0
    assert [r.faults for r in read_checked(spark, path, SCHEMA, required=("ID",)).bad.collect()] == [["no ID"]]
    with pytest.raises(TooManyBadRows, match="1 of 2"):
        read_checked(spark, path, SCHEMA, required=("ID",), max_bad_share=0.4)
    assert read_checked(spark, path, SCHEMA, required=("ID",), max_bad_share=0.5).good.count() == 1
    with pytest.raises(ValueError, match="no column absent"):
        read_checked(spark, path, src._schema(ID=src._LONG, absent=src._INT))


def test_good_rows_are_what_the_plain_scan_reads(spark, tmp_path):
    path = written(tmp_path, a=["ID,name,value", *[f"{i},n{i},{i / 7}" for i in range(50)]])
    plain = src.read_table(spark, f"{path}/a.csv", SCHEMA).collect()
    assert sorted(read_checked(spark, path, SCHEMA).good.collect()) == sorted(plain)


@pytest.mark.parametrize("k", [100, 400])
def test_merged_sketches_keep_their_rank_error(spark, k):
    draw = random.Random(k)
    values = [draw.gauss(0, 1) if i % 3 else 0.25 for i in range(20_000)]  # a third in one place
    rows = [(i % 7, v) for i, v in enumerate(values)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "day int, x double").repartition(5)
    days = skt.quantile_sketches(df, ["x"], by=["day"], k=k)
    assert {r.n for r in days.collect()} <= {len(values) // 7, len(values) // 7 + 1}
    merged = skt.merge_sketches(days, k=k)
    quantiles = {f"q{i}": i / 20 for i in range(1, 20)}
    row = skt.sketch_quantiles(merged, quantiles).first()
    assert merged.first()["n"] == len(values)
    error = 2 * skt.rank_error(k)  # for all 19 ranks at once
    for name, q in quantiles.items():
        below, upto = sum(v < row[name] for v in values) / len(values), sum(v <= row[name] for v in values) / len(values)
        assert below - error <= q <= upto + error
    size = merged.select(F.length("sketch")).first()[0]
    assert size < 40 * k
