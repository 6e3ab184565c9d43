"""Near duplicates by SimHash fingerprints, joined on shared blocks.

Fingerprints that differ in at most d of 64 bits agree on all but d of b blocks, so such a pair shares
one of the C(b, d) choices of b - d blocks. Fingerprints meet on those choices; inside a meeting the
Hamming distance is verified and a spanning set of links goes on, never all pairs. A choice shared by
more than `BUCKET` fingerprints is not compared pair by pair: its fingerprints meet on the points half
way between them (each fingerprint with up to d/2 bits flipped), which finds exactly the pairs within d
and whose groups are bounded by the geometry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.llm.components import components
from swayrank.llm.words import join_counted, map_columns, utf8
from swayrank.session import freeze

SEED = 42
BITS = 64
BUCKET = 1024  # fingerprints compared pair by pair
MEAN_BUCKET_BITS = 6  # blocks are chosen so that a random meeting holds 2^6 fingerprints at most
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of a text's lower-cased (A-Z) word shingles, repeats counted; 0 without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, fp longs) per row of `docs`; `tag` is a hash of the text. A null text has no words."""

    def each(batch: pa.RecordBatch) -> dict:
        made = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "fp": made}

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tag")
    )
    return map_columns(rows, each, "doc_id long, tag long, fp long")


def block_count(fingerprint_count: int, max_bits: int) -> int:
    """The fewest blocks for which a meeting of random fingerprints stays small."""
    wanted = log2(max(2, fingerprint_count)) - MEAN_BUCKET_BITS
    blocks = max_bits + 1
    while BITS * (blocks - max_bits) // blocks < wanted and comb(blocks + 1, max_bits) <= 4096:
        blocks += 1
    return blocks


def _masks(blocks: int, max_bits: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]


def _xor_masks(max_flips: int) -> list[int]:
    return [sum(1 << i for i in flips) for n in range(max_flips + 1) for flips in combinations(range(BITS), n)]


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(str(_signed(v)) for v in values) + "]"), "array<bigint>")


def _spanning(keys: np.ndarray, choice: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the first row of each cluster inside a meeting (chains of pairs within `max_bits`); rows come sorted."""
    n = len(fps)
    label = np.arange(n)
    left, right, shift = [], [], 1
    alive = np.arange(n - 1)
    while len(alive):
        alive = alive[alive + shift < n]
        alive = alive[(keys[alive] == keys[alive + shift]) & (choice[alive] == choice[alive + shift])]
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + shift]) <= max_bits]
        left.append(near)
        right.append(near + shift)
        shift += 1
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (old == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _links_in_order(max_bits: int):
    """Over rows sorted by (choice, key): verifies meeting by meeting; one meeting at most waits for the next batch."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held, size = None, [], 0

        def links(rows: np.ndarray) -> pd.DataFrame | None:
            a, b = _spanning(rows[1], rows[0], rows[2].view(np.uint64), max_bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}) if len(a) else None

        for frame in frames:
            held.append(frame[["choice", "key", "fp"]].to_numpy(np.int64).T)
            size += len(frame)
            if size < CHUNK:
                continue
            rows = np.concatenate(held if rest is None else [rest, *held], axis=1)
            held, size = [], 0
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = np.ascontiguousarray(rows[:, cut:])
            if cut and (made := links(np.ascontiguousarray(rows[:, :cut]))) is not None:
                yield made
        last = [x for x in (rest, *held) if x is not None]
        if last and (made := links(np.ascontiguousarray(np.concatenate(last, axis=1)))) is not None:
            yield made

    return each


def close_links(nodes: DataFrame, count: int, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct fingerprints `fp` of `nodes` that connect all within `max_bits` bits."""
    masks = _longs(_masks(block_count(count, max_bits), max_bits))
    meetings = nodes.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    crowded = meetings.groupBy("choice", "key").count().filter(F.col("count") > bucket).select("choice", "key")
    crowded = freeze(crowded)  # at most one row for every `bucket` meetings
    small = meetings.join(crowded, ["choice", "key"], "left_anti")
    links = (
        small.repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "fp")
        .mapInPandas(_links_in_order(max_bits), "a long, b long")
    )
    dense = meetings.join(crowded, ["choice", "key"], "left_semi").select("fp").distinct()
    # Two fingerprints within d bits have a point at most near bits from one and far bits from the other,
    # where near + far = d. All that is within far bits of a point is linked to the smallest within near
    # bits, so every link is d bits at most, and a point's group has no more members than there are flips.
    near, far = max_bits // 2, max_bits - max_bits // 2
    inner, outer = _longs(_xor_masks(near)), _longs(_xor_masks(far))
    points = dense.select("fp", F.explode(inner).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    )
    stars = points.groupBy("point").agg(F.min("fp").alias("b"))
    if near == far:
        dense_links = points.join(stars, "point").select(F.col("fp").alias("a"), "b")
    else:
        wider = dense.select("fp", F.explode(outer).alias("flip")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
        )
        dense_links = wider.join(stars, "point").select(F.col("fp").alias("a"), "b")
    return links.unionByName(dense_links.filter("a <> b").distinct())


def _named(docs: DataFrame, shingle: int, max_bits: int, doc_id: str, text: str, bucket: int) -> DataFrame:
    """(doc_id, tag, fp, root, component_id) per row; rows without an id have no component.

    `root` is a fingerprint that tells components apart; two may have the same smallest id if ids repeat.
    """
    table = freeze(fingerprints(docs, shingle, doc_id, text))
    nodes = freeze(
        table.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    )
    count = nodes.count()
    members = components(freeze(close_links(nodes, count, max_bits, bucket)))
    rooted = freeze(
        nodes.join(members, nodes["fp"] == members["node"], "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id", F.col("n").alias("copies"))
    )
    least = freeze(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    facts = freeze(join_counted(rooted, least, "root", count).select("fp", "root", "component_id", F.col("copies").alias("n")))
    total = facts.agg(F.sum("n")).first()[0] or 0
    known = join_counted(table.filter("doc_id is not null"), facts, "fp", total)
    return known.unionByName(table.filter("doc_id is null"), allowMissingColumns=True)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, doc_id: str = "doc_id", text: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits, and the smallest id reachable over close pairs.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other.
    Texts shorter than a shingle are one shingle. Rows with a null id take no part: their component is
    null. Rows that share an id are rows of their own: each is in the component of its text. Repeated rows are
    returned as often as they come. Other columns are ignored; an empty table gives no rows.
    """
    return _named(docs, shingle, max_bits, doc_id, text, bucket).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest id. Rows with a null id stay.

    Each row is judged by its own text, so rows that share an id but are not near duplicates all stay. Of rows of one
    component with the same smallest id, the one with the smallest fingerprint, then text hash, stays; of rows
    with the same id and text, the one whose columns have the smallest hash. Null, empty and wordless texts
    are near duplicates of each other; very long texts count whole; other columns pass through, whatever their
    names; an empty table gives no rows.

    Ids and text hashes decide, so texts are not moved when few documents go: the rows that go, and those that are
    repeated, are written first, and Spark sees their true size.
    """
    found = _named(docs, shingle, max_bits, "doc_id", "text", BUCKET).filter("doc_id is not null")
    one = F.struct("doc_id", "fp", "tag")
    found = freeze(found.groupBy("root", one.alias("one")).agg(F.count("*").alias("n")))
    least = freeze(found.groupBy("root").agg(F.min("one").alias("first"), F.count("*").alias("n")))
    judged = join_counted(found.withColumnRenamed("n", "times"), least, "root", found.count())
    key = [F.col("one.doc_id").alias("_gone_id"), F.col("one.tag").alias("_gone_tag")]
    gone = freeze(judged.filter("one <> first").select(*key))
    repeated = freeze(judged.filter("one = first and times > 1").select(*key))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        row.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tag")
    )
    same = (F.col("_id") == F.col("_gone_id")) & (F.col("_tag") == F.col("_gone_tag"))
    kept = rows.join(gone, same, "left_anti")
    once = kept.join(repeated, same, "left_anti").select("_row")
    hashed = [F.col(f"_row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = kept.join(repeated, same, "left_semi").groupBy("_id", "_tag").agg(F.min_by("_row", F.xxhash64(*hashed)).alias("_row"))
    return once.unionByName(first.select("_row")).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
