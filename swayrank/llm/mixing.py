"""Mixing sources to target weights: hash-random order, prefix sums over key ranges, exact cuts.

Every row gets a key from a hash of its id. A source is cut into ranges of the key, as many as its table needs,
and sorted inside each; sums of whole ranges supply the offsets. No window holds more than one range of one
source, so a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayrank.functions.joins import attach_one_row, join_groups
from swayrank.llm.words import WORD_PATTERN
from swayrank.operators.order import ordered_index, running_totals
from swayrank.session import freeze

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
RANGE_ROWS = 20_000  # rows that share one range of the key, about


def word_count(text: str = "text") -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_key(column: str, seed: str) -> Column:
    """32 hex digits that look random; the same for equal ids. Rows without an id get them from their text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(column).cast("string"), F.concat(F.lit("null|"), F.xxhash64("text")))))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Per source: source_size, weight and target, from a table (source, size).

    Sources in code point order, null last, take the weights in turn. The targets add up to `share` of all sizes and
    are in proportion to the weights, but none is above `max_epochs` times its source; the excess is shared
    again until none is above. That is one level L with target = min(cap, weight x L): sources are ordered
    by cap / weight, and running totals give the first at which the demand covers the whole.
    """
    totals = freeze(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = ordered_index(totals, [F.col("source").asc_nulls_last()], out="place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = freeze(
        placed.select("source", "source_size", turn.cast("long").alias("weight"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    cells = running_totals(capped, "level", {"caps": F.sum("cap"), "weights": F.sum("weight")}, descending=False)
    wanted = attach_one_row(cells, capped.agg((F.sum("source_size") * F.lit(share)).alias("wanted")))
    demand = F.col("cum_caps") + F.col("level") * (F.col("all_weights") - F.col("cum_weights"))
    left = F.col("wanted") - (F.col("cum_caps") - F.col("caps"))
    open_weights = F.col("all_weights") - (F.col("cum_weights") - F.col("weights"))
    found = wanted.filter(demand >= F.col("wanted")).agg(F.min_by(left / open_weights, "level").alias("common"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("common"), F.col("cap").cast("double")))
    return attach_one_row(capped, found).select("source", "source_size", "weight", target.alias("target"))


def _measured(docs: DataFrame, seed: str) -> list[Column]:
    """doc_id, source, size, key and tag (a hash of the text) of a row."""
    return [
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count().alias("size"), hash_key("doc_id", seed).alias("key"), F.xxhash64("text").alias("tag"),
    ]


def _key_range(rows: int, range_rows: int) -> Column:
    """The range of the key that a row is in; there are as many as keep about `range_rows` rows in each."""
    return F.substring("key", 1, max(0, ceil(log(max(1, rows / range_rows), 16)))).alias("slice")


def _places(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and range: `start`, the words of the ranges before it, beside the source's target columns."""
    ranges = sized.groupBy("source", "slice").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "slice", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("start"))
    return freeze(join_groups(starts, targets, ["source"]))


def _epochs() -> tuple[Column, Column]:
    """Whole epochs of a source, and the words its target holds beyond them."""
    whole = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    return epochs, whole - epochs * F.col("source_size")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
    seed: str = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row.

    Size is the number of words (null text: 0). A source gives whole epochs while its target holds them, then its rows
    in key order up to the target's whole words; the row at the cut gives a part. So the taken words of a source
    are exactly its target rounded down, and no row gives more than `max_epochs` times its size. The outcome
    depends on ids, sizes, sources and, for null ids, texts only, not on partitions. Null sources are a source of their
    own; rows with equal ids go by size; repeated rows are rows like others, and ones with equal id, size and source
    swap freely. Other columns are ignored. Empty texts take nothing; an empty table gives no rows.
    """
    sized = freeze(docs.select(*_measured(docs, seed)).drop("tag"))
    sliced = sized.select("*", _key_range(sized.count(), range_rows))
    targets = source_targets(sized.select("source", "size"), weights, share, max_epochs)
    places = _places(sliced, targets)
    inside = (
        Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = join_groups(
        sliced.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))), places, ["source", "slice"], "left"
    )
    epochs, beyond = _epochs()
    part = F.greatest(F.lit(0), F.least(F.col("size"), beyond - F.col("start") - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


MAX_BROADCAST_SOURCES = 100_000


def source_cuts(sized: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per source: `epochs`, and the cut: `last` (key, size, tag), the `room` in words there, `same` rows that stand there.

    Rows before the cut give one epoch more, rows after it none more. `last` is null where the target holds whole epochs only.
    Equal rows are one cell before anything is ordered.
    """
    cells = sized.groupBy("source", "slice", "key", "size", "tag").agg(F.count("*").alias("same"))
    words = F.col("size") * F.col("same")
    inside = (
        Window.partitionBy("source", "slice").orderBy("key", "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = join_groups(
        cells.filter("size > 0").withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0))),
        _places(sized, targets), ["source", "slice"], "left",
    )
    epochs, beyond = _epochs()
    room = beyond - F.col("start") - F.col("before")
    place = F.when(room > 0, F.struct("key", "size", "tag"))
    last = F.max_by(F.struct(room.alias("room"), "same"), place)  # skips rows without a place
    found = placed.groupBy("source").agg(F.max(place).alias("last"), last.alias("at"), F.first(epochs).alias("epochs"))
    return found.select("source", "epochs", "last", F.col("at.room").alias("room"), F.col("at.same").alias("same"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
    seed: str = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; a part of a row is its first words joined by one space.

    The cut of each source is found on ids, sizes and text hashes, then meets the texts in their scan: one row a source,
    broadcast. Only rows equal in id and text to the one at a cut are numbered, which of them come first being open.
    Rows with null or empty texts are never taken; null ids and sources are mixed like others; very long texts are cut at
    a word like any; columns pass through, whatever their names; an empty table gives no rows. Reruns agree but for the
    other columns of such equal rows.
    """
    sized = freeze(docs.select(*_measured(docs, seed)))
    sized = sized.select("*", _key_range(sized.count(), range_rows))
    targets = source_targets(sized.select("source", "size"), weights, share, max_epochs)
    cuts = freeze(source_cuts(sized, targets, range_rows))
    few = cuts.count() <= MAX_BROADCAST_SOURCES
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_measured(docs, seed))
    known = join_groups(rows, F.broadcast(cuts) if few else cuts, ["source"])
    place = F.struct("key", "size", "tag")
    at_cut, several = F.coalesce(place == F.col("last"), F.lit(False)), F.coalesce(F.col("same") > 1, F.lit(False))

    def taken(more) -> Column:
        """Words a row gives, if it gives `more` beyond its epochs."""
        return F.col("epochs") * F.col("size") + more

    before = F.coalesce(place < F.col("last"), F.lit(False))
    more = F.when(before, F.col("size")).when(at_cut, F.col("room")).otherwise(0)
    plain = known.filter(~(at_cut & several)).select("_doc", "size", taken(more).alias("taken"))
    equal = freeze(known.filter(at_cut & several).select("_doc", "source", "size", "epochs", "room").withColumn("mark", F.monotonically_increasing_id()))
    numbered = ordered_index(equal, [F.col("mark")], by=["source"], out="place")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("place") * F.col("size")))
    given = plain.unionByName(numbered.select("_doc", "size", taken(rest).alias("taken"))).filter("taken > 0")

    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    repeated = given.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy_number"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy_number") - 1) * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(f"({WORD_PATTERN})")), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("size"), first).otherwise(F.col("_doc.text"))
    return repeated.select(*[text.alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])
