"""Pairs of vectors above a cosine threshold, by dual traversal of cover trees.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the threshold is a largest distance. Vectors with one label are covered
by nested levels of nodes; a node has a centre, and the largest distance of its vectors to it is its covering radius.
Two nodes are at least (distance of centres - radii) and at most (distance + radii) apart: pairs of nodes beyond the
threshold are dropped, pairs wholly within it are counted without looking inside, others give way to the pairs of their children.
What is left at the bottom is decided by the cosine itself.

The upper levels are tables. A node with more than `CHUNK` vectors is split around centres taken from a bounded sample of it,
farthest first, down to half its radius; every vector goes to its nearest centre, and radii come from all of them, so the
sample steers the balance only. Nodes small enough are chunks: their lower levels, with halving radii, are built in one
task, and two chunks that the tables leave undecided meet in one task. A node of copies is never taken apart; copies beyond a chunk are
dealt to several.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.llm.components import components
from swayrank.llm.words import arrow_schema, join_counted, record_batch
from swayrank.session import freeze

THRESHOLD = 0.93
CHUNK = 2048  # vectors whose lower levels are built together
SAMPLE = 512  # vectors of a node that its children's centres are taken from, about
MAX_CHILDREN = 64
MAX_DEPTH = 8  # of the upper levels; larger nodes are dealt to chunks as they are
SLACK = 1e-6  # above rounding of distances; what a bound misses by it is decided by the cosine
LEAST_RADIUS = 1 / 8  # of the threshold's distance: the lowest level of a chunk
DENSE = 0.05  # share of centre pairs above which all of them are multiplied
GATHER = 1 << 18


def reach_of(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return math.sqrt(2 - 2 * threshold)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine with sums that are rounded once."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def distances(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class Tree:
    """The levels of a chunk. Vectors are reordered so that a node is a range of them; the first is its centre."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.rows, self.vectors, self.levels = rows, vectors, levels
        self.units = unit(vectors)

    @classmethod
    def of(cls, rows: np.ndarray, vectors: np.ndarray, reach: float) -> Tree:
        """Levels with radii 2, 1, 1/2, ...: a node's children are its centre and, in turn, the first vector not yet covered."""
        units = unit(vectors)
        apart = distances(units @ units.T)
        nodes, levels, radius = [np.arange(len(rows))], [], 2.0
        while True:
            levels.append(([len(n) for n in nodes], [float(apart[n[0], n].max()) for n in nodes]))
            radius /= 2
            if radius < reach * LEAST_RADIUS or len(nodes) == len(rows):
                break
            finer = []
            for node in nodes:
                while len(node):
                    near = apart[node[0], node] <= radius
                    finer.append(node[near])
                    node = node[~near]
            nodes = finer
        order = np.concatenate(nodes)
        made = []
        for sizes, radii in levels:
            ends = np.cumsum(sizes)
            made.append((ends - sizes, ends, np.array(radii)))
        return cls(rows[order], vectors[order], made)

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, self.rows, self.vectors, *[part for level in self.levels for part in level])
        return file.getvalue()

    @classmethod
    def from_bytes(cls, content: bytes) -> Tree:
        rows, vectors, *rest = np.load(io.BytesIO(content), allow_pickle=False).values()
        return cls(rows, vectors, [tuple(rest[i : i + 3]) for i in range(0, len(rest), 3)])

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of a level, the range of its children in the next."""
        starts, ends, _ = self.levels[level]
        below = self.levels[level + 1][0]
        return np.searchsorted(below, starts), np.searchsorted(below, ends)


def _product(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs out of two ranges, for many pairs of ranges."""
    na, nb = first[1] - first[0], second[1] - second[0]
    sizes = na * nb
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return first[0][which] + place // nb[which], second[0][which] + place % nb[which]


def _dots(a: Tree, b: Tree, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of pairs of unit vectors."""
    if not len(left):
        return np.empty(0)
    ua, ia = np.unique(left, return_inverse=True)
    ub, ib = np.unique(right, return_inverse=True)
    if len(left) > DENSE * len(ua) * len(ub):
        return (a.units[ua] @ b.units[ub].T)[ia, ib]
    parts = range(0, len(left), GATHER)
    return np.concatenate([np.einsum("ij,ij->i", a.units[left[i : i + GATHER]], b.units[right[i : i + GATHER]]) for i in parts])


class Links:
    """Counts and a spanning set of the links found between two chunks, or inside one."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.same = a, b, a is b
        self.first = 0 if self.same else len(a.rows)  # place of b's vectors after a's
        self.added = np.zeros(self.first + len(b.rows) + 1, np.int64)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def _range(self, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> None:
        np.add.at(self.added, starts, times)
        np.add.at(self.added, ends, -times)

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)

    def whole(self, la: tuple, lb: tuple, na: np.ndarray, nb: np.ndarray) -> None:
        """All vectors of nodes `na` are linked to all of `nb`; inside a node, to all others."""
        starts, ends = (la[0][na], lb[0][nb] + self.first), (la[1][na], lb[1][nb] + self.first)
        own = (na == nb) & self.same
        sizes = [e - s for s, e in zip(starts, ends)]
        self._range(starts[0], ends[0], sizes[1] - own)
        self._range(starts[1][~own], ends[1][~own], sizes[0][~own])
        self._link(starts[0], starts[1])
        for s, e in zip(starts, ends):
            _, once = np.unique(s * (len(self.added) + 1) + e, return_index=True)
            inside, first = _product((s[once], e[once]), (s[once], s[once] + 1))
            self._link(first, inside)

    def single(self, left: np.ndarray, right: np.ndarray) -> None:
        right = right + self.first
        np.add.at(self.added, left, 1)
        np.add.at(self.added, left + 1, -1)
        np.add.at(self.added, right, 1)
        np.add.at(self.added, right + 1, -1)
        self._link(left, right)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, x, y): 0 for the number y of links of row x, 1 for a link of rows x and y that spans others."""
        rows = self.a.rows if self.same else np.concatenate((self.a.rows, self.b.rows))
        counts = np.cumsum(self.added)[:-1]
        some = np.flatnonzero(counts)
        label = np.arange(len(rows))
        left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.left, self.right))
        while len(left):
            low = np.minimum(label[left], label[right])
            old = label.copy()
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            label = label[label]
            if (old == label).all():
                break
        moved = np.flatnonzero(label != np.arange(len(rows)))
        kinds = np.repeat([0, 1], [len(some), len(moved)])
        return kinds, np.concatenate((rows[some], rows[moved])), np.concatenate((counts[some], rows[label[moved]]))


def traverse(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links between two chunks, or inside one if they are the same object, found level by level."""
    reach, links = reach_of(threshold), Links(a, b)
    deepest = [len(t.levels) - 1 for t in (a, b)]
    na = nb = np.zeros(1, np.int64)
    level = [0, 0]
    while len(na):
        la, lb = a.levels[level[0]], b.levels[level[1]]
        far = distances(_dots(a, b, la[0][na], lb[0][nb]))
        radii = la[2][na] + lb[2][nb]
        own = (na == nb) & links.same
        near = far - radii <= reach + SLACK
        lone = (la[1] - la[0])[na] * (lb[1] - lb[0])[nb] == 1
        whole = near & (far + radii <= reach - SLACK) & ~(own & lone)
        links.whole(la, lb, na[whole], nb[whole])
        near &= ~whole & ~(own & lone)
        if level == deepest:
            na, nb, own = na[near], nb[near], own[near]
            left, right = _product((la[0][na], la[1][na]), (lb[0][nb], lb[1][nb]))
            if links.same:
                inside = np.repeat(own, (la[1] - la[0])[na] * (lb[1] - lb[0])[nb])
                keep = ~inside | (left < right)
                left, right = left[keep], right[keep]
            dots = _dots(a, b, left, right)
            close = dots >= threshold
            for i in np.flatnonzero(np.abs(dots - threshold) < SLACK * SLACK):
                close[i] = cosine(a.vectors[left[i]], b.vectors[right[i]]) >= threshold
            links.single(left[close], right[close])
            break
        na, nb = na[near], nb[near]
        ranges = []
        for side, (tree, nodes) in enumerate(((a, na), (b, nb))):
            if level[side] == deepest[side]:
                ranges.append((nodes, nodes + 1))
            else:
                starts, ends = tree.children(level[side])
                ranges.append((starts[nodes], ends[nodes]))
        inside = np.repeat((na == nb) & links.same, (ranges[0][1] - ranges[0][0]) * (ranges[1][1] - ranges[1][0]))
        na, nb = _product(*ranges)
        keep = ~inside | (na <= nb)
        na, nb = na[keep], nb[keep]
        level = [min(x + 1, d) for x, d in zip(level, deepest)]
    return links.result()


# ---- the upper levels, as tables ----

def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, and finite throughout."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def _matrix(cells) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in cells])


def farthest_first(units: np.ndarray, most: int) -> np.ndarray:
    """Rows of up to `most` centres, each the farthest from those before, until half the first one's radius covers all."""
    chosen = [0]
    gap = distances(units @ units[0])
    stop = gap.max() / 2
    while len(chosen) < most and gap.max() > stop:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(units @ units[chosen[-1]]))
    return np.array(chosen)


def _split(points: DataFrame, large: DataFrame, chunk: int, sample: int) -> DataFrame:
    """The vectors of `large` nodes (node, n), each in the child of its node whose centre is nearest.

    Centres travel to where the vectors of their node are: a node is dealt to as many tasks as it needs, and each of them reads
    the centres before the vectors.
    """
    mine = points.join(large, "node")
    chance = F.pmod(F.xxhash64("row", "node"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n")

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        vectors = _matrix(frame["v"])
        most = int(min(MAX_CHILDREN, -(-2 * frame["n"].iloc[0] // chunk)))
        chosen = vectors[farthest_first(unit(vectors), max(2, most))]
        return pd.DataFrame({"node": frame["node"].iloc[:1], "n": frame["n"].iloc[:1], "v": [chosen.ravel().tolist()]})

    found = freeze(mine.filter(chance).groupBy("node").applyInPandas(centres, "node string, n long, v array<double>"))
    tasks = F.ceil(F.col("n") / F.lit(8 * chunk)).cast("long")
    heads = found.select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("part"), F.lit(None).cast("long").alias("row"), "v"
    )
    sampled = mine.join(found.select("node"), "node", "left_semi")  # a sample may be empty: such a node waits for the next level
    members = sampled.select("node", F.pmod(F.xxhash64("row"), tasks).alias("part"), "row", "v")
    target = arrow_schema("row long, node string, v array<double>")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, heads = None, None
        for batch in batches:
            frame = batch.to_pandas()
            names, rows = batch.column("node").to_pylist(), batch.column("row").to_pylist()
            if not rows:
                continue
            places, begin = list(names), 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[begin] and rows[i] is not None:
                    continue
                if rows[begin] is None:
                    node, heads, begin = names[begin], frame["v"].iloc[begin], begin + 1
                if begin < i:
                    vectors = unit(_matrix(frame["v"].iloc[begin:i]))
                    nearest = (vectors @ unit(np.asarray(heads).reshape(-1, vectors.shape[1])).T).argmax(axis=1)
                    places[begin:i] = [f"{node}/{k}" for k in nearest.tolist()]
                begin = i
            kept = pa.array([r is not None for r in rows])
            made = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(places), batch.column("v")], names=["row", "node", "v"]).filter(kept)
            yield record_batch({c: made.column(c) for c in target.names}, target)

    together = heads.unionByName(members).repartition("node", "part").sortWithinPartitions("node", "part", F.col("row").asc_nulls_first())
    split = together.mapInArrow(each, "row long, node string, v array<double>")
    return split.unionByName(mine.join(found.select("node"), "node", "left_anti").select("row", "node", "v"))


def chunked(points: DataFrame, chunk: int, sample: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """`points` (row, node, v) with the chunk each is in as `node`."""
    done, current = [], points
    for depth in range(max_depth + 1):
        sizes = freeze(current.groupBy("node").agg(F.count("*").alias("n")))
        large = freeze(sizes.filter(F.col("n") > chunk))
        if not large.head(1):
            break
        done.append(current.join(large, "node", "left_anti").select("row", "node", "v"))
        if depth < max_depth:
            current = freeze(_split(current, large, chunk, sample))
        else:
            piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / chunk))
            current = current.join(large, "node").select("row", F.concat("node", F.lit("/"), piece.cast("string")).alias("node"), "v")
    for part in done:
        current = current.unionByName(part)
    return current


def _apart(x: str, y: str) -> Column:
    """The distance of two unit vectors in columns."""
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


def build_chunks(points: DataFrame, reach: float) -> DataFrame:
    """(node, n, first, centre, radius, tree) per chunk; `first` is its smallest row number."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.of(frame["row"].to_numpy(np.int64), _matrix(frame["v"]), reach)
        return pd.DataFrame({
            "node": frame["node"].iloc[:1], "n": [len(frame)], "first": [tree.rows.min()], "centre": [tree.units[0].tolist()],
            "radius": [float(tree.levels[0][2][0])], "tree": [tree.to_bytes()],
        })

    return points.groupBy("node").applyInPandas(build, "node string, n long, first long, centre array<double>, radius double, tree binary")


def _ancestor(depth: Column) -> Column:
    """The name of the node above `node` at a depth; roots are at 1."""
    return F.call_function("substring_index", F.col("node"), F.lit("/"), depth)


def upper_nodes(chunks: DataFrame) -> DataFrame:
    """(node, parent, n, first, centre, radius, leaf) of chunks and of all nodes above them; roots are their own parents.

    A node's centre is that of its largest child, its radius the most that any child's centre and radius reach.
    """
    depth = F.size(F.split("node", "/"))
    level = chunks.select("node", "n", "first", "centre", "radius", F.lit(True).alias("leaf"), depth.alias("depth"))
    deepest = chunks.agg(F.max(depth)).first()[0] or 0
    made, waiting = [], level
    parent = F.when(F.col("depth") > 1, _ancestor(F.col("depth") - 1)).otherwise(F.col("node"))
    for d in range(deepest, 0, -1):
        here = freeze(waiting.filter(F.col("depth") == d).withColumn("parent", parent))
        made.append(here)
        if d > 1:
            biggest = here.groupBy("parent").agg(F.max_by("centre", F.struct("n", "node")).alias("top"))
            above = here.join(biggest, "parent").groupBy("parent").agg(
                F.sum("n").alias("n"), F.min("first").alias("first"), F.first("top").alias("centre"),
                F.max(_apart("centre", "top") + F.col("radius")).alias("radius"),
            )
            waiting = waiting.filter(F.col("depth") < d).unionByName(
                above.select(F.col("parent").alias("node"), "n", "first", "centre", "radius", F.lit(False).alias("leaf"), F.lit(d - 1).alias("depth"))
            )
    nodes = made[0] if made else level.withColumn("parent", parent)
    for here in made[1:]:
        nodes = nodes.unionByName(here)
    return nodes.drop("depth")


def traverse_nodes(nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (a, b) that are wholly linked, and pairs of chunks that are undecided; a node is paired with itself too."""
    info = ["node", "n", "first", "centre", "radius", "leaf"]
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in info]
    kids = nodes.filter("parent <> node").select("parent", *info).unionByName(nodes.filter("leaf").select(F.col("node").alias("parent"), *info))
    kids = freeze(kids)
    roots = nodes.filter("parent = node")
    pairs = roots.select(*side("a"), *side("b"))
    whole, undecided = [], []
    same = F.col("a_node") == F.col("b_node")
    while True:
        apart = F.when(same, 0.0).otherwise(_apart("a_centre", "b_centre"))
        radii = F.col("a_radius") + F.col("b_radius")
        judged = freeze(
            pairs.withColumn("low", apart - radii).withColumn("high", apart + radii).filter(F.col("low") <= reach + SLACK)
            .withColumn("whole", (F.col("high") <= reach - SLACK) & (~same | (F.col("a_n") > 1)))
        )
        whole.append(judged.filter("whole").select(*[f"{x}_{c}" for x in "ab" for c in ("node", "n", "first")]))
        undecided.append(judged.filter("not whole and a_leaf and b_leaf").select("a_node", "b_node"))
        open_pairs = judged.filter("not whole and not (a_leaf and b_leaf)").select("a_node", "b_node")
        if not open_pairs.head(1):
            break
        left = kids.select(F.col("parent").alias("a_parent"), *side("a"))
        right = kids.select(F.col("parent").alias("b_parent"), *side("b"))
        met = open_pairs.select(F.col("a_node").alias("a_parent"), F.col("b_node").alias("b_parent")).join(left, "a_parent").join(right, "b_parent")
        pairs = met.filter("a_parent <> b_parent or a_node <= b_node").drop("a_parent", "b_parent")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(whole), union(undecided)


def _in_chunks(chunks: DataFrame, undecided: DataFrame, threshold: float) -> DataFrame:
    """(kind, x, y) of `traverse` for all undecided pairs of chunks."""
    sides = undecided.select("a_node", "b_node", F.lit(0).alias("side"), F.col("a_node").alias("node")).unionByName(
        undecided.filter("a_node <> b_node").select("a_node", "b_node", F.lit(1).alias("side"), F.col("b_node").alias("node"))
    )
    trees = sides.join(chunks.select("node", "tree"), "node")

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        found = [Tree.from_bytes(t) for t in frame.sort_values("side")["tree"]]
        kinds, x, y = traverse(found[0], found[-1], threshold)
        return pd.DataFrame({"kind": kinds.astype(np.int32), "x": x, "y": y})

    return trees.groupBy("a_node", "b_node").applyInPandas(pair, "kind int, x long, y long")


def _whole_links(nodes: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, more): links that each vector of a chunk has through whole pairs of nodes above it; (x, y): rows that spans them."""
    own = F.col("a_node") == F.col("b_node")
    adds = whole.select(F.col("a_node").alias("node"), (F.col("b_n") - own.cast("long")).alias("more")).unionByName(
        whole.filter(~own).select(F.col("b_node").alias("node"), F.col("a_n").alias("more"))
    ).groupBy("node").agg(F.sum("more").alias("more"))
    heads = nodes.join(adds, "node").select(F.col("node").alias("above"), F.col("first").alias("above_first"), "more")
    leaves = nodes.filter("leaf").select("node", "first", F.explode(
        F.transform(F.sequence(F.lit(1), F.size(F.split("node", "/"))), _ancestor)
    ).alias("above"))
    under = freeze(leaves.join(heads, "above"))
    per_chunk = under.groupBy("node").agg(F.sum("more").alias("more"))
    spans = under.select(F.col("first").alias("x"), F.col("above_first").alias("y")).unionByName(
        whole.select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    ).filter("x <> y")
    return per_chunk, spans


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label",
    chunk: int = CHUNK, sample: int = SAMPLE, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: rows of the same label whose cosine is at least `threshold` are linked.

    `n_links` counts the other rows linked directly, `component_id` is the smallest id reachable by links, the row's own included,
    and `kept` tells whether that is the row's id. Cosines are in double precision on the original vectors.

    Rows whose label is null (unless `label` is None: then all are compared), whose id is null, or whose vector is null,
    empty, zero or holds a null or a value that is not finite are linked to nothing: 0 links, and their own id. A null id gives a
    null component that is not kept. Vectors of different lengths are not compared. Rows that share an id are rows of
    their own, as are repeated rows; their links count each. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col(f"`{embedding}`").cast("array<double>")
    group = F.lit("") if label is None else F.col(f"`{label}`").cast("string")
    fine = usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    base = freeze(
        vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), group.alias("label"), v.alias("v"))
        .select("vec_id", F.when(fine, F.md5(F.concat_ws("|", F.size("v"), "label"))).alias("node"), F.when(fine, F.col("v")).alias("v"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    reach = reach_of(threshold)
    placed = freeze(chunked(base.filter("node is not null").select("row", "node", "v"), chunk, sample, max_depth))
    chunks = freeze(build_chunks(placed, reach))
    nodes = freeze(upper_nodes(chunks))
    whole, undecided = traverse_nodes(nodes, reach)
    whole, found = freeze(whole), freeze(_in_chunks(chunks, undecided, threshold))
    per_chunk, spans = _whole_links(nodes, whole)

    through = freeze(placed.select("row", "node").join(per_chunk, "node").join(nodes.select("node", "first"), "node").select("row", "more", "first"))
    counts = found.filter("kind = 0").select(F.col("x").alias("row"), F.col("y").alias("n")).unionByName(through.select("row", F.col("more").alias("n")))
    links = found.filter("kind = 1").select("x", "y").unionByName(spans).unionByName(
        through.filter("row <> first").select(F.col("row").alias("x"), F.col("first").alias("y"))
    )
    members = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    rooted = freeze(
        base.select("row", "vec_id").join(counts.groupBy("row").agg(F.sum("n").alias("n_links")), "row", "left")
        .join(members.withColumnRenamed("node", "row"), "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "row").alias("root"))
    )
    least = freeze(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")))
    named = join_counted(rooted, least, "root", rooted.count())
    return named.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
