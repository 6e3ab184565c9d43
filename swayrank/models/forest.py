"""Uplift random forest grown with DataFrame aggregations.

Splits maximise the normalised divergence gain of Rzepakowski & Jaroszewicz, "Decision trees for
uplift modeling with single and multiple treatments" (2012), with response rates shrunk towards the
parent node. All trees of all runs grow together, level by level: a level counts into arrays of fixed size per (run, tree,
node), and of two siblings only the smaller (see `histograms`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
)

from swayrank.functions.joins import attach_one_row, join_groups
from swayrank.models.descent import descent
from swayrank.models.histograms import (
    BLOCK_ROWS,
    HISTOGRAM,
    Layout,
    add_chosen,
    arrow_schema,
    bin_edges,
    combined,
    dealt,
    joint_sums,
    level_histograms,
    make_blocks,
    packed,
    run_keys,
    spread_sums,
    struct_schema,
)
from swayrank.models.histograms import walk as walk_rows
from swayrank.models.shared import Scorer, make_shared_blocks, open_block, score_shared
from swayrank.operators.action import SharedRuns
from swayrank.session import freeze

MAX_TREE_NODES = 5_000_000  # over all runs and trees; what is broadcast stays below some 100 MB
SHARED_ROWS = 1 << 19  # rows of a task that counts them for all runs
STATS = ("n", "nt", "yt", "yc")

# Cumulative probabilities of a Poisson distribution with mean 1, for 0, 1, .. 7.
POISSON_ONE = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 10
    random_state: int = 42
    max_depth: int = 5
    max_features: int = 10
    min_samples_leaf: int = 100
    min_samples_treatment: int = 10
    n_reg: float = 10.0
    n_bins: int = 32
    normalization: bool = True


@dataclass
class Tree:
    """A tree as heap-ordered arrays: children of node i are 2i+1 (below the cut) and 2i+2."""

    feature: list[int]
    cut: list[int]
    treated_rate: list[float]
    control_rate: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls([-1] * size, [0] * size, [0.0] * size, [0.0] * size, [0.0] * size)


@dataclass
class UpliftForest:
    """A fitted forest; `by` are the columns of the run a forest belongs to (none for a single one)."""

    features: tuple[str, ...]
    config: ForestConfig
    edges: list[list[float]]
    trees: dict[tuple, list[Tree]]
    by: list[str] = field(default_factory=list)
    by_schema: StructType = field(default_factory=StructType)
    name: str = "uplift_rf"

    # ---- scoring ----

    def _forest_table(self, spark) -> DataFrame:
        """One row per run: per tree the arrays of split features, cuts and leaf uplifts."""
        nested = ArrayType(ArrayType(IntegerType()))
        schema = StructType([
            *self.by_schema,
            StructField("_feature", nested),
            StructField("_cut", nested),
            StructField("_leaf", ArrayType(ArrayType(DoubleType()))),
        ])
        rows = [
            (
                *key,
                [t.feature for t in trees],
                [t.cut for t in trees],
                [[p - q for p, q in zip(t.treated_rate, t.control_rate)] for t in trees],
            )
            for key, trees in self.trees.items()
        ]
        return spark.createDataFrame(rows, schema)

    def score(self, df: DataFrame) -> DataFrame:
        """Add `uplift`: walk all trees inside the row's own stage; nothing is shuffled."""
        columns = df.columns
        binned = with_bins(df, self.features, self.edges)
        table = self._forest_table(df.sparkSession)
        placed = join_groups(binned, F.broadcast(table), self.by) if self.by else attach_one_row(binned, table)
        depth, count = self.config.max_depth, self.config.n_estimators
        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(count - 1)),
            F.lit(0.0),
            lambda sum_, k: sum_ + F.get(F.get("_leaf", k), walk(F.get("_feature", k), F.get("_cut", k), depth)),
        )
        return placed.select(*columns, (total / F.lit(float(count))).alias("uplift"))

    def score_runs(self, shared: SharedRuns) -> DataFrame:
        """The rows of all runs with `uplift`, from rows that the runs have in common."""
        depth, count, models = self.config.max_depth, self.config.n_estimators, []
        for run in shared.runs:
            trees = self.trees[run.run_id,]
            leaf = [np.array(t.treated_rate) - np.array(t.control_rate) for t in trees]
            models.append((0.0, np.array([t.feature for t in trees]), np.array([t.cut for t in trees]), np.array(leaf)))
        return score_shared(shared, self.features, Scorer(Layout.of(self.edges), depth, models), lambda x: x / float(count))

    def margin(self, df: DataFrame) -> DataFrame:
        """Attributions of a forest explain its uplift score itself."""
        return self.score(df).withColumnRenamed("uplift", "margin")

    def feature_importances(self, spark) -> DataFrame:
        """Share per feature and run of the divergence gained by its splits, weighted by node size."""
        rows = []
        for key, trees in self.trees.items():
            gains = [0.0] * len(self.features)
            for tree in trees:
                for f, g in zip(tree.feature, tree.gain):
                    if f >= 0:
                        gains[f] += g
            total = sum(gains) or 1.0
            rows += [(*key, name, g / total) for name, g in zip(self.features, gains)]
        schema = StructType([*self.by_schema]).add("feature", "string").add("importance", "double")
        return spark.createDataFrame(rows, schema)

    # ---- storing ----

    def to_table(self, spark) -> DataFrame:
        """One row per run and tree."""
        ints, doubles = ArrayType(IntegerType()), ArrayType(DoubleType())
        schema = StructType([*self.by_schema, StructField("tree", IntegerType())])
        for name in ("feature", "cut"):
            schema.add(name, ints)
        for name in ("treated_rate", "control_rate", "gain"):
            schema.add(name, doubles)
        rows = [
            (*key, k, t.feature, t.cut, t.treated_rate, t.control_rate, t.gain)
            for key, trees in self.trees.items() for k, t in enumerate(trees)
        ]
        return spark.createDataFrame(rows, schema)

    def settings(self) -> dict:
        return {"features": list(self.features), "edges": self.edges, "by": self.by, "config": asdict(self.config)}

    @classmethod
    def from_table(cls, table: DataFrame, settings: dict) -> UpliftForest:
        by = settings["by"]
        trees: dict[tuple, list[Tree]] = {}
        for row in table.orderBy(*by, "tree").collect():
            key = tuple(row[c] for c in by)
            trees.setdefault(key, []).append(
                Tree(list(row["feature"]), list(row["cut"]), list(row["treated_rate"]), list(row["control_rate"]),
                     list(row["gain"]))
            )
        schema = StructType([table.schema[c] for c in by])
        return cls(tuple(settings["features"]), ForestConfig(**settings["config"]), settings["edges"], trees, by, schema)


# ---- bins ----

def with_bins(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """Add `_bins`, the array of bin numbers in feature order; null counts as above all edges."""
    cut = [(c, e) for c, e in zip(features, edges) if e]
    if cut:
        cutter = Bucketizer(
            inputCols=[c for c, _ in cut], outputCols=[f"_bin_{c}" for c, _ in cut], handleInvalid="keep",
            splitsArray=[[float("-inf"), *e, float("inf")] for _, e in cut],
        )
        df = cutter.transform(df)
    numbers = [
        F.coalesce(F.col(f"_bin_{c}").cast("int"), F.lit(len(e) + 1)) if e else F.lit(0) for c, e in zip(features, edges)
    ]
    return df.withColumn("_bins", F.array(*numbers)).drop(*[f"_bin_{c}" for c, _ in cut])


def walk(feature: Column, cut: Column, steps: int) -> Column:
    """The node a row's `_bins` reach after some steps down a tree; leaves stay where they are.

    A fold keeps the expression small: written out, each step would repeat the previous one.
    """
    if steps == 0:
        return F.lit(0)

    def down(node: Column, _: Column) -> Column:
        split = F.get(feature, node)
        above = F.get("_bins", split) >= F.get(cut, node)
        return F.when(split >= 0, node * 2 + F.when(above, 2).otherwise(1)).otherwise(node)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), down)


# ---- growing ----

def bootstrap_draw(tree: Column, id_col: str, seed: int) -> Column:
    """A number in [0, 1) per row and tree, from a hash of seed, tree and ID, alike in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), tree, F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bootstrap_weight(tree: Column, id_col: str, seed: int) -> Column:
    """How often a row enters a tree: Poisson(1) from its draw."""
    draw = bootstrap_draw(tree, id_col, seed)
    weight = F.lit(len(POISSON_ONE))
    for count in reversed(range(len(POISSON_ONE))):
        weight = F.when(draw < POISSON_ONE[count], count).otherwise(weight)
    return weight


def drawn_weights(draws: np.ndarray) -> np.ndarray:
    """`bootstrap_weight` of many draws at once; as columns, the cases of all trees make code too long to be compiled."""
    return np.searchsorted(POISSON_ONE, draws, "right").astype(np.uint8)


def _divergence(p: Column, q: Column) -> Column:
    p, q = (F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in (p, q))
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def _entropy(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def _rate(y: Column, n: Column, parent: Column, config: ForestConfig) -> Column:
    return (y + config.n_reg * parent) / (n + config.n_reg)


COUNTS = "n array<bigint>, nt array<bigint>, yt array<bigint>, yc array<bigint>"


def node_statistics(made: DataFrame, by_schema: StructType, layout: Layout) -> DataFrame:
    """Weighted counts per (run, tree, node, feature, bin) from a level's arrays."""
    widths = [len(e) + 2 for e in layout.edges]
    places = [F.lit(",".join(map(str, x))) for x in (
        [j for j, w in enumerate(widths) for _ in range(w)], [b for w in widths for b in range(w)])]
    numbers = [F.transform(F.split(p, ","), lambda x: x.cast("int")) for p in places]
    run = F.from_json(F.substring_index("key", "#", 1), by_schema) if len(by_schema) else F.struct()
    keyed = made.select(
        *[run[f.name].alias(f.name) for f in by_schema], F.substring_index("key", "#", -1).cast("int").alias("tree"), "node",
        F.inline(F.arrays_zip(numbers[0].alias("split_on"), numbers[1].alias("bin"), *STATS)),
    )
    return keyed.toDF(*by_schema.names, "tree", "node", "split_on", "bin", *STATS).where("n > 0")


def best_splits(stats: DataFrame, rates: DataFrame, by: Sequence[str], config: ForestConfig) -> DataFrame:
    """The best admissible split per node, with the shrunk response rates of node and children.

    `rates` has the node rates found at the level above; at the root there are none and the raw
    rates apply. Windows run over the bins of one feature in one node.
    """
    nodes = [*by, "tree", "node"]
    cell = Window.partitionBy(*nodes, "split_on")
    upwards = cell.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One shuffle by node serves the windows and the final choice.
    sides = stats.repartition(*nodes).select(
        *nodes, "split_on", "bin",
        *[F.sum(c).over(upwards).cast("double").alias(f"hi_{c}") for c in STATS],
        *[F.sum(c).over(cell).cast("double").alias(c) for c in STATS],
    )
    c = F.col
    sides = join_groups(sides, rates, nodes, "left").withColumns({
        **{f"lo_{s}": c(s) - c(f"hi_{s}") for s in STATS},
        "p": F.coalesce(c("p"), F.try_divide(c("yt"), c("nt")), F.lit(0.0)),
        "q": F.coalesce(c("q"), F.try_divide(c("yc"), c("n") - c("nt")), F.lit(0.0)),
    })
    for side in ("lo", "hi"):
        sides = sides.withColumns({
            f"{side}_p": _rate(c(f"{side}_yt"), c(f"{side}_nt"), c("p"), config),
            f"{side}_q": _rate(c(f"{side}_yc"), c(f"{side}_n") - c(f"{side}_nt"), c("q"), config),
        })
    share = c("hi_n") / c("n")
    gain = (
        share * _divergence(c("hi_p"), c("hi_q")) + (1 - share) * _divergence(c("lo_p"), c("lo_q"))
        - _divergence(c("p"), c("q"))
    )
    improvement = c("n") * gain
    if config.normalization:
        treated = c("nt") / c("n")
        at, ac = F.try_divide(c("hi_nt"), c("nt")), F.try_divide(c("hi_n") - c("hi_nt"), c("n") - c("nt"))
        gain = gain / (
            _entropy(treated) * _divergence(at, ac) + treated * _entropy(at) + (1 - treated) * _entropy(ac) + 0.5
        )
    # Each node looks at max_features of the features, picked by hash.
    draw = F.xxhash64(F.lit(config.random_state), "tree", "node", "split_on")
    pick = F.dense_rank().over(Window.partitionBy(*nodes).orderBy(draw))
    admissible = (c("bin") > 0) & (c("pick") <= config.max_features) & (c("gain") > 0)
    for side in ("lo", "hi"):
        admissible &= c(f"{side}_n") >= config.min_samples_leaf
        admissible &= c(f"{side}_nt") >= config.min_samples_treatment
        admissible &= (c(f"{side}_n") - c(f"{side}_nt")) >= config.min_samples_treatment
    choice = F.struct(
        c("gain"), (-c("split_on")).alias("order_on"), (-c("bin")).alias("order_bin"), "split_on", "bin",
        "lo_p", "lo_q", "hi_p", "hi_q", "improvement", "lo_n", "hi_n",
    )
    return (
        sides.withColumns({"gain": gain, "improvement": improvement, "pick": pick})
        .groupBy(*nodes)
        .agg(F.max("p").alias("p"), F.max("q").alias("q"), F.max(F.when(admissible, choice)).alias("best"))
        .select(*nodes, "p", "q", "best.*")
    )


def fit_uplift_forest(
    train: DataFrame, features: Sequence[str], config: ForestConfig = ForestConfig(), treatment: str = "treatment",
    target: str = "visit", id_col: str = "ID", by: Sequence[str] = (), edges: Sequence[Sequence[float]] | None = None,
) -> UpliftForest:
    """Grow the forest; with `by`, one forest per run in the same jobs.

    `edges` are split candidates per feature, found from `train` if not given. The driver holds the trees (runs x trees x
    2^depth nodes, checked), never rows.
    """
    spark, by = train.sparkSession, list(by)
    edges = [list(e) for e in edges] if edges is not None else bin_edges(train, features, config.n_bins)
    layout, count = Layout.of(edges), config.n_estimators
    draws = F.array(*[bootstrap_draw(F.lit(k), id_col, config.random_state) for k in range(count)])
    rows = train.select(
        *by, *features, F.col(treatment).cast("double").alias("_t"), F.col(target).cast("double").alias("_y"), draws.alias("_w")
    )
    blocks = freeze(make_blocks(rows, features, layout, by, {"_t": 1, "_y": 1, "_w": count}, {"_w": drawn_weights}))
    blocks = dealt(blocks) if by else packed(blocks)
    by_schema = StructType([train.schema[c] for c in by])
    found = blocks.select("key").distinct().limit(MAX_TREE_NODES)
    found = found.select("key", F.from_json("key", by_schema).alias("run")).collect() if by else found.collect()
    keys = {r["key"]: tuple(r["run"]) if by else () for r in found} or ({} if by else {"{}": ()})

    def counts(arrays: dict, counted: dict, level: int, made: DataFrame | None) -> DataFrame:
        measure = _forest_measure(arrays, counted, count, level)
        return level_histograms(blocks, made, counted, layout, len(STATS), measure, _count_arrays, COUNTS)

    return UpliftForest(tuple(features), config, edges, _grow(spark, keys, by_schema, layout, config, counts), by, by_schema)


def fit_forest_runs(
    train: SharedRuns, features: Sequence[str], config: ForestConfig, treatment: str, target: str, id_col: str, edges: Sequence[Sequence[float]],
) -> UpliftForest:
    """`fit_uplift_forest` by run of rows that the runs have in common: an action changes neither arms nor responses nor IDs."""
    spark, layout, count = train.rows.sparkSession, Layout.of(edges), config.n_estimators
    draws = F.array(*[bootstrap_draw(F.lit(k), id_col, config.random_state) for k in range(count)])
    rows = train.rows.withColumns({"_t": F.col(treatment).cast("double"), "_y": F.col(target).cast("double"), "_w": draws})
    as_class = {"_t": lambda t: t, "_y": lambda y: y, "_w": lambda draws: drawn_weights(draws).T}
    blocks = freeze(make_shared_blocks(SharedRuns(rows, train.action, train.runs), features, layout, {"_t": 1, "_y": 1, "_w": count}, as_class))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    keys = run_keys(train.runs) if size else []
    blocks = blocks.repartition(max(1, min(-(-size // BLOCK_ROWS), max(spark.sparkContext.defaultParallelism, -(-size // SHARED_ROWS)))))
    by_schema = StructType().add("run_id", "integer", False)

    def counts(arrays: dict, counted: dict, level: int, made: DataFrame | None) -> DataFrame:
        grown = [[(*arrays[name], list(counted[name])) if name in counted else None for name in (f"{key}#{k}" for k in range(count))] for key in keys]
        parts = blocks.mapInArrow(_count_runs(grown, keys, counted, layout, config), struct_schema(HISTOGRAM))
        return combined(parts, made, counted, layout, len(STATS), _count_arrays, COUNTS)

    forest = _grow(spark, {key: (run.run_id,) for key, run in zip(keys, train.runs)}, by_schema, layout, config, counts)
    return UpliftForest(tuple(features), config, [list(e) for e in edges], forest, ["run_id"], by_schema)


def _count_runs(grown: list[list], keys: list[str], counted: dict, layout: Layout, config: ForestConfig):
    """Sums of the nodes counted, over all blocks of a task, one run and tree after the other.

    Rows are counted by arm and response, as often as they are drawn for the tree.
    """
    starts, schema = tuple(layout.starts.tolist()), arrow_schema(HISTOGRAM)
    total = starts[-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, held = descent(starts, config.max_depth), []
        for batch in batches:
            for row in batch.to_pylist():
                t, y = np.frombuffer(row["_t"]), np.frombuffer(row["_y"])
                weights = np.frombuffer(row["_w"], np.uint8).reshape(config.n_estimators, -1)
                held.append((open_block(row, starts), (2 * (t == 1) + (y == 1)).astype(np.int64), weights))
        for n, key in enumerate(keys):
            if not any(grown[n]):
                continue
            codes = [block.of_run(n) for block, _, _ in held]
            for k, tree in enumerate(grown[n]):
                if tree is None:
                    continue
                feature, cut, wanted = tree
                slot_of = np.full(len(feature), -1)
                slot_of[wanted] = np.arange(len(wanted))
                find, chosen = way.finder(feature, cut, slot_of), []
                for mine, (_, kind, weights) in zip(codes, held):
                    slot = find(mine)
                    some = np.flatnonzero((slot >= 0) & (weights[k] > 0))
                    if len(some):
                        chosen.append((kind[some] * len(wanted) + slot[some], weights[k][some], *[code[some] for code in mine]))
                if not chosen:
                    continue
                slots, w, *parts = (np.concatenate(x) for x in zip(*chosen))
                sums = joint_sums(way.joints, 4 * len(wanted), 1)
                add_chosen(sums, parts, slots, [w])
                by_kind = [s.reshape(4, len(wanted), -1) for s in sums]
                cells = np.zeros((len(wanted), total, len(STATS)))
                spread_sums(cells, [np.stack([s.sum(axis=0), s[2] + s[3], s[3], s[1]]) for s in by_kind], way.joints)
                parents = [counted[f"{key}#{k}"][node] for node in wanted]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{key}#{k}"] * len(wanted)), pa.array(parents, pa.int32()), pa.array(wanted, pa.int32()),
                    pa.array([1] * len(wanted), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()),
                ], schema=schema)

    return each


def _grow(spark, keys: dict[str, tuple], by_schema: StructType, layout: Layout, config: ForestConfig, counts) -> dict[tuple, list[Tree]]:
    """Grow the trees of all runs level by level; `counts` makes the arrays of a level's nodes."""
    by, count = by_schema.names, config.n_estimators
    if len(keys) * count * 2 ** (config.max_depth + 1) > MAX_TREE_NODES:
        raise ValueError("too many runs for one forest fit; split the list of runs")
    forest = {key: [Tree.empty(config.max_depth) for _ in range(count)] for key in keys.values()}
    rate_schema = StructType([*by_schema, StructField("tree", IntegerType()), StructField("node", IntegerType()),
                              StructField("p", DoubleType()), StructField("q", DoubleType())])
    names = {(keys[name], k): f"{name}#{k}" for name in keys for k in range(count)}
    counted: dict[str, dict[int, int]] = {name: {0: -1} for name in names.values()}
    made, levels = None, []
    try:
        for level in range(config.max_depth):
            arrays = {names[key, k]: (np.array(t.feature), np.array(t.cut)) for key, ts in forest.items() for k, t in enumerate(ts)}
            made = counts(arrays, counted, level, made)
            levels.append(made)
            first = 2**level - 1
            rates = spark.createDataFrame(
                [(*key, k, node, t.treated_rate[node], t.control_rate[node])
                 for key, ts in forest.items() for k, t in enumerate(ts)
                 for node in range(first, 2 * first + 1) if level > 0 and t.feature[(node - 1) // 2] >= 0], rate_schema)
            counted = {}
            for r in best_splits(node_statistics(made, by_schema, layout), rates, by, config).collect():
                key, node = tuple(r[c] for c in by), r["node"]
                tree = forest[key][r["tree"]]
                tree.treated_rate[node], tree.control_rate[node] = r["p"], r["q"]
                if r["split_on"] is None:
                    continue
                tree.feature[node], tree.cut[node], tree.gain[node] = r["split_on"], r["bin"], r["improvement"]
                low, high = 2 * node + 1, 2 * node + 2
                tree.treated_rate[low], tree.control_rate[low] = r["lo_p"], r["lo_q"]
                tree.treated_rate[high], tree.control_rate[high] = r["hi_p"], r["hi_q"]
                counted.setdefault(names[key, r["tree"]], {})[high if r["hi_n"] < r["lo_n"] else low] = node
            if not counted:
                break
    finally:
        for done in levels:
            done.unpersist()
    return forest


def _count_arrays(key: str, node: int, cells: np.ndarray) -> tuple:
    return tuple(np.rint(cells.T).astype(np.int64).tolist())


def _forest_measure(arrays: dict[str, tuple], counted: dict, count: int, level: int):
    """The node of every row in each tree of its run, and its counts as often as it is drawn for the tree."""

    def measure(block: dict, bins: np.ndarray):
        t, y = np.frombuffer(block["_t"]), np.frombuffer(block["_y"])
        weights = np.frombuffer(block["_w"], np.uint8).reshape(-1, count)
        for k in range(count):
            name = f"{block['key']}#{k}"
            if name not in counted:
                continue
            drawn = np.flatnonzero(weights[:, k] > 0)
            w, treated, responded = weights[drawn, k].astype(np.float64), t[drawn], y[drawn]
            node = np.full(len(bins), 0)
            node[drawn] = walk_rows(bins[drawn], *arrays[name], level)
            numbers = np.zeros((4, len(bins)))
            numbers[:, drawn] = w, w * treated, w * treated * responded, w * (1 - treated) * responded
            yield name, node, list(numbers)

    return measure
