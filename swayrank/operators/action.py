"""Collective actions: who is eligible, who takes part, and what participants change."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.operators.sampling import HASH, hash_cutoffs, seeded_hash, truncated_share

MAX_RUNS_PER_JOB = 5_000


def _operator_and_number(text: str, allowed: str, what: str) -> tuple[str, float]:
    sign, number = text[:1], text[1:]
    if not sign or sign not in allowed:
        raise ValueError(f"unsupported {what} operator in {text!r}; use one of {' '.join(allowed)}")
    try:
        return sign, float(number)
    except ValueError:
        raise ValueError(f"{what} {text!r} must be one operator character and a number") from None


@dataclass(frozen=True)
class CollectiveAction:
    """An eligibility criterion such as {"recency": "<2"}, the changes participants make, and their share.

    `attacks` is a list of {feature: change} with change "=v" (set), "+v" (add) or "-v" (subtract,
    not below `floor`), applied in list order.
    """

    criterion: Mapping[str, str]
    attacks: Sequence[Mapping[str, str]]
    frac: float
    floor: float = 0.0
    feature: str = field(init=False)
    operator: str = field(init=False)
    threshold: float = field(init=False)

    def __post_init__(self) -> None:
        if len(self.criterion) != 1:
            raise ValueError("exactly one eligibility criterion is supported")
        ((feature, rule),) = self.criterion.items()
        operator, threshold = _operator_and_number(rule, "=><", "criterion")
        object.__setattr__(self, "feature", feature)
        object.__setattr__(self, "operator", operator)
        object.__setattr__(self, "threshold", threshold)
        for _, change in self.changes():
            _operator_and_number(change, "=+-", "attack")

    def changes(self) -> list[tuple[str, str]]:
        return [(name, change) for attack in self.attacks for name, change in attack.items()]

    @property
    def attack_features(self) -> list[str]:
        """Changed features, each once, in order of first change."""
        return list(dict.fromkeys(name for name, _ in self.changes()))


@dataclass(frozen=True)
class Run:
    """One repeat of an experiment: its key, the seed of its sample, the share taking part."""

    run_id: int
    seed: int
    frac: float


def run_grid_keys(fracs: Iterable[float], seeds: Sequence[int]) -> list[Run]:
    """All (fraction, seed) repeats, numbered."""
    pairs = [(frac, seed) for frac in fracs for seed in seeds]
    return [Run(i, seed, frac) for i, (frac, seed) in enumerate(pairs)]


def eligible(action: CollectiveAction) -> Column:
    """The eligibility rule as a column; null feature values are not eligible."""
    value, limit = F.col(action.feature), F.lit(action.threshold)
    rule = {"=": value == limit, ">": value > limit, "<": value < limit}[action.operator]
    return F.coalesce(rule, F.lit(False))


def changed_value(current: Column, change: str, floor: float = 0.0) -> Column:
    sign, number = _operator_and_number(change, "=+-", "attack")
    if sign == "=":
        return F.lit(number)
    if sign == "+":
        return current + F.lit(number)
    lowered = current - F.lit(number)
    return F.when(lowered < floor, F.lit(floor)).otherwise(lowered)


def apply_attacks(df: DataFrame, action: CollectiveAction, flag: str = "aca_flag") -> DataFrame:
    """Change the features of flagged rows; changed columns become double."""
    values = {name: F.col(name).cast("double") for name in action.attack_features}
    for name, change in action.changes():
        values[name] = changed_value(values[name], change, action.floor)
    return df.withColumns(
        {name: F.when(F.col(flag) == 1, value).otherwise(F.col(name).cast("double")) for name, value in values.items()}
    )


def with_runs(df: DataFrame, runs: Sequence[Run], cutoffs: Mapping[int, str] | None = None) -> DataFrame:
    """Repeat every row once per run, adding run_id, run_seed and frac (and the run's cutoff).

    The runs are a literal array unfolded inside the scan's stage, so their number is bounded by the
    caller's list and no join takes place.
    """
    if not 0 < len(runs) <= MAX_RUNS_PER_JOB:
        raise ValueError(f"give between 1 and {MAX_RUNS_PER_JOB} runs per job")
    rows = []
    for run in runs:
        fields = [F.lit(run.run_id).alias("run_id"), F.lit(run.seed).alias("run_seed"),
                  F.lit(float(run.frac)).alias("frac")]
        if cutoffs is not None:
            fields.append(F.lit(cutoffs.get(run.run_id, "")).alias("cutoff"))
        rows.append(F.struct(*fields))
    return df.select("*", F.inline(F.array(*rows)))


def participation_cutoffs(
    population: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str = "ID"
) -> dict[int, str]:
    """Per run the largest hash that still takes part; runs without participants are absent.

    One job over the eligible IDs, hashed and counted once per seed: runs of one seed differ in their shares only. The result
    is one string per run, so it goes into later plans as literals and is not worked out again by each of them.
    """
    seeds = list(dict.fromkeys(run.seed for run in runs))
    candidates = with_runs(population.where(eligible(action)).select(id_col), [Run(n, seed, 0.0) for n, seed in enumerate(seeds)])
    hashed = candidates.withColumn(HASH, seeded_hash(F.col("run_seed"), id_col)).select("run_seed", HASH)
    of_runs = F.array(*[
        F.struct(F.lit(run.run_id).alias("run_id"), F.lit(float(run.frac)).alias("frac"), F.lit(run.seed).alias("seed")) for run in runs
    ])

    def unfold(counts: DataFrame) -> DataFrame:
        return counts.select("*", F.inline(F.filter(of_runs, lambda run: run["seed"] == F.col("run_seed"))))

    cutoffs = hash_cutoffs(
        hashed, ["run_id"], truncated_share(F.col("frac")), carry=["frac"], few_groups=True, shared=["run_seed"], unfold=unfold,
    )
    return {row["run_id"]: row["cutoff"] for row in cutoffs.collect()}


def apply_action_runs(
    df: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str = "ID", cutoffs: Mapping[int, str] | None = None,
) -> DataFrame:
    """Every row once per run with run_id, frac, `aca_flag` and the run's changes.

    Per run exactly int(n_eligible * frac) eligible rows take part: those whose hash does not exceed
    the run's cutoff (found here unless given). The rows are neither joined nor shuffled.
    """
    rows = with_runs(df, runs, participation_cutoffs(df, action, runs, id_col) if cutoffs is None else cutoffs)
    own_hash = F.when(eligible(action), seeded_hash(F.col("run_seed"), id_col))
    flagged = rows.withColumn("aca_flag", F.when(own_hash <= F.col("cutoff"), 1).otherwise(0))
    return apply_attacks(flagged.drop("cutoff", "run_seed"), action)


PART, AFTER = "_part", "_after_"


@dataclass(frozen=True)
class SharedRuns:
    """`apply_action_runs` without a row per run: the rows once each, with the places in `runs` of those that a row takes part in
    (`PART`) and the values its changed features have then (`AFTER` and the name)."""

    rows: DataFrame
    action: CollectiveAction
    runs: Sequence[Run]

    def unfold(self, rows: DataFrame, kept: Sequence[str], each: Mapping[str, str]) -> DataFrame:
        """`rows` once per run as `apply_action_runs` has them; `each` maps new columns to columns with an array of their values by run."""
        (new, values), = each.items()
        taken = rows.select("*", F.posexplode(values).alias("_n", new))
        by_run = {"run_id": [F.lit(r.run_id) for r in self.runs], "frac": [F.lit(float(r.frac)) for r in self.runs]}
        part = F.array_contains(PART, F.col("_n"))
        changed = {c: F.when(part, F.col(f"{AFTER}{c}")).otherwise(F.col(c).cast("double")) for c in self.action.attack_features}
        return taken.select(
            *[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in kept if not c.startswith(AFTER)],
            *[F.get(F.array(*found), F.col("_n")).alias(c) for c, found in by_run.items()],
            F.when(part, 1).otherwise(0).alias("aca_flag"), new,
        )


def share_action(
    df: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str = "ID", cutoffs: Mapping[int, str] | None = None,
) -> SharedRuns:
    """The action of every run on rows that the runs share; a row's hash is worked out once per seed."""
    if not 0 < len(runs) <= MAX_RUNS_PER_JOB:
        raise ValueError(f"give between 1 and {MAX_RUNS_PER_JOB} runs per job")
    found = participation_cutoffs(df, action, runs, id_col) if cutoffs is None else cutoffs
    by_seed: dict[int, list[Column]] = {}
    for n, run in enumerate(runs):
        by_seed.setdefault(run.seed, []).append(F.struct(F.lit(n).alias("n"), F.lit(found.get(run.run_id, "")).alias("cutoff")))
    limits = F.array(*[F.array(*own) for own in by_seed.values()])

    def taken(own_hash: Column, place: Column) -> Column:
        return F.transform(F.filter(F.get(limits, place), lambda x: own_hash <= x["cutoff"]), lambda x: x["n"])

    part = F.flatten(F.transform(F.array(*[seeded_hash(seed, id_col) for seed in by_seed]), taken))
    none = F.array().cast("array<int>")
    values = {name: F.col(name).cast("double") for name in action.attack_features}
    for name, change in action.changes():
        values[name] = changed_value(values[name], change, action.floor)
    rows = df.select(
        "*", F.when(eligible(action), F.coalesce(part, none)).otherwise(none).alias(PART),
        *[value.alias(f"{AFTER}{name}") for name, value in values.items()],
    )
    return SharedRuns(rows, action, runs)


def apply_action(df: DataFrame, action: CollectiveAction, seed: int = 42, id_col: str = "ID") -> DataFrame:
    """One action on one table: all rows come back, participants flagged and changed."""
    run = [Run(0, seed, action.frac)]
    return apply_action_runs(df, action, run, id_col).drop("run_id", "frac")


def compare_ranking(
    before: DataFrame, after: DataFrame, action: CollectiveAction, id_col: str = "ID", by: Sequence[str] = ()
) -> DataFrame:
    """Inner join of the rankings on ID: original features and ranks, `_modified` ranks, the flag.

    `by` lists run keys that only `after` has. Where the before values already travel with the
    changed rows (see `plans.experiment`), this join is not needed.
    """
    left = before.select(id_col, *action.attack_features, "normalised_rank", "uplift")
    right = after.select(
        *by,
        id_col,
        F.col("normalised_rank").alias("normalised_rank_modified"),
        F.col("uplift").alias("uplift_modified"),
        "aca_flag",
    )
    # Spark does not count the repetition by run in its size estimate, so it must not pick a broadcast.
    return left.join(right.hint("merge") if by else right, id_col, "inner")
