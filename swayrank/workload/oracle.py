"""The queries as SQL for DuckDB, written with plain windows and joins."""

from __future__ import annotations

from swayrank.functions.student import expansion_terms
from swayrank.operators import sampling as smp
from swayrank.operators.report import GRID_FRACTIONS
from swayrank.workload.campaign import SCORED_SQL, TRIAL_SQL, score_sql
from swayrank.workload.queries import GRID_RUNS, SMALL_RUNS

SINGLE_RUN = [(0, 42)]

ORACLE: dict[str, str] = {}


def with_campaign(body: str) -> str:
    return f"WITH {TRIAL_SQL}\n{body}"


def with_scored(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SCORED_SQL, *ctes]) + "\n" + body


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


# ---- building blocks ----

def qini_ctes(source: str, score: str, by: str, prefix: str = "q") -> str:
    """`{prefix}_points`: Qini points per group; `{prefix}_auc`: the coefficient per group."""
    def points(name: str, value: str) -> str:
        return f"""
{name}_cells AS (
  SELECT {by}, {value} AS s, count(*) AS n, sum(treatment) AS nt, sum(treatment * visit) AS yt,
    sum((1 - treatment) * visit) AS yc FROM {source} GROUP BY {by}, {value}),
{name}_running AS (
  SELECT {by}, s, sum(n) OVER w AS x, sum(nt) OVER w AS nt, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc
  FROM {name}_cells WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
{name}_points AS (
  SELECT {by}, s, CAST(x AS BIGINT) AS x,
    CAST(yt - yc * CASE WHEN x = nt THEN 0 ELSE CAST(nt AS DOUBLE) / (x - nt) END AS DOUBLE) AS v
  FROM {name}_running),
{name}_strips AS (
  SELECT {by}, (x - lag(x, 1, 0) OVER w) * (v + lag(v, 1, 0) OVER w) / 2.0 AS strip,
    x, v, row_number() OVER (PARTITION BY {by} ORDER BY x DESC) AS back
  FROM {name}_points WINDOW w AS (PARTITION BY {by} ORDER BY x)),
{name}_area AS (
  SELECT {by}, sum(strip) AS area, max(CASE WHEN back = 1 THEN x * v / 2.0 END) AS base
  FROM {name}_strips GROUP BY {by})"""

    actual = points(prefix, score)
    best = points(f"{prefix}_best", "treatment * visit - (1 - treatment) * visit")
    return f"""{actual.lstrip()},{best},
{prefix}_auc AS (
  SELECT a.{by}, (a.area - b.base) / nullif(b.area - b.base, 0) AS qini_coeff
  FROM {prefix}_area a JOIN {prefix}_best_area b ON a.{by} = b.{by})"""


def action_ctes(runs: list[tuple[int, int, float]], rule: str, changes: dict[str, str]) -> str:
    """`compared`: every row once per run, before and after the action; `after_auc` per run."""
    values = ", ".join(f"({i}, {seed}, CAST({frac!r} AS DOUBLE))" for i, seed, frac in runs)
    new = ", ".join(
        f"CASE WHEN p.ID IS NOT NULL THEN {changes[c]} ELSE b.{c} END AS {c}" if c in changes else f"b.{c} AS {c}"
        for c in ("recency", "history", "newbie")
    )
    return f"""runs AS (SELECT * FROM (VALUES {values}) AS v(run_id, seed, frac)),
base AS (SELECT *, rank / CAST(max(rank) OVER () AS DOUBLE) AS normalised_rank
  FROM (SELECT *, dense_rank() OVER (ORDER BY uplift DESC) AS rank FROM scored)),
base_run AS (SELECT *, 0 AS grp FROM base),
{qini_ctes("base_run", "uplift", "grp", "before")},
candidates AS (
  SELECT r.run_id, b.ID, row_number() OVER (PARTITION BY r.run_id
      ORDER BY md5(CAST(r.seed AS VARCHAR) || ':' || CAST(b.ID AS VARCHAR))) AS place,
    floor(CAST(count(*) OVER (PARTITION BY r.run_id) AS DOUBLE) * r.frac) AS k
  FROM base b CROSS JOIN runs r WHERE {rule}),
picked AS (SELECT run_id, ID FROM candidates WHERE place <= k),
changed AS (
  SELECT r.run_id, r.frac, b.ID, b.treatment, b.visit, b.uplift AS uplift_before, b.normalised_rank AS rank_before,
    b.recency AS recency_before, b.history AS history_before, b.newbie AS newbie_before,
    CASE WHEN p.ID IS NULL THEN 0 ELSE 1 END AS aca_flag, {new}
  FROM base b CROSS JOIN runs r LEFT JOIN picked p ON p.run_id = r.run_id AND p.ID = b.ID),
rescored AS (SELECT *, {score_sql()} AS uplift_after FROM changed),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY uplift_after DESC) AS rank FROM rescored),
compared AS (SELECT *, rank / CAST(max(rank) OVER (PARTITION BY run_id) AS DOUBLE) AS rank_after FROM ranked),
{qini_ctes("rescored", "uplift_after", "run_id", "after")}"""


RECENCY_CHANGES = {"recency": "CASE WHEN b.recency - 24.0 < 0 THEN 0.0 ELSE b.recency - 24.0 END", "newbie": "1.0"}
HISTORY_CHANGES = {"history": "CASE WHEN b.history - 200000 < 0 THEN 0.0 ELSE b.history - 200000 END"}


def recency_action(runs=((0, 42, 0.1),)) -> str:
    return action_ctes(list(runs), "b.recency > 40", RECENCY_CHANGES)


def history_action(runs=((0, 42, 0.1),)) -> str:
    return action_ctes(list(runs), "b.history > 250000", HISTORY_CHANGES)


def keys(runs) -> list[tuple[int, int, float]]:
    return [(r.run_id, r.seed, r.frac) for r in runs]


def t_sql(n: str) -> str:
    """Critical value for n pairs by the large-sample expansion (n is in the hundreds here)."""
    return "(" + " + ".join(f"{g!r} / pow({n} - 1.0, {i})" for i, g in enumerate(expansion_terms(0.95))) + ")"


MOVED = """moved AS (
  SELECT run_id, count(*) AS n, avg(rank_before) AS avg_before, median(rank_before) AS median_before,
    avg(rank_after) AS avg_after, median(rank_after) AS median_after,
    avg(rank_before - rank_after) AS mean_diff, stddev_samp(rank_before - rank_after) / sqrt(count(*)) AS se
  FROM compared WHERE aca_flag = 1 GROUP BY run_id)"""

CI_LOW = f"mean_diff - {t_sql('n')} * se"
CI_HIGH = f"mean_diff + {t_sql('n')} * se"


def results_cte(feature: str, name: str = "results") -> str:
    return f"""{MOVED},
{name} AS (
  SELECT r.run_id, 'campaign' AS dataset, 'formula' AS model, '{feature}' AS target_feature, r.frac,
    q.qini_coeff, m.n AS num_participants, m.avg_before AS avg_normalised_rank,
    m.median_before AS median_normalised_rank, m.avg_after AS avg_modified_normalised_rank,
    m.median_after AS median_modified_normalised_rank, {CI_LOW} AS ci_low, {CI_HIGH} AS ci_high,
    (SELECT qini_coeff FROM before_auc) AS baseline_qini_coeff
  FROM runs r JOIN after_auc q ON q.run_id = r.run_id JOIN moved m ON m.run_id = r.run_id)"""


RESULT_DOUBLES = [
    "frac", "qini_coeff", "avg_normalised_rank", "median_normalised_rank", "avg_modified_normalised_rank",
    "median_modified_normalised_rank", "ci_low", "ci_high", "baseline_qini_coeff",
]
RESULT_COLUMNS = "dataset, model, target_feature, num_participants, " + ", ".join(r6(c, c) for c in RESULT_DOUBLES)

SMALL_GRID = [history_action(keys(SMALL_RUNS)), results_cte("history")]

METRICS = ("ci_low", "ci_high", "delta_qini")
AGG = """drops AS (SELECT *, (baseline_qini_coeff - qini_coeff) / nullif(baseline_qini_coeff, 0) AS delta_qini FROM results),
agg AS (SELECT dataset, model, target_feature, frac, """ + ", ".join(
    f"avg({m}) AS avg_{m}, stddev_samp({m}) AS std_{m}, median({m}) AS median_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}"
    for m in METRICS
) + " FROM drops GROUP BY dataset, model, target_feature, frac)"
AGG_DOUBLES = [f"{s}_{m}" for m in METRICS for s in ("avg", "std", "median", "min", "max")]


def histogram_ctes(source: str, by: str, bins: int = 50) -> str:
    """`hist`: equal-width bins over each group's range, from `source` with columns {by}, value."""
    return f"""ends AS (SELECT {by}, min(value) AS mn, max(value) AS mx, count(*) AS total FROM {source} GROUP BY {by}),
edges AS (SELECT {by}, total, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS low,
  CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS high FROM ends),
{bin_ctes(source, by, bins)}"""


def bin_ctes(source: str, by: str, bins: int) -> str:
    return f"""guessed AS (
  SELECT s.{by}, s.value, e.low, (e.high - e.low) / {bins}.0 AS width,
    greatest(least(floor((s.value - e.low) / ((e.high - e.low) / {bins}.0)), {bins - 1}), 0) AS g
  FROM {source} s JOIN edges e ON e.{by} = s.{by}),
placed AS (
  SELECT {by}, CAST(CASE WHEN value < low + g * width AND g > 0 THEN g - 1
    WHEN value >= low + (g + 1) * width AND g < {bins - 1} THEN g + 1 ELSE g END AS INT) AS bin FROM guessed),
counted AS (SELECT {by}, bin, count(*) AS c FROM placed GROUP BY {by}, bin),
hist AS (
  SELECT e.{by}, CAST(b.bin AS INT) AS bin, e.low + b.bin * ((e.high - e.low) / {bins}.0) AS bin_start,
    coalesce(c.c, 0) AS count, (e.high - e.low) / {bins}.0 AS width, e.total
  FROM edges e CROSS JOIN (SELECT range AS bin FROM range({bins})) b
  LEFT JOIN counted c ON c.{by} = e.{by} AND c.bin = b.bin)"""


def curve_ctes(source: str, score: str, by: str, name: str = "curve") -> str:
    """`{name}`: uplift at up to 201 depths per group, by walking all rows."""
    return f"""{name}_rows AS (
  SELECT {by}, row_number() OVER w AS i, sum(treatment) OVER w AS nt, sum(treatment * visit) OVER w AS yt,
    sum((1 - treatment) * visit) OVER w AS yc
  FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY {score} DESC, treatment DESC, visit DESC ROWS UNBOUNDED PRECEDING)),
{name}_sizes AS (SELECT {by}, count(*) AS n, least(count(*) + 1, 201) AS k FROM {source} GROUP BY {by}),
{name}_nodes AS (
  SELECT {by}, CAST(u.node AS INT) AS node,
    CAST(CASE WHEN u.node = k - 1 THEN n ELSE floor(u.node * (n / CAST(k - 1 AS DOUBLE))) END AS BIGINT) AS x
  FROM {name}_sizes, (SELECT range AS node FROM range(201)) u WHERE u.node < k),
{name} AS (
  SELECT d.{by}, d.node, d.x, CAST(CASE WHEN d.x = 0 THEN 0 WHEN d.x = r.nt THEN r.yt
    ELSE r.yt - r.yc * r.nt / CAST(d.x - r.nt AS DOUBLE) END AS DOUBLE) AS uplift
  FROM {name}_nodes d LEFT JOIN {name}_rows r ON r.{by} = d.{by} AND r.i = d.x)"""


SCORED_RUN = "scored_run AS (SELECT *, 0 AS grp FROM scored)"

# ---- sources ----

FEATURE_COLS = f"recency, {r6('history', 'history')}, newbie"
ORACLE["load_campaign"] = with_campaign(
    f"SELECT ID, segment, treatment, visit, {FEATURE_COLS}, history_segment, channel, zip_code FROM campaign")
ORACLE["join_on_id"] = with_campaign(f"SELECT ID, {FEATURE_COLS}, visit, segment FROM campaign")
ORACLE["write_read_table"] = with_campaign(f"SELECT ID, segment, {FEATURE_COLS} FROM campaign")
ORACLE["sketched_percentiles"] = """SELECT feature, name, true AS within
FROM (VALUES ('recency'), ('history'), ('newbie')) f(feature), (VALUES ('p10'), ('p20'), ('p80'), ('p90')) q(name)"""
ORACLE["scan_with_quarantine"] = f"""WITH {TRIAL_SQL}
SELECT ID, CASE WHEN ID % 100 <> 0 THEN segment END AS segment, CASE WHEN ID % 100 <> 0 THEN recency END AS recency,
  CASE WHEN ID % 100 <> 0 THEN round(CAST(history AS DOUBLE), 6) + 0.0 END AS history, CASE WHEN ID % 100 = 0 THEN 'type of history' ELSE '' END AS faults
FROM campaign"""
ORACLE["resume_grid"] = with_scored(
    f"""SELECT run_id, {RESULT_COLUMNS} FROM results
UNION ALL
SELECT run_id, {RESULT_COLUMNS} FROM (SELECT * REPLACE ('other' AS model) FROM results WHERE run_id = {SMALL_RUNS[0].run_id})""",
    *SMALL_GRID)
ORACLE["read_results"] = with_scored(f"SELECT {RESULT_COLUMNS} FROM results", *SMALL_GRID)

# ---- preparation ----

ORACLE["binarize_treatment"] = with_campaign(
    "SELECT ID, segment, CASE WHEN segment = '1-URGENT' THEN 1 ELSE 0 END AS treatment FROM trial")
ORACLE["map_treatment"] = with_campaign(
    "SELECT ID, segment, CASE WHEN segment IN ('1-URGENT','2-HIGH') THEN 1 WHEN segment = '5-LOW' THEN 0 END "
    "AS treatment FROM trial")
ORACLE["class_label"] = with_campaign(
    "SELECT ID, treatment, visit, CASE WHEN treatment = visit THEN 1 ELSE 0 END AS label FROM campaign")
ORACLE["exclude_arm"] = with_campaign("SELECT ID, segment FROM campaign")
ORACLE["map_ordinal"] = with_campaign(
    "SELECT ID, CASE history_segment WHEN '1) low' THEN 50 WHEN '2) mid' THEN 175 ELSE 1000 END AS history_segment "
    "FROM campaign")
CHANNELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
ONE_HOT = ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\""
    for c, vs in (("zip_code", REGIONS), ("channel", CHANNELS)) for v in vs
)
ORACLE["one_hot"] = with_campaign(f"SELECT ID, {ONE_HOT} FROM campaign")
ORACLE["assign_id"] = with_campaign(
    "SELECT ID AS order_id, recency, row_number() OVER (ORDER BY recency, campaign.ID) - 1 AS ID FROM campaign")
ORACLE["select_features"] = with_campaign(
    f"SELECT ID, {FEATURE_COLS}, history_segment, channel, zip_code FROM campaign")
ORACLE["select_features_by_prefix"] = with_campaign(
    f"SELECT ID, {r6('history', 'history')}, history_segment FROM campaign")
ORACLE["relative_drop"] = with_campaign(
    f"SELECT ID, {r6('history', 'history')}, CAST(recency AS DOUBLE) AS recency, "
    f"{r6('(history - recency) / nullif(history, 0)', 'delta_qini')} FROM campaign")

# ---- actions ----

ORACLE["eligible"] = with_campaign(
    "SELECT ID, CAST(newbie = 0 AS INT) AS newbie_0, CAST(recency > 40 AS INT) AS recency_gt, "
    "CAST(recency < 2 AS INT) AS recency_lt FROM campaign")
ORACLE["attack_set"] = with_campaign("SELECT ID, CAST(1 AS DOUBLE) AS newbie FROM campaign WHERE newbie = 0")
ORACLE["attack_add"] = with_campaign("SELECT ID, CAST(recency + 9 AS DOUBLE) AS recency FROM campaign WHERE recency < 2")
ORACLE["attack_sub_floor"] = with_campaign(
    "SELECT ID, CAST(greatest(recency - 60, 0) AS DOUBLE) AS recency FROM campaign WHERE recency > 40")

# ---- sampling ----

HASHED = "hashed AS (SELECT ID, row_number() OVER (ORDER BY md5('42:' || CAST(ID AS VARCHAR))) AS place FROM campaign)"
ORACLE["sample_exact"] = with_campaign(
    f", {HASHED} SELECT ID FROM hashed WHERE place <= (SELECT floor(CAST(count(*) AS DOUBLE) * 0.1) FROM campaign)")
ORACLE["sample_k"] = with_campaign(f", {HASHED} SELECT ID FROM hashed WHERE place <= 1000")
ORACLE["head_by"] = with_campaign("SELECT ID, recency FROM campaign ORDER BY ID LIMIT 500")
ORACLE["stratified_split"] = with_campaign(""",
sizes AS (SELECT segment, count(*) AS n FROM campaign GROUP BY segment),
shares AS (SELECT segment, n * ceil(sum(n) OVER () * CAST(0.3 AS DOUBLE)) / CAST(sum(n) OVER () AS DOUBLE) AS exact,
  ceil(sum(n) OVER () * CAST(0.3 AS DOUBLE)) AS wanted FROM sizes),
quotas AS (SELECT segment, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, segment)
  <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
hashed AS (SELECT ID, segment, row_number() OVER (PARTITION BY segment ORDER BY md5('42:' || CAST(ID AS VARCHAR))) AS place
  FROM campaign)
SELECT ID, h.segment, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS side
FROM hashed h JOIN quotas q ON q.segment = h.segment""")
SEEDS = ", ".join(f"({i}, {s})" for i, s in enumerate(smp.seed_list(20)))
ORACLE["prepare_campaign"] = with_campaign(""",
sizes AS (SELECT segment, count(*) AS n FROM campaign GROUP BY segment),
shares AS (SELECT segment, n * ceil(sum(n) OVER () * CAST(0.3 AS DOUBLE)) / CAST(sum(n) OVER () AS DOUBLE) AS exact,
  ceil(sum(n) OVER () * CAST(0.3 AS DOUBLE)) AS wanted FROM sizes),
quotas AS (SELECT segment, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, segment)
  <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
hashed AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5('42:' || CAST(ID AS VARCHAR))) AS place
  FROM campaign),
flagged AS (SELECT h.*, q.quota, h.treatment AS t FROM hashed h JOIN quotas q ON q.segment = h.segment)
SELECT ID, segment, visit, recency, round(history, 6) + 0.0 AS history,
  CASE history_segment WHEN '1) low' THEN 50 WHEN '2) mid' THEN 175 ELSE 1000 END AS history_segment, newbie,
""" + ONE_HOT + """, t AS treatment, CASE WHEN t = visit THEN 1 ELSE 0 END AS label,
  CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS side FROM flagged""")
ORACLE["seed_grid"] = with_campaign(f""",
seeds AS (SELECT * FROM (VALUES {SEEDS}) AS v(run_id, seed)),
drawn AS (SELECT run_id, seed, ID,
    row_number() OVER (PARTITION BY run_id ORDER BY md5(CAST(seed AS VARCHAR) || ':' || CAST(ID AS VARCHAR))) AS place,
    floor(CAST(count(*) OVER (PARTITION BY run_id) AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS k
  FROM campaign CROSS JOIN seeds WHERE newbie = 0)
SELECT run_id, seed, count(*) AS n, CAST(sum(ID) AS BIGINT) AS id_sum FROM drawn WHERE place <= k
GROUP BY run_id, seed""")
ORACLE["apply_action"] = with_scored(
    f"SELECT ID, CAST(recency AS DOUBLE) AS recency, {r6('history', 'history')}, CAST(newbie AS DOUBLE) AS newbie, "
    "aca_flag FROM changed", recency_action())

ORACLE["participants"] = with_scored(
    f"SELECT ID, {r6('history', 'history')}, aca_flag FROM changed WHERE aca_flag = 1", history_action())

# ---- ranking ----

ORACLE["dense_rank"] = with_scored("SELECT ID, uplift, dense_rank() OVER (ORDER BY uplift DESC) AS rank FROM scored")
ORACLE["normalised_rank"] = with_scored(
    f"SELECT ID, uplift, {r6('rank / CAST(max(rank) OVER () AS DOUBLE)', 'normalised_rank')} "
    "FROM (SELECT ID, uplift, dense_rank() OVER (ORDER BY uplift DESC) AS rank FROM scored)")
ORACLE["ranking_positions"] = with_scored(
    "SELECT ID, uplift, row_number() OVER (ORDER BY uplift DESC, ID) - 1 AS position FROM scored")
ORACLE["cumulative_responses"] = with_scored("""
SELECT position, CAST(yc AS BIGINT) AS responses_control, CAST(yt AS BIGINT) AS responses_treated,
  CAST(position - nt AS BIGINT) AS n_control, CAST(nt AS BIGINT) AS n_treated FROM (
  SELECT row_number() OVER w AS position, sum(treatment) OVER w AS nt, sum(treatment * visit) OVER w AS yt,
    sum((1 - treatment) * visit) OVER w AS yc FROM scored
  WINDOW w AS (ORDER BY uplift DESC, treatment DESC, visit DESC ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT 0, 0, 0, 0)""")
ORACLE["uplift_curve"] = with_scored(
    f"SELECT node, x, {r6('uplift', 'uplift')} FROM curve", SCORED_RUN, curve_ctes("scored_run", "uplift", "grp"))
QINI = qini_ctes("scored_run", "uplift", "grp")
ORACLE["qini_curve"] = with_scored(
    f"SELECT x, {r6('v', 'value')} FROM q_points UNION ALL SELECT 0, 0.0", SCORED_RUN, QINI)
ORACLE["perfect_qini_curve"] = with_scored(
    f"SELECT x, {r6('v', 'value')} FROM q_best_points UNION ALL SELECT 0, 0.0", SCORED_RUN, QINI)
ORACLE["qini_auc"] = with_scored(f"SELECT {r6('qini_coeff', 'qini_coeff')} FROM q_auc", SCORED_RUN, QINI)
ORACLE["qini_auc_by_segment"] = with_scored(
    f"SELECT zip_code, {r6('qini_coeff', 'qini_coeff')} FROM q_auc",
    f"regional AS (SELECT zip_code, treatment, visit, {score_sql()} AS uplift FROM campaign)",
    qini_ctes("regional", "uplift", "zip_code"))
RESPONSES = """responses AS (SELECT CAST(sum(treatment * visit) AS BIGINT) AS responses_treated,
  coalesce(CAST(sum((1 - treatment) * visit) * sum(treatment) AS DOUBLE) / nullif(sum(1 - treatment), 0), 0) AS rescaled,
  count(*) AS n FROM scored)"""
ORACLE["number_responses"] = with_scored(
    f"SELECT responses_treated, {r6('rescaled', 'rescaled_responses_control')}, n FROM responses", RESPONSES)
ORACLE["random_baseline"] = with_scored(
    f"SELECT n AS x, {r6('responses_treated - rescaled', 'uplift')} FROM responses UNION ALL SELECT 0, 0.0", RESPONSES)

# ---- experiments ----

ORACLE["rank_after_action_formula"] = with_scored(
    f"SELECT ID, CAST(recency_before AS INT) AS recency, CAST(newbie_before AS INT) AS newbie, "
    f"{r6('rank_before', 'normalised_rank')}, {r6('uplift_before', 'uplift')}, "
    f"{r6('rank_after', 'normalised_rank_modified')}, {r6('uplift_after', 'uplift_modified')}, aca_flag FROM compared",
    recency_action())
ORACLE["compare_ranking"] = with_scored(
    f"SELECT ID, {r6('history_before', 'history')}, {r6('rank_before', 'normalised_rank')}, "
    f"{r6('uplift_before', 'uplift')}, {r6('rank_after', 'normalised_rank_modified')}, "
    f"{r6('uplift_after', 'uplift_modified')}, aca_flag FROM compared", history_action())
ORACLE["summarise_participants"] = with_scored(
    f"SELECT n AS num_participants, {r6('avg_before', 'avg_normalised_rank')}, "
    f"{r6('median_before', 'median_normalised_rank')}, {r6('avg_after', 'avg_modified_normalised_rank')}, "
    f"{r6('median_after', 'median_modified_normalised_rank')}, {r6(CI_LOW, 'ci_low')}, {r6(CI_HIGH, 'ci_high')} "
    "FROM moved", recency_action(), MOVED)
ORACLE["paired_t_interval"] = with_scored(
    f"SELECT n, {r6('mean_diff', 'mean_diff')}, {r6('se', 'se_diff')}, {r6(CI_LOW, 'ci_low')}, "
    f"{r6(CI_HIGH, 'ci_high')} FROM moved", recency_action(), MOVED)
ORACLE["run_experiment"] = with_scored(
    f"SELECT {RESULT_COLUMNS} FROM results", recency_action(), results_cte("recency"))
ORACLE["run_grid"] = with_scored(
    f"SELECT run_id, {RESULT_COLUMNS} FROM results", recency_action(keys(GRID_RUNS)), results_cte("recency"))
ORACLE["aggregate_experiments"] = with_scored(
    "SELECT " + ", ".join(r6(c, c) for c in AGG_DOUBLES) + f", dataset, model, target_feature, {r6('frac', 'frac')} "
    "FROM agg", *SMALL_GRID, AGG)
GRID_VALUES = ", ".join(f"(CAST({f!r} AS DOUBLE))" for f in GRID_FRACTIONS)
ORACLE["missing_cells"] = with_scored(
    f"SELECT DISTINCT r.dataset, r.target_feature, r.model, {r6('g.frac', 'frac')} "
    f"FROM results r CROSS JOIN (VALUES {GRID_VALUES}) AS g(frac) "
    "WHERE round(g.frac, 4) NOT IN (SELECT round(frac, 4) FROM results)", *SMALL_GRID)
ORACLE["with_origin"] = with_scored(
    f"SELECT dataset, target_feature, model, {r6('frac', 'frac')}, "
    + ", ".join(r6(c, c) for c in ("avg_delta_qini", "avg_ci_low", "avg_ci_high"))
    + " FROM agg UNION ALL SELECT DISTINCT dataset, target_feature, model, 0.0, 0.0, 0.0, 0.0 FROM agg",
    *SMALL_GRID, AGG)
ORACLE["rank_decrease_series"] = with_scored(
    f"SELECT dataset, target_feature, model, {r6('frac', 'frac')}, "
    f"{r6('(avg_ci_low + avg_ci_high) / 2', 'avg_rank_decrease')}, {r6('avg_ci_low', 'ci_low')}, "
    f"{r6('avg_ci_high', 'ci_high')} FROM agg UNION ALL "
    "SELECT DISTINCT dataset, target_feature, model, 0.0, 0.0, 0.0, 0.0 FROM agg", *SMALL_GRID, AGG)
ORACLE["band"] = with_scored(
    f"SELECT {r6('frac', 'frac')}, {r6('avg_delta_qini', 'avg_delta_qini')}, {r6('std_delta_qini', 'std_delta_qini')}, "
    f"{r6('avg_delta_qini - std_delta_qini', 'lower')}, {r6('avg_delta_qini + std_delta_qini', 'upper')} FROM agg"
    .replace("AS lower", 'AS "lower"').replace("AS upper", 'AS "upper"'), *SMALL_GRID, AGG)
ORACLE["distinct_series"] = with_scored("SELECT DISTINCT dataset, target_feature, model FROM results", *SMALL_GRID)

# ---- distributions ----

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM campaign" for c in ("recency", "history", "newbie")
) + ")"
STATS = """stats AS (SELECT feature, count(DISTINCT value) AS n_unique, min(value) AS mn, max(value) AS mx,
  quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.2) AS p20, quantile_cont(value, 0.8) AS p80,
  quantile_cont(value, 0.9) AS p90 FROM long GROUP BY feature)"""
ORACLE["is_categorical"] = with_scored(
    "SELECT feature, n_unique, n_unique <= 10 AS categorical FROM stats", LONG, STATS)
ORACLE["feature_percentiles"] = with_scored(
    "SELECT feature, " + ", ".join(r6(p, p) for p in ("p10", "p20", "p80", "p90")) + " FROM stats", LONG, STATS)
ORACLE["density_histogram"] = with_scored(
    f"SELECT bin, {r6('bin_start', 'bin_start')}, count, {r6('count / (total * width)', 'density')} FROM hist",
    "series AS (SELECT 0 AS grp, uplift AS value FROM scored)", histogram_ctes("series", "grp"))
SERIES = "series AS (" + " UNION ALL ".join(
    f"SELECT '{m}_{g}/{p}' AS grp, {col} AS value FROM compared{cond}"
    for m, cols in (("rank", ("rank_before", "rank_after")), ("uplift", ("uplift_before", "uplift_after")))
    for p, col in zip(("before", "after"), cols)
    for g, cond in (("all", ""), ("participants", " WHERE aca_flag = 1"))
) + ")"
ORACLE["compare_distributions"] = with_scored(
    f"SELECT split_part(grp, '/', 1) AS series, split_part(grp, '/', 2) AS phase, bin, {r6('bin_start', 'bin_start')}, "
    f"count, {r6('count / (total * width)', 'density')} FROM hist",
    recency_action(), SERIES, histogram_ctes("series", "grp"))
PLACES = """places AS (
  SELECT 'before' AS grp, aca_flag, row_number() OVER (ORDER BY uplift_before DESC, ID) - 1 AS value FROM compared
  UNION ALL
  SELECT 'after', aca_flag, row_number() OVER (ORDER BY uplift_after DESC, ID) - 1 FROM compared),
stood AS (SELECT grp, CAST(value AS DOUBLE) AS value FROM places WHERE aca_flag = 1),
edges AS (SELECT grp, 0.0::DOUBLE AS low, CAST(count(*) AS DOUBLE) AS high, count(*) AS total FROM places GROUP BY grp)"""
ORACLE["position_histogram"] = with_scored(
    f"SELECT bin, {r6('bin_start', 'bin_start')}, count FROM hist WHERE grp = 'after'",
    recency_action(), PLACES, bin_ctes("stood", "grp", 200))
ORACLE["before_after_formula"] = with_scored(
    f"SELECT {r6('b.qini_coeff', 'qini_before')}, {r6('a.qini_coeff', 'qini_after')}, "
    f"{r6('a.qini_coeff - b.qini_coeff', 'qini_change')} FROM before_auc b CROSS JOIN after_auc a", history_action())
PHASES = """phases AS (
  SELECT 'before' AS phase, treatment, visit, uplift_before AS score FROM compared
  UNION ALL SELECT 'after', treatment, visit, uplift_after FROM compared)"""
ORACLE["ranking_comparison"] = with_scored(
    f"""SELECT 'curve_' || phase AS series, node AS item, CAST(x AS DOUBLE) AS x, {r6('uplift', 'value')} FROM curve
UNION ALL SELECT 'participants_' || grp, bin, {r6('bin_start', 'bin_start')}, CAST(count AS DOUBLE) FROM hist
UNION ALL SELECT 'random', 0, 0.0, 0.0
UNION ALL SELECT 'random', 1, CAST(n AS DOUBLE), {r6('responses_treated - rescaled', 'value')} FROM responses""",
    recency_action(), PHASES, curve_ctes("phases", "score", "phase"), PLACES, bin_ctes("stood", "grp", 200), RESPONSES)
ORACLE["compare_models_formula"] = with_scored(
    f"SELECT c.model, node, x, {r6('uplift', 'uplift')}, {r6('qini_coeff', 'qini_coeff')} "
    "FROM curve c JOIN q_auc q ON q.model = c.model",
    """models AS (SELECT 'formula' AS model, treatment, visit, uplift AS score FROM scored
  UNION ALL SELECT 'recency', treatment, visit, CAST(-recency AS DOUBLE) FROM scored)""",
    curve_ctes("models", "score", "model"), qini_ctes("models", "score", "model"))

# ---- reports ----

TERMS = {
    "recency": "CAST(-recency AS DOUBLE)", "history": "floor(history / 5000) * 10",
    "newbie": "CAST(newbie * 50 AS DOUBLE)", "treatment": "CAST(0 AS DOUBLE)",
}
ATTRIBUTIONS = "terms AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {t} AS term FROM campaign" for c, t in TERMS.items()
) + """),
long AS (SELECT feature, value, term - avg(term) OVER (PARTITION BY feature) AS phi FROM terms)"""


def strategy_sql(corr: str) -> str:
    """Proposal text, from and to for a correlation expression over `stats` s."""
    up = f"coalesce({corr} > 0, false)"
    modify = (f"'Modify ' || s.feature || ' from ' || CAST(CASE WHEN {up} THEN mn ELSE mx END AS VARCHAR) || ' to ' || "
              f"CAST(CASE WHEN {up} THEN mx ELSE mn END AS VARCHAR)")
    shift = (f"CASE WHEN {up} THEN 'Increase ' || s.feature || ' by ' || printf('%.2f', p90 - p10) || "
             f"' for values below ' || printf('%.2f', p20) ELSE 'Decrease ' || s.feature || ' by ' || "
             f"printf('%.2f', p90 - p10) || ' for values above ' || printf('%.2f', p80) END")
    none = f"coalesce({corr} = 0, false)"
    start = f"CASE WHEN {none} THEN NULL WHEN n_unique <= 10 THEN CASE WHEN {up} THEN mn ELSE mx END " \
            f"WHEN {up} THEN p10 ELSE p90 END"
    end = f"CASE WHEN {none} THEN NULL WHEN n_unique <= 10 THEN CASE WHEN {up} THEN mx ELSE mn END " \
          f"WHEN {up} THEN p90 ELSE p10 END"
    return (f"CASE WHEN {none} THEN 'N/A (no correlation)' WHEN n_unique <= 10 THEN {modify} ELSE {shift} END "
            f"AS proposed_strategy, {r6(start, 'from_value')}, {r6(end, 'to_value')}")


ORACLE["feature_report"] = with_scored(
    f"""SELECT s.feature, {r6('mean_shap', 'mean_shap')}, {r6('importance', 'importance')}, {r6('corr', 'correlation')},
  CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS direction, {strategy_sql('corr')},
  CAST(row_number() OVER (ORDER BY corr DESC NULLS LAST, s.feature) AS INT) AS rank
FROM stats s JOIN impact i ON i.feature = s.feature""",
    ATTRIBUTIONS, STATS,
    """impact AS (SELECT feature, avg(phi) AS mean_shap, avg(abs(phi)) AS importance,
  covar_samp(value, phi) / nullif(stddev_samp(value) * stddev_samp(phi), 0) AS corr FROM long GROUP BY feature)""")
ORACLE["propose_action"] = with_scored(
    f"SELECT s.feature, CAST(c.corr AS DOUBLE) AS correlation, {strategy_sql('c.corr')} "
    "FROM stats s CROSS JOIN (VALUES (0.5), (-0.5), (0.0)) AS c(corr)", LONG, STATS)
