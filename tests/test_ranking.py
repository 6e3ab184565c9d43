import pytest
from helpers import curve_by_walking, qini_by_hand, random_rows, trial
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swayrank.operators import ranking as rank

quick = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def curve(df, **options):
    return [tuple(r) for r in rank.uplift_curve(df, **options).orderBy("node").collect()]


def assert_curve(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


@quick
@given(seed=st.integers(0, 10**6), scores=st.sampled_from([1, 5, 400]), n=st.sampled_from([3, 250, 700]))
def test_curve_and_qini_equal_walking_all_rows(spark, seed, scores, n):
    rows = random_rows(n, scores, seed)
    df = trial(spark, rows)
    assert_curve(curve(df), curve_by_walking(rows))
    got, want = rank.qini_auc(df).first()["qini_coeff"], qini_by_hand(rows)
    assert (got is None) == (want is None)
    if want is not None:
        assert got == pytest.approx(want, abs=1e-9)


def test_given_number_of_nodes(spark):
    rows = random_rows(120, 30, 1)
    assert_curve(curve(trial(spark, rows), n_nodes=11), curve_by_walking(rows, 11))
    with pytest.raises(ValueError, match="two ends"):
        rank.uplift_curve(trial(spark, rows), n_nodes=1)


def test_qini_ignores_increasing_transforms_and_is_one_for_the_best_score(spark):
    df = trial(spark, random_rows(400, 50, 2))
    qini = rank.qini_auc(df).first()["qini_coeff"]
    assert rank.qini_auc(df.withColumn("uplift", F.exp(F.col("uplift") / 10))).first()["qini_coeff"] == pytest.approx(qini)
    best = df.withColumn("uplift", (F.col("visit") * (2 * F.col("treatment") - 1)).cast("double"))
    assert rank.qini_auc(best).first()["qini_coeff"] == pytest.approx(1.0)


def test_all_scores_equal(spark):
    rows = [(1, 5.0, 0, 1), (2, 5.0, 1, 0), (3, 5.0, 1, 1)]
    df = trial(spark, rows)
    assert [tuple(r) for r in rank.qini_curve(df).orderBy("x").collect()] == [(0, 0.0), (3, 1.0 - 1.0 * 2)]
    assert {r["normalised_rank"] for r in rank.normalised_rank(df).collect()} == {1.0}
    assert {r["rank"] for r in rank.dense_rank_desc(df).collect()} == {1}
    assert_curve(curve(df), [(0, 0, 0.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, -1.0)])


def test_without_control_rows(spark):
    df = trial(spark, [(1, 3.0, 1, 1), (2, 2.0, 1, 0), (3, 1.0, 1, 1)])
    assert [y for _, _, y in curve(df)] == [0.0, 1.0, 1.0, 2.0]
    assert tuple(rank.number_responses(df).first()) == (2, 0.0, 3)
    assert [tuple(r) for r in rank.random_baseline(df).orderBy("x").collect()] == [(0, 0.0), (3, 2.0)]


def test_no_responses_give_null_and_no_error(spark):
    df = trial(spark, [(1, 3.0, 1, 0), (2, 2.0, 0, 0)])
    assert rank.qini_auc(df).first()["qini_coeff"] is None


def test_perfect_curve_has_at_most_three_points(spark):
    df = trial(spark, [(1, 0.0, 1, 1), (2, 0.0, 1, 0), (3, 0.0, 0, 1), (4, 0.0, 0, 0)])
    assert [tuple(r) for r in rank.perfect_qini_curve(df).orderBy("x").collect()] == [
        (0, 0.0), (1, 1.0), (3, 1.0), (4, 0.0)]


def test_cumulative_responses_in_chunks(spark):
    rows = random_rows(60, 3, 4)
    got = [tuple(r) for r in rank.cumulative_responses(trial(spark, rows), chunk=7).orderBy("position").collect()]
    state, want = [0, 0, 0, 0], [(0, 0, 0, 0, 0)]
    for i, (_, t, y) in enumerate(sorted(((s, t, y) for _, s, t, y in rows), reverse=True), 1):
        state[1 if t else 0] += y
        state[3 if t else 2] += 1
        want.append((i, *state))
    assert got == want


def test_positions_follow_id_on_ties_and_ranks_count_greater_scores(spark):
    rows = random_rows(200, 12, 6)
    df = trial(spark, rows)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["ID"]: r["position"] for r in rank.ranking_positions(df).collect()}
    assert [got[r[0]] for r in order] == list(range(200))
    distinct = {r[1] for r in rows}
    for r in rank.dense_rank_desc(df).collect():
        assert r["rank"] == sum(s > r["uplift"] for s in distinct) + 1


def test_groups_are_ranked_apart(spark):
    a, b = random_rows(90, 10, 7), random_rows(30, 4, 8)
    df = trial(spark, a).withColumn("m", F.lit("a")).unionByName(trial(spark, b).withColumn("m", F.lit("b")))
    got = {r["m"]: r["qini_coeff"] for r in rank.qini_auc(df, by=["m"]).collect()}
    assert got == pytest.approx({"a": qini_by_hand(a), "b": qini_by_hand(b)})
    for m, rows in (("a", a), ("b", b)):
        part = rank.uplift_curve(df, by=["m"]).where(F.col("m") == m).drop("m").orderBy("node")
        assert_curve([tuple(r) for r in part.collect()], curve_by_walking(rows))


def test_a_score_that_a_third_of_all_rows_share(spark):
    """Ranks are right, and the rows of the hot score are spread over the join's partitions."""
    from swayrank.functions import joins

    rows = [(i, 5.0 if i % 3 == 0 else None if i % 50 == 1 else float(i), i % 2, i % 5 == 0) for i in range(6000)]
    df = trial(spark, [(i, s, t, int(y)) for i, s, t, y in rows])
    distinct = sorted({s for _, s, _, _ in rows if s is not None}, reverse=True)
    place = {s: n + 1 for n, s in enumerate(distinct)} | {None: len(distinct) + 1}
    found = {r["ID"]: r["rank"] for r in rank.dense_rank_desc(df).collect()}
    assert found == {i: place[s] for i, s, _, _ in rows}
    facts = spark.createDataFrame([(5.0, 2000, 1)] + [(float(i), 1, 2) for i in range(6, 4000)], "uplift double, n long, x int")
    text = joins.join_spread(df, facts, ["uplift"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text and text.count("Join") == 2
