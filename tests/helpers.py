"""Plain Python versions of the ranking measures, and small random trials."""

import random

from pyspark.sql import functions as F


def trial(spark, rows):
    """rows: (ID, uplift, treatment, visit)."""
    return spark.createDataFrame(rows, "ID long, uplift double, treatment int, visit int").repartition(3)


def random_rows(n, scores, seed):
    draw = random.Random(seed)
    return [(i, float(draw.randrange(scores)), draw.randrange(2), draw.randrange(2)) for i in range(n)]


def net(yt, yc, nt, nc):
    return yt - yc * nt / nc if nc else yt


def curve_by_walking(rows, nodes=None):
    order = sorted(((s, t, y) for _, s, t, y in rows), reverse=True)
    state, states = [0, 0, 0, 0], [(0, 0, 0, 0)]
    for _, t, y in order:
        state[1 if t else 0] += y
        state[3 if t else 2] += 1
        states.append(tuple(state))
    n = len(rows)
    k = nodes or min(n + 1, 201)
    xs = [n if i == k - 1 else int(i * (n / (k - 1))) for i in range(k)]
    return [(i, x, net(states[x][1], states[x][0], states[x][3], states[x][2])) for i, x in enumerate(xs)]


def qini_points(rows, score):
    points = [(0, 0.0)]
    for s in sorted({score(r) for r in rows}, reverse=True):
        top = [r for r in rows if score(r) >= s]
        nt = sum(r[2] for r in top)
        yt, yc = sum(r[2] * r[3] for r in top), sum((1 - r[2]) * r[3] for r in top)
        nc = len(top) - nt
        points.append((len(top), yt - yc * (nt / nc if nc else 0)))
    return points


def area(points):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


def qini_by_hand(rows):
    actual = qini_points(rows, lambda r: r[1])
    best = qini_points(rows, lambda r: r[3] * r[2] - r[3] * (1 - r[2]))
    base = best[-1][0] * best[-1][1] / 2
    return (area(actual) - base) / (area(best) - base) if area(best) != base else None


def uniform(k):
    """Hash-derived uniform numbers in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def planted_trial(spark, n=6000):
    """Treatment helps only where x1 > 0.5."""
    base = spark.range(n).select(
        F.col("id").alias("ID"), *[uniform(k).alias(f"x{k}") for k in range(1, 6)],
        (uniform(9) < 0.5).cast("int").alias("treatment"), uniform(10).alias("_u"),
    )
    chance = 0.2 + 0.5 * F.col("treatment") * (F.col("x1") > 0.5).cast("int")
    return base.withColumn("visit", (F.col("_u") < chance).cast("int")).drop("_u")
