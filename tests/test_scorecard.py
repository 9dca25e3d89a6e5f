"""Scores of dimensions against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from marea.operators import scorecard as C
from marea.operators.designs import groups_of

R = random.Random(8)
ROWS = [(k // 20, R.randint(0, 9), R.randint(0, 5) + (k % 3), R.choice(["A", "B", "C"]), R.random() < 0.4, R.choice([-1, 0, 1]), R.choice(["EXACT", "RIGHT"]), float(R.randint(1, 9))) for k in range(800)]
SCHEMA = "block long, x int, y int, class string, out boolean, claim int, kind string, lower double"


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_effects_and_evidence(spark):
    df = spark.createDataFrame([*ROWS, (3, None, 1, None, None, 0, "INCONCLUSIVE", 0.0)], SCHEMA).withColumn("upper", F.lit(None).cast("double"))
    c = F.col
    whole, inside = C.censored(df, {"late": c("x")}, "block")
    sums = C.together(C.ordinal(df, {"rank": (c("x"), c("y"))}, "block"), C.agreement(df, {"sign": (c("claim"), c("y") - 3)}, "block"), C.contrast(df, {"class": (c("class"), "A", "B", c("out"))}, "block"), inside)
    got = {r.dimension: r for r in C.evidence(sums, replicates=60).collect()}
    x, y = (np.array([r[k] for r in ROWS]) for k in (1, 2))
    assert np.isclose(got["rank"].effect, np.corrcoef(ranks(x), ranks(y))[0, 1])
    signs = [r[5] * (r[2] - 3) for r in ROWS if r[5] * (r[2] - 3)]
    assert np.isclose(got["sign"].effect, np.mean(np.array(signs) > 0) - 0.5)
    share = lambda k: np.mean([r[4] for r in ROWS if r[3] == k])
    assert np.isclose(got["class"].effect, share("B") - share("A"))
    assert all(r.lo <= r.effect <= r.hi and r.support == "ADEQUATE" and r.failures == 0 for k, r in got.items())
    again = {r.dimension: (r.lo, r.hi) for r in C.evidence(sums.repartition(5), replicates=60).collect()}
    assert all(np.allclose(again[k], (r.lo, r.hi)) for k, r in got.items())
    assert whole.first().pairs > 0 and {r.dimension for r in C.effects(sums).collect()} == set(got)


def test_tied_columns():
    g = np.random.default_rng(1)
    a, b, c = g.normal(size=(3, 200))
    x = np.column_stack([np.ones(200), a, b, a + 2 * b, c, 3 * c, np.zeros(200)])
    assert groups_of(x.T @ x) == [[1, 2, 3], [4, 5]]
    x = np.column_stack([a, 2 * a, b, a - b, c])
    assert groups_of(x.T @ x) == [[0, 1, 2, 3]]
