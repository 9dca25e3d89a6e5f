"""Queries of local laws of motion: ridge and free fits, their stability and projections, and what policies make of them."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from ..operators.exact import quantiles
from ..operators.laws import FAMILIES, local_laws, many_laws
from ..operators.ordered import along, quadratic_fit
from ..sources.ticks import ticks
from .registry import TICKS, query

WINDOW, RIDGE = 20, 1.0


def r(x, digits):
    return F.round(x, digits).alias(x)


def derived(spark, sf):
    """Ticks with price and the first two derivatives of a parabola over 8 rows."""
    return quadratic_fit(ticks(spark, sf).withColumn("x", F.col("seq").cast("double")), "price", "x", 8)


def ridge_laws(spark, sf, tolerance=None):
    return local_laws(derived(spark, sf), WINDOW, "affine", RIDGE, tolerance)


def _pairs(names):
    return [(a, b) for k, a in enumerate(names) for b in names[k:]]


_X = ("price", "d1", "d2")
_W = f"(PARTITION BY entity_id ORDER BY seq ROWS {WINDOW - 1} PRECEDING)"
#: The law by normal equations: the constant stands apart, since standardised columns sum to 0; the slopes by Cramer's rule.
_LAW = TICKS + f""", y AS (SELECT entity_id, seq, price, list(price) OVER (PARTITION BY entity_id ORDER BY seq ROWS 7 PRECEDING) AS y FROM t),
  s AS (SELECT *, list_sum(list_transform(y, lambda v, i: (i - 8) * v)) AS xy, list_sum(list_transform(y, lambda v, i: (i - 8) * (i - 8) * v)) AS xxy, list_sum(y) AS sy FROM y),
  q AS (SELECT *, 8.0 AS n, -28.0 AS a, 140.0 AS b, -784.0 AS c, 4676.0 AS d FROM s WHERE seq >= 8),
  e AS (SELECT entity_id, seq, price, (n * (xy * d - c * xxy) - sy * (a * d - b * c) + b * (a * xxy - b * xy)) / (n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)) AS d1,
    2 * (n * (b * xxy - xy * c) - a * (a * xxy - xy * b) + sy * (a * c - b * b)) / (n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)) AS d2 FROM q),
  j AS (SELECT *, d2 - lag(d2) OVER (PARTITION BY entity_id ORDER BY seq) AS j FROM e),
  m AS (SELECT *, count(j) OVER w AS n, avg(j) OVER w AS mj, {', '.join(f'avg({x}) OVER w AS m_{x}, stddev_pop({x}) OVER w AS s_{x}, covar_pop({x}, j) OVER w AS r_{x}' for x in _X)},
    {', '.join(f'covar_pop({a}, {b}) OVER w AS c_{a}_{b}' for a, b in _pairs(_X) if a != b)} FROM j WINDOW w AS {_W}),
  z AS (SELECT *, {', '.join(f'{WINDOW} * c_{a}_{b} / (s_{a} * s_{b}) AS u_{a}_{b}' for a, b in _pairs(_X) if a != b)}, {WINDOW + RIDGE} AS g, {', '.join(f'{WINDOW} * r_{x} / s_{x} AS v_{x}' for x in _X)} FROM m WHERE n = {WINDOW} AND least({', '.join(f's_{x}' for x in _X)}) > 0),
  k AS (SELECT *, g * (g * g - u_d1_d2 * u_d1_d2) - u_price_d1 * (u_price_d1 * g - u_d1_d2 * u_price_d2) + u_price_d2 * (u_price_d1 * u_d1_d2 - g * u_price_d2) AS det,
    v_price * (g * g - u_d1_d2 * u_d1_d2) - u_price_d1 * (v_d1 * g - u_d1_d2 * v_d2) + u_price_d2 * (v_d1 * u_d1_d2 - g * v_d2) AS k0,
    g * (v_d1 * g - u_d1_d2 * v_d2) - v_price * (u_price_d1 * g - u_d1_d2 * u_price_d2) + u_price_d2 * (u_price_d1 * v_d2 - v_d1 * u_price_d2) AS k1,
    g * (g * v_d2 - v_d1 * u_d1_d2) - u_price_d1 * (u_price_d1 * v_d2 - v_d1 * u_price_d2) + v_price * (u_price_d1 * u_d1_d2 - g * u_price_d2) AS k2 FROM z),
  l AS (SELECT entity_id, seq, price, d1, d2, k0 / det / s_price AS b0, k1 / det / s_d1 AS b1, k2 / det / s_d2 AS b2, mj FROM k),
  f AS (SELECT l.*, l.mj - l.b0 * k.m_price - l.b1 * k.m_d1 - l.b2 * k.m_d2 AS a0 FROM l JOIN k USING (entity_id, seq)),
  w AS (SELECT *, a0 + b0 * price + b1 * d1 + b2 * d2 AS jerk FROM f)"""


@query(_LAW + " SELECT entity_id, seq, round(a0, 4) AS a, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(price + d1 + d2 / 2 + jerk / 6, 4) AS taylor_p, round(d1 + d2 + jerk / 2, 4) AS taylor_p1, round(d2 + jerk, 4) AS taylor_p2 FROM w")
def q_ridge_law(spark, sf):
    """The ridge law of the last 20 rows and its Taylor projection one row ahead."""
    return ridge_laws(spark, sf).select("entity_id", "seq", r("a", 4), *[r(f"b{k}", 5) for k in range(3)], *[r(f"taylor_{s}", 4) for s in ("p", "p1", "p2")])


_TERMS = 60
_AHEAD = "list_sum(list_transform(range(1, " + f"{_TERMS + 1}" + "), lambda i: {0}[i + {1}] * [" + ", ".join(repr(1 / factorial(k)) for k in range(_TERMS)) + "][i]))"
_SERIES = "list_reduce(list_concat([{0}], list_transform(range({1}), lambda i: [0.0::DOUBLE])), lambda s, i: list_append(s, b0 * s[len(s) - 2] + b1 * s[len(s) - 1] + b2 * s[len(s)]))"


@query(_LAW + ", d AS (SELECT *, " + ", ".join(f"{_SERIES.format(start, _TERMS)} AS {name}" for name, start in (("y", "[price, d1, d2, jerk]"), ("e0", "[1.0::DOUBLE, 0, 0]"), ("e1", "[0.0::DOUBLE, 1, 0]"), ("e2", "[0.0::DOUBLE, 0, 1]"))) + " FROM w) SELECT entity_id, seq, "
    + ", ".join(f"round({_AHEAD.format('y', k)}, 3) AS {s}" for k, s in enumerate(("p", "p1", "p2"))) + ", " + ", ".join(f"round(sqrt({' + '.join(f'pow({_AHEAD.format(e, k)}, 2)' for k in range(3))}), 4) AS amplified_{s}" for e, s in (("e0", "p"), ("e1", "p1"), ("e2", "p2"))) + " FROM d")
def q_rk_projection(spark, sf):
    """The ridge law followed for one row by the adaptive pair, against the series of its solution in SQL, and how much small changes grow."""
    d = ridge_laws(spark, sf, 1e-10)
    return d.select("entity_id", "seq", *[F.round(f"rk_{s}", 3).alias(s) for s in ("p", "p1", "p2")], *[r(f"amplified_{s}", 4) for s in ("p", "p1", "p2")])


@query()
def q_rk_domain(spark, sf):
    """Where projections leave the range of their window, in which coordinates, what they pass on the way and what they cost."""
    d = ridge_laws(spark, sf, 1e-6)
    return d.groupBy("exit_in", "event").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exit"), 4).alias("exit"), F.round(F.avg("event_time"), 4).alias("event_time"), F.round(F.max("distance"), 4).alias("distance"), F.round(F.avg("steps"), 3).alias("steps"), F.round(F.avg("evaluations"), 3).alias("evaluations"), F.count_if("failed").alias("failed"))


@query()
def q_rk_tolerances(spark, sf):
    """How far projections at each tolerance end from those of the tightest, and how many evaluations they take."""
    tolerances = (1e-3, 1e-4, 1e-6, 1e-8)  # a row's projections come from one fit, one after the other
    d = many_laws(derived(spark, sf), [("affine", WINDOW)], RIDGE, list(tolerances), ["rk_p2", "evaluations"])
    told = lambda x, t: F.max(F.when(F.col("tolerance") == t, F.col(x)))
    rows = d.groupBy("entity_id", "seq").agg(*[told(c, t).alias(f"{c}_{k}") for c in ("rk_p2", "evaluations") for k, t in enumerate(tolerances)])
    apart = [F.struct(F.lit(t).alias("tolerance"), F.col(f"rk_p2_{k}").alias("x"), F.col("rk_p2_3").alias("best"), F.col(f"evaluations_{k}").alias("evaluations")) for k, t in enumerate(tolerances)]
    off = F.abs(F.col("x") - F.col("best"))
    return rows.select(F.inline(F.array(*apart))).groupBy("tolerance").agg(F.count("x").alias("n"), F.max(off).alias("largest"), F.avg(off).alias("mean"), F.round(F.avg("evaluations"), 3).alias("evaluations"))


@query()
def q_law_families(spark, sf):
    """Each family and window without ridge: laws that could be fitted, their condition and the error of the second derivative one row ahead."""
    e = derived(spark, sf).withColumn("came", F.lead("d2").over(along("entity_id")))
    d = many_laws(e, [(f, w) for f in FAMILIES for w in (10, 15, 20)], wanted=["condition", "taylor_p2"], carry=["came"]).where("came IS NOT NULL AND condition <= 1e8")
    off = F.col("taylor_p2") - F.col("came")
    return d.groupBy("family", "window").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("bias"), F.max("condition").alias("condition"))


@query()
def q_law_time(spark, sf):
    """The five-parameter law, affine with time, of 15 rows: its projection by generator and pair, stability and first crossing."""
    d = local_laws(derived(spark, sf), 15, "time").where("condition <= 1e8")
    return d.select("entity_id", "seq", "condition", "growth", "radius", "exact_p2", "rk_p2", "event", "event_time", "failed")


@query()
def q_price_confidence(spark, sf):
    """HIGH, MEDIUM or LOW confidence in each projection: in its window's range, and condition, growth and amplification within their medians or 95 % quantiles over all."""
    d = many_laws(derived(spark, sf), [("affine", WINDOW)], RIDGE, [1e-6], ["condition", "growth", "amplified_p", "amplified_p1", "amplified_p2", "failed", "exit"])
    d = d.select("entity_id", "seq", "condition", "growth", F.greatest("amplified_p", "amplified_p1", "amplified_p2").alias("amplification"), "failed", "exit").persist()  # read by each limit and by the rows
    limits = None
    for c in ("condition", "growth", "amplification"):
        q = quantiles(d.withColumn("all", F.lit(1)), ["all"], c, {f"{c}_median": 0.5, f"{c}_q95": 0.95})
        limits = q if limits is None else limits.join(q, "all")
    within = lambda q: (F.col("condition") <= F.col(f"condition_{q}")) & (F.col("growth") <= F.col(f"growth_{q}")) & (F.col("amplification") <= F.col(f"amplification_{q}"))
    confidence = F.when(F.col("failed"), "INVALID").when(F.col("exit").isNotNull(), "LOW").when(within("median"), "HIGH").when(within("q95"), "MEDIUM").otherwise("LOW")
    return d.join(F.broadcast(limits.drop("all"))).select("entity_id", "seq", confidence.alias("confidence"), F.when(F.col("exit").isNull(), "IN_DOMAIN").otherwise("OUT_OF_DOMAIN").alias("domain"), F.when(F.col("growth") <= 0, "STABLE").otherwise("LOCALLY_EXPANSIVE").alias("stability"))  # limits: one row
