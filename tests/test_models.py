"""The estimator chain, local dynamics and survival statistics against literal vectors, invariants and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marea.operators import models as M
from marea.operators.dynamics import expm, fit_windows
from marea.operators.folds import fold
from marea.operators.survival import block_bootstrap, concordance
from marea.streaming.stateful import stream_fold


def run(step, rows, **how):
    state, out = {}, []
    for row in rows:
        state, made = step(state, row, **how)
        out.append(made)
    return out


def tick(t, price, volume=10.0, quality=1.0):
    return {"t": float(t), "price": price, "volume": volume, "quality": quality}


def test_first_tick_is_at_rest():
    first = run(M.state_step, [tick(0, 100.0)])[0]
    assert (first["level"], first["velocity"], first["acceleration"], first["perturbation_class"], first["health"]) == (0.0, 0.0, 0.0, "NONE", "HEALTHY")
    usual = 0.95 + 0.05 * 10
    assert first["volume_influence"] == pytest.approx(math.log1p(10 / usual) + math.log1p(10) / 10)
    assert first["coherence"] == pytest.approx(1.0, abs=1e-6)
    # The uncertainty of an expected, coherent tick: 1 / (1 + e).
    assert first["uncertainty"] == pytest.approx(1 / (1 + math.e), abs=1e-6)


def test_state_stays_in_bounds_and_tells_its_health():
    r = random.Random(5)
    out = run(M.state_step, [tick(k, 100 + r.uniform(-3, 3), r.uniform(0, 50), r.choice([0.2, 1.0])) for k in range(300)])
    for x in out:
        assert all(0 <= x[k] <= 1 for k in ("coherence", "strength", "persistence", "uncertainty", "reversal", "perturbation"))
        assert 15 <= x["half_life"] <= 900 and 10 <= x["interval"] <= 600 and 0.001 <= x["rate"] <= 0.2
        assert abs(x["velocity"]) <= 50 and abs(x["acceleration"]) <= 200
    assert "STRUCTURAL/UNKNOWN" in {x["perturbation_class"] for x in out}
    gap = run(M.state_step, [tick(0, 1.0), tick(1, 1.0), tick(9, 1.0), tick(10, 1.0)])
    assert [x["health"] for x in gap] == ["HEALTHY", "HEALTHY", "DEGRADED_DATA", "DEGRADED_DATA"]
    bad = run(M.state_step, [tick(0, 1.0), tick(1, None), tick(2, math.nan), tick(3, 1.0)])
    assert [x["health"] for x in bad] == ["HEALTHY", "INVALID", "INVALID", "HEALTHY"] and bad[1]["level"] is None


@pytest.mark.parametrize(
    "residual, level, velocity, now, kind",
    [(1.0, 1.0, 0.0, 1.0, "REINFORCING"), (-1.0, 1.0, 0.0, 0.5, "CONTRADICTING"), (-1.0, 1.0, 0.0, -0.5, "REVERSING"), (1.0, 0.0, 0.0, 1.0, "STRUCTURAL/UNKNOWN"), (0.0, 0.0, 1.0, 2.0, "REINFORCING")],
)
def test_perturbations(residual, level, velocity, now, kind):
    assert M.perturbation_of(0.5, residual, 1.0, level, velocity, now) == kind
    assert M.perturbation_of(1e-5, residual, 1.0, level, velocity, now) == "NONE"
    assert M.perturbation_of(0.5, residual, 0.4, level, velocity, now) == "STRUCTURAL/UNKNOWN"


def shape(t, at=None, score=0.9, direction="UPWARD", eligible=True, valid=True):
    return {"t": float(t), "at": float(t if at is None else at), "interval": 10.0, "direction": direction, "score": score, "valid": valid, "eligible": eligible}


def test_envelope():
    out = run(M.envelope_step, [shape(0), shape(1), shape(2), shape(2, 3), shape(4), shape(5, score=0.5), shape(6, score=0.55), shape(7)])
    assert [x["state"] for x in out] == ["OPENING", "OPENING", "OPEN", "OPEN", "OPEN", "CLOSING", "CLOSED", "OPENING"]
    assert out[2]["candidate"] == "QUALIFIED" and out[2]["candidate_since"] == 2.0 and "ENVELOPE_OPENED" in out[2]["events"]
    assert out[3]["events"][0] == "CONTEXT_REEVALUATED" and out[3]["candidate_since"] == 2.0
    assert "CANDIDATE_INVALIDATED" in out[4]["events"] and "CANDIDATE_QUALIFIED" in out[4]["events"] and out[4]["candidate_since"] == 4.0
    assert out[5]["candidate"] is None and "CANDIDATE_INVALIDATED" in out[5]["events"] and out[0]["aperture"] == pytest.approx(0.45)
    unsafe = run(M.envelope_step, [shape(0), shape(1), shape(2), shape(2, 20), shape(30, eligible=False), shape(31, eligible=None), shape(32, valid=False)])
    assert [x["safety"] for x in unsafe[3:]] == ["SHAPE_STALE", "MARKET_INELIGIBLE", None, "INVALID_RETURNSHAPE"]
    assert unsafe[3]["state"] == "CLOSED" and unsafe[3]["aperture"] == 0 and unsafe[3]["candidate"] == "INVALIDATED" and "ENVELOPE_CLOSED" in unsafe[3]["events"]


def test_colours():
    price = lambda colours: [x["colour"] for x in run(M.price_colour_step, [{"session": "d", "raw_colour": c} for c in colours])]
    assert price(["GREEN", "RED", "RED", "AMBER", "GREEN"]) == ["GREEN", "AMBER", "RED", "AMBER", "GREEN"]
    assert price(["GREEN", "RED", "GREEN"]) == ["GREEN", "AMBER", "GREEN"]
    volume = run(M.volume_colour_step, [{"session": s, "activity": a} for s, a in (("d", 2.0), ("d", 0.5), ("d", 0.5), ("d", 2.0), ("d", 1.0), ("e", 0.1), ("e", None))])
    assert [x["colour"] for x in volume] == ["GREEN", "AMBER", "RED", "AMBER", "AMBER", "RED", "INVALID"]
    assert [x["change"] for x in volume[:4]] == ["STABLE", "PENDING_RED", "CONFIRMED_RED", "PENDING_GREEN"]


def test_cockpit():
    row = lambda p1, p2, q1, caution=False: {"session": "d", "p1": p1, "p2": p2, "q1": q1, "caution": caution}
    out = run(M.cockpit_step, [row(1.0, 0.1, 1.1), row(1.0, -1.2, -0.2), row(1.0, 0.1, 1.1), row(1.0, 0.1, 1.1), row(-1.0, -0.1, -1.1), row(-1.0, -0.1, -1.1), row(0.0, 0.0, 0.0), row(-1.0, -0.1, -1.1, True), row(None, 0.0, 0.0)])
    assert [x["colour"] for x in out] == ["GREEN", "AMBER", "AMBER", "GREEN", "AMBER", "RED", "AMBER", "AMBER", "INVALID"]
    assert [x["motion"] for x in out[:6]] == ["UP_ACCELERATING", "TURN_DOWN_CANDIDATE", "TURN_DOWN_CANDIDATE", "UP_ACCELERATING", "DIRECTION_CHANGE_TRANSITION", "DOWN_ACCELERATING"]
    assert [x["turn_age"] for x in out[:4]] == [0, 1, 2, 0] and out[7]["motion"] == "UNCERTAIN"
    slow = run(M.cockpit_step, [row(1.0, -0.8, 0.2), row(1.0, -0.8, 0.2)])
    assert [(x["turn"], x["opposing_rows"]) for x in slow] == [("NONE", 1), ("DOWN", 2)]


def test_exponential_and_fit():
    a = np.array([[[0.0, 3.0], [-3.0, 0.0]], [[1.0, 0.0], [0.0, -40.0]], [[0.0, 0.0], [0.0, 0.0]]])
    want = np.array([[[math.cos(3), math.sin(3)], [-math.sin(3), math.cos(3)]], [[math.e, 0], [0, math.exp(-40)]], [[1, 0], [0, 1]]])
    assert np.allclose(expm(a), want, atol=1e-9)
    r = np.random.default_rng(1)
    x = r.normal(size=(5, 15, 3))
    j = 0.5 + x @ np.array([0.1, -0.2, -0.3])
    made = fit_windows(x[..., 0], x[..., 1], x[..., 2], j)
    assert np.allclose(made["a"], 0.5) and np.allclose(made["b0"], 0.1) and np.allclose(made["b1"], -0.2) and np.allclose(made["b2"], -0.3)
    # One row ahead by many small Euler steps of the same law.
    s, h = x[0, -1].copy(), 1e-5
    for _ in range(100_000):
        s = s + h * np.array([s[1], s[2], 0.5 + s @ np.array([0.1, -0.2, -0.3])])
    assert np.allclose([made["next_p"][0], made["next_p1"][0], made["next_p2"][0]], s, atol=1e-3)
    x[0, :, 1] = 2.0
    assert np.isnan(fit_windows(x[..., 0], x[..., 1], x[..., 2], j)["a"]).tolist() == [True] + [False] * 4
    shrunk = fit_windows(x[1:, :, 0], x[1:, :, 1], x[1:, :, 2], j[1:], ridge=50.0)
    assert (np.abs(shrunk["b2"]) < 0.3).all()


def test_concordance_is_brute_force(spark):
    r = random.Random(9)
    rows = [("k", r.randint(0, 4), kind, low, low + r.randint(1, 3) if kind == "INTERVAL" else None) for low, kind in ((r.randint(1, 8), r.choice(["EXACT", "EXACT", "INTERVAL", "RIGHT"])) for _ in range(80))]
    pairs = score = 0.0
    for a, b in itertools.permutations(rows, 2):
        end = a[3] if a[2] == "EXACT" else a[4]
        if end is not None and b[3] > end:
            pairs, score = pairs + 1, score + (b[1] > a[1]) + 0.5 * (b[1] == a[1])
    ties = sum(a[2] == b[2] == "EXACT" and a[3] == b[3] for a, b in itertools.combinations(rows, 2))
    df = spark.createDataFrame([*rows, ("k", None, "EXACT", 3, None), ("lone", 1, "RIGHT", 3, None)], "g string, x int, kind string, low int, up int")
    got = {x.g: x for x in concordance(df, "g", "x", "kind", "low", "up").collect()}
    assert got["k"].pairs == pairs + ties and got["k"].concordance == pytest.approx((score + ties / 2) / (pairs + ties)) and "lone" not in got


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", k // 5, float(k % 5)) for k in range(100)] + [("b", k, float(k % 2)) for k in range(40)], "g string, b int, x double")
    one, two = ({r.g: r for r in block_bootstrap(d, "g", "b", F.col("x"), replicates=300).collect()} for d in (df, df.repartition(7)))
    assert one == two and (one["a"].lo, one["a"].hi, one["a"].blocks) == (2.0, 2.0, 20)  # blocks that are all alike
    assert 0.3 < one["b"].lo < 0.45 and 0.55 < one["b"].hi < 0.7 and one["b"].mean == 0.5


def test_state_model_streams_as_it_folds(spark, tmp_path):
    r = random.Random(2)
    rows = [(e, s, float(3 * s), None if s == 7 else r.uniform(90, 110), r.uniform(0, 9), 1.0) for e in range(3) for s in range(1, 25)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, t double, price double, volume double, quality double")
    columns = ["t", "price", "volume", "quality"]
    batch = {(x.entity_id, x.seq): x for x in fold(df, M.state_step, columns, M.STATE_COLUMNS).collect()}
    for part, cond in enumerate(("seq <= 9", "seq > 9")):
        df.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = stream_fold(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*"), M.state_step, columns, M.STATE_COLUMNS)
    run_ = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run_.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(batch) and not any(x.late for x in got)
    for x in got:
        assert x.health == batch[x.entity_id, x.seq].health and x.half_life == batch[x.entity_id, x.seq].half_life
