"""Local laws and the adaptive integrator against numpy, matrix exponentials and fine fixed steps."""

import numpy as np
import pytest

from marea.operators import laws as L


def windows(n=200, w=15, seed=3):
    g = np.random.default_rng(seed)
    return np.cumsum(g.normal(size=(n, w, 3)), 1), g.normal(size=(n, w)) / 10, np.tile(np.arange(1.0 - w, 1), (n, 1)) + g.random((n, w)) / 10


@pytest.mark.parametrize("family, ridge", [("affine", 0.0), ("affine", 1.0), ("time", 0.0), ("squares", 0.0), ("squares", 1.0)])
def test_fit_is_least_squares(family, ridge):
    x, j, t = windows()
    x[3, 4, 1] = np.nan
    x[5, :, 2] = 1.0
    at, laws = L.fit(x, j, t, family, ridge)
    assert set(range(200)) - set(at.tolist()) == {3, 5}
    for k, i in enumerate(at[:40]):
        z = (x[i] - x[i].mean(0)) / x[i].std(0)
        design = np.column_stack([np.ones(15), z, *([(t[i] - t[i].mean()) / t[i].std()] if family == "time" else []), *([z * z] if family == "squares" else [])])
        penalty = ridge * np.diag([0.0] + [1.0] * (design.shape[1] - 1))
        assert np.allclose(laws.beta[k], np.linalg.solve(design.T @ design + penalty, design.T @ j[i]), atol=1e-7) and np.isclose(laws.condition[k], np.linalg.cond(design))
        y, d = x[i, -1], 1e-5
        near = [(laws.at(np.array([k])).jerk(np.zeros(1), (y + d * e)[None]) - laws.at(np.array([k])).jerk(np.zeros(1), (y - d * e)[None]))[0] / (2 * d) for e in np.eye(3)]
        assert np.allclose(laws.slopes(x[at, -1])[k], near, atol=1e-6)


def test_windows_without_full_rank_have_no_law():
    x, j, t = windows(20)
    x[:, :, 2] = 2 * x[:, :, 0] + 1
    assert len(L.fit(x, j, t, "affine")[0]) == 0 and len(L.fit(x, j, t, "affine", 1.0)[0]) == 20
    assert len(L.fit(x[:0], j[:0], t[:0], "time")[0]) == 0


@pytest.mark.parametrize("family", ["affine", "time"])
def test_projection_follows_the_generator(family):
    x, j, t = windows()
    at, laws = L.fit(x, j, t, family, 1.0 if family == "affine" else 0.0)
    y = x[at, -1]
    got = L.project(laws, y, tolerance=1e-9)
    assert not got["failed"].any() and np.allclose(got["end"], laws.exact(y), atol=1e-7)
    for k in range(11):
        assert np.allclose(got["path"][:, k], laws.exact(y, k / 10), atol=1e-6)
    fine = np.stack([laws.exact(y, k / 2000)[:, 1] for k in range(2001)], 1)
    for k in range(len(at)):
        turns = np.flatnonzero(np.sign(fine[k, 1:]) != np.sign(fine[k, :-1]))
        if len(turns):
            assert abs(got["event_time"][k] - turns[0] / 2000) < 1e-3 and got["event"][k] == ("UPPER" if fine[k, turns[0]] > 0 else "LOWER")
        else:
            assert np.isnan(got["event_time"][k]) and got["event"][k] is None
    loose = L.project(laws, y, tolerance=1e-3)
    assert loose["steps"].mean() < got["steps"].mean() and 0 < np.abs(loose["end"] - got["end"]).max() < 0.1


def test_exits_and_distances_are_told_on_the_grid():
    x, j, t = windows(60)
    at, laws = L.fit(x, j, t, "affine", 1.0)
    got = L.project(laws, x[at, -1])
    for k in range(len(at)):
        path = got["path"][k]
        out = (path < laws.low[k]) | (path > laws.high[k])
        first = int(out.any(1).argmax()) if out.any() else None
        assert (np.isnan(got["exit"][k]) and got["exit_in"][k] is None) if first is None else (np.isclose(got["exit"][k], first / 10) and got["exit_in"][k] == "|".join(s for s, o in zip(L.STATE, out[first], strict=True) if o))
        assert np.isclose(got["distance"][k], np.linalg.norm((path - laws.mean[k]) / laws.scale[k], axis=1).max())


def test_one_failure_spoils_no_other_row():
    x, j, t = windows(40)
    at, laws = L.fit(x, j, t, "squares", 1.0)
    good = L.project(laws, x[at, -1])["end"]
    laws.beta[7, 4:] = 1e9  # explodes
    got = L.project(laws, x[at, -1])
    rest = np.arange(len(at)) != 7
    assert got["failed"].tolist() == [k == 7 for k in range(len(at))] and np.array_equal(got["end"][rest], good[rest]) and np.isnan(got["end"][7]).all()


def test_stability_of_a_known_law():
    laws = L.Fits("affine", np.array([[0.0, -6.0, -11.0, -6.0]]), np.zeros((1, 3)), np.ones((1, 3)), np.zeros((1, 3)), np.ones((1, 3)), np.zeros(1), np.ones(1), np.ones(1))
    got = L.stability(laws, np.zeros((1, 3)))  # eigenvalues -1, -2, -3
    assert np.isclose(got["growth"][0], -1) and np.isclose(got["radius"][0], 3)
    v = np.vander([-1.0, -2.0, -3.0], 3, increasing=True).T
    ahead = (v * np.exp([-1.0, -2.0, -3.0])) @ np.linalg.inv(v)
    assert np.allclose([got[f"amplified_{s}"][0] for s in L.STATE], np.linalg.norm(ahead, axis=0))


def test_local_laws_over_batches(spark):
    rows = [(e, s, float((s * 7919 + e * 31) % 97), float((s * 31) % 13), float((s * 17 + e) % 11)) for e in range(3) for s in range(60)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, price double, d1 double, d2 double")
    whole = {(r.entity_id, r.seq): r for r in L.local_laws(df, 15, "affine", 1.0).collect()}
    assert set(whole) == {(e, s) for e in range(3) for s in range(15, 60)}  # the first row has no third derivative
    assert all(abs(r.exact_p - r.rk_p) < 1e-3 for r in whole.values() if not r.failed)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = {(r.entity_id, r.seq): r for r in L.local_laws(df, 15, "affine", 1.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(again) == set(whole) and all(abs(again[k].rk_p - whole[k].rk_p) < 1e-6 for k in whole)
    squares = L.local_laws(df, 15, "squares", 1.0, tolerance=None).first()
    assert squares.exact_p is None and squares.rk_p is None and squares.failed is None
