"""Local laws of motion: fits of the third derivative over each window, their stability, and projections by an adaptive Runge-Kutta pair.

A law tells jerk = f(p, p1, p2, t) from the last rows, with its state standardised over the window. Families: affine in
the state; with time beside it; with the squares of the standardised state. All of a batch's windows are fitted and
integrated together, each with steps of its own, so one that fails spoils no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dynamics import expm
from .ordered import along

FAMILIES = ("affine", "time", "squares")
STATE = ("p", "p1", "p2")

# The Dormand-Prince pair of orders 5 and 4 and its interpolant of order 4.
_C = np.array([0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1])
_A = [
    [],
    [1 / 5],
    [3 / 40, 9 / 40],
    [44 / 45, -56 / 15, 32 / 9],
    [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729],
    [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656],
]
_B = np.array([35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84])
_E = np.array([-71 / 57600, 0, 71 / 16695, -71 / 1920, 17253 / 339200, -22 / 525, 1 / 40])
_P = np.array([
    [1, -8048581381 / 2820520608, 8663915743 / 2820520608, -12715105075 / 11282082432],
    [0, 0, 0, 0],
    [0, 131558114200 / 32700410799, -68118460800 / 10900136933, 87487479700 / 32700410799],
    [0, -1754552775 / 470086768, 14199869525 / 1410260304, -10690763975 / 1880347072],
    [0, 127303824393 / 49829197408, -318862633887 / 49829197408, 701980252875 / 199316789632],
    [0, -282668133 / 205662961, 2019193451 / 616988883, -1453857185 / 822651844],
    [0, 40617522 / 29380423, -110615467 / 29380423, 69997945 / 29380423],
])


@dataclass
class Fits:
    """Laws of n windows: beta by standardised term, the windows' means, scales and ranges, and those of time."""

    family: str
    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    time_mean: np.ndarray
    time_scale: np.ndarray
    condition: np.ndarray

    def at(self, rows: np.ndarray) -> Fits:
        return Fits(self.family, *(getattr(self, k)[rows] for k in ("beta", "mean", "scale", "low", "high", "time_mean", "time_scale", "condition")))

    def jerk(self, t: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (y - self.mean) / self.scale
        out = self.beta[:, 0] + (self.beta[:, 1:4] * z).sum(1)
        if self.family == "time":
            out = out + self.beta[:, 4] * (t - self.time_mean) / self.time_scale
        if self.family == "squares":
            out = out + (self.beta[:, 4:7] * z * z).sum(1)
        return out

    def motion(self, t: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.column_stack([y[:, 1], y[:, 2], self.jerk(t, y)])

    def slopes(self, y: np.ndarray) -> np.ndarray:
        """The jerk's derivatives by the state, in natural units, at y."""
        b = self.beta[:, 1:4] + (2 * self.beta[:, 4:7] * (y - self.mean) / self.scale if self.family == "squares" else 0)
        return b / self.scale

    def jacobian(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), 3, 3))
        out[:, 0, 1] = out[:, 1, 2] = 1.0
        out[:, 2] = self.slopes(y)
        return out

    def exact(self, y: np.ndarray, span: float = 1.0) -> np.ndarray:
        """The state after span from y, by the exponential of the generator; only for laws linear in the state."""
        if self.family == "squares":
            raise ValueError("squares have no generator")
        g = np.zeros((len(y), 5, 5))  # of (p, p1, p2, t, 1)
        g[:, :3, :3] = self.jacobian(y)
        g[:, 2, 4] = self.beta[:, 0] - (self.beta[:, 1:4] / self.scale * self.mean).sum(1)
        if self.family == "time":
            g[:, 2, 3] = self.beta[:, 4] / self.time_scale
            g[:, 2, 4] -= g[:, 2, 3] * self.time_mean
        g[:, 3, 4] = 1.0
        begin = np.column_stack([y, np.zeros(len(y)), np.ones(len(y))])
        return (expm(g * span) @ begin[..., None])[:, :3, 0]


def fit(x: np.ndarray, j: np.ndarray, t: np.ndarray, family: str = "affine", ridge: float = 0.0) -> tuple[np.ndarray, Fits]:
    """(rows, laws) of the windows x (n, w, 3), j and t (n, w; relative to the last row) that have one.

    A window has none if values are missing, a column is constant, or, without ridge, the design has not full rank.
    ridge weighs the squared standardised slopes, not the constant.
    """
    if family not in FAMILIES:
        raise ValueError(f"no family {family}")
    mean, scale = x.mean(1), x.std(1)
    tm, ts = t.mean(1), t.std(1)
    good = np.isfinite(x).all((1, 2)) & np.isfinite(j).all(1) & (scale > 0).all(1)
    if family == "time":
        good &= np.isfinite(t).all(1) & (ts > 0)
    at = np.flatnonzero(good)
    z = (x[at] - mean[at, None]) / scale[at, None]
    columns = [np.ones((*z.shape[:2], 1)), z]
    if family == "time":
        columns.append(((t[at] - tm[at, None]) / ts[at, None])[..., None])
    if family == "squares":
        columns.append(z * z)
    design = np.concatenate(columns, -1)
    left = right = None
    if not len(at):
        singular = np.zeros((0, design.shape[-1]))
    elif ridge:
        singular = np.linalg.svd(design, compute_uv=False)
    else:
        left, singular, right = np.linalg.svd(design, full_matrices=False)
    with np.errstate(divide="ignore"):
        condition = singular[:, 0] / singular[:, -1]
    if not ridge:
        full = singular[:, -1] > singular[:, 0] * max(design.shape[1:]) * np.finfo(float).eps
        at, design, condition = at[full], design[full], condition[full]
    if ridge:
        penalty = ridge * np.diag([0.0] + [1.0] * (design.shape[-1] - 1))
        beta = np.linalg.solve(design.transpose(0, 2, 1) @ design + penalty, design.transpose(0, 2, 1) @ j[at][..., None])[..., 0]
    else:
        beta = np.zeros((0, design.shape[-1]))
        if left is not None:  # the decomposition that gave the condition solves the fit too
            along_ = (left[full].transpose(0, 2, 1) @ j[at][..., None])[..., 0] / singular[full]
            beta = (right[full].transpose(0, 2, 1) @ along_[..., None])[..., 0]
    return at, Fits(family, beta, mean[at], scale[at], x[at].min(1), x[at].max(1), tm[at], ts[at], condition)


def stability(laws: Fits, y: np.ndarray) -> dict[str, np.ndarray]:
    """growth (largest real part) and radius (largest modulus) of the Jacobian's eigenvalues at y, and by how much a unit step on from a small change of p, p1 or p2 grows."""
    g = laws.jacobian(y)
    values = np.linalg.eigvals(g) if len(y) else np.zeros((0, 3))
    ahead = np.linalg.norm(expm(np.clip(g, -1e3, 1e3)), axis=1) if len(y) else np.zeros((0, 3))
    return {"growth": values.real.max(1), "radius": np.abs(values).max(1)} | {f"amplified_{k}": ahead[:, n] for n, k in enumerate(STATE)}


def project(laws: Fits, start: np.ndarray, span: float = 1.0, tolerance: float = 1e-6, flat: float = 0.0035332071428566536, points: int = 11, most_steps: int = 1000) -> dict[str, np.ndarray]:
    """Trajectories of the laws from start over span, each row with its own error-controlled steps.

    end; path (points of an even grid, by the pair's interpolant); evaluations and steps; event UPPER or LOWER and its time
    where p1 first passes 0 downward or upward; exit and exit_in, the first grid point outside the window's range and in
    which of p, p1, p2; distance, the largest standardised distance from the window's mean on the grid; failed, where no
    step was small enough or the end is not finite or 10^6 scales away. Absolute tolerances are tolerance times the
    window's scale, for p1 a tenth of flat at most.
    """
    n = len(start)
    atol = np.column_stack([tolerance * laws.scale[:, 0], np.minimum(tolerance * laws.scale[:, 1], 0.1 * flat), tolerance * laws.scale[:, 2]])
    t, y = np.zeros(n), start.astype(float).copy()
    grid = np.linspace(0.0, span, points)
    path = np.full((n, points, 3), np.nan)
    path[:, 0] = start
    event_time, event = np.full(n, np.nan), np.zeros(n, np.int64)
    steps, calls, failed = np.zeros(n, np.int64), np.full(n, 2), np.zeros(n, bool)
    with np.errstate(all="ignore"):
        k1 = laws.motion(t, y)
        scale = atol + tolerance * np.abs(y)
        d0, d1 = (np.sqrt(((v / scale) ** 2).mean(1)) for v in (y, k1))
        h0 = np.where((d0 < 1e-5) | (d1 < 1e-5), 1e-6, 0.01 * d0 / d1)
        d2 = np.sqrt((((laws.motion(h0, y + h0[:, None] * k1) - k1) / scale) ** 2).mean(1)) / h0
        h1 = np.where((d1 <= 1e-15) & (d2 <= 1e-15), np.maximum(1e-6, h0 * 1e-3), (0.01 / np.maximum(d1, d2)) ** 0.2)
    h = np.minimum(np.minimum(100 * h0, h1), span)
    h[~np.isfinite(h)] = 1e-6
    rejected = np.zeros(n, bool)
    live = np.arange(n)
    while len(live):
        own = laws.at(live)
        step = np.minimum(h[live], span - t[live])
        now, ks = y[live], [k1[live]]
        with np.errstate(all="ignore"):
            for c, a in zip(_C[1:], _A[1:], strict=True):
                ks.append(own.motion(t[live] + c * step, now + step[:, None] * sum(w * k for w, k in zip(a, ks, strict=True))))
            new = now + step[:, None] * sum(w * k for w, k in zip(_B, ks, strict=True))
            ks.append(own.motion(t[live] + step, new))
            error = step[:, None] * sum(w * k for w, k in zip(_E, ks, strict=True))
            norm = np.sqrt(((error / (atol[live] + tolerance * np.maximum(np.abs(now), np.abs(new)))) ** 2).mean(1))
        calls[live] += 6
        fine = norm < 1
        with np.errstate(all="ignore"):
            factor = np.where(norm == 0, 10.0, np.clip(0.9 * norm**-0.2, 0.2, 10.0))
        factor = np.where(np.isfinite(norm), factor, 0.2)
        factor = np.where(fine & rejected[live], np.minimum(factor, 1.0), np.where(fine, factor, np.minimum(factor, 1.0)))
        dense = np.stack(ks, 1).transpose(0, 2, 1) @ _P  # (row, state, power)

        def inside(theta: np.ndarray, rows: np.ndarray) -> np.ndarray:
            powers = theta[:, None] ** np.arange(1, 5)
            return now[rows] + step[rows, None] * (dense[rows] @ powers[..., None])[..., 0]  # noqa: B023

        ok = np.flatnonzero(fine)
        for g in range(1, points):
            hit = ok[(grid[g] > t[live[ok]]) & (grid[g] <= t[live[ok]] + step[ok] + 1e-12)]
            if len(hit):
                path[live[hit], g] = inside(np.minimum(1.0, (grid[g] - t[live[hit]]) / step[hit]), hit)
        falls = (now[:, 1] >= 0) & (new[:, 1] <= 0) & (now[:, 1] != new[:, 1])
        rises = (now[:, 1] <= 0) & (new[:, 1] >= 0) & (now[:, 1] != new[:, 1])
        crossed = ok[(falls | rises)[ok] & np.isnan(event_time[live[ok]]) & ((now[ok, 1] != 0) | (t[live[ok]] > 0))]
        if len(crossed):
            lo, hi, sign = np.zeros(len(crossed)), np.ones(len(crossed)), np.where(falls[crossed], 1.0, -1.0)
            for _ in range(50):
                mid = (lo + hi) / 2
                before = sign * inside(mid, crossed)[:, 1] > 0
                lo, hi = np.where(before, mid, lo), np.where(before, hi, mid)
            event_time[live[crossed]] = t[live[crossed]] + hi * step[crossed]
            event[live[crossed]] = sign.astype(np.int64)
        went = live[ok]
        t[went], y[went], k1[went] = np.where(step[ok] >= span - t[went], span, t[went] + step[ok]), new[ok], ks[-1][ok]
        steps[went] += 1
        rejected[live] = ~fine
        h[live] = step * factor
        lost = ~fine & ((h[live] < 1e-14 * span) | (steps[live] >= most_steps)) | (fine & (steps[live] >= most_steps) & (t[live] < span))
        failed[live[lost]] = True
        live = live[~lost & (t[live] < span)]
    failed |= ~np.isfinite(y).all(1) | (np.abs(y - start) > 1e6 * laws.scale).any(1)
    path[failed] = np.nan
    y[failed] = np.nan
    out_of = (path < laws.low[:, None]) | (path > laws.high[:, None])
    outside = out_of.any(2)
    first = np.where(outside.any(1), outside.argmax(1), -1)
    with np.errstate(all="ignore"):
        distance = np.linalg.norm((path - laws.mean[:, None]) / laws.scale[:, None], axis=2).max(1)
    dims = ["|".join(s for s, o in zip(STATE, out_of[k, f], strict=True) if o) if f >= 0 else None for k, f in enumerate(first.tolist())]
    return {
        "end": y, "path": path, "evaluations": calls, "steps": steps, "failed": failed, "event_time": np.where(failed, np.nan, event_time), "event": np.array([None if b else {1: "UPPER", -1: "LOWER"}.get(e) for e, b in zip(event.tolist(), failed.tolist(), strict=True)], object),
        "exit": np.where(first >= 0, grid[first], np.nan), "exit_in": np.array(dims, object), "distance": distance,
    }


COLUMNS = (
    "a double, b0 double, b1 double, b2 double, condition double, growth double, radius double, amplified_p double, amplified_p1 double, amplified_p2 double, "
    "taylor_p double, taylor_p1 double, taylor_p2 double, exact_p double, exact_p1 double, exact_p2 double, rk_p double, rk_p1 double, rk_p2 double, "
    "evaluations long, steps long, failed boolean, event string, event_time double, exit double, exit_in string, distance double"
)


def local_laws(df: DataFrame, window: int = 15, family: str = "affine", ridge: float = 0.0, tolerance: float | None = 1e-6) -> DataFrame:
    """entity_id, seq and COLUMNS for each row of df (entity_id, seq, price, d1, d2) with a law over its last window rows.

    a and b0..b2 are the law in natural units (at the current row, for squares: its tangent); taylor_* hold its jerk for one
    row ahead, exact_* follow the law by its generator (null for squares) and rk_* by project with tolerance (None: not
    projected). Rows whose window has no law are left out. An entity's rows stream by; window - 1 of them are held.
    """
    return many_laws(df, [(family, window)], ridge, [tolerance]).drop("family", "window", "tolerance")


def many_laws(df: DataFrame, kinds: list[tuple[str, int]], ridge: float = 0.0, tolerances: list[float | None] = [None], wanted: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:  # noqa: B006
    """As local_laws for each (family, window) and tolerance, from one pass over the rows: entity_id, seq, carry, family, window, tolerance and wanted of COLUMNS (None: all).

    A law is fitted once for all tolerances. What isn't wanted isn't computed.
    """
    carry, described = carry or [], [c.strip() for c in COLUMNS.split(",")]
    names = [c.split()[0] for c in described]
    names = [c for c in names if wanted is None or c in wanted]
    needs = lambda *parts: any(c.startswith(parts) for c in names)
    rows_in = df.withColumn("jerk", F.col("d2") - F.lag("d2").over(along("entity_id"))).select("entity_id", "seq", "price", "d1", "d2", "jerk", *carry)
    most = max(w for _, w in kinds)

    def told(rows: pd.DataFrame, keys: np.ndarray, numbers: np.ndarray, begun: int, family: str, window: int) -> Iterator[pd.DataFrame]:
        """The laws whose last row is at begun or after."""
        if len(rows) < window:
            return
        view = np.lib.stride_tricks.sliding_window_view(numbers, window, axis=0)
        full = np.flatnonzero(keys[window - 1 :] == keys[: len(keys) - window + 1])
        full = full[full + window - 1 >= begun]
        for k in range(0, len(full), 2048):
            some = full[k : k + 2048]
            x = view[some].transpose(0, 2, 1)
            at, laws = fit(x[..., :3], x[..., 3], x[..., 4] - x[:, -1:, 4], family, ridge)
            if not len(at):
                continue
            now = x[at, -1, :3]
            b = laws.slopes(now)
            jerk = laws.jerk(np.zeros(len(at)), now)
            made = {"a": jerk - (b * now).sum(1), "b0": b[:, 0], "b1": b[:, 1], "b2": b[:, 2], "condition": laws.condition}
            if needs("growth", "radius", "amplified"):
                made |= stability(laws, now)
            made |= {"taylor_p": now[:, 0] + now[:, 1] + now[:, 2] / 2 + jerk / 6, "taylor_p1": now[:, 1] + now[:, 2] + jerk / 2, "taylor_p2": now[:, 2] + jerk}
            ahead = laws.exact(now) if family != "squares" and needs("exact") else np.full((len(at), 3), np.nan)
            last = some[at] + window - 1
            for tolerance in tolerances:
                done = project(laws, now, tolerance=tolerance) if tolerance else None
                for n, s in enumerate(STATE):
                    made[f"exact_{s}"], made[f"rk_{s}"] = ahead[:, n], done["end"][:, n] if done else np.nan
                for c in ("evaluations", "steps", "failed", "event", "event_time", "exit", "exit_in", "distance"):
                    made[c] = done[c] if done else None
                out = pd.DataFrame({"entity_id": keys[last], "seq": rows["seq"].to_numpy()[last], **{c: rows[c].to_numpy()[last] for c in carry}, "family": family, "window": window, "tolerance": tolerance if tolerance else np.nan, **made})
                yield out[["entity_id", "seq", *carry, "family", "window", "tolerance", *names]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            begun = 0 if held is None else len(held)
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys, numbers = rows["entity_id"].to_numpy(), rows[["price", "d1", "d2", "jerk", "seq"]].to_numpy(np.float64)
            for family, window in kinds:
                yield from told(rows, keys, numbers, begun, family, window)
            held = rows.iloc[1 - most :]

    types = {f.name: f.dataType.simpleString() for f in rows_in.schema}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows_in.repartition(parts, "entity_id").sortWithinPartitions("entity_id", "seq")
    plain = ["entity_id " + types["entity_id"], "seq " + types["seq"], *(f"{c} {types[c]}" for c in carry), "family string", "window int", "tolerance double"]
    out = dealt.mapInPandas(run, ", ".join([*plain, *(c for c in described if c.split()[0] in names)]))
    gone = F.lit(None).cast("double")
    nullable = ("exact_p", "exact_p1", "exact_p2", "rk_p", "rk_p1", "rk_p2", "event_time", "exit", "distance")
    return out.withColumns({c: F.nanvl(c, gone) for c in ("tolerance", *(n for n in nullable if n in names))})
