"""Local dynamics: least-squares laws over the last rows of each entity, their projections and stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import along

#: Fits whose design has a larger condition number are rejected.
CONDITION = 1e8


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponentials of a stack of square matrices, by scaling, a Taylor sum and squaring."""
    norm = np.abs(a).sum(-1).max(-1)
    squarings = np.maximum(0, np.ceil(np.log2(np.maximum(norm, 1e-300))).astype(int) + 1)
    a = a / (2.0**squarings)[..., None, None]
    out = term = np.broadcast_to(np.eye(a.shape[-1]), a.shape).copy()
    for k in range(1, 19):
        term = term @ a / k
        out = out + term
    for k in range(int(squarings.max(initial=0))):
        more = squarings > k
        out[more] = out[more] @ out[more]
    return out


def fit_windows(p: np.ndarray, p1: np.ndarray, p2: np.ndarray, j: np.ndarray, ridge: float = 0.0) -> dict[str, np.ndarray]:
    """For stacks of windows (rows x window): the law j = a + b.(p, p1, p2) in natural units, its condition, the projection one row ahead and the largest real eigenvalue.

    The state is standardised per window; ridge weighs the squared slopes. The projection is exact for the law: the
    exponential of its generator. NaN where a column is constant, values are missing or the condition is too large.
    """
    x = np.stack([p, p1, p2], -1)
    mean, scale = x.mean(1), x.std(1)
    good = np.isfinite(mean).all(1) & np.isfinite(j).all(1) & (scale > 0).all(1)
    n = len(p)
    out = {k: np.full(n, np.nan) for k in ("a", "b0", "b1", "b2", "condition", "next_p", "next_p1", "next_p2", "growth")}
    if not good.any():
        return out
    z = (x[good] - mean[good, None]) / scale[good, None]
    design = np.concatenate([np.ones((*z.shape[:2], 1)), z], -1)
    with np.errstate(divide="ignore"):
        condition = np.linalg.cond(design)
    fine = np.isfinite(condition) & (condition <= CONDITION)
    at = np.flatnonzero(good)[fine]
    out["condition"][np.flatnonzero(good)] = condition
    if not len(at):
        return out
    design = design[fine]
    penalty = ridge * np.diag([0.0, 1.0, 1.0, 1.0])
    beta = np.linalg.solve(design.transpose(0, 2, 1) @ design + penalty, (design.transpose(0, 2, 1) @ j[at][..., None]))[..., 0]
    b = beta[:, 1:] / scale[at]
    a = beta[:, 0] - (b * mean[at]).sum(1)
    now = x[at, -1]
    # The motion (p, p1, p2, 1)' = generator (p, p1, p2, 1); one row ahead is its exponential.
    g = np.zeros((len(at), 4, 4))
    g[:, 0, 1] = g[:, 1, 2] = 1.0
    g[:, 2, :3], g[:, 2, 3] = b, a
    ahead = (expm(np.clip(g, -1e3, 1e3)) @ np.concatenate([now, np.ones((len(at), 1))], 1)[..., None])[:, :3, 0]
    out["a"][at], out["growth"][at] = a, np.linalg.eigvals(g[:, :3, :3]).real.max(1)
    for k in range(3):
        out[f"b{k}"][at] = b[:, k]
        out[("next_p", "next_p1", "next_p2")[k]][at] = np.where(np.isfinite(ahead[:, k]), ahead[:, k], np.nan)
    return out


def local_fit(df: DataFrame, window: int, ridge: float = 0.0) -> DataFrame:
    """entity_id, seq and the columns of fit_windows for each row of df (entity_id, seq, price, d1, d2) with a full window.

    Rows go to their entity's task once; there the last window - 1 rows are carried from batch to batch and windows are
    views of what is held. One row of each entity is lost to the third derivative; values that are null make no fit.
    """
    df = df.withColumn("jerk", F.col("d2") - F.lag("d2").over(along("entity_id"))).select("entity_id", "seq", "price", "d1", "d2", "jerk")
    names = ["a", "b0", "b1", "b2", "condition", "next_p", "next_p1", "next_p2", "growth"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = rows.iloc[1 - window :] if window > 1 else None
            if len(rows) < window:
                continue
            x = np.lib.stride_tricks.sliding_window_view(rows[["price", "d1", "d2", "jerk"]].to_numpy(np.float64), window, axis=0)
            keys = rows["entity_id"].to_numpy()
            full = (keys[window - 1 :] == keys[: len(keys) - window + 1]) & np.isfinite(x).all((1, 2))
            if full.any():
                made = fit_windows(*(x[full, k] for k in range(4)), ridge)
                at = np.flatnonzero(full) + window - 1
                yield pd.DataFrame({"entity_id": keys[at], "seq": rows["seq"].to_numpy()[at], **{k: made[k] for k in names}})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, "entity_id").sortWithinPartitions("entity_id", "seq")
    return dealt.mapInPandas(run, "entity_id long, seq long, " + ", ".join(f"{k} double" for k in names))


def integrate(law, start: np.ndarray, span: float, inside, steps: int = 10, halvings: int = 20) -> dict[str, np.ndarray]:
    """Trajectories of a batch of states under state' = law(state) by fourth-order Runge-Kutta, steps + 1 points, until they leave a domain.

    Rows that leave it (inside says which stay) stop where the last step, bisected, still is inside: exit tells the time,
    NaN for those that stay, and distance how far a row came from its start. Points after an exit are NaN.
    """

    def advance(x, h):
        a = law(x)
        b = law(x + h / 2 * a)
        c = law(x + h / 2 * b)
        return x + h / 6 * (a + 2 * b + 2 * c + law(x + h * c))

    n, width = len(start), span / steps
    path = np.full((n, steps + 1, start.shape[1]), np.nan)
    path[:, 0], exit_, now = start, np.full(n, np.nan), start.copy()
    alive = inside(start)
    exit_[~alive] = 0.0
    for k in range(steps):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        with np.errstate(all="ignore"):
            new = advance(now[at], np.full((len(at), 1), width))
            good = np.isfinite(new).all(1) & inside(new)
        now[at[good]] = new[good]
        path[at[good], k + 1] = new[good]
        lost = at[~good]
        if len(lost):
            lo, hi = np.zeros((len(lost), 1)), np.full((len(lost), 1), width)
            last = now[lost].copy()
            for _ in range(halvings):
                mid = (lo + hi) / 2
                with np.errstate(all="ignore"):
                    there = advance(now[lost], mid)
                    good = np.isfinite(there).all(1) & inside(there)
                lo[good], hi[~good], last[good] = mid[good], mid[~good], there[good]
            exit_[lost], now[lost], alive[lost] = k * width + lo[:, 0], last, False
    return {"path": path, "end": now, "exit": exit_, "distance": np.sqrt(((now - start) ** 2).sum(1))}


def convergence(law, start: np.ndarray, span: float, inside, levels: tuple[int, ...] = (10, 20, 40)) -> np.ndarray:
    """How far the ends of each level of steps lie from those of the finest, at most over the batch; NaN ends don't count."""
    ends = [integrate(law, start, span, inside, k)["end"] for k in levels]
    return np.array([np.nanmax(np.abs(e - ends[-1])) for e in ends[:-1]])
