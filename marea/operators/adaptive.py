"""The online model of several outputs: features of price and volume, conditioned by running statistics, a polynomial basis and one linear map learned by clipped gradient steps.

One step serves batch folds and streams. Its state holds numbers, lists and arrays, which `folds.kept` writes as JSON; lists restore it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np

from .models import within

# Fixed values of the model: names of features and outputs in their order, and its parameters.
FEATURES = ("price_displacement", "price_velocity", "price_acceleration", "relative_volume", "volume_log", "volume_density", "directional_volume", "volume_movement_abs", "volume_movement_signed")
INTERACTIONS = (
    ("volume_log_x_price_displacement", "volume_log", "price_displacement"),
    ("relative_volume_x_price_velocity", "relative_volume", "price_velocity"),
    ("volume_density_x_price_displacement", "volume_density", "price_displacement"),
    ("price_velocity_x_acceleration", "price_velocity", "price_acceleration"),
)
OUTPUTS = ("direction_state", "magnitude_state", "strength", "persistence", "observation_half_life", "forward_half_life", "reinforcement", "uncertainty", "reversal_tendency", "perturbation_state")


@dataclass(frozen=True)
class Settings:
    """Parameters of the model; the defaults are its published configuration, without quotes."""

    rate: float = 0.03
    decay: float = 0.0005
    most_weight: float = 5.0
    order: int = 2
    interaction_order: int = 1
    interactions: tuple[str, ...] = tuple(name for name, _, _ in INTERACTIONS)
    warm_up: int = 12
    least_scale: float = 1e-6
    bound: float = 8.0
    volumes: int = 20
    volume_half_life: float = 45.0
    densities: int = 200
    half_life: float = 60.0
    least_half_life: float = 5.0
    most_half_life: float = 300.0
    shorten: float = 0.35
    lengthen: float = 1.15
    ahead: float = 60.0
    displacement_at: float = 0.0025
    velocity_at: float = 0.0012
    acceleration_at: float = 0.0010
    volume_at: float = 1.8
    density_at: float = 2500.0


def basis_names(c: Settings, features: tuple[str, ...] = FEATURES) -> list[str]:
    """Names of the basis: bias, then each feature and each allowed product with its powers."""
    powers = [(f, c.order) for f in features] + [(n, min(c.order, c.interaction_order)) for n, a, b in INTERACTIONS if n in c.interactions]
    return ["bias", *(name if k == 1 else f"{name}^{k}" for name, most in powers for k in range(1, most + 1))]


@cache
def _size(c: Settings) -> int:
    return len(basis_names(c))


def basis(values: np.ndarray, c: Settings) -> np.ndarray:
    """The basis of conditioned features (in the order of FEATURES)."""
    at = dict(zip(FEATURES, values.tolist(), strict=True))
    parts = [(x, c.order) for x in at.values()] + [(at[a] * at[b], min(c.order, c.interaction_order)) for n, a, b in INTERACTIONS if n in c.interactions]
    out = [1.0]
    for x, most in parts:
        out += [x, x * x, x * x * x][:most]
    return np.array(out)


def gradient_update(weights: np.ndarray, x: np.ndarray, targets: np.ndarray, rate: float, decay: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, errors, hits) of a matrix of weights (outputs x features) after a step down each output's squared error; hits tells outputs with a clipped weight."""
    errors = targets - weights @ x
    free = weights + rate * (errors[:, None] * x - decay * weights)
    new = np.minimum(np.maximum(free, -most), most)
    return new, errors, (new != free).any(1)


def _half_life(now: float, perturbation: float, reinforcement: float, c: Settings) -> float:
    if perturbation > 0:
        now *= 1 - min(0.95, perturbation) * c.shorten
    if reinforcement > 0:
        now *= 1 + min(reinforcement, 1.0) * (c.lengthen - 1)
    return within(now, c.least_half_life, c.most_half_life)


def adaptive_step(state: dict, row: dict, c: Settings = Settings()) -> tuple[dict, dict]:
    """One tick (t in seconds, price, volume) through the model: the outputs, half prediction and half target, a forward estimate, and what was learned.

    A tick not after the one before raises. Until every feature has been seen warm_up times, conditioned features are 0
    and weights stay. A tick with a missing or infinite value leaves the state as it is and has no outputs.
    """
    t, price, volume = row["t"], row["price"], row["volume"]
    if any(x is None or not math.isfinite(x) for x in (t, price, volume)):
        return state, dict.fromkeys((*OUTPUTS, "kind", "expected_magnitude", "favorable", "adverse", "forward_decay", "error", "drift", "learning", "bound_hits")) | {"reasons": "INVALID"}
    n, size = state.get("n", 0), _size(c)
    weights = np.asarray(state["weights"]) if n else np.zeros((len(OUTPUTS), size))
    mean, spread = (np.asarray(state[k]) if n else np.zeros(len(FEATURES)) for k in ("mean", "spread"))
    if n:
        dt = t - state["t"]
        if dt <= 0:
            raise ValueError(f"tick at {t} is not after {state['t']}")
        moved = (price - state["price"]) / max(state["price"], 1e-9)
        velocity = moved / dt
        acceleration = (velocity - state["velocity"]) / dt
    else:
        moved = velocity = acceleration = 0.0

    seen = state.get("seen", [])  # (time, volume) of the last ticks
    near = seen[-c.volumes :]
    usual = 1.0
    if near:
        ages = [min(1.0, 2.0 ** (-max(0.0, t - at) / c.volume_half_life)) for at, _ in near]
        total = sum(ages)
        usual = max(1e-9, sum(a * v for a, (_, v) in zip(ages, near, strict=True)) / total if total > 0 else near[-1][1])
    relative = max(0.0, volume / usual)
    log_volume = math.log1p(relative)
    seen = [*seen[1 - max(c.densities, c.volumes) :], [t, volume]]
    held = seen[-c.densities :]
    density = sum(v for _, v in held) / max(1e-6, held[-1][0] - held[0][0])
    signed = math.copysign(log_volume, moved) if moved else 0.0
    raw = np.array([moved, velocity, acceleration, relative, log_volume, density, signed, log_volume * abs(moved), log_volume * moved])

    ready = n >= c.warm_up
    scale = np.maximum(np.sqrt(np.maximum(0.0, spread / (n - 1))) if n > 1 else 0.0, c.least_scale)
    free = (raw - mean) / scale if ready else np.zeros(len(FEATURES))
    conditioned = np.minimum(np.maximum(free, -c.bound), c.bound)
    bound_hits = state.get("bound_hits", 0) + int((conditioned != free).sum())
    off = raw - mean
    mean = mean + off / (n + 1)
    spread = spread + off * (raw - mean)

    price_why = [w for w, x, at in (("DISPLACEMENT", moved, c.displacement_at), ("VELOCITY", velocity, c.velocity_at), ("ACCELERATION", acceleration, c.acceleration_at)) if abs(x) >= at]
    volume_why = [w for w, x, at in (("RV", relative, c.volume_at), ("VOLUME_DENSITY", density, c.density_at)) if x >= at]
    perturbation = min(1.0, 0.2 * len(price_why + volume_why))
    kind = "COMBINED" if price_why and volume_why else "VOLUME" if volume_why else "PRICE" if price_why else "NONE"

    before = state.get("direction", 0.0)
    reinforcement = within((0.15 if before * float(np.sign(moved)) > 0 else -0.15) + 0.2 * perturbation, -1.0, 1.0)
    h_seen = _half_life(state.get("h_seen", c.half_life), perturbation, reinforcement, c)
    h_ahead = _half_life(state.get("h_ahead", c.half_life), 0.5 * perturbation, max(0.0, reinforcement), c)

    x = basis(conditioned, c)
    direction = math.tanh(conditioned[1] / 0.005)
    strength = min(1.0, 0.6 * abs(direction) + 0.4 * min(1.0, conditioned[4]))
    targets = np.array([
        direction, abs(conditioned[0]), strength, min(1.0, h_seen / max(c.most_half_life, 1e-9)), h_seen, h_ahead, reinforcement,
        within(1.0 - strength + 0.25 * perturbation, 0.0, 1.0), within(0.5 * perturbation + 0.3 * max(-direction * before, 0.0), 0.0, 1.0), perturbation,
    ])
    predicted = weights @ x
    learning = n + 1 >= c.warm_up  # this tick's features have been counted
    if learning:
        new, errors, _ = gradient_update(weights, x, targets, c.rate, c.decay, c.most_weight)
    else:
        new, errors = weights, targets - predicted
    drift = float(np.abs(new - weights).sum())
    out = dict(zip(OUTPUTS, (0.5 * predicted + 0.5 * targets).tolist(), strict=True))
    out["strength"], out["uncertainty"] = within(out["strength"], 0.0, 1.0), within(out["uncertainty"], 0.0, 1.0)
    out["magnitude_state"], out["direction_state"] = abs(out["magnitude_state"]), within(out["direction_state"], -1.0, 1.0)
    if relative > 2.0 and abs(moved) < 0.0005:  # much volume alone is no strength
        out["strength"] = min(out["strength"], 0.65)
    out["reversal_tendency"] = within((0.2 if -out["direction_state"] * before > 0 else 0.05) + 0.7 * perturbation, 0.0, 1.0)

    toward, unsure = out["direction_state"], out["uncertainty"]
    size_ahead = max(0.0, out["magnitude_state"] * (1 + 0.5 * out["strength"]))
    favorable, adverse = size_ahead * max(0.0, toward) * (1 - unsure), size_ahead * max(0.0, -toward) * (0.6 + unsure)
    if toward >= 0:
        favorable, adverse = max(favorable, size_ahead * (1 - unsure) * 0.5), max(adverse, size_ahead * unsure * 0.4)
    h = out["forward_half_life"]
    decay = min(1.0, 2.0 ** (-c.ahead / h)) if h > 0 else None
    kept = {"n": n + 1, "t": t, "price": price, "velocity": velocity, "direction": toward, "seen": seen, "mean": mean, "spread": spread, "weights": new, "h_seen": h_seen, "h_ahead": h_ahead, "bound_hits": bound_hits}
    return kept, {**out, "kind": kind, "reasons": ";".join(price_why + volume_why), "expected_magnitude": size_ahead, "favorable": favorable, "adverse": adverse, "forward_decay": decay, "error": float(np.abs(errors).sum()), "drift": drift, "learning": learning, "bound_hits": bound_hits}


ADAPTIVE_OUT = ", ".join(f"{k} double" for k in OUTPUTS) + ", kind string, reasons string, expected_magnitude double, favorable double, adverse double, forward_decay double, error double, drift double, learning boolean, bound_hits long"
