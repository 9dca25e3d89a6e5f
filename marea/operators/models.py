"""Step functions of the estimator chain: state model, envelope, colours, positions. Each folds one entity's rows, in batch and in streams alike."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .folds import Many, ema_step, hysteresis_step

# Fixed values of the state model: bounds, rates, weights.
EPSILON = 1e-8
VELOCITY_BOUND, ACCELERATION_BOUND, CURVATURE_BOUND = 50.0, 200.0, 200.0
GAP_SECONDS = 5.0
VOLUME_RATE, VOLUME_MOST = 0.05, 3.0
QUALITY_FLOOR = 0.5
MULTIPLIER_MOST = 1.5
COHERENCE_WEIGHTS = {"level": 1.0, "velocity": 1.0, "acceleration": 0.8, "volume": 0.7}
STRENGTH_WEIGHTS = {"bias": -0.25, "volume": 0.8, "velocity": 0.35, "acceleration": 0.2, "coherence": 1.0, "uncertainty": -1.1}
UNCERTAINTY_WEIGHTS = {"bias": -1.0, "innovation": 1.0, "incoherence": 0.8, "structural": 0.8, "quality": 1.0, "instability": 0.5}
REVERSAL_WEIGHTS = {"bias": -1.2, "oppose": 1.0, "against": 0.8, "impersistence": 0.7, "extreme": 0.8, "uncertainty": 0.6}
PERSISTENCE_RATE = 0.2
HALF_LIFE, HALF_LIFE_LEAST, HALF_LIFE_MOST = 120.0, 15.0, 900.0
RATE, RATE_LEARNING, RATE_LEARNING_LEAST, RATE_LEARNING_MOST, RATE_LEAST, RATE_MOST = 0.05, 0.005, 1e-4, 0.05, 0.001, 0.2
INTERVAL, INTERVAL_LEAST, INTERVAL_MOST = 60.0, 10.0, 600.0
AGAINST = {"CONTRADICTING", "REVERSING", "STRUCTURAL/UNKNOWN"}

STATE_COLUMNS = (
    "level double, velocity double, acceleration double, curvature double, innovation double, volume_influence double, "
    "perturbation_class string, perturbation double, coherence double, strength double, persistence double, uncertainty double, "
    "reversal double, half_life double, rate double, interval double, support double, health string"
)


def within(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def _logistic(weights: dict[str, float], values: dict[str, float]) -> float:
    return 1 / (1 + math.exp(-weights.get("bias", 0.0) - sum(weights[k] * v for k, v in values.items())))


def _side(x: float) -> int:
    return (x > 1e-15) - (x < -1e-15)


def perturbation_of(magnitude: float, residual: float, quality: float, level: float, velocity: float, now: float) -> str:
    """How evidence (the residual) bears on the state it met (level, velocity), given the velocity now."""
    if quality < QUALITY_FLOOR:
        return "STRUCTURAL/UNKNOWN"
    if magnitude <= math.sqrt(EPSILON):
        return "NONE"
    state, evidence = _side(level) or _side(velocity), _side(residual) or _side(now - velocity)
    if not state or not evidence:
        return "STRUCTURAL/UNKNOWN"
    return "REINFORCING" if state == evidence else "REVERSING" if _side(now) == evidence else "CONTRADICTING"


def state_step(state: dict, row: dict) -> tuple[dict, dict]:
    """One tick (t in seconds, price, volume, quality) through the adaptive state model.

    A tick whose price, volume or time is missing or not finite leaves the state as it is; its health is INVALID and its
    other columns are null. Health counts gaps and clips of all ticks so far.
    """
    names = [c.split()[0] for c in STATE_COLUMNS.split(", ")]
    if any(row[c] is None or not math.isfinite(row[c]) for c in ("t", "price", "volume")):
        return state, dict.fromkeys(names) | {"health": "INVALID"}
    known = "t" in state
    dt = max(0.0, row["t"] - state["t"]) if known else 1.0
    gaps, clips, hits = (state.get(k, 0) for k in ("gaps", "clips", "hits"))
    gaps += known and dt > GAP_SECONDS
    quality = within(1.0 if row["quality"] is None else row["quality"], 0.0, 1.0)
    reference = ema_step({k: state[k] for k in ("ref", "scale") if known}, row)[0]

    before, speed = state.get("level", 0.0), state.get("velocity", 0.0)
    span = max(1e-6, dt) + EPSILON
    level = (row["price"] - reference["ref"]) / max(reference["scale"], EPSILON)
    raw = (level - before) / span
    velocity = within(raw, -VELOCITY_BOUND, VELOCITY_BOUND)
    clips += velocity != raw
    raw = (velocity - speed) / span
    acceleration = within(raw, -ACCELERATION_BOUND, ACCELERATION_BOUND)
    clips += acceleration != raw
    raw = acceleration / (1 + velocity * velocity) ** 1.5
    curvature = within(raw, -CURVATURE_BOUND, CURVATURE_BOUND)
    clips += curvature != raw

    residual = level - (before + speed * dt)
    innovation = abs(residual) / math.sqrt(max(dt + EPSILON, EPSILON))
    usual = state.get("usual_volume", 1.0) * (1 - VOLUME_RATE) + VOLUME_RATE * row["volume"]
    push = within(math.log1p(row["volume"] / max(usual, EPSILON)) + math.log1p(max(row["volume"], 0.0)) / 10, 0.0, VOLUME_MOST)
    magnitude = within(innovation / (1 + innovation), 0.0, 1.0)
    kind = perturbation_of(magnitude, residual, quality, before, speed, velocity)

    parts = {"level": level, "velocity": velocity, "acceleration": acceleration, "volume": push}
    mass = sum(COHERENCE_WEIGHTS[k] * abs(v) for k, v in parts.items())
    coherence = within(abs(sum(COHERENCE_WEIGHTS[k] * v for k, v in parts.items())) / (mass + EPSILON), 0.0, 1.0) if mass > EPSILON else 0.0
    strength = _logistic(STRENGTH_WEIGHTS, {"volume": push, "velocity": abs(velocity), "acceleration": abs(acceleration), "coherence": coherence, "uncertainty": state.get("uncertainty", 0.15)})
    agrees = (velocity * speed >= 0) - abs(acceleration) / (1 + abs(acceleration)) / 4 - 0.4 * (kind in AGAINST)
    persistence = (1 - PERSISTENCE_RATE) * state.get("persistence", 0.0) + PERSISTENCE_RATE * within(agrees, 0.0, 1.0)
    uncertainty = _logistic(UNCERTAINTY_WEIGHTS, {"innovation": innovation, "incoherence": 1 - coherence, "structural": kind == "STRUCTURAL/UNKNOWN", "quality": 1 - quality, "instability": min(1.0, abs(residual))})
    reversal = _logistic(REVERSAL_WEIGHTS, {"oppose": velocity * acceleration < 0, "against": kind in AGAINST, "impersistence": 1 - persistence, "extreme": min(1.0, abs(level) / 4), "uncertainty": uncertainty})

    gain = within(1 + persistence * strength * 0.2, 1.0, 1.35) * within(1 - uncertainty * 0.35, 0.5, 1.0)
    half_life = within(state.get("half_life", HALF_LIFE) * gain * (0.75 if kind in AGAINST else 1.0), HALF_LIFE_LEAST, HALF_LIFE_MOST)
    learning = RATE_LEARNING * max(0.2, 1 - uncertainty) * max(0.5, strength) * within(1 + magnitude * (MULTIPLIER_MOST - 1), 0.8, MULTIPLIER_MOST)
    proposed = state.get("rate", RATE) + within(learning, RATE_LEARNING_LEAST, RATE_LEARNING_MOST) * (strength - uncertainty) * 0.1
    rate = within(proposed, RATE_LEAST, RATE_MOST)
    hits += rate != proposed
    stretch = (0.7 + 0.6 * persistence) * (0.7 + 0.6 * strength) * (1.1 - 0.8 * uncertainty) * (1 - 0.35 * magnitude)

    made = {
        "level": level, "velocity": velocity, "acceleration": acceleration, "curvature": curvature, "innovation": innovation,
        "volume_influence": push, "perturbation_class": kind, "perturbation": magnitude, "coherence": coherence, "strength": strength,
        "persistence": persistence, "uncertainty": uncertainty, "reversal": reversal, "half_life": half_life, "rate": rate,
        "interval": within(INTERVAL * stretch, INTERVAL_LEAST, INTERVAL_MOST), "support": strength * persistence / max(EPSILON, uncertainty + reversal),
    }
    sound = all(math.isfinite(v) for v in made.values() if isinstance(v, float))
    made["health"] = "INVALID" if not sound else "DEGRADED_DATA" if gaps else "DEGRADED_NUMERICAL" if clips or hits else "PERTURBED" if magnitude > 0.7 else "HEALTHY"
    kept = {k: made[k] for k in ("level", "velocity", "persistence", "uncertainty", "half_life", "rate")}
    return {**reference, **kept, "t": row["t"], "usual_volume": usual, "gaps": gaps, "clips": clips, "hits": hits}, made


def _within(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """within of each value, what is not a number included."""
    x = np.where(x < hi, x, hi)
    return np.where(x > lo, x, lo)


def _each(f: Callable, *of: np.ndarray) -> np.ndarray:
    """f of each value by the C library, as single steps have it: numpy's own functions may differ in the last bit."""
    return np.fromiter(map(f, *(x.tolist() for x in of)), np.float64, len(of[0]))


def _total(*terms: np.ndarray) -> np.ndarray:
    """Sums of floats as Python's sum has them, which carries what is rounded off."""
    return np.fromiter(map(sum, zip(*(x.tolist() for x in terms), strict=True)), np.float64, len(terms[0]))


def _logistics(weights: dict[str, float], values: dict[str, np.ndarray]) -> np.ndarray:
    return 1 / (1 + _each(math.exp, -weights.get("bias", 0.0) - _total(*(weights[k] * v for k, v in values.items()))))


def _sides(x: np.ndarray) -> np.ndarray:
    return (x > 1e-15).astype(np.int64) - (x < -1e-15)


KINDS = np.array(["NONE", "STRUCTURAL/UNKNOWN", "REINFORCING", "REVERSING", "CONTRADICTING"], object)
_POWER = 1.5


def state_steps(state: dict, row: dict) -> tuple[dict, dict]:
    """state_step for one row each of many entities, to the same bits: state and row hold arrays, missing values are NaN."""
    with np.errstate(all="ignore"):
        fine = np.isfinite(row["t"]) & np.isfinite(row["price"]) & np.isfinite(row["volume"])
        s = state if fine.all() else {k: v[fine] for k, v in state.items()}
        t, price, volume, quality = (row[c][fine] for c in ("t", "price", "volume", "quality"))
        known = s["known"]
        ago = t - s["t"]
        dt = np.where(known, np.where(ago > 0, ago, 0.0), 1.0)
        gaps = s["gaps"] + (known & (dt > GAP_SECONDS))
        quality = _within(np.where(np.isnan(quality), 1.0, quality), 0.0, 1.0)
        ref = np.where(known, s["ref"] + 0.05 * (price - s["ref"]), price)
        scale = 0.95 * s["scale"] + 0.05 * np.abs(price - ref)
        scale = np.where(known, np.where(scale > 1e-4, scale, 1e-4), 1.0)

        before, speed = s["level"], s["velocity"]
        span = np.where(dt > 1e-6, dt, 1e-6) + EPSILON
        level = (price - ref) / np.where(EPSILON > scale, EPSILON, scale)
        raw = (level - before) / span
        velocity = _within(raw, -VELOCITY_BOUND, VELOCITY_BOUND)
        clips = s["clips"] + (velocity != raw)
        raw = (velocity - speed) / span
        acceleration = _within(raw, -ACCELERATION_BOUND, ACCELERATION_BOUND)
        clips = clips + (acceleration != raw)
        raw = acceleration / _each(lambda x: x**_POWER, 1 + velocity * velocity)
        curvature = _within(raw, -CURVATURE_BOUND, CURVATURE_BOUND)
        clips = clips + (curvature != raw)

        residual = level - (before + speed * dt)
        innovation = np.abs(residual) / np.sqrt(np.where(EPSILON > dt + EPSILON, EPSILON, dt + EPSILON))
        usual = s["usual_volume"] * (1 - VOLUME_RATE) + VOLUME_RATE * volume
        push = _within(_each(math.log1p, volume / np.where(EPSILON > usual, EPSILON, usual)) + _each(math.log1p, np.where(0.0 > volume, 0.0, volume)) / 10, 0.0, VOLUME_MOST)
        magnitude = _within(innovation / (1 + innovation), 0.0, 1.0)

        held, evidence, now = _sides(before), _sides(residual), _sides(velocity)
        held, evidence = np.where(held == 0, _sides(speed), held), np.where(evidence == 0, _sides(velocity - speed), evidence)
        kind = np.where(held == evidence, 2, np.where(now == evidence, 3, 4))
        kind = np.where((held == 0) | (evidence == 0), 1, kind)
        kind = np.where(quality < QUALITY_FLOOR, 1, np.where(magnitude <= math.sqrt(EPSILON), 0, kind))
        unknown, against = kind == 1, np.isin(KINDS, list(AGAINST))[kind]

        parts = {"level": level, "velocity": velocity, "acceleration": acceleration, "volume": push}
        mass = _total(*(COHERENCE_WEIGHTS[k] * np.abs(v) for k, v in parts.items()))
        coherence = _within(np.abs(_total(*(COHERENCE_WEIGHTS[k] * v for k, v in parts.items()))) / (mass + EPSILON), 0.0, 1.0)
        coherence = np.where(mass > EPSILON, coherence, 0.0)
        strength = _logistics(STRENGTH_WEIGHTS, {"volume": push, "velocity": np.abs(velocity), "acceleration": np.abs(acceleration), "coherence": coherence, "uncertainty": s["uncertainty"]})
        agrees = (velocity * speed >= 0) - np.abs(acceleration) / (1 + np.abs(acceleration)) / 4 - 0.4 * against
        persistence = (1 - PERSISTENCE_RATE) * s["persistence"] + PERSISTENCE_RATE * _within(agrees, 0.0, 1.0)
        least = np.where(np.abs(residual) < 1.0, np.abs(residual), 1.0)
        uncertainty = _logistics(UNCERTAINTY_WEIGHTS, {"innovation": innovation, "incoherence": 1 - coherence, "structural": unknown, "quality": 1 - quality, "instability": least})
        far = np.abs(level) / 4
        reversal = _logistics(REVERSAL_WEIGHTS, {"oppose": velocity * acceleration < 0, "against": against, "impersistence": 1 - persistence, "extreme": np.where(far < 1.0, far, 1.0), "uncertainty": uncertainty})

        gain = _within(1 + persistence * strength * 0.2, 1.0, 1.35) * _within(1 - uncertainty * 0.35, 0.5, 1.0)
        half_life = _within(s["half_life"] * gain * np.where(against, 0.75, 1.0), HALF_LIFE_LEAST, HALF_LIFE_MOST)
        sure = 1 - uncertainty
        learning = RATE_LEARNING * np.where(sure > 0.2, sure, 0.2) * np.where(strength > 0.5, strength, 0.5) * _within(1 + magnitude * (MULTIPLIER_MOST - 1), 0.8, MULTIPLIER_MOST)
        proposed = s["rate"] + _within(learning, RATE_LEARNING_LEAST, RATE_LEARNING_MOST) * (strength - uncertainty) * 0.1
        rate = _within(proposed, RATE_LEAST, RATE_MOST)
        hits = s["hits"] + (rate != proposed)
        stretch = (0.7 + 0.6 * persistence) * (0.7 + 0.6 * strength) * (1.1 - 0.8 * uncertainty) * (1 - 0.35 * magnitude)
        doubt = uncertainty + reversal

        numbers = {
            "level": level, "velocity": velocity, "acceleration": acceleration, "curvature": curvature, "innovation": innovation,
            "volume_influence": push, "perturbation": magnitude, "coherence": coherence, "strength": strength, "persistence": persistence,
            "uncertainty": uncertainty, "reversal": reversal, "half_life": half_life, "rate": rate,
            "interval": _within(INTERVAL * stretch, INTERVAL_LEAST, INTERVAL_MOST), "support": strength * persistence / np.where(doubt > EPSILON, doubt, EPSILON),
        }
        sound = np.all([np.isfinite(v) for v in numbers.values()], axis=0)
        health = np.select([~sound, gaps > 0, (clips > 0) | (hits > 0), magnitude > 0.7], HEALTHS[:4], HEALTHS[4])
        new = {"known": np.ones(len(t), bool), "ref": ref, "scale": scale, "t": t, "usual_volume": usual, "gaps": gaps, "clips": clips, "hits": hits}
        new |= {k: numbers[k] for k in ("level", "velocity", "persistence", "uncertainty", "half_life", "rate")}
        made = {**numbers, "perturbation_class": KINDS[kind], "health": health}
    if fine.all():
        return new, made
    after, told = {}, {}
    for k, v in state.items():
        after[k] = v.copy()
        after[k][fine] = new[k]
    for c, v in made.items():
        told[c] = np.full(len(fine), "INVALID", object) if c == "health" else np.full(len(fine), None, object) if v.dtype == object else np.full(len(fine), np.nan)
        told[c][fine] = v
    return after, told


HEALTHS = np.array(["INVALID", "DEGRADED_DATA", "DEGRADED_NUMERICAL", "PERTURBED", "HEALTHY"], object)
STATES = Many(
    {"ref": 0.0, "scale": 1.0, "t": 0.0, "usual_volume": 1.0, "gaps": 0, "clips": 0, "hits": 0, "level": 0.0, "velocity": 0.0, "persistence": 0.0, "uncertainty": 0.15, "half_life": HALF_LIFE, "rate": RATE},
    state_steps,
)


ENVELOPE_COLUMNS = "state_before string, state string, aperture_before double, aperture double, safety string, candidate string, candidate_since double, direction string, events array<string>"


def envelope_step(state: dict, row: dict, rate: float = 0.5) -> tuple[dict, dict]:
    """One evaluation of a shape (t, interval, direction, score, valid) at time at, in a market eligible or not.

    Unsafe evaluations close the gate, its aperture and the candidate at once; else the gate follows the score with
    hysteresis. An open gate without a candidate qualifies one; a newer shape invalidates it. A null market is eligible.
    """
    gate, aperture, candidate = state.get("gate", "CLOSED"), state.get("aperture", 0.0), state.get("candidate")
    events, shown = [], None
    if "t" not in state or row["t"] > state["t"]:
        if "t" in state:
            events.append("SHAPE_SUPERSEDED")
        if candidate is not None:
            shown, candidate = {**candidate, "status": "INVALIDATED"}, None
            events.append("CANDIDATE_INVALIDATED")
        events.append("RETURN_SHAPE_ACCEPTED")
    else:
        events.append("CONTEXT_REEVALUATED")
    events.append("CAPTURABILITY_EVALUATED")
    safety = "INVALID_RETURNSHAPE" if not row["valid"] else "SHAPE_STALE" if row["at"] > row["t"] + row["interval"] else "MARKET_INELIGIBLE" if row["eligible"] is False else None
    if safety:
        held, now, opened = {"gate": "CLOSED"}, "CLOSED", 0.0
        if candidate is not None:
            shown, candidate = {**candidate, "status": "INVALIDATED"}, None
            events.append("CANDIDATE_INVALIDATED")
        events += [safety] + ["ENVELOPE_CLOSED"] * (gate != "CLOSED")
    else:
        held, made = hysteresis_step({"gate": gate, "n": state.get("n", 0)}, {"score": row["score"]})
        now = made["gate"]
        opened = within(rate * within(row["score"], 0.0, 1.0) + (1 - rate) * aperture, 0.0, 1.0)
        step = {("CLOSED", "OPENING"): "ENVELOPE_OPENING", ("OPENING", "OPEN"): "ENVELOPE_OPENED", ("OPEN", "CLOSING"): "ENVELOPE_CLOSING", ("CLOSING", "CLOSED"): "ENVELOPE_CLOSED"}.get((gate, now))
        events += [step] * (step is not None)
        if now == "OPEN" and candidate is None:
            candidate = {"since": row["at"], "direction": row["direction"], "status": "QUALIFIED"}
            events.append("CANDIDATE_QUALIFIED")
        shown = candidate
    events.append("APERTURE_UPDATED")
    shown = shown or {}
    made = {"state_before": gate, "state": now, "aperture_before": aperture, "aperture": opened, "safety": safety, "candidate": shown.get("status"), "candidate_since": shown.get("since"), "direction": shown.get("direction"), "events": events}
    return {**held, "t": max(row["t"], state.get("t", row["t"])), "aperture": opened, "candidate": candidate}, made


def price_colour_step(state: dict, row: dict) -> tuple[dict, dict]:
    """A raw colour shown at once, but for a direct reversal of GREEN and RED, which shows AMBER for one row; reset where the session changes."""
    state = state if state.get("session") == row["session"] else {}
    raw = row["raw_colour"]
    turns = {state.get("colour"), raw} == {"GREEN", "RED"} and state.get("pending") != raw
    colour = "AMBER" if turns else raw
    return {"session": row["session"], "colour": colour, "pending": raw if turns else None}, {"colour": colour}


def volume_colour_step(state: dict, row: dict, lower: float = 0.8, upper: float = 1.2, confirm: int = 2) -> tuple[dict, dict]:
    """Activity against its baseline as a colour; a change shows AMBER until it has come confirm times running; reset where the session changes."""
    x = row["activity"]
    state = state if state.get("session") == row["session"] else {}
    if x is None or not math.isfinite(x):
        return {"session": row["session"], "colour": "INVALID"}, {"raw_colour": "INVALID", "colour": "INVALID", "change": "INVALID"}
    raw = "GREEN" if x >= upper else "RED" if x <= lower else "AMBER"
    shown, change, pending, n = raw, "STABLE", None, 0
    if state.get("colour") not in (None, raw):
        n = state.get("n", 0) + 1 if state.get("pending") == raw else 1
        change = f"CONFIRMED_{raw}" if n >= confirm else f"PENDING_{raw}"
        if n < confirm:
            shown, pending = "AMBER", raw
    return {"session": row["session"], "colour": shown, "pending": pending, "n": n}, {"raw_colour": raw, "colour": shown, "change": change}


COCKPIT_COLUMNS = "motion string, zero_proximity double, deceleration double, opposing_rows long, turn string, turn_age long, colour string"


def cockpit_step(state: dict, row: dict, epsilon: float = 1e-6, near: float = 0.25, strong: float = 0.5, persist: int = 2, hold: int = 2) -> tuple[dict, dict]:
    """Turn candidates from velocity p1, acceleration p2 and the projected velocity q1, held for hold rows after they vanish; reset where the session changes.

    A candidate is a projected crossing of zero, or a slowing that lasts persist rows, comes near zero and is strong. With
    caution (low confidence or out of domain) the colour is AMBER. Null or non-finite inputs are INVALID and clear the state.
    """
    state = state if state.get("session") == row["session"] else {}
    p1, p2, q1 = row["p1"], row["p2"], row["q1"]
    if any(x is None or not math.isfinite(x) for x in (p1, p2, q1)):
        return {"session": row["session"], "colour": "INVALID"}, {"motion": "INVALID", "zero_proximity": None, "deceleration": None, "opposing_rows": 0, "turn": "NONE", "turn_age": 0, "colour": "INVALID"}
    way = (p1 > epsilon) - (p1 < -epsilon)
    ahead, back = ("UP", "DOWN") if way > 0 else ("DOWN", "UP")
    slowing = way != 0 and way * p2 < 0 and way * q1 < way * p1
    speeding = way != 0 and way * p2 > 0 and way * q1 >= way * p1
    motion = "NEAR_STATIONARY" if not way else f"{ahead}_{'ACCELERATING' if speeding else 'DECELERATING' if slowing else 'STABLE'}"
    proximity = abs(q1) / max(abs(p1), abs(q1), epsilon)
    deceleration = max(0.0, way * (p1 - q1)) / max(abs(p1), epsilon)
    against = back if slowing else None
    rows = (state.get("rows", 0) if against == state.get("against") else 0) + 1 if against else 0
    crossing = way != 0 and way * q1 <= 0
    turn, age = (back, 1) if crossing or (slowing and rows >= persist and proximity <= near and deceleration >= strong) else (None, 0)
    if turn and turn == state.get("turn"):
        age = state["age"] + 1
    elif not turn and state.get("turn") and state["age"] < hold:
        turn, age = state["turn"], state["age"] + 1
    flips = not turn and way != 0 and state.get("colour") == ("RED" if way > 0 else "GREEN")
    if not way:
        shown, colour = "NEAR_STATIONARY", "AMBER"
    elif turn:
        shown, colour = f"TURN_{turn}_CANDIDATE", "AMBER"
    elif flips:
        shown, colour = "DIRECTION_CHANGE_TRANSITION", "AMBER"
    elif row["caution"]:
        shown, colour = "UNCERTAIN", "AMBER"
    else:
        shown, colour = motion, "GREEN" if way > 0 else "RED"
    made = {"motion": shown, "zero_proximity": proximity, "deceleration": deceleration, "opposing_rows": rows, "turn": turn or "NONE", "turn_age": age, "colour": colour}
    return {"session": row["session"], "colour": colour, "against": against, "rows": rows, "turn": turn, "age": age}, made


def half_life_step(state: dict, row: dict, start: float = 120.0, least: float = 15.0, most: float = 900.0, shorten: float = 0.35, lengthen: float = 1.15) -> tuple[dict, dict]:
    """A half-life that perturbations shorten and reinforcement lengthens."""
    now = state.get("half_life", start)
    if row["perturbation"] > 0:
        now *= 1 - min(0.95, row["perturbation"]) * shorten
    if row["reinforcement"] > 0:
        now *= 1 + min(row["reinforcement"], 1.0) * (lengthen - 1)
    now = within(now, least, most)
    return {"half_life": now}, {"half_life": now}


def aperture_step(state: dict, row: dict, rate: float = 0.5) -> tuple[dict, dict]:
    """An exponential mean of scores in 0..1 that an unsafe row sets to 0."""
    now = 0.0 if row["unsafe"] else within(rate * within(row["score"], 0.0, 1.0) + (1 - rate) * state.get("aperture", 0.0), 0.0, 1.0)
    return {"aperture": now}, {"aperture": now}


def volume_step(state: dict, row: dict) -> tuple[dict, dict]:
    """The usual volume (an exponential mean from 1, updated before it is used) and the push of the volume against it."""
    usual = state.get("usual", 1.0) * (1 - VOLUME_RATE) + VOLUME_RATE * row["volume"]
    push = within(math.log1p(row["volume"] / max(usual, EPSILON)) + math.log1p(max(row["volume"], 0.0)) / 10, 0.0, VOLUME_MOST)
    return {"usual": usual}, {"usual": usual, "influence": push}


def gradient_step(state: dict, row: dict, rate: float = 0.05, decay: float = 0.01, most: float = 0.5) -> tuple[dict, dict]:
    """One step of a linear model (bias, x1, x2, x3) of y down its squared error, with weight decay and weights within most."""
    x = (1.0, row["x1"], row["x2"], row["x3"])
    w = state.get("w", (0.0,) * 4)
    prediction = sum(a * b for a, b in zip(w, x, strict=True))
    error = row["y"] - prediction
    free = [a - rate * (-error * b + decay * a) for a, b in zip(w, x, strict=True)]
    new = [within(a, -most, most) for a in free]
    return {"w": new}, {"prediction": prediction, "error": error, "hit": new != free, **{f"w{k}": a for k, a in enumerate(new)}}
