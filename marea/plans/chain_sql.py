"""The estimator chain in SQL: each state machine as a recursion from an entity's tick to the next one."""

from __future__ import annotations

from .registry import TICKS

class M:
    """Fixed values of the state model, written out once more: the SQL takes nothing from the code it checks."""

    ACCELERATION_BOUND = 200.0
    COHERENCE_WEIGHTS = {"level": 1.0, "velocity": 1.0, "acceleration": 0.8, "volume": 0.7}
    CURVATURE_BOUND = 200.0
    EPSILON = 1e-08
    GAP_SECONDS = 5.0
    HALF_LIFE = 120.0
    HALF_LIFE_LEAST = 15.0
    HALF_LIFE_MOST = 900.0
    INTERVAL = 60.0
    INTERVAL_LEAST = 10.0
    INTERVAL_MOST = 600.0
    MULTIPLIER_MOST = 1.5
    PERSISTENCE_RATE = 0.2
    QUALITY_FLOOR = 0.5
    RATE = 0.05
    RATE_LEARNING = 0.005
    RATE_LEARNING_LEAST = 0.0001
    RATE_LEARNING_MOST = 0.05
    RATE_LEAST = 0.001
    RATE_MOST = 0.2
    REVERSAL_WEIGHTS = {"bias": -1.2, "oppose": 1.0, "against": 0.8, "impersistence": 0.7, "extreme": 0.8, "uncertainty": 0.6}
    STRENGTH_WEIGHTS = {"bias": -0.25, "volume": 0.8, "velocity": 0.35, "acceleration": 0.2, "coherence": 1.0, "uncertainty": -1.1}
    UNCERTAINTY_WEIGHTS = {"bias": -1.0, "innovation": 1.0, "incoherence": 0.8, "structural": 0.8, "quality": 1.0, "instability": 0.5}
    VELOCITY_BOUND = 50.0
    VOLUME_MOST = 3.0
    VOLUME_RATE = 0.05


RECURSIVE_TICKS = TICKS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)


def q20(x: str) -> str:
    """A value on a grid of 2 ** -20: ties are odd multiples of 2 ** -21, which sums of decimals don't hit."""
    return f"round(({x}) * 1048576) / 1048576"


def layers(source: str, *steps: dict[str, str]) -> str:
    """A query that adds each step's columns to those of the steps before."""
    out = source
    for k, step in enumerate(steps):
        out = f"SELECT *, {', '.join(f'{x} AS {name}' for name, x in step.items())} FROM ({out}) l{k}"
    return out


def within(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo!r}, least({hi!r}, {x}))"


def side(x: str) -> str:
    return f"(CASE WHEN {x} > 1e-15 THEN 1 WHEN {x} < -1e-15 THEN -1 ELSE 0 END)"


def logistic(weights: dict[str, float], **values: str) -> str:
    total = " + ".join([repr(weights["bias"]), *(f"{weights[k]!r} * ({v})" for k, v in values.items())])
    return f"1 / (1 + exp(-({total})))"


def recursion(name: str, source: str, kept: dict[str, str], made: list[str], *steps: dict[str, str]) -> str:
    """name: rows (entity_id, seq, kept, made) of source, folded from a row of seq 0 with the values of kept; before a step they are called p_."""
    start = ", ".join(f"{x} AS {k}" for k, x in kept.items())
    none = "".join(f", NULL AS {k}" for k in made)
    known = ", ".join(f"{name}.{k} AS p_{k}" for k in kept)
    body = layers(f"SELECT x.*, {known} FROM {name} JOIN {source} x ON x.entity_id = {name}.entity_id AND x.seq = {name}.seq + 1", *steps)
    return f"{name} AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS seq, {start}{none} FROM {source} UNION ALL SELECT entity_id, seq, {', '.join([*kept, *made])} FROM ({body}) done)"


_AGAINST = "kind IN ('CONTRADICTING', 'REVERSING', 'STRUCTURAL/UNKNOWN')"
_D = "CAST({} AS DOUBLE)".format
_C, _E = M.COHERENCE_WEIGHTS, repr(M.EPSILON)
_PARTS = {"level": "level", "velocity": "velocity", "acceleration": "acceleration", "volume": "push"}
STATE_OUT = ["level", "velocity", "acceleration", "curvature", "innovation", "volume_influence", "perturbation_class", "perturbation", "coherence", "strength", "persistence", "uncertainty", "reversal", "half_life", "rate", "interval", "support", "health"]
_KEPT = {"now": _D("NULL"), "ref": _D("NULL"), "scale": _D("NULL"), "level": _D(0), "velocity": _D(0), "persistence": _D(0), "uncertainty": _D(0.15), "half_life": _D(M.HALF_LIFE), "rate": _D(M.RATE), "usual": _D(1), "gaps": "0", "clips": "0", "hits": "0"}
_MADE = [c for c in STATE_OUT if c not in _KEPT]
_TYPED = [f"{_D('NULL') if c not in ('perturbation_class', 'health') else 'CAST(NULL AS VARCHAR)'} AS {c}" for c in _MADE]

_STATE = recursion(
    "s",
    "o",
    _KEPT,
    _MADE,
    {"dt": "CASE WHEN p_now IS NULL THEN 1.0 ELSE greatest(0.0, now - p_now) END", "ref": "CASE WHEN p_ref IS NULL THEN price ELSE p_ref + 0.05 * (price - p_ref) END"},
    {"gaps": f"p_gaps + CASE WHEN p_now IS NOT NULL AND dt > {M.GAP_SECONDS!r} THEN 1 ELSE 0 END", "scale": "CASE WHEN p_ref IS NULL THEN 1.0 ELSE greatest(1e-4, 0.95 * p_scale + 0.05 * abs(price - ref)) END", "span": f"greatest(1e-6, dt) + {_E}"},
    {"level": f"(price - ref) / greatest(scale, {_E})"},
    {"raw_v": "(level - p_level) / span"},
    {"velocity": within("raw_v", -M.VELOCITY_BOUND, M.VELOCITY_BOUND)},
    {"raw_a": "(velocity - p_velocity) / span"},
    {"acceleration": within("raw_a", -M.ACCELERATION_BOUND, M.ACCELERATION_BOUND)},
    {"raw_c": "acceleration / pow(1 + velocity * velocity, 1.5)"},
    {"curvature": within("raw_c", -M.CURVATURE_BOUND, M.CURVATURE_BOUND), "residual": "level - (p_level + p_velocity * dt)", "usual": f"p_usual * (1 - {M.VOLUME_RATE!r}) + {M.VOLUME_RATE!r} * volume"},
    {"clips": "p_clips + CAST(velocity <> raw_v AS INTEGER) + CAST(acceleration <> raw_a AS INTEGER) + CAST(curvature <> raw_c AS INTEGER)", "innovation": f"abs(residual) / sqrt(greatest(dt + {_E}, {_E}))", "push": within(f"ln(1 + volume / greatest(usual, {_E})) + ln(1 + greatest(volume, 0.0)) / 10", 0.0, M.VOLUME_MOST)},
    {"volume_influence": "push", "perturbation": within("innovation / (1 + innovation)", 0.0, 1.0), "was": f"coalesce(nullif({side('p_level')}, 0), {side('p_velocity')})", "says": f"coalesce(nullif({side('residual')}, 0), {side('velocity - p_velocity')})"},
    {"kind": f"CASE WHEN quality < {M.QUALITY_FLOOR!r} THEN 'STRUCTURAL/UNKNOWN' WHEN perturbation <= sqrt({_E}) THEN 'NONE' WHEN was = 0 OR says = 0 THEN 'STRUCTURAL/UNKNOWN' WHEN was = says THEN 'REINFORCING' WHEN {side('velocity')} = says THEN 'REVERSING' ELSE 'CONTRADICTING' END", "mass": " + ".join(f"{_C[k]!r} * abs({v})" for k, v in _PARTS.items())},
    {"perturbation_class": "kind", "coherence": "CASE WHEN mass > " + _E + " THEN " + within("abs(" + " + ".join(f"{_C[k]!r} * {v}" for k, v in _PARTS.items()) + f") / (mass + {_E})", 0.0, 1.0) + " ELSE 0.0 END"},
    {"strength": logistic(M.STRENGTH_WEIGHTS, volume="push", velocity="abs(velocity)", acceleration="abs(acceleration)", coherence="coherence", uncertainty="p_uncertainty"), "agrees": f"CASE WHEN velocity * p_velocity >= 0 THEN 1 ELSE 0 END - abs(acceleration) / (1 + abs(acceleration)) / 4 - CASE WHEN {_AGAINST} THEN 0.4 ELSE 0.0 END"},
    {"persistence": f"(1 - {M.PERSISTENCE_RATE!r}) * p_persistence + {M.PERSISTENCE_RATE!r} * " + within("agrees", 0.0, 1.0), "uncertainty": logistic(M.UNCERTAINTY_WEIGHTS, innovation="innovation", incoherence="1 - coherence", structural="CASE WHEN kind = 'STRUCTURAL/UNKNOWN' THEN 1 ELSE 0 END", quality="1 - quality", instability="least(1.0, abs(residual))")},
    {"reversal": logistic(M.REVERSAL_WEIGHTS, oppose="CASE WHEN velocity * acceleration < 0 THEN 1 ELSE 0 END", against=f"CASE WHEN {_AGAINST} THEN 1 ELSE 0 END", impersistence="1 - persistence", extreme="least(1.0, abs(level) / 4)", uncertainty="uncertainty"), "gain": within("1 + persistence * strength * 0.2", 1.0, 1.35) + " * " + within("1 - uncertainty * 0.35", 0.5, 1.0), "learning": f"{M.RATE_LEARNING!r} * greatest(0.2, 1 - uncertainty) * greatest(0.5, strength) * " + within(f"1 + perturbation * ({M.MULTIPLIER_MOST!r} - 1)", 0.8, M.MULTIPLIER_MOST)},
    {"half_life": within(f"p_half_life * gain * CASE WHEN {_AGAINST} THEN 0.75 ELSE 1.0 END", M.HALF_LIFE_LEAST, M.HALF_LIFE_MOST), "proposed": "p_rate + " + within("learning", M.RATE_LEARNING_LEAST, M.RATE_LEARNING_MOST) + " * (strength - uncertainty) * 0.1", "stretch": "(0.7 + 0.6 * persistence) * (0.7 + 0.6 * strength) * (1.1 - 0.8 * uncertainty) * (1 - 0.35 * perturbation)"},
    {"rate": within("proposed", M.RATE_LEAST, M.RATE_MOST), "interval": within(f"{M.INTERVAL!r} * stretch", M.INTERVAL_LEAST, M.INTERVAL_MOST), "support": f"strength * persistence / greatest({_E}, uncertainty + reversal)"},
    {"hits": "p_hits + CAST(rate <> proposed AS INTEGER)"},
    {"health": "CASE WHEN gaps > 0 THEN 'DEGRADED_DATA' WHEN clips > 0 OR hits > 0 THEN 'DEGRADED_NUMERICAL' WHEN perturbation > 0.7 THEN 'PERTURBED' ELSE 'HEALTHY' END"},
).replace(", ".join(f"NULL AS {c}" for c in _MADE), ", ".join(_TYPED))

#: m: the state model over ticks; d: with tick columns and the path projected from each state.
STATE = RECURSIVE_TICKS + ", o AS (SELECT *, epoch(event_time) AS now, CASE WHEN label = 'error' THEN 0.4 ELSE 1.0 END AS quality FROM t), " + _STATE + ", m AS (SELECT * FROM s WHERE seq > 0)"
_SAMPLE = "{'tau': tau, 'level': level + velocity * tau + acceleration * tau * tau / 2}"
SHAPES = STATE + """, g AS (SELECT m.*, o.volume, o.quality, o.event_time, list_transform(range(1, 9), lambda i: m.interval * pow(i / 8.0, 1.8)) AS taus FROM m JOIN o USING (entity_id, seq)),
  h AS (SELECT *, list_transform(taus, lambda u: velocity * u + acceleration * u * u / 2) AS paths FROM g),
  i AS (SELECT *, (level + paths[8]) - level AS terminal, list_max(list_transform(paths, lambda x: abs((level + x) - level))) AS largest, pow(2.0, -interval / half_life) AS decay FROM h),
  j AS (SELECT *, CASE WHEN terminal > 0 THEN 'UPWARD' WHEN terminal < 0 THEN 'DOWNWARD' ELSE 'FLAT' END AS direction, CASE WHEN largest = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, abs(terminal) / abs(largest))) END AS geometry, cbrt(strength * coherence * persistence) AS structure, sqrt((1 - uncertainty) * (1 - reversal)) AS risk FROM i),
  d AS (SELECT *, geometry * structure * risk AS score FROM j)"""


def gate(score: str, p: str = "p_") -> list[dict[str, str]]:
    """The hysteresis gate: goes, next gate and count, from the gate and count before."""
    shut = f"({p}gate IN ('CLOSED', 'OPENING'))"
    return [
        {"goes": f"CASE WHEN {shut} THEN coalesce({score} >= 0.75, false) ELSE coalesce({score} <= 0.55, true) END"},
        {"more": f"CASE WHEN NOT goes THEN 0 WHEN {p}gate IN ('CLOSED', 'OPEN') THEN 1 ELSE {p}n + 1 END"},
        {"moved": f"CASE WHEN NOT goes THEN CASE WHEN {shut} THEN 'CLOSED' ELSE 'OPEN' END WHEN {p}gate = 'CLOSED' THEN 'OPENING' WHEN {p}gate = 'OPEN' THEN 'CLOSING' WHEN {p}gate = 'OPENING' THEN CASE WHEN more >= 3 THEN 'OPEN' ELSE {p}gate END ELSE CASE WHEN more >= 2 THEN 'CLOSED' ELSE {p}gate END END"},
    ]


HYSTERESIS = RECURSIVE_TICKS + ", o AS (SELECT *, CASE WHEN label <> 'signup' THEN volume / 90 END AS score FROM t), " + recursion(
    "s", "o", {"gate": "'CLOSED'", "n": "0"}, [], *gate("score"), {"gate": "moved", "n": "CASE WHEN moved IN ('OPEN', 'CLOSED') THEN 0 ELSE more END"}
) + " SELECT entity_id, seq, gate FROM s WHERE seq > 0"

_WORD = "CAST(NULL AS VARCHAR)"
ENVELOPE = SHAPES + ", v AS (SELECT entity_id, seq, epoch(event_time) AS now, epoch(event_time) + volume / 2 AS due, interval, direction AS path, score, quality = 1 AS eligible FROM d), " + recursion(
    "e",
    "v",
    {"gate": "'CLOSED'", "n": "0", "last": _D("NULL"), "opened": _D(0), "since": _D("NULL"), "way": _WORD, "has": "false"},
    ["state_before", "aperture_before", "safety", "candidate", "candidate_since", "direction", "events"],
    {"newer": "p_last IS NULL OR now > p_last", "safety": "CASE WHEN score IS NULL THEN 'INVALID_RETURNSHAPE' WHEN due > now + interval THEN 'SHAPE_STALE' WHEN NOT eligible THEN 'MARKET_INELIGIBLE' END"},
    *gate("score"),
    {"lost": "p_has AND (newer OR safety IS NOT NULL)", "gate": "CASE WHEN safety IS NOT NULL THEN 'CLOSED' ELSE moved END", "n": "CASE WHEN safety IS NOT NULL OR moved IN ('OPEN', 'CLOSED') THEN 0 ELSE more END", "opened": "CASE WHEN safety IS NOT NULL THEN 0.0 ELSE " + within("0.5 * " + within("score", 0.0, 1.0) + " + (1 - 0.5) * p_opened", 0.0, 1.0) + " END"},
    {"stays": "p_has AND NOT lost", "made": "safety IS NULL AND gate = 'OPEN' AND NOT (p_has AND NOT lost)"},
    {
        "has": "stays OR made", "since": "CASE WHEN made THEN due WHEN stays THEN p_since END", "way": "CASE WHEN made THEN path WHEN stays THEN p_way END", "last": "greatest(now, coalesce(p_last, now))", "state_before": "p_gate", "aperture_before": "p_opened",
        "candidate": "CASE WHEN stays OR made THEN 'QUALIFIED' WHEN lost AND safety IS NOT NULL THEN 'INVALIDATED' END",
        "candidate_since": "CASE WHEN made THEN due WHEN stays OR (lost AND safety IS NOT NULL) THEN p_since END",
        "direction": "CASE WHEN made THEN path WHEN stays OR (lost AND safety IS NOT NULL) THEN p_way END",
        "events": """list_filter([CASE WHEN newer AND p_last IS NOT NULL THEN 'SHAPE_SUPERSEDED' END, CASE WHEN newer AND p_has THEN 'CANDIDATE_INVALIDATED' END, CASE WHEN newer THEN 'RETURN_SHAPE_ACCEPTED' ELSE 'CONTEXT_REEVALUATED' END, 'CAPTURABILITY_EVALUATED',
          CASE WHEN safety IS NOT NULL AND p_has AND NOT newer THEN 'CANDIDATE_INVALIDATED' END, safety, CASE WHEN safety IS NOT NULL AND p_gate <> 'CLOSED' THEN 'ENVELOPE_CLOSED' END,
          CASE WHEN safety IS NOT NULL THEN NULL WHEN p_gate = 'CLOSED' AND gate = 'OPENING' THEN 'ENVELOPE_OPENING' WHEN p_gate = 'OPENING' AND gate = 'OPEN' THEN 'ENVELOPE_OPENED' WHEN p_gate = 'OPEN' AND gate = 'CLOSING' THEN 'ENVELOPE_CLOSING' WHEN p_gate = 'CLOSING' AND gate = 'CLOSED' THEN 'ENVELOPE_CLOSED' END,
          CASE WHEN made THEN 'CANDIDATE_QUALIFIED' END, 'APERTURE_UPDATED'], lambda x: x IS NOT NULL)""",
    },
)
for _c, _t in (("state_before", "VARCHAR"), ("aperture_before", "DOUBLE"), ("safety", "VARCHAR"), ("candidate", "VARCHAR"), ("candidate_since", "DOUBLE"), ("direction", "VARCHAR"), ("events", "VARCHAR[]")):
    ENVELOPE = ENVELOPE.replace(f"NULL AS {_c}", f"CAST(NULL AS {_t}) AS {_c}", 1)


def colours(source: str, session: str) -> str:
    """The price colour's recursion over source (entity_id, seq, session, raw_colour)."""
    fresh = "p_session IS DISTINCT FROM session"
    return recursion(
        "s", source, {"session": _WORD, "colour": _WORD, "pending": _WORD}, [],
        {"shown": f"CASE WHEN {fresh} THEN NULL ELSE p_colour END", "waits": f"CASE WHEN {fresh} THEN NULL ELSE p_pending END"},
        {"turns": "coalesce((shown = 'GREEN' AND raw_colour = 'RED') OR (shown = 'RED' AND raw_colour = 'GREEN'), false) AND waits IS DISTINCT FROM raw_colour"},
        {"colour": "CASE WHEN turns THEN 'AMBER' ELSE raw_colour END", "pending": "CASE WHEN turns THEN raw_colour END"},
    )


VOLUME_COLOURS = RECURSIVE_TICKS + ", u AS (SELECT *, CAST(CAST(event_time AS DATE) AS VARCHAR) AS session, avg(volume) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS usual FROM t), o AS (SELECT *, CASE WHEN usual > 0 THEN volume / usual END AS x FROM u), " + recursion(
    "s", "o", {"session": _WORD, "colour": _WORD, "pending": _WORD, "n": "0"}, ["raw", "change"],
    {"same": "p_session IS NOT DISTINCT FROM session", "raw": "CASE WHEN x IS NULL THEN 'INVALID' WHEN x >= 1.2 THEN 'GREEN' WHEN x <= 0.8 THEN 'RED' ELSE 'AMBER' END"},
    {"differs": "raw <> 'INVALID' AND same AND p_colour IS NOT NULL AND p_colour <> raw"},
    {"n": "CASE WHEN NOT differs THEN 0 WHEN p_pending IS NOT DISTINCT FROM raw THEN p_n + 1 ELSE 1 END"},
    {"change": "CASE WHEN raw = 'INVALID' THEN 'INVALID' WHEN NOT differs THEN 'STABLE' WHEN n >= 2 THEN 'CONFIRMED_' || raw ELSE 'PENDING_' || raw END", "colour": "CASE WHEN differs AND n < 2 THEN 'AMBER' ELSE raw END", "pending": "CASE WHEN differs AND n < 2 THEN raw END"},
).replace("NULL AS raw, NULL AS change", f"{_WORD} AS raw, {_WORD} AS change") + " SELECT entity_id, seq, raw AS raw_colour, colour, change FROM s WHERE seq > 0"


def cockpit(source: str) -> str:
    """The cockpit's recursion over source (entity_id, seq, session, p1, p2, q1, caution)."""
    e = "1e-6"
    return recursion(
        "s", source, {"session": _WORD, "colour": _WORD, "against": _WORD, "rows_": "0", "held": _WORD, "age": "0"}, ["shown", "proximity", "deceleration"],
        {"same": "p_session IS NOT DISTINCT FROM session", "way": f"CASE WHEN p1 > {e} THEN 1 WHEN p1 < -{e} THEN -1 ELSE 0 END"},
        {"slowing": "way <> 0 AND way * p2 < 0 AND way * q1 < way * p1", "speeding": "way <> 0 AND way * p2 > 0 AND way * q1 >= way * p1", "ahead": "CASE WHEN way > 0 THEN 'UP' ELSE 'DOWN' END", "back": "CASE WHEN way > 0 THEN 'DOWN' ELSE 'UP' END", "proximity": f"abs(q1) / greatest(abs(p1), abs(q1), {e})", "deceleration": f"greatest(0.0, way * (p1 - q1)) / greatest(abs(p1), {e})"},
        {"against": "CASE WHEN slowing THEN back END"},
        {"rows_": "CASE WHEN against IS NULL THEN 0 WHEN same AND against = p_against THEN p_rows_ + 1 ELSE 1 END"},
        {"fires": "(way <> 0 AND way * q1 <= 0) OR (slowing AND rows_ >= 2 AND proximity <= 0.25 AND deceleration >= 0.5)"},
        {"held": "CASE WHEN fires THEN back WHEN same AND p_held IS NOT NULL AND p_age < 2 THEN p_held END", "age": "CASE WHEN fires THEN CASE WHEN same AND p_held = back THEN p_age + 1 ELSE 1 END WHEN same AND p_held IS NOT NULL AND p_age < 2 THEN p_age + 1 ELSE 0 END"},
        {"flips": "held IS NULL AND way <> 0 AND same AND coalesce(p_colour = CASE WHEN way > 0 THEN 'RED' ELSE 'GREEN' END, false)"},
        {"shown": "CASE WHEN way = 0 THEN 'NEAR_STATIONARY' WHEN held IS NOT NULL THEN 'TURN_' || held || '_CANDIDATE' WHEN flips THEN 'DIRECTION_CHANGE_TRANSITION' WHEN caution THEN 'UNCERTAIN' ELSE ahead || CASE WHEN speeding THEN '_ACCELERATING' WHEN slowing THEN '_DECELERATING' ELSE '_STABLE' END END", "colour": "CASE WHEN way = 0 OR held IS NOT NULL OR flips OR caution THEN 'AMBER' WHEN way > 0 THEN 'GREEN' ELSE 'RED' END"},
    ).replace("NULL AS shown, NULL AS proximity, NULL AS deceleration", f"{_WORD} AS shown, {_D('NULL')} AS proximity, {_D('NULL')} AS deceleration")
