"""Scalar functions of the estimators and policies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles divide: over 0 it is infinite with the sign of both, and 0 / 0 is not a number."""
    b = b.cast("double")
    return F.when(b == 0, a * F.when(b.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(F.try_divide(a, b))


def rounded(x: Column | str, digits: int) -> Column:
    """x to digits places as SQL's double arithmetic tells them: scaled, rounded half away from 0, scaled back; what scaling takes out of range stays as it is. F.round reads a double's decimal text, which is a tie more often."""
    scale, beyond = float(10**digits), float("inf")
    if isinstance(x, str):  # by arithmetic, to the same bits: F.round makes a decimal of each value
        at = F.abs(F.col(x).cast("double") * scale)
        whole = F.floor(at).cast("double")
        near = F.signum(F.col(x).cast("double")) * F.when(at - whole >= 0.5, whole + 1).otherwise(whole) + 0.0
        return F.when(at == beyond, F.col(x).cast("double")).otherwise(F.when(at < 2.0**52, near).otherwise(F.col(x).cast("double") * scale) / scale)
    near = F.round(x.cast("double") * scale) / scale
    return F.when(F.abs(near) == beyond, x.cast("double")).otherwise(near)


def whole(x: Column) -> Column:
    """A double rounded half away from 0, to the bits of F.round(x), which makes a decimal of each value."""
    near, side = F.rint(x), F.signum(x)  # rint takes halves to the even neighbour
    return near + F.when(x - near == side / 2, side).otherwise(0.0) + 0.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def half_life_decay(elapsed: Column, half_life: Column) -> Column:
    """2 ** (-elapsed / half_life) within 0..1; 1 where no time has passed."""
    return F.when(elapsed <= 0, F.lit(1.0)).otherwise(clamp(F.pow(F.lit(2.0), -elapsed / half_life), 0.0, 1.0))


def curvature(velocity: Column, acceleration: Column) -> Column:
    return acceleration / F.pow(1 + velocity * velocity, F.lit(1.5))


def volume_influence(volume: Column, reference: Column) -> Column:
    return clamp(F.log1p(volume / reference) + F.log1p(volume) / 10, 0.0, 3.0)


def geometry_quality(terminal: Column, largest: Column) -> Column:
    """Share of the largest excursion that is left at the end; 0 where there was none."""
    return F.when(largest == 0, F.lit(0.0)).otherwise(clamp(F.abs(terminal) / F.abs(largest), 0.0, 1.0))


def structural_quality(a: Column, b: Column, c: Column) -> Column:
    """Geometric mean of three scores."""
    return F.cbrt(a * b * c)


def risk_quality(uncertainty: Column, reversal: Column) -> Column:
    return F.sqrt((1 - uncertainty) * (1 - reversal))


def sign_within(x: Column, tolerance: float = 0.0) -> Column:
    """-1, 0 or 1; 0 within the tolerance."""
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def signed_class(x: Column, neutral: float) -> Column:
    return F.when(x > neutral, F.lit("UP")).when(x < -neutral, F.lit("DOWN")).otherwise(F.lit("NEUTRAL"))


def forward_samples(level: Column, velocity: Column, acceleration: Column, length: Column, n: int = 8, power: float = 1.8) -> Column:
    """array<struct<tau, level>> at length * (i / n) ** power, propagated by velocity and acceleration."""
    shares = F.array(*[F.pow(F.lit(i) / F.lit(float(n)), F.lit(power)) for i in range(1, n + 1)])  # folded into one constant
    return F.transform(F.transform(shares, lambda x: length * x), lambda t: F.struct(t.alias("tau"), (level + velocity * t + acceleration * t * t / 2).alias("level")))


def session_class(time: Column, end_inclusive: bool = True) -> Column:
    """Trading session by minute of day; whether 20:00 itself still is AFTERHOURS is the caller's choice."""
    minute = F.hour(time) * 60 + F.minute(time)
    after = (minute < 1200) | ((minute == 1200) & (F.second(time) == 0) if end_inclusive else F.lit(False))
    return F.when((minute >= 570) & (minute < 960), "REGULAR").when((minute >= 240) & (minute < 570), "PREMARKET").when((minute >= 960) & after, "AFTERHOURS").otherwise("UNKNOWN")


def minute_of_session(time: Column) -> Column:
    minute = F.hour(time) * 60 + F.minute(time)
    return F.when((minute >= 570) & (minute < 960), minute - 570).otherwise(-1)


def phase_of(rank: Column, total: Column) -> Column:
    """First 60 %, next 20 %, last 20 % of an ordered set."""
    return F.when(10 * (rank - 1) < 6 * total, "PHASE_1").when(10 * (rank - 1) < 8 * total, "PHASE_2").otherwise("PHASE_3")


def regime_of(x: Column, q25: Column, q75: Column, q95: Column) -> Column:
    return F.when(x <= q25, "LOW").when(x <= q75, "NORMAL").when(x <= q95, "ELEVATED").otherwise("EXTREME")


def projected_samples(level: Column, velocity: Column, acceleration: Column, strength: Column, persistence: Column, uncertainty: Column, reversal: Column, length: Column, half_life: Column) -> Column:
    """The samples of forward_samples with what decays by half_life over their tau, and what grows as that goes."""
    parts = F.transform(forward_samples(level, velocity, acceleration, length), lambda s: F.struct(s["tau"].alias("tau"), s["level"].alias("level"), F.pow(F.lit(2.0), -s["tau"] / half_life).alias("part")))
    return F.transform(
        parts,
        lambda s: F.struct(
            s["tau"].alias("tau"),
            s["level"].alias("level"),
            (velocity * s["part"]).alias("velocity"),
            clamp(uncertainty + (1 - s["part"]) * 0.15, 0.0, 1.0).alias("uncertainty"),
            clamp(strength * s["part"], 0.0, 1.0).alias("strength"),
            clamp(persistence * s["part"], 0.0, 1.0).alias("persistence"),
            clamp(reversal + (1 - s["part"]) * 0.1, 0.0, 1.0).alias("reversal"),
        ),
    )


def motion_phase(p1: Column, p2: Column, q1: Column, epsilon: float) -> Column:
    """Phase of a motion from velocity, acceleration and projected velocity."""
    still = F.when(q1 > epsilon, "TURNING_UP").when(q1 < -epsilon, "TURNING_DOWN").otherwise("NEAR_STATIONARY")
    rising = F.when(q1 <= -epsilon, "TURNING_DOWN").when(p2 > 0, "UP_ACCELERATING").otherwise("UP_DECELERATING")
    falling = F.when(q1 >= epsilon, "TURNING_UP").when(p2 > 0, "DOWN_DECELERATING").otherwise("DOWN_ACCELERATING")
    return F.when(F.abs(p1) <= epsilon, still).when(p1 > 0, rising).otherwise(falling)


def raw_colour(phase: Column, q1: Column, confidence: Column, epsilon: float) -> Column:
    up, down = phase.isin("UP_ACCELERATING", "TURNING_UP") & (q1 > epsilon), phase.isin("DOWN_ACCELERATING", "TURNING_DOWN") & (q1 < -epsilon)
    return F.when(confidence == "LOW", "AMBER").when(up, "GREEN").when(down, "RED").otherwise("AMBER")


def target_rule(emergency: Column, enabled: Column, trading: Column, unsafe: Column, state: Column, candidate: Column, direction: Column) -> Column:
    """The first rule that applies, from emergency to a qualified candidate."""
    of_open = F.when(candidate.isNull(), "R34").when(candidate != "QUALIFIED", "R35").when(direction == "FLAT", "R36").when(direction == "UPWARD", "R40").when(direction == "DOWNWARD", "R41").otherwise("R34")
    of_state = F.when(state == "CLOSED", "R31").when(state == "OPENING", "R32").when(state == "CLOSING", "R33").when(state == "OPEN", of_open).otherwise("R34")
    return F.when(emergency, "R10").when(~enabled, "R20").when(~trading, "R21").when(unsafe, "R30").otherwise(of_state)


def target_position(rule: Column, has: Column) -> Column:
    return F.when(rule.isin("R20", "R21"), has).when(rule == "R40", "LONG").when(rule == "R41", "SHORT").otherwise("FLAT")


def transition_intent(has: Column, wants: Column, pending: Column) -> Column:
    """What a change of position takes; a pending target overrules."""
    free = F.when(has == wants, "NO_CHANGE").when(has == "FLAT", "OPEN").when(wants == "FLAT", "CLOSE").otherwise("REVERSE")
    return F.when(pending == "NONE", free).when(pending == wants, "NO_CHANGE").otherwise("RETARGET")


def transition_window(time: Column) -> Column:
    """The quarter hours after the open, before the close and after the close, else NONE."""
    m = F.hour(time) * 60 + F.minute(time)
    return F.when(m.between(570, 584), "FIRST_15_AFTER_0930").when(m.between(945, 959), "LAST_15_BEFORE_1600").when(m.between(960, 974), "FIRST_15_AFTER_1600").otherwise("NONE")


def direction_claim(*evidence: Column) -> Column:
    """The sign of the first evidence that has one; 0 if none has."""
    return F.coalesce(*[F.nullif(F.signum(x).cast("int"), F.lit(0)) for x in evidence], F.lit(0))


def ambiguity_index(efficiency: Column, deviation: Column, category: Column) -> Column:
    """From 0 to 1: detours, scatter and an inconclusive category; null where one isn't known."""
    unclear = (category == "AMBIGUOUS/INCONCLUSIVE").cast("double")
    return ((1 - efficiency) + deviation / (1 + deviation) + unclear) / 3


def support_label(blocks: Column) -> Column:
    return F.when(blocks >= 30, "ADEQUATE").when(blocks >= 10, "LIMITED").otherwise("INSUFFICIENT")


def evidence_class(effect: Column, lo: Column, hi: Column, support: Column) -> Column:
    """What an effect, its interval and its support allow to say."""
    unknown = effect.isNull() | lo.isNull() | hi.isNull() | (support == "INSUFFICIENT")
    full = support == "ADEQUATE"
    return F.when(unknown, "INCONCLUSIVE").when(full & (hi < 0), "UNSUPPORTED").when(full & (effect > 0) & (lo > 0), "EMPIRICALLY_SUPPORTED").when((effect > 0) | (support == "LIMITED"), "PARTIALLY_SUPPORTED").otherwise("INCONCLUSIVE")


def effect_class(delta: Column, threshold: float) -> Column:
    return F.when(delta > threshold, "BENEFICIAL").when(delta < -threshold, "HARMFUL").when(F.abs(delta) <= threshold, "NO MEASURABLE EFFECT").otherwise("MIXED")


def condition_class(condition: Column) -> Column:
    """Words for a condition number; null, infinite and NaN are SINGULAR."""
    bad = condition.isNull() | F.isnan(condition) | (condition == float("inf"))
    return F.when(bad, "SINGULAR").when(condition < 1e4, "WELL CONDITIONED").when(condition < 1e8, "MODERATELY CONDITIONED").when(condition < 1e12, "POORLY CONDITIONED").otherwise("SEVERELY ILL-CONDITIONED")


def effective_mass(relative_volume: Column, density: Column, coherence: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.5 * relative_volume + 0.35 * F.least(F.lit(1.0), density / 5000) + 0.15 * F.abs(coherence))


def signal_strength(mass: Column, movement: Column, coherence: Column) -> Column:
    return clamp(0.45 * mass + 0.45 * movement + 0.1 * coherence, 0.0, 1.0)


def percent_encoded(text: Column) -> Column:
    """A text with all but letters, digits and -._~ percent-encoded, blanks as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def coerced(df, kinds: dict[str, str]):
    """df with text columns as double, bigint or boolean; blank and unreadable texts are null."""
    made = {}
    for name, kind in kinds.items():
        text = F.nullif(F.trim(F.col(name)), F.lit(""))
        if kind == "boolean":
            made[name] = F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
        else:
            whole = F.when(text.rlike("^-?[0-9]+$"), text) if kind == "bigint" else text
            made[name] = whole.try_cast(kind)
    return df.withColumns(made)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON text of fields in the order of their names, without blanks; null fields stay, as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
