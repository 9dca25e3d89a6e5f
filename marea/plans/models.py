"""Queries of the estimator chain: state model, shapes, envelope, decisions, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import models as M
from ..operators.folds import fold, hysteresis_step, linear_fold
from ..operators.ordered import along, quadratic_fit
from ..sources.ticks import ticks
from . import chain_sql as C
from .registry import TICKS, query


def r6(x):
    return F.round(x, 6)


def q20(x):
    """On a grid of 2 ** -20, as chain_sql.q20: true values, told alike by engines that differ in the last bits."""
    return S.whole((F.col(x) if isinstance(x, str) else x) * 1048576.0) / 1048576.0


def grid(df):
    """Entity and row, with doubles on the grid."""
    return df.select(*[q20(f"`{f.name}`").alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def gridded(names, words=()):
    return "entity_id, seq, " + ", ".join(n if n in words else f"{C.q20(n)} AS {n}" for n in names)


def states(spark, sf, carry=()):
    """The state model over ticks; error ticks have quality 0.4."""
    return states_of(ticks(spark, sf), carry)


def states_of(ticks, carry=(), only=None):
    """States of rows like ticks, with other columns to carry; only names the columns of the model that are wanted, else all are."""
    out = ", ".join(c for c in M.STATE_COLUMNS.split(", ") if only is None or c.split()[0] in only)
    t = ticks.withColumn("t", F.col("event_time").cast("timestamp").cast("double")).withColumn("quality", F.when(F.col("label") == "error", 0.4).otherwise(1.0))
    return fold(t, M.state_step, ["t", "price", "volume", "quality"], out, carry=list(carry), many=M.STATES)


def shapes(df):
    """Projected samples of each state and the displacement, direction and qualities of its path."""
    c = F.col
    df = df.withColumn("samples", S.projected_samples(c("level"), c("velocity"), c("acceleration"), c("strength"), c("persistence"), c("uncertainty"), c("reversal"), c("interval"), c("half_life")))
    moved = F.transform("samples", lambda s: s["level"] - c("level"))
    df = df.withColumns({"terminal": F.element_at(moved, -1), "largest": F.array_max(F.transform(moved, F.abs)), "decay": F.pow(F.lit(2.0), -c("interval") / c("half_life"))})
    df = df.withColumns({"direction": F.when(c("terminal") > 0, "UPWARD").when(c("terminal") < 0, "DOWNWARD").otherwise("FLAT"), "geometry": S.geometry_quality(c("terminal"), c("largest"))})
    return df.withColumn("score", c("geometry") * S.structural_quality(c("strength"), c("coherence"), c("persistence")) * S.risk_quality(c("uncertainty"), c("reversal")))


@query(C.STATE + f" SELECT {gridded(C.STATE_OUT, ("perturbation_class", "health"))} FROM m")
def q_state_model(spark, sf):
    return grid(states(spark, sf))


KINEMATICS = ["level", "velocity", "acceleration", "curvature", "innovation"]


@query(C.STATE + f" SELECT {gridded(KINEMATICS)} FROM m")
def q_kinematics(spark, sf):
    return grid(states(spark, sf).select("entity_id", "seq", *KINEMATICS))


@query(C.STATE + " SELECT perturbation_class, health, count(*) AS n, round(avg(perturbation), 6) AS mean FROM m GROUP BY 1, 2")
def q_perturbation_counts(spark, sf):
    return states(spark, sf).groupBy("perturbation_class", "health").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("perturbation")).alias("mean"))


_AFTER = {"tau": "taus[k]", "level": "level + paths[k]", "velocity": "velocity * part", "uncertainty": "greatest(0, least(1, uncertainty + (1 - part) * 0.15))", "strength": "greatest(0, least(1, strength * part))", "persistence": "greatest(0, least(1, persistence * part))", "reversal": "greatest(0, least(1, reversal + (1 - part) * 0.1))"}


@query(C.SHAPES + ", k AS (SELECT *, unnest(range(1, 9)) AS k FROM d), x AS (SELECT *, pow(2.0, -taus[k] / half_life) AS part FROM k) SELECT entity_id, seq, CAST(k - 1 AS INTEGER) AS k, " + ", ".join(f"{C.q20(x)} AS {n}" for n, x in _AFTER.items()) + " FROM x")
def q_forward_samples(spark, sf):
    """Outer, as samples are never missing or empty: else Spark makes them twice, once to leave out rows without."""
    return grid(shapes(states(spark, sf)).select("entity_id", "seq", F.posexplode_outer("samples").alias("k", "s")).select("entity_id", "seq", "k", "s.*"))


SHAPE = ["interval", "half_life", "terminal", "largest", "direction", "decay", "geometry", "score", "support"]


@query(C.SHAPES + f" SELECT {gridded(SHAPE, ('direction',))} FROM d")
def q_return_shape(spark, sf):
    return grid(shapes(states(spark, sf)).select("entity_id", "seq", *SHAPE))


def envelopes(spark, sf):
    """Each tick's shape evaluated as many seconds later as half its volume says; error ticks are ineligible. One shuffle: the second fold follows the first one's order."""
    t = shapes(states(spark, sf, ["t", "volume", "quality"]))
    t = t.select("entity_id", "seq", "t", (F.col("t") + F.col("volume") / 2).alias("at"), "interval", "direction", "score", F.col("score").isNotNull().alias("valid"), (F.col("quality") == 1).alias("eligible"))
    return fold(t, M.envelope_step, ["t", "at", "interval", "direction", "score", "valid", "eligible"], M.ENVELOPE_COLUMNS, in_order=True)


@query(C.ENVELOPE + f" SELECT entity_id, seq, state_before, gate AS state, {C.q20('aperture_before')} AS aperture_before, {C.q20('opened')} AS aperture, safety, candidate, candidate_since, direction, array_to_string(events, ';') AS events FROM e WHERE seq > 0")
def q_envelope(spark, sf):
    e = envelopes(spark, sf)
    return e.withColumns({"aperture_before": q20("aperture_before"), "aperture": q20("aperture"), "events": F.array_join("events", ";")})


@query(C.HYSTERESIS)
def q_hysteresis(spark, sf):
    """A gate that volumes open and close; signups have no score."""
    t = ticks(spark, sf).withColumn("score", F.when(F.col("label") != "signup", F.col("volume") / 90))
    return fold(t, hysteresis_step, ["score"], "gate string")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'LONG' WHEN 'O' THEN 'FLAT' ELSE 'SHORT' END AS has, ['NONE', 'LONG', 'FLAT', 'SHORT'][o_custkey % 4 + 1] AS pending,
  o_orderkey % 29 = 0 AS emergency, o_orderkey % 23 <> 0 AS enabled, o_orderkey % 19 <> 0 AS trading, o_orderkey % 17 = 0 AS unsafe, ['CLOSED', 'OPENING', 'OPEN', 'OPEN', 'OPEN', 'CLOSING'][o_orderkey % 6 + 1] AS state,
  CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'INVALIDATED' ELSE 'QUALIFIED' END AS candidate, ['UPWARD', 'DOWNWARD', 'FLAT'][o_custkey % 3 + 1] AS direction FROM orders),
  r AS (SELECT *, CASE WHEN emergency THEN 'R10' WHEN NOT enabled THEN 'R20' WHEN NOT trading THEN 'R21' WHEN unsafe THEN 'R30' WHEN state = 'CLOSED' THEN 'R31' WHEN state = 'OPENING' THEN 'R32' WHEN state = 'CLOSING' THEN 'R33'
    WHEN candidate IS NULL THEN 'R34' WHEN candidate <> 'QUALIFIED' THEN 'R35' WHEN direction = 'FLAT' THEN 'R36' WHEN direction = 'UPWARD' THEN 'R40' ELSE 'R41' END AS rule FROM o),
  w AS (SELECT *, CASE WHEN rule IN ('R20', 'R21') THEN has WHEN rule = 'R40' THEN 'LONG' WHEN rule = 'R41' THEN 'SHORT' ELSE 'FLAT' END AS wants FROM r),
  i AS (SELECT *, CASE WHEN pending <> 'NONE' AND pending <> wants THEN 'RETARGET' WHEN pending <> 'NONE' OR has = wants THEN 'NO_CHANGE' WHEN has = 'FLAT' THEN 'OPEN' WHEN wants = 'FLAT' THEN 'CLOSE' ELSE 'REVERSE' END AS intent FROM w)
  SELECT o_orderkey, rule, has, wants, intent, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), rule, has, wants, intent)) AS decision_id FROM i""")
def q_decision_rules(spark, sf):
    """The rule waterfall, the intent it takes and the decision's fingerprint."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        key,
        F.when(F.col("o_orderstatus") == "F", "LONG").when(F.col("o_orderstatus") == "O", "FLAT").otherwise("SHORT").alias("has"),
        pick(("NONE", "LONG", "FLAT", "SHORT"), cust % 4).alias("pending"),
        S.target_rule(key % 29 == 0, key % 23 != 0, key % 19 != 0, key % 17 == 0, pick(("CLOSED", "OPENING", "OPEN", "OPEN", "OPEN", "CLOSING"), key % 6), F.when(cust % 7 == 0, None).when(cust % 7 == 1, "INVALIDATED").otherwise("QUALIFIED"), pick(("UPWARD", "DOWNWARD", "FLAT"), cust % 3)).alias("rule"),
    )
    o = o.withColumn("wants", S.target_position(F.col("rule"), F.col("has"))).withColumn("intent", S.transition_intent(F.col("has"), F.col("wants"), F.col("pending")))
    return o.select(key, "rule", "has", "wants", "intent", F.sha2(F.concat_ws("|", key.cast("string"), "rule", "has", "wants", "intent"), 256).alias("decision_id"))


MOTION = TICKS + """, a AS (SELECT entity_id, seq, event_time, price - lag(price) OVER w AS p1, price - 2 * lag(price) OVER w + lag(price, 2) OVER w AS p2 FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY seq)),
  m AS (SELECT *, CASE WHEN abs(p2) > 400 THEN 'LOW' WHEN abs(p2) > 200 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, p1 + p2 / 2 AS q1 FROM a WHERE p2 IS NOT NULL)"""


def motion(spark, sf):
    """First and second differences of the price, the velocity half a row ahead, and a confidence that falls with the acceleration."""
    w, p = along("entity_id"), F.col("price")
    t = ticks(spark, sf).withColumns({"p1": p - F.lag(p).over(w), "p2": p - 2 * F.lag(p).over(w) + F.lag(p, 2).over(w), "session": F.to_date("event_time").cast("string")}).where("p2 is not null")
    t = t.withColumns({"q1": F.col("p1") + F.col("p2") / 2, "confidence": F.when(F.abs("p2") > 400, "LOW").when(F.abs("p2") > 200, "MEDIUM").otherwise("HIGH")})
    t = t.withColumn("phase", S.motion_phase(F.col("p1"), F.col("p2"), F.col("q1"), 1e-6))
    return t.withColumns({"raw_colour": S.raw_colour(F.col("phase"), F.col("q1"), F.col("confidence"), 1e-6), "caution": F.col("confidence") == "LOW"})


@query(MOTION + """, f AS (SELECT *, CASE WHEN abs(p1) <= 1e-6 THEN CASE WHEN q1 > 1e-6 THEN 'TURNING_UP' WHEN q1 < -1e-6 THEN 'TURNING_DOWN' ELSE 'NEAR_STATIONARY' END
  WHEN p1 > 0 THEN CASE WHEN q1 <= -1e-6 THEN 'TURNING_DOWN' WHEN p2 > 0 THEN 'UP_ACCELERATING' ELSE 'UP_DECELERATING' END
  ELSE CASE WHEN q1 >= 1e-6 THEN 'TURNING_UP' WHEN p2 > 0 THEN 'DOWN_DECELERATING' ELSE 'DOWN_ACCELERATING' END END AS phase FROM m)
  SELECT entity_id, seq, phase, confidence, CASE WHEN confidence = 'LOW' THEN 'AMBER' WHEN phase IN ('UP_ACCELERATING', 'TURNING_UP') AND q1 > 1e-6 THEN 'GREEN' WHEN phase IN ('DOWN_ACCELERATING', 'TURNING_DOWN') AND q1 < -1e-6 THEN 'RED' ELSE 'AMBER' END AS raw_colour FROM f""")
def q_price_phase(spark, sf):
    return motion(spark, sf).select("entity_id", "seq", "phase", "confidence", "raw_colour")


_PHASE = """CASE WHEN abs(p1) <= 1e-6 THEN CASE WHEN q1 > 1e-6 THEN 'TURNING_UP' WHEN q1 < -1e-6 THEN 'TURNING_DOWN' ELSE 'NEAR_STATIONARY' END
  WHEN p1 > 0 THEN CASE WHEN q1 <= -1e-6 THEN 'TURNING_DOWN' WHEN p2 > 0 THEN 'UP_ACCELERATING' ELSE 'UP_DECELERATING' END
  ELSE CASE WHEN q1 >= 1e-6 THEN 'TURNING_UP' WHEN p2 > 0 THEN 'DOWN_DECELERATING' ELSE 'DOWN_ACCELERATING' END END"""
_RECURSIVE_MOTION = MOTION.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + f""", f AS (SELECT *, {_PHASE} AS phase FROM m), o AS (SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS BIGINT) AS seq, seq AS tick, CAST(CAST(event_time AS DATE) AS VARCHAR) AS session, p1, p2, q1, confidence = 'LOW' AS caution,
  CASE WHEN confidence = 'LOW' THEN 'AMBER' WHEN phase IN ('UP_ACCELERATING', 'TURNING_UP') AND q1 > 1e-6 THEN 'GREEN' WHEN phase IN ('DOWN_ACCELERATING', 'TURNING_DOWN') AND q1 < -1e-6 THEN 'RED' ELSE 'AMBER' END AS raw_colour FROM f), """


@query(_RECURSIVE_MOTION + C.colours("o", "session") + " SELECT s.entity_id, o.tick AS seq, o.raw_colour, s.colour FROM s JOIN o USING (entity_id, seq)")
def q_price_policy(spark, sf):
    return fold(motion(spark, sf), M.price_colour_step, ["session", "raw_colour"], "colour string", carry=["raw_colour"])


@query(_RECURSIVE_MOTION + C.cockpit("o") + f" SELECT s.entity_id, o.tick AS seq, shown AS motion, {C.q20('proximity')} AS zero_proximity, {C.q20('s.deceleration')} AS deceleration, CAST(rows_ AS BIGINT) AS opposing_rows, coalesce(held, 'NONE') AS turn, CAST(age AS BIGINT) AS turn_age, colour FROM s JOIN o USING (entity_id, seq)")
def q_price_cockpit(spark, sf):
    return grid(fold(motion(spark, sf), M.cockpit_step, ["session", "p1", "p2", "q1", "caution"], M.COCKPIT_COLUMNS))


@query(C.VOLUME_COLOURS)
def q_volume_policy(spark, sf):
    t = ticks(spark, sf).withColumns({"session": F.to_date("event_time").cast("string"), "usual": F.avg("volume").over(along("entity_id").rowsBetween(-14, 0))})
    t = t.withColumn("activity", F.col("volume") / F.when(F.col("usual") > 0, F.col("usual")))
    return fold(t, M.volume_colour_step, ["session", "activity"], "raw_colour string, colour string, change string")


@query(TICKS + """, o AS (SELECT entity_id, list(volume ORDER BY seq) AS v FROM t GROUP BY 1), k AS (SELECT entity_id, v, unnest(range(1, len(v) + 1)) AS seq FROM o),
  u AS (SELECT entity_id, seq, v[seq] AS x, list_reduce(list_concat([1.0], v[1:seq]), lambda r, y: r * 0.95 + 0.05 * y) AS usual FROM k)
  SELECT entity_id, seq, round(usual * 1048576) / 1048576 AS usual, round(greatest(0, least(3, ln(1 + x / greatest(usual, 1e-8)) + ln(1 + greatest(x, 0)) / 10)) * 1048576) / 1048576 AS influence FROM u""")
def q_volume_influence(spark, sf):
    f = linear_fold(ticks(spark, sf), "volume", "usual", M.VOLUME_RATE, start=1.0)
    return grid(f.select("entity_id", "seq", "usual", S.volume_influence(F.col("volume"), F.greatest(F.col("usual"), F.lit(M.EPSILON))).alias("influence")))


@query(TICKS + """, u AS (SELECT *, count(*) FILTER (WHERE label = 'error') OVER (PARTITION BY entity_id ORDER BY seq) AS g FROM t),
  o AS (SELECT entity_id, g, list(CASE WHEN label = 'error' THEN 0.0 ELSE volume / 100 END ORDER BY seq) AS v, min(seq) AS first FROM u GROUP BY 1, 2), k AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM o)
  SELECT entity_id, first + i - 1 AS seq, round(list_reduce(list_concat([0.0], v[1:i]), lambda r, y: 0.5 * y + 0.5 * r) * 1048576) / 1048576 AS aperture FROM k""")
def q_aperture(spark, sf):
    t = ticks(spark, sf).withColumns({"score": S.clamp(F.col("volume") / 100, 0.0, 1.0), "unsafe": F.col("label") == "error"})
    return linear_fold(t, "score", "aperture", 0.5, start=0.0, reset="unsafe").select("entity_id", "seq", q20("aperture").alias("aperture"))


@query(TICKS + """, o AS (SELECT entity_id, list(least(1.0, volume / 100) * CASE WHEN label = 'error' THEN -1 ELSE 1 END ORDER BY seq) AS v FROM t GROUP BY 1), k AS (SELECT entity_id, v, unnest(range(1, len(v) + 1)) AS seq FROM o)
  SELECT entity_id, seq, round(list_reduce(list_concat([120.0], v[1:seq]), lambda r, y: greatest(15, least(900, CASE WHEN y < 0 THEN r * (1 - least(0.95, -y) * 0.35) WHEN y > 0 THEN r * (1 + y * 0.15) ELSE r END))) * 1048576) / 1048576 AS half_life FROM k""")
def q_half_life(spark, sf):
    t = ticks(spark, sf).withColumn("x", F.least(F.lit(1.0), F.col("volume") / 100))
    t = t.withColumns({"perturbation": F.when(F.col("label") == "error", F.col("x")).otherwise(0.0), "reinforcement": F.when(F.col("label") == "error", 0.0).otherwise(F.col("x"))})
    return fold(t, M.half_life_step, ["perturbation", "reinforcement"], "half_life double").withColumn("half_life", q20("half_life"))


@query(TICKS + """, m AS (SELECT *, abs(price - lag(price) OVER w) >= 200 AS v, abs(price - 250) >= 200 AS d, volume >= 90 AS r FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY seq)),
  n AS (SELECT *, list_filter([CASE WHEN d THEN 'DISPLACEMENT' END, CASE WHEN v THEN 'VELOCITY' END, CASE WHEN r THEN 'RV' END], lambda x: x IS NOT NULL) AS reasons FROM m)
  SELECT entity_id, seq, CASE WHEN coalesce(r, false) AND (coalesce(d, false) OR coalesce(v, false)) THEN 'COMBINED' WHEN r THEN 'VOLUME' WHEN len(reasons) > 0 THEN 'PRICE' ELSE 'NONE' END AS kind, CAST(least(10, 2 * len(reasons)) AS DOUBLE) / 10 AS magnitude, array_to_string(reasons, ';') AS reasons FROM n""")
def q_threshold_detector(spark, sf):
    t = ticks(spark, sf)
    yes = lambda c: F.coalesce(c, F.lit(False))
    d, v, r = F.abs(F.col("price") - 250) >= 200, yes(F.abs(F.col("price") - F.lag("price").over(along("entity_id"))) >= 200), F.col("volume") >= 90
    t = t.withColumns({"d": d, "v": v, "r": r})
    d, v, r = F.col("d"), F.col("v"), F.col("r")
    t = t.withColumn("why", F.array_compact(F.array(F.when(d, "DISPLACEMENT"), F.when(v, "VELOCITY"), F.when(r, "RV"))))
    kind = F.when(r & (d | v), "COMBINED").when(r, "VOLUME").when(d | v, "PRICE").otherwise("NONE")
    return t.select("entity_id", "seq", kind.alias("kind"), (F.least(F.lit(10), 2 * F.size("why")) / 10).alias("magnitude"), F.array_join("why", ";").alias("reasons"))


@query(TICKS + """, s AS (SELECT entity_id, seq, CASE label WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS decision FROM t)
  SELECT entity_id, seq, decision, coalesce(last_value(CASE decision WHEN 'BUY' THEN 'LONG' WHEN 'SELL' THEN 'SHORT' END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY seq), 'FLAT') AS state FROM s""")
def q_emitter_state(spark, sf):
    t = ticks(spark, sf).withColumn("decision", F.when(F.col("label") == "purchase", "BUY").when(F.col("label") == "error", "SELL").otherwise("HOLD"))
    moved = F.when(F.col("decision") == "BUY", "LONG").when(F.col("decision") == "SELL", "SHORT")
    return t.select("entity_id", "seq", "decision", F.coalesce(F.last(moved, ignorenulls=True).over(along("entity_id")), F.lit("FLAT")).alias("state"))


@query(TICKS + """, s AS (SELECT *, coalesce(last_value(CASE label WHEN 'purchase' THEN 'LONG' WHEN 'error' THEN 'FLAT' WHEN 'signup' THEN 'SHORT' END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY seq), 'FLAT') AS wants FROM t),
  h AS (SELECT *, coalesce(lag(wants) OVER (PARTITION BY entity_id ORDER BY seq), 'FLAT') AS has FROM s)
  SELECT entity_id, seq, has, wants, CASE WHEN wants = 'FLAT' THEN 'CLOSE_' || has WHEN has = 'FLAT' THEN 'OPEN_' || wants ELSE 'CLOSE_' || has || '|OPEN_' || wants END AS verbs FROM h WHERE has <> wants""")
def q_position_ledger(spark, sf):
    """Positions as orders fill at once: the last target stands, and each change lists its verbs."""
    w = along("entity_id")
    target = F.when(F.col("label") == "purchase", "LONG").when(F.col("label") == "error", "FLAT").when(F.col("label") == "signup", "SHORT")
    t = ticks(spark, sf).withColumn("wants", F.coalesce(F.last(target, ignorenulls=True).over(w), F.lit("FLAT")))
    t = t.withColumn("has", F.coalesce(F.lag("wants").over(w), F.lit("FLAT"))).where("has != wants")
    verbs = F.concat_ws("|", F.when(F.col("has") != "FLAT", F.concat(F.lit("CLOSE_"), "has")), F.when(F.col("wants") != "FLAT", F.concat(F.lit("OPEN_"), "wants")))
    return t.select("entity_id", "seq", "has", "wants", verbs.alias("verbs"))


@query(TICKS + """, c AS (SELECT entity_id, seq, quantile_cont(price, 0.5) OVER w AS median, min(price) OVER w AS least, max(price) OVER w AS most, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
  l AS (UNPIVOT (SELECT * FROM c WHERE n = 15) ON median, least, most INTO NAME property VALUE new_value),
  o AS (SELECT *, lag(new_value) OVER (PARTITION BY entity_id, property ORDER BY seq) AS old_value FROM l)
  SELECT entity_id, seq, property, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value, seq + 1 AS effective FROM o WHERE old_value IS DISTINCT FROM new_value""")
def q_adaptation_audit(spark, sf):
    """What the last 15 rows' properties changed to, and from which row on that counts."""
    w = along("entity_id")
    last = w.rowsBetween(-14, 0)
    made = {"median": F.percentile("price", 0.5).over(last), "least": F.min("price").over(last), "most": F.max("price").over(last)}
    t = ticks(spark, sf).withColumns(made).where("seq >= 15")
    t = t.withColumns({f"old_{k}": F.lag(k).over(w) for k in made})
    old = [F.struct(F.lit(k).alias("property"), F.col(f"old_{k}").alias("old"), F.col(k).alias("new")) for k in made]
    t = t.select("entity_id", "seq", F.explode(F.array(*old)).alias("x")).where("not (x.old <=> x.new)")
    return t.select("entity_id", "seq", "x.property", r6("x.old").alias("old_value"), r6("x.new").alias("new_value"), (F.col("seq") + 1).alias("effective"))


@query(TICKS + """, e AS (SELECT event_id, 'evt:' || sha256(CAST(event_id AS VARCHAR)) AS id, CASE WHEN seq > 1 THEN 'evt:' || sha256(CAST(lag(event_id) OVER (PARTITION BY entity_id ORDER BY seq) AS VARCHAR)) END AS parent,
  CASE WHEN label = 'view' THEN 'SOURCE' ELSE 'STAGE' END AS producer, CASE WHEN label = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, CASE WHEN volume > 10 THEN sha256(label) END AS payload FROM t),
  f AS (SELECT event_id, list_filter([CASE WHEN NOT regexp_full_match(id, 'evt:[0-9a-f]{64}') THEN 'ID' END, CASE WHEN producer = 'SOURCE' AND parent IS NOT NULL THEN 'SOURCE_PARENT' END, CASE WHEN producer <> 'SOURCE' AND parent IS NULL THEN 'NO_PARENT' END,
    CASE WHEN status = 'SUCCESS' AND payload IS NULL THEN 'NO_PAYLOAD' END, CASE WHEN status = 'ERROR' AND payload IS NOT NULL THEN 'ERROR_PAYLOAD' END], lambda x: x IS NOT NULL) AS faults FROM e)
  SELECT event_id, array_to_string(faults, ';') AS faults FROM f WHERE len(faults) > 0""")
def q_envelope_validation(spark, sf):
    """Faults of lineage envelopes: identifiers, parents and payloads that break their rules."""
    name = lambda c: F.concat(F.lit("evt:"), F.sha2(c.cast("string"), 256))
    t = ticks(spark, sf)
    e = t.select("event_id", name(F.col("event_id")).alias("id"), name(F.lag("event_id").over(along("entity_id"))).alias("parent"), F.when(F.col("label") == "view", "SOURCE").otherwise("STAGE").alias("producer"), F.when(F.col("label") == "error", "ERROR").otherwise("SUCCESS").alias("status"), F.when(F.col("volume") > 10, F.sha2("label", 256)).alias("payload"))
    source, success, parent, payload = F.col("producer") == "SOURCE", F.col("status") == "SUCCESS", F.col("parent").isNotNull(), F.col("payload").isNotNull()
    faults = F.array_compact(F.array(F.when(~F.col("id").rlike("^evt:[0-9a-f]{64}$"), "ID"), F.when(source & parent, "SOURCE_PARENT"), F.when(~source & ~parent, "NO_PARENT"), F.when(success & ~payload, "NO_PAYLOAD"), F.when(~success & payload, "ERROR_PAYLOAD")))
    return e.withColumn("f", faults).where("size(f) > 0").select("event_id", F.array_join("f", ";").alias("faults"))


@query()
def q_local_fit(spark, sf):
    """A local linear law of the third derivative over 15 rows, and the price it gives one row ahead (null where the fit is singular)."""
    from ..operators.dynamics import local_fit

    t = quadratic_fit(ticks(spark, sf), "price", "seq", 8)
    return local_fit(t, 15)
