"""Queries of coercion, lineage, identifiers, signals, designs and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordered import along
from ..sources.ticks import ticks
from . import chain_sql as C
from .registry import TICKS, query

W = "(PARTITION BY entity_id ORDER BY seq)"


def r6(x):
    return F.round(x, 6)


# Coercion and audits


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS price, CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '' ELSE 'false' END AS valid, CASE event_id % 3 WHEN 0 THEN ' 12' ELSE '7.5' END AS n FROM events),
  c AS (SELECT event_id, TRY_CAST(nullif(price, '') AS DOUBLE) AS price, CASE lower(valid) WHEN 'true' THEN true WHEN 'false' THEN false END AS valid, TRY_CAST(CASE WHEN regexp_full_match(trim(n), '-?[0-9]+') THEN trim(n) END AS BIGINT) AS n FROM e)
  SELECT event_id, price, valid, n, CAST(CASE WHEN price IS NULL THEN NULL WHEN valid THEN 1.0 ELSE 0.5 END AS DOUBLE) AS quality, price IS NOT NULL AND isfinite(price) AND valid IS NOT NULL AS usable FROM c""")
def q_coercion(spark, sf):
    """Text columns as typed ones, by a table of kinds: empty and unreadable texts are null; then quality and what may be used."""
    k, e = F.col("event_id"), spark.read.parquet(f"{sf}/events.parquet")
    raw = e.select(k, F.when(k % 7 == 0, "").when(k % 7 == 1, "n/a").otherwise(F.col("value").cast("string")).alias("price"), F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "no").when(k % 5 == 2, "").otherwise("false").alias("valid"), F.when(k % 3 == 0, " 12").otherwise("7.5").alias("n"))
    c = S.coerced(raw, {"price": "double", "valid": "boolean", "n": "bigint"})
    price, valid = F.col("price"), F.col("valid")
    return c.select("event_id", price, valid, "n", F.when(price.isNotNull(), F.when(F.coalesce(valid, F.lit(False)), 1.0).otherwise(0.5)).alias("quality"), (price.isNotNull() & ~F.isnan(price) & valid.isNotNull()).alias("usable"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate <= o_orderdate + INTERVAL 60 DAY AS known, CASE WHEN l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN l_quantity END AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_point_in_time(spark, sf):
    """Values that were known 60 days after the order; those that came later are told and hidden."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    known = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    return spark.read.parquet(f"{sf}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", known.alias("known"), F.when(known, F.col("l_quantity")).alias("quantity"))


@query(TICKS + f""", a AS (SELECT entity_id, label, row_number() OVER (PARTITION BY entity_id ORDER BY event_time, event_id) AS i FROM t), b AS (SELECT entity_id, label, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS i FROM t WHERE event_id % 50 <> 7)
  SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, count(a.i) AS n_left, count(b.i) AS n_right, count(*) FILTER (WHERE a.label = b.label) AS equal_rows, count(*) FILTER (WHERE a.i IS NULL OR b.i IS NULL OR a.label <> b.label) AS differing, count(a.i) = count(b.i) AND count(*) FILTER (WHERE a.label = b.label) = count(*) AS strict FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.i = b.i GROUP BY 1""")
def q_positional_zip(spark, sf):
    """Two sequences of an entity laid side by side by position, with an audit of lengths and equality."""
    t = ticks(spark, sf)
    number = lambda df, *by: df.select("entity_id", "label", F.row_number().over(along("entity_id", by=by)).alias("i"))
    a, b = number(t, "event_time", "event_id").withColumnRenamed("label", "x"), number(t.where("event_id % 50 != 7"), "event_id").withColumnRenamed("label", "y")
    z = a.join(b, ["entity_id", "i"], "full")
    same = F.count_if(F.col("x") == F.col("y"))
    n = z.groupBy("entity_id").agg(F.count("x").alias("n_left"), F.count("y").alias("n_right"), same.alias("equal_rows"), F.count(F.lit(1)).alias("n"))
    return n.select("entity_id", "n_left", "n_right", "equal_rows", (F.col("n") - F.col("equal_rows")).alias("differing"), ((F.col("n_left") == F.col("n_right")) & (F.col("equal_rows") == F.col("n"))).alias("strict"))


# Lineage and identifiers


@query(TICKS + f""", p AS (SELECT *, '{{"entity":' || entity_id || ',"label":"' || label || '","seq":' || seq || ',"volume":' || CAST(volume AS BIGINT) || '}}' AS payload FROM t),
  e AS (SELECT *, 'evt:' || sha256('SOURCE|' || entity_id || '|' || seq || '|' || sha256(payload)) AS event_id_ FROM p)
  SELECT entity_id, seq, event_id_ AS source_id, sha256(payload) AS payload_sha256, 'evt:' || sha256('D01|' || event_id_) AS stage_id, CASE WHEN label = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, CASE WHEN label = 'error' THEN 'label is error' END AS fault, CASE WHEN label <> 'error' THEN payload END AS payload,
    CASE label WHEN 'purchase' THEN 'ORDER:' || lpad(CAST(event_id AS VARCHAR), 8, '0') WHEN 'view' THEN 'PAGE:' || entity_id ELSE 'NONE' END AS scientific_id FROM e""")
def q_source_events(spark, sf):
    """Source events of ticks (canonical JSON payload: keys in order, no blanks) and the envelope of the stage that takes them; a failed one keeps its fault, not its payload."""
    t, c = ticks(spark, sf), F.col
    t = t.withColumn("payload", S.canonical_json({"volume": c("volume").cast("long"), "seq": c("seq"), "entity": c("entity_id"), "label": c("label")}))
    t = t.withColumn("payload_sha256", F.sha2("payload", 256)).withColumn("source_id", F.concat(F.lit("evt:"), F.sha2(F.concat_ws("|", F.lit("SOURCE"), c("entity_id").cast("string"), c("seq").cast("string"), "payload_sha256"), 256)))
    failed = c("label") == "error"
    science = F.when(c("label") == "purchase", F.concat(F.lit("ORDER:"), F.lpad(c("event_id").cast("string"), 8, "0"))).when(c("label") == "view", F.concat(F.lit("PAGE:"), c("entity_id").cast("string"))).otherwise("NONE")
    return t.select("entity_id", "seq", "source_id", "payload_sha256", F.concat(F.lit("evt:"), F.sha2(F.concat(F.lit("D01|"), "source_id"), 256)).alias("stage_id"), F.when(failed, "ERROR").otherwise("SUCCESS").alias("status"), F.when(failed, "label is error").alias("fault"), F.when(~failed, c("payload")).alias("payload"), science.alias("scientific_id"))


@query("SELECT s_suppkey, 'D04C|' || replace(url_encode(s_name || ' / é*~'), '+', '%20') || '|' || s_suppkey || '|' || (s_suppkey + 60) AS candidate_id, 'EP' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS episode_id FROM supplier")
def q_candidate_ids(spark, sf):
    """Identifiers from a percent-encoded name and two times, and zero-padded numbers."""
    k = F.col("s_suppkey")
    name = S.percent_encoded(F.concat("s_name", F.lit(" / é*~")))
    return spark.read.parquet(f"{sf}/supplier.parquet").select(k, F.concat_ws("|", F.lit("D04C"), name, k.cast("string"), (k + 60).cast("string")).alias("candidate_id"), F.format_string("EP%06d", k).alias("episode_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.weight') AS BIGINT), 1) AS weight, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"seen\":true,\"weight\":1}' AS emitted FROM events")
def q_json_props(spark, sf):
    """A JSON column read with a schema, defaults under it, and written again."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("m", F.from_json("props", "map<string,bigint>"))
    full = F.map_concat(F.map_filter(F.create_map(F.lit("weight"), F.lit(1).cast("bigint")), lambda k, _: ~F.map_contains_key("m", "weight")), F.col("m"))
    e = e.withColumn("m", full)
    return e.select("event_id", F.col("m.k").alias("k"), F.col("m.weight").alias("weight"), S.canonical_json({"weight": F.col("m.weight"), "seen": F.lit(True), "k": F.col("m.k")}).alias("emitted"))


# Signals and features


@query(TICKS + f""", f AS (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0) AS relative, sign(price - lag(price) OVER {W}) * sign(lag(price) OVER {W} - lag(price, 2) OVER {W}) AS coherence, abs(price - lag(price) OVER {W}) / 500 AS moved FROM t),
  m AS (SELECT *, greatest(0, 0.5 * relative + 0.35 * least(1.0, volume * 60 / 5000) + 0.15 * abs(coherence)) AS mass FROM f WHERE coherence IS NOT NULL AND relative IS NOT NULL)
  SELECT entity_id, 'S-' || lpad(CAST(row_number() OVER {W} AS VARCHAR), 8, '0') AS signal_id, seq, {C.q20('mass')} AS mass, {C.q20('mass / greatest(1, volume)')} AS density, {C.q20('greatest(0, least(1, 0.45 * mass + 0.45 * moved + 0.1 * coherence))')} AS strength, CAST(row_number() OVER {W} AS BIGINT) AS version FROM m""")
def q_signals(spark, sf):
    """Numbered signals of an entity: effective mass, its density over the half-life (here the volume, in seconds) and strength."""
    from .models import grid

    w, p, c = along("entity_id"), F.col("price"), F.col
    turn = F.signum(p - F.lag(p).over(w)) * F.signum(F.lag(p).over(w) - F.lag(p, 2).over(w))
    f = ticks(spark, sf).withColumns({"relative": c("volume") / F.nullif(F.avg("volume").over(w.rowsBetween(-14, 0)), F.lit(0.0)), "coherence": turn, "moved": F.abs(p - F.lag(p).over(w)) / 500}).where("coherence is not null and relative is not null")
    f = f.withColumns({"mass": S.effective_mass(c("relative"), c("volume") * 60, c("coherence")), "version": F.row_number().over(w).cast("long")})
    return grid(f.select("entity_id", F.format_string("S-%08d", "version").alias("signal_id"), "seq", "mass", (c("mass") / F.greatest(F.lit(1.0), c("volume"))).alias("density"), S.signal_strength(c("mass"), c("moved"), c("coherence")).alias("strength"), "version"))


_FEATURES = {"price": "price", "volume": "volume", "is_error": "CASE WHEN label = 'error' THEN 1.0 ELSE 0.0 END", "is_never": "CASE WHEN label = 'never' THEN 1.0 ELSE 0.0 END", "hour": "CAST(hour(event_time) AS DOUBLE)"}


@query(TICKS + ", r AS (SELECT phase, unnest([" + ", ".join(f"{{'feature': '{k}', 'x': {x}}}" for k, x in _FEATURES.items()) + "]) AS f FROM (SELECT *, CASE WHEN seq <= 20 THEN 'PHASE_1' ELSE 'PHASE_2' END AS phase FROM t)) SELECT phase, f.feature AS feature, count(*) AS n, round(avg(f.x), 6) AS mean, round(var_pop(f.x), 4) AS variance, var_pop(f.x) > 1e-12 AS varies FROM r GROUP BY 1, 2")
def q_variance_rows(spark, sf):
    """Mean and variance of each feature by phase, and whether it varies at all."""
    t = ticks(spark, sf).withColumn("phase", F.when(F.col("seq") <= 20, "PHASE_1").otherwise("PHASE_2"))
    r = t.select("phase", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.expr(x).cast("double").alias("x")) for k, x in _FEATURES.items()])).alias("f"))
    return r.groupBy("phase", F.col("f.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("f.x")).alias("mean"), F.round(F.var_pop("f.x"), 4).alias("variance"), (F.var_pop("f.x") > 1e-12).alias("varies"))


@query(TICKS + ", r AS (SELECT label, unnest([" + ", ".join(f"{{'feature': '{k}', 'x': {x}}}" for k, x in _FEATURES.items()) + "]) AS f FROM t), v AS (SELECT label, f.feature AS feature, var_pop(f.x) > 1e-12 AS able FROM r GROUP BY 1, 2) SELECT label, coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (WHERE able), '') AS retained, coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (WHERE NOT able), '') AS gated, sha256(coalesce(string_agg(feature, chr(10) ORDER BY feature) FILTER (WHERE able), '')) AS basis_sha256 FROM v GROUP BY 1")
def q_feature_gating(spark, sf):
    """Which features a label's data can feed, and the frozen basis' fingerprint."""
    r = ticks(spark, sf).select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.expr(x).cast("double").alias("x")) for k, x in _FEATURES.items()])).alias("f"))
    v = r.groupBy("label", F.col("f.feature").alias("feature")).agg((F.var_pop("f.x") > 1e-12).alias("able"))
    of = lambda keep, sep: F.array_join(F.sort_array(F.collect_list(F.when(F.col("able") == keep, F.col("feature")))), sep)
    return v.groupBy("label").agg(of(True, ";").alias("retained"), of(False, ";").alias("gated"), F.sha2(of(True, "\n"), 256).alias("basis_sha256"))


_COLUMNS = {"one": "1.0", "quantity": "l_quantity", "discount": "l_discount * 100", "tax": "l_tax * 100", "double_tax": "l_tax * 200"}
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in list(_COLUMNS)[i:]]


@query("WITH x AS (SELECT l_returnflag, " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in _COLUMNS.items()) + " FROM lineitem) SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(sum({a} * {b}), 2) AS {a}_{b}" for a, b in _PAIRS) + " FROM x GROUP BY 1")
def q_design_moments(spark, sf):
    """The matrix of products of a design's columns, by partial sums."""
    from ..operators.designs import moments

    m = moments(_design(spark, sf), list(_COLUMNS), ["l_returnflag"])
    return m.select("l_returnflag", "n", *[F.round(f"{a}_{b}", 2).alias(f"{a}_{b}") for a, b in _PAIRS])


def _design(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", *[F.expr(x).cast("double").alias(k) for k, x in _COLUMNS.items()])


@query("SELECT l_returnflag, count(*) AS n, 5 AS n_columns, 4 AS matrix_rank, 1 AS rank_deficiency, 'one;quantity;discount;tax' AS retained, 'double_tax' AS excluded, 'double_tax' AS depends_on_tax, 'WELL CONDITIONED' AS classification FROM lineitem GROUP BY 1")
def q_design_report(spark, sf):
    """Rank, the independent columns in their order, what the others depend on, and the condition of the independent ones."""
    from ..operators.designs import report

    r = report(_design(spark, sf), list(_COLUMNS), "l_returnflag")
    return r.select("l_returnflag", "n", "n_columns", "matrix_rank", "rank_deficiency", "retained", "excluded", F.array_join(F.map_keys(F.map_filter("depends", lambda _, v: v == "tax")), ";").alias("depends_on_tax"), S.condition_class(F.col("condition")).alias("classification"))


_TIED = {"one": "1.0", "quantity": "l_quantity", "discount": "l_discount * 100", "tax": "CASE WHEN l_linestatus = 'F' THEN l_tax * 100 ELSE l_discount * 300 END", "mix": "l_quantity - 2 * l_discount * 100", "price": "l_extendedprice / 1000"}


@query("WITH x AS (SELECT l_linestatus, " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in _TIED.items()) + """ FROM lineitem), d AS (SELECT l_linestatus, count(*) AS n, max(abs(mix - quantity + 2 * discount)) < 1e-9 AS mixed, abs(regr_r2(tax, discount) - 1) < 1e-9 AND abs(regr_intercept(tax, discount)) < 1e-9 AS taxed FROM x GROUP BY 1)
  SELECT l_linestatus, n, 1 AS dependency, CASE WHEN taxed THEN 'quantity;discount;tax;mix' ELSE 'quantity;discount;mix' END AS members, CASE WHEN taxed THEN 4 ELSE 3 END AS n_members, CASE WHEN taxed THEN 2 ELSE 1 END AS surplus FROM d WHERE mixed""")
def q_dependency_groups(spark, sf):
    """Columns tied by linear dependencies, by phase: line status F has one, O a second one that shares a column."""
    from ..operators.designs import dependency_groups

    x = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linestatus", *[F.expr(e).cast("double").alias(k) for k, e in _TIED.items()])
    return dependency_groups(x, list(_TIED), "l_linestatus")


# Baselines and controls


@query(TICKS + f""", s AS (SELECT label, CASE WHEN seq <= 20 THEN 2 ELSE 3 END AS phase, event_id, CAST(sign(lead(price) OVER {W} - price) AS INTEGER) AS y FROM t), c AS (SELECT * FROM s WHERE y IS NOT NULL),
  p AS (SELECT label, avg(CASE WHEN y = -1 THEN 1.0 ELSE 0 END) AS down, avg(CASE WHEN y <= 0 THEN 1.0 ELSE 0 END) AS flat FROM c WHERE phase = 2 GROUP BY 1),
  r AS (SELECT c.label, rep, y, CAST(('0x' || substr(md5(rep || '|' || event_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u, down, flat FROM c JOIN p ON p.label = c.label, range(1, 21) g(rep) WHERE phase = 3),
  a AS (SELECT label, rep, avg(CASE WHEN y = CASE WHEN u < down THEN -1 WHEN u < flat THEN 0 ELSE 1 END THEN 1.0 ELSE 0.0 END) AS accuracy FROM r GROUP BY 1, 2)
  SELECT label, count(*) AS replicates, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, round(quantile_cont(accuracy, 0.05), 6) AS p05, round(quantile_cont(accuracy, 0.5), 6) AS p50, round(quantile_cont(accuracy, 0.95), 6) AS p95, round(max(accuracy), 6) AS most FROM a GROUP BY 1""")
def q_random_control(spark, sf):
    """Accuracy of guesses drawn by the class frequencies of an earlier phase: 20 replicates, draws by hashes of row and replicate."""
    w = along("entity_id")
    c = ticks(spark, sf).select("label", F.when(F.col("seq") <= 20, 2).otherwise(3).alias("phase"), "event_id", F.signum(F.lead("price").over(w) - F.col("price")).cast("int").alias("y")).where("y is not null")
    p = c.where("phase = 2").groupBy("label").agg(F.avg((F.col("y") == -1).cast("double")).alias("down"), F.avg((F.col("y") <= 0).cast("double")).alias("flat"))
    r = c.where("phase = 3").join(p, "label").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    guess = F.when(u < F.col("down"), -1).when(u < F.col("flat"), 0).otherwise(1)
    a = r.groupBy("label", "rep").agg(F.avg((F.col("y") == guess).cast("double")).alias("accuracy"))
    q = lambda x: r6(F.percentile("accuracy", x))  # noqa: E731  20 values
    return a.groupBy("label").agg(F.count(F.lit(1)).alias("replicates"), r6(F.avg("accuracy")).alias("mean"), r6(F.stddev_pop("accuracy")).alias("std"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), r6(F.max("accuracy")).alias("most"))


@query(TICKS + """, f AS (SELECT entity_id, seq, price, regr_slope(price, seq) OVER p AS b, regr_intercept(price, seq) OVER p AS a, count(*) OVER p AS n, lead(price) OVER (PARTITION BY entity_id ORDER BY seq) AS next FROM t WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
  SELECT entity_id, seq, round(a + b * (seq + 1), 4) AS predicted, round(abs(a + b * (seq + 1) - next), 4) AS error FROM f WHERE n = 15""")
def q_affine_baseline(spark, sf):
    """The next price by a straight line through the last 15, and its error."""
    w = along("entity_id")
    p = w.rowsBetween(-14, 0)
    f = ticks(spark, sf).withColumns({"b": F.regr_slope("price", "seq").over(p), "a": F.regr_intercept("price", "seq").over(p), "next": F.lead("price").over(w)}).where("seq >= 15")
    at = F.col("a") + F.col("b") * (F.col("seq") + 1)
    return f.select("entity_id", "seq", F.round(at, 4).alias("predicted"), F.round(F.abs(at - F.col("next")), 4).alias("error"))


@query(TICKS + f""", f AS (SELECT *, lag(volume) OVER {W} AS v1, lead(volume) OVER {W} AS y, avg(volume) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS m, regr_slope(volume, p1) OVER q AS b, regr_intercept(volume, p1) OVER q AS a FROM (SELECT *, lag(volume) OVER {W} AS p1 FROM t) WINDOW q AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
  r AS (SELECT unnest([{{'model': 'POINT', 'e': abs(volume - y)}}, {{'model': 'DERIVATIVE', 'e': abs(2 * volume - v1 - y)}}, {{'model': 'INTERVAL', 'e': abs(m - y)}}, {{'model': 'ROLLING_60', 'e': abs(a + b * volume - y)}}]) AS x FROM f WHERE y IS NOT NULL AND v1 IS NOT NULL AND seq > 30)
  SELECT x.model AS model, count(x.e) AS n, round(avg(x.e), 5) AS mae FROM r GROUP BY 1""")
def q_volume_predictors(spark, sf):
    """One-step errors of the last volume, its extrapolation, the mean of 15, and a regression on the volume before over 60 rows."""
    w, v, c = along("entity_id"), F.col("volume"), F.col
    q = w.rowsBetween(-59, 0)
    f = ticks(spark, sf).withColumns({"v1": F.lag("volume").over(w), "y": F.lead("volume").over(w), "m": F.avg("volume").over(w.rowsBetween(-14, 0))})
    f = f.withColumns({"b": F.regr_slope("volume", "v1").over(q), "a": F.regr_intercept("volume", "v1").over(q)}).where("y is not null and v1 is not null and seq > 30")
    made = {"POINT": v, "DERIVATIVE": 2 * v - c("v1"), "INTERVAL": c("m"), "ROLLING_60": c("a") + c("b") * v}
    r = f.select(F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.abs(x - c("y")).alias("e")) for k, x in made.items()])).alias("x"))
    return r.groupBy(c("x.model").alias("model")).agg(F.count("x.e").alias("n"), F.round(F.avg("x.e"), 5).alias("mae"))
