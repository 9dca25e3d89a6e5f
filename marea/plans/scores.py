"""Queries of scorecards, controls, audits and regressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.exact import quantiles
from ..operators.ordered import along, with_runs
from ..sources.ticks import bars, ticks
from .registry import BARS, TICKS, query

W = "(PARTITION BY entity_id ORDER BY seq)"


def r6(x):
    return F.round(x, 6)


def stepped(spark, sf):
    """Ticks with the last and the next change of price."""
    w, p = along("entity_id"), F.col("price")
    return ticks(spark, sf).withColumns({"step": p - F.lag(p).over(w), "next": F.lead(p).over(w) - p})


STEPPED = TICKS + f", s AS (SELECT *, price - lag(price) OVER {W} AS step, lead(price) OVER {W} - price AS next FROM t)"


@query("SELECT c_custkey, coalesce(CAST(n AS VARCHAR), '') AS n_large FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey")
def q_left_join(spark, sf):
    large = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    return c.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.col("n").cast("string"), F.lit("")).alias("n_large"))


@query(TICKS + """, c AS (SELECT CASE WHEN hour(event_time) * 60 + minute(event_time) BETWEEN 570 AND 959 THEN 'REGULAR' WHEN hour(event_time) * 60 + minute(event_time) BETWEEN 240 AND 569 THEN 'PREMARKET'
    WHEN hour(event_time) * 60 + minute(event_time) BETWEEN 960 AND 1199 OR (hour(event_time) = 20 AND minute(event_time) = 0 AND second(event_time) = 0) THEN 'AFTERHOURS' ELSE 'UNKNOWN' END AS session, count(*) AS n FROM t GROUP BY 1)
  SELECT v.session, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM t), 6) AS fraction FROM (VALUES ('PREMARKET'), ('REGULAR'), ('AFTERHOURS'), ('UNKNOWN'), ('HALTED')) v(session) LEFT JOIN c ON c.session = v.session""")
def q_session_summary(spark, sf):
    """Every session of a fixed list, those without ticks too."""
    names = spark.createDataFrame([(x,) for x in ("PREMARKET", "REGULAR", "AFTERHOURS", "UNKNOWN", "HALTED")], "session string")
    n = ticks(spark, sf).groupBy(S.session_class(F.col("event_time")).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a session
    found = names.join(n, "session", "left")
    return found.select("session", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r6(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))).alias("fraction"))


RUNS = TICKS + f""", c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER {W} OR seq = 1 THEN 1 ELSE 0 END AS cut FROM t), r AS (SELECT *, sum(cut) OVER {W} AS run FROM c),
  i AS (SELECT entity_id, CAST(run AS BIGINT) AS run, any_value(label) AS label, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(event_time) AS began, max(event_time) AS ended FROM r GROUP BY 1, 2)"""


def label_runs(spark, sf):
    r = with_runs(ticks(spark, sf), "label")
    return r.groupBy("entity_id", "run").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("event_time").alias("began"), F.max("event_time").alias("ended"))


@query(RUNS + " SELECT label, count(*) AS runs, " + ", ".join(f"quantile_cont(n, {q / 100}) AS q{q}" for q in (25, 50, 75, 90, 95)) + ", round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share_2, round(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END), 6) AS share_3 FROM i GROUP BY 1")
def q_duration_scorecard(spark, sf):
    r = label_runs(spark, sf)
    share = lambda k: r6(F.avg((F.col("n") >= k).cast("double"))).alias(f"share_{k}")
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("runs"), share(2), share(3)).join(quantiles(r, ["label"], "n", {f"q{q}": q / 100 for q in (25, 50, 75, 90, 95)}), "label")


@query(RUNS + " SELECT entity_id, run, label, n, CAST(floor(epoch(ended)) - floor(epoch(began)) AS BIGINT) AS seconds FROM i")
def q_decision_runs(spark, sf):
    seconds = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("began").cast("timestamp"))
    return label_runs(spark, sf).select("entity_id", "run", "label", "n", seconds.alias("seconds"))


@query(RUNS + f""", p AS (SELECT *, max(CASE WHEN label = 'view' THEN last_seq END) OVER b AS last_view, max_by(n, first_seq) FILTER (WHERE label = 'view') OVER b AS n_view FROM i WINDOW b AS (PARTITION BY entity_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT entity_id, run, last_view, n_view FROM p WHERE label = 'purchase'""")
def q_latest_run(spark, sf):
    """The last finished run of views before each run of purchases."""
    before = Window.partitionBy("entity_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("label") == "view", F.struct("last_seq", "n")), ignorenulls=True).over(before)
    return label_runs(spark, sf).withColumn("v", seen).where("label = 'purchase'").select("entity_id", "run", F.col("v.last_seq").alias("last_view"), F.col("v.n").alias("n_view"))


COLUMNS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "gross": "l_extendedprice * (1 + l_tax)"}
PAIRS = [(a, b) for k, a in enumerate(COLUMNS) for b in list(COLUMNS)[k + 1 :]]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({COLUMNS[a]}, {COLUMNS[b]}), 4) AS r FROM lineitem" for a, b in PAIRS) + """)
  SELECT a, b, r, CASE WHEN abs(r) >= 0.9999 THEN 'DUPLICATE' WHEN abs(r) >= 0.95 THEN 'VERY_HIGH' WHEN abs(r) >= 0.8 THEN 'HIGH' ELSE 'LOW' END AS band FROM c""")
def q_corr_bands(spark, sf):
    """All pairs of columns in one pass over the table."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*[f"{e} AS {k}" for k, e in COLUMNS.items()])
    one = x.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in PAIRS])
    r = F.abs(F.col("r"))
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("r")) for a, b in PAIRS])).alias("x")).select("x.*")
    return long.withColumn("band", F.when(r >= 0.9999, "DUPLICATE").when(r >= 0.95, "VERY_HIGH").when(r >= 0.8, "HIGH").otherwise("LOW"))


@query("""WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS yx, corr(l_extendedprice, l_discount) AS yz, corr(l_quantity, l_discount) AS xz FROM lineitem)
  SELECT round((yx * yx + yz * yz - 2 * yx * yz * xz) / (1 - xz * xz), 6) AS r2 FROM c""")
def q_linear_r2(spark, sf):
    """R squared of a regression on two columns and an intercept, from three correlations."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    c = x.agg(F.corr("l_extendedprice", "l_quantity").alias("yx"), F.corr("l_extendedprice", "l_discount").alias("yz"), F.corr("l_quantity", "l_discount").alias("xz"))
    yx, yz, xz = F.col("yx"), F.col("yz"), F.col("xz")
    return c.select(r6((yx * yx + yz * yz - 2 * yx * yz * xz) / (1 - xz * xz)).alias("r2"))


@query(STEPPED + ", r AS (SELECT CASE WHEN next IS NULL THEN 'NO_OUTCOME' WHEN step IS NULL THEN 'NO_HISTORY' WHEN label = 'error' THEN 'QUALITY' WHEN volume = 0 THEN 'NO_VOLUME' ELSE 'ELIGIBLE' END AS reason FROM s) SELECT reason, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM r GROUP BY 1")
def q_exclusions(spark, sf):
    reason = F.when(F.col("next").isNull(), "NO_OUTCOME").when(F.col("step").isNull(), "NO_HISTORY").when(F.col("label") == "error", "QUALITY").when(F.col("volume") == 0, "NO_VOLUME").otherwise("ELIGIBLE")
    n = stepped(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a reason


CLASSES = STEPPED + """, p AS (SELECT *, CASE WHEN step > 20 THEN 'UP' WHEN step < -20 THEN 'DOWN' ELSE 'NEUTRAL' END AS was, CASE WHEN next > 20 THEN 'UP' WHEN next < -20 THEN 'DOWN' ELSE 'NEUTRAL' END AS is_,
  CASE WHEN 10 * (seq - 1) < 6 * total THEN 'PHASE_1' WHEN 10 * (seq - 1) < 8 * total THEN 'PHASE_2' ELSE 'PHASE_3' END AS phase FROM (SELECT *, count(*) OVER (PARTITION BY entity_id) AS total FROM s) WHERE next IS NOT NULL AND step IS NOT NULL)"""


def classed(spark, sf):
    s = stepped(spark, sf).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("entity_id"))).where("next is not null and step is not null")
    return s.withColumns({"was": S.signed_class(F.col("step"), 20.0), "is_": S.signed_class(F.col("next"), 20.0), "phase": S.phase_of(F.col("seq"), F.col("total"))})


@query(CLASSES + " SELECT entity_id, seq, was, is_, phase FROM p")
def q_signed_class(spark, sf):
    return classed(spark, sf).select("entity_id", "seq", "was", "is_", "phase")


@query(CLASSES + """, m AS (SELECT label, is_, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, is_) AS k FROM p WHERE phase = 'PHASE_2' GROUP BY 1, 2)
  SELECT p.label, count(*) AS n, round(avg(CASE WHEN p.is_ = m.is_ THEN 1.0 ELSE 0.0 END), 6) AS majority, round(avg(CASE WHEN p.is_ = was THEN 1.0 ELSE 0.0 END), 6) AS persistence,
  round(avg(CASE WHEN (was = 'UP' AND p.is_ = 'DOWN') OR (was = 'DOWN' AND p.is_ = 'UP') OR (was = 'NEUTRAL' AND p.is_ = 'NEUTRAL') THEN 1.0 ELSE 0.0 END), 6) AS contrarian, round(avg(CASE WHEN p.is_ = 'NEUTRAL' THEN 1.0 ELSE 0.0 END), 6) AS neutral
  FROM p LEFT JOIN m ON m.label = p.label AND m.k = 1 WHERE phase = 'PHASE_3' GROUP BY 1""")
def q_controls(spark, sf):
    """Accuracy of predictors that learn nothing but the majority of the phase before."""
    p = classed(spark, sf)
    counts = p.where("phase = 'PHASE_2'").groupBy("label", "is_").agg(F.count(F.lit(1)).alias("n"))
    majority = counts.groupBy("label").agg(F.min_by("is_", F.struct(-F.col("n"), "is_")).alias("usual"))
    opposite = F.when(F.col("was") == "UP", "DOWN").when(F.col("was") == "DOWN", "UP").otherwise("NEUTRAL")
    right = lambda x, name: r6(F.avg(F.coalesce((F.col("is_") == x).cast("double"), F.lit(0.0)))).alias(name)
    return p.where("phase = 'PHASE_3'").join(majority, "label", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), right(F.col("usual"), "majority"), right(F.col("was"), "persistence"), right(opposite, "contrarian"), right(F.lit("NEUTRAL"), "neutral"))


@query(CLASSES + " SELECT phase, label, count(*) AS n, round(avg(CASE WHEN was = is_ THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(abs(next - step)), 6) AS mae, round(sqrt(avg((next - step) * (next - step))), 6) AS rmse, round(quantile_cont(abs(next - step), 0.5), 6) AS median, round(corr(next, step), 6) AS r FROM p GROUP BY 1, 2")
def q_eval_scorecard(spark, sf):
    e = F.col("next") - F.col("step")
    c = classed(spark, sf).withColumn("size", F.abs(e))
    plain = c.groupBy("phase", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("was") == F.col("is_")).cast("double"))).alias("accuracy"), r6(F.avg("size")).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.corr("next", "step")).alias("r"))
    return plain.join(quantiles(c, ["phase", "label"], "size", {"median": 0.5}).withColumn("median", r6("median")), ["phase", "label"])


@query(STEPPED + " SELECT label, count(*) AS n, round(avg(CASE WHEN sign(step) * next > 0 THEN 1.0 ELSE 0.0 END), 6) AS concordance, round(avg(CASE WHEN sign(step) * next > 0 THEN 1.0 ELSE 0.0 END) - 0.5, 6) AS effect FROM s WHERE step IS NOT NULL AND next IS NOT NULL GROUP BY 1")
def q_state_c15(spark, sf):
    c = F.avg((F.signum("step") * F.col("next") > 0).cast("double"))
    return stepped(spark, sf).where("step is not null and next is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(c).alias("concordance"), r6(c - 0.5).alias("effect"))


@query(BARS + """, m AS (SELECT day, sum(close - open) AS net, sum(high - low) AS range, sum(n_ticks) AS n FROM b GROUP BY 1), q AS (SELECT quantile_cont(range, 0.25) AS low, quantile_cont(range, 0.75) AS high FROM m)
  SELECT day, CASE WHEN sign(net) <> sign(lag(net) OVER (ORDER BY day)) AND range > high THEN 'REVERSAL' WHEN range > high THEN 'NOISY' WHEN range < low THEN 'QUIET' WHEN net >= 0 THEN 'UP' ELSE 'DOWN' END AS regime FROM m, q""")
def q_regimes(spark, sf):
    """A day's regime by its own measures and their quantiles over all days."""
    m = bars(ticks(spark, sf)).groupBy("day").agg(F.sum(F.col("close") - F.col("open")).alias("net"), F.sum(F.col("high") - F.col("low")).alias("range"))
    q = m.agg(F.percentile("range", 0.25).alias("low"), F.percentile("range", 0.75).alias("high"))
    turned = F.signum("net") != F.signum(F.lag("net").over(Window.orderBy("day")))  # one row a day
    wide = F.col("range") > F.col("high")
    m = m.withColumn("turned", F.coalesce(turned, F.lit(False))).join(F.broadcast(q))
    return m.select("day", F.when(F.col("turned") & wide, "REVERSAL").when(wide, "NOISY").when(F.col("range") < F.col("low"), "QUIET").when(F.col("net") >= 0, "UP").otherwise("DOWN").alias("regime"))


@query(STEPPED + ", d AS (SELECT CAST(round(abs(step) * 100) AS BIGINT) AS cents, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1) SELECT cents, n FROM d ORDER BY n DESC, cents LIMIT 10")
def q_increments(spark, sf):
    d = stepped(spark, sf).where("step is not null").groupBy(F.round(F.abs("step") * 100).cast("long").alias("cents")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "cents").limit(10)


@query(TICKS + f""", x AS (SELECT *, price - 250 AS x FROM t), c AS (SELECT *, CASE WHEN lag(x) OVER {W} < 0 AND x >= 0 THEN 'LOWER' WHEN lag(x) OVER {W} > 0 AND x <= 0 THEN 'UPPER' END AS crossing FROM x),
  n AS (SELECT *, first_value(CASE WHEN crossing IS NOT NULL THEN seq END IGNORE NULLS) OVER f AS later, first_value(crossing IGNORE NULLS) OVER f AS kind FROM c WINDOW f AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT entity_id, seq, later - seq AS rows, CASE WHEN later IS NULL THEN 'OTHER' WHEN later - seq = 1 THEN 'IMMEDIATE' WHEN kind = crossing THEN 'RETURN' WHEN later - seq <= 5 THEN 'DELAYED' ELSE 'OTHER' END AS outcome FROM n WHERE crossing IS NOT NULL""")
def q_time_to_crossing(spark, sf):
    from ..operators.ordered import crossings

    later = along("entity_id").rowsBetween(1, Window.unboundedFollowing)
    t = ticks(spark, sf).withColumn("crossing", crossings(F.col("price") - 250))
    t = t.withColumn("then", F.first(F.when(F.col("crossing").isNotNull(), F.struct("seq", "crossing")), ignorenulls=True).over(later)).where("crossing is not null")
    rows = F.col("then.seq") - F.col("seq")
    return t.select("entity_id", "seq", rows.alias("rows"), F.when(rows.isNull(), "OTHER").when(rows == 1, "IMMEDIATE").when(F.col("then.crossing") == F.col("crossing"), "RETURN").when(rows <= 5, "DELAYED").otherwise("OTHER").alias("outcome"))


@query("""WITH f AS (SELECT [CAST(round(l_quantity * 200) AS BIGINT), CAST(round(l_discount * 100000) AS BIGINT), CAST(round(l_tax * 125000) AS BIGINT)] AS v FROM lineitem),
  u AS (SELECT unnest(['quantity', 'discount', 'tax']) AS factor, unnest(v) AS x, list_min(v) AS least, v FROM f)
  SELECT factor, count(*) AS n, count(*) FILTER (WHERE len(list_filter(v, lambda y: y = least)) > 1) AS tied FROM u WHERE x = least GROUP BY 1""")
def q_lowest_factor(spark, sf):
    """How often each factor is the least of three, alone or tied."""
    f = {k: F.round(F.col(f"l_{k}") * by).cast("long") for k, by in (("quantity", 200), ("discount", 100000), ("tax", 125000))}
    least = F.least(*f.values())
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.array_compact(F.array(*[F.when(v == least, k) for k, v in f.items()])).alias("who"))
    return x.select(F.explode("who").alias("factor"), (F.size("who") > 1).alias("tie")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.count_if("tie").alias("tied"))


@query(TICKS + " SELECT CASE label WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS decision, count(*) AS n, min(price) AS least, max(price) AS most, round(avg(price), 6) AS mean, quantile_cont(price, 0.5) AS median, round(stddev_pop(volume), 6) AS volume_std FROM t GROUP BY 1")
def q_by_decision(spark, sf):
    t = ticks(spark, sf).withColumn("decision", F.when(F.col("label") == "purchase", "BUY").when(F.col("label") == "error", "SELL").otherwise("HOLD"))
    plain = t.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least"), F.max("price").alias("most"), r6(F.avg("price")).alias("mean"), r6(F.stddev_pop("volume")).alias("volume_std"))
    return plain.join(quantiles(t, ["decision"], "price", {"median": 0.5}), "decision")


@query(TICKS + """, d AS (SELECT label, min(price) AS least, max(price) AS most, avg(price) AS mean, stddev_pop(price) AS std, avg(CASE WHEN price < 25 OR price > 475 THEN 1.0 ELSE 0.0 END) AS near FROM t GROUP BY 1)
  SELECT label, least, most, round(std / mean, 6) AS cv, round(near, 6) AS near_bounds, CASE WHEN near > 0.5 THEN 'SATURATED' WHEN most - least < 50 THEN 'NARROW' ELSE 'WIDE' END AS kind FROM d""")
def q_dynamic_range(spark, sf):
    near = ((F.col("price") < 25) | (F.col("price") > 475)).cast("double")
    d = ticks(spark, sf).groupBy("label").agg(F.min("price").alias("least"), F.max("price").alias("most"), F.avg("price").alias("mean"), F.stddev_pop("price").alias("std"), F.avg(near).alias("near"))
    kind = F.when(F.col("near") > 0.5, "SATURATED").when(F.col("most") - F.col("least") < 50, "NARROW").otherwise("WIDE")
    return d.select("label", "least", "most", r6(F.col("std") / F.col("mean")).alias("cv"), r6("near").alias("near_bounds"), kind.alias("kind"))


@query(BARS + """, m AS (SELECT day, max(high) AS top, min(low) AS low, sum(n_ticks) AS n FROM b GROUP BY 1), a AS (SELECT 1 AS k, day FROM m ORDER BY top DESC, m.day LIMIT 1),
  c AS (SELECT 2 AS k, day FROM m WHERE day NOT IN (SELECT day FROM a) ORDER BY low, m.day LIMIT 1), e AS (SELECT 3 AS k, day FROM m WHERE day NOT IN (SELECT day FROM a UNION ALL SELECT day FROM c) ORDER BY n DESC, m.day LIMIT 1)
  SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e""")
def q_greedy_pick(spark, sf):
    """The day of the highest price, then of the lowest, then of most ticks, none twice; over one row a day."""
    m = bars(ticks(spark, sf)).groupBy("day").agg(F.max("high").alias("top"), F.min("low").alias("low"), F.sum("n_ticks").alias("n"))
    picked = None
    for k, order in enumerate((F.desc("top"), F.asc("low"), F.desc("n")), 1):
        rest = m if picked is None else m.join(picked, "day", "left_anti")
        one = rest.orderBy(order, "day").limit(1).select(F.lit(k).alias("k"), "day")
        picked = one if picked is None else picked.unionByName(one)
    return picked


@query(TICKS + " SELECT entity_id, CAST(event_time AS DATE) AS day, sha256(string_agg(concat_ws('|', CAST(seq AS VARCHAR), CAST(event_id AS VARCHAR), label), chr(10) ORDER BY seq)) AS seal FROM t GROUP BY 1, 2")
def q_logical_seal(spark, sf):
    """A digest of each entity's rows of a day, in their order; a day bounds what is held at once."""
    row = F.struct("seq", F.concat_ws("|", F.col("seq").cast("string"), F.col("event_id").cast("string"), "label").alias("text"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"])
    return ticks(spark, sf).groupBy("entity_id", F.to_date("event_time").alias("day")).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("seal"))


@query(TICKS + """, m AS (SELECT a.entity_id, a.seq, arg_min(b.seq, (abs(b.price - a.price), b.seq)) AS control FROM t a JOIN t b ON a.entity_id = b.entity_id AND b.label <> 'error' AND b.seq BETWEEN a.seq - 20 AND a.seq + 20 WHERE a.label = 'error' GROUP BY 1, 2)
  SELECT entity_id, seq, control FROM m""")
def q_matched_control(spark, sf):
    """For each error the most alike other tick within 20 rows: a window's list, no join."""
    near = F.collect_list(F.when(F.col("label") != "error", F.struct("price", "seq"))).over(along("entity_id").rowsBetween(-20, 20))
    t = ticks(spark, sf).withColumn("near", near).where("label = 'error' and size(near) > 0")
    best = F.array_min(F.transform("near", lambda x: F.struct(F.abs(x["price"] - F.col("price")).alias("d"), x["seq"].alias("seq"))))
    return t.select("entity_id", "seq", best["seq"].alias("control"))


@query(STEPPED + f""", c AS (SELECT entity_id, seq, CASE WHEN lag(price) OVER {W} < 250 AND price >= 250 THEN 'LOWER' WHEN lag(price) OVER {W} > 250 AND price <= 250 THEN 'UPPER' END AS kind FROM t),
  e AS (SELECT c.kind, c.entity_id, c.seq, k FROM c, range(1, 16) r(k) WHERE c.kind IS NOT NULL), v AS (SELECT e.kind, e.k, avg(abs(s.step)) AS x FROM e JOIN s ON s.entity_id = e.entity_id AND s.seq BETWEEN e.seq - e.k AND e.seq - 1 GROUP BY e.kind, e.k, e.entity_id, e.seq)
  SELECT kind, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(x), 6) AS mean FROM v WHERE x IS NOT NULL GROUP BY 1, 2""")
def q_pre_event_mean(spark, sf):
    """Mean size of the 1 to 15 changes before each crossing."""
    from ..operators.ordered import crossings

    w = along("entity_id")
    t = stepped(spark, sf).withColumn("kind", crossings(F.col("price") - 250))
    means = [F.struct(F.lit(k).alias("k"), F.avg(F.abs("step")).over(w.rowsBetween(-k, -1)).alias("x")) for k in range(1, 16)]
    t = t.withColumn("m", F.array(*means)).where("kind is not null").select("kind", F.explode("m").alias("m"))
    return t.where("m.x is not null").groupBy("kind", F.col("m.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("m.x")).alias("mean"))


@query(RUNS + """, d AS (SELECT entity_id, label, n, first_seq % 10 AS x, CASE WHEN last_seq = max(last_seq) OVER (PARTITION BY entity_id) THEN 'RIGHT' WHEN n = 1 THEN 'INTERVAL' ELSE 'EXACT' END AS kind FROM i),
  e AS (SELECT a.label, count(*) AS pairs, sum(CASE WHEN b.x > a.x THEN 1.0 WHEN b.x = a.x THEN 0.5 ELSE 0 END) AS score FROM d a JOIN d b ON a.label = b.label AND b.n > CASE a.kind WHEN 'EXACT' THEN a.n ELSE a.n + 1 END WHERE a.kind <> 'RIGHT' GROUP BY 1),
  g AS (SELECT label, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS ties FROM (SELECT label, n, count(*) AS c FROM d WHERE kind = 'EXACT' GROUP BY 1, 2) GROUP BY 1)
  SELECT label, CAST(coalesce(pairs, 0) + coalesce(ties, 0) AS BIGINT) AS pairs, round((coalesce(score, 0) + 0.5 * coalesce(ties, 0)) / nullif(coalesce(pairs, 0) + coalesce(ties, 0), 0), 6) AS concordance FROM e FULL JOIN g USING (label)""")
def q_c_index(spark, sf):
    """Concordance of a predictor with censored durations."""
    from ..operators.survival import concordance

    runs = label_runs(spark, sf).withColumn("x", F.col("first_seq") % 10)
    last = F.max("last_seq").over(Window.partitionBy("entity_id"))
    d = runs.withColumn("kind", F.when(F.col("last_seq") == last, "RIGHT").when(F.col("n") == 1, "INTERVAL").otherwise("EXACT")).withColumn("upper", F.when(F.col("kind") == "INTERVAL", F.col("n") + 1))
    return concordance(d, "label", "x", "kind", "n", "upper").select("label", "pairs", r6("concordance").alias("concordance"))


@query()
def q_bootstrap(spark, sf):
    from ..operators.survival import block_bootstrap

    s = stepped(spark, sf).where("step is not null and next is not null").withColumn("block", F.floor(F.unix_timestamp(F.col("event_time").cast("timestamp")) / 108000))
    return block_bootstrap(s, "label", "block", (F.signum("step") * F.col("next") > 0).cast("double"), replicates=2000)
