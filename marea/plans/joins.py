"""Queries of joins, set operations, scans, aggregates and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds
from ..operators.asof import asof
from ..operators.exact import quantiles
from ..operators.ordered import ahead, along
from ..sources.ticks import bars, ticks
from .registry import BARS, TICKS, query

W = "(PARTITION BY entity_id ORDER BY seq)"


def r6(x):
    return F.round(x, 6)


def rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


# Scans, projections, cleansing


@query(TICKS + " SELECT entity_id, seq, price FROM t WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00'")
def q_scan_range(spark, sf):
    return ticks(spark, sf).where("event_time >= TIMESTAMP_NTZ'2024-01-10 00:00:00' and event_time < TIMESTAMP_NTZ'2024-01-20 00:00:00'").select("entity_id", "seq", "price")


@query("SELECT ts AS at, event_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_orderdate, o_orderkey, 'order' FROM orders")
def q_union_sorted(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return e.unionByName(o).orderBy("at", "kind", "id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('second', ts) AS parsed FROM events")
def q_ts_parse(spark, sf):
    from ..sources.ticks import parsed_timestamp

    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return e.withColumn("parsed", parsed_timestamp("text"))


@query("""SELECT event_id, CASE WHEN m BETWEEN 570 AND 959 THEN 'REGULAR' WHEN m BETWEEN 240 AND 569 THEN 'PREMARKET' WHEN m BETWEEN 960 AND 1199 OR (m = 1200 AND second(ts) = 0) THEN 'AFTERHOURS' ELSE 'UNKNOWN' END AS session,
  CASE WHEN m BETWEEN 570 AND 959 THEN m - 570 ELSE -1 END AS minute FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def q_session_class(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", S.session_class(F.col("ts")).alias("session"), S.minute_of_session(F.col("ts")).cast("long").alias("minute"))


@query("""SELECT event_id, CASE WHEN m BETWEEN 570 AND 959 THEN 'REGULAR' WHEN m BETWEEN 240 AND 569 THEN 'PREMARKET' WHEN m BETWEEN 960 AND 1199 THEN 'AFTERHOURS' ELSE 'UNKNOWN' END AS session FROM (SELECT *, hour(date_trunc('hour', ts)) * 60 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE minute(ts) END AS m FROM events)""")
def q_session_strict(spark, sf):
    """Sessions that end before 20:00, not with it; each seventh tick is moved to its full hour, so that edges are met."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.when(F.col("event_id") % 7 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    return e.select("event_id", S.session_class(ts, end_inclusive=False).alias("session"))


@query(TICKS + " SELECT entity_id, seq, price, volume, CAST(NULL AS DOUBLE) AS bid, true AS has_price, false AS has_bid FROM t WHERE seq >= 5 AND seq < 25")
def q_replayed(spark, sf):
    """Rows 5 to 24 of each entity as a replay hands them on: the bid that the table lacks is null, and said to be missing."""
    from ..sources.ticks import replayed

    r = replayed(ticks(spark, sf), 5, 25, ("price", "bid"))
    return r.select("entity_id", "seq", "price", "volume", "bid", F.col("available")["price"].alias("has_price"), F.col("available")["bid"].alias("has_bid"))


@query(TICKS + " SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY event_time, event_id) AS audit_seq FROM t")
def q_audit_sequence(spark, sf):
    """The sequence numbers of an append-only audit sink per label."""
    from ..sources.ticks import audited

    return audited(ticks(spark, sf), ["label"], ["event_time", "event_id"]).select("label", "event_id", "audit_seq")


@query(TICKS + f" SELECT entity_id, CASE WHEN count(*) FILTER (WHERE d < 0) = 0 THEN 'ASC' WHEN count(*) FILTER (WHERE d > 0) = 0 THEN 'DESC' ELSE 'MIXED' END AS chronology FROM (SELECT entity_id, event_id - lag(event_id) OVER {W} AS d FROM t) GROUP BY 1")
def q_chronology(spark, sf):
    d = ticks(spark, sf).withColumn("d", F.col("event_id") - F.lag("event_id").over(along("entity_id")))
    down, up = F.count_if(F.col("d") < 0), F.count_if(F.col("d") > 0)
    return d.groupBy("entity_id").agg(F.when(down == 0, "ASC").when(up == 0, "DESC").otherwise("MIXED").alias("chronology"))


@query(BARS + """ SELECT entity_id, day, concat_ws(';', CASE WHEN n_ticks < 2 THEN 'SINGLE_TICK' END, CASE WHEN high = low THEN 'FLAT' END, CASE WHEN open > close THEN 'FALLING' END) AS flags, n_ticks >= 2 AND high > low AS data_valid FROM b""")
def q_quality_flags(spark, sf):
    b = bars(ticks(spark, sf))
    flags = F.array(F.when(F.col("n_ticks") < 2, "SINGLE_TICK"), F.when(F.col("high") == F.col("low"), "FLAT"), F.when(F.col("open") > F.col("close"), "FALLING"))
    return b.select("entity_id", "day", F.array_join(F.array_compact(flags), ";").alias("flags"), ((F.col("n_ticks") >= 2) & (F.col("high") > F.col("low"))).alias("data_valid"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_quantity)) AS versions FROM lineitem GROUP BY 1, 2)
  SELECT CASE WHEN n = 1 THEN 'UNIQUE' WHEN versions = 1 THEN 'EXACT' ELSE 'CONFLICT' END AS kind, count(*) AS keys, CAST(sum(CASE WHEN versions = 1 THEN 1 ELSE n END) AS BIGINT) AS kept FROM d GROUP BY 1""")
def q_dup_policy(spark, sf):
    """Exact copies are kept once; conflicting rows of one key are all kept and told."""
    d = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("l_partkey", "l_quantity")).alias("versions"))
    kind = F.when(F.col("n") == 1, "UNIQUE").when(F.col("versions") == 1, "EXACT").otherwise("CONFLICT")
    return d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("versions") == 1, 1).otherwise(F.col("n"))).alias("kept"))


@query(TICKS + ", c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS total FROM t) SELECT entity_id, seq, CASE WHEN 10 * (seq - 1) < 6 * total THEN 'PHASE_1' WHEN 10 * (seq - 1) < 8 * total THEN 'PHASE_2' ELSE 'PHASE_3' END AS phase FROM c")
def q_phase_split(spark, sf):
    total = F.count(F.lit(1)).over(Window.partitionBy("entity_id"))
    return ticks(spark, sf).select("entity_id", "seq", S.phase_of(F.col("seq"), total).alias("phase"))


@query(TICKS + ", c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS total FROM t), k AS (SELECT DISTINCT entity_id, CAST(floor(i * (total - 1) / 9.0) AS BIGINT) + 1 AS seq FROM (SELECT DISTINCT entity_id, total FROM c), range(10) r(i)) SELECT c.entity_id, c.seq, c.price FROM c JOIN k USING (entity_id, seq)")
def q_even_sample(spark, sf):
    """Ten evenly spaced rows of each entity (a sampling operator)."""
    t = ticks(spark, sf)
    at = t.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total")).select("entity_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(i * (F.col("total") - 1) / 9.0).cast("long") + 1)).alias("seq")).distinct()
    return t.join(at, ["entity_id", "seq"]).select("entity_id", "seq", "price")


@query(TICKS + " SELECT entity_id, seq, CASE WHEN seq < 15 THEN 'WARM_UP' WHEN volume < 10 THEN 'THIN' WHEN price < 1 THEN 'CHEAP' ELSE 'ELIGIBLE' END AS reason FROM t")
def q_eligibility(spark, sf):
    return ticks(spark, sf).select("entity_id", "seq", F.when(F.col("seq") < 15, "WARM_UP").when(F.col("volume") < 10, "THIN").when(F.col("price") < 1, "CHEAP").otherwise("ELIGIBLE").alias("reason"))


@query("SELECT event_id, word FROM (SELECT event_id, unnest([event_type, CASE WHEN value > 100 THEN 'large' ELSE 'small' END]) AS word FROM events)")
def q_event_fanout(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.explode(F.array("event_type", F.when(F.col("value") > 100, "large").otherwise("small"))).alias("word"))


@query("SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', ts)), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def q_tz(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.date_format(F.expr("convert_timezone('America/New_York', 'UTC', ts)"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# Joins


@query("SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def q_join_pv(spark, sf):
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment", "o_totalprice")


@query("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q_join_count(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


_SIDES = TICKS + ", l AS (SELECT entity_id, event_time, seq FROM t WHERE label = 'purchase'), r AS (SELECT entity_id, event_time, price FROM t WHERE label = 'error')"


def _sides(spark, sf):
    t = ticks(spark, sf)
    return t.where("label = 'purchase'").select("entity_id", "event_time", "seq"), t.where("label = 'error'").select("entity_id", "event_time", "price")


@query(_SIDES + " SELECT l.entity_id, l.event_time, l.seq, r.price, r.event_time AS at FROM l ASOF LEFT JOIN r ON l.entity_id = r.entity_id AND l.event_time >= r.event_time")
def q_asof_backward(spark, sf):
    return asof(*_sides(spark, sf), "entity_id", "event_time", "price")


@query(_SIDES + " SELECT l.entity_id, l.event_time, l.seq, r.price, r.event_time AS at FROM l ASOF LEFT JOIN r ON l.entity_id = r.entity_id AND l.event_time > r.event_time")
def q_asof_strict(spark, sf):
    return asof(*_sides(spark, sf), "entity_id", "event_time", "price", strict=True)


@query(_SIDES + " SELECT l.entity_id, l.event_time, l.seq, r.price, r.event_time AS at FROM l ASOF LEFT JOIN r ON l.entity_id = r.entity_id AND l.event_time <= r.event_time")
def q_asof_forward(spark, sf):
    return asof(*_sides(spark, sf), "entity_id", "event_time", "price", forward=True)


_NEAR = _SIDES + """, a AS (SELECT l.*, r.event_time AS before FROM l ASOF LEFT JOIN r ON l.entity_id = r.entity_id AND l.event_time >= r.event_time), z AS (SELECT a.*, r.event_time AS after FROM a ASOF LEFT JOIN r ON a.entity_id = r.entity_id AND a.event_time <= r.event_time)"""


def _nearest(spark, sf):
    left, right = _sides(spark, sf)
    back = asof(left, right, "entity_id", "event_time", "price", at="before").drop("price")
    return asof(back, right, "entity_id", "event_time", "price", forward=True, at="after").drop("price")


@query(_NEAR + " SELECT entity_id, seq, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN event_time - before <= after - event_time THEN before ELSE after END AS nearest FROM z")
def q_asof_nearest(spark, sf):
    earlier = F.col("event_time") - F.col("before") <= F.col("after") - F.col("event_time")
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | earlier, F.col("before")).otherwise(F.col("after"))
    return _nearest(spark, sf).select("entity_id", "seq", near.alias("nearest"))


@query(_NEAR + " SELECT entity_id, seq, CASE WHEN before IS NULL AND after IS NULL THEN 'ALONE' WHEN after IS NULL OR event_time - before < after - event_time THEN 'AFTER_IT' WHEN before IS NULL OR event_time - before > after - event_time THEN 'BEFORE_IT' ELSE 'SIMULTANEOUS' END AS relation FROM z")
def q_transition_relation(spark, sf):
    b, a, t = F.col("before"), F.col("after"), F.col("event_time")
    rel = F.when(b.isNull() & a.isNull(), "ALONE").when(a.isNull() | (t - b < a - t), "AFTER_IT").when(b.isNull() | (t - b > a - t), "BEFORE_IT").otherwise("SIMULTANEOUS")
    return _nearest(spark, sf).select("entity_id", "seq", rel.alias("relation"))


@query(TICKS + ", a AS (SELECT entity_id, seq FROM t WHERE volume > 90) SELECT a.entity_id, a.seq AS turn, t.seq, t.label FROM a JOIN t ON t.entity_id = a.entity_id AND t.seq BETWEEN a.seq - 5 AND a.seq - 1")
def q_precursor_band(spark, sf):
    """A band of fixed width by equi-join on its positions, not by range."""
    t = ticks(spark, sf)
    band = t.where("volume > 90").select("entity_id", F.col("seq").alias("turn"), F.explode(F.sequence(F.col("seq") - 5, F.col("seq") - 1)).alias("seq"))
    return band.join(t, ["entity_id", "seq"]).select("entity_id", "turn", "seq", "label")


@query(TICKS + " SELECT entity_id, seq, EXISTS (SELECT 1 FROM t u WHERE u.entity_id = t.entity_id AND u.seq BETWEEN t.seq + 1 AND t.seq + 5 AND u.label = 'error') AS useful FROM t WHERE volume > 90")
def q_false_warning(spark, sf):
    t = ticks(spark, sf).withColumn("useful", F.coalesce(ahead(F.bool_or(F.col("label") == "error"), 5), F.lit(False)))
    return t.where("volume > 90").select("entity_id", "seq", "useful")


@query(TICKS + ", a AS (SELECT entity_id, seq FROM t WHERE volume > 97), o AS (SELECT a.entity_id, a.seq + k AS seq, k FROM a, range(-15, 16) r(k)) SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(t.price), 6) AS mean_price FROM o JOIN t USING (entity_id, seq) GROUP BY 1")
def q_event_study(spark, sf):
    t = ticks(spark, sf)
    o = t.where("volume > 97").select("entity_id", F.col("seq").alias("anchor"), F.explode(F.sequence(F.lit(-15), F.lit(15))).alias("k")).withColumn("seq", F.col("anchor") + F.col("k"))
    return o.join(t, ["entity_id", "seq"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean_price"))


@query(TICKS + f", p AS (SELECT *, lag(event_id) OVER {W} AS parent FROM t) SELECT count(*) AS children, count(*) FILTER (WHERE b.entity_id = p.entity_id) AS inherited, count(*) FILTER (WHERE b.event_id IS NULL) AS orphans FROM p LEFT JOIN t b ON p.parent = b.event_id WHERE parent IS NOT NULL")
def q_lineage_check(spark, sf):
    t = ticks(spark, sf)
    child = t.withColumn("parent", F.lag("event_id").over(along("entity_id"))).where("parent is not null").select("entity_id", "parent")
    p = t.select(F.col("event_id").alias("parent"), F.col("entity_id").alias("owner"))
    return child.join(p, "parent", "left").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("owner") == F.col("entity_id")).alias("inherited"), F.count_if(F.col("owner").isNull()).alias("orphans"))


@query(TICKS + ", g(name, least) AS (VALUES ('P1', 20.0), ('P2', 50.0), ('P3', 80.0)) SELECT name, label, count(*) AS n, round(avg(price), 6) AS mean_price FROM t, g WHERE volume >= least GROUP BY 1, 2")
def q_policy_grid(spark, sf):
    """Every row under each of a fixed list of policies, by explosion."""
    grid = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("least")) for n, v in (("P1", 20.0), ("P2", 50.0), ("P3", 80.0))])
    t = ticks(spark, sf).withColumn("p", F.explode(grid)).where("volume >= p.least")
    return t.groupBy(F.col("p.name").alias("name"), "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean_price"))


@query(TICKS + ", a AS (SELECT label, avg(price) AS x FROM t WHERE seq % 2 = 0 GROUP BY 1), b AS (SELECT label, avg(price) AS y FROM t WHERE seq % 2 = 1 GROUP BY 1) SELECT label, round(y - x, 6) AS delta, round((y - x) / x, 6) AS relative FROM a JOIN b USING (label)")
def q_compare(spark, sf):
    t = ticks(spark, sf)
    x, y = F.avg(F.when(F.col("seq") % 2 == 0, F.col("price"))), F.avg(F.when(F.col("seq") % 2 == 1, F.col("price")))
    return t.groupBy("label").agg(r6(y - x).alias("delta"), r6((y - x) / x).alias("relative"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def q_common_cover(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("k")).intersect(spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def q_region_except(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k")).subtract(spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 400000").select("o_custkey"))


# Aggregates


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def q_profile(spark, sf):
    e, v = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value"), "value"
    plain = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"))
    return plain.join(rounded(quantiles(e, ["event_type"], v, {"median": 0.5, "p01": 0.01, "p99": 0.99}), "event_type"), "event_type")


@query("SELECT CAST(ts AS DATE) AS day, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def q_daily_summary(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query(TICKS + f", g AS (SELECT floor(date_diff('microsecond', lag(event_time) OVER {W}, event_time) / 60000000.0) AS m FROM t) SELECT CASE WHEN m < 60 THEN 'UNDER_1H' WHEN m < 360 THEN 'UNDER_6H' WHEN m < 1440 THEN 'UNDER_1D' ELSE 'LONGER' END AS bucket, count(*) AS n FROM g WHERE m IS NOT NULL GROUP BY 1")
def q_gap_hist(spark, sf):
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    g = ticks(spark, sf).withColumn("m", F.floor((micros - F.lag(micros).over(along("entity_id"))) / 60000000.0)).where("m is not null")
    return g.groupBy(F.when(F.col("m") < 60, "UNDER_1H").when(F.col("m") < 360, "UNDER_6H").when(F.col("m") < 1440, "UNDER_1D").otherwise("LONGER").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(*) FILTER (WHERE value IS NULL) AS null_values, min(value) AS least, max(value) AS most FROM events")
def q_schema_profile(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_if(F.col("value").isNull()).alias("null_values"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("WITH s(state) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT state, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM events), 6) AS percent FROM s LEFT JOIN n ON state = event_type")
def q_occupancy(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    states = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "never")], "state string")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = states.join(n, F.col("state") == F.col("event_type"), "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("state", n.alias("n"), r6(100.0 * n / F.col("total")).alias("percent"))


@query(TICKS + " SELECT label, volume > 50 AS heavy, price > 50 AS dear, count(*) AS n FROM t GROUP BY 1, 2, 3")
def q_joint_freq(spark, sf):
    return ticks(spark, sf).groupBy("label", (F.col("volume") > 50).alias("heavy"), (F.col("price") > 50).alias("dear")).agg(F.count(F.lit(1)).alias("n"))


_ERR = TICKS + f", e AS (SELECT label, price - lag(price) OVER {W} AS err FROM t)"


def _errors(spark, sf):
    return ticks(spark, sf).select("label", (F.col("price") - F.lag("price").over(along("entity_id"))).alias("err")).where("err is not null")


@query(_ERR + " SELECT label, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(quantile_cont(abs(err), 0.5), 6) AS median_ae, round(avg(err), 6) AS bias FROM e WHERE err IS NOT NULL GROUP BY 1")
def q_error_metrics(spark, sf):
    e = _errors(spark, sf).withColumn("size", F.abs("err"))
    plain = e.groupBy("label").agg(r6(F.avg("size")).alias("mae"), r6(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rmse"), r6(F.avg("err")).alias("bias"))
    return plain.join(rounded(quantiles(e, ["label"], "size", {"median_ae": 0.5}), "label"), "label")


@query(_ERR + " SELECT label, round(quantile_cont(abs(err), 0.5), 6) AS q50, round(quantile_cont(abs(err), 0.9), 6) AS q90, round(quantile_cont(abs(err), 0.999), 6) AS q999 FROM e WHERE err IS NOT NULL GROUP BY 1")
def q_error_quantiles(spark, sf):
    return rounded(quantiles(_errors(spark, sf).withColumn("size", F.abs("err")), ["label"], "size", {"q50": 0.5, "q90": 0.9, "q999": 0.999}), "label")


_SIGN = TICKS + f", d AS (SELECT *, CAST(sign(price - lag(price) OVER {W}) AS INTEGER) AS was, CAST(sign(lead(price) OVER {W} - price) AS INTEGER) AS next FROM t), s AS (SELECT * FROM d WHERE was IS NOT NULL AND next IS NOT NULL)"


def _signs(spark, sf):
    p = F.col("price")
    t = ticks(spark, sf).withColumns({"was": F.signum(p - F.lag("price").over(along("entity_id"))).cast("int"), "next": F.signum(F.lead("price").over(along("entity_id")) - p).cast("int")})
    return t.where("was is not null and next is not null")


@query(_SIGN + " SELECT count(*) FILTER (WHERE was > 0 AND next > 0) AS tp, count(*) FILTER (WHERE was > 0 AND next <= 0) AS fp, count(*) FILTER (WHERE was <= 0 AND next <= 0) AS tn, count(*) FILTER (WHERE was <= 0 AND next > 0) AS fn, round(count(*) FILTER (WHERE was > 0 AND next > 0) * 1.0 / nullif(count(*) FILTER (WHERE was > 0), 0), 6) AS precision FROM s")
def q_confusion(spark, sf):
    a, b = F.col("was") > 0, F.col("next") > 0
    n = F.count_if
    return _signs(spark, sf).agg(n(a & b).alias("tp"), n(a & ~b).alias("fp"), n(~a & ~b).alias("tn"), n(~a & b).alias("fn"), r6(F.try_divide(n(a & b).cast("double"), n(a))).alias("precision"))


@query(_SIGN + " SELECT label, round(avg(CASE WHEN was = next THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY 1")
def q_dir_accuracy(spark, sf):
    return _signs(spark, sf).groupBy("label").agg(r6(F.avg((F.col("was") == F.col("next")).cast("double"))).alias("accuracy"))


@query(_SIGN + ", r AS (SELECT label, next, avg(CASE WHEN was = next THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM s GROUP BY 1, 2) SELECT label, round(avg(recall), 6) AS balanced, arg_max(next, n * 10 + next) AS majority FROM r GROUP BY 1")
def q_balanced_accuracy(spark, sf):
    r = _signs(spark, sf).groupBy("label", "next").agg(F.avg((F.col("was") == F.col("next")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("label").agg(r6(F.avg("recall")).alias("balanced"), F.max_by("next", F.struct("n", "next")).alias("majority"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def q_pearson(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("c"), r6(F.regr_r2("l_extendedprice", "l_quantity")).alias("r2"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query(TICKS + " SELECT entity_id, label AS most_common, n FROM (SELECT entity_id, label, count(*) AS n, min(seq) AS first_seq FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first_seq) = 1")
def q_mode(spark, sf):
    c = ticks(spark, sf).groupBy("entity_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    best = F.max_by(F.struct(F.col("label").alias("most_common"), "n"), F.struct("n", -F.col("first_seq")))
    return c.groupBy("entity_id").agg(best.alias("x")).select("entity_id", "x.*")


@query(TICKS + " SELECT label, CAST(event_time AS DATE) AS day, count(*) AS n, round(avg(volume), 6) AS mean_volume, grouping(label) AS g1, grouping(CAST(event_time AS DATE)) AS g2 FROM t GROUP BY GROUPING SETS ((label, CAST(event_time AS DATE)), (label), ())")
def q_regime_rollup(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.to_date("event_time"))
    out = t.rollup("label", "day").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("volume")).alias("mean_volume"), F.grouping("label").cast("long").alias("g1"), F.grouping("day").cast("long").alias("g2"))
    return out.select("label", "day", "n", "mean_volume", "g1", "g2")


@query("WITH c AS (SELECT l_returnflag || l_linestatus AS model, round(avg(l_discount), 6) AS err, count(*) AS n FROM lineitem GROUP BY 1) SELECT model, err, n FROM c ORDER BY err, n DESC, model LIMIT 1")
def q_select_model(spark, sf):
    c = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(r6(F.avg("l_discount")).alias("err"), F.count(F.lit(1)).alias("n"))
    return c.orderBy("err", F.desc("n"), "model").limit(1)


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value >= {a} AND value < {b}) AS band_{a}" for a, b in ((0, 10), (10, 50), (50, 100), (100, 500))) + " FROM events GROUP BY 1")
def q_bands(spark, sf):
    v = F.col("value")
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(*[F.count_if((v >= a) & (v < b)).alias(f"band_{a}") for a, b in ((0, 10), (10, 50), (50, 100), (100, 500))])


@query(TICKS + ", s AS (SELECT entity_id, min(event_time) AS a, max(event_time) AS z FROM t GROUP BY entity_id, CAST(event_time AS DATE)), e AS (SELECT entity_id % 10 AS pool, a AS moment, 1 AS d FROM s UNION ALL SELECT entity_id % 10, z, -1 FROM s), r AS (SELECT pool, sum(d) OVER (PARTITION BY pool ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT pool, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY 1")
def q_peak_concurrency(spark, sf):
    """Spans that run at once: sums of whole days first, then the order inside each day, so no pool is put in order as a whole."""
    s = ticks(spark, sf).groupBy("entity_id", F.to_date("event_time").alias("day")).agg(F.min("event_time").alias("a"), F.max("event_time").alias("z"))
    e = s.select((F.col("entity_id") % 10).alias("pool"), F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("pool", "x.*", F.to_date("x.at").alias("day"))
    days = e.groupBy("pool", "day").agg(F.sum("d").alias("net"))
    days = days.withColumn("open", F.sum("net").over(Window.partitionBy("pool").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("net"))  # one row a day
    running = F.sum("d").over(Window.partitionBy("pool", "day").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    highest = e.withColumn("n", running).groupBy("pool", "day").agg(F.max("n").alias("n"))
    return highest.join(days, ["pool", "day"]).groupBy("pool").agg(F.max(F.col("open") + F.col("n")).alias("peak"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS contrast FROM orders GROUP BY 1")
def q_class_contrast(spark, sf):
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(of("F") - of("O"), 4).alias("contrast"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS near FROM lineitem GROUP BY 1")
def q_approx_distinct(spark, sf):
    """The estimate's error is told against the exact number, which SQL counts too: within three times its relative deviation."""
    d = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_orderkey").distinct()  # first: beside a distinct count, each pair would carry a sketch through the shuffle
    e = d.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.count("l_orderkey").alias("exact"))
    return e.select("l_returnflag", "exact", (F.abs(F.col("a") - F.col("exact")) <= 0.06 * F.col("exact")).alias("near"))


# Models and recurrences


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'LONG' WHEN 'O' THEN 'FLAT' ELSE 'SHORT' END AS has, CASE WHEN o_totalprice > 300000 THEN 'LONG' WHEN o_totalprice > 100000 THEN 'FLAT' ELSE 'SHORT' END AS wants FROM orders)
  SELECT o_orderkey, has, wants, CASE WHEN has = wants THEN 'NONE' WHEN wants = 'FLAT' THEN 'CLOSE_' || has WHEN has = 'FLAT' THEN 'OPEN_' || wants ELSE 'CLOSE_' || has || '|OPEN_' || wants END AS verbs FROM d""")
def q_position_plan(spark, sf):
    """Current against wanted position, by a table of the nine cells."""
    names = ("LONG", "FLAT", "SHORT")
    verbs = lambda a, b: "NONE" if a == b else "|".join([f"CLOSE_{a}"] * (a != "FLAT") + [f"OPEN_{b}"] * (b != "FLAT"))
    plan = spark.createDataFrame([(a, b, verbs(a, b)) for a in names for b in names], "has string, wants string, verbs string")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    has = F.when(F.col("o_orderstatus") == "F", "LONG").when(F.col("o_orderstatus") == "O", "FLAT").otherwise("SHORT")
    wants = F.when(F.col("o_totalprice") > 300000, "LONG").when(F.col("o_totalprice") > 100000, "FLAT").otherwise("SHORT")
    return o.select("o_orderkey", has.alias("has"), wants.alias("wants")).join(F.broadcast(plan), ["has", "wants"]).select("o_orderkey", "has", "wants", "verbs")


@query(TICKS + """, o AS (SELECT entity_id, list(price ORDER BY seq) AS p FROM t GROUP BY 1), k AS (SELECT entity_id, p, unnest(range(1, len(p) + 1)) AS seq FROM o)
  SELECT entity_id, seq, round(list_reduce(p[1:seq], lambda r, x: r + 0.05 * (x - r)) * 1048576) / 1048576 AS ref FROM k""")
def q_ema_reference(spark, sf):
    return folds.linear_fold(ticks(spark, sf), "price", "ref", 0.05).select("entity_id", "seq", (F.round(F.col("ref") * 1048576.0) / 1048576.0).alias("ref"))


@query(TICKS + """, a AS (SELECT entity_id, seq, price, lead(price, 5) OVER w AS p5, list(price) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY seq))
  SELECT entity_id, seq, round(list_sum(list_transform(range(1, 6), lambda i: i * (y[i + 1] - y[1]))) / 55.0, 6) AS slope, round(list_sum(list_transform(range(1, 6), lambda i: abs(y[i + 1] - y[i]))), 6) AS path_length, round(p5 - price, 6) AS terminal FROM a WHERE p5 IS NOT NULL""")
def q_horizon_geometry(spark, sf):
    y = F.collect_list("price").over(along("entity_id").rowsBetween(0, 5))
    a = ticks(spark, sf).withColumn("y", y).where("size(y) = 6")
    steps = F.sequence(F.lit(1), F.lit(5))
    add = lambda f: F.aggregate(F.transform(steps, f), F.lit(0.0), lambda s, x: s + x)
    at = lambda i: F.element_at("y", i.cast("int"))
    return a.select("entity_id", "seq", r6(add(lambda i: i * (at(i + 1) - F.element_at("y", 1))) / 55.0).alias("slope"), r6(add(lambda i: F.abs(at(i + 1) - at(i)))).alias("path_length"), r6(F.element_at("y", 6) - F.element_at("y", 1)).alias("terminal"))


@query(TICKS + ", b AS (SELECT label, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 4) SELECT round(sum(iqr * n) / sum(n), 6) AS weighted_iqr, (SELECT round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 6) FROM t) AS overall_iqr FROM b")
def q_weighted_iqr(spark, sf):
    t, ends = ticks(spark, sf).select("label", "price"), {"a": 0.25, "z": 0.75}
    n = t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    b = quantiles(t, ["label"], "price", ends).join(n, "label").agg(r6(F.sum((F.col("z") - F.col("a")) * F.col("n")) / F.sum("n")).alias("weighted_iqr"))
    return b.join(F.broadcast(quantiles(t, [], "price", ends).select(r6(F.col("z") - F.col("a")).alias("overall_iqr"))))


@query(TICKS + f", m AS (SELECT *, CAST(sign(lead(price) OVER {W} - price) AS INTEGER) AS next FROM t), c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS total FROM m) SELECT CASE WHEN 10 * (seq - 1) < 6 * total THEN 'PHASE_1' WHEN 10 * (seq - 1) < 8 * total THEN 'PHASE_2' ELSE 'PHASE_3' END AS phase, label, count(*) FILTER (WHERE next > 0) AS up, count(*) FILTER (WHERE next = 0) AS same, count(*) FILTER (WHERE next < 0) AS down FROM c WHERE next IS NOT NULL GROUP BY 1, 2")
def q_class_distribution(spark, sf):
    total = F.count(F.lit(1)).over(Window.partitionBy("entity_id"))
    t = ticks(spark, sf).withColumns({"next": F.signum(F.lead("price").over(along("entity_id")) - F.col("price")), "phase": S.phase_of(F.col("seq"), total)}).where("next is not null")
    n = F.col("next")
    return t.groupBy("phase", "label").agg(F.count_if(n > 0).alias("up"), F.count_if(n == 0).alias("same"), F.count_if(n < 0).alias("down"))


@query(TICKS + " SELECT entity_id, arg_min(price, seq) AS start, arg_max(price, seq) AS ended, min(price) AS least, max(price) AS most, max(step) AS max_step FROM (SELECT *, round(abs(price - lag(price) OVER (PARTITION BY entity_id ORDER BY seq)), 6) AS step FROM t) GROUP BY 1")
def q_drift(spark, sf):
    t = ticks(spark, sf).withColumn("step", r6(F.abs(F.col("price") - F.lag("price").over(along("entity_id")))))
    return t.groupBy("entity_id").agg(F.min_by("price", "seq").alias("start"), F.max_by("price", "seq").alias("ended"), F.min("price").alias("least"), F.max("price").alias("most"), F.max("step").alias("max_step"))


@query(TICKS + ", h AS (SELECT *, greatest(1, least(20, CAST(floor(volume / 5) AS BIGINT))) AS h FROM t) SELECT a.entity_id, a.seq, a.h, round(b.price - a.price, 6) AS change FROM h a JOIN t b ON a.entity_id = b.entity_id AND b.seq = a.seq + a.h")
def q_dynamic_horizon(spark, sf):
    t = ticks(spark, sf)
    a = t.withColumn("h", F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.col("volume") / 5))).cast("long")).select("entity_id", F.col("seq").alias("from_seq"), "h", F.col("price").alias("p"), (F.col("seq") + F.col("h")).alias("seq"))
    return a.join(t, ["entity_id", "seq"]).select("entity_id", F.col("from_seq").alias("seq"), "h", r6(F.col("price") - F.col("p")).alias("change"))
