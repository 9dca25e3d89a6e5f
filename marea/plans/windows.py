"""Queries of ordered windows, runs and labels over ticks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.exact import average_ranks, quantiles
from ..operators.ordered import ahead, along, crossings, drawdown, full_window, persistence, prior, quadratic_fit, with_runs
from ..sources.ticks import bars, ticks
from .registry import BARS, TICKS, query

W = "(PARTITION BY entity_id ORDER BY seq)"


def r6(x):
    return S.rounded(x, 6)


@query(BARS + " SELECT * FROM b")
def q_tumbling_ohlcv(spark, sf):
    return bars(ticks(spark, sf))


@query(BARS + """ SELECT entity_id, day, round(close / lag(close) OVER (PARTITION BY entity_id ORDER BY day) - 1, 6) AS close_return, round(high - low, 6) AS high_low_range,
  round((high - low) / close, 6) AS high_low_range_fraction, round(close - open, 6) AS open_close_change, round(close / nullif(open, 0) - 1, 6) AS open_close_return FROM b""")
def q_bar_features(spark, sf):
    before = F.lag("close").over(Window.partitionBy("entity_id").orderBy("day"))
    b = bars(ticks(spark, sf))
    return b.select("entity_id", "day", r6(S.ratio(F.col("close"), before) - 1).alias("close_return"), r6(F.col("high") - F.col("low")).alias("high_low_range"), r6(S.ratio(F.col("high") - F.col("low"), F.col("close"))).alias("high_low_range_fraction"), r6(F.col("close") - F.col("open")).alias("open_close_change"), r6(F.col("close") / F.nullif("open", F.lit(0.0)) - 1).alias("open_close_return"))


@query(TICKS + f""" SELECT entity_id, seq, CASE WHEN row_number() OVER {W} >= 15 THEN round(quantile_cont(volume, 0.5) OVER (PARTITION BY entity_id ORDER BY seq ROWS 14 PRECEDING), 6) END AS median_15,
  CASE WHEN row_number() OVER {W} >= 30 THEN round(avg(volume) OVER (PARTITION BY entity_id ORDER BY seq ROWS 29 PRECEDING), 6) END AS mean_30 FROM t""")
def q_rolling_median(spark, sf):
    t = ticks(spark, sf)
    return t.select("entity_id", "seq", r6(full_window(F.percentile("volume", 0.5), 15)).alias("median_15"), r6(full_window(F.avg("volume"), 30)).alias("mean_30"))


@query(TICKS + f""", m AS (SELECT *, CASE WHEN row_number() OVER {W} >= 15 THEN quantile_cont(volume, 0.5) OVER (PARTITION BY entity_id ORDER BY seq ROWS 14 PRECEDING) END AS b FROM t)
  SELECT entity_id, seq, CASE WHEN b > 0 THEN round(volume / b, 6) END AS ratio, CASE WHEN b > 0 AND volume > 0 THEN round(ln(volume / b), 6) END AS log_ratio FROM m""")
def q_volume_ratio(spark, sf):
    t = ticks(spark, sf).withColumn("b", full_window(F.percentile("volume", 0.5), 15))
    ok = F.col("b") > 0
    return t.select("entity_id", "seq", F.when(ok, r6(F.col("volume") / F.col("b"))).alias("ratio"), F.when(ok & (F.col("volume") > 0), r6(F.log(F.col("volume") / F.col("b")))).alias("log_ratio"))


@query(TICKS + """, p AS (SELECT entity_id, seq, list(price) OVER (PARTITION BY entity_id ORDER BY seq ROWS 14 PRECEDING) AS y FROM t),
  s AS (SELECT entity_id, seq, list_sum(list_transform(y, lambda v, i: (i - 15) * v)) AS xy, list_sum(list_transform(y, lambda v, i: (i - 15) * (i - 15) * v)) AS xxy, list_sum(y) AS sy FROM p WHERE seq >= 15),
  c AS (SELECT *, 15.0 AS n, -105.0 AS a, 1015.0 AS b, -11025.0 AS c3, 127687.0 AS d4 FROM s)
  SELECT entity_id, seq, round((n * (xy * d4 - c3 * xxy) - sy * (a * d4 - b * c3) + b * (a * xxy - b * xy)) / (n * (b * d4 - c3 * c3) - a * (a * d4 - b * c3) + b * (a * c3 - b * b)), 4) AS d1,
   round(2 * (n * (b * xxy - xy * c3) - a * (a * xxy - xy * b) + sy * (a * c3 - b * b)) / (n * (b * d4 - c3 * c3) - a * (a * d4 - b * c3) + b * (a * c3 - b * b)), 4) AS d2 FROM c""")
def q_quadratic_w15(spark, sf):
    t = ticks(spark, sf).withColumn("x", F.col("seq").cast("double"))
    return quadratic_fit(t, "price", "x", 15).where("seq >= 15").select("entity_id", "seq", F.round("d1", 4).alias("d1"), F.round("d2", 4).alias("d2"))


def _state_sql(k: int) -> str:
    f = f"OVER (PARTITION BY entity_id ORDER BY seq ROWS {k - 1} PRECEDING)"
    return f"""SELECT entity_id, seq, {k} AS k, round(avg(volume) {f}, 6) AS mean, round(quantile_cont(volume, 0.5) {f}, 6) AS median, min(volume) {f} AS least, max(volume) {f} AS most,
      round(stddev_pop(volume) {f}, 6) AS spread, count(*) FILTER (WHERE volume >= 50) {f} AS n_50, seq - max(CASE WHEN TRUE THEN 0 END) {f} AS z FROM t"""


@query(TICKS + " SELECT entity_id, seq, k, mean, median, least, most, spread, n_50 FROM (" + " UNION ALL ".join(_state_sql(k) for k in (3, 5, 8, 15)) + ") WHERE seq >= k")
def q_interval_state(spark, sf):
    t = ticks(spark, sf)
    parts = []
    for k in (3, 5, 8, 15):
        f = along("entity_id").rowsBetween(1 - k, 0)
        parts.append(t.select("entity_id", "seq", F.lit(k).alias("k"), r6(F.avg("volume").over(f)).alias("mean"), r6(F.percentile("volume", 0.5).over(f)).alias("median"), F.min("volume").over(f).alias("least"), F.max("volume").over(f).alias("most"), r6(F.stddev_pop("volume").over(f)).alias("spread"), F.count_if(F.col("volume") >= 50).over(f).alias("n_50")).where(F.col("seq") >= k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(TICKS + f""", d AS (SELECT *, price > 50 AS c FROM t), r AS (SELECT *, max(CASE WHEN NOT c THEN seq END) OVER {W} AS last_off FROM d)
  SELECT entity_id, seq, seq - coalesce(last_off, 0) AS persistence FROM r""")
def q_persistence(spark, sf):
    t = ticks(spark, sf)
    return t.select("entity_id", "seq", persistence(F.col("price") > 50).alias("persistence"))


_RUNS = TICKS + f""", g AS (SELECT *, CAST(sum(CASE WHEN label IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER {W} AS BIGINT) AS run FROM (SELECT *, lag(label) OVER {W} AS before FROM t))"""


@query(_RUNS + " SELECT entity_id, run, label, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, min(event_time) AS started, max(event_time) AS ended FROM g GROUP BY 1, 2, 3")
def q_intervals(spark, sf):
    g = with_runs(ticks(spark, sf), "label")
    return g.groupBy("entity_id", "run", "label").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.min("event_time").alias("started"), F.max("event_time").alias("ended"))


@query(_RUNS + ", l AS (SELECT entity_id, run, label, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT label, max(n) AS longest, count(*) AS runs, round(avg(n), 6) AS mean_length FROM l GROUP BY 1")
def q_max_run(spark, sf):
    runs = with_runs(ticks(spark, sf), "label").groupBy("entity_id", "run", "label").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("label").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"), r6(F.avg("n")).alias("mean_length"))


@query(_RUNS + ", l AS (SELECT entity_id, run, label, min(seq) AS first_seq, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT entity_id, label, first_seq, n FROM l QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first_seq) = 1")
def q_longest_run(spark, sf):
    runs = with_runs(ticks(spark, sf), "label").groupBy("entity_id", "run", "label").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("entity_id").agg(F.max_by(F.struct("label", "first_seq", "n"), F.struct("n", -F.col("first_seq"))).alias("x"))
    return best.select("entity_id", "x.*")


@query(_RUNS + """, l AS (SELECT entity_id, run, min(seq) AS a, max(seq) AS z, count(*) AS n FROM g GROUP BY 1, 2), x AS (SELECT *, lead(a) OVER (PARTITION BY entity_id ORDER BY run) AS next FROM l)
  SELECT entity_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS covered, count(*) FILTER (WHERE next IS NOT NULL AND next <> z + 1) AS gaps, count(*) FILTER (WHERE n <> z - a + 1) AS torn FROM x GROUP BY 1""")
def q_interval_audit(spark, sf):
    runs = with_runs(ticks(spark, sf), "label").groupBy("entity_id", "run").agg(F.min("seq").alias("a"), F.max("seq").alias("z"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("next", F.lead("a").over(Window.partitionBy("entity_id").orderBy("run")))
    return runs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("covered"), F.count_if(F.col("next") != F.col("z") + 1).alias("gaps"), F.count_if(F.col("n") != F.col("z") - F.col("a") + 1).alias("torn"))


@query(TICKS + f""", j AS (SELECT *, label || '|' || CASE WHEN price > 50 THEN 'HIGH' ELSE 'LOW' END AS state FROM t),
  g AS (SELECT *, CAST(sum(CASE WHEN state IS NOT DISTINCT FROM before AND CAST(event_time AS DATE) = CAST(prev AS DATE) THEN 0 ELSE 1 END) OVER {W} AS BIGINT) AS run FROM (SELECT *, lag(state) OVER {W} AS before, lag(event_time) OVER {W} AS prev FROM j))
  SELECT entity_id, run, state, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2, 3""")
def q_joint_intervals(spark, sf):
    t = ticks(spark, sf).withColumn("state", F.concat_ws("|", "label", F.when(F.col("price") > 50, "HIGH").otherwise("LOW")))
    new_day = F.to_date("event_time") != F.to_date(F.lag("event_time").over(along("entity_id")))
    return with_runs(t, "state", apart=new_day).groupBy("entity_id", "run", "state").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(TICKS + f""", d AS (SELECT *, sign(price - lag(price) OVER {W}) AS s FROM t), x AS (SELECT * FROM d WHERE s <> 0), k AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY entity_id, s ORDER BY seq) AS island FROM x)
  SELECT entity_id, CAST(s AS INTEGER) AS direction, min(seq) AS first_seq, count(*) AS n FROM k GROUP BY entity_id, s, island""")
def q_run_lengths(spark, sf):
    d = ticks(spark, sf).withColumn("direction", F.signum(F.col("price") - F.lag("price").over(along("entity_id"))).cast("int")).where("direction != 0")
    return with_runs(d, "direction").groupBy("entity_id", "direction", "run").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).drop("run")


@query(TICKS + " SELECT entity_id, seq, " + ", ".join(f"max(volume) OVER p{k} AS max_{k}, round(avg(volume) OVER p{k}, 6) AS mean_{k}, bool_or(volume > 90) OVER p{k} AS any_{k}" for k in (1, 3, 5, 8, 15)) + " FROM t WINDOW " + ", ".join(f"p{k} AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 3, 5, 8, 15)))
def q_prior_features(spark, sf):
    t = ticks(spark, sf)
    out = []
    for k in (1, 3, 5, 8, 15):
        out += [prior(F.max("volume"), k).alias(f"max_{k}"), r6(prior(F.avg("volume"), k)).alias(f"mean_{k}"), prior(F.bool_or(F.col("volume") > 90), k).alias(f"any_{k}")]
    return t.select("entity_id", "seq", *out)


@query(TICKS + f""", d AS (SELECT *, price - lag(price) OVER {W} AS change FROM t) SELECT entity_id, seq, round(quantile_cont(price, 0.5) OVER p, 6) AS median_c, min(price) OVER p AS min_c, max(price) OVER p AS max_c,
  lag(price) OVER {W} AS prior_c, round(change, 6) AS delta_c, count(*) FILTER (WHERE change > 0) OVER p AS ups, count(*) FILTER (WHERE change < 0) OVER p AS downs, count(*) FILTER (WHERE change = 0) OVER p AS flats
  FROM d WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""")
def q_context15(spark, sf):
    d = ticks(spark, sf).withColumn("change", F.col("price") - F.lag("price").over(along("entity_id")))
    c = F.col("change")
    return d.select("entity_id", "seq", r6(prior(F.percentile("price", 0.5), 15)).alias("median_c"), prior(F.min("price"), 15).alias("min_c"), prior(F.max("price"), 15).alias("max_c"), F.lag("price").over(along("entity_id")).alias("prior_c"), r6(c).alias("delta_c"), prior(F.count_if(c > 0), 15).alias("ups"), prior(F.count_if(c < 0), 15).alias("downs"), prior(F.count_if(c == 0), 15).alias("flats"))


@query(TICKS + """, q AS (SELECT quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.75) AS b, quantile_cont(volume, 0.95) AS c FROM t)
  SELECT entity_id, seq, CASE WHEN volume <= a THEN 'LOW' WHEN volume <= b THEN 'NORMAL' WHEN volume <= c THEN 'ELEVATED' ELSE 'EXTREME' END AS regime FROM t, q""")
def q_volume_regime(spark, sf):
    t = ticks(spark, sf)
    q = quantiles(t, [], "volume", {"a": 0.25, "b": 0.75, "c": 0.95})  # one row
    return t.join(F.broadcast(q)).select("entity_id", "seq", S.regime_of(F.col("volume"), F.col("a"), F.col("b"), F.col("c")).alias("regime"))


_CROSS = TICKS + f""", m AS (SELECT *, price - 50 AS x, lag(price - 50) OVER {W} AS before FROM t), c AS (SELECT *, CASE WHEN before < 0 AND x >= 0 THEN 'LOWER' WHEN before > 0 AND x <= 0 THEN 'UPPER' END AS kind FROM m)"""


def _crossed(spark, sf):
    return ticks(spark, sf).withColumn("kind", crossings(F.col("price") - 50))


@query(_CROSS + f" SELECT entity_id, seq, kind, row_number() OVER (PARTITION BY entity_id, kind ORDER BY seq) AS n FROM c WHERE kind IS NOT NULL")
def q_crossings(spark, sf):
    c = _crossed(spark, sf).where("kind is not null")
    return c.select("entity_id", "seq", "kind", F.row_number().over(along("entity_id", "kind")).cast("long").alias("n"))


@query(_CROSS + ", k AS (SELECT * FROM c WHERE kind IS NOT NULL), l AS (SELECT *, lead(kind) OVER (PARTITION BY entity_id ORDER BY seq) AS next, lead(seq) OVER (PARTITION BY entity_id ORDER BY seq) AS next_seq FROM k) SELECT entity_id, count(*) AS cycles, CAST(sum(next_seq - seq) AS BIGINT) AS rows_in FROM l WHERE kind = 'LOWER' AND next = 'UPPER' GROUP BY 1")
def q_cycles(spark, sf):
    k = _crossed(spark, sf).where("kind is not null").withColumns({"next": F.lead("kind").over(along("entity_id")), "next_seq": F.lead("seq").over(along("entity_id"))})
    return k.where("kind = 'LOWER' and next = 'UPPER'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("cycles"), F.sum(F.col("next_seq") - F.col("seq")).alias("rows_in"))


@query(_CROSS + f""", r AS (SELECT *, max(CASE WHEN NOT volume > 30 THEN seq END) OVER {W} AS off FROM c), p AS (SELECT *, seq - coalesce(off, 0) AS held FROM r), l AS (SELECT *, coalesce(lag(held) OVER {W}, 0) AS before_held FROM p)
  SELECT least_run, count(*) AS n, round(avg(before_held), 6) AS mean_run FROM l, (VALUES (1), (2), (3)) v(least_run) WHERE kind IS NOT NULL AND before_held >= least_run GROUP BY 1""")
def q_precursor_runs(spark, sf):
    c = _crossed(spark, sf).withColumn("held", persistence(F.col("volume") > 30))
    c = c.withColumn("held", F.coalesce(F.lag("held").over(along("entity_id")), F.lit(0))).where("kind is not null")
    out = c.withColumn("least_run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("held >= least_run")
    return out.groupBy("least_run").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("held")).alias("mean_run"))


@query(TICKS + """ SELECT entity_id, seq, CASE WHEN price > a THEN 'MAX' ELSE 'MIN' END AS turn FROM (SELECT *, max(price) OVER p AS a, min(price) OVER p AS b, max(price) OVER n AS c, min(price) OVER n AS d, count(*) OVER p AS np, count(*) OVER n AS nn FROM t
  WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  WHERE np = 3 AND nn = 3 AND ((price > a AND price > c) OR (price < b AND price < d))""")
def q_turns(spark, sf):
    t = ticks(spark, sf).withColumns({"a": prior(F.max("price"), 3), "b": prior(F.min("price"), 3), "c": ahead(F.max("price"), 3), "d": ahead(F.min("price"), 3), "np": prior(F.count(F.lit(1)), 3), "nn": ahead(F.count(F.lit(1)), 3)})
    t = t.where("np = 3 and nn = 3 and ((price > a and price > c) or (price < b and price < d))")
    return t.select("entity_id", "seq", F.when(F.col("price") > F.col("a"), "MAX").otherwise("MIN").alias("turn"))


@query(TICKS + f""", l AS (SELECT *, lag(label) OVER s AS before, CAST(event_time AS DATE) AS day FROM t WINDOW s AS (PARTITION BY entity_id, CAST(event_time AS DATE) ORDER BY seq))
  SELECT entity_id, seq, before AS from_state, label AS to_state FROM l WHERE before <> label""")
def q_transitions(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.to_date("event_time"))
    t = t.withColumn("from_state", F.lag("label").over(along("entity_id", "day")))
    return t.where("from_state != label").select("entity_id", "seq", "from_state", F.col("label").alias("to_state"))


@query(TICKS + f" SELECT before, label, count(*) AS n FROM (SELECT label, lag(label) OVER {W} AS before FROM t) WHERE before IS NOT NULL GROUP BY 1, 2")
def q_state_bigrams(spark, sf):
    return ticks(spark, sf).withColumn("before", F.lag("label").over(along("entity_id"))).where("before is not null").groupBy("before", "label").agg(F.count(F.lit(1)).alias("n"))


@query(TICKS + f" SELECT b || '>' || a || '>' || label AS path, count(*) AS n FROM (SELECT label, lag(label) OVER {W} AS a, lag(label, 2) OVER {W} AS b FROM t) WHERE b IS NOT NULL GROUP BY 1")
def q_state_trigrams(spark, sf):
    t = ticks(spark, sf).withColumns({"a": F.lag("label").over(along("entity_id")), "b": F.lag("label", 2).over(along("entity_id"))}).where("b is not null")
    return t.groupBy(F.concat_ws(">", "b", "a", "label").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query(TICKS + f""", g AS (SELECT *, CAST(price - lag(price) OVER {W} AS DECIMAL(18,2)) AS gain FROM t WHERE price IS NOT NULL), s AS (SELECT *, sum(gain) OVER {W} AS total FROM g), p AS (SELECT *, greatest(0, max(total) OVER {W}) AS peak FROM s)
  SELECT entity_id, seq, CAST(total AS DOUBLE) AS total, CAST(peak AS DOUBLE) AS peak, CAST(peak - total AS DOUBLE) AS drawdown FROM p""")
def q_drawdown(spark, sf):
    t = ticks(spark, sf).withColumn("gain", (F.col("price") - F.lag("price").over(along("entity_id"))).cast("decimal(18,2)"))
    out = drawdown(t, "gain", ("entity_id",), ("seq",))
    return out.select("entity_id", "seq", *[F.col(c).cast("double").alias(c) for c in ("total", "peak", "drawdown")])


@query(TICKS + f" SELECT entity_id, seq, lead(price) OVER {W} AS fill_price, lead(event_time) OVER {W} AS fill_time FROM t QUALIFY label = 'purchase'")
def q_next_open_fill(spark, sf):
    t = ticks(spark, sf).withColumns({"fill_price": F.lead("price").over(along("entity_id")), "fill_time": F.lead("event_time").over(along("entity_id"))})
    return t.where("label = 'purchase'").select("entity_id", "seq", "fill_price", "fill_time")


@query(TICKS + " SELECT entity_id, seq, " + ", ".join(f"round(lead(price, {h}) OVER {W} / price - 1, 6) AS return_{h}" for h in (1, 5, 15)) + " FROM t")
def q_forward_returns(spark, sf):
    t = ticks(spark, sf)
    return t.select("entity_id", "seq", *[r6(S.ratio(F.lead("price", h).over(along("entity_id")), F.col("price")) - 1).alias(f"return_{h}") for h in (1, 5, 15)])


@query(TICKS + """, f AS (SELECT entity_id, seq, price, list(price) OVER n AS later, count(*) OVER n AS k FROM t WINDOW n AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
  SELECT entity_id, seq, round(list_max(later) - price, 6) AS mfe, round(list_min(later) - price, 6) AS mae, CAST(list_position(later, list_max(later)) AS BIGINT) AS rows_to_mfe FROM f WHERE k = 10""")
def q_excursions(spark, sf):
    t = ticks(spark, sf).withColumns({"later": ahead(F.collect_list("price"), 10)}).where(F.size("later") == 10)
    return t.select("entity_id", "seq", r6(F.array_max("later") - F.col("price")).alias("mfe"), r6(F.array_min("later") - F.col("price")).alias("mae"), F.array_position("later", F.array_max("later")).alias("rows_to_mfe"))


@query(TICKS + """ SELECT entity_id, seq, CASE WHEN n >= 20 AND s > 0 THEN round(greatest(-8.0, least(8.0, (price - m) / s)), 4) END AS z FROM (SELECT *, avg(price) OVER p AS m, stddev_samp(price) OVER p AS s, count(price) OVER p AS n FROM t
  WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def q_causal_zscore(spark, sf):
    p = along("entity_id").rowsBetween(Window.unboundedPreceding, -1)
    t = ticks(spark, sf).withColumns({"m": F.avg("price").over(p), "s": F.stddev_samp("price").over(p), "n": F.count("price").over(p)})
    return t.select("entity_id", "seq", F.when((F.col("n") >= 20) & (F.col("s") > 0), F.round(S.clamp((F.col("price") - F.col("m")) / F.col("s"), -8.0, 8.0), 4)).alias("z"))


@query(TICKS + """ SELECT entity_id, seq, round(volume / nullif(m, 0), 6) AS to_mean, round(volume / nullif(d, 0), 6) AS to_median FROM (SELECT *, avg(volume) OVER p AS m, quantile_cont(volume, 0.5) OVER p AS d FROM t
  WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")
def q_relative_volume(spark, sf):
    v, zero = F.col("volume"), F.lit(0.0)
    t = ticks(spark, sf).withColumns({"m": prior(F.avg("volume"), 20), "d": prior(F.percentile("volume", 0.5), 20)})
    return t.select("entity_id", "seq", r6(v / F.nullif("m", zero)).alias("to_mean"), r6(v / F.nullif("d", zero)).alias("to_median"))


@query(TICKS + """ SELECT entity_id, seq, round(v / nullif(date_diff('microsecond', a, b) / 1e6, 0), 8) AS density FROM (SELECT *, sum(volume) OVER p AS v, min(event_time) OVER p AS a, max(event_time) OVER p AS b FROM t
  WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS 199 PRECEDING))""")
def q_volume_density(spark, sf):
    p = along("entity_id").rowsBetween(-199, 0)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (micros(F.max("event_time").over(p)) - micros(F.min("event_time").over(p))) / 1e6
    return ticks(spark, sf).select("entity_id", "seq", F.round(F.sum("volume").over(p) / F.nullif(span, F.lit(0.0)), 8).alias("density"))


@query(TICKS + f""" SELECT entity_id, seq, CASE WHEN before IS NULL THEN 'START' WHEN day - CAST(before AS DATE) > 2 THEN 'WEEKEND' WHEN day > CAST(before AS DATE) THEN 'OVERNIGHT' WHEN event_time - before > INTERVAL 1 HOUR THEN 'GAP' ELSE 'CONTINUOUS' END AS stratum
  FROM (SELECT *, CAST(event_time AS DATE) AS day, lag(event_time) OVER {W} AS before FROM t)""")
def q_transition_stratum(spark, sf):
    t = ticks(spark, sf).withColumn("before", F.lag("event_time").over(along("entity_id")))
    days = F.datediff(F.to_date("event_time"), F.to_date("before"))
    gap = F.col("event_time") - F.col("before") > F.expr("INTERVAL 1 HOUR")
    return t.select("entity_id", "seq", F.when(F.col("before").isNull(), "START").when(days > 2, "WEEKEND").when(days > 0, "OVERNIGHT").when(gap, "GAP").otherwise("CONTINUOUS").alias("stratum"))


@query(TICKS + """, s AS (SELECT entity_id, CAST(event_time AS DATE) AS day, arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price, arg_max(label, seq) AS last_state, min(seq) AS a, arg_min(label, seq) AS first_state FROM t GROUP BY 1, 2)
  SELECT entity_id, day, first_price, last_price, last_state, lead(first_state) OVER o AS next_state, round(lead(first_price) OVER o - last_price, 6) AS gap FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY day)""")
def q_session_boundary(spark, sf):
    s = ticks(spark, sf).groupBy("entity_id", F.to_date("event_time").alias("day")).agg(F.min_by("price", "seq").alias("first_price"), F.max_by("price", "seq").alias("last_price"), F.max_by("label", "seq").alias("last_state"), F.min_by("label", "seq").alias("first_state"))
    o = Window.partitionBy("entity_id").orderBy("day")
    return s.select("entity_id", "day", "first_price", "last_price", "last_state", F.lead("first_state").over(o).alias("next_state"), r6(F.lead("first_price").over(o) - F.col("last_price")).alias("gap"))


@query(TICKS + f""", p AS (SELECT *, max(CASE label WHEN 'purchase' THEN seq * 2 + 1 WHEN 'error' THEN seq * 2 END) OVER {W} AS k FROM t), s AS (SELECT *, CASE WHEN k % 2 = 1 THEN 'LONG' ELSE 'FLAT' END AS state FROM p)
  SELECT entity_id, seq, coalesce(lag(state) OVER {W}, 'FLAT') AS state_before, state AS state_after FROM s""")
def q_position_fsm(spark, sf):
    """FLAT or LONG by the last of buy (purchase) and sell (error): no fold, a carried last value."""
    state = F.last(F.when(F.col("label") == "purchase", "LONG").when(F.col("label") == "error", "FLAT"), ignorenulls=True).over(along("entity_id").rowsBetween(Window.unboundedPreceding, 0))
    t = ticks(spark, sf).withColumn("state_after", F.coalesce(state, F.lit("FLAT")))
    return t.select("entity_id", "seq", F.coalesce(F.lag("state_after").over(along("entity_id")), F.lit("FLAT")).alias("state_before"), "state_after")


_FSM = TICKS + f""", p AS (SELECT *, max(CASE label WHEN 'purchase' THEN seq * 2 + 1 WHEN 'error' THEN seq * 2 END) OVER {W} AS k FROM t), s AS (SELECT *, coalesce(k % 2 = 1, FALSE) AS long FROM p), e AS (SELECT *, long AND NOT coalesce(lag(long) OVER {W}, FALSE) AS opens FROM s), n AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER {W} AS BIGINT) AS episode FROM e)"""


def _episodes(spark, sf):
    long = F.coalesce(F.last(F.when(F.col("label") == "purchase", True).when(F.col("label") == "error", False), ignorenulls=True).over(along("entity_id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    t = ticks(spark, sf).withColumn("long", long)
    t = t.withColumn("opens", F.col("long") & ~F.coalesce(F.lag("long").over(along("entity_id")), F.lit(False)))
    return t.withColumn("episode", F.sum(F.col("opens").cast("int")).over(along("entity_id").rowsBetween(Window.unboundedPreceding, 0)))


@query(_FSM + """ SELECT entity_id, episode, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, arg_min(price, seq) AS open_price, min(price) AS min_price, max(price) AS max_price, count(*) FILTER (WHERE label = 'purchase') AS buys FROM n WHERE long GROUP BY 1, 2""")
def q_episodes(spark, sf):
    return _episodes(spark, sf).where("long").groupBy("entity_id", "episode").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.min_by("price", "seq").alias("open_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count_if(F.col("label") == "purchase").alias("buys"))


@query(_FSM + """, x AS (SELECT entity_id, episode, CAST(arg_max(price, seq) AS DECIMAL(18,2)) - CAST(arg_min(price, seq) AS DECIMAL(18,2)) AS pnl FROM n WHERE long GROUP BY 1, 2)
  SELECT count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, CAST(sum(pnl) AS DOUBLE) AS gross, round(CAST(sum(pnl) FILTER (WHERE pnl > 0) AS DOUBLE) / nullif(-CAST(sum(pnl) FILTER (WHERE pnl < 0) AS DOUBLE), 0), 6) AS profit_factor, round(avg(CAST(pnl AS DOUBLE)), 6) AS expectancy, round(quantile_cont(CAST(pnl AS DOUBLE), 0.5), 6) AS median,
   round(quantile_cont(CAST(pnl AS DOUBLE), 0.5) FILTER (WHERE pnl > 0), 6) AS median_win, round(quantile_cont(CAST(pnl AS DOUBLE), 0.5) FILTER (WHERE pnl < 0), 6) AS median_loss, round(stddev_pop(CAST(pnl AS DOUBLE)), 6) AS deviation FROM x""")
def q_trade_summary(spark, sf):
    d = lambda f: f("price", "seq").cast("decimal(18,2)")
    x = _episodes(spark, sf).where("long").groupBy("entity_id", "episode").agg((d(F.max_by) - d(F.min_by)).alias("pnl"))
    p = F.col("pnl")
    won, lost = F.sum(F.when(p > 0, p)).cast("double"), F.sum(F.when(p < 0, p)).cast("double")
    x = x.withColumn("side", F.signum(p.cast("double")).cast("int")).withColumn("value", p.cast("double"))
    of = lambda df, name: F.broadcast(quantiles(df, [], "value", {name: 0.5}).withColumn(name, r6(name)))
    plain = x.agg(F.count(F.lit(1)).alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).cast("double").alias("gross"), r6(won / F.nullif(-lost, F.lit(0.0))).alias("profit_factor"), r6(F.avg("value")).alias("expectancy"), r6(F.stddev_pop("value")).alias("deviation"))
    return plain.join(of(x, "median")).join(of(x.where("side > 0"), "median_win")).join(of(x.where("side < 0"), "median_loss"))


@query(_FSM + """, x AS (SELECT entity_id, episode, strftime(arg_max(event_time, seq), '%Y-%m') AS month, CAST(arg_max(price, seq) AS DECIMAL(18,2)) - CAST(arg_min(price, seq) AS DECIMAL(18,2)) AS pnl FROM n WHERE long GROUP BY 1, 2)
  SELECT month, count(*) AS trades, CAST(sum(pnl) AS DOUBLE) AS pnl FROM x GROUP BY 1""")
def q_monthly_pnl(spark, sf):
    d = lambda f: f("price", "seq").cast("decimal(18,2)")
    x = _episodes(spark, sf).where("long").groupBy("entity_id", "episode").agg(F.date_format(F.max_by("event_time", "seq"), "yyyy-MM").alias("month"), (d(F.max_by) - d(F.min_by)).alias("pnl"))
    return x.groupBy("month").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").cast("double").alias("pnl"))


@query(_FSM + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, episode ORDER BY price DESC, seq) AS place FROM n WHERE long) SELECT entity_id, episode, seq AS best_seq, price AS best_price FROM r WHERE place = 1""")
def q_argmax_span(spark, sf):
    best = F.max_by(F.struct("seq", "price"), F.struct("price", -F.col("seq")))
    return _episodes(spark, sf).where("long").groupBy("entity_id", "episode").agg(best.alias("x")).select("entity_id", "episode", F.col("x.seq").alias("best_seq"), F.col("x.price").alias("best_price"))


@query(TICKS + f""", d AS (SELECT *, CASE label WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS decision FROM t), m AS (SELECT *, lead(decision) OVER {W} AS next, lead(seq) OVER {W} AS next_seq FROM d WHERE decision <> 'HOLD')
  SELECT decision || '-' || next AS pattern, count(*) AS n, CAST(sum(next_seq - seq - 1) AS BIGINT) AS holds FROM m WHERE decision <> next AND next_seq - seq >= 2 GROUP BY 1""")
def q_pattern(spark, sf):
    d = ticks(spark, sf).withColumn("decision", F.when(F.col("label") == "purchase", "BUY").when(F.col("label") == "error", "SELL")).where("decision is not null")
    d = d.withColumns({"next": F.lead("decision").over(along("entity_id")), "next_seq": F.lead("seq").over(along("entity_id"))}).where("decision != next and next_seq - seq >= 2")
    return d.groupBy(F.concat_ws("-", "decision", "next").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("next_seq") - F.col("seq") - 1).alias("holds"))


@query(TICKS + f""" SELECT entity_id, seq, round(a, 6) AS minus_1, price AS at_0, round(b, 6) AS plus_1, round(c, 6) AS plus_5, round(d, 6) AS plus_15 FROM (SELECT *, coalesce(lag(price) OVER {W}, price) AS a, lead(price) OVER {W} AS b, lead(price, 5) OVER {W} AS c, lead(price, 15) OVER {W} AS d FROM t) WHERE volume > 95 AND d IS NOT NULL""")
def q_event_response(spark, sf):
    t = ticks(spark, sf).withColumns({"a": F.lag("price").over(along("entity_id")), "b": F.lead("price").over(along("entity_id")), "c": F.lead("price", 5).over(along("entity_id")), "d": F.lead("price", 15).over(along("entity_id"))}).where("volume > 95 and d is not null")
    return t.select("entity_id", "seq", r6(F.coalesce("a", "price")).alias("minus_1"), F.col("price").alias("at_0"), r6("b").alias("plus_1"), r6("c").alias("plus_5"), r6("d").alias("plus_15"))


@query(TICKS + " SELECT label, seq, entity_id, price, rank, side FROM (" + " UNION ALL ".join(f"SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY price {d}, event_id) AS INTEGER) AS rank, '{n}' AS side FROM t" for n, d in (("TOP", "DESC"), ("BOTTOM", "ASC"))) + ") WHERE rank <= 10")
def q_top_k(spark, sf):
    """The ten dearest and the ten cheapest ticks of each label: each task keeps its own ten before they meet."""
    t, out = ticks(spark, sf), []
    for side, order in (("TOP", F.desc("price")), ("BOTTOM", F.asc("price"))):
        rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "event_id"))
        out.append(t.withColumn("rank", rank).where("rank <= 10").select("label", "seq", "entity_id", "price", "rank", F.lit(side).alias("side")))
    return out[0].unionByName(out[1])


@query(TICKS + """, r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY price) + (count(*) OVER (PARTITION BY label, price) - 1) / 2.0 AS a, rank() OVER (PARTITION BY label ORDER BY volume) + (count(*) OVER (PARTITION BY label, volume) - 1) / 2.0 AS b FROM t)
  SELECT label, round(corr(a, b), 6) AS spearman, round(corr(price, volume), 6) AS pearson, count(*) AS n FROM r GROUP BY 1""")
def q_spearman(spark, sf):
    t = ticks(spark, sf).select("label", "price", "volume")
    pairs = t.groupBy("label", "price", "volume").agg(F.count(F.lit(1)).alias("times"))  # ranks are joined to pairs of values, and these counted again
    ranked = pairs.join(average_ranks(t, ["label"], "price", "a"), ["label", "price"]).join(average_ranks(t, ["label"], "volume", "b"), ["label", "volume"])
    # Moments of pairs weighted by how often they occur, about the mean ranks and near the mean values, so that nothing is repeated.
    near = t.groupBy("label").agg(F.avg("price").alias("price_0"), F.avg("volume").alias("volume_0"), F.count(F.lit(1)).alias("n"))
    x = ranked.join(near, "label").withColumns({"a": F.col("a") - (F.col("n") + 1) / 2, "b": F.col("b") - (F.col("n") + 1) / 2, "price": F.col("price") - F.col("price_0"), "volume": F.col("volume") - F.col("volume_0")})

    def corr(u: str, v: str):
        total = lambda e: F.sum(F.col("times") * e)
        n, su, sv = F.sum("times"), total(F.col(u)), total(F.col(v))
        return (n * total(F.col(u) * F.col(v)) - su * sv) / F.sqrt((n * total(F.col(u) * F.col(u)) - su * su) * (n * total(F.col(v) * F.col(v)) - sv * sv))

    return x.groupBy("label").agg(r6(corr("a", "b")).alias("spearman"), r6(corr("price", "volume")).alias("pearson"), F.sum("times").alias("n"))


@query(TICKS + f""", r AS (SELECT *, list(label) OVER p AS before FROM t WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)) SELECT entity_id, seq, len(before) AS held, array_to_string(before, ',') AS context FROM r WHERE seq > 15""")
def q_context_audit(spark, sf):
    t = ticks(spark, sf).withColumn("before", prior(F.collect_list("label"), 15)).where("seq > 15")
    return t.select("entity_id", "seq", F.size("before").cast("long").alias("held"), F.array_join("before", ",").alias("context"))
