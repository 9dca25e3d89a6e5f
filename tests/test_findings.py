"""What reviews found, each case as it failed: prices of 0, and steps that must stay equal to their plain forms."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from marea.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """A folder with events of two entities, whose prices are 0 alone, after one another, first and last."""
    prices = {1: [0.0, 3.5, 0.0, 0.0, 7.25, 1.0] * 5 + [0.0], 2: [2.0, 0.0, 4.0] * 7, 3: [-2.0, 0.0, -0.0, 5.0] * 6}
    rows = [(10 * e + 1000 * k, datetime(2024, 1, 1 + k, 9, 30), e, ("view", "error", "purchase")[k % 3], x, f'{{"k": {k}}}') for e, own in prices.items() for k, x in enumerate(own[:31])]
    rows += [(r[0] + 1, r[1] + timedelta(hours=3), *r[2:4], r[4] / 2, r[5]) for r in rows[::2]]
    folder = tmp_path_factory.mktemp("zeros")
    c = duckdb.connect()
    c.execute("CREATE TABLE events(event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), c


def as_sql(spark, folder, duck, name):
    """Spark's and SQL's rows of a query, told alike."""
    told = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v + 0.0 if isinstance(v, float) else v)
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    wanted = duck.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(map(told, r)) for r in got.select(*names).collect()), sorted(tuple(map(told, r)) for r in wanted)


def test_bar_features_of_zero_prices(spark, zeros):
    got, wanted = as_sql(spark, *zeros, "q_bar_features")
    assert got == wanted and any("inf" in r for r in got) and any("nan" in r for r in got)


def test_forward_returns_of_zero_prices(spark, zeros):
    got, wanted = as_sql(spark, *zeros, "q_forward_returns")
    assert got == wanted and any("inf" in r for r in got) and any("nan" in r for r in got)


def test_multi_horizon_of_zero_prices(spark, zeros):
    got, wanted = as_sql(spark, *zeros, "q_multi_horizon")
    assert got == wanted and any("inf" in r for r in got)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events whose ids don't rise with time, some without a price, an id or both, and prices at the ends of what doubles hold."""
    r = random.Random(4)
    prices = [0.0, 1e-310, 1e-305, 1e300, 1.7e308, math.inf, math.nan, None]
    rows = []
    for k in range(1_500):
        at = datetime(2024, 1, 1) + timedelta(seconds=r.randrange(25 * 86_400))
        rows.append((k * 7_919 % 1_500, at, r.randrange(20), "view", r.choice(prices) if r.random() < 0.15 else r.randrange(1, 50_000) / 100, f'{{"k": {k}}}'))
    for k in range(0, 1_500, 50):  # without an id, at the time of another tick of its entity
        rows.append((None, *rows[k][1:3], "view", 2.5, '{"k": 1}'))
    for day in range(1, 26):  # an entity whose days have no price for weeks
        rows.append((2_000 + day, datetime(2024, 1, day), 50, "view", None if 3 < day < 22 else 4.0 + day, '{"k": 1}'))
    folder = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("CREATE TABLE events(event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), c


@pytest.mark.parametrize("name", ["q_bar_features", "q_forward_returns", "q_multi_horizon"])
def test_odd_ids_and_prices(spark, odd, name):
    got, wanted = as_sql(spark, *odd, name)
    assert got == wanted and len(got) > 400


def test_ties_as_sql_rounds_them(spark):
    from marea.functions import scalars as S

    rows = [(8.0046875,), (-0.5103125,), (0.9303125,), (5e-07,), (2.5,), (float("inf"),), (-1234.56789,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(S.rounded("x", 6)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", r).fetchall()[0][0] for r in rows]


@pytest.fixture(scope="module")
def close(tmp_path_factory):
    """Events of 300 entities: one tick, and two within a second of each other about a day later; one entity has 3,000 ticks."""
    r = random.Random(3)
    rows = []
    for e in range(300):
        at = datetime(2024, 1, 1, microsecond=r.randrange(10**6)) + timedelta(seconds=r.randrange(10**6))
        gap = timedelta(hours=24) - timedelta(microseconds=r.randrange(1, 500_000))
        times = [at, at + gap, at + gap + timedelta(microseconds=r.randrange(500_000, 1_000_000)), at + timedelta(hours=80)]
        rows += [(4 * e + k, t, e, "view", r.randrange(1, 50_000) / 100, f'{{"k": {k}}}') for k, t in enumerate(times)]
    rows += [(10_000 + k, datetime(2024, 1, 1) + timedelta(seconds=977 * k), 7_000, "view", r.randrange(1, 50_000) / 100, '{"k": 1}') for k in range(3_000)]
    folder = tmp_path_factory.mktemp("close")
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    c.register("frame", frame)
    c.execute("CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM frame")
    c.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), c


def test_horizons_of_close_ticks(spark, close):
    """Fits through ticks a second apart tell the last bit of times, logarithms and sums."""
    got, wanted = as_sql(spark, *close, "q_time_horizons")
    few = lambda rows: [r for r in rows if "7000" not in r[:5]]
    assert len(few(got)) > 500 and few(got) == few(wanted) and len(got) == len(wanted)


def test_validity_of_short_and_long_entities(spark, close):
    got, wanted = as_sql(spark, *close, "q_validity_duration")
    assert got == wanted and len(got) == 4_200


def test_no_sketch_for_each_pair(spark):
    """The exact count's pairs go through the shuffle without sketches of the estimate."""
    plan = QUERIES["q_approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_approx_count_distinct") == 1 and "distinct l_orderkey" not in plan


def test_seal_hands_on_states_alone(spark):
    """No join of each row's seal: what is shuffled after the folds is one state an entity."""
    plan = QUERIES["q_replay_seal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 6


@pytest.mark.parametrize("name", ["q_law_families", "q_rk_tolerances"])
def test_one_pass_fits_all_laws(spark, name):
    """All families, windows and tolerances come from one pass over the rows, without joins."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1


def test_adaptive_horizons_of_zero_prices(spark, zeros):
    got, wanted = as_sql(spark, *zeros, "q_adaptive_horizons")
    assert got == wanted and len(got) > 100


def test_adaptive_horizons_need_no_join(spark):
    """Anchors go through the model's fold, so no table of all states is joined or broadcast."""
    plan = QUERIES["q_adaptive_horizons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInPandas") == 2


def test_columns_are_rounded_to_the_same_bits(spark):
    from pyspark.sql import functions as F

    from marea.functions import scalars as S

    r = random.Random(8)
    odd = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 2.0**52 + 1, -(2.0**53), 1e300, 1.7e308, math.inf, -math.inf, math.nan, None]
    rows = [(x,) for x in odd + [r.gauss(0, 10.0 ** r.randrange(-8, 14)) for _ in range(2_000)] + [r.randrange(-4_000, 4_000) / 2 / 10**6 for _ in range(500)]]
    for digits in (0, 3, 6):
        got = spark.createDataFrame(rows, "x double").select(S.rounded("x", digits).alias("a"), S.rounded(F.col("x"), digits).alias("b")).collect()
        assert [repr(x.a) for x in got] == [repr(x.b) for x in got]


@pytest.mark.parametrize("at_once", [32_768, 700, 1])
def test_entities_step_together_as_alone(monkeypatch, at_once):
    """The state model of many entities at once has the bits of one row after another, missing and odd values included."""
    import numpy as np

    from marea.operators import folds
    from marea.operators import models as M

    r = np.random.default_rng(3)
    sizes = np.r_[900, r.integers(1, 40, 150)]
    n = int(sizes.sum())
    x = pd.DataFrame({"entity_id": np.repeat(np.arange(len(sizes)), sizes), "seq": np.arange(n), "t": np.cumsum(r.choice([0.0, 0.25, 3.0, 4_000.0], n)), "price": r.choice([0.0, 3.5, 250.0, 1e-9, 1e308, -1e308, np.inf, np.nan], n, p=[0.1, 0.3, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05]), "volume": r.choice([0.0, 1.0, 70.0, np.nan], n, p=[0.3, 0.3, 0.35, 0.05]), "quality": r.choice([0.4, 1.0, -3.0, np.nan], n)})
    columns, out = ["t", "price", "volume", "quality"], dict(c.split() for c in M.STATE_COLUMNS.split(", "))
    alike = lambda made: pd.concat(list(made), ignore_index=True).astype({c: "float64" for c, kind in out.items() if kind == "double"})
    alone = alike(folds._folder(M.state_step, columns, [], list(out), "entity_id", "seq", False)(x.iloc[a : a + 333] for a in range(0, n, 333)))
    monkeypatch.setattr(folds, "AT_ONCE", at_once)
    together = alike(folds._together(M.state_step, M.STATES, columns, [], out, "entity_id", "seq")(x.iloc[a : a + 333] for a in range(0, n, 333)))
    assert set(alone["perturbation_class"].dropna()) == set(M.KINDS) and alone["health"].nunique() >= 3
    for c, kind in {"entity_id": "long", "seq": "long", **out}.items():
        a, b = alone[c], together[c]
        assert (a.isna() == b.isna()).all() and a.dropna().tolist() == b.dropna().tolist()
        assert kind != "double" or (np.signbit(a.dropna()) == np.signbit(b.dropna())).all()
    with pytest.raises(ValueError, match="out of order"):
        list(folds._together(M.state_step, M.STATES, columns, [], out, "entity_id", "seq")(iter([x.iloc[[0, 2, 1]]])))


def censored_rows(n):
    """Blocks, durations and two predictors with ties, shared values, gaps and missing ones."""
    r = random.Random(9)
    rows = []
    for _ in range(n):
        low = r.choice([0.0, 24.0, r.randrange(40) / 2, r.uniform(0, 60)])
        kind = r.choice(["EXACT", "EXACT", "INTERVAL", "RIGHT"])
        rows.append((r.randrange(5), kind, None if r.random() < 0.02 else low, low + r.choice([0.5, 7.0]) if kind == "INTERVAL" else None, r.choice([120.0, 900.0, -0.0, 0.0, None, r.uniform(0, 900)]), r.gauss(0, 1)))
    return rows


def test_concordances_as_one_by_one(spark):
    """All predictors and blocks at once have the pairs and scores of each alone."""
    from pyspark.sql import functions as F

    from marea.operators.survival import concordance, concordances

    df = spark.createDataFrame(censored_rows(3_000), "block long, kind string, lower double, upper double, p double, q double").persist()
    whole, own = concordances(df, ["p", "q"], "block", "kind", "lower", "upper")
    got = {(x.predictor, None): (x.pairs, x.score) for x in whole.collect()} | {(x.predictor, x.block): (x.pairs, x.score) for x in own.collect()}
    wanted = {}
    for name in ("p", "q"):
        for key in (F.lit("all"), F.col("block").cast("string")):
            for x in concordance(df.withColumn("key", key), "key", name, "kind", "lower", "upper").collect():
                wanted[name, None if x.key == "all" else int(x.key)] = (x.pairs, x.score)
    assert got == wanted and len(got) == 12


def test_ranks_of_shared_values(spark):
    """Sums of ranks by block are those of all records, values that many share included."""
    import numpy as np

    from pyspark.sql import functions as F

    from marea.operators import scorecard

    r = random.Random(6)
    rows = [(r.randrange(4), r.choice([0.0, -0.0, 1.0, r.gauss(0, 1)]), r.choice([1.0, float(r.randrange(30)), math.nan])) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "block long, x double, y double").persist()
    got = {x.block: (x.n, x.a, x.b, x.aa, x.bb, x.ab) for x in scorecard.ordinal(df, {"d": (F.col("x"), F.col("y"))}, "block", buckets=16).collect()}
    kept = pd.DataFrame([x for x in rows if x[2] == x[2]], columns=["block", "x", "y"])
    a, b = (kept[k] + 0.0 for k in "xy")
    a, b = a.rank(), b.rank()
    wanted = pd.DataFrame({"n": 1.0, "a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}).groupby(kept["block"]).sum()
    assert len(got) == 4 and all(np.allclose(got[k], v, rtol=1e-12) for k, v in zip(wanted.index, wanted.to_numpy(), strict=True))


def test_labels_hand_on_columns(spark):
    """Paths and durations in the order of the rows carry each row's columns, of long and short entities; whole keeps rows without an end."""
    from pyspark.sql import functions as F

    from marea.operators import labels as L

    t = spark.range(46_000).select(F.when(F.col("id") < 40_000, 1).otherwise(F.col("id") % 300).cast("long").alias("entity_id"), F.col("id").alias("seq"), (F.col("id") / 10).alias("h"), F.sin("id").alias("y"), (F.pmod("id", F.lit(3)) - 1).cast("double").alias("claim"), F.lit(False).alias("gap"), (F.col("id") * 2).alias("z"))
    t = t.repartition(1).sortWithinPartitions("entity_id", "seq")
    keys = lambda df: sorted(map(tuple, df.select("entity_id", "seq", *[c for c in ("n", "slope", "kind", "lower", "upper") if c in df.columns]).collect()), key=str)
    p = L.time_horizons(t, (24,), in_order=True, carry=("h", "y", "claim", "gap", "z"), whole=True)
    d = L.validity(p, in_order=True, carry=("z", "n"))
    assert d.where("z = 2 * seq").select("entity_id", "seq").distinct().count() == d.count() == 46_000
    assert keys(p.where("n IS NOT NULL")) == keys(L.time_horizons(t, (24,))) and keys(d.drop("n")) == keys(L.validity(t))


def test_dimensions_shuffle_ticks_once(spark):
    """States, paths and durations follow one another in the order of one shuffle by entity, without joins of rows."""
    import re

    for name in ("q_dimension_effects", "q_dimension_evidence"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        once = set(re.findall(r"Exchange hashpartitioning\((?:entity_id|user_id)#.*plan_id=(\d+)", plan))  # as planned and as run
        assert 1 <= len(once) <= 2 and not re.search(r"Join \[entity_id", plan)


def test_grid_has_the_bits_of_round(spark):
    """Doubles come onto the grid by arithmetic, not by a decimal of each, with the same bits: halves, signed zeros, what is missing or out of range included."""
    import struct

    from pyspark.sql import functions as F

    from marea.plans.models import grid, q20

    r = random.Random(11)
    near = [0.0, 0.5, 1.0, 1.5, 2.5, 3.5, 0.49999999999999994, 1 / 3, 4503599627370495.5, 4503599627370496.0, 4503599627370497.0, 9007199254740993.0, 2.0**63, 1e300, 1.7976931348623157e308, 5e-324, math.inf]
    some = [s * x / d for x in near for s in (1, -1) for d in (1, 1048576)] + [math.nextafter((r.randrange(99) + 0.5) / 1048576, r.choice([-9, 9])) for _ in range(99)] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(2_000)] + [math.nan, None]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    bits = lambda x: x if x is None else "nan" if math.isnan(x) else struct.pack("<d", x)
    got = df.select("x", (F.round(F.col("x") * 1048576.0) / 1048576.0).alias("wanted"), q20("x").alias("got")).collect()
    assert all(bits(x.got) == bits(x.wanted) for x in got) and len(got) == len(some)
    assert "round(" not in grid(df)._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_made_once(spark):
    """Times and decays of projected samples are worked out once, with the bits of the formula written out; samples aren't made again to look for empty ones."""
    from pyspark.sql import functions as F

    from marea.functions import scalars as S
    from marea.plans.models import shapes

    r = random.Random(12)
    names = ["level", "velocity", "acceleration", "strength", "persistence", "uncertainty", "reversal", "interval", "half_life", "coherence"]
    rows = [(k, *[r.choice([r.uniform(-3, 3), r.uniform(0, 1), 1e200, -0.0, None]) for _ in names[:7]], r.uniform(10, 600), r.uniform(15, 900), 0.5) for k in range(300)] + [(300, *[None] * 10)]
    df = spark.createDataFrame(rows, ", ".join(["seq long", *(f"{n} double" for n in names)]))
    c, part = F.col, lambda t: F.pow(F.lit(2.0), -t / F.col("half_life"))
    tau = lambda i: c("interval") * F.pow(i / F.lit(8.0), F.lit(1.8))
    plain = lambda i, t: F.struct(t.alias("tau"), (c("level") + c("velocity") * t + c("acceleration") * t * t / 2).alias("level"), (c("velocity") * part(t)).alias("velocity"), *[S.clamp(c(n) + (1 - part(t)) * g, 0.0, 1.0).alias(n) if g else S.clamp(c(n) * part(t), 0.0, 1.0).alias(n) for n, g in (("uncertainty", 0.15), ("strength", 0), ("persistence", 0), ("reversal", 0.1))])
    wanted = df.select("seq", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: plain(i, tau(i)))).alias("k", "s")).collect()
    made = shapes(df).select("seq", F.posexplode_outer("samples").alias("k", "s"))
    assert sorted(map(str, made.collect())) == sorted(map(str, wanted)) and len(wanted) == 8 * 301
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("POWER(") == 1 and "Filter" not in plan


def test_forward_samples_do_not_filter_by_samples(spark, zeros):
    assert "size(" not in QUERIES["q_forward_samples"](spark, zeros[0])._jdf.queryExecution().optimizedPlan().toString()
