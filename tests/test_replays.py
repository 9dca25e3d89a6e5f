"""Folds that stop and go on, seals, the online model, censored concordance and label kernels, against plain Python."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from marea.operators import folds
from marea.operators import labels as L
from marea.operators.adaptive import ADAPTIVE_OUT, FEATURES, OUTPUTS, Settings, adaptive_step, basis_names, gradient_update
from marea.operators.folds import final_states, fold
from marea.operators.replay import SEAL_COLUMNS, manifest, resumed, seal_step, sealed
from marea.operators.survival import concordance, later_and_larger
from marea.streaming import stateful


class Replay:
    """The online model once more, one dict of weights per output and one running mean and variance per feature."""

    def __init__(self, c):
        self.c, self.w = c, {o: dict.fromkeys(basis_names(c), 0.0) for o in OUTPUTS}
        self.seen, self.stats, self.prev = [], {f: [] for f in FEATURES}, None
        self.v = self.d = 0.0
        self.h = [c.half_life, c.half_life]

    def step(self, t, price, volume):
        c, prev = self.c, self.prev
        dp = (price - prev[1]) / prev[1] if prev else 0.0
        v = dp / (t - prev[0]) if prev else 0.0
        acc = (v - self.v) / (t - prev[0]) if prev else 0.0
        near = self.seen[-20:]
        w = [2 ** (-(t - a) / 45) for a, _ in near]
        rv = volume / max(1e-9, sum(x * y for x, (_, y) in zip(w, near, strict=True)) / sum(w) if near else 1.0)
        self.seen.append((t, volume))
        last = self.seen[-200:]
        dens, vl = sum(x for _, x in last) / max(1e-6, last[-1][0] - last[0][0]), math.log(1 + rv)
        raw = dict(zip(FEATURES, (dp, v, acc, rv, vl, dens, vl if dp > 0 else -vl if dp < 0 else 0.0, vl * abs(dp), vl * dp), strict=True))
        z = {}
        for f, x in raw.items():
            old = self.stats[f]
            z[f] = max(-8, min(8, (x - np.mean(old)) / max(np.std(old, ddof=1), 1e-6))) if len(old) >= 12 else 0.0
            old.append(x)
        why = [abs(dp) >= 0.0025, abs(v) >= 0.0012, abs(acc) >= 0.001, rv >= 1.8, dens >= 2500]
        pm = 0.2 * sum(why)
        r = max(-1, min(1, (0.15 if self.d * np.sign(dp) > 0 else -0.15) + 0.2 * pm))
        for k, (p, q) in enumerate(((pm, r), (pm / 2, max(0, r)))):
            self.h[k] = min(300, max(5, self.h[k] * (1 - min(0.95, p) * 0.35) * (1 + min(q, 1) * 0.15 if q > 0 else 1)))
        x = {"bias": 1.0}
        for f in FEATURES:
            x[f], x[f + "^2"] = z[f], z[f] ** 2
        x |= {"volume_log_x_price_displacement": z["volume_log"] * z["price_displacement"], "relative_volume_x_price_velocity": z["relative_volume"] * z["price_velocity"]}
        x |= {"volume_density_x_price_displacement": z["volume_density"] * z["price_displacement"], "price_velocity_x_acceleration": z["price_velocity"] * z["price_acceleration"]}
        d = math.tanh(z["price_velocity"] / 0.005)
        s = min(1, 0.6 * abs(d) + 0.4 * min(1, z["volume_log"]))
        aim = dict(zip(OUTPUTS, (d, abs(z["price_displacement"]), s, self.h[0] / 300, *self.h, r, max(0, min(1, 1 - s + pm / 4)), max(0, min(1, pm / 2 + 0.3 * max(-d * self.d, 0))), pm), strict=True))
        out = {}
        for o, w in self.w.items():
            told = sum(w[k] * x[k] for k in x)
            out[o] = (told + aim[o]) / 2
            if len(self.seen) >= 12:
                for k in x:
                    w[k] = max(-5, min(5, w[k] - 0.03 * (-(aim[o] - told) * x[k] + 0.0005 * w[k])))
        out["strength"], out["uncertainty"], out["magnitude_state"], out["direction_state"] = max(0, min(1, out["strength"])), max(0, min(1, out["uncertainty"])), abs(out["magnitude_state"]), max(-1, min(1, out["direction_state"]))
        if rv > 2 and abs(dp) < 0.0005:
            out["strength"] = min(out["strength"], 0.65)
        out["reversal_tendency"] = max(0, min(1, (0.2 if -out["direction_state"] * self.d > 0 else 0.05) + 0.7 * pm))
        self.prev, self.v, self.d = (t, price), v, out["direction_state"]
        return out


def walk(n, seed):
    r = random.Random(seed)
    t, p, out = 0.0, 100.0, []
    for _ in range(n):
        t, p = t + r.choice([1.0, 2.0, 60.0]), p * (1 + r.gauss(0, 0.002))
        out.append((t, p, float(r.choice([0, 10, 50, 5000]))))
    return out


def test_adaptive_model_is_its_replay():
    for seed in range(3):
        model, state = Replay(Settings()), {}
        for k, (t, p, v) in enumerate(walk(260, seed)):
            state, got = adaptive_step(state, {"t": t, "price": p, "volume": v})
            want = model.step(t, p, v)
            assert all(abs(got[o] - want[o]) < 1e-7 * (1 + abs(want[o])) for o in OUTPUTS), k
            assert got["learning"] == (k >= 11)
    assert adaptive_step(state, {"t": None, "price": 1.0, "volume": 1.0})[0] is state
    with pytest.raises(ValueError, match="not after"):
        adaptive_step(state, {"t": t, "price": 1.0, "volume": 1.0})


def test_gradient_update_of_a_matrix():
    w, e, hit = gradient_update(np.array([[0.0, 0.4], [0.5, 0.5]]), np.array([1.0, 2.0]), np.array([1.0, 99.0]), 0.1, 0.01, 0.5)
    assert np.allclose(e, [0.2, 97.5]) and np.allclose(w, [[0.02, 0.4396], [0.5, 0.5]]) and hit.tolist() == [False, True]
    assert len(basis_names(Settings(order=3, interaction_order=2))) == 1 + 27 + 8 and len(basis_names(Settings(interactions=()))) == 19


def test_fold_goes_on_from_states(spark):
    rows = [(e, s, t, p, v) for e in range(4) for s, (t, p, v) in enumerate(walk(30 + 10 * e, e))]
    df = spark.createDataFrame(rows, "entity_id long, seq long, t double, price double, volume double")
    whole = sorted(map(str, fold(df, adaptive_step, ["t", "price", "volume"], ADAPTIVE_OUT).collect()))
    parts = [df.where("seq < 10"), df.where("seq >= 10 AND seq < 33 AND entity_id <> 2"), df.where("seq >= 33 OR seq >= 10 AND entity_id = 2")]
    assert sorted(map(str, resumed(parts, adaptive_step, ["t", "price", "volume"], ADAPTIVE_OUT).collect())) == whole
    states = final_states(parts[0], adaptive_step, ["t", "price", "volume"])
    assert {(r.entity_id, r.seq) for r in states.collect()} == {(e, 9) for e in range(4)}
    with pytest.raises(Exception, match="out of order"):
        fold(parts[0], adaptive_step, ["t", "price", "volume"], ADAPTIVE_OUT, restored=states).collect()


def test_seals_of_a_stream_that_stops(spark, tmp_path):
    rows = [(e, s, f'{{"x":{s * e}}}', f"{s}") for e in range(3) for s in range(1, 41)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, record string, reduced string")
    batch = {(r.entity_id, r.seq): (r.accepted, r.logical, r.semantic) for r in sealed(df).collect()}
    for part in (df.where("seq <= 17"), df.where("seq > 17")):  # the second run starts from the first one's checkpoint
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = stateful.stream_fold(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), seal_step, ["record", "reduced"], SEAL_COLUMNS)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(180)
    got = {(r.entity_id, r.seq): (r.accepted, r.logical, r.semantic) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == batch
    want = ""
    for s in range(1, 41):
        want = hashlib.sha256((want + f'{{"x":{s * 2}}}').encode()).hexdigest()
    assert batch[2, 40][1] == want
    told = manifest(sealed(df), 16).collect()
    assert {(r.accepted, r.complete) for r in told} == {(16, False), (32, False), (40, True)} and all(batch[r.entity_id, r.seq][1] == r.prefix for r in told)


def test_concordance_is_brute_force(spark):
    r, rows = random.Random(1), []
    for key, n in (("a", 5000), ("b", 60), ("c", 1)):
        for _ in range(n):
            low, kind = float(r.choice([1, 1, 1, 2, r.randrange(1, 300)])), r.choice(["EXACT", "EXACT", "INTERVAL", "RIGHT"])
            rows.append((key, r.choice([r.random(), 0.5]), kind, low, low + r.randrange(0, 5) if kind == "INTERVAL" else None))
    rows += [("d", None, "EXACT", 1.0, None), ("e", 1.0, "RIGHT", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, kind string, lower double, upper double")
    got = {x.k: (x.pairs, x.score, x.concordance) for x in concordance(df, "k", "x", "kind", "lower", "upper").collect()}
    for key in "ab":
        own = [x for x in rows if x[0] == key]
        p, low = np.array([x[1] for x in own]), np.array([x[3] for x in own])
        pairs = score = 0.0
        for x in own:
            if x[2] != "RIGHT":
                later = low > (x[3] if x[2] == "EXACT" else x[4])
                pairs, score = pairs + later.sum(), score + (p[later] > x[1]).sum() + 0.5 * (p[later] == x[1]).sum()
        exact = [x[3] for x in own if x[2] == "EXACT"]
        ties = sum(c * (c - 1) // 2 for c in (exact.count(x) for x in set(exact)))
        assert got[key] == (pairs + ties, score + ties / 2, (score + ties / 2) / (pairs + ties))
    assert set(got) == {"a", "b"} | {x[0] for x in rows if x[2] == "EXACT" and x[1] is not None} and later_and_larger(*(np.array([], float),) * 2, *(np.array([], int),) * 2) == 0


def test_first_reversals_are_brute_force():
    g = np.random.default_rng(1)
    for _ in range(40):
        n, k = int(g.integers(1, 150)), 30
        h, y = np.cumsum(g.random(n)), np.cumsum(g.normal(size=n)) / 10
        own = g.integers(0, n, 15)
        h0, y0 = np.r_[h[own], h[0] - g.random(15)], np.r_[y[own], g.normal(size=15)]
        begun, held, claim = np.r_[own + 1, np.zeros(15, int)], np.r_[np.zeros(15), g.normal(size=15)], g.choice([-1.0, 1.0], k)
        at, sums = L.first_reversals(h, y, claim, h0, y0, begun, held)
        for i in range(k):
            s, found = held[i], n
            for j in range(begun[i], n):
                s += (h[j] - h0[i]) * (y[j] - y0[i])
                if claim[i] * (y[j] - y0[i]) < 0 and claim[i] * s < 0:
                    found = j
                    break
            assert at[i] == found and (found < n or abs(s - sums[i]) < 1e-8)


def test_path_moments_are_brute_force():
    g = np.random.default_rng(2)
    h, y = np.cumsum(g.random(600) + 1e-3), np.cumsum(g.normal(size=600)) / 10
    start = np.sort(g.integers(0, 599, 80))
    end, claim = np.minimum(599, start + g.integers(1, 500, 80)), g.choice([-1.0, 1.0], 80)
    got = L.path_moments(h, y, claim, start, end)
    for i, (a, z) in enumerate(zip(start, end, strict=True)):
        x, d = h[a + 1 : z + 1] - h[a], y[a + 1 : z + 1] - y[a]
        q = x * x / 2
        want = {"xy": (x * d).sum(), "xx": (x * x).sum(), "xq": (x * q).sum(), "qq": (q * q).sum(), "qy": (q * d).sum(), "yy": (d * d).sum(), "length": np.abs(np.diff(y[a : z + 1])).sum(), "best": (claim[i] * d).max()}
        assert all(abs(got[k][i] - v) < 1e-8 * (1 + abs(v)) for k, v in want.items())


def test_validity_over_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(e, s, r.choice([-1, 0, 1]), s / 10.0, r.gauss(0, 1) / 10 + (s % 97) / 50, r.random() < 0.1) for e in range(2) for s in range(9000)]
    a = spark.createDataFrame(rows, "entity_id long, seq long, claim int, h double, y double, gap boolean")
    got = {(x.entity_id, x.seq): (x.kind, x.lower, x.upper) for x in L.validity(a.selectExpr("entity_id", "seq", "claim", "CAST(h AS DECIMAL(12,4)) AS h", "y", "gap")).collect()}
    assert len(got) == len(rows)
    for k in r.sample(range(len(rows)), 300):
        e, s, claim, h, y, _ = rows[k]
        want, total, before = ("RIGHT", None, None), 0.0, 0.0
        for _, s2, _, h2, y2, gap in rows[k + 1 : 9000 * (e + 1)] if claim else ():
            total += (h2 - h) * (y2 - y)
            if claim * (y2 - y) < 0 and claim * total < 0:
                want = ("INTERVAL", before, h2 - h) if gap else ("EXACT", h2 - h, h2 - h)
                break
            before = h2 - h
        want = ("INCONCLUSIVE", 0.0, None) if not claim else want if want[0] != "RIGHT" else ("RIGHT", before, None)
        assert got[e, s][0] == want[0] and all((x is None) == (w is None) and (x is None or abs(x - w) < 1e-9) for x, w in zip(got[e, s][1:], want[1:], strict=True))


@pytest.mark.parametrize("at_once", [16, 400, 100_000])
def test_resumed_many_entities_at_once(monkeypatch, at_once):
    """Restored entities take their rows together too, with the rows, states and errors of one row after the other; entities without rows, without a key or without a valid row included."""
    from marea.operators import models as M

    r = np.random.default_rng(8)
    columns, names = ["t", "price", "volume", "quality"], [c.split()[0] for c in M.STATE_COLUMNS.split(", ")]
    out = dict(c.split() for c in M.STATE_COLUMNS.split(", "))
    rows = pd.DataFrame({"entity_id": np.repeat(np.arange(120.0), 20), "seq": np.tile(np.arange(20), 120), "t": np.tile(np.arange(20) * 2.5, 120), "price": r.choice([0.0, 250.0, 1e-9, 1e308, np.nan], 2400), "volume": r.choice([0.0, 70.0, np.nan], 2400, p=[0.3, 0.65, 0.05]), "quality": r.choice([0.4, 1.0, np.nan], 2400)})
    rows.loc[rows["entity_id"] == 5, "price"] = np.nan
    rows = pd.concat([rows.iloc[:60].assign(entity_id=np.nan), rows], ignore_index=True)
    parts = [rows[rows["seq"] < 9], rows[(rows["seq"] >= 9) & (rows["entity_id"] != 7) & (rows["seq"] < 15)], rows[rows["seq"] >= 15]]
    singles = []

    def counted(state, row):
        singles.append(1)
        return M.state_step(state, row)

    def ran(many):
        states, told = None, []
        for n, part in enumerate(parts):
            x = part if n == 0 else pd.concat([part.assign(__state=None), states.rename(columns={"state": "__state"})]).sort_values(["entity_id", "__state", "seq"], na_position="last")
            fed = lambda x=x: (x.iloc[a : a + 57] for a in range(0, len(x), 57))
            of = lambda o, n=n: folds._together(counted, M.STATES, columns, [], o, "entity_id", "seq", n > 0) if many else folds._folder(M.state_step, columns, [], o and names, "entity_id", "seq", n > 0)
            made = pd.concat([*of(out)(fed())], ignore_index=True)
            told.append([tuple(None if pd.isna(v) else v for v in row) for row in made[["entity_id", "seq", *names]].itertuples(index=False)])
            states = pd.concat([*of(None)(fed())], ignore_index=True)
            told.append(sorted(states.astype(str).itertuples(index=False, name=None)))
        return told, x

    monkeypatch.setattr(folds, "AT_ONCE", at_once)
    (alone, _), (together, x) = ran(False), ran(True)
    assert alone == together and len(together[1]) == 120 + 27 and any(s == "{}" for _, _, s in together[1])
    assert at_once < 1_000 or len(singles) < 200
    late = x[x["entity_id"] == 3].assign(seq=lambda d: d["seq"].where(d["__state"].isna(), d["seq"][d["__state"].isna()].min()))
    with pytest.raises(ValueError, match="out of order"):
        list(folds._together(M.state_step, M.STATES, columns, [], out, "entity_id", "seq", True)(iter([late])))


def test_state_resumed_is_the_state_model(spark, tmp_path):
    """q_state_resumed steps its parts many entities at once and has the rows of the state model over everything."""
    from marea.plans.models import q_state_model
    from marea.plans.replays import q_state_resumed

    r = random.Random(3)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(90_000)), r.choice([None, *range(1, 30)]), r.choice(["view", "error"]), r.choice([None, 0.0, r.uniform(-5, 400)]), f'{{"k": {r.randrange(90)}}}') for k in range(1_500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    resumed_, whole = (q(spark, str(tmp_path)) for q in (q_state_resumed, q_state_model))
    known = "entity_id IS NOT NULL"
    assert sorted(map(str, resumed_.where(known).collect())) == sorted(map(str, whole.where(known).collect())) and resumed_.count() == 1_500


def test_manifest_of_odd_seals(spark):
    """Checkpoints of seals in any order, of entities or rows that are missing or come twice, are those of a join with each entity's last row."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(r.choice([None, *range(9)]), r.choice([None, *range(60)]), r.choice([None, *range(1, 90)]), r.choice("abc"), r.choice(["d", None])) for _ in range(900)]
    rows += sorted(((e, s, s, f"{s}", "x") for e in range(9, 40) for s in range(1, r.randrange(2, 70))), key=lambda x: (x[0] % 3, x))
    df = spark.createDataFrame(rows, f"entity_id long, seq long, {SEAL_COLUMNS}")
    last = df.groupBy("entity_id").agg(F.max("seq").alias("seq")).withColumn("complete", F.lit(True))
    told = df.join(last, ["entity_id", "seq"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    for every in (1, 7, 25):
        wanted = told.where((F.col("accepted") % every == 0) | F.col("complete")).select("entity_id", "seq", "accepted", F.col("logical").alias("prefix"), "semantic", "complete")
        got = manifest(df.repartition(3), every)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.columns == wanted.columns
    assert manifest(df.limit(0), 7).count() == 0


def test_manifest_shuffles_what_may_be_a_checkpoint(spark, tmp_path):
    """q_replay_manifest deals ticks once and then only checkpoints: no texts of rows, no seals to join."""
    import pyarrow as pa

    from marea.operators.replay import _candidates
    from marea.plans.replays import q_replay_manifest

    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=k), k % 3, "view", 1.0 * k, '{"k": 1}') for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    made = q_replay_manifest(spark, str(tmp_path))
    assert sorted((x.entity_id, x.accepted, x.complete) for x in made.collect()) == [(e, k, k == 100) for e in range(3) for k in (25, 50, 75, 100)]
    plan = made._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2] or made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and plan.count("MapInPandas") == 2
    batch = pa.RecordBatch.from_pydict({"entity_id": [1] * 50 + [2] * 30 + [None, None], "seq": [*range(50), *range(30), 1, 2], "due": [k % 25 == 24 for k in range(50)] + [False] * 32})
    assert [x.num_rows for x in _candidates(iter([batch, batch.slice(0, 0)]))] == [2 + 1 + 2, 0]
