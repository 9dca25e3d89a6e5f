"""Exact quantiles, folds, designs, dynamics, sources and streams against plain computations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marea.functions import scalars as S
from marea.operators import designs, dynamics, exact, folds, labels
from marea.operators import models as M
from marea.sources import ticks as T
from marea.streaming import stateful


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_quantiles_and_ranks(spark, buckets):
    r = random.Random(buckets)
    rows = [(k, r.choice([1.5, 2.0, r.random() * 10, None])) for k in (1, 2, None) for _ in range(r.randint(40, 90))] + [(7, 3.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(3)
    at = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {x.k: x for x in exact.quantiles(df, ["k"], "x", at, buckets).collect()}
    groups = {k: [x for q, x in rows if q == k and x is not None] for k in {q for q, _ in rows}}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, row in got.items():
        assert [round(row[n], 9) for n in at] == [round(float(np.quantile(groups[k], p)), 9) for p in at.values()]
    whole = exact.quantiles(df, [], "x", at, buckets).first()
    assert round(whole.c, 9) == round(float(np.median([x for v in groups.values() for x in v])), 9)
    ranks = {(x.k, x.x): x.rank for x in exact.average_ranks(df.where("k is not null"), ["k"], "x", "rank", buckets).collect()}
    for k in (1, 2, 7):
        for v in groups[k]:
            less, same = sum(x < v for x in groups[k]), groups[k].count(v)
            assert ranks[k, v] == less + (same + 1) / 2
    assert exact.quantiles(df.limit(0), ["k"], "x", at).count() == 0


def test_linear_fold(spark):
    r = random.Random(2)
    rows = [(e, s, None if r.random() < 0.1 else r.uniform(-5, 5), r.random() < 0.05) for e in range(4) for s in range(1, 400)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, x double, off boolean").repartition(5)
    for rate, start in ((0.05, None), (0.5, 0.0)):
        got = {(x.entity_id, x.seq): x.m for x in folds.linear_fold(df, "x", "m", rate, start, "off").collect()}
        held = {}
        for e, s, x, off in rows:
            m = held.get(e, start)
            m = 0.0 if off else m if x is None else x if m is None else (1 - rate) * m + rate * x
            held[e] = m
            assert got[e, s] is None or np.isnan(got[e, s]) if m is None else abs(got[e, s] - m) < 1e-9


def test_fold_minds_the_order(spark):
    df = spark.createDataFrame([(1, 2, 0.1), (1, 1, 0.2)], "entity_id long, seq long, score double").coalesce(1)
    with pytest.raises(Exception, match="out of order"):
        folds.fold(df, folds.hysteresis_step, ["score"], "gate string", in_order=True).collect()
    assert folds.fold(df, folds.hysteresis_step, ["score"], "gate string").count() == 2


def test_design_report(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3))
    full = np.column_stack([np.ones(300), x, x[:, 0] + 2 * x[:, 1], np.zeros(300)])
    names = [f"c{k}" for k in range(6)]
    df = spark.createDataFrame([("g", *map(float, row)) for row in full], "k string, " + ", ".join(f"{n} double" for n in names))
    got = designs.report(df, names, "k").first()
    assert got.matrix_rank == np.linalg.matrix_rank(full) == 4 and got.retained == "c0;c1;c2;c3" and got.excluded == "c4;c5" and got.depends == {"c4": "c2", "c5": ""}
    assert abs(got.largest - np.linalg.svd(full, compute_uv=False)[0]) < 1e-6 and got.condition < 10
    classes = spark.createDataFrame([(1.0,), (1e5,), (1e9,), (1e13,), (float("inf"),), (None,)], "c double").select(S.condition_class(F.col("c")).alias("x"))
    assert [x.x.split()[0] for x in classes.collect()] == ["WELL", "MODERATELY", "POORLY", "SEVERELY", "SINGULAR", "SINGULAR"]


def test_integration_and_exits():
    a = np.array([[0.0, 1.0], [-1.0, -0.1]])
    start = np.array([[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]])
    law = lambda x: x @ a.T
    made = dynamics.integrate(law, start, 1.0, lambda x: np.abs(x).max(1) < 5)
    wanted = dynamics.expm(a[None])[0] @ start[:2].T
    assert np.allclose(made["end"][:2], wanted.T, atol=1e-5) and np.isnan(made["exit"][:2]).all() and made["exit"][2] == 0
    grows = dynamics.integrate(lambda x: x, np.array([[1.0]]), 3.0, lambda x: x[:, 0] < np.e)
    assert abs(grows["exit"][0] - 1.0) < 1e-3 and np.isnan(grows["path"][0, -1, 0]) and grows["end"][0, 0] < np.e
    errors = dynamics.convergence(law, start[:2], 5.0, lambda x: np.abs(x).max(1) < 50)
    assert errors[0] > 10 * errors[1]


def test_local_fit_carries_windows(spark):
    rows = [(e, s, float(np.sin(s / 5 + e)), float(np.cos(s / 5 + e)), float(-np.sin(s / 5 + e)) + 0.01 * (s % 3)) for e in range(3) for s in range(1, 60)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, price double, d1 double, d2 double").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got[size] = {(x.entity_id, x.seq): x.next_p for x in dynamics.local_fit(df, 15).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got["7"]) == set(got["10000"]) == {(e, s) for e in range(3) for s in range(16, 60)}
    assert all(a == b or abs(a - b) < 1e-9 or (np.isnan(a) and np.isnan(b)) for a, b in ((got["7"][k], got["10000"][k]) for k in got["7"]))


def test_gradient_is_numpy():
    w, state, r = np.zeros(4), {}, random.Random(1)
    for _ in range(200):
        x = np.array([1.0, r.random(), r.random(), r.random()])
        y = r.random() * 3
        state, made = M.gradient_step(state, {"x1": x[1], "x2": x[2], "x3": x[3], "y": y})
        assert abs(made["prediction"] - w @ x) < 1e-12
        free = w - 0.05 * (-(y - w @ x) * x + 0.01 * w)
        w = np.clip(free, -0.5, 0.5)
        assert np.allclose(state["w"], w) and made["hit"] == bool((w != free).any())


def test_validity_inconclusive(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, False), (1, 2, 1, 1.0, 0.0, False), (1, 3, 1, 2.0, -1.0, True)], "entity_id long, seq long, claim int, h double, y double, gap boolean")
    got = {x.seq: (x.kind, x.lower, x.upper) for x in labels.validity(df).collect()}
    assert got == {1: ("INCONCLUSIVE", 0.0, None), 2: ("INTERVAL", 0.0, 1.0), 3: ("RIGHT", 0.0, None)}


def test_scalars(spark):
    row = spark.range(1).select(S.ambiguity_index(F.lit(0.5), F.lit(1.0), F.lit("WEAKENING")).alias("a"), S.effective_mass(F.lit(2.0), F.lit(1e6), F.lit(-1.0)).alias("m"), S.signal_strength(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("s"), S.percent_encoded(F.lit("a b~*é")).alias("p"), S.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("j"), S.evidence_class(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit("ADEQUATE")).alias("e")).first()
    assert (round(row.a, 9), row.m, row.s, row.p, row.j, row.e) == (round(1 / 3, 9), 1.5, 1.0, "a%20b~%2A%C3%A9", '{"a":null,"b":1}', "EMPIRICALLY_SUPPORTED")


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.csv", "x\n1\n"), ("b.txt", "y")):
        (tmp_path / "d" / name).write_text(text)
    got = {x.path.rsplit("/", 1)[1]: (x.bytes, x.sha256) for x in T.file_manifest(spark, f"{tmp_path}/d").collect()}
    assert got == {"a.csv": (4, hashlib.sha256(b"x\n1\n").hexdigest()), "b.txt": (1, hashlib.sha256(b"y").hexdigest())}
    assert T.discover(spark, f"{tmp_path}/d").endswith("a.csv")
    (tmp_path / "d" / "c.csv").write_text("x\n")
    with pytest.raises(ValueError, match="more than one"):
        T.discover(spark, f"{tmp_path}/d")
    df = spark.createDataFrame([(1, s, float(s)) for s in range(1, 6)], "entity_id long, seq long, bid double")
    rows = T.replayed(df, 2, 4).orderBy("seq").collect()
    assert [(x.seq, x.ask, x.available) for x in rows] == [(s, None, {"bid": True, "ask": False}) for s in (2, 3)]
    assert [x.audit_seq for x in T.audited(df, ["entity_id"], ["seq"]).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    made = T.expanded(spark, {"level": 1, "open": True}, [{}, {"level": 2.5}]).orderBy("step").collect()
    assert [(x.step, x.level, x.open) for x in made] == [(1, 1.0, True), (2, 2.5, True)]


def run_stream(made, path, mode="append"):
    q = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_stream_intervals_restart_and_late_rows(spark, tmp_path):
    rows = [(e, s, 10.0 * s + (500 if s > 12 else 0), "ab"[s // 5 % 2]) for e in range(2) for s in range(1, 21)]
    schema = "entity_id long, seq long, t double, label string"
    late = [(0, 3, 1.0, "a")]
    for k, part in enumerate((rows[:9] + rows[20:31], rows[9:20] + rows[31:] + late)):  # the second run starts from the first one's checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(stateful.stream_intervals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path)
    got = sorted(tuple(x)[3:] for x in spark.read.parquet(f"{tmp_path}/out").where("entity_id = 0").collect())
    wanted, state = [], {}
    for _, _, t, label in rows[:20]:
        state, made = stateful.interval_step(state, {"t": t, "label": label})
        if made["closed_label"]:
            wanted.append(tuple(made.values()))
    assert got == sorted(wanted) and len(wanted) == 5
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * len(wanted)


def test_stream_duplicates_and_bars(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{h}:{m:02d}:00", k, float(k), 1.0) for k, (h, m) in enumerate([(0, 5), (0, 50), (1, 10), (1, 20), (3, 0), (6, 0)])]
    df = spark.createDataFrame(rows + rows[:2], "entity_id long, at string, event_id long, price double, volume double").select("entity_id", F.to_timestamp("at").alias("event_time"), "event_id", "price", "volume")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_stream(stateful.without_duplicates(source(), ["event_id"], "event_time"), f"{tmp_path}/d")
    assert sorted(x.event_id for x in spark.read.parquet(f"{tmp_path}/d/out").collect()) == list(range(6))
    run_stream(stateful.tumbling_bars(stateful.without_duplicates(source(), ["event_id"], "event_time"), late=None), f"{tmp_path}/b")
    bars = {x.window.start.hour: (x.open, x.high, x.low, x.close, x.volume) for x in spark.read.parquet(f"{tmp_path}/b/out").collect()}
    assert {h: bars[h] for h in (0, 1, 3)} == {0: (0.0, 1.0, 0.0, 1.0, 2.0), 1: (2.0, 3.0, 2.0, 3.0, 2.0), 3: (4.0, 4.0, 4.0, 4.0, 1.0)}  # that of hour 6 is still open
