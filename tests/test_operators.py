"""Step functions, streams and sources against small literal vectors."""

import pytest
from pyspark.sql import functions as F

from marea.functions import scalars as S
from marea.operators import folds
from marea.sources import ticks as T
from marea.streaming.stateful import stream_fold


def gates(scores, state=None):
    state, out = state or {}, []
    for s in scores:
        state, made = folds.hysteresis_step(state, {"score": s})
        out.append(made["gate"])
    return out


def test_hysteresis():
    assert gates([0.76, 0.78, 0.79]) == ["OPENING", "OPENING", "OPEN"]
    assert gates([0.54, 0.53], {"gate": "OPEN"}) == ["CLOSING", "CLOSED"]
    assert gates([0.50, 0.70], {"gate": "OPEN"}) == ["CLOSING", "OPEN"]
    with pytest.raises(ValueError):
        folds.hysteresis_step({}, {"score": 1}, open_at=0.5, close_at=0.6)


def test_qualities(spark):
    row = spark.range(1).select(S.geometry_quality(F.lit(-0.25), F.lit(1.0)).alias("a"), S.geometry_quality(F.lit(0.3), F.lit(0.0)).alias("b"), S.structural_quality(F.lit(0.125), F.lit(0.125), F.lit(0.125)).alias("c"), S.risk_quality(F.lit(0.75), F.lit(0.0)).alias("d"), S.half_life_decay(F.lit(30.0), F.lit(30.0)).alias("e")).first()
    assert (row.a, row.b, round(row.c, 9), row.d, row.e) == (0.25, 0.0, 0.125, 0.5, 0.5)


def test_fold_and_stream_agree(spark, tmp_path):
    rows = [(e, s, "abc"[(s * s + e) % 3], "d") for e in range(3) for s in range(1, 30)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, label string, day string")
    batch = {(r.entity_id, r.seq): r.colour for r in folds.fold(df, folds.debounce_step, ["day", "label"], "colour string").collect()}
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = stream_fold(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), folds.debounce_step, ["day", "label"], "colour string")
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.entity_id, r.seq): r.colour for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_csv_round_trip(spark, tmp_path):
    with open(f"{tmp_path}/a.csv", "wb") as f:
        f.write(b"\xef\xbb\xbftimestamp,open,high,low,close,volume\n2023-03-12 03:30:00,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n")
    rows = T.read_raw_bars(spark, f"{tmp_path}/a.csv").withColumn("at", T.parsed_timestamp("timestamp")).collect()
    assert [r.at is None for r in rows] == [False, True] and rows[0].high == 2
    T.write_rows(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/out", ["b"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["b"]
