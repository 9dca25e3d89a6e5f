"""The batch folds as Structured Streaming operators: same step functions, state kept per entity by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.folds import Step, kept, plain


def stream_fold(stream: DataFrame, step: Step, columns: list[str], out: str, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """A stream's rows through step, each micro-batch in order; rows not after an entity's last one come out as late, unfolded.

    The state is one JSON text per entity, so what is kept doesn't grow with the stream.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, state = (held.get[0], json.loads(held.get[1])) if held.exists else (None, {})
        rows = []
        table = pd.concat(list(frames)).sort_values(order)
        for at, *values in zip(table[order].tolist(), *(plain(table[c]) for c in columns), strict=True):  # Python's own values, so that the state can be written as JSON
            if last is not None and at <= last:
                rows.append((keys[0], at, True, *[None] * len(names)))
                continue
            state, made = step(state, dict(zip(columns, values, strict=True)))
            last = at
            rows.append((keys[0], last, False, *(made[n] for n in names)))
        if last is not None:
            held.update((last, kept(state)))
        yield pd.DataFrame(rows, columns=[key, order, "late", *names])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} long, late boolean, {out}", "last long, state string", "append", "NoTimeout")


def interval_step(state: dict, row: dict, most: float = 60.0) -> tuple[dict, dict]:
    """Intervals of rows (t in seconds, label) with one label and no gap over most: a row that ends one tells it, closed_*; the rest stays open."""
    t, label, closed = row["t"], row["label"], {"closed_label": None, "closed_first": None, "closed_last": None, "closed_rows": None}
    if state and (label != state["label"] or t - state["last"] > most):
        closed = {"closed_label": state["label"], "closed_first": state["first"], "closed_last": state["last"], "closed_rows": state["n"]}
        state = {}
    return {"label": label, "first": state.get("first", t), "last": t, "n": state.get("n", 0) + 1}, closed


INTERVAL_COLUMNS = "closed_label string, closed_first double, closed_last double, closed_rows long"


def stream_intervals(stream: DataFrame, most: float = 60.0) -> DataFrame:
    """The intervals of interval_step of a stream (entity_id, seq, t, label), each told by the row that ends it."""
    made = stream_fold(stream, lambda s, r: interval_step(s, r, most), ["t", "label"], INTERVAL_COLUMNS)
    return made.where("closed_label is not null")


def without_duplicates(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed, so the state stays bounded."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def tumbling_bars(stream: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Bars of a tick stream by event time, closed once the watermark has passed them; without late, the watermark that the stream has."""
    from pyspark.sql import functions as F

    at = F.struct("event_time", "event_id")
    marked = stream if late is None else stream.withWatermark("event_time", late)
    return (
        marked.groupBy("entity_id", F.window("event_time", size))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    )
