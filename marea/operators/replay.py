"""Replays that can be sealed and resumed: ordered digests carried from row to row, a manifest of checkpoints, and folds continued from states.

A digest of a prefix is the SHA-256 of the digest before it and the row's canonical text, so one text of 64 characters
carries it over partitions, tables and micro-batches, and a replay that stops and starts again ends with the same seal.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Many, Step, final_states, fold

SEAL_COLUMNS = "accepted long, logical string, semantic string"


def canonical(**fields: Column) -> Column:
    """A row's canonical JSON: names in order, no blanks, nulls written; floating numbers are told on the grid of 2 ** -20, as integers."""
    typed = [F.coalesce(F.to_json(F.struct(c.alias(k))), F.lit("{}")) for k, c in sorted(fields.items())]
    parts = [F.when(c.isNull(), F.lit(f"{json.dumps(k)}:null")).otherwise(F.substring(t, F.lit(2), F.length(t) - 2)) for (k, c), t in zip(sorted(fields.items()), typed, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def on_grid(x: Column) -> Column:
    return F.round(x * 1048576.0).cast("long")


def seal_step(state: dict, row: dict) -> tuple[dict, dict]:
    """Digests of the rows so far: of record (everything that was told) and of reduced (what the model alone decides)."""
    after = lambda name, text: hashlib.sha256((state.get(name, "") + text).encode()).hexdigest()
    now = {"accepted": state.get("accepted", 0) + 1, "logical": after("logical", row["record"]), "semantic": after("semantic", row["reduced"])}
    return now, dict(now)


def sealed(df: DataFrame, restored: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """entity_id, seq and SEAL_COLUMNS of rows (entity_id, seq, record, reduced), each as of that row; restored and in_order as `fold` takes them."""
    return fold(df, seal_step, ["record", "reduced"], SEAL_COLUMNS, restored=restored, in_order=in_order)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are due or may be an entity's last one: all but those right before a later row of their entity, in whatever order rows come."""
    for batch in batches:
        key, seq, due = (batch.column(c) for c in ("entity_id", "seq", "due"))
        later = pc.and_(pc.equal(key[1:], key[:-1]), pc.greater(seq[1:], seq[:-1])).fill_null(False)
        last = pa.array([True] * min(1, len(batch)), pa.bool_())
        yield batch.filter(pc.or_(due, pa.concat_arrays([pc.invert(later), last])))


def manifest(seals: DataFrame, every: int) -> DataFrame:
    """The checkpoints of a sealed replay: each entity's every-th row and its last one, which is complete.

    accepted and the prefix digest tell a resumed run where it stands and whether it had the same rows. Only rows that may be
    checkpoints are shuffled; of seals in order, as `sealed` makes them, these are the checkpoints and one row a batch.
    """
    told = seals.select("entity_id", "seq", "accepted", F.col("logical").alias("prefix"), "semantic", F.coalesce(F.col("accepted") % every == 0, F.lit(False)).alias("due"))
    told = told.mapInArrow(_candidates, told.schema)
    last = F.max("seq").over(Window.partitionBy("entity_id"))
    complete = F.coalesce(F.col("entity_id").isNotNull() & (F.col("seq") == last), F.lit(False))
    return told.withColumn("complete", complete).where("due OR complete").drop("due")


def resumed_states(parts: list[DataFrame], step: Step, columns: list[str]) -> DataFrame:
    """entity_id, seq, state after the last of parts, each begun from the states after the one before: what `resumed` ends with, one row an entity."""
    states = None
    for part in parts:
        states = final_states(part, step, columns, restored=states)
    return states


def resumed(parts: list[DataFrame], step: Step, columns: list[str], out: str, carry: list[str] | None = None, many: Many | None = None) -> DataFrame:
    """The fold of all parts, each begun from the states after the one before: the rows of one fold over everything, if each part's rows come after the last one's. many is as in `fold`."""
    states, made = None, None
    for n, part in enumerate(parts):
        rows = fold(part, step, columns, out, carry=carry, restored=states, many=many)
        made = rows if made is None else made.unionByName(rows)
        if n + 1 < len(parts):
            states = final_states(part, step, columns, restored=states, many=many)
    return made
