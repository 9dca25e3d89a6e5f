"""Order-dependent recurrences, each with one step function that batch folds and streams share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, dict]]

#: Rows that a task folds at once where a step is known for many entities, and the least number of entities for which that pays.
AT_ONCE, FEW = 32_768, 8


class Many(NamedTuple):
    """A step for many entities at once, one row of each: step takes and gives dicts of arrays.

    start has the state before an entity's first row, by the names that the single step's state has once it is not empty;
    beside them, known tells which states are not empty. Both steps must give the same numbers.
    """

    start: dict[str, float]
    step: Callable[[dict, dict], tuple[dict, dict]]


def hysteresis_step(state: dict, row: dict, open_at: float = 0.75, close_at: float = 0.55, to_open: int = 3, to_close: int = 2) -> tuple[dict, dict]:
    """CLOSED opens by way of OPENING after to_open rows at open_at or more; OPEN closes by way of CLOSING after to_close rows at close_at or less. A null score is low."""
    if open_at < close_at:
        raise ValueError("open_at is below close_at")
    gate, x = state.get("gate", "CLOSED"), row["score"]
    shut = gate in ("CLOSED", "OPENING")
    goes = (x is not None and x >= open_at) if shut else (x is None or x <= close_at)
    if not goes:
        gate, n = "CLOSED" if shut else "OPEN", 0
    elif gate in ("CLOSED", "OPEN"):
        gate, n = "OPENING" if shut else "CLOSING", 1
    else:
        n = state.get("n", 1) + 1
        if n >= (to_open if shut else to_close):
            gate, n = "OPEN" if shut else "CLOSED", 0
    return {"gate": gate, "n": n}, {"gate": gate}


def ema_step(state: dict, row: dict, rate: float = 0.05) -> tuple[dict, dict]:
    """An exponential reference of the price and of its distance from it; the first row sets the reference, with scale 1."""
    p = row["price"]
    if "ref" not in state:
        return {"ref": p, "scale": 1.0}, {"ref": p, "scale": 1.0}
    ref = state["ref"] + rate * (p - state["ref"])
    scale = max(1e-4, 0.95 * state["scale"] + 0.05 * abs(p - ref))
    return {"ref": ref, "scale": scale}, {"ref": ref, "scale": scale}


def debounce_step(state: dict, row: dict, confirm: int = 2) -> tuple[dict, dict]:
    """A colour that changes only once the new label has come confirm times running; reset where the day changes."""
    if state.get("day") != row["day"]:
        state = {"day": row["day"], "colour": row["label"], "candidate": None, "n": 0}
    elif row["label"] == state["colour"]:
        state = {**state, "candidate": None, "n": 0}
    else:
        n = state["n"] + 1 if row["label"] == state["candidate"] else 1
        state = {**state, "candidate": row["label"], "n": n}
        if n >= confirm:
            state = {**state, "colour": row["label"], "candidate": None, "n": 0}
    return state, {"colour": state["colour"]}


def plain(column: pd.Series) -> list:
    """A column's values as Python's own, missing ones and NaN as None."""
    values = column.tolist()
    return [None if gone else v for v, gone in zip(values, column.isna(), strict=True)] if column.isna().any() else values


def linear_fold(df: DataFrame, column: str, out: str, rate: float, start: float | None = None, reset: str | None = None, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """key, order, column, out: the exponential mean out = (1 - rate) out + rate column of each entity, many rows at a time.

    start is the mean before the first row; without it the first row's value is. A true reset sets the mean to 0. Missing
    values leave the mean as it is. Inside a batch the recurrence is a cumulative sum of scaled values; one value is carried.
    """
    step = 64  # rows at once: scales stay within what a double can tell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            keys, x = batch[key].to_numpy(), batch[column].to_numpy(np.float64, na_value=np.nan)
            cut = batch[reset].fillna(False).to_numpy(bool) if reset else np.zeros(len(batch), bool)
            out_ = np.empty(len(batch))
            known, fresh = ~np.isnan(x), np.r_[True, keys[1:] != keys[:-1]] if len(batch) else np.zeros(0, bool)
            edges = np.flatnonzero(fresh | cut | ~known)
            starts = np.unique(np.concatenate([edges, edges + 1, np.arange(0, len(batch), step)]))
            starts = starts[starts < len(batch)]
            for a, z in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
                if keys[a] != last:
                    last, held = keys[a], start
                if cut[a]:
                    held = 0.0
                    out_[a:z] = held
                elif not known[a]:
                    out_[a:z] = np.nan if held is None else held
                else:
                    first = 0
                    if held is None:
                        held, first = x[a], 1
                        out_[a] = held
                    n = np.arange(1, z - a - first + 1)
                    down = (1 - rate) ** n
                    out_[a + first : z] = down * (held + np.cumsum(rate * x[a + first : z] / down))
                    held = out_[z - 1]
            yield pd.DataFrame({key: batch[key], order: batch[order], column: batch[column], out: out_})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(key, order, column, *([reset] if reset else [])).repartition(parts, key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {column} {kinds[column]}, {out} double")


def kept(state: dict) -> str:
    """A state as JSON that gives the same numbers back."""
    return json.dumps(state, sort_keys=True, separators=(",", ":"), default=lambda x: x.tolist() if hasattr(x, "tolist") else list(x))


def fold(df: DataFrame, step: Step, columns: list[str], out: str, key: str = "entity_id", order: str = "seq", carry: list[str] | None = None, in_order: bool = False, restored: DataFrame | None = None, many: Many | None = None) -> DataFrame:
    """Each entity's rows through step, in order: key, order, the columns of carry and those of out (doubles and strings, with many).

    Rows are sorted by Spark and folded as they stream through, so an entity of any length holds one state in memory.
    in_order spares the shuffle where df is made row by row from another fold's result, whose order it still has; rows of
    an entity that come out of order are an error. restored (key, order, state), as `final_states` gives it, is the state
    from before an entity's first row; rows up to that order are an error then. With many, entities that are sorted into one
    task take their rows together, AT_ONCE rows at a time, restored or not; the rest of long ones, where few are left, goes row by row.
    """
    carry = carry or []
    reads = list(dict.fromkeys([*columns, *carry]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if in_order and restored is not None:
        raise ValueError("states are restored where rows are sorted")
    if many is not None:
        run = _together(step, many, columns, carry, dict(f.split() for f in out.split(", ")), key, order, restored is not None)
    else:
        run = _folder(step, reads, carry, [f.split()[0] for f in out.split(", ")], key, order, restored is not None)
    carried = "".join(f"{c} {kinds[c]}, " for c in carry)
    return _dealt(df, reads, key, order, in_order, restored).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {carried}{out}")


def final_states(df: DataFrame, step: Step, columns: list[str], key: str = "entity_id", order: str = "seq", restored: DataFrame | None = None, many: Many | None = None) -> DataFrame:
    """key, order, state: the order of each entity's last row and the state after it as JSON, which `fold` restores.

    Entities of restored without rows in df keep their state. many is as in `fold`.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if many is not None:
        run = _together(step, many, columns, [], None, key, order, restored is not None)
    else:
        run = _folder(step, list(dict.fromkeys(columns)), [], None, key, order, restored is not None)
    return _dealt(df, list(dict.fromkeys(columns)), key, order, False, restored).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state string")


def _dealt(df: DataFrame, reads: list[str], key: str, order: str, in_order: bool, restored: DataFrame | None) -> DataFrame:
    rows = df.select(key, order, *reads)
    if in_order:
        return rows
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: adaptive merging would see small rows, not the work a step is
    if restored is None:
        return rows.repartition(parts, key).sortWithinPartitions(key, order)
    both = rows.withColumn("__state", F.lit(None).cast("string")).unionByName(restored.select(key, order, F.col("state").alias("__state")), allowMissingColumns=True)
    return both.repartition(parts, key).sortWithinPartitions(key, F.asc_nulls_last("__state"), order)


def _folder(step: Step, reads: list[str], carry: list[str], names: list[str] | None, key: str, order: str, restored: bool):
    """The fold of one task: rows with the columns names, or, without names, each entity's last order and state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at, state = None, None, {}
        for batch in batches:
            made, ended, told = [], [], []
            given = [plain(batch[c]) for c in reads]
            states = plain(batch["__state"]) if restored else [None] * len(batch)
            for n, (k, o, held, *values) in enumerate(zip(batch[key].tolist(), batch[order].tolist(), states, *given, strict=True)):
                if k != last:
                    if last is not None and names is None:
                        ended.append((last, at, kept(state)))
                    last, at, state = k, None, {}
                if at is not None and (o < at or restored and known and o == at):
                    raise ValueError(f"rows of {key} {k} are out of order: {o} after {at}")
                at, known = o, held is not None
                if known:
                    state = json.loads(held)
                    continue
                state, row = step(state, dict(zip(reads, values, strict=True)))
                if names is not None:
                    made.append(row)
                    told.append(n)
            if names is None:
                if ended:
                    yield pd.DataFrame(ended, columns=[key, order, "state"])
            else:
                rows = batch if len(told) == len(batch) else batch.iloc[told]
                yield pd.DataFrame({key: rows[key], order: rows[order], **{c: rows[c] for c in carry}, **{n: pd.Series([r[n] for r in made], index=rows.index) for n in names}})
        if names is None and last is not None:
            yield pd.DataFrame([(last, at, kept(state))], columns=[key, order, "state"])

    return run


def _together(step: Step, many: Many, columns: list[str], carry: list[str], out: dict[str, str] | None, key: str, order: str, restored: bool = False):
    """The fold of one task by many: entities of some rows take their first rows at once, then their second ones, and so on. Without out, each entity's last order and state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at, held, begun = None, None, {}, False  # the entity that may go on, its last order and state, and whether that is as it was restored

        def told(f: pd.DataFrame) -> pd.DataFrame:
            nonlocal last, at, held, begun
            keys, orders = f[key].to_numpy(), f[order].to_numpy()
            texts = f["__state"].to_numpy() if restored else None
            stored = f["__state"].notna().to_numpy() if restored else np.zeros(len(f), bool)
            same = keys[1:] == keys[:-1]
            back = np.r_[at is not None and keys[0] == last and (orders[0] < at or begun and orders[0] == at), same & ((orders[1:] < orders[:-1]) | stored[:-1] & (orders[1:] == orders[:-1]))]
            if back.any():
                k = int(np.argmax(back))
                raise ValueError(f"rows of {key} {keys[k]} are out of order: {orders[k]} after {orders[k - 1] if k else at}")
            first = np.flatnonzero(np.r_[True, ~same])
            ends = np.r_[first[1:], len(f)] - 1
            heads = np.add.reduceat(stored, first, dtype=np.int64)  # states are sorted before the rows of their entity
            size = ends + 1 - first - heads
            lanes = np.argsort(-size, kind="stable")
            first, size, heads, ends = first[lanes], size[lanes], heads[lanes], ends[lanes]
            state = {k: np.full(len(lanes), v) for k, v in many.start.items()} | {"known": np.zeros(len(lanes), bool)}

            def begin(lane: int, single: dict) -> None:
                for k in state if single else ():
                    state[k][lane] = True if k == "known" else single[k]

            before = (last, at, held)
            if keys[0] == last:
                begin(int(np.flatnonzero(first == 0)[0]), held)
                before = (None, None, {})
            for lane in np.flatnonzero(heads):
                state["known"][lane] = False
                begin(lane, json.loads(texts[first[lane] + heads[lane] - 1]))
            first = first + heads
            given = {c: f[c].to_numpy(np.float64, na_value=np.nan) for c in columns}
            made = {c: np.full(len(f), np.nan) if kind == "double" else np.full(len(f), None, object) for c, kind in (out or {}).items()}
            done = 0
            while (n := int(np.searchsorted(-size, -done))) >= FEW:
                rows = first[:n] + done
                new, row = many.step({k: v[:n] for k, v in state.items()}, {c: v[rows] for c, v in given.items()})
                for k, v in new.items():
                    state[k][:n] = v
                for c, v in made.items():
                    v[rows] = row[c]
                done += 1
            kept_ = lambda i: {k: state[k][i].item() for k in many.start} if state["known"][i] else {}
            for i in range(n):
                single, rows = kept_(i), range(first[i] + done, first[i] + size[i])
                values = [plain(f[c].iloc[rows.start : rows.stop]) for c in columns]
                for r, *x in zip(rows, *values, strict=True):
                    single, row = step(single, dict(zip(columns, x, strict=True)))
                    for c, v in made.items():
                        v[r] = row[c]
                begin(i, single)
            end = int(np.argmax(ends))
            last, at, held, begun = keys[-1], orders[-1], kept_(end), bool(stored[-1])
            if out is not None:
                rows = pd.DataFrame({key: f[key], order: f[order], **{c: f[c] for c in carry}, **made})
                return rows[~stored] if restored else rows
            ended = [before, *((keys[z], orders[z], kept_(i)) for i, z in enumerate(ends) if i != end)]
            return pd.DataFrame([(k, o, kept(s)) for k, o, s in ended if k is not None], columns=[key, order, "state"])

        waiting, size = [], 0
        for batch in batches:
            if len(batch):
                waiting.append(batch)
                size += len(batch)
            if size >= AT_ONCE:
                yield told(pd.concat(waiting, ignore_index=True))
                waiting, size = [], 0
        if size:
            yield told(pd.concat(waiting, ignore_index=True))
        if out is None and last is not None:
            yield pd.DataFrame([(last, at, kept(held))], columns=[key, order, "state"])

    return run
