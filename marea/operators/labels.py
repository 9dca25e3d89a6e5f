"""Forward labels of anchors: path geometry up to a time horizon, and how long a claim stays valid. For evaluation only."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Rows of a task that are worked on at once, and the longest entity of which many are.
AT_ONCE, SHORT = 32_768, 1_024


def category(claim: Column, displacement: Column, slope: Column) -> Column:
    """How a path agrees with the direction claimed for it."""
    dy, db = claim * displacement, claim * slope
    return F.when(claim == 0, "AMBIGUOUS/INCONCLUSIVE").when((dy > 0) & (db > 0), "CONTINUATION").when((dy >= 0) & (db <= 0), "WEAKENING").when((dy < 0) & (db < 0), "REVERSAL").otherwise("AMBIGUOUS/INCONCLUSIVE")


MOMENTS = ("xy", "xx", "xq", "qq", "qy", "yy", "length", "best")


def path_moments(h: np.ndarray, y: np.ndarray, claim: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over each path, rows start + 1 to end, about its row start: of x, dy and q = x x / 2, the path's length and its best progress.

    Short paths, of any entities, are laid out end to end and summed row by row, in the order and with the products that
    SQL has, since fits of rows close in time tell any other order; long ones, of one entity, are differences of running sums about the middle of some
    tens of path lengths, so that what cancels stays small, and their extremes come from a table of powers of two.
    """
    out = {k: np.zeros(len(start)) for k in MOMENTS}
    n = end - start
    longest = h[end] - h[start]
    step = np.abs(np.diff(y, prepend=y[:1]))
    direct = n <= 64
    for at in _bounded(np.flatnonzero(direct), n, 1 << 20):
        own = np.repeat(np.arange(len(at)), n[at])
        row = np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + start[at][own] + 1
        first = np.cumsum(n[at]) - n[at]
        x, dy = h[row] - h[start[at]][own], y[row] - y[start[at]][own]
        q = x * x / 2
        steps = np.diff(dy, prepend=0.0)
        steps[first] = dy[first]
        for k, v in zip(MOMENTS, (x * dy, x * x, x * q, x * x * x * x / 4, q * dy, dy * dy, np.abs(steps)), strict=False):
            out[k][at] = np.add.reduceat(v, first)
        out["best"][at] = np.maximum.reduceat(claim[at][own] * dy, first)
    rest = np.flatnonzero(~direct)
    if not len(rest):
        return out
    tables = [_extremes(s * y) for s in (1, -1)]
    width = int(np.log2(n[rest].max()))
    for at in np.split(rest, np.flatnonzero(np.diff(np.floor((h[start[rest]] - h[start[rest[0]]]) / (16 * np.median(longest[rest]))))) + 1):
        a, z = start[at].min(), end[at].max() + 1
        hc, yc = (h[a:z] - h[start[at[len(at) // 2]]]).astype(np.longdouble), (y[a:z] - y[start[at[len(at) // 2]]]).astype(np.longdouble)
        sums = {}
        for i in range(5):
            for j in range(3):
                if i + j <= 4 and (j < 2 or not i):
                    sums[i, j] = np.concatenate([[0], np.cumsum(hc**i * yc**j)])
        u, v = -hc[start[at] - a], -yc[start[at] - a]
        over = {k: t[end[at] - a + 1] - t[start[at] - a + 1] for k, t in sums.items()}

        def about(i: int, j: int) -> np.ndarray:
            """The sum of x^i dy^j about the path's own row."""
            total = 0
            for p in range(i + 1):
                for r in range(j + 1):
                    total = total + comb(i, p) * comb(j, r) * over[p, r] * u ** (i - p) * v ** (j - r)  # noqa: B023
            return total.astype(np.float64)

        for k, (i, j, by) in {"xy": (1, 1, 1), "xx": (2, 0, 1), "xq": (3, 0, 2), "qq": (4, 0, 4), "qy": (2, 1, 2), "yy": (0, 2, 1)}.items():
            out[k][at] = about(i, j) / by
        travelled = np.concatenate([[0], np.cumsum(step[a:z])])
        out["length"][at] = travelled[end[at] - a + 1] - travelled[start[at] - a + 1]
    level = np.minimum(np.log2(n[rest]).astype(int), width)
    for side, table in ((1, tables[0]), (-1, tables[1])):
        mine = claim[rest] == side
        r, lv = rest[mine], level[mine]
        most = np.array([max(table[k][a + 1], table[k][z - (1 << k) + 1]) for k, a, z in zip(lv.tolist(), start[r].tolist(), end[r].tolist(), strict=True)])
        out["best"][r] = most - side * y[start[r]] if len(r) else most
    return out


def _bounded(rows: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """rows in parts whose sizes sum to most at most."""
    return [p for p in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // most)) + 1) if len(p)] if len(rows) else []


def _extremes(v: np.ndarray) -> list[np.ndarray]:
    """For each power of two, the greatest of so many values from each place on."""
    out = [v]
    while 2 << len(out) - 1 <= len(v):
        half = 1 << len(out) - 1
        out.append(np.maximum(out[-1][:-half], out[-1][half:]))
    return out


def _stops(key: np.ndarray) -> np.ndarray:
    """For each row the place after the last one of its entity."""
    edge = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return np.repeat(edge, np.diff(edge, prepend=0))


def first_at(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each of many searches the first place from lo on, up to hi, where rising h has reached least; hi if none."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        before = h[mid] < least[live]
        lo[live[before]] = mid[before] + 1
        hi[live[~before]] = mid[~before]
        live = live[lo[live] < hi[live]]
    return lo


def _of_each(key: np.ndarray, h: np.ndarray, y: np.ndarray, claim: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """path_moments of rows of several entities: short paths of all at once, long ones entity by entity."""
    long = end - start > 64
    out = path_moments(h, y, claim[start], start, np.where(long, start + 1, end))
    for k in np.unique(key[start[long]]):
        own = np.flatnonzero(key == k)
        at = np.flatnonzero(long & (key[start] == k))
        a, z = own[0], own[-1] + 1
        for name, v in path_moments(h[a:z], y[a:z], claim[start[at]], start[at] - a, end[at] - a).items():
            out[name][at] = v
    return out


def time_horizons(anchors: DataFrame, horizons: tuple[float, ...] = (), named: dict[str, str] | None = None, in_order: bool = False, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """For rows (entity_id, seq, h, y, claim) and each horizon in the units of h: the path from a row to the first one at or after it.

    horizons are fixed lengths; named gives columns of anchors that hold each row's own length, by name (null, not finite
    or not positive: none). Rows without an end are left out. Rows stream by in the order of entity and h, and many entities
    are worked on at once; those of one whose paths have no end yet are held, and work is done when as many again have
    come, so it grows with the rows. in_order spares the shuffle where anchors is made row by row from a fold's result, with
    seq in the order of h. carry names further columns of anchors to hand on. With whole, rows without an end stay, with n and
    what is told of the path null; with one horizon rows keep their order then.
    """
    named = named or {}
    columns = [str(x) for x in horizons] + list(named)
    lengths = anchors.select("entity_id", "seq", F.col("h").cast("double").alias("h"), F.col("y").cast("double").alias("y"), F.col("claim").cast("double").alias("claim"), *[F.lit(float(x)).alias(f"t{k}") for k, x in enumerate(horizons)], *[F.col(f"`{c}`").cast("double").alias(f"t{k}") for k, c in enumerate(named.values(), len(horizons))], *[c for c in carry if c not in ("h", "y", "claim")])
    handed = ["claim", *[c for c in carry if c != "claim"]]
    names = ["entity_id", "seq", "horizon", "requested", "n", "hours", "displacement", *MOMENTS, *handed]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, waiting = [], 0, 0  # waiting: rows of the entity that goes on whose paths had no end yet

        def told(rows: pd.DataFrame, final: bool) -> tuple[list[pd.DataFrame], int]:
            """What is known of the rows of some entities, or of one that goes on, and up to which row nothing more will come."""
            key, h, y, claim, seq = (rows[c].to_numpy() for c in ("entity_id", "h", "y", "claim", "seq"))
            place, stop = np.arange(len(h)), _stops(key)
            ends, made = [], []
            for k in range(len(columns)):
                t = rows[f"t{k}"].to_numpy()
                fine = np.isfinite(t) & (t > 0) & np.isfinite(h)
                ends.append(np.where(fine, first_at(h, place + 1, stop, h + np.where(fine, t, 0.0)), 0))
            open_ = (np.max(ends, axis=0) >= stop) & (not final)
            upto = int(np.argmax(open_)) if open_.any() else len(h)
            for k, end in enumerate(ends):
                at = np.flatnonzero((end[:upto] > 0) & (end[:upto] < stop[:upto]))
                if len(at) or (whole and upto):
                    m = {c: np.empty(0) for c in MOMENTS} if not len(at) else path_moments(h, y, claim[at], at, end[at]) if key[0] == key[-1] else _of_each(key, h, y, claim, at, end[at])
                    told_of = pd.DataFrame({"n": end[at] - at, "hours": h[end[at]] - h[at], "displacement": y[end[at]] - y[at], **m}, index=at)
                    at = np.arange(upto) if whole else at
                    told_of = told_of.reindex(at) if whole else told_of
                    made.append(told_of.assign(entity_id=key[at], seq=seq[at], horizon=k, requested=rows[f"t{k}"].to_numpy()[at], **{c: rows[c].to_numpy()[at] for c in handed})[names])
            return made, upto

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < max(AT_ONCE, 2 * waiting):
                continue
            rows = pd.concat(held, ignore_index=True)
            key = rows["entity_id"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last entity may go on
            if cut:
                yield from told(rows.iloc[:cut], True)[0]
                rows, waiting = rows.iloc[cut:].reset_index(drop=True), 0
            if len(rows) >= max(AT_ONCE, 2 * waiting):
                made, upto = told(rows, False)
                yield from made
                rows = rows.iloc[upto:].reset_index(drop=True)
                waiting = len(rows)
            held, size = [rows], len(rows)
        if size:
            yield from told(pd.concat(held, ignore_index=True), True)[0]

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lengths if in_order else lengths.repartition(parts, "entity_id").sortWithinPartitions("entity_id", "h", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in lengths.schema}
    a = dealt.mapInPandas(run, f"entity_id {kinds['entity_id']}, seq {kinds['seq']}, horizon int, requested double, n long, hours double, displacement double, " + ", ".join(f"{k} double" for k in MOMENTS) + "".join(f", {k} {kinds[k]}" for k in handed))
    c = F.col
    name = F.element_at(F.array(*map(F.lit, columns)), c("horizon") + 1)
    dy, slope, det = c("displacement"), S.ratio(c("xy"), c("xx")), c("xx") * c("qq") - c("xq") * c("xq")
    two = lambda x: F.when(c("n") >= 2, S.ratio(x, det))
    share = lambda x: F.when(c("length") == 0, 0.0).otherwise(x / c("length"))
    left = F.greatest(F.lit(0.0), c("yy") - 2 * slope * c("xy") + slope * slope * c("xx"))
    return a.select(
        "entity_id", "seq", name.alias("horizon"), "requested", "n", "hours", dy.alias("displacement"), slope.alias("slope"), two(c("xy") * c("qq") - c("qy") * c("xq")).alias("quadratic_slope"), two(c("xx") * c("qy") - c("xq") * c("xy")).alias("acceleration"),
        c("length").alias("path_length"), share(F.abs(dy)).alias("efficiency"), share(F.sqrt(left / c("n"))).alias("deviation"), F.when(c("claim") == 0, 0.0).otherwise(c("best")).alias("max_progress"), (c("claim") * dy).alias("terminal_progress"), F.when(c("n").isNotNull(), category(c("claim"), dy, slope)).alias("category"), *carry,
    )


def first_reversals(h: np.ndarray, y: np.ndarray, claim: np.ndarray, h0: np.ndarray, y0: np.ndarray, begun: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For claims about (h0, y0), the first of the rows (h, y) from begun on where the path is beyond y0 against the claim and so is the sum of x dy, held before; len(h) if none, then also that sum.

    All claims walk the rows at once, over stretches of a power of two. A stretch is passed whole if none of its values is
    against the claim, or if even all of them at their least would leave the sum with it.
    """
    n = len(h)
    hc, place, sums = h - h[0], begun.copy(), held.copy()
    flip = claim
    yc = y - y[0]
    a, b, c = (np.concatenate([[0.0], np.cumsum(v)]) for v in (hc * yc, hc, yc))
    lows = {s: [-t for t in _extremes(-s * y)] for s in (1.0, -1.0)}
    u, v = h0 - h[0], y0 - y[0]

    def total(i: np.ndarray, to: np.ndarray) -> np.ndarray:
        """With the claim's sign: the sum of claims i over rows from begun to before to."""
        s = begun[i]
        return flip[i] * (held[i] + a[to] - a[s] - u[i] * (c[to] - c[s]) - v[i] * (b[to] - b[s]) + (to - s) * u[i] * v[i])

    levels = len(lows[1.0])
    live, level = np.flatnonzero(place < n), np.zeros(len(claim), np.int64)
    while len(live):
        p, lv = place[live], level[live]
        lv = np.minimum(lv, levels - 1)
        lv = np.where(p + (1 << lv) > n, np.log2(np.maximum(n - p, 1)).astype(np.int64), lv)
        low = np.empty(len(live))
        for s in (1.0, -1.0):
            for k in np.unique(lv[flip[live] == s]):
                m = (flip[live] == s) & (lv == k)
                low[m] = lows[s][k][p[m]]
        below = flip[live] * y0[live] - low
        size = 1 << lv
        over = (below <= 0) | (total(live, p) - (h[p + size - 1] - h0[live]) * size * np.maximum(below, 0) > 0)
        single = ~over & (lv == 0)
        found = single.copy()
        found[single] = (below[single] > 0) & (total(live[single], p[single] + 1) < 0)
        goes = over | (single & ~found)
        place[live] = np.where(goes, p + size, p)
        level[live] = np.where(goes, lv + 1, lv - 1)
        live = live[~found & (place[live] < n)]
        level[live] = np.maximum(level[live], 0)
    ended = place >= n
    sums[ended] = flip[ended] * total(np.flatnonzero(ended), np.full(ended.sum(), n))
    return np.minimum(place, n), sums


def validity(anchors: DataFrame, in_order: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, seq, the columns of carry, kind, lower, upper for rows (entity_id, seq, claim, h, y, gap): when the path first reverses a row's claim.

    An entity's rows stream by in the order of h; claims that stand are held with their running sum. Rows are taken in
    blocks of a quarter of the standing claims at least, and a block is searched by all claims at once in steps of powers
    of two, so the time of a row doesn't grow with the claims. A claim of 0 is INCONCLUSIVE. in_order is as in
    time_horizons; carried columns are numbers.
    """
    kept = ["seq", *carry]
    names = ["entity_id", *kept, "kind", "lower", "upper"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, waiting = None, [], 0
        none = pd.DataFrame({k: np.empty(0) for k in (*kept, "claim", "h", "y", "sum")})
        standing, last = none, np.nan

        def block() -> tuple[pd.DataFrame, pd.DataFrame, float]:
            """(what ends in the rows waiting, what stands after them, their last h)."""
            f = pd.concat(rows, ignore_index=True)
            h, y, gap = f["h"].to_numpy(np.float64), f["y"].to_numpy(np.float64), f["gap"].fillna(False).to_numpy(bool)
            new = f.loc[f["claim"] != 0, [*kept, "claim", "h", "y"]].assign(sum=0.0)
            all_ = pd.concat([standing, new], ignore_index=True) if len(standing) else new.reset_index(drop=True)
            begun = np.concatenate([np.zeros(len(standing), np.int64), np.flatnonzero(f["claim"].to_numpy() != 0) + 1])
            h0 = all_["h"].to_numpy(np.float64)
            at, sums = first_reversals(h, y, np.sign(all_["claim"].to_numpy(np.float64)), h0, all_["y"].to_numpy(np.float64), begun, all_["sum"].to_numpy(np.float64))
            done = at < len(h)
            where = at[done]
            x = h[where] - h0[done]
            before = np.where(where > 0, h[where - 1], last) - h0[done]
            idle = f.loc[f["claim"] == 0, kept]
            ended = pd.concat([all_.loc[done, kept], idle]) if len(idle) else all_.loc[done, kept]
            ended = ended.assign(entity_id=key, kind=np.concatenate([np.where(gap[where], "INTERVAL", "EXACT"), np.full(len(idle), "INCONCLUSIVE")]), lower=np.concatenate([np.where(gap[where], before, x), np.zeros(len(idle))]), upper=np.concatenate([x, np.full(len(idle), np.nan)]))[names]
            return ended, all_.assign(sum=sums)[~done].reset_index(drop=True), h[-1]

        def many(f: pd.DataFrame) -> pd.DataFrame:
            """All rows of some short entities: their claims step from row to row together."""
            entity, claim, h, y, gap = f["entity_id"].to_numpy(), f["claim"].to_numpy(np.float64), f["h"].to_numpy(np.float64), f["y"].to_numpy(np.float64), f["gap"].fillna(False).to_numpy(bool)
            stop, at = _stops(entity), np.full(len(f), -1)
            live, total, ahead = np.flatnonzero(claim != 0), np.zeros(len(f)), 1
            while len(live := live[live + ahead < stop[live]]):
                to = live + ahead
                dy = y[to] - y[live]
                total[live] += (h[to] - h[live]) * dy
                back = (claim[live] * dy < 0) & (claim[live] * total[live] < 0)
                at[live[back]] = to[back]
                live, ahead = live[~back], ahead + 1
            met, hidden = at >= 0, np.where(at >= 0, gap[at], False)
            before = np.where(at - 1 > np.arange(len(f)), h[at - 1] - h, 0.0)  # an anchor's own row is at 0
            lower = np.where(claim == 0, 0.0, np.where(met, np.where(hidden, before, h[at] - h), h[stop - 1] - h))
            kind = np.where(claim == 0, "INCONCLUSIVE", np.where(met, np.where(hidden, "INTERVAL", "EXACT"), "RIGHT"))
            return f[["entity_id", *kept]].assign(kind=kind, lower=lower, upper=np.where(met, h[at] - h, np.nan))

        def right() -> pd.DataFrame:
            return standing[kept].assign(entity_id=key, kind="RIGHT", lower=last - standing["h"], upper=np.nan)[names]

        def each(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """What becomes of whole entities, short ones together and long ones by blocks."""
            nonlocal key, rows, standing, last
            if not len(f):
                return
            sizes = f.groupby("entity_id")["seq"].transform("size").to_numpy()
            if (sizes <= SHORT).any():
                yield many(f[sizes <= SHORT].reset_index(drop=True))
            for k, part in f[sizes > SHORT].groupby("entity_id", sort=False):
                key, standing, last = k, none, np.nan
                for a in range(0, len(part), 4096):
                    rows = [part.iloc[a : a + 4096]]
                    ended, standing, last = block()
                    yield ended
                yield right()
            key, rows, standing, last = None, [], none, np.nan

        held, size = [], 0  # rows of whole short entities, and the first ones of the last
        for batch in batches:
            if key is not None:  # a long entity goes on
                end = int(np.argmax(np.append(batch["entity_id"].to_numpy() != key, True)))
                own, batch = batch.iloc[:end], batch.iloc[end:]
                rows, waiting = ([*rows, own] if end else rows), waiting + end
                if len(batch):
                    if rows:
                        ended, standing, last = block()
                        yield ended
                    yield right()
                    key, rows, waiting, standing, last = None, [], 0, none, np.nan
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= AT_ONCE:
                f = pd.concat(held, ignore_index=True)
                edge = np.append(0, np.flatnonzero(np.diff(f["entity_id"].to_numpy())) + 1)
                long = len(f) - edge[-1] > SHORT
                yield from each(f.iloc[: edge[-1]])
                held, size = ([], 0) if long else ([f.iloc[edge[-1] :]], len(f) - edge[-1])
                if long:
                    key, rows, waiting = f["entity_id"].iloc[-1], [f.iloc[edge[-1] :]], len(f) - edge[-1]
            if waiting >= max(4096, len(standing) // 4):
                ended, standing, last = block()
                yield ended
                rows, waiting = [], 0
        if size:
            yield from each(pd.concat(held, ignore_index=True))
        if rows:
            ended, standing, last = block()
            yield ended
        if key is not None:
            yield right()

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = anchors.select("entity_id", "seq", F.col("claim").cast("double"), F.col("h").cast("double"), F.col("y").cast("double"), "gap", *carry)
    dealt = typed if in_order else typed.repartition(parts, "entity_id").sortWithinPartitions("entity_id", "h", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in typed.schema}
    return dealt.mapInPandas(run, "entity_id long, seq long, " + "".join(f"{k} {kinds[k]}, " for k in carry) + "kind string, lower double, upper double").withColumn("upper", F.nanvl("upper", F.lit(None).cast("double")))
