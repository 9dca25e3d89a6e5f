"""Concordance of censored durations, by merging counts over ranges, and block bootstrap, from counts rather than pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import bucket_of, cuts_of, finer


def later_and_larger(t: np.ndarray, p: np.ndarray, k: np.ndarray, m: np.ndarray) -> int:
    """Sum of k[i] m[j] over t[j] > t[i], twice where p[j] > p[i] and once where equal; n log n sorted look-ups.

    Two ranks of t differ first in one bit, which the later one has: each bit's groups meet once, ordered by p.
    """
    rank, size = np.unique(t, return_inverse=True)[1], np.unique(p, return_inverse=True)[1]
    width, total = int(size.max(initial=0)) + 1, 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        later, group = (rank >> bit & 1).astype(bool), (rank >> bit + 1) * width
        points, events = later & (m > 0), ~later & (k > 0)
        at = group[points] + size[points]
        order = np.argsort(at, kind="stable")
        at, sums = at[order], np.concatenate([[0], np.cumsum(m[points][order])])
        own = group[events] + size[events]
        above, below = sums[np.searchsorted(at, own, "right")], sums[np.searchsorted(at, own)]
        twice = 2 * (sums[np.searchsorted(at, group[events] + width)] - above) + above - below
        total += int((k[events] * twice).sum())
    return total


def concordance(df: DataFrame, key: str, predictor: str, kind: str, lower: str, upper: str) -> DataFrame:
    """key, pairs, score, concordance: how often, of two durations known to differ, the longer one has the larger predictor (equal: half).

    A duration is EXACT (lower), INTERVAL (up to upper) or RIGHT (at least lower). One pair is comparable if one ends
    before the other's lower; equal exact durations count half. Rows with null predictor or lower take no part; a key
    with exact durations but no comparable pairs has null, one without either has no row.

    Rows are counted by distinct values and dealt into ranges of (key, time), then of (key, predictor). Two values meet in
    one range of time, or in one range of predictors at different times, or in the grid of ranges, each time by sorted
    look-ups in n log n; no join is made. A time that many rows share is a range of its own, in which none meet. A task
    holds a range, or the grid of one key, whose sides are as long as there are shuffle partitions and such times.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.where(F.col(predictor).isNotNull() & F.col(lower).isNotNull()).select(F.col(key).alias("key"), F.col(predictor).cast("double").alias("p"), F.col(kind).alias("kind"), F.col(lower).cast("double").alias("low"), F.when(F.col(kind) == "EXACT", F.col(lower)).when(F.col(kind) == "INTERVAL", F.col(upper)).cast("double").alias("end"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = F.array(F.struct(F.col("low").alias("t"), zero.alias("k"), one.alias("m")), F.struct(F.col("end").alias("t"), one.alias("k"), zero.alias("m")))
    counted = d.select("key", "p", F.inline(sides)).where("t IS NOT NULL").groupBy("key", "p", "t").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    counted = counted.persist()
    total = counted.count()
    often = counted.groupBy("key", "t").count().where(F.col("count") > max(1000, total // (4 * parts)))  # 4 x parts at most
    hot = often.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("hot"))
    ranged = counted.repartitionByRange(parts, "key", "t").withColumn("part", F.spark_partition_id()).join(F.broadcast(hot), "key", "left")
    place = F.coalesce(F.size(F.filter("hot", lambda x: x < F.col("t"))) * 2 + F.array_contains("hot", F.col("t")).cast("int"), F.lit(0))
    timed = ranged.withColumns({"place": place, "alone": F.coalesce(F.array_contains("hot", F.col("t")), F.lit(False))}).drop("hot")
    timed = timed.withColumn("tb", F.col("part").cast("long") * (8 * parts + 2) + F.col("place")).drop("part", "place").persist()
    by_p = timed.groupBy("key", "p", "tb").agg(F.sum("k").alias("k"), F.sum("m").alias("m")).repartitionByRange(parts, "key", "p").withColumn("pb", F.spark_partition_id()).persist()
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}
    schema = f"key {kinds['key']}, halves long"

    def halves(t: str, p: str):
        def count(rows: pd.DataFrame) -> pd.DataFrame:
            made = later_and_larger(*(rows[c].to_numpy() for c in (t, p, "k", "m")))
            return pd.DataFrame({"key": rows["key"].iloc[:1], "halves": [made]})

        return count

    def above(rows: pd.DataFrame) -> pd.DataFrame:
        """As halves over the grid, without the pairs of one range of predictors."""
        t, p, k, m = (rows[c].to_numpy() for c in ("tb", "pb", "k", "m"))
        same = sum(later_and_larger(t[p == x], p[p == x], k[p == x], m[p == x]) for x in np.unique(p))
        return pd.DataFrame({"key": rows["key"].iloc[:1], "halves": [later_and_larger(t, p, k, m) - same]})

    inside = timed.where(~F.col("alone")).groupBy("key", "tb").applyInPandas(halves("t", "p"), schema)
    beside = by_p.groupBy("key", "pb").applyInPandas(halves("tb", "p"), schema)
    grid = by_p.groupBy("key", "tb", "pb").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    apart = grid.groupBy("key").applyInPandas(above, schema)
    won = inside.unionByName(beside).unionByName(apart).groupBy("key").agg(F.sum("halves").alias("halves"))
    by_time = timed.groupBy("key", "tb", "t").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    in_block = Window.partitionBy("key", "tb").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_time.withColumn("after", F.sum("m").over(in_block)).groupBy("key", "tb").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.coalesce(F.sum(F.col("k") * F.col("after")), F.lit(0)).alias("own"))
    beyond = F.sum("m").over(Window.partitionBy("key").orderBy(F.desc("tb")).rowsBetween(Window.unboundedPreceding, -1))
    met = blocks.withColumn("beyond", F.coalesce(beyond, F.lit(0))).groupBy("key").agg(F.sum(F.expr("own + k * beyond")).alias("pairs"))
    ties = d.where("kind = 'EXACT'").groupBy("key", "low").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("ties"))
    kinds_met = d.where("kind IN ('EXACT', 'INTERVAL', 'RIGHT')").select("key").distinct()
    both = kinds_met.join(met, "key", "left").join(won, "key", "left").join(ties, "key", "left").where("pairs > 0 OR ties IS NOT NULL").fillna(0, ["pairs", "halves", "ties"])
    both = both.select(F.col("key").alias(key), (F.col("pairs") + F.col("ties")).alias("pairs"), ((F.col("halves") + F.col("ties")) / 2).alias("score"))
    return both.withColumn("concordance", F.try_divide("score", F.when(F.col("pairs") > 0, F.col("pairs"))))


def later_pairs(t: np.ndarray, k: np.ndarray, m: np.ndarray) -> int:
    """Sum of k[i] m[j] over t[j] > t[i]."""
    order = np.argsort(t, kind="stable")
    sums = np.concatenate([[0], np.cumsum(m[order])])
    return int((k * (sums[-1] - sums[np.searchsorted(t[order], t, "right")])).sum())


def concordances(df: DataFrame, predictors: list[str], block: str, kind: str, lower: str, upper: str) -> tuple[DataFrame, DataFrame]:
    """(predictor, pairs, score, concordance) over all rows and (predictor, block, pairs, score) of pairs inside a block: as `concordance` of each predictor, and of each predictor and block.

    For many rows: a row is dealt once into buckets of time, with all predictors, and once for each predictor into buckets of its
    values, and both serve the whole and the blocks. A value that many rows share is a bucket of its own: such times are only
    counted, such predictors counted before they are dealt. df is read some times, so it should be kept. Predictors that are not
    a number count as missing.
    """
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = range(len(predictors))
    names = [f"p{d}" for d in marks]
    c = F.col
    end = F.when(c(kind) == "EXACT", c(lower)).when(c(kind) == "INTERVAL", c(upper))
    rows = df.where(c(lower).isNotNull() & c(block).isNotNull()).select(c(block).cast("long").alias("block"), c(lower).cast("double").alias("low"), end.cast("double").alias("end"), (c(kind) == "EXACT").alias("exact"), c(kind).isin("EXACT", "INTERVAL", "RIGHT").alias("told"), *[c(p).cast("double").alias(n) for p, n in zip(predictors, names, strict=True)])
    t_cuts, *p_cuts = cuts_of(rows, ["low", *names], parts)

    def sides(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their times, k, m): exact ones, which end where they begin to be outlived, then starts and ends of the others."""
        low, last, exact = f["low"].to_numpy(np.float64) + 0.0, f["end"].to_numpy(np.float64) + 0.0, f["exact"].fillna(False).to_numpy(bool)
        for at, t, k, m in ((exact, low, 1, 1), (~exact, low, 0, 1), (~exact & ~np.isnan(last), last, 1, 0)):
            yield np.flatnonzero(at), t[at], np.full(at.sum(), k), np.full(at.sum(), m)

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for at, t, k, m in sides(f):
                tb = bucket_of(t, t_cuts)
                made = f.iloc[at][["block", *names]].assign(tb=tb, t=t, side=(2 * k + m).astype(np.int32))
                yield made[tb % 2 == 0][["tb", "t", "side", "block", *names]].sort_values("t")  # neighbours alike take less room in shuffles

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Exact rows of times that many share, counted for each predictor."""
        for f in batches:
            at, t, _, _ = next(sides(f))
            tb, own = bucket_of(t, t_cuts), f.iloc[at]
            for d in marks:
                hot = (tb % 2 == 1) & own[names[d]].notna().to_numpy()
                yield pd.DataFrame({"d": d, "tb": tb[hot], "block": own["block"].to_numpy()[hot], "c": 1}).groupby(["d", "tb", "block"], as_index=False)["c"].sum()

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, few = ["d", "pb", "p", "tb", "block"], []

        def counted() -> pd.DataFrame:
            return pd.concat(few).groupby(keys, as_index=False)[["k", "m"]].sum()

        for f in batches:
            for at, t, k, m in sides(f):
                tb, own = bucket_of(t, t_cuts), f.iloc[at]
                for d in marks:
                    p = own[names[d]].to_numpy(np.float64) + 0.0
                    there = ~np.isnan(p)
                    made = pd.DataFrame({"d": d, "pb": bucket_of(p[there], p_cuts[d]), "p": p[there], "tb": tb[there], "block": own["block"].to_numpy()[there], "k": k[there], "m": m[there]})
                    often = made["pb"].to_numpy() % 2 == 1
                    few.append(made[often])
                    yield made[~often].sort_values("p")
            if sum(map(len, few)) > 100_000:
                few = [counted()]
                if len(few[0]) > 50_000:
                    yield few.pop()
        if few:
            yield counted()

    def over(f: pd.DataFrame, d: int) -> Iterator[tuple[int | None, pd.DataFrame]]:
        """All rows with predictor d, and those of each block."""
        yield None, f
        yield from f.groupby("block")

    def made_of(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["d", "block", "halves", "pairs", "ties", "exact"]).astype({"block": "Int64"})

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        for d in marks:
            for b, own in over(f[f[names[d]].notna()], d):
                t, p, side = own["t"].to_numpy(), own[names[d]].to_numpy(), own["side"].to_numpy()
                k, m = side // 2, side % 2
                often = np.unique(t[side == 3], return_counts=True)[1].astype(np.int64)
                found.append((d, b, later_and_larger(t, p, k, m), later_pairs(t, k, m), int((often * (often - 1) // 2).sum()), int(often.sum())))
        return made_of(found)

    def beside(f: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one bucket of a predictor at different times, and the grid's cells of that bucket."""
        d, pb = int(f["d"].iloc[0]), int(f["pb"].iloc[0])
        found = [(d, b, later_and_larger(*(own[c].to_numpy() for c in ("tb", "p", "k", "m"))), None, 0, 0, 0) for b, own in over(f, d)]
        cells = f.groupby(["block", "tb"], as_index=False)[["k", "m"]].sum()
        cells = cells.assign(d=d, pb=pb, halves=0)[["d", "block", "halves", "tb", "pb", "k", "m"]]
        halves = pd.DataFrame(found, columns=["d", "block", "halves", "tb", "pb", "k", "m"]).astype({"block": "Int64", "tb": "Int64"})
        return pd.concat([halves, cells.astype({"block": "Int64", "tb": "Int64"})])

    def apart(f: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different buckets of the predictor, and all pairs of different buckets of time."""
        t, p, k, m = (f[c].to_numpy() for c in ("tb", "pb", "k", "m"))
        same = sum(later_pairs(t[p == x], k[p == x], m[p == x]) for x in np.unique(p))
        b = f["block"].iloc[0]
        return made_of([(int(f["d"].iloc[0]), None if pd.isna(b) else int(b), later_and_larger(t, p, k, m) - same, later_pairs(t, k, m), 0, 0)])

    schema = "d int, block long, halves long, pairs long, ties long, exact long"
    listed = ", ".join(f"{n} double" for n in names)
    near = finer(rows.where("told").mapInPandas(timed, f"tb int, t double, side int, block long, {listed}"), c("tb")).groupBy("tb").applyInPandas(inside, schema)
    dealt = rows.where("told").mapInPandas(valued, "d int, pb int, p double, tb int, block long, k long, m long")
    met = finer(dealt, c("d"), c("pb")).groupBy("d", "pb").applyInPandas(beside, "d int, block long, halves long, tb int, pb int, k long, m long").persist()  # cells, bounded by the numbers of buckets and blocks
    cells = met.where("tb IS NOT NULL").select("d", "block", "tb", "pb", "k", "m")
    cells = cells.unionByName(cells.groupBy("d", "tb", "pb").agg(F.sum("k").alias("k"), F.sum("m").alias("m")).withColumn("block", F.lit(None).cast("long")))
    far = cells.groupBy("d", "block").applyInPandas(apart, schema)
    often = rows.where("told").mapInPandas(shared, "d int, tb int, block long, c long").groupBy("d", "tb", "block").agg(F.sum("c").alias("c"))
    often = often.unionByName(often.groupBy("d", "tb").agg(F.sum("c").alias("c")).withColumn("block", F.lit(None).cast("long")))
    none = F.lit(0).cast("long")
    parts_ = [near, far, met.where("tb IS NULL").select("d", "block", "halves", none.alias("pairs"), none.alias("ties"), none.alias("exact")), often.select("d", "block", none.alias("halves"), none.alias("pairs"), F.expr("c * (c - 1) div 2").alias("ties"), c("c").alias("exact"))]
    sums = reduce(DataFrame.unionByName, parts_).groupBy("d", "block").agg(*[F.sum(x).alias(x) for x in ("halves", "pairs", "ties", "exact")]).where("pairs > 0 OR exact > 0").persist()  # a row for each predictor and block
    told = sums.select(F.element_at(F.array(*map(F.lit, predictors)), c("d") + 1).alias("predictor"), "block", (c("pairs") + c("ties")).alias("pairs"), ((c("halves") + c("ties")) / 2).alias("score"))
    return told.where("block IS NULL").drop("block").withColumn("concordance", F.try_divide("score", F.when(c("pairs") > 0, c("pairs")))), told.where("block IS NOT NULL")


def block_bootstrap(df: DataFrame, key: str, block: str, value: Column, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """key, blocks, mean, lo, hi: the mean of value and its 95 % percentile interval over resampled blocks.

    Each replicate draws as many of a key's blocks as it has, with replacement. Only sums and counts of blocks are
    resampled; draws come from hashes of (seed, replicate, draw), so that a task run again draws the same.
    """
    sums = df.groupBy(key, block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    own = Window.partitionBy(key)
    numbered = sums.withColumns({"b": F.row_number().over(own.orderBy(block)) - 1, "blocks": F.count(F.lit(1)).over(own)})
    draws = numbered.select(key, "blocks", F.col("b").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    draws = draws.select(key, "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), "blocks").cast("int").alias("b"))
    means = draws.groupBy(key, "rep", "b").agg(F.count(F.lit(1)).alias("times")).join(numbered, [key, "b"]).groupBy(key, "rep").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("mean"))
    spread = means.groupBy(key).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = sums.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), (F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(spread, key).select(key, "blocks", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
