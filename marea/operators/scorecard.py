"""Scores of a model's dimensions against what came after: each by the scorer of its kind, all from sums by block.

Ordinal dimensions are scored by rank correlation, agreement by the share of claims that came true, contrasts by the
difference of an outcome's incidence between two classes, censored ones by concordance with durations. Every kind comes
down to sums by block of time, from which the effect is taken, and its interval by drawing blocks anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .exact import bucket_of, cuts_of, finer
from .survival import concordances

_SUMS = ["n", "a", "b", "aa", "bb", "ab"]


def ordinal(records: DataFrame, pairs: dict[str, tuple[Column, Column]], block: str, buckets: int = 256) -> DataFrame:
    """Rank correlation of each pair (predictor, outcome). Ranks are those of all records, also where blocks are drawn anew.

    Records are dealt by buckets of the predictor, which gives its ranks, then with these by buckets of the outcome, and no
    join is made. Records of a value that many share are spread over tasks. records is read some times, so it should be kept.
    """
    marks = range(len(pairs))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    both = [(x.cast("double"), y.cast("double")) for x, y in pairs.values()]
    d = records.select(F.col(block).alias("block"), *[F.when(finite(x) & finite(y), v).alias(f"{n}{k}") for k, (x, y) in enumerate(both) for n, v in (("x", x), ("y", y))])
    cuts = dict(zip([f"{n}{k}" for n in "xy" for k in marks], cuts_of(d, [f"{n}{k}" for n in "xy" for k in marks], buckets), strict=True))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k in marks:
                own = f.loc[f[f"x{k}"].notna(), ["block", f"x{k}", f"y{k}"]].set_axis(["block", "x", "y"], axis=1).sort_values("x")  # neighbours alike take less room in shuffles
                x, y = own["x"].to_numpy() + 0.0, own["y"].to_numpy() + 0.0
                yield own.assign(k=k, xb=bucket_of(x, cuts[f"x{k}"]), yb=bucket_of(y, cuts[f"y{k}"]), x=x, y=y)[["k", "xb", "yb", "block", "x", "y"]]

    dealt = d.mapInPandas(deal, "k int, xb int, yb int, block long, x double, y double")
    c, sides = F.col, F.array(F.struct(F.lit("x").alias("side"), F.col("xb").alias("b")), F.struct(F.lit("y").alias("side"), F.col("yb").alias("b")))
    sizes = dealt.select("k", F.inline(sides)).groupBy("k", "side", "b").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("below", F.sum("m").over(Window.partitionBy("k", "side").orderBy("b")) - c("m")).persist()  # a row for each bucket

    def ranked(rows: DataFrame, side: str, value: str, name: str, salt: Column) -> DataFrame:
        """rows with the mean rank of value instead of it and its bucket."""
        at = sizes.where(c("side") == side).select("k", c("b").alias(f"{side}b"), "m", "below")
        own = Window.partitionBy("k", f"{side}b", "salt").orderBy(value)
        rows = finer(rows.withColumn("salt", F.when(c(f"{side}b") % 2 == 1, salt)), c("k"), c(f"{side}b"), c("salt"))
        until = F.count(F.lit(1)).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        placed = rows.withColumn("mean", (F.rank().over(own) + until) / 2).join(F.broadcast(at), ["k", f"{side}b"])
        rank = c("below") + F.when(c(f"{side}b") % 2 == 1, (c("m") + 1) / 2).otherwise(c("mean"))
        return placed.withColumn(name, rank).drop("mean", "salt", "m", "below", f"{side}b", value)

    r = ranked(dealt, "x", "x", "a", F.pmod(F.xxhash64("y", "block"), F.lit(64)))
    r = ranked(r, "y", "y", "b", F.pmod(F.xxhash64("a"), F.lit(64)))
    one, a, b = F.lit(1.0), c("a"), c("b")
    sums = r.groupBy("k", "block").agg(*[F.sum(e).alias(n) for n, e in zip(_SUMS, (one, a, b, a * a, b * b, a * b), strict=True)])
    return sums.withColumns({"dimension": F.element_at(F.array(*map(F.lit, pairs)), c("k") + 1), "kind": F.lit("ordinal")}).drop("k")


def agreement(records: DataFrame, pairs: dict[str, tuple[Column, Column]], block: str) -> DataFrame:
    """How often a claim's sign and the outcome's agree, where neither is 0, less one half."""
    parts = [records.select(F.lit(k).alias("dimension"), F.col(block).alias("block"), (F.signum(x) * F.signum(y)).alias("s")) for k, (x, y) in pairs.items()]
    d = reduce(DataFrame.unionByName, parts).where("s <> 0")
    return d.groupBy("dimension", "block").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("s") > 0).cast("double")).alias("a")).withColumn("kind", F.lit("agreement"))


def contrast(records: DataFrame, pairs: dict[str, tuple[Column, str, str, Column]], block: str) -> DataFrame:
    """Incidence of an outcome in the second class less that in the first: (class, first, second, outcome)."""
    one = lambda c: F.sum(F.coalesce(c.cast("double"), F.lit(0.0)))
    parts = [records.groupBy(F.lit(k).alias("dimension"), F.col(block).alias("block")).agg(one(c == u).alias("n"), one((c == u) & o).alias("a"), one(c == v).alias("b"), one((c == v) & o).alias("ab")) for k, (c, u, v, o) in pairs.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("kind", F.lit("contrast"))


def censored(records: DataFrame, predictors: dict[str, Column], block: str) -> tuple[DataFrame, DataFrame]:
    """(whole, by block): pairs and score of each predictor with the records' durations (kind, lower, upper), over all records, and of pairs inside a block. records is read some times."""
    d = records.where("kind <> 'INCONCLUSIVE'").select(F.col(block).alias("block"), "kind", "lower", "upper", *[x.cast("double").alias(k) for k, x in predictors.items()])
    whole, own = concordances(d, list(predictors), "block", "kind", "lower", "upper")
    own = own.select(F.col("predictor").alias("dimension"), "block", F.col("pairs").cast("double").alias("n"), F.col("score").alias("a"))
    return whole.withColumnRenamed("predictor", "dimension"), own.withColumn("kind", F.lit("censored"))


def _effect() -> Column:
    n, a, b, aa, bb, ab = (F.sum(F.coalesce(c, F.lit(0.0)) * F.col("times")) for c in _SUMS)
    spread = lambda s, ss: n * ss - s * s
    ranks = F.try_divide(n * ab - a * b, F.sqrt(F.greatest(F.lit(0.0), spread(a, aa) * spread(b, bb))))
    kind = F.first("kind")
    return F.when(kind == "ordinal", ranks).when(kind == "contrast", F.try_divide(ab, b) - F.try_divide(a, n)).otherwise(F.try_divide(a, n) - 0.5)


def effects(sums: DataFrame) -> DataFrame:
    """dimension, kind, blocks and effect from sums by block."""
    full = sums.select("dimension", "kind", "block", *[F.col(c) if c in sums.columns else F.lit(None).cast("double").alias(c) for c in _SUMS]).withColumn("times", F.lit(1.0))
    return full.groupBy("dimension").agg(F.first("kind").alias("kind"), F.countDistinct("block").alias("blocks"), _effect().alias("effect"))


def evidence(sums: DataFrame, replicates: int = 400, seed: int = 11) -> DataFrame:
    """dimension, kind, blocks, effect, lo, hi, failures, support and evidence; lo to hi is the 95 % percentile interval over blocks drawn anew.

    Draws come from hashes of (seed, replicate, draw), so a task run again draws the same.
    """
    own = Window.partitionBy("dimension")
    sums = sums.persist()  # a row for each dimension and block, read by the effects and twice by the draws
    full = sums.select("dimension", "kind", "block", *_SUMS).withColumns({"at": F.row_number().over(own.orderBy("block")) - 1, "blocks": F.count(F.lit(1)).over(own)})
    draws = full.select("dimension", "blocks", F.col("at").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    draws = draws.groupBy("dimension", "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), "blocks").cast("int").alias("at")).agg(F.count(F.lit(1)).cast("double").alias("times"))
    drawn = draws.join(full, ["dimension", "at"]).groupBy("dimension", "rep").agg(_effect().alias("x"))
    spread = drawn.groupBy("dimension").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("x").isNull()).alias("failures"))
    made = effects(sums).join(spread, "dimension").withColumns({"lo": F.col("q")[0], "hi": F.col("q")[1]}).drop("q").withColumn("support", S.support_label(F.col("blocks")))
    return made.withColumn("evidence", S.evidence_class(F.col("effect"), F.col("lo"), F.col("hi"), F.col("support")))


def together(*parts: DataFrame) -> DataFrame:
    """Sums of all kinds in one table."""
    fill = [p.select("dimension", "kind", "block", *[F.col(c).cast("double").alias(c) if c in p.columns else F.lit(None).cast("double").alias(c) for c in _SUMS]) for p in parts]
    return reduce(DataFrame.unionByName, fill)
