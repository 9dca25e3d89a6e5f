"""Exact quantiles and ranks of groups of any size, from counts of values: no group is held in one place.

Values are counted per group, which Spark does before it shuffles. A bounded sketch of all values gives cut points, the
counts between them give each bucket's place in its group, and only inside buckets are values put in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(df: DataFrame, keys: list[str], value: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(keys, v, n, b) counts of distinct values in buckets, and (keys, b, m, below, total) of the buckets."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [k / buckets for k in range(1, max(2, buckets))], 10_000).alias("cuts"))  # one row of buckets - 1 values
    placed = counts.join(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = placed.groupBy(*keys, "b").agg(F.sum("n").alias("m"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return placed, sums.withColumns({"below": F.sum("m").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"), "total": F.sum("m").over(own)})


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], buckets: int = 64) -> DataFrame:
    """keys and a column for each name of at: the linearly interpolated quantile of value in the group; nulls don't count.

    Groups in which all values are null have no row. Keys may be null.
    """
    placed, sums = _placed(df, keys, value, buckets)
    wanted = sums.select(*keys, "b", "m", "below", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos")) for k, p in at.items()])).alias("q")).select(*keys, "b", "m", "below", "q.*")
    wanted = wanted.withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")})
    inside = lambda x: (F.col(x) >= F.col("below")) & (F.col(x) < F.col("below") + F.col("m"))
    wanted = wanted.where(inside("lo") | inside("hi")).withColumnsRenamed({k: f"_{k}" for k in keys} | {"b": "_b"})
    same = F.col("b") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, "b", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(wanted, same).withColumn("until", F.col("below") + F.sum("n").over(own)).withColumn("since", F.col("until") - F.col("n"))
    holds = lambda x: F.max(F.when((F.col(x) >= F.col("since")) & (F.col(x) < F.col("until")), F.col("v")))
    found = met.groupBy(*keys, "name").agg(holds("lo").alias("a"), holds("hi").alias("z"), F.first("pos").alias("pos"), F.first("lo").alias("lo"))
    found = found.withColumn("x", F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - F.col("lo")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in at])


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, buckets: int = 64) -> DataFrame:
    """(keys, value, name): the rank of each distinct value in its group, ties at their mean."""
    placed, sums = _placed(df, keys, value, buckets)
    own = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.join(sums.select(*keys, "b", "below"), [*keys, "b"]).withColumn("until", F.col("below") + F.sum("n").over(own))
    return at.select(*keys, F.col("v").alias(value), (F.col("until") - (F.col("n") - 1) / 2).alias(name))


def cuts_of(df: DataFrame, columns: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column cut points that part its values into about even buckets, and which of them so many rows share that they are a bucket alone."""
    at = [k / buckets for k in range(1, buckets)]
    row = df.agg(*[F.percentile_approx(F.col(c) + 0.0, at, 16 * buckets).alias(c) for c in columns]).first()  # buckets - 1 values a column
    made = []
    for c in columns:
        cuts, n = np.unique(np.array([x for x in row[c] or [] if x == x], np.float64), return_counts=True)
        made.append((cuts, n > 1))
    return made


def bucket_of(v: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each value's bucket, rising with the values; odd buckets hold one value that many rows share."""
    points, often = cuts
    if not len(points):
        return np.zeros(len(v), np.int32)
    i = np.searchsorted(points, v)
    at = np.minimum(i, len(points) - 1)
    return (2 * i + ((points[at] == v) & often[at])).astype(np.int32)


def finer(df: DataFrame, *keys: Column) -> DataFrame:
    """df dealt by keys into more partitions than usual, so that a task sorts its rows in memory."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, min(8 * parts, 256)), *keys)
