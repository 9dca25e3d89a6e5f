"""As-of joins by union and carry: one shuffle by key, no range join, so a hot moment never meets another in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, forward: bool = False, strict: bool = False, at: str = "at") -> DataFrame:
    """left with value and time (as at) of the last right row not after its time, or first not before it.

    strict leaves out equal times. Of right rows of one time the last, or first, by value counts. Null where there is none.
    """
    kind = F.lit(0 if strict != forward else 1)
    right_kind = F.lit(1 if strict != forward else 0)
    extra = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.struct(*extra).alias("_l"), kind.alias("_k"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(True).alias("_left"))
    b = right.select(key, time, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), right_kind.alias("_k"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    spec = Window.partitionBy(key).orderBy(time, "_k", "_v")
    found = F.when(~F.col("_left"), F.struct(F.col("_v").alias("v"), F.col(time).alias("t")))
    if forward:
        got = F.first(found, ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    else:
        got = F.last(found, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_f", got).where("_left")
    return both.select(key, time, *[F.col(f"_l.{c}").alias(c) for c in extra], F.col("_f.v").alias(value), F.col("_f.t").alias(at))
