"""Window operators over an entity's ordered rows. All look back only, except those named for what lies ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(*keys: str, by: tuple[str, ...] = ("seq",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)



def full_window(agg: Column, rows: int, spec: WindowSpec | None = None) -> Column:
    """An aggregate over the last rows rows, null until there are so many."""
    spec = spec or along("entity_id")
    return F.when(F.row_number().over(spec) >= rows, agg.over(spec.rowsBetween(1 - rows, 0)))


def prior(agg: Column, rows: int, spec: WindowSpec | None = None) -> Column:
    """An aggregate over the rows rows before the current one."""
    return agg.over((spec or along("entity_id")).rowsBetween(-rows, -1))


def ahead(agg: Column, rows: int, spec: WindowSpec | None = None) -> Column:
    """An aggregate over the next rows rows: labels for evaluation, never features."""
    return agg.over((spec or along("entity_id")).rowsBetween(1, rows))


def with_runs(df: DataFrame, state: str, keys: tuple[str, ...] = ("entity_id",), by: tuple[str, ...] = ("seq",), apart: Column | None = None) -> DataFrame:
    """df with run, numbering stretches of equal state; apart breaks a run too. Nulls are a state."""
    spec = along(*keys, by=by)
    same = F.col(state).eqNullSafe(F.lag(state).over(spec)) & (F.row_number().over(spec) > 1)
    cut = ~same | apart if apart is not None else ~same
    return df.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(1))).withColumn("run", F.sum("_cut").over(spec.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def persistence(condition: Column, spec: WindowSpec | None = None) -> Column:
    """How many rows up to this one the condition has held without a break."""
    spec = spec or along("entity_id")
    at = F.row_number().over(spec)
    broken = F.max(F.when(~F.coalesce(condition, F.lit(False)), F.col("seq"))).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    return at - F.coalesce(broken, F.lit(0))


def quadratic_fit(df: DataFrame, y: str, t: str, rows: int, spec: WindowSpec | None = None) -> DataFrame:
    """df with d1 and d2, the derivatives at the current row of a least-squares parabola over the last rows rows.

    Closed form over times relative to the current row; null before the window is full or where times don't determine it.
    """
    spec = spec or along("entity_id")
    frame = spec.rowsBetween(1 - rows, 0)
    points = F.collect_list(F.struct(F.col(t).alias("t"), F.col(y).alias("y"))).over(frame)
    df = df.withColumn("_p", F.when(F.row_number().over(spec) >= rows, points))
    names = ("_n", "_x", "_xx", "_xxx", "_xxxx", "_y", "_xy", "_xxy")

    def add(s, p):  # all sums in one pass over the window
        x, v = p["t"] - F.col(t), p["y"]
        return F.struct(*[(s[k] + z).alias(k) for k, z in zip(names, (F.lit(1.0), x, x * x, x * x * x, x * x * x * x, v, x * v, x * x * v), strict=True)])

    df = df.withColumn("_s", F.aggregate("_p", F.struct(*[F.lit(0.0).alias(k) for k in names]), add))
    sums = {k: F.col(f"_s.{k}") for k in names}
    n, a, b, c, d, p, q, r = sums.values()
    det = n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)
    one = n * (q * d - c * r) - p * (a * d - b * c) + b * (a * r - b * q)
    two = n * (b * r - q * c) - a * (a * r - q * b) + p * (a * c - b * b)
    good = F.abs(det) > 0
    return df.withColumns({"d1": F.when(good, one / det), "d2": F.when(good, 2 * two / det)}).drop("_p", "_s")


def crossings(x: Column, spec: WindowSpec | None = None) -> Column:
    """LOWER where x rises through 0, UPPER where it falls through 0, else null."""
    before = F.lag(x).over(spec or along("entity_id"))
    return F.when((before < 0) & (x >= 0), "LOWER").when((before > 0) & (x <= 0), "UPPER")


def drawdown(df: DataFrame, gain: str, keys: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """df with the running total of gain, its peak (0 at least) and the fall from it."""
    spec = along(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("total", F.sum(gain).over(spec))
    df = df.withColumn("peak", F.greatest(F.lit(0), F.max("total").over(spec)))
    return df.withColumn("drawdown", F.col("peak") - F.col("total"))
