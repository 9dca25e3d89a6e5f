"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="marea-shared-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Lets Arrow batches hold so many rows and about so many bytes at most, in this session from now on: texts may be long, and a worker holds a batch several times over."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, str(rows))
    spark.conf.set(_BYTES, str(size))


def released() -> None:
    """Gives what a Python worker has freed back to the system, where the C library can: workers are kept and soon do other work."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marea-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the table stands for the result: what was shuffled for it can go at once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def likely(rows: DataFrame, column: str, wanted: DataFrame, bits: int = 1 << 22, keep_rest: str | None = None) -> DataFrame:
    """The rows whose column is among that column of wanted, and a few others, before a join that shuffles them; or, with keep_rest, all rows and which they are as a column of that name.

    A bitmap of hashed values is broadcast: bits / 64 rows at most, whatever the input. Where it is full it spares nothing.
    """
    own, block, mask = fresh(rows, "slot", "block", "marks")
    slot = F.pmod(F.xxhash64(F.col(column), F.lit(1)), F.lit(bits))
    marks = wanted.select(slot.alias("s")).select(F.floor(F.col("s") / 64).alias(block), F.expr("shiftleft(1L, CAST(s % 64 AS INT))").alias("bit"))
    marks = marks.groupBy(block).agg(F.bit_or("bit").alias(mask))
    known = rows.withColumn(own, slot).withColumn(block, F.floor(F.col(own) / 64)).join(F.broadcast(marks), block, "left" if keep_rest else "inner")
    hit = F.expr(f"shiftrightunsigned(`{mask}`, CAST(`{own}` % 64 AS INT)) & 1 = 1")
    if keep_rest:
        return known.withColumn(keep_rest, F.coalesce(hit, F.lit(False))).drop(own, block, mask)
    return known.where(hit).drop(own, block, mask)


#: Keys that may be hot, at most; each has at least so many rows.
MOST_HOT, LEAST_HOT = 10_000, 1_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined by key with table, which has one row per key and n, how many of the rows have it; n is not returned.

    A key with more than a MOST_HOT-th of all rows (LEAST_HOT at least) is dealt into parts of about so many rows, and its
    row of table is repeated for each. Such keys, fewer than MOST_HOT by counting, are broadcast with their numbers of
    parts; both sides are then shuffled once.
    """
    bound = max(LEAST_HOT, -(-total // MOST_HOT))
    parts, part = fresh(rows, "parts", "part")
    sized = table.withColumn(parts, F.ceil(F.col("n") / bound).cast("int")).drop("n")
    hot = sized.where(F.col(parts) > 1).select(key, parts)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    return dealt.join(sized.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts), [key, part], how).drop(part)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has one of them, whatever the case."""
    known, mark = {c.lower() for c in df.columns}, "__"
    while any(f"{mark}{n}".lower() in known for n in names):
        mark += "_"
    return [mark + n for n in names]


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        for uri in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            store, path = filesystem(uri)
            store.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file of any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
