"""Exact top-k inner-product search by tiles.

Candidates are packed into matrix shards, queries into matrix tiles. Tiles are dealt into rows and shards into columns of a
grid; in a cell each tile meets each shard once, the product gives a partial selection of k per query, merged as shards
go by, and the cells' lists are merged as a tree. A tile is read once for each column and a shard once for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query tiles that one task holds, about.
TILES = 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """array<double> of floor(scale * component); null if the vector is null, empty, or has a null or non-finite component."""
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)), x)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, v) as matrices of at most size rows of one length: dim, n, ids, data."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, vectors = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "data": [np.array(vectors, np.float64).tobytes()]})

        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInPandas(pack, "dim int, ids binary, data binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions, per row, of the k highest scores, ties to the smaller id: a selection by score, then a full sort of all that reach its k-th."""
    if scores.shape[1] > 4 * k:
        cut = np.partition(scores, -k, axis=1)[:, -k]
        rows, at = np.nonzero(scores >= cut[:, None])
    else:
        rows, at = np.divmod(np.arange(scores.size), scores.shape[1])
    order = np.lexsort((ids[at], -scores[rows, at], rows))
    rows, at = rows[order], at[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return np.stack([rows[rank < k], at[rank < k]])


def product(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's id, score) of the k best candidates of each query, its own id left out."""
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        scores = q @ c.T
        scores[q_ids[:, None] == ids[None, :]] = -np.inf
        at = best(scores, ids, k)
        found = scores[at[0], at[1]]
        keep = np.isfinite(found)
        return at[0, keep], ids[at[1, keep]], found[keep].astype(np.int64)
    whole = q.astype(np.int64) @ c.astype(np.int64).T
    pairs = [(r, j) for r in range(len(q)) for j in sorted(np.flatnonzero(ids != q_ids[r]), key=lambda j: (-whole[r, j], ids[j]))[:k]]  # noqa: B023
    at = np.array(pairs, np.int64).reshape(-1, 2).T
    return at[0], ids[at[1]], whole[at[0], at[1]]


def merged(a: tuple | None, b: tuple, k: int) -> tuple:
    """The k best of each query of two partial lists."""
    if a is None:
        return b
    row, ids, score = (np.concatenate(c) for c in zip(a, b, strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard: int = 8192, tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with every row of another id.

    Vectors that are null or hold null or non-finite components, and rows of null id, take no part; vectors of another
    length than the query's are no candidates. Repeated rows are candidates each; a repeated query id is answered once,
    by its smallest vector. Products are exact below 2^53; beyond, they are computed in 64-bit integers.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), queries.alias("q")).where("id is not null and v is not null")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    session = vectors.sparkSession
    n_tiles = -(-asked.count() // tile)
    high = max(1, -(-n_tiles // TILES))
    wide = max(1, min(-(-vectors.count() // shard), -(-2 * int(session.conf.get("spark.sql.shuffle.partitions")) // high)))
    cell = lambda own, n: F.pmod(F.xxhash64(own), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = _packed(asked.select("id", "v").repartition(n_tiles or 1), tile)
    tiles = tiles.withColumn("y", F.monotonically_increasing_id()).withColumn("y", cell("y", high)).withColumn("x", every(wide)).withColumn("kind", F.lit(0))
    shards = _packed(rows.select("id", "v"), shard).withColumn("x", cell("ids", wide)).withColumn("y", every(high)).withColumn("kind", F.lit(1))
    grid = tiles.unionByName(shards).repartition(high * wide, "y", "x").sortWithinPartitions("y", "x", "kind")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, asked_here, lists = None, [], []

        def told() -> Iterator[pd.DataFrame]:
            for (q_ids, _), found in zip(asked_here, lists, strict=True):
                if found is not None:
                    yield pd.DataFrame({"query_id": q_ids[found[0]], "vec_id": found[1], "score": found[2]})

        for batch in batches:
            for dim, ids, data, y, x, kind in batch[["dim", "ids", "data", "y", "x", "kind"]].itertuples(index=False):
                if (y, x) != here:
                    yield from told()
                    here, asked_here, lists = (y, x), [], []
                ids, data = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)
                if kind == 0:
                    asked_here.append((ids, data))
                    lists.append(None)
                    continue
                for t, (q_ids, q) in enumerate(asked_here):
                    if q.shape[1] == dim:
                        lists[t] = merged(lists[t], product(q_ids, q, ids, data, k), k)
        yield from told()

    lists = grid.mapInPandas(partial, "query_id long, vec_id long, score long")
    order = (F.desc("score"), F.asc("vec_id"))
    part = lists.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "b").orderBy(*order))).where(F.col("rank") <= k)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
