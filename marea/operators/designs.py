"""Independence and condition of a design's columns, from the matrix of their products: one pass of partial sums, whatever the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, n and a_b, the sum of products of columns a and b (a not after b); rows with a null in any column are left out."""
    known = df.dropna(subset=columns)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]])


def independent(gram: np.ndarray, tolerance: float = 1e-9) -> tuple[list[int], dict[int, int]]:
    """The columns that those before don't span, in order; and for each other column the one that it depends on most.

    What is left of a column after projection on those kept is a share of its own square; below tolerance it is spanned.
    """
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    kept: list[int] = []
    depends: dict[int, int] = {}
    for j in range(len(gram)):
        if not scale[j]:
            depends[j] = -1
            continue
        own = gram[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])
        cross = gram[kept, j] / (scale[kept] * scale[j])
        weights = np.linalg.lstsq(own, cross, rcond=None)[0] if kept else np.empty(0)
        if 1 - cross @ weights > tolerance:
            kept.append(j)
        else:
            depends[j] = kept[int(np.abs(weights).argmax())]
    return kept, depends


def report(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, n, n_columns, matrix_rank, rank_deficiency, retained, excluded, depends, condition and singular values of each group's design.

    The condition is that of the kept columns at unit length. A group is one row of sums, so groups are worked on in tasks.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def work(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                gram = np.zeros((len(columns),) * 2)
                for i, j in pairs:
                    gram[i, j] = gram[j, i] = row[f"{columns[i]}_{columns[j]}"]
                kept, depends = independent(gram)
                scale = np.sqrt(np.diag(gram)[kept])
                values = np.linalg.eigvalsh(gram[np.ix_(kept, kept)] / np.outer(scale, scale)) if kept else np.array([0.0])
                condition = float(np.sqrt(values[-1] / values[0])) if values[0] > 0 else float("inf")
                singular = np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0))
                batch_row = {key: row[key], "n": row["n"], "n_columns": len(columns), "matrix_rank": len(kept), "rank_deficiency": len(columns) - len(kept), "retained": ";".join(columns[i] for i in kept), "excluded": ";".join(columns[i] for i in depends)}
                yield pd.DataFrame([batch_row | {"depends": {columns[i]: columns[d] if d >= 0 else "" for i, d in depends.items()}, "condition": condition, "smallest": float(singular[0]), "largest": float(singular[-1])}])

    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n long, n_columns int, matrix_rank int, rank_deficiency int, retained string, excluded string, depends map<string,string>, condition double, smallest double, largest double"
    return moments(df, columns, [key]).mapInPandas(work, out)


def groups_of(gram: np.ndarray, tolerance: float = 1e-9, least: float = 1e-6) -> list[list[int]]:
    """Groups of columns tied by linear dependencies: each spanned column with those of the kept ones that it takes part of; groups that share a column are one.

    A kept column counts if it makes least of the spanned one's length or more. A column of zeros is in no group.
    """
    kept, depends = independent(gram, tolerance)
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    leader = list(range(len(gram)))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for j in (j for j, d in depends.items() if d >= 0):
        before = [i for i in kept if i < j]
        own = gram[np.ix_(before, before)] / np.outer(scale[before], scale[before])
        weights = np.linalg.lstsq(own, gram[before, j] / (scale[before] * scale[j]), rcond=None)[0]
        for i in np.flatnonzero(np.abs(weights) >= least).tolist():
            a, b = find(before[i]), find(j)
            leader[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for i in range(len(gram)):
        found.setdefault(find(i), []).append(i)
    return [g for g in found.values() if len(g) > 1]


def dependency_groups(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, n, dependency (from 1), members, n_members and surplus (members beyond their rank) of each group of tied columns, by key; keys without any have no row."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def work(batches):
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                gram = np.zeros((len(columns),) * 2)
                for i, j in pairs:
                    gram[i, j] = gram[j, i] = row[f"{columns[i]}_{columns[j]}"]
                for n, group in enumerate(groups_of(gram), 1):
                    rank = len(independent(gram[np.ix_(group, group)])[0])
                    rows.append((row[key], row["n"], n, ";".join(columns[i] for i in group), len(group), len(group) - rank))
            yield pd.DataFrame(rows, columns=[key, "n", "dependency", "members", "n_members", "surplus"])

    kind = df.schema[key].dataType.simpleString()
    return moments(df, columns, [key]).mapInPandas(work, f"{key} {kind}, n long, dependency int, members string, n_members int, surplus int")
