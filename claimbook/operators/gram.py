"""Cross-product matrices of numeric columns, summed where the rows are.

Each task reduces its Arrow batches to one small matrix per group; only those
matrices are shuffled. One scan serves any number of groups, and the cost of a
row grows with numpy's matrix product instead of with p * p generated sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _partial_products(n_cols: int):
    upper = np.triu_indices(n_cols)

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = batch.column(0).to_numpy()
            weight = batch.column(1).to_numpy()
            x = np.column_stack([batch.column(i + 2).to_numpy() for i in range(n_cols)])
            for g in np.unique(group):
                pick = group == g
                block = x[pick]
                product = block.T @ (block * weight[pick, None])
                sums[int(g)] = sums[int(g)] + product if int(g) in sums else product
        for g, matrix in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(upper[0]), g, dtype=np.int32)),
                    pa.array(upper[0].astype(np.int32)),
                    pa.array(upper[1].astype(np.int32)),
                    pa.array(matrix[upper]),
                ],
                ["grp", "i", "j", "s"],
            )

    return reduce_batches


def cross_products(
    df: DataFrame,
    columns: Sequence[Column],
    group: Column | None = None,
    weight: Column | None = None,
) -> dict[int, np.ndarray]:
    """Weighted sums of products of every column pair, per integer group.

    The columns must be free of nulls. Returns one symmetric matrix per group
    (group 0 when there is none). The sums come to the driver as Arrow columns.
    """
    p = len(columns)
    rows = df.select(
        (group if group is not None else F.lit(0)).cast("int").alias("grp"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
    )
    sums = (
        rows.mapInArrow(_partial_products(p), "grp int, i int, j int, s double")
        .groupBy("grp", "i", "j")
        .agg(F.sum("s").alias("s"))
    )
    table = sums.toArrow()
    group_of, i, j, s = (table[c].to_numpy() for c in ("grp", "i", "j", "s"))
    matrices: dict[int, np.ndarray] = {}
    for g in np.unique(group_of):
        pick = group_of == g
        matrix = np.zeros((p, p))
        matrix[i[pick], j[pick]] = s[pick]
        matrix[j[pick], i[pick]] = s[pick]
        matrices[int(g)] = matrix
    return matrices


def column_means(df: DataFrame, columns: Sequence[Column]) -> list[float]:
    """Mean of every column, one aggregate; 0 where there are no rows."""
    facts = df.agg(*[F.avg(c.cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [float(m) if m is not None else 0.0 for m in facts]


def independent_columns(gram: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Positions that are not a linear combination of earlier ones.

    ``gram`` holds products of columns less their means, so a large mean is not taken
    for a combination with the intercept. Elimination in column order on the scaled
    matrix: a column whose remaining share of its own length is below ``tol`` is aliased.
    """
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    left = gram / np.outer(scale, scale)
    kept = []
    for j in range(len(left)):
        if left[j, j] > tol:
            kept.append(j)
            left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
    return kept
