"""Small matrices from tall tables: sums and triangles of Arrow batches, combined over the cluster in two steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in which the tasks' parts of a row are combined before they are one.
FAN = 1024
PARTS = "i int, part int, v array<double>"


def matrix_of(columns: list[pa.Array]) -> np.ndarray:
    """Double columns as a matrix; null counts as 0."""
    return np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])


def parts_of(table: DataFrame, add: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of a matrix that each task makes of its batches: add(matrix so far, batch)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                total = add(total, matrix_of(b.columns))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), TaskContext.get().partitionId(), np.int32)), pa.array(list(total))], names=["i", "part", "v"])

    return table.mapInArrow(partial, PARTS)


def row_sums(table: DataFrame, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a small matrix, ``rows`` of the batch's matrix; empty without rows."""

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": parts.i.iloc[:1], "part": parts.part.iloc[:1] % FAN, "v": [np.sum(np.stack(parts.v.to_list()), 0)]})

    parts = parts_of(table, lambda total, x: rows(x) if total is None else total + rows(x))
    for level in (F.col("part") % FAN, F.lit(0)):
        parts = parts.groupBy("i", level.alias("next")).applyInPandas(added, PARTS)
    return np.array([r["v"] for r in sorted(parts.select("i", "v").collect())])


def triangle(table: DataFrame) -> tuple[np.ndarray, int]:
    """R of a QR decomposition of all rows of a table of double columns, and their number: products are never formed, so no digits are lost."""
    k = len(table.columns)

    def shorter(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r") if len(rows) > k else rows

    def stacked(total: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        # the last row has the number of rows
        before, n = (total[:-1], total[-1, 0]) if total is not None else (x[:0], 0)
        return np.vstack([shorter(np.vstack([before, x])), np.append(n + len(x), np.zeros(k - 1))])

    def combined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["part", "i"])
        last = (parts.part != parts.part.shift(-1)).to_numpy()
        rows = np.stack(parts.v.to_list())
        out = np.vstack([shorter(rows[~last]), rows[last].sum(0)])
        return pd.DataFrame({"i": np.arange(len(out), dtype=np.int32), "part": np.full(len(out), parts.part.iloc[0] % FAN, np.int32), "v": list(out)})

    parts = parts_of(table, stacked)
    for level in (F.col("part") % FAN, F.lit(0)):
        parts = parts.groupBy(level.alias("next")).applyInPandas(combined, PARTS)
    found = np.array([r["v"] for r in sorted(parts.select("i", "v").collect())])
    if not len(found):
        return np.zeros((k, k)), 0
    r = np.zeros((k, k))
    top = np.linalg.qr(found[:-1], mode="r")
    r[: len(top)] = top
    return r, int(found[-1, 0])
