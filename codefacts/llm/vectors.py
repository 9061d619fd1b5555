"""Arrow columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_width(rows: DataFrame, column: str) -> int:
    """The number of components that most vectors have (the smaller on a tie; 0 without vectors)."""
    top = rows.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return int(top[0]["d"]) if top else 0


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with width components each, all finite and none null; their indices in the column)."""
    values = column.flatten()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
    right = np.flatnonzero((lengths == width) & (width > 0))
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][right]
    x = flat[starts[:, None] + np.arange(width)] if len(right) else np.zeros((0, width))
    good = np.isfinite(x).all(1)
    return x[good], right[good]
