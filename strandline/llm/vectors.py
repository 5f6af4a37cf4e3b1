"""Integer vectors out of Arrow lists of floating-point numbers, as the operators on embeddings read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True if the list is not null and none of its components is null, NaN or infinite."""
    whole = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & whole, F.lit(False))


def longest(df: DataFrame, column: str) -> int:
    """The most components that a vector of df has; 0 for an empty table."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def integers(lists: pa.Array, scale: int, width: int, limit: int) -> np.ndarray:
    """(rows, width) int64: floor(scale * x) of every component, x as double; shorter vectors end in zeros.

    lists holds finite() vectors only. A component that is `limit` or more in size raises: sums of products of such would
    not fit a long.
    """
    lists = pa.concat_arrays([lists]) if lists.offset else lists
    lengths = np.asarray(pc.list_value_length(lists), np.int64)
    x = np.floor(np.asarray(lists.flatten(), np.float64) * scale)
    if len(x) and np.abs(x).max() >= limit:
        raise ValueError(f"a component times {scale} is {limit} or more: its products do not fit a long")
    if (lengths == width).all():
        return x.astype(np.int64).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
    return out
