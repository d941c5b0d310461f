"""Vectors as arrays: validity, products, decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(v: Column, width: int) -> Column:
    """Whether an array has exactly ``width`` finite elements; null arrays haven't."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the shorter array decides the length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def decoded(blob: Column, width: int) -> Column:
    """Vectors stored as little-endian 32-bit floats; null where a blob has another length."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * width else None)

    return decode(blob)
