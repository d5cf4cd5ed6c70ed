"""Vectors as rows of exact integers: which rows take part, and the narrowest form they fit."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries beyond this count as this, so that integers stay exact as doubles.
MOST = float(1 << 52)


class Shape(NamedTuple):
    rows: int
    width: int
    narrowest: int
    low: int
    high: int


def _doubles(column: str) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def whole(column: str) -> Column:
    """Neither the vector nor one of its entries is null, and all entries are finite."""
    bad = F.exists(_doubles(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(df: DataFrame, key: str, column: str, scale: float, offset: int = 0) -> DataFrame:
    """(key, vector): floor(scale * entry) + offset of each vector that is whole."""
    clipped = lambda x: F.greatest(F.least(F.lit(scale) * x, F.lit(MOST)), F.lit(-MOST))
    return df.where(whole(column)).select(F.col(key).alias("key"), F.transform(_doubles(column), lambda x: F.floor(clipped(x)) + F.lit(offset)).alias("vector"))


def measured(df: DataFrame) -> Shape:
    got = df.agg(F.count("*"), F.max(F.size("vector")), F.min(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    return Shape(*[x or 0 for x in got])


def narrowed(df: DataFrame, shape: Shape) -> DataFrame:
    """Vectors filled up with zeros to one width, in the smallest integer type that holds all entries."""
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= shape.low and shape.high < 1 << bits)
    vector = F.col("vector")
    if shape.narrowest < shape.width:
        vector = F.concat(vector, F.array_repeat(F.lit(0).cast("bigint"), F.lit(shape.width) - F.size(vector)))
    return df.withColumn("vector", vector.cast(f"array<{kind}>"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a column of vectors of one width, as 64-bit integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
