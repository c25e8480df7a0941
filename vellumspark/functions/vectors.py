"""Vectors as array columns (H-11..H-17)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """H-13: over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """H-14: 0 for a zero vector and, if strict, for unequal lengths; else over the shorter length."""
    length = norm(a) * norm(b)
    value = F.when(length == 0, 0.0).otherwise(dot(a, b) / length)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(value) if strict else value


def normalize(a: Column) -> Column:
    """H-11: unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def rounded(a: Column, places: int = 6) -> Column:
    """Components rounded half away from zero; what rounds to zero from below is -0.0, as in IEEE 754."""
    return F.transform(a, lambda x: F.round(F.abs(x.cast("double")), places) * F.signum(x.cast("double")))


def truncate(a: Column, dims: int) -> Column:
    """H-12: the first dims components, to unit length again."""
    return normalize(F.slice(a, 1, dims))


def rr(rank: Column, k: int = 60) -> Column:
    """H-17."""
    return 1.0 / (k + rank)


def rr_normal(rank: Column, k: int = 60) -> Column:
    """H-16: 1 at rank 1."""
    return (k + 1.0) / (k + rank)


@F.pandas_udf(T.BinaryType())
def to_bytes(s: pd.Series) -> pd.Series:
    """H-15: little-endian 32-bit floats, for export."""
    return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
