"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keys_present(df: DataFrame, keys: Iterable[str]) -> list[str]:
    cols = set(df.columns)
    return [k for k in keys if k in cols]


def with_business(df: DataFrame, business_col: str = "business_id") -> tuple[DataFrame, bool]:
    """Make sure a business key exists so every operator has one code path.

    Returns the frame and whether the key was added (caller drops it again).
    """
    if business_col in df.columns:
        return df, False
    return df.withColumn(business_col, F.lit(0).cast("long")), True


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; used where results are compared across engines."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(field.name), digits) + F.lit(0.0)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def null_nonfinite(df: DataFrame) -> DataFrame:
    """F-21: NaN and +-Inf become NULL in every floating column, also in arrays."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        dt = field.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            out.append(_finite_or_null(c).alias(field.name))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
            out.append(F.transform(c, _finite_or_null).alias(field.name))
        elif isinstance(dt, T.MapType) and isinstance(dt.valueType, (T.DoubleType, T.FloatType)):
            out.append(F.transform_values(c, lambda k, v: _finite_or_null(v)).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def _finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
