"""Coercion to what a rule compares: text, numbers, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def to_number(column: Column, kind: T.DataType) -> Column:
    """Doubles; what is no number is null, NaN too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = column.cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    elif isinstance(kind, T.StringType):
        number = F.when(column.rlike(_NUMBER), F.trim(column).try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number), number)


def to_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    if isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"a {kind.simpleString()} column has no text to match")
    return column.cast("string")
