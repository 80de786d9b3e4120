"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NumericType, StringType

from eventloom.contracts import WINDOW_SECONDS


def columns_of_type(df: DataFrame, *types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def integer_columns(df: DataFrame) -> list[str]:
    """Columns of 32 or 64 bit integers, in table order."""
    return columns_of_type(df, LongType, IntegerType)


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, StringType)


def time_window(time: str | Column = "time", seconds: int = WINDOW_SECONDS) -> Column:
    """Number of the window a time falls in; times before the origin get negative windows."""
    time = F.col(time) if isinstance(time, str) else time
    return F.floor(time / F.lit(seconds)).cast("bigint")


def equals_flag(column: Column, value: str) -> Column:
    """1 where the column equals the value, else 0; nulls give 0."""
    return F.when(column == value, 1).otherwise(0)


def success_flag(column: str | Column) -> Column:
    return equals_flag(F.upper(column), "SUCCESS")


def ratio(numerator: str | Column, denominator: str | Column, epsilon: float | None = None) -> Column:
    """numerator / denominator, 0.0 for a zero denominator.

    With `epsilon` the denominator is shifted by it instead, as the first drafts did.
    """
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    if epsilon is not None:
        return top / (bottom + F.lit(epsilon))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def to_number(column: str) -> Column:
    """Text as double, null where it is no number.

    Java also reads "1d" and "2f" as numbers; a trailing type letter makes the text a non-number here.
    """
    text = F.col(column).cast("string")
    number = F.when(~text.rlike("[0-9.][dDfF]\\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    chosen = set(columns)
    return df.select(*[to_number(c).alias(c) if c in chosen else F.col(c) for c in df.columns])
