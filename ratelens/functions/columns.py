"""Schema helpers: required / optional column checks and type inference.

All of these look only at ``df.schema`` (driver-side metadata); none of them
runs a Spark job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def existing_columns(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """The candidates that exist in ``df``, in the candidates' order."""
    have = set(df.columns)
    return [c for c in candidates if c in have]


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "report") -> None:
    """Raise a ValueError naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs column(s) {missing}; available: {df.columns}")


def _field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of a numeric type (integral, fractional or decimal)."""
    skip = set(exclude)
    return [n for n, t in _field_types(df).items() if isinstance(t, T.NumericType) and n not in skip]


def temporal_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Date and timestamp columns, which are monitored as numbers (see :func:`as_number`)."""
    skip = set(exclude)
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [n for n, t in _field_types(df).items() if isinstance(t, kinds) and n not in skip]


def as_number(df: DataFrame, column: str) -> Column:
    """The column as a double; dates and timestamps as days since 1970-01-01, NaN as null, -0.0 as 0.0."""
    c, t = F.col(column), df.schema[column].dataType
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, T.TimestampNTZType):
        # calendar days, whatever the session's time zone
        day = c.cast("date")
        return F.unix_date(day) + F.timestamp_diff("MICROSECOND", day.cast("timestamp_ntz"), c) / F.lit(86_400_000_000.0)
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c) / F.lit(86_400_000_000.0)
    x = c.cast("double")
    return F.nanvl(x, F.lit(None).cast("double")) + F.lit(0.0) if isinstance(t, (T.DoubleType, T.FloatType)) else x


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """String and boolean columns, which are profiled by category shares."""
    skip = set(exclude)
    return [
        n
        for n, t in _field_types(df).items()
        if isinstance(t, (T.StringType, T.BooleanType)) and n not in skip
    ]
