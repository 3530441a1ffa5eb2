"""NULL and NaN rules shared by every operator.

The pandas-style rules behind the published figures treat NaN as missing: a
comparison with it is false and an aggregate skips it.  Spark orders NaN above
every number and lets it poison averages, so NaN becomes NULL once, at ingest,
and a condition that feeds a flag column is wrapped in ``truthy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(condition: Column) -> Column:
    """A condition that is false, not NULL, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN with NULL in every floating-point column."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def flag(column: str) -> Column:
    """A boolean column as 0.0/1.0, NULL kept."""
    return F.col(column).cast("double")
