"""Statistics expressions with the missing-value rules of the feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """NaN is a missing value everywhere; aggregates and comparisons would take it for the largest one."""
    return F.when(~F.isnan(value), value)


def without_nan(df: DataFrame) -> DataFrame:
    """df with nulls for NaN in its floating columns; other columns are passed through, as are filters on them."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def near(a: Column, b: Column, tolerance: float = 1.5e-8) -> Column:
    return F.abs(a - b) < tolerance


def divide(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, and `empty` where b is 0 or either is missing."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(empty))


def variation(value: Column, keep: Column | None = None) -> Column:
    """Aggregate: 100 sd / mean of the kept values; 0 if there are none or the mean is not positive, null for one value."""
    v = nan_to_null(value) if keep is None else F.when(keep, nan_to_null(value))
    return F.when(F.avg(v) > 0, F.stddev_samp(v) / F.avg(v) * 100).otherwise(F.lit(0.0))


def proportional_difference(big: Column, small: Column, infinite: bool = False) -> Column:
    """Null where `small` is 0; if `infinite`, what doubles give there: infinity of the sign of that 0, and NaN for 0 and 0."""
    apart = F.abs(big - small)
    found = apart / F.nullif(small, F.lit(0)) * 100
    return F.when(small == 0, apart * F.pow(small, F.lit(-1.0))).otherwise(found) if infinite else found
