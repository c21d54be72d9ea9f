"""Column expressions shared by the operators."""

from .calendar import day_part, jan_week, season, seconds_between
from .stats import divide, near, nan_to_null, variation, without_nan

__all__ = ["day_part", "divide", "jan_week", "nan_to_null", "near", "season", "seconds_between", "variation", "without_nan"]
