"""Numeric settings: strict arguments and lenient session options."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def positive_int(value) -> int:
    """value as a whole number above 0; a ValueError for all else."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"not a whole number: {value}") from None
    if n <= 0:
        raise ValueError(f"not above 0: {value}")
    return n


def positive_setting(spark: SparkSession, name: str, default: float) -> float:
    """The session's option as a number above 0; the default where it is unset or anything else."""
    try:
        n = float(spark.conf.get(name, None))
    except (TypeError, ValueError):
        return default
    return default if math.isnan(n) or n <= 0 else n
