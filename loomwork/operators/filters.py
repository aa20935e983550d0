"""Filters built from parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df
