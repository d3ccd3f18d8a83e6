"""Rows whose columns are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """df.select(*columns), by way of one generated struct a row: the optimizer does not copy what makes a column into each later use of it, nor into filters."""
    return df.select(F.inline(F.array(F.struct(*columns))))
