"""Static partitions by position, and cursors. Spark doesn't need them to run in parallel; they are here for
callers that split work by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.sampling import div


def check_partition(index: int, parts: int) -> None:
    if parts < 1 or not 0 <= index < parts:
        raise ValueError("partition index must be in [0, partitions)")


def take_partition(df: DataFrame, index: int, parts: int, position: str) -> DataFrame:
    """Rows whose position is ``index`` modulo ``parts``."""
    check_partition(index, parts)
    return df.where(F.col(position) % parts == index)


def partition_size(total: Column, index: Column, parts: Column) -> Column:
    """How many of ``total`` positions are ``index`` modulo ``parts``."""
    return div(total + parts - 1 - index, parts)


def after_cursor(df: DataFrame, cursor: int, position: str = "source_index") -> DataFrame:
    return df.where(F.col(position) > cursor)


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in order: a dry run."""
    return df.orderBy(*order).limit(n)


def without_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
