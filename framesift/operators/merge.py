"""Merging of partial outputs: disjoint by task, complete, in the order of the tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many ids an error names.
NAMED = 10


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicates(df: DataFrame, key: str = "task_id") -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(expected: DataFrame, actual: DataFrame, key: str = "task_id") -> DataFrame:
    return expected.join(actual.select(key).distinct(), key, "left_anti")


def extra(expected: DataFrame, actual: DataFrame, key: str = "task_id") -> DataFrame:
    return actual.select(key).distinct().join(expected.select(key), key, "left_anti")


def in_task_order(df: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows of the tasks, with ``task_pos``, in its order."""
    return df.join(tasks.select(key, "task_pos"), key).orderBy("task_pos")


def _refuse(found: DataFrame, what: str, order: list[str], key: str) -> None:
    ids = [str(r[key]) for r in found.orderBy(*order).limit(NAMED).collect()]
    if ids:
        raise ValueError(f"{what}: {', '.join(ids)}")


def merge(parts: list[DataFrame], tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """The parts' rows in task order; an error for a task that is in more than one place, missing, or unknown."""
    if not parts:
        raise ValueError("nothing to merge")
    every = union_all(parts)
    _refuse(duplicates(every, key), "tasks in more than one part", [key], key)
    _refuse(missing(tasks, every, key), "missing tasks", ["task_pos"], key)
    _refuse(extra(tasks, every, key), "unexpected tasks", [key], key)
    return in_task_order(every, tasks, key)
