"""Columns that later steps use several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with further columns, in place of any with their names, all made from df's own and computed once a row.

    Spark would otherwise merge a column into each later use, such as a lambda's body. What depends on the task's number is
    not merged, so the columns do so in name: it is never below zero.
    """
    kept = [c for c in df.columns if c not in made]
    step = df.select(*kept, F.when(F.spark_partition_id() >= 0, F.struct(*[c.alias(n) for n, c in made.items()])).alias("_made"))
    return step.select(*kept, "_made.*")
