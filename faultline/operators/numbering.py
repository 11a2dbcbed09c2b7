"""Rows numbered in a global order, without a task that gets them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.history import cut

#: Spark's own row numbers hold the task in the bits from this one on, and the row of the task below.
_TASK_BITS = 33


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows and their place, from 0 on, in this order: sorted by ranges, numbered in each, and moved on by the sizes of the ranges before."""
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    task = F.shiftright(F.col(name), _TASK_BITS)
    sizes = held.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    # a row for each task
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    joined = held.withColumn("task", task).join(F.broadcast(before), "task")
    return joined.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << _TASK_BITS) - 1)) + F.col("before")).drop("task", "before")
