"""Documents as rows of lines, and runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1) and line for each line of each text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def by_line(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("line_no")


def running(flag: Column, *keys: str) -> Column:
    """How many flags are set up to the row: the id of the segment that each flag opens."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(by_line(*keys).rowsBetween(Window.unboundedPreceding, 0))


def joined(order: str, line: str, separator: str = "\n") -> Column:
    """Aggregate: the lines in order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, line)))
    return F.array_join(F.transform(ordered, lambda x: x[line]), separator)
