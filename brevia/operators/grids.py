"""Grids of cells: empty rows and columns go, the rest becomes a Markdown table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions.text import escape_cell
from brevia.operators.lines import joined


def trim_grid(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, row_no, cells) without blank rows and without columns that are blank in every row; short rows are padded."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    kept = rows.where(F.exists("cells", full))
    cells = kept.select(*keys, "row_no", F.posexplode("cells").alias("col_no", "cell"))
    used = cells.where(full(F.col("cell"))).groupBy(*keys).agg(F.array_sort(F.collect_set("col_no")).alias("used"))
    pick = F.transform("used", lambda i: F.coalesce(F.try_element_at(F.col("cells"), i + 1), F.lit("")))
    return kept.join(used, list(keys)).select(*keys, "row_no", pick.alias("cells"))


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def markdown_table(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and markdown: the first row is the header, short rows are padded to the widest."""
    width = F.max(F.size("cells")).over(Window.partitionBy(*keys))
    first = F.min("row_no").over(Window.partitionBy(*keys))
    wide = rows.withColumn("width", width).withColumn("first", first)
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), "|"), F.lit("|"))
    line = F.concat(table_line(padded), F.when(F.col("row_no") == F.col("first"), rule).otherwise(""))
    return wide.withColumn("line", line).groupBy(*keys).agg(joined("row_no", "line").alias("markdown"))
