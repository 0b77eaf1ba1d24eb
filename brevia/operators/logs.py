"""Log summaries: error lines with context, other runs of lines counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.operators.lines import by_line, joined, running

#: What makes a line an error line (fixed values); word edges are ASCII.
ERROR_LINE = "|".join([
    r"(?i:(?<![0-9A-Za-z_])(?:FAIL|ERROR|FATAL|PANIC|EXCEPTION|TRACEBACK)(?![0-9A-Za-z_]))",
    r"^[\t\n\f\r ]*at[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]*\(",
    r"^(?:FAILED|PASSED)[\t\n\f\r ]+",
    r"^---[\t\n\f\r ]+FAIL:",
    "●[\\t\\n\\f\\r ]*(?:test|✕)",
    r"^[\t\n\f\r ]*\|[\t\n\f\r ]*(?:AssertionError|Error:|failed)",
])
CONTEXT = 2


def is_error(line: Column) -> Column:
    return line.rlike(ERROR_LINE)


def summarise_logs(lines: DataFrame, *keys: str, context: int = CONTEXT) -> DataFrame:
    """keys, line_no and line of what is kept: every line near an error line, and each other run as one row.

    A run of one line stays as it is; a longer one becomes ``... N lines omitted ...`` at its first line's number.
    """
    near = F.max(is_error(F.col("line"))).over(by_line(*keys).rowsBetween(-context, context))
    marked = lines.withColumn("kept", near)
    run = F.when(F.col("kept"), F.lit(None)).otherwise(running(F.col("kept"), *keys))
    grouped = marked.withColumn("run", run)
    kept = grouped.where("kept").select(*keys, "line_no", "line")
    omitted = F.concat(F.lit("... "), F.count("*").cast("string"), F.lit(" lines omitted ..."))
    runs = grouped.where("not kept").groupBy(*keys, "run").agg(F.min("line_no").alias("line_no"), F.when(F.count("*") == 1, F.min("line")).otherwise(omitted).alias("line"))
    return kept.unionByName(runs.select(*keys, "line_no", "line"))


def log_documents(lines: DataFrame, *keys: str) -> DataFrame:
    """keys and markdown: each log's summary as one text."""
    return summarise_logs(lines, *keys).groupBy(*keys).agg(joined("line_no", "line").alias("markdown"))
