"""Unified diffs as rows of lines: files, hunks, changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.operators.lines import joined, running


#: The first line of a file's part of a diff (a format).
GIT_HEAD, GIT_SAME = r"^diff --git a/(.+) b/(.+)\z", r"^diff --git a/(.+) b/\1\z"


def header_path(line: Column, marker: str) -> Column:
    """The path of a ---/+++ line: no marker, timestamp or a/ b/; null for /dev/null."""
    path = F.regexp_replace(F.substring_index(F.substr(line, F.lit(len(marker) + 1)), "\t", 1), "^[ab]/", "")
    return F.when(path != "/dev/null", path)


def segment(lines: DataFrame, *keys: str) -> DataFrame:
    """lines (keys, line_no, line) with file_no, hunk_no (0 before the first hunk) and change (+, - or null).

    Git diffs split at ``diff --git ``, others at ``--- `` lines.
    """
    each = Window.partitionBy(*keys)
    git = F.max(F.col("line").startswith("diff --git ")).over(each)
    opens = F.when(git, F.col("line").startswith("diff --git ")).otherwise(F.col("line").startswith("--- "))
    filed = lines.withColumn("opens", opens).withColumn("file_no", running(F.col("opens"), *keys)).where("file_no > 0")
    hunked = filed.withColumn("hunk_no", running(F.col("line").startswith("@@ "), *keys, "file_no"))
    inside = (F.col("hunk_no") > 0) & ~F.col("line").startswith("@@ ")
    change = F.when(inside & F.col("line").startswith("+"), "+").when(inside & F.col("line").startswith("-"), "-")
    return hunked.withColumn("change", change).select(*keys, "line_no", "line", "file_no", "hunk_no", "change")


def _hunks(marked: DataFrame, *keys: str) -> DataFrame:
    """Of ``segment``'s rows one row per hunk, hunk 0 for a file's head: adds, dels, ws_only, body, and what the head says."""
    head = F.col("hunk_no") == 0
    has = lambda *prefixes: F.max(F.when(head & F.col("line").rlike("^(?:" + "|".join(prefixes) + ")"), True).otherwise(False))
    path = lambda marker: F.max(F.when(head & F.col("line").startswith(marker), header_path(F.col("line"), marker)))
    # what a file without hunks says of its paths: renames, then ---/+++ lines, then the first line
    said = lambda prefix: F.max(F.when(head & F.col("line").startswith(prefix), F.substr("line", F.lit(len(prefix) + 1))))
    named = lambda k: F.max(F.when(head & F.col("line").rlike(GIT_SAME), F.regexp_extract("line", GIT_SAME, 1)).when(head & F.col("line").rlike(GIT_HEAD), F.regexp_extract("line", GIT_HEAD, k)))
    side_of = lambda rename, marker, k: F.coalesce(said(rename), F.when(has(re.escape(marker)), path(marker)).otherwise(named(k)))
    bare = F.regexp_replace(F.substr("line", F.lit(2)), r"\s+", "")
    side = lambda sign: F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == sign, F.struct("line_no", bare.alias("bare"))))), lambda x: x["bare"])
    hunks = marked.groupBy(*keys, "file_no", "hunk_no").agg(
        side_of("rename from ", "--- ", 1).alias("old_path"), side_of("rename to ", "+++ ", 2).alias("new_path"), has("Binary files ").alias("binary"), has("new file mode").alias("new"), has("deleted file mode").alias("gone"),
        has("rename from ").alias("renamed"), has("old mode ", "new mode ").alias("mode"), F.count_if(F.col("change") == "+").alias("adds"), F.count_if(F.col("change") == "-").alias("dels"),
        side("-").alias("out"), side("+").alias("in"), joined("line_no", "line").alias("body"),
    )
    return hunks.withColumn("ws_only", (F.size("out") > 0) & (F.col("out") == F.col("in"))).drop("out", "in")


def _files(hunks: DataFrame, *keys: str) -> DataFrame:
    """Of ``_hunks``' rows one row per file: paths, status, adds, dels, body of the hunks that change more than white space, skipped."""
    facts = [F.max(c).alias(c) for c in ("old_path", "new_path", "binary", "new", "gone", "renamed", "mode")]
    shown = (F.col("hunk_no") > 0) & ~F.col("ws_only")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("hunk_no", "body")))), lambda x: x["body"]), "\n")
    files = hunks.groupBy(*keys, "file_no").agg(*facts, F.max("hunk_no").alias("hunks"), F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.count_if("ws_only").alias("skipped"), body.alias("body"))
    status = (
        F.when(F.col("binary"), "binary").when(F.col("new") | (F.col("old_path").isNull() & F.col("new_path").isNotNull()), "new")
        .when(F.col("gone") | (F.col("new_path").isNull() & F.col("old_path").isNotNull()), "deleted").when(F.col("renamed") & (F.col("hunks") == 0), "renamed").when(F.col("renamed"), "renamed, modified")
        .when(F.col("mode") & (F.col("hunks") == 0), "mode changed").otherwise("modified")
    )
    return files.withColumn("status", status)


def diff_files(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, file_no, old_path, new_path, status, adds and dels of each file."""
    return _files(_hunks(segment(lines, *keys), *keys), *keys).select(*keys, "file_no", "old_path", "new_path", "status", "adds", "dels")


def diff_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, file_no (null: the whole diff), adds and dels, for every file and diff in one aggregation over grouping sets."""
    marked = segment(lines, *keys)
    columns = [F.col(k) for k in keys]
    sets = marked.groupingSets([[*columns, F.col("file_no")], columns], *columns, F.col("file_no"))
    return sets.agg(F.count_if(F.col("change") == "+").alias("adds"), F.count_if(F.col("change") == "-").alias("dels"))


def whitespace_only(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, file_no, hunk_no and ws_only: whether removed and added lines are the same once white space is gone."""
    return _hunks(segment(lines, *keys), *keys).where("hunk_no > 0 and adds + dels > 0").select(*keys, "file_no", "hunk_no", "ws_only")


def diff_markdown(lines: DataFrame, *keys: str) -> DataFrame:
    """keys and markdown: a heading, then each file's changes in a fence longer than any run of ` in them; hunks of white space alone are left out.

    Lines are segmented once; hunks, files and diffs are three aggregations of which each feeds the next.
    """
    shown = _files(_hunks(segment(lines, *keys), *keys), *keys)
    path = F.when((F.col("old_path") != F.col("new_path")) & F.col("status").startswith("renamed"), F.concat("old_path", F.lit(" → "), "new_path")).otherwise(F.coalesce("new_path", "old_path", F.lit("?")))
    head = F.concat(F.lit("## "), path, F.lit(" ("), F.col("status"), F.lit(", +"), F.col("adds").cast("string"), F.lit(" -"), F.col("dels").cast("string"), F.lit(")"))
    longest = F.array_max(F.transform(F.regexp_extract_all("body", F.lit("`+"), F.lit(0)), F.length))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(4), F.coalesce(longest, F.lit(0)) + 1))
    fence = F.when(F.col("body") != "", F.concat(F.lit("\n\n"), mark, F.lit("diff\n"), F.col("body"), F.lit("\n"), mark)).otherwise("")
    note = F.when(F.col("skipped") > 0, F.concat(F.lit("\n\n["), F.col("skipped").cast("string"), F.lit(" whitespace-only hunk(s) omitted]"))).otherwise("")
    parts = shown.withColumn("part", F.concat(head, fence, note))
    total = F.concat(F.lit("**"), F.count("*").cast("string"), F.lit(" file(s) changed** (+"), F.sum("adds").cast("string"), F.lit(" -"), F.sum("dels").cast("string"), F.lit(")\n\n"))
    return parts.groupBy(*keys).agg(F.concat(total, joined("file_no", "part", "\n\n")).alias("markdown"))
