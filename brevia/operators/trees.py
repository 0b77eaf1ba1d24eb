"""Path trees: directories and files with depth, counts and collapsed branches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions.text import human_bytes, plural

#: Directories that are never entered (fixed values).
DEPENDENCIES = ["node_modules", "vendor", "dist", "build", "target", ".venv", "venv", "__pycache__", ".next", ".nuxt", ".terraform"]
MOST_ENTRIES = 100


def _ignore_pattern(line: str) -> str:
    """A line of an ignore file as a pattern over paths (directories end in /): * and ? stay within a name, ** crosses names."""
    line, anchored = line.rstrip("/"), "/" in line.rstrip("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", line.lstrip("/")):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[0] == "[" and len(part) > 1 else re.escape(part))
    return ("^" if anchored else "(?:^|/)") + out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a file's path is left out by the lines of an ignore file: of those that match the last one decides, ! takes back."""
    out: Column = F.lit(False)
    for line in patterns:
        line = line.strip()
        if line and not line.startswith("#"):
            below = "/.+" if line.endswith("/") else r"(?:/.*)?"
            out = F.when(path.rlike(_ignore_pattern(line.removeprefix("!")) + below + r"\z"), not line.startswith("!")).otherwise(out)
    return out


#: Signs of an ignore line and what they match in a path, in the order they are looked for: private signs hold a place until all are found.
_GLOBS = [("**/", "\ue001", "(?:.*/)?"), ("/**", "\ue002", "/.*"), ("**", "\ue003", ".*"), ("*", "\ue004", "[^/]*"), ("?", "\ue005", "[^/]"), ("[!", "\ue006", "[^")]


def ignore_rules(texts: DataFrame, root: str, text: str) -> DataFrame:
    """root, rank, pattern, takes_back and dir_only: a row for each rule of each root's ignore file.

    A rule is a line that is neither blank nor a comment; one with a slash before its end is held against whole paths,
    others against the last name.
    """
    lines = texts.select(root, F.posexplode(F.split(text, "\n")).alias("rank", "line"))
    rules = lines.withColumn("line", F.regexp_replace("line", r"\s+\z", "")).where("line <> '' and not startswith(line, '#')")
    bare = rules.withColumns({"takes_back": F.col("line").startswith("!"), "dir_only": F.col("line").endswith("/"), "glob": F.regexp_replace("line", r"^!|/\z", "")})
    pattern = F.regexp_replace(F.regexp_replace("glob", "^/", ""), r"([.+^${}()|\\])", r"\\$1")
    for sign, held, _ in _GLOBS:
        pattern = F.replace(pattern, F.lit(sign), F.lit(held))
    for _, held, meaning in _GLOBS:
        pattern = F.replace(pattern, F.lit(held), F.lit(meaning))
    anchor = F.when(F.col("glob").contains("/"), "^").otherwise("(?:^|/)")
    return bare.select(root, "rank", F.concat(anchor, pattern, F.lit("\\z")).alias("pattern"), "takes_back", "dir_only")


def not_ignored(files: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """files (root, path, ...) without those that their root's rules leave out.

    Every directory and file is judged by the last rule that fits it; what is below a directory that is left out goes with
    it, whatever later rules take back, as it is never entered. Each distinct path of a root meets the rules of that root
    once; paths and rules are joined by root, and the last fitting rule is a partial maximum.
    """
    parts = F.split("path", "/")
    steps = files.select(root, "path", F.explode(F.transform(parts, lambda _, i: F.struct(F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("step"), (i + 1 < F.size(parts)).alias("is_dir")))).alias("s")).select(root, "path", "s.*").distinct()
    fits = F.expr("step rlike pattern") & (~F.col("dir_only") | F.col("is_dir"))
    judged = steps.select(root, "step", "is_dir").distinct().join(rules, root).where(fits)
    out = judged.groupBy(root, "step", "is_dir").agg(F.max_by("takes_back", "rank").alias("takes_back")).where("not takes_back").select(root, "step", "is_dir")
    gone = steps.join(out, [root, "step", "is_dir"], "left_semi").select(root, "path").distinct()
    return files.join(gone, [root, "path"], "left_anti").select(*files.columns)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """root, path and size of every file below a folder, from its listing; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    base = re.escape(path.rstrip("/").split("://")[-1] + "/")
    return listed.select(F.lit(path.rstrip("/").rpartition("/")[2]).alias("root"), F.element_at(F.split("path", base), -1).alias("path"), F.col("length").alias("size"))


def entries(files: DataFrame, root: str) -> DataFrame:
    """root, parent, name, path, depth, is_dir and size of every file and directory above it, from (root, path, size).

    ``.git`` and what it holds is left out.
    """
    seen = files.where(~F.col("path").rlike(r"(^|/)\.git(/|\z)"))
    parts = seen.select(root, "path", "size", F.split("path", "/").alias("parts"))
    steps = parts.select(root, "size", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    rows = steps.select(
        root, F.when(F.col("depth") == 1, "").otherwise(upto(F.greatest(F.col("depth") - 1, F.lit(1)))).alias("parent"), F.element_at("parts", F.col("depth")).alias("name"),
        upto(F.col("depth")).alias("path"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir"), "size",
    )
    return rows.groupBy(root, "parent", "name", "path", "depth").agg(F.max("is_dir").alias("is_dir"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("size"))


def tree_counts(files: DataFrame, root: str) -> DataFrame:
    """root, parent, n_files, n_dirs and collapsed of every directory: dependency, nested (it holds a .git of its own), crowded or null."""
    counted = entries(files, root).groupBy(root, "parent").agg(F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if(F.col("is_dir")).alias("n_dirs"))
    own = files.select(root, F.regexp_extract("path", r"^(.+?)/\.git(?:/.*)?\z", 1).alias("parent")).where("parent <> ''").distinct().withColumn("nested", F.lit(True))
    name = F.element_at(F.split("parent", "/"), -1)
    why = F.when(name.isin(DEPENDENCIES), "dependency").when(F.col("nested"), "nested").when((F.col("n_files") + F.col("n_dirs") > MOST_ENTRIES) & (F.col("parent") != ""), "crowded")
    return counted.join(own, [root, "parent"], "left").withColumn("collapsed", why).drop("nested")


def tree_lines(files: DataFrame, root: str) -> DataFrame:
    """root, sort_key and line of every entry that shows: nothing below a collapsed directory does.

    Each entry is joined by equality with the directories above it, so a root of any size is split over tasks.
    """
    every = entries(files, root)
    counts = tree_counts(files, root).where("collapsed is not null").select(root, F.col("parent").alias("path"), "collapsed", (F.col("n_files") + F.col("n_dirs")).alias("n"))
    parts = F.split("path", "/")
    above = every.where("depth > 1").select(root, F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    below = above.join(counts.select(root, "path"), [root, "path"], "left_semi").select(root, F.col("inner").alias("path")).distinct()
    hidden = every.join(below, [root, "path"], "left_anti")
    marked = hidden.join(counts, [root, "path"], "left")
    note = F.when(F.col("collapsed") == "dependency", " (dependency directory, collapsed)").when(F.col("collapsed") == "nested", " (nested git repo/worktree, collapsed)").when(F.col("collapsed") == "crowded", F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" items, collapsed)"))).otherwise("")
    text = F.when(F.col("is_dir"), F.concat("name", F.lit("/"), note)).otherwise(F.concat("name", F.lit(" ("), human_bytes(F.coalesce("size", F.lit(0))), F.lit(")")))
    steps = F.transform(F.split("path", "/"), lambda part, i: F.concat(F.when((i + 1 < F.size(F.split("path", "/"))) | F.col("is_dir"), "0").otherwise("1"), part))
    return marked.select(root, F.array_join(steps, "\u0001").alias("sort_key"), F.concat(F.repeat(F.lit("  "), F.col("depth")), text).alias("line"), "is_dir")


def tree_summary(files: DataFrame, root: str) -> DataFrame:
    """root and markdown: the counts, and the tree with directories before files, each by name."""
    lines = tree_lines(files, root)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "line"))), lambda x: x["line"]), "\n")
    files_n, dirs_n = F.count_if(~F.col("is_dir")), F.count_if(F.col("is_dir"))
    head = F.concat(F.lit("**"), files_n.cast("string"), F.lit(" "), plural(files_n, "file", "files"), F.lit(", "), dirs_n.cast("string"), F.lit(" "), plural(dirs_n, "directory", "directories"), F.lit("**\n\n```\n"))
    return lines.groupBy(root).agg(F.concat(head, F.max(root), F.lit("/\n"), body, F.lit("\n```")).alias("markdown"))
