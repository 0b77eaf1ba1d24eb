"""Ignore files as data, and diffs without hunks."""

from __future__ import annotations

from brevia.operators import diffs, trees
from brevia.operators.lines import explode_lines


def kept(spark, texts, files):
    rules = trees.ignore_rules(spark.createDataFrame(texts, "root string, text string"), "root", "text")
    return {tuple(r) for r in trees.not_ignored(spark.createDataFrame(files, "root string, path string"), rules, "root").collect()}


def test_each_root_has_its_rules(spark):
    names = ["keep.txt", "debug.log", "build/out.bin", "src/build.py", "src/a/x.tmp", "src/a/keep.tmp", "docs/one.md", "other/docs/two.md", "en/keep.html", "a+b.txt", "deep/x/y/z.go"]
    files = [(root, n) for root in ("one", "two", "none") for n in names]
    one = "*.log\nbuild/\n*.tmp\n!keep.tmp\n/docs\n#x\n\nen/\n!en/keep.html"
    two = "src\n!src/a/keep.tmp\na+b.txt\n**/y/\n[!a-z]*\n*.m?\r\n"
    got = kept(spark, [("one", one), ("two", two)], files)
    assert {p for r, p in got if r == "none"} == set(names)
    assert {p for r, p in got if r == "one"} == {"keep.txt", "src/build.py", "src/a/keep.tmp", "other/docs/two.md", "a+b.txt", "deep/x/y/z.go"}  # en/ is never entered, so nothing below comes back
    assert {p for r, p in got if r == "two"} == {"keep.txt", "debug.log", "build/out.bin", "en/keep.html"}


def test_rules_of_nothing(spark):
    files = [("r", "a/b"), ("r", "a/b"), ("s", "c")]
    assert kept(spark, [], files) == {("r", "a/b"), ("s", "c")} and kept(spark, [("r", "\n# only words\n")], files) == {("r", "a/b"), ("s", "c")}
    assert kept(spark, [("r", "*\n!a\n!a/b")], files) == {("r", "a/b"), ("s", "c")}
    rules = trees.ignore_rules(spark.createDataFrame([("q", "x")], "root string, text string"), "root", "text")
    assert trees.not_ignored(spark.createDataFrame(files, "root string, path string"), rules, "root").count() == 3


def test_files_without_hunks_have_names(spark):
    text = "\n".join(["diff --git a/old name.txt b/new.txt", "similarity index 100%", "rename from old name.txt", "rename to new.txt", "diff --git a/p.png b/p.png", "Binary files a/p.png and b/p.png differ", "diff --git a/e b/e", "new file mode 100644",
                      "diff --git a/r.c b/s.c", "rename from r.c", "rename to s.c", "--- a/r.c", "+++ b/s.c", "@@ -1 +1 @@", "-a", "+b", "diff --git a/gone b/gone", "deleted file mode 100644", "--- a/gone", "+++ /dev/null", "@@ -1 +0,0 @@", "-x"])
    rows = explode_lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert [(r["old_path"], r["new_path"], r["status"]) for r in sorted(diffs.diff_files(rows, "id").collect(), key=lambda r: r["file_no"])] == [
        ("old name.txt", "new.txt", "renamed"), ("p.png", "p.png", "binary"), ("e", "e", "new"), ("r.c", "s.c", "renamed, modified"), ("gone", None, "deleted"),
    ]
    shown = diffs.diff_markdown(rows, "id").first()["markdown"]
    assert "## old name.txt → new.txt (renamed, +0 -0)" in shown and "## p.png (binary" in shown and "?" not in shown
