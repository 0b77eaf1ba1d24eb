"""Operators on small fixtures written for the rule they show."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from brevia import api
from brevia.functions import text as t
from brevia.operators import diffs, grids, html, json_docs, logs, outline, pages, relations, report, tags, trees
from brevia.operators.lines import explode_lines
from brevia.sources import detect
from brevia.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, t.clean_text(lit("  a \t\r\nb\r\r\r\rc  "))) == "a\nb\n\nc"
    assert [value(spark, t.human_count(lit(n))) for n in (999, 1000, 1250, 1350, 12345)] == ["999", "1.0k", "1.2k", "1.4k", "12.3k"]
    assert value(spark, t.human_bytes(lit(1536))) == "1.5 KB"
    assert value(spark, t.escape_heading(lit("  # x"))) == r"  \# x"
    assert value(spark, t.escape_cell(lit(" a|b\nc "))) == r"a\|b c"
    assert value(spark, t.tidy_markdown(lit("a b [](x) c​"))) == "a b  c"
    assert value(spark, t.clip(lit("abcdef"), 3)) == "abc…"
    assert [value(spark, t.k_tokens(lit(n))) for n in (950, 1200, 12400)] == ["950", "1.2k", "12k"]


def test_log_with_two_incidents(spark):
    """200 lines, an error with 2 lines behind, 200 lines, a fatal line with 1 behind: two lines of context stay, two runs are counted."""
    quiet = [f"line {i} INFO all is well" for i in range(200)]
    text = "\n".join([*quiet, "ERROR broken", "  at one", "  at two", *quiet, "FATAL gone", "tail"])
    lines = explode_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    out = logs.log_documents(lines, "id").first()["markdown"].split("\n")
    gap = ["... 198 lines omitted ...", *quiet[-2:]]
    assert out == [*gap, "ERROR broken", "  at one", "  at two", *gap, "FATAL gone", "tail"]


def test_single_omitted_line_stays(spark):
    text = "\n".join(["ERROR a", "1", "2", "3", "4", "5", "ERROR b"])
    lines = explode_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    assert logs.log_documents(lines, "id").first()["markdown"] == text


def test_error_words_have_ascii_edges(spark):
    rows = [("an error here", True), ("errors", False), ("éERROR", True), ("  at f.g (x)", True), ("PASSED  x", True), ("--- FAIL: y", True), ("fine", False)]
    got = spark.createDataFrame(rows, "line string, want boolean").where(logs.is_error(F.col("line")) != F.col("want"))
    assert got.count() == 0


def test_outline_skips_fences_and_finds_ends(spark):
    md = "# One\ntext\n## Two [link](x) \\* ##\n```\n# not a heading\n```\n# Three\n"
    rows = outline.headings(spark.createDataFrame([(1, md)], "id0 long, md string"), "id0").orderBy("id").collect()
    assert [(r["id"], r["level"], r["title"]) for r in rows] == [(1, 1, "One"), (2, 2, "Two link *"), (3, 1, "Three")]
    assert md[rows[0]["start"] : rows[0]["end"]] == md[: md.index("# Three")]


def test_outline_without_headings(spark):
    out = outline.format_outline(spark.createDataFrame([(1, "just text")], "k long, md string"), "k").first()["outline"]
    assert out == "no headings; about 3 tokens, ask for page=1"


def test_section_prefers_exact_titles(spark):
    md = "# Setup guide\na\n# Setup\nb\n# The setup\nc"
    docs = spark.createDataFrame([(1, md)], "k long, md string")
    wanted = spark.createDataFrame([(1, "setup"), (1, "3"), (1, "nothing")], "k long, wanted string")
    got = {r["wanted"]: r["id"] for r in outline.section_lookup(docs, wanted, "k").collect()}
    assert got == {"setup": 2, "3": 3}


def diff_lines(spark, text):
    return explode_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")


def test_diff_statuses_and_counts(spark):
    text = "\n".join([
        "diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,2 @@", "-old", "+new", " same", "@@ -9 +9 @@", "-a b", "+a  b",
        "diff --git a/n b/n", "new file mode 100644", "--- /dev/null", "+++ b/n", "@@ -0,0 +1 @@", "+line",
        "diff --git a/o b/p", "rename from o", "rename to p", "diff --git a/b.png b/b.png", "Binary files a/b.png and b/b.png differ",
    ])
    rows = diffs.diff_files(diff_lines(spark, text), "id").orderBy("file_no").collect()
    assert [(r["status"], r["adds"], r["dels"]) for r in rows] == [("modified", 2, 2), ("new", 1, 0), ("renamed", 0, 0), ("binary", 0, 0)]
    same = diffs.whitespace_only(diff_lines(spark, text), "id").where("ws_only").collect()
    assert [(r["file_no"], r["hunk_no"]) for r in same] == [(1, 2)]
    out = diffs.diff_markdown(diff_lines(spark, text), "id").first()["markdown"]
    assert out.startswith("**4 file(s) changed** (+3 -2)") and "[1 whitespace-only hunk(s) omitted]" in out and "+a  b" not in out


def test_plain_patch_splits_at_minus_lines(spark):
    rows = diffs.diff_stats(diff_lines(spark, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +0,0 @@\n-c"), "id").collect()
    assert {(r["file_no"], r["adds"], r["dels"]) for r in rows} == {(1, 1, 1), (2, 0, 1), (None, 1, 2)}


def test_running_lines_and_numbers_go(spark):
    rows = [(1, p, k, line) for p in range(1, 7) for k, line in enumerate([f"ACME Report {p}", "intro", *[f"body {p} {i}" for i in range(4)], "Confidential text", f"- {p + 2} -"], 1)]
    lines = spark.createDataFrame(rows, "doc long, page_no long, line_no long, line string")
    left = {r["line"] for r in pages.without_furniture(lines, "doc").collect()}
    assert not any(x.startswith(("ACME", "Confidential", "- ")) for x in left)
    assert "body 3 2" in left


def test_pages_hold_whole_lines_within_budget(spark):
    docs = spark.createDataFrame([(1, "aaaa\nbbbb\ncc\n" + "d" * 30)], "k long, text string")
    rows = pages.pack_pages(docs, "k", "text", 10).orderBy("page_no").collect()
    assert [r["content"] for r in rows] == ["aaaa\nbbbb", "cc", "d" * 30]


def test_grid_and_table(spark):
    rows = spark.createDataFrame([("s", 1, ["a", "", "b|c"]), ("s", 2, ["", " "]), ("s", 3, ["d"])], "sheet string, row_no long, cells array<string>")
    out = grids.markdown_table(grids.trim_grid(rows, "sheet"), "sheet").first()["markdown"]
    assert out == "| a | b\\|c |\n|---|---|\n| d |  |"


def test_json_columns(spark):
    df = spark.range(1).select(F.expr("named_struct('a', 1, 'secret_b', 2, 'c', array(named_struct('secret_d', 1, 'e', 2)))").alias("doc"), F.expr("array(1,2,3,4,5)").alias("xs"))
    assert df.select(F.to_json(json_docs.drop_keys(df, "doc", "secret*"))).first()[0] == '{"a":1,"c":[{"e":2}]}'
    pick = lambda c: df.select(c).first()[0]
    assert pick(json_docs.select_slice(F.col("xs"), -2)) == [4, 5] and pick(json_docs.select_slice(F.col("xs"), 5, 10)) == []
    assert pick(json_docs.select_index(F.col("xs"), -1)) == 5 and pick(json_docs.select_index(F.col("xs"), 9)) is None
    assert pick(json_docs.max_str(F.lit("héllo world"), 5)) == "héllo…(+6 chars)"
    assert pick(json_docs.drop_lists_over(F.col("xs"), 3)) == '"[5 items omitted]"'
    assert json_docs.flatten(df, "doc")[0] is not None


def test_tree_collapses(spark):
    files = [("r", f"big/f{i}", 10) for i in range(101)] + [("r", "node_modules/x/y.js", 1), ("r", "src/a.py", 2048), ("r", ".git/config", 5), ("r", "README", 7)]
    out = trees.tree_summary(spark.createDataFrame(files, "root string, path string, size long"), "root").first()["markdown"]
    assert out.split("\n") == ["**2 files, 3 directories**", "", "```", "r/", "  big/ (101 items, collapsed)", "  node_modules/ (dependency directory, collapsed)", "  src/", "    a.py (2.0 KB)", "  README (7 B)", "```"]


def test_html_columns(spark):
    page = '<html><head><title> A  b </title><script>var x = "</p>";</script></head><body><!-- no --><p>Hi <b>you</b></p><a href="/x?utm_source=1&b=2">l</a></body></html>'
    got = spark.range(1).select(html.title(F.lit(page)).alias("t"), html.strip(F.lit(page)).alias("s"), html.links(F.lit(page)).alias("l"), html.needs_js(F.lit(page)).alias("n")).first()
    assert got["t"] == "A b" and got["s"] == "A b Hi you l" and got["l"] == ["/x?utm_source=1&b=2"] and got["n"]
    rewrite = lambda u: value(spark, html.rewrite_link(F.lit(u), F.lit("https"), F.lit("e.org")))
    assert rewrite("https://e.org/a?utm_x=1&z=1&b=2#f") == "/a?b=2&z=1#f" and rewrite("https://e.org") == "/" and rewrite("#top") is None and rewrite("http://o.org/?q=1") == "http://o.org/?q=1"


def test_kinds(spark, tmp_path):
    kind = lambda text, path=None, media=None: value(spark, detect.kind(F.lit(text), F.lit(path).cast("string"), F.lit(media).cast("string")))
    assert kind("%PDF-1.4", "x.html") == "pdf" and kind("x", "a/b.NDJSON") == "json" and kind('  {"a": 1}') == "json" and kind("{a") == "text"
    assert kind("<header>") == "html" and kind("diff --git a/x b/x") == "diff" and kind("x", None, "application/ld+json") == "json"
    (tmp_path / "a.log").write_text("x")
    (tmp_path / "big.txt").write_text("y" * 100)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in detect.files(spark, str(tmp_path), 50).collect()}
    assert rows["a.log"]["kind"] == "logfile" and rows["big.txt"]["error"] and rows["big.txt"]["content"] is None


def test_styles_inherit(spark):
    styles = spark.createDataFrame([(1, None, "serif"), (2, 1, None), (3, 2, None), (4, None, None)], "style_id long, based_on long, font string")
    assert {(r["style_id"], r["font"]) for r in relations.inherited(styles, "font").collect()} == {(1, "serif"), (2, "serif"), (3, "serif")}


def test_report(spark):
    runs = spark.createDataFrame([("a", "x", 10, True), ("a", "x", 20, False), ("a", "y", 5, True), ("b", "x", 9, True)], "task string, arm string, tokens long, correct boolean")
    rows = {r["task"]: r for r in report.ab_pivot(runs, ("x", "y")).collect()}
    assert set(rows) == {"a", None} and rows["a"]["x_mean"] == 15 and rows["a"]["change_pct"] == -66
    answers = spark.createDataFrame([(1, 1, "It costs **1,200** euros"), (2, 1, "12000")], "answer_id long, task long, answer string")
    facts = spark.createDataFrame([(1, 1, ["1200", "1.2k"])], "task long, fact_no long, phrases array<string>")
    assert {(r["answer_id"], r["correct"]) for r in report.grade(answers, facts).collect()} == {(1, True), (2, False)}
    calls = spark.createDataFrame([(1, 1, "c", 5, 1), (1, 2, "c", 7, 2), (1, 3, "d", 3, 1)], "session long, seq long, call_id string, input long, output long")
    assert tuple(report.session_usage(calls).first()) == (1, 2, 10, 7, 3)


def test_ttl_counts_from_insert(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:09:00", 7), (3, "2024-01-01 00:11:00", 7), (4, "2024-01-01 00:12:00", 7)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "to_timestamp(ts) as ts", "user_id").write.parquet(str(tmp_path / "events"))
    done = events.ttl_cache(events.event_stream(spark, str(tmp_path / "events")), 600, str(tmp_path / "out"))
    assert [tuple(r) for r in done.collect()] == [(7, 4, 2)]
    state = events.ttl_step(spark.createDataFrame([(9, "2024-01-01 00:20:00", 7), (8, "2024-01-01 00:20:30", 8), (7, None, 8), (6, "2024-01-01", None)], "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts")), spark.createDataFrame([(7, 1704067860000000, 4, 2)], events.STATE), 600)
    assert sorted((r["user_id"], r["n_reads"], r["n_hits"]) for r in state.collect()) == [(7, 5, 3), (8, 1, 0)]


def page_markdown(spark, page):
    return tags.markdown(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html").first()["markdown"]


def test_markdown_of_a_page(spark):
    page = "<html><head><title>The page</title></head><body><nav><a href='/'>no</a></nav><article><h2>Part &amp; more</h2><p>Some <b>bold</b> and <a href=\"/x\">a link</a>.<ul><li>one<li>two</ul></article><footer>no</footer></body></html>"
    assert page_markdown(spark, page) == "# The page\n\n## Part & more\n\nSome **bold** and [a link](/x).\n\n- one\n- two"
    bare = "<title>T</title><h1>T</h1><nav>menu</nav><p>text<br>next"
    assert page_markdown(spark, bare).endswith("# T\n\ntext\nnext")


def test_reading_a_mixed_corpus(spark):
    rows = [
        ("a", "<html><body><h1>Hi</h1><p>x</body></html>", None, None), ("b", "ok\nERROR x\n", "run.log", None), ("c", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b", "x.patch", None),
        ("d", "plain  \n\n\n\ntext", None, None), ("e", None, None, None), ("f", "%PDF-1.4", None, None), ("g", "no diff here", "y.diff", None),
    ]
    docs = spark.createDataFrame(rows, "id string, text string, path string, content_type string")
    got = {r["id"]: r for r in api.read_docs(docs).collect()}
    assert api.read_docs(docs.unionByName(docs)).count() == 14
    assert [got[k]["kind"] for k in "abcdf"] == ["html", "logfile", "diff", "text", "pdf"]
    assert got["a"]["markdown"] == "# Hi\n\nx" and got["d"]["markdown"] == "plain\n\ntext" and got["c"]["markdown"].startswith("**1 file(s) changed** (+1 -1)")
    assert [got[k]["error"] for k in "defg"] == [None, "source is empty", "unsupported file type", "not a recognizable diff/patch"]
    assert {r["id"]: r["outline"][:10] for r in api.read_outlines(docs).collect()}["a"] == "1 headings"
    assert {r["id"]: r["error"] for r in api.read_page(docs, 2).collect()}["a"] == "page 2 out of range: there are 1 page(s)"


def test_files_of_any_bytes(spark, tmp_path):
    """Text in several encodings, bytes that are none, magic signs, limits: never a failed job."""
    content = {"a.txt": "naïve café".encode(), "b.txt": "naïve — “x”".encode("cp1252"), "c.txt": "\ufeffmark".encode(), "d.txt": "wide é".encode("utf-16"), "e.bin": bytes(range(256)), "f.pdf": b"%PDF-1.4\xff\x00\xfe", "g.log": b"a", "h.docx": b"PK\x03\x04\x00\x01"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in detect.files(spark, str(tmp_path)).collect()}
    assert [rows[n]["text"] for n in ("a.txt", "b.txt", "c.txt", "d.txt", "g.log")] == ["naïve café", "naïve — “x”", "mark", "wide é", "a"]
    assert [rows[n]["kind"] for n in ("e.bin", "f.pdf", "g.log", "h.docx", "b.txt")] == ["unknown", "pdf", "logfile", "docx", "text"]
    value_of = lambda media: value(spark, detect.kind(F.lit("x"), F.lit(None).cast("string"), F.lit(media)))
    assert value_of("text/html; charset=utf-8") == "html" and value_of(" Application/JSON ;x") == "json"


def test_published_log_ratio(spark):
    """405 lines with two incidents: 5,315 tokens come to 135."""
    quiet = [f"2024-01-01 00:00:00 INFO request handled id={i:03d}".ljust(51)[:51] for i in range(200)]
    text = "\n".join([*quiet, "ERROR cannot connect to the store", "  at first", "  at second", *quiet, "FATAL out of memory", "  stopped"])
    out = logs.log_documents(explode_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text"), "id").first()["markdown"]
    assert len(out) / len(text) <= 0.03 and abs(len(text) / 4 - 5315) < 200


def test_long_documents_take_linear_time(spark):
    """100,000 lines, every second a heading, and 100,000 lines into pages, within a minute each."""
    md = "\n".join(f"{'#' * (i % 6 + 1)} t{i}\ntext" for i in range(50_000))
    began = time.perf_counter()
    rows = outline.headings(spark.createDataFrame([(1, md)], "k long, md string"), "k")
    assert rows.count() == 50_000 and rows.agg(F.max("end")).first()[0] == len(md)
    assert pages.pack_pages(spark.createDataFrame([(1, md)], "k long, md string"), "k", "md", 20_000).agg(F.sum("n_lines")).first()[0] == 100_000
    assert time.perf_counter() - began < 120


def plain_pages(text, budget):
    """Blocks packed by a plain loop over lists."""
    text = text.strip()
    if len(text) <= budget:
        return [text]
    blocks, open_, mark = [], None, ""
    for line in text.split("\n"):
        fence = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if open_ is not None:
            open_[1].append(line)
            if fence and fence[1][0] == mark[0] and len(fence[1]) >= len(mark) and line.strip() == fence[1]:
                open_ = None
        elif fence:
            open_, mark = ("fence", [line]), fence[1]
            blocks.append(open_)
        elif not line.strip():
            blocks.append(("", []))
        else:
            kind = "table" if line.lstrip(" ").startswith("|") else "text"
            if not blocks or blocks[-1][0] != kind:
                blocks.append((kind, []))
            blocks[-1][1].append(line)
    pages_, page = [], []
    size = lambda chunks: len("\n\n".join(chunks))
    for kind, lines in (b for b in blocks if b[1]):
        whole = "\n".join(lines)
        if size([*page, whole]) <= budget:
            page.append(whole)
            continue
        if len(whole) <= budget:
            pages_, page = [*pages_, page], [whole]
            continue
        head, tail, body = [], [], lines
        if kind == "table" and len(lines) > 1 and not lines[1].strip().strip("|-: "):
            head, body = lines[:2], lines[2:]
        if kind == "fence":
            sign = re.match(r" {0,3}(`{3,}|~{3,})", lines[0])[1]
            head, tail, body = lines[:1], [sign], lines[1:-1] if len(lines) > 1 and lines[-1].strip() == sign else lines[1:]
        if len("\n".join(head)) > budget // 2:
            head, tail, body = [], [], lines
        width = budget - sum(len(x) + 1 for x in head + tail)
        units = []
        for line in body:
            if len(line) <= width:
                units.append((line, False))
            while len(line) > width or (units and units[-1][1] is None):
                piece, at = line[:width], line[:width].rfind(" ")
                piece, rest = (line[:at], line[at + 1 :]) if 0 < at and at > width - width // 5 else (piece, line[width:])
                units.append((piece, True))
                line = rest
                if 0 < len(line) <= width:
                    units.append((line, True))
        room = budget - size(page) - 2
        if page and room < budget // 4:
            pages_, page = [*pages_, page], []
        chunk = []
        for text_, alone in units:
            if chunk and not alone and size([*page, "\n".join([*head, *chunk, text_, *tail])]) <= budget:
                chunk.append(text_)
            elif not chunk and (not page or (not alone and size([*page, "\n".join([*head, text_, *tail])]) <= budget)):
                chunk = [text_]
            else:
                if chunk:
                    page.append("\n".join([*head, *chunk, *tail]))
                pages_, page, chunk = [*pages_, page], [], [text_]
        page.append("\n".join([*head, *chunk, *tail]))
    return ["\n\n".join(p) for p in [*pages_, page] if p]


def test_blocks_into_pages_match_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    row = lambda: "| " + " | ".join(word() for _ in range(3)) + " |"
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 7)):
            kind = rng.randint(0, 4)
            if kind == 0:
                parts.append("\n".join([row(), "|---|:-:|---|", *[row() for _ in range(rng.randint(0, 25))]]))
            elif kind == 1:
                parts.append("\n".join(["```py", *[" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 25))], "```"]))
            elif kind == 2:
                parts.append(" ".join(word() for _ in range(rng.randint(60, 120))) + rng.choice(["", "x" * 400]))
            else:
                parts.append("\n".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))))
        texts.append(rng.choice(["\n\n", "\n\n\n", "\n"]).join(parts))
    texts += ["", "short", "```\nopen to the end\n" + "line of code\n" * 40]
    got = {}
    for r in pages.pack_blocks(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text", 200).collect():
        got.setdefault(r["k"], {})[r["page_no"]] = r["content"]
    for k, text in enumerate(texts):
        assert [got[k][n] for n in sorted(got[k])] == plain_pages(text, 200), k


def test_html_keeps_code_tables_lists_and_signs(spark):
    cases = [
        ('<article><pre class="language-Go"><code>func <a href="/f">f</a>() {\n\n  a &lt; b\n}\n</code></pre><p>it&#8217;s &#x41;&amp;&#39;x&#39;</p></article>', "```go\nfunc f() {\n\n  a < b\n}\n```\n\nit’s A&'x'"),
        ('<div class="highlight highlight-source-js"><pre>a\n```\nb</pre></div>', "````js\na\n```\nb\n````"),
        ("<ol><li>one <b>x</b></li><li>two</ol><p>end", "1. one **x**\n2. two\n\nend"),
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>", "| a | b\\|c |\n|---|---|\n| 1 |  |"),
        ("<p>see<sup><a href='#n1'>[12]</a></sup> <a href='/x'>this</a> <a href='#top'>up</a><a href='#h'>¶</a></p>", "see [this](/x) up"),
        ("<p>a</p><div hidden><p>no</p></div><span aria-hidden='true'>no</span><p style='color:red; display: none'>no</p><div role=navigation>no</div><p>b</p>", "a\n\nb"),
    ]
    for page, want in cases:
        assert page_markdown(spark, page) == want, page


def test_trees_leave_out_ignored_files_and_nested_repositories(spark, tmp_path):
    names = ["keep.txt", "debug.log", "build/out.bin", "src/build.py", "src/a/x.tmp", "src/a/keep.tmp", "docs/one.md", "other/docs/two.md"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    kept = {r["path"] for r in files.where(~trees.ignored(F.col("path"), ["*.log", "build/", "*.tmp", "!keep.tmp", "/docs", "#x"])).collect()}
    assert kept == {"keep.txt", "src/build.py", "src/a/keep.tmp", "other/docs/two.md"}
    rows = [("r", "inner/.git", 1), ("r", "inner/src/lib.go", 5), ("r", "own.go", 7), ("r", ".git/HEAD", 1)]
    out = trees.tree_summary(spark.createDataFrame(rows, "root string, path string, size long"), "root").first()["markdown"]
    assert "  inner/ (nested git repo/worktree, collapsed)" in out and "lib.go" not in out and "own.go" in out and ".git" not in out.replace("nested git", "")
    (tmp_path / "top" / "deep").mkdir(parents=True)
    (tmp_path / "top" / "deep" / "f.txt").write_text("12345")
    assert [tuple(r) for r in trees.scan(spark, str(tmp_path / "top")).collect()] == [("top", "deep/f.txt", 5)]


def test_mode_changes_and_long_fences(spark):
    rows = diffs.diff_files(diff_lines(spark, "diff --git a/x b/x\nold mode 100644\nnew mode 100755"), "id").collect()
    assert [r["status"] for r in rows] == ["mode changed"]
    out = diffs.diff_markdown(diff_lines(spark, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+`````\n"), "id").first()["markdown"]
    assert "\n``````diff\n" in out and out.endswith("\n``````")


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a|x", 1), (None, 3)], "kind string, n long")
    report.write_report(rows, str(tmp_path), "kind")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "markdown"), wholetext=True).collect())
    assert text.strip() == "| kind | n |\n|---|---|\n| a\\|x | 1 |\n| b | 2 |\n|  | 3 |" and spark.read.json(str(tmp_path / "json")).count() == 3
    label = lambda name, command: value(spark, report.tool_label(F.lit(name), F.lit(command)))
    assert [label("Bash", " ls -l"), label("mcp__files__read_it", None), label("Read", "x"), label("Bash", "")] == ["Bash(ls)", "read_it", "Read", "Bash"]


def test_json_reading(spark):
    rows = [("a", '{"n":1,"tags":["x",null,""],"o":{"p":null},"rows":[{"k":1,"s":"a|b"},{"k":2,"s":null},{"k":3,"s":"c"}]}'), ("b", "<html><body>x"), ("c", "{bad"), ("d", '{"rows":null}')]
    docs = spark.createDataFrame([(i, t, "x.json" if i == "c" else None, None) for i, t in rows], "id string, text string, path string, content_type string")
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL("n int, tags array<string>, o struct<p: string>, rows array<struct<k: int, s: string>>")
    read = lambda **o: {r["id"]: r["content"] or r["error"] for r in api.read_json(docs, kind, **o).collect()}
    assert read() == {"a": '{"n":1,"tags":["x"],"rows":[{"k":1,"s":"a|b"},{"k":2},{"k":3,"s":"c"}]}', "b": "not JSON (it looks like html): use read_docs", "c": "invalid JSON", "d": "{}"}
    assert read(most_items=1, drop=("s",))["a"] == '{"n":1,"tags":["x"],"rows":[{"k":1},"… 2 more items"]}'
    assert read(select=lambda r: r["rows"], table=True)["a"] == "| k | s |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |\n| 3 | c |"
    assert read(outline=True)["a"].split("\n", 1)[1] == '{\n n: number (1)\n tags: [3] string ("x")\n o: {}\n rows: [3] {k: number (1), s?: string ("a|b")}\n}'
    assert read(select=lambda r: json_docs.select_index(r["rows"], 9))["a"].startswith("nothing matches the selection")
