"""Elements of nested pages against trees whose elements are removed one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brevia import api
from brevia.operators import html, tags

HIDES = [("hidden", "always"), ("aria-hidden='true'", "always"), ('style="color:red;display:none"', "always"), ('role="dialog"', "chrome"), ("class=x", None), ("", None), ("", None), ("data-hidden=1", None)]


def tree(rng, depth=0):
    """(name, attribute, what it does, children); a text is a word."""
    if depth > 5 or rng.random() < 0.3:
        return f"w{rng.randrange(1000)}"
    name = rng.choice(["div", "div", "ul", "section", "p", "nav", "aside", "span", "article" if depth > 1 else "div", "button"])
    attribute, does = rng.choice(HIDES)
    does = "always" if name == "button" else does or ("chrome" if name in ("nav", "aside") else None)
    return name, attribute, does, [tree(rng, depth + 1) for _ in range(rng.randrange(4))]


def source(rng, node):
    if isinstance(node, str):
        return rng.choice(["{} ", " {}<br> ", "{} <hr/>", "{} <!-- <div hidden> --> "]).format(node)
    name = rng.choice([str.upper, str])(node[0])
    return f"<{name} {node[1]}>".replace(" >", ">") + "".join(source(rng, c) for c in node[3]) + f"</{name}>" + rng.choice(["", " ", "</b>", "</em> "])


def words(node, without):
    if isinstance(node, str):
        return [node]
    return [] if node[2] in without else [w for c in node[3] for w in words(c, without)]


def article(node):
    """The first article that nothing hides."""
    if isinstance(node, str) or node[2] == "always":
        return None
    return node if node[0] == "article" else next((a for c in node[3] if (a := article(c))), None)


def test_elements_go_as_a_whole(spark):
    rng = random.Random(11)
    trees = [("div", "", None, [tree(rng) for _ in range(4)]) for _ in range(250)]
    pages = [(k, source(rng, t)) for k, t in enumerate(trees)]
    got = {r["k"]: r["text"] for r in tags.pruned(spark.createDataFrame(pages, "k int, html string"), "k", "html").select("k", html.strip(F.col("body")).alias("text")).collect()}
    seen = 0
    for k, t in enumerate(trees):
        main = article(t)
        assert got[k].split() == (words(main, {"always"}) if main else words(t, {"always", "chrome"})), pages[k]
        seen += bool(main)
    assert 30 < seen < 220


def test_odd_pages(spark):
    rows = [(1, "<div hidden><div>a</div>b</div>c"), (2, "<nav><nav>x</nav>y</nav>z"), (3, "<div hidden>never ends <p>a</p>"), (4, "</div></nav>a<nav>b</nav>"), (5, None), (6, ""), (7, "no tags < 5"), (8, "<script>if (a < b) '</div>'</script><style>p{}</style>x<!-- never ends"),
            (9, "<div hidden>" * 3000 + "x" + "</div>" * 3000 + "y"), (10, "<article>a</article><article>b</article>"), (11, "<article hidden>a</article><article><div hidden>b<div></div></div>c</article>"), (12, "\ue000<p>z")]
    got = {r["k"]: html_text for r in tags.pruned(spark.createDataFrame(rows, "k int, html string"), "k", "html").select("k", html.strip(F.col("body")).alias("text")).collect() for html_text in [r["text"]]}
    assert got == {1: "c", 2: "z", 3: "never ends a", 4: "a", 6: "", 7: "no tags < 5", 8: "x", 9: "y", 10: "a", 11: "c", 12: "z"}


def test_lists_links_and_marks_keep_their_meaning(spark):
    cases = [
        ("<ul><li>a<ul><li>b<ul><li>c</li></ul></li><li>d</li></ul></li><li>e</li></ul><p>f", "- a\n  - b\n    - c\n  - d\n- e\n\nf"),
        ("<p>was <del>old</del> <s class=x> gone </s>new <strong>x</strong></p><strike>y</strike>", "was ~~old~~ ~~gone~~new **x**\n\n~~y~~"),
        ("<a href='/p?utm_source=a&amp;b=2&amp;a=1&gclid=3#x'>one</a> <a href=\"https://h.org/?utm_medium=q\">two</a> <a href=/r?c=3>three</a> <a href='#up'>up</a>", "[one](/p?a=1&b=2#x) [two](https://h.org/) [three](/r?c=3) up"),
        ("<ul><li>a<ol><li>x</li><li>y</li></ol></li></ul>", "- a\n\n1. x\n2. y"),
    ]
    frame = spark.createDataFrame([(k, page) for k, (page, _) in enumerate(cases)], "k int, html string")
    got = {r["k"]: r["markdown"] for r in tags.markdown(frame, "k", "html").collect()}
    for k, (page, want) in enumerate(cases):
        assert got[k] == want, page


def test_pages_are_read_with_their_repeats(spark):
    rows = [("a", "<html><body><div hidden><div>x</div>y</div><p>one"), ("a", "<html><body><p>two"), ("a", "<html><body><p>two"), ("b", "<html>" + "<p>x" * 200 + "<script>1</script>")]
    docs = spark.createDataFrame(rows, "id string, text string").withColumns({"path": F.lit(None).cast("string"), "content_type": F.lit("text/html")})
    got = sorted((r["id"], r["markdown"], r["error"]) for r in api.read_docs(docs).collect())
    assert [g[:2] for g in got[:3]] == [("a", "one"), ("a", "two"), ("a", "two")] and not any(g[2] for g in got)
