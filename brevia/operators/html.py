"""Web pages as columns: title, links, visible text. Expressions over the source text; no tree is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.functions.text import tidy_markdown

#: Elements without readable text (fixed values).
DROPPED = ["script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "picture", "video", "audio", "button", "select", "textarea", "dialog"]
#: Page furniture, dropped where no article is found (fixed values).
CHROME = ["nav", "header", "footer", "aside", "form"]
#: Query parameters that only track (fixed values).
TRACKING = r"(?:utm_[^=&]*|fbclid|gclid|ref_src)"


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def links(html: Column) -> Column:
    """The href of every anchor, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=("[^"]*"|'[^']*'|[^\s>"']+)"""), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']\z""", ""))


def rewrite_link(url: Column, base_scheme: Column, base_host: Column) -> Column:
    """A link without tracking parameters, root-relative on the page's own host; null for anchors, javascript: and data:."""
    fragment = F.regexp_extract(url, r"#.*$", 0)
    bare = F.regexp_replace(url, r"#.*$", "")
    query = F.when(F.instr(bare, "?") > 0, F.substring_index(bare, "?", -1)).otherwise("")
    path = F.substring_index(bare, "?", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|\\z)"))
    tracked = query.rlike(f"(^|&){TRACKING}(=|&|\\z)")
    rest = F.when(tracked, F.array_join(F.array_sort(pairs), "&")).otherwise(query)
    own = F.concat(base_scheme, F.lit("://"), base_host)
    local = F.when(path == own, "/").when(path.startswith(F.concat(own, F.lit("/"))), F.substr(path, F.length(own) + 1)).otherwise(path)
    full = F.concat(local, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""), fragment)
    return F.when(url.rlike(r"^(#|javascript:|data:)") | (url == ""), F.lit(None)).otherwise(full)


def strip(html: Column) -> Column:
    """Readable text: elements of ``DROPPED``, comments and tags go, white space is collapsed."""
    held = lambda low: F.filter(F.array(*map(F.lit, DROPPED)), lambda tag: low.contains(F.concat(F.lit("<"), tag)))
    element = lambda tag: F.concat(F.lit("(?is)<"), tag, F.lit(r"(\s[^>]*)?>.*?</"), tag, F.lit(">"))
    open_tags = F.transform(F.array(F.lower(html)), held)[0]  # what goes leaves a blank, so no tag comes up later
    bare = F.aggregate(open_tags, F.regexp_replace(html, r"(?s)<!--.*?-->", " "), lambda left, tag: F.regexp_replace(left, element(tag), F.lit(" ")))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[\s ]+", " "))


#: Character references (fixed values); the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


#: Roles of page furniture (fixed values).
ROLES = ["navigation", "banner", "contentinfo", "search", "dialog", "alertdialog", "menu", "menubar", "complementary"]
_TAGS = r"(?:\s|<[^>]*>)*"
#: Citation marks and links that only show where they are (fixed values inside).
MARKS = [
    (rf"(?is)<sup(?:\s[^>]*)?>{_TAGS}\[{_TAGS}(?:\d+|[a-z]|note \d+|nb \d+|citation needed|clarification needed){_TAGS}\]{_TAGS}</sup>", ""),
    (rf"(?is)<a(?:\s[^>]*)?>{_TAGS}(?:#|¶|§|🔗|link|permalink)?{_TAGS}</a>", ""),
]
#: A private sign before an item for each list that its own list is in (see ``tags.pruned``).
NESTED = "\ue002"
#: Tags to Markdown, in order, as (pattern, replacement with $1 and so on).
MARKDOWN = [
    (r"(?is)<head(?:\s[^>]*)?>.*?</head>", ""), (r"[\s ]+", " "),
    *[(rf"(?i)<h{n}(?:\s[^>]*)?> ?(.*?) ?</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (r"""(?i)<a\s[^>]*?href=(?:"(?:#|javascript:|data:)[^"]*"|'(?:#|javascript:|data:)[^']*')[^>]*>(.*?)</a>""", "$1"),
    (r"""(?i)<a\s[^>]*?href=(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*> ?(.*?) ?</a>""", "[$4]($1$2$3)"), (r"(?i)</?(?:code|kbd|samp)(?:\s[^>]*)?>", "`"), (r"(?i)<(?:b|strong)(?:\s[^>]*)?> ?(.*?) ?</(?:b|strong)>", "**$1**"),
    (r"(?i)<(?:i|em)(?:\s[^>]*)?> ?(.*?) ?</(?:i|em)>", "*$1*"), (r"(?i)<(?:del|s|strike)(?:\s[^>]*)?> ?(.*?) ?</(?:del|s|strike)>", "~~$1~~"), (rf"(?i) ?({NESTED}*)<li(?:\s[^>]*)?> ?", "\n$1- "), (r"(?i)<br ?/?>", "\n"), (r"(?i)<hr ?/?>", "\n\n---\n\n"), (r"(?i)<blockquote(?:\s[^>]*)?> ?", "\n\n> "),
    (r"(?i)</?(?:p|div|ul|ol|table|tr|section|article|main|figure|header|footer|nav|aside|form|blockquote|body)(?:\s[^>]*)?>", "\n\n"), (r"(?s)<[^>]*>", ""),
]
#: Elements that are turned into Markdown as a whole: code, tables, ordered lists without lists inside.
WHOLE = r"(?is)<pre(?:\s[^>]*)?>.*?</pre>|<table(?:\s[^>]*)?>(?:(?!<table).)*?</table>|<ol(?:\s[^>]*)?>(?:(?!<[ou]l).)*?</ol>"
#: How a block of code says its language (fixed values).
LANGUAGE = r"""(?i)(?:language-|lang-|brush:\s*|highlight-source-|sourceCode\s+|data-lang(?:uage)?\s*=\s*["']?)([\w+#-]+)"""
_CUT = "\ue000"


def _through(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def unescape(text: Column) -> Column:
    """Character references, by name and by number, as what they stand for; the ampersand last."""

    def one(x: Column, i: Column) -> Column:
        code = F.regexp_extract(x, r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", 1)
        number = F.when(code != "", F.conv(code, 16, 10)).otherwise(F.regexp_extract(x, r"^([0-9]{1,7});", 1)).cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(i == 0, x).when(known, F.concat(sign, F.regexp_replace(x, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x))

    numbered = lambda x: F.when(x.contains("&#"), F.array_join(F.transform(F.split(x, "&#", -1), one), "")).otherwise(x)
    text = F.transform(F.array(text), numbered)[0]
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def _inline(html: Column) -> Column:
    return unescape(_through(html, MARKDOWN))


def _code(html: Column, before: Column) -> Column:
    """A block of code in a fence longer than any run of ` in it, with the language that it or its wrapper says."""
    own = F.regexp_extract(F.regexp_extract(html, r"(?is)^<pre[^>]*>\s*(?:<code[^>]*>)?", 0), LANGUAGE, 1)
    wrapper = F.regexp_extract(F.regexp_extract(before, r"(?is)(?:<div[^>]*>\s*){1,2}\z", 0), LANGUAGE, 1)
    language = F.lower(F.when(own != "", own).otherwise(wrapper))
    text = unescape(F.regexp_replace(F.regexp_replace(html, r"(?i)<br ?/?>", "\n"), r"(?s)<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"^\r?\n|\s+\z", ""), r"\r\n?", "\n")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(mark, language, F.lit("\n"), text, F.lit("\n"), mark)


def _table(html: Column) -> Column:
    """Rows of cells; a rule follows the first row, and short rows are padded to the widest."""
    cell = lambda c: F.trim(F.regexp_replace(F.replace(_inline(c), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=<tr[\s>]|</table|</tr>)"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)(?=<t[dh][\s>]|</t[dh]>|\z)"), F.lit(1)), cell))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), width))
    return F.when(width > 0, F.array_join(F.transform(rows, lambda r, i: F.concat(line(r), F.when(i == 0, rule).otherwise(""))), "\n")).otherwise("")


def _numbered(html: Column) -> Column:
    items = F.split(F.regexp_replace(html, r"(?i)<li(?:\s[^>]*)?>", _CUT), _CUT)
    return F.array_join(F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.trim(F.regexp_replace(F.replace(_inline(x), F.lit(NESTED), F.lit("")), r"\s+", " ")))), "\n")


def _cleaned_links(body: Column) -> Column:
    """body with the tracking parameters of its links gone; links that go nowhere stay for the rules of Markdown."""
    pieces = lambda x: F.split(F.regexp_replace(x, r"""(?i)(<a\s[^>]*?href=)("[^"]*"|'[^']*'|[^\s>"']+)""", f"$1{_CUT}$2{_CUT}"), _CUT, -1)

    def link(x: Column) -> Column:
        url = F.replace(F.regexp_replace(x, r"""^["']|["']\z""", ""), F.lit("&amp;"), F.lit("&"))
        return F.concat(F.lit('"'), F.coalesce(rewrite_link(url, F.lit(""), F.lit("")), url), F.lit('"'))

    tracked = rf"(?i)href=[^>]*[?&;]{TRACKING}"
    cleaned = lambda b: F.when(b.rlike(tracked), F.array_join(F.transform(pieces(b), lambda x, i: F.when(i % 2 == 0, x).otherwise(link(x))), "")).otherwise(b)
    return F.transform(F.array(body), cleaned)[0]


def body_markdown(body: Column, name: Column) -> Column:
    """The readable part of a page (see ``tags.pruned``) as Markdown, under its title unless a heading opens it."""
    body = _through(_cleaned_links(F.replace(body, F.lit(_CUT), F.lit(""))), MARKS)
    cut_up = F.split(F.regexp_replace(body, WHOLE, f"{_CUT}$0{_CUT}"), _CUT, -1)
    spaced = [(r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"^\n+|\n+\z", "")]
    plain = lambda x: F.trim(_through(tidy_markdown(_inline(x)), spaced))
    made = lambda p, x: F.when(x.startswith("<p"), _code(x, p)).when(x.rlike("(?i)^<table"), _table(x)).otherwise(_numbered(x))
    parts = lambda cut: F.transform(cut, lambda x, i: F.when(i % 2 == 0, plain(x)).otherwise(made(F.element_at(cut, i), x)))
    tidy = F.replace(F.array_join(F.filter(F.transform(F.array(cut_up), parts)[0], lambda x: x != ""), "\n\n"), F.lit(NESTED), F.lit("  "))
    return F.transform(F.array(tidy), lambda x: F.when((name == "") | x.startswith("# "), x).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), x)))[0]


def needs_js(html: Column) -> Column:
    """Little text and a script: the page builds itself in a browser."""
    return F.lower(html).contains("<script") & (F.octet_length(strip(html)) < 300)


def pages_summary(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_chars of text and needs_js."""
    return pages.select("page_id", title(F.col("html")).alias("title"), F.size(links(F.col("html"))).alias("n_links"), F.char_length(strip(F.col("html"))).alias("n_chars"), needs_js(F.col("html")).alias("needs_js"))
